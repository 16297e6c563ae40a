"""Registered queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat, fmindex, jaccard, langid, mtree, packing, phrases, quality, ranked, simhash, suffixsort, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digest_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op5_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fmindex.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_probe(table(spark, sf_dir, "conversations"))
    return chat.digest_conversations(rows, public_tokenizers.path("byte_bpe_50k.json"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixsort.suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_byte_bpe, op3_top_k, op4_quality_rules, op5_fm_dedup, op6_chat_format, op7_suffix_dedup, op8_simhash, op9_language_id, op10_packing, op11_phrases, op12_ranked_search, op13_jaccard_join)}

#: DuckDB SQL for the operators that SQL can express exactly.
SQL: dict[str, str] = {
    "op3_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op6_chat_format": """
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
            CAST(sum(17 + length(replace(replace(role, '\\', '\\\\'), '<', '\\l')) + length(replace(replace(text, '\\', '\\\\'), '<', '\\l'))) AS BIGINT) AS formatted_chars
        FROM c GROUP BY conv_id
    """,
    "op4_quality_rules": """
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
        g AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
        again AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
        covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
        counts AS (
            SELECT rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
            FROM w LEFT JOIN covered USING (rid)
        ),
        judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
        hosts AS (SELECT source, count(*) AS n, CAST(sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS DOUBLE) AS failed FROM judged GROUP BY source),
        rated AS (SELECT *, failed / n AS rate FROM hosts),
        fit AS (
            SELECT *, count(*) OVER () - 1 AS others, (sum(failed) OVER () - failed + 0.5e0) / (sum(n) OVER () - n + 1) AS m,
                sum(rate) OVER () - rate AS rates, sum(rate * rate) OVER () - rate * rate AS squares, sum(1e0 / n) OVER () - 1e0 / n AS inverse FROM rated
        ),
        spread AS (SELECT *, m * (1 - m) AS spread, CASE WHEN others > 0 THEN (squares - 2 * m * rates) / others + m * m - m * (1 - m) * inverse / others END AS excess FROM fit),
        prior AS (SELECT *, CASE WHEN excess > 0 THEN greatest(1e0, least(200e0, spread / excess - 1)) ELSE 200e0 END AS k FROM spread),
        verdict AS (SELECT source, others, round((failed + m * k) / (n + k), 6) AS host_rate, round(greatest(0.05e0, m + 3 * sqrt(spread / (k + 1))), 6) AS host_bar FROM prior)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND NOT (others > 0 AND host_rate > host_bar) AS kept, host_rate, host_bar
        FROM judged JOIN verdict ON judged.source IS NOT DISTINCT FROM verdict.source
    """,
    "op5_fm_dedup": """
        WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        g AS (SELECT rid, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
        hit AS (SELECT rid, i FROM g QUALIFY doc_id > min(doc_id) OVER (PARTITION BY g)),
        gone AS (SELECT DISTINCT rid, i + k AS pos FROM hit, (SELECT unnest(range(0, 13)) AS k)),
        words AS (SELECT rid, i AS pos, ws[i] AS word FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
        kept AS (SELECT rid, string_agg(word, ' ' ORDER BY pos) AS kept FROM words ANTI JOIN gone USING (rid, pos) GROUP BY rid)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN (SELECT rid, count(*) AS n FROM gone GROUP BY rid) USING (rid) LEFT JOIN kept USING (rid)
    """,
    "op7_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        s AS (SELECT rid, doc_id, i, substr(h, 2 * i + 1, 200) AS g FROM (SELECT rid, doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d)),
        hit AS (SELECT rid, i FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
        runs AS (SELECT *, i > lag(i, 1, -1000) OVER (PARTITION BY rid ORDER BY i) + 100 AS new, least(100, lead(i, 1, 1000000000) OVER (PARTITION BY rid ORDER BY i) - i) AS own FROM hit),
        spans AS (SELECT rid, i, own, sum(CAST(new AS INTEGER)) OVER (PARTITION BY rid ORDER BY i) AS span FROM runs),
        cuts AS (SELECT rid, span, min(i) AS a, max(i) + 100 AS b FROM spans GROUP BY rid, span),
        edges AS (SELECT rid, b, lead(a, 1, 1000000000) OVER (PARTITION BY rid ORDER BY a) AS a FROM (SELECT * FROM cuts UNION ALL SELECT rid, 0, -1, 0 FROM d)),
        kept AS (SELECT rid, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY b) AS kept FROM edges JOIN d USING (rid) GROUP BY rid),
        counts AS (SELECT rid, sum(own) AS n FROM spans GROUP BY rid)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(counts.n, 0) AS BIGINT) AS n_removed, coalesce(c.n, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
        FROM d JOIN kept USING (rid) LEFT JOIN counts USING (rid) LEFT JOIN (SELECT rid, count(*) AS n FROM cuts GROUP BY rid) c USING (rid)
    """,
    "op12_ranked_search": """
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents
        ), s AS (SELECT count(*) AS nn, sum(len(ts)) AS ll FROM d WHERE len(ts) > 0),
        q AS (
            SELECT item_id, t, count(*) AS times
            FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t
        ), p AS (SELECT rid, doc_id, n, t, count(*) AS tf FROM (SELECT rid, doc_id, len(ts) AS n, unnest(ts) AS t FROM d) GROUP BY rid, doc_id, n, t),
        w AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t, nn),
        r AS (
            SELECT item_id, rid, doc_id, CAST(sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
            FROM q JOIN p USING (t) JOIN w USING (t), s GROUP BY item_id, rid, doc_id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM r WHERE score > 0 QUALIFY rank <= 10
    """,
    "op11_phrases": """
        WITH p AS (
            SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws
            FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
        ), starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
        g AS (SELECT lang, array_to_string(ws[i:i + k], ' ') AS phrase, k + 1 AS size, count(*) AS f FROM starts, (SELECT unnest(range(0, 4)) AS k) WHERE i + k <= len(ws) GROUP BY ALL HAVING f >= 30),
        n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
        c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM g WHERE size > 1),
        cut AS (
            SELECT c.lang, c.phrase, c.size, a, k, x.f AS l, y.f AS r, CAST((2000000 * CAST(a AS HUGEINT)) // (x.f + y.f) AS BIGINT) AS score
            FROM c JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')
        ), w AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        kept AS (
            SELECT * FROM w WHERE NOT EXISTS (
                SELECT 1 FROM g b WHERE b.lang = w.lang AND b.size > w.size AND 100 * b.f >= 80 * w.a AND contains(' ' || b.phrase || ' ', ' ' || w.phrase || ' '))
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
    """,
    "op13_jaccard_join": """
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
        ), s AS (
            SELECT rid, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM d
        ), t AS (SELECT rid, len(g) AS n, unnest(g) AS g FROM s),
        links AS (SELECT a.rid AS u, b.rid AS v FROM t a JOIN t b USING (g) GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reach AS (SELECT rid AS a, rid AS b FROM s UNION SELECT a, v FROM reach JOIN links ON b = u)
        SELECT x.doc_id, CAST(len(x.g) AS BIGINT) AS n_shingles, min(y.doc_id) AS component_id
        FROM s x JOIN reach ON x.rid = a JOIN s y ON y.rid = b GROUP BY x.rid, x.doc_id, x.g
    """,
}
