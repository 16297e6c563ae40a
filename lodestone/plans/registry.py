"""All registered queries of the knowledge-corpus operators with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import changes, graph, index, pages, search, structure, timeline
from lodestone.plans import checks, ingests, reports, texts  # noqa: F401  they register their queries
from lodestone.plans.register import QUERIES, SQL, query  # noqa: F401
from lodestone.sources import intake
from lodestone.sources.derived import DUCK_PAGES, EVENT_PHASES, as_markdown, progress_events, segments_of, table, wiki_files, wiki_pages
from lodestone.storage import stored

QUESTIONS = [(1, "BUILDING order"), (2, "customer#000000007"), (3, "the and"), (4, "asia europe"), (5, "1-urgent"), (6, "land of france"), (7, "xyzzy")]


def _with(*more: str, then: str) -> str:
    return ", ".join([DUCK_PAGES.rstrip(), *more]) + " " + then


LINKS = "links AS (SELECT path AS from_path, CAST(unnest(generate_series(0, len(t) - 1)) AS INTEGER) AS ordinal, unnest(t) AS to_path FROM (SELECT path, regexp_extract_all(content, '\\[\\[([^\\]|#]+)(?:[|#][^\\]]*)?\\]\\]', 1) AS t FROM wiki))"
RESOLVED = "resolved AS (SELECT l.* FROM links l WHERE to_path IN (SELECT path FROM wiki))"
BACK = "back AS (SELECT to_path AS path, count(DISTINCT from_path) AS n FROM resolved WHERE from_path <> to_path GROUP BY 1)"
TOKENS = "CAST(length(regexp_replace({0}, '[\\x00-\\x7F]', '', 'g')) + ceil((length({0}) - length(regexp_replace({0}, '[\\x00-\\x7F]', '', 'g'))) / 4.0) AS BIGINT)"
SPACE = "\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
PLAIN = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(tldr, '\\|[^\\n]*\\|', ' ', 'g'), '\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]', '\\1', 'g'), '[`*_>#-]', ' ', 'g'), '[{SPACE}]+', ' ', 'g'))"
HEADINGS = f"list_filter(list_transform(regexp_extract_all(body, '(?m)^#{{1,6}}[{SPACE}]+(.+?)[{SPACE}]*$', 1), lambda h: substring(trim(regexp_replace(h, '\\s+#+\\s*$', '')), 1, 200)), lambda h: h <> '' AND h <> coalesce(title, '') AND h <> '关联条目')[1:80]"
CARDS = f"""out_ AS (SELECT from_path AS path, count(DISTINCT to_path) AS n FROM links WHERE from_path <> to_path GROUP BY 1),
    bare AS (SELECT w.path, sha256(content) AS hash, type, substring(title, 1, 240) AS title, list_sort(list_transform(aliases[1:20], lambda x: substring(x, 1, 160))) AS aliases, list_sort(list_transform(tags[1:30], lambda x: substring(x, 1, 80))) AS tags,
        CASE WHEN length({PLAIN}) > 180 THEN rtrim(substring({PLAIN}, 1, 179)) || '…' ELSE {PLAIN} END AS tldr, {HEADINGS} AS headings, coalesce(o.n, 0) AS n_outgoing, coalesce(b.n, 0) AS n_backlinks
        FROM (SELECT * REPLACE (CASE WHEN tldr = '' THEN title ELSE tldr END AS tldr) FROM wiki) w LEFT JOIN out_ o ON w.path = o.path LEFT JOIN back b ON w.path = b.path),
    cards AS (SELECT *, {TOKENS.format("card")} AS tokens FROM (SELECT *, CAST(to_json(struct_pack(path := path, hash := hash, type := type, title := title, aliases := aliases, tags := tags, tldr := tldr, headings := headings, outgoingCount := n_outgoing, backlinkCount := n_backlinks)) AS VARCHAR) AS card FROM bare))"""


@query("corpus_fingerprint", f"SELECT lang, CAST(sum(c) AS BIGINT) AS n_docs, count(*) AS n_distinct, CAST(sum(t) AS BIGINT) AS tokens FROM (SELECT lang, sha256(text), count(*) AS c, max({TOKENS.format('text')}) AS t FROM documents GROUP BY 1, 2) GROUP BY lang")
def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return structure.fingerprint(table(spark, d, "documents"))


@query("document_quality", rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    m AS (SELECT *, length(regexp_replace(text, '[^\x{{FFFD}}]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE) AS ratio, len(list_filter(lines, lambda x: length(x) > 2000)) AS n_long,
        list_reduce(list_filter(list_transform(lines, lambda x: substring(regexp_extract(x, '^\s*(```|~~~)', 1), 1, 1)), lambda m: m <> ''), lambda a, m: CASE WHEN a = '' THEN m WHEN a = m THEN '' ELSE a END, '') AS fence FROM d),
    e AS (SELECT *, concat_ws(',', CASE WHEN regexp_replace(text, '[{SPACE}]+', '', 'g') = '' THEN 'EMPTY' END, CASE WHEN ratio > 0.01 THEN 'REPLACEMENT_RATIO' END, CASE WHEN n_long > 0 THEN 'LONG_LINE' END,
        CASE WHEN octet_length(encode(text)) > 20971520 THEN 'TOO_LARGE' END, CASE WHEN fence <> '' THEN 'OPEN_FENCE' END) AS errors FROM m)
    SELECT doc_id, length(text) AS characters, ratio AS replacement_ratio, CAST(n_long AS INTEGER) AS long_lines, errors, CASE WHEN errors <> '' THEN 'fail' WHEN ratio > 0.001 THEN 'warning' ELSE 'pass' END AS overall FROM e""")
def document_quality(spark, d):
    return structure.quality(table(spark, d, "documents")).select("doc_id", "characters", "replacement_ratio", "long_lines", F.array_join("errors", ",").alias("errors"), "overall")


MARKDOWN = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos FROM documents),
    k AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 0 AND NOT (doc_id % 3 = 0 AND pos = 0) THEN '## ' || x WHEN pos % 7 = 3 THEN '```' ELSE x END AS line FROM l)"""
SECTIONS = rf"""{MARKDOWN}, f AS (SELECT *, sum(CAST(regexp_matches(line, '^\s*(```|~~~)') AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 AS open FROM k),
    h AS (SELECT *, NOT open AND regexp_matches(line, '^#{{1,6}}\s+.') AS is_heading FROM f),
    n AS (SELECT *, sum(CAST(is_heading AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h),
    g AS (SELECT doc_id, section, max(CASE WHEN is_heading THEN trim(regexp_extract(line, '^#{{1,6}}\s+(.+)$', 1)) END) AS heading, coalesce(max(CASE WHEN is_heading THEN length(regexp_extract(line, '^(#+)', 1)) END), 0) AS level,
        min(pos) + 1 AS start_line, max(pos) + 1 AS end_line, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '[{SPACE}]+$', '') AS content FROM n GROUP BY doc_id, section),
    secs AS (SELECT doc_id, 's' || lpad(CAST(CAST(section + CASE WHEN min(section) OVER (PARTITION BY doc_id) = 0 THEN 1 ELSE 0 END AS BIGINT) AS VARCHAR), 4, '0') AS section_id,
        coalesce(heading, CASE WHEN max(section) OVER (PARTITION BY doc_id) = 0 THEN 'Document' ELSE 'Preamble' END) AS heading, CAST(level AS INTEGER) AS level, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, {TOKENS.format('content')} AS tokens, content FROM g)"""


@query("document_sections", f"WITH {SECTIONS} SELECT * FROM secs")
def document_sections(spark, d):
    return structure.sections(as_markdown(table(spark, d, "documents"))).drop("page")


@query("token_chunks")
def token_chunks(spark, d):
    return structure.token_chunks(table(spark, d, "documents"))


@query("markdown_chunks")
def markdown_chunks(spark, d):
    return structure.markdown_chunks(as_markdown(table(spark, d, "documents")))


@query("markdown_blocks")
def markdown_blocks(spark, d):
    return structure.blocks(as_markdown(table(spark, d, "documents")))


@query("normalized_texts")
def normalized_texts(spark, d):
    return structure.normalized(as_markdown(table(spark, d, "documents")))


@query("representative_sections", f"""WITH {SECTIONS} SELECT doc_id, section_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_id) AS n FROM secs WHERE level <= 2) WHERE n <= 16
    UNION SELECT doc_id, max(section_id) FROM secs GROUP BY 1""")
def representative_sections(spark, d):
    return structure.representative_sections(structure.sections(as_markdown(table(spark, d, "documents"))))


@query("web_pages")
def web_pages(spark, d):
    return structure.web_pages(table(spark, d, "pages"))


@query("page_links", _with(LINKS, then="SELECT * FROM links"))
def page_links(spark, d):
    return index.page_links(wiki_pages(spark, d))


@query("backlinks", _with(LINKS, RESOLVED, then="SELECT DISTINCT to_path AS path, from_path FROM resolved WHERE from_path <> to_path"))
def backlinks(spark, d):
    pages = wiki_pages(spark, d)
    return index.backlinks(index.page_links(pages), pages)


@query("nav_cards", _with(LINKS, RESOLVED, BACK, CARDS, then="SELECT path, hash, type, title, array_to_string(aliases, ';') AS aliases, array_to_string(tags, ';') AS tags, tldr, array_to_string(headings, ';') AS headings, n_outgoing, n_backlinks, tokens FROM cards"))
def nav_cards(spark, d):
    lists = [F.array_join(c, ";").alias(c) for c in ("aliases", "tags", "headings")]
    return index.nav_cards(wiki_pages(spark, d)).select("path", "hash", "type", "title", "tldr", "n_outgoing", "n_backlinks", "tokens", *lists)


@query("index_page_budget", _with(LINKS, RESOLVED, BACK, CARDS, then="""SELECT type, path, CAST(r AS INTEGER) AS rank, CAST(spent AS BIGINT) AS spent, CAST(CASE WHEN max(r) OVER (PARTITION BY type) < total THEN max(r) OVER (PARTITION BY type) END AS INTEGER) AS next_offset
    FROM (SELECT *, sum(tokens) OVER (PARTITION BY type ORDER BY path) AS spent FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY path) AS r, count(*) OVER (PARTITION BY type) AS total FROM cards) WHERE r > 10 AND r <= 110) WHERE spent <= 8000 OR r = 11"""))
def index_page_budget(spark, d):
    return index.budget_page(index.nav_cards(wiki_pages(spark, d)), offset=10, limit=100)


@query("root_view", _with(LINKS, RESOLVED, BACK, CARDS, then="""SELECT CASE WHEN t <= 12000 THEN 'complete' ELSE 'layered' END AS mode, t AS complete_tokens, path, type, CAST(r AS INTEGER) AS rank, tokens FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY path) AS r,
    CAST(sum(w) OVER () + ceil((sum(length(card) - w) OVER () + count(*) OVER () + 1) / 4.0) AS BIGINT) AS t FROM (SELECT *, length(regexp_replace(card, '[\\x00-\\x7F]', '', 'g')) AS w FROM cards)) WHERE t <= 12000 OR r <= 5"""))
def root_view(spark, d):
    return index.root_view(index.nav_cards(wiki_pages(spark, d)))


@query("root_document")
def root_document(spark, d):
    pages = wiki_pages(spark, d)
    return index.root_document(index.nav_cards(pages), pages)


@query("index_revision", _with("r AS (SELECT substring(sha256(path), 1, 3) AS bucket, path, sha256(path || '|' || sha256(content) || '|' || coalesce(array_to_string(list_sort(list_distinct(list_filter(links, lambda x: x <> path))), ','), '')) AS h FROM wiki)", then="SELECT sha256(string_agg(h, '' ORDER BY bucket)) AS revision FROM (SELECT bucket, sha256(string_agg(h, '' ORDER BY path)) AS h FROM r GROUP BY bucket)"))
def index_revision(spark, d):
    return index.revision(wiki_pages(spark, d))


@query("visible_index", _with(f"t AS (SELECT type, title, path, {PLAIN} AS tldr FROM wiki)", then="""SELECT k.type, CAST(coalesce(row_number() OVER (PARTITION BY t.type ORDER BY title, path), 0) * CASE WHEN path IS NULL THEN 0 ELSE 1 END AS INTEGER) AS position,
    coalesce('- [[' || path || '|' || title || ']] — ' || CASE WHEN length(tldr) > 180 THEN rtrim(substring(tldr, 1, 179)) || '…' ELSE tldr END, '') AS line FROM (SELECT unnest(['source', 'entity', 'concept', 'synthesis', 'output']) AS type) k LEFT JOIN t ON t.type = k.type"""))
def visible_index(spark, d):
    return index.visible_index(wiki_pages(spark, d))


@query("type_counts", _with(then="SELECT t.type, count(path) AS n FROM (SELECT unnest(['source', 'entity', 'concept', 'synthesis', 'output']) AS type) t LEFT JOIN wiki w ON w.type = t.type GROUP BY 1"))
def type_counts(spark, d):
    return index.type_counts(wiki_pages(spark, d))


@query("tag_counts", _with(then="SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM wiki) GROUP BY 1"))
def tag_counts(spark, d):
    return index.tag_counts(wiki_pages(spark, d))


@query("page_parse", _with(then="""SELECT path || '.md' AS path, string_split(path, '/')[-1] AS basename, type, title, tldr, 'draft' AS status, '2024-01-01' AS created, '2024-01-02' AS updated, array_to_string(tags, ';') AS tags, array_to_string(aliases, ';') AS aliases,
    CASE WHEN raw_path IS NULL OR path LIKE '%9' THEN '' ELSE '[[' || raw_path || ']]' END AS raw_path, content AS body, array_to_string(regexp_extract_all(content, '\\[\\[([^\\]|#]+)(?:[|#][^\\]]*)?\\]\\]', 1), ';') AS links FROM wiki"""))
def page_parse(spark, d):
    found = pages.parse_pages(wiki_files(spark, d))
    body = F.regexp_replace("body", "^\n", "")
    return found.select("path", "basename", "type", "title", "tldr", "status", "created", "updated", *(F.array_join(c, ";").alias(c) for c in ("tags", "aliases", "links")), "raw_path", body.alias("body"))


@query("canonical_pages")
def canonical_pages(spark, d):
    return pages.canonical_pages(wiki_files(spark, d), "2024-05-01").select("path", "changed", F.sha2("content", 256).alias("hash"), F.array_join("warnings", ",").alias("warnings"))


IDENTS = rf"""idents AS (SELECT DISTINCT path, type, i AS identity FROM (SELECT path, type, regexp_replace(lower(unnest(list_concat([title, string_split(path, '/')[-1]], aliases))), '[{SPACE}·・,，.。:：;；''"“”‘’()（）\[\]【】/_-]', '', 'g') AS i FROM wiki WHERE type IN ('entity', 'concept', 'synthesis')) WHERE length(i) >= 2)"""
CROSSED = """crossed AS (SELECT identity, string_agg(path, ';' ORDER BY path) AS paths FROM idents GROUP BY identity HAVING count(DISTINCT type) > 1), reported AS (SELECT min(identity) AS identity FROM crossed GROUP BY paths)"""


@query("lint", _with(LINKS, IDENTS, CROSSED, "known AS (SELECT path, lower(trim(title)) AS key FROM wiki WHERE trim(title) <> '')", "there AS (SELECT path FROM wiki UNION SELECT 'raw/articles/doc-' || doc_id FROM documents WHERE doc_id % 10 <> 0)", then=r"""
    SELECT code, severity, path || CASE WHEN code = 'missing-index' THEN '' ELSE '.md' END AS path, code = 'missing-index' AS fixable FROM (
    SELECT 'invalid-filename' AS code, 'warning' AS severity, path FROM wiki WHERE NOT regexp_matches(string_split(path, '/')[-1], '^[a-z0-9]+(-[a-z0-9]+)*$')
    UNION ALL SELECT 'missing-field', 'error', path FROM wiki WHERE title = ''
    UNION ALL SELECT 'missing-field', 'error', path FROM wiki WHERE tldr = ''
    UNION ALL SELECT 'missing-field', 'error', path FROM wiki WHERE status = ''
    UNION ALL SELECT 'dangling-link', 'error', from_path FROM links WHERE to_path NOT IN (SELECT path FROM there)
    UNION ALL SELECT 'orphan-page', 'warning', path FROM wiki WHERE path NOT IN (SELECT from_path FROM links) AND path NOT IN (SELECT to_path FROM links)
    UNION ALL SELECT 'missing-raw-path', 'error', path FROM wiki WHERE type = 'source' AND path LIKE '%9'
    UNION ALL SELECT 'missing-raw-file', 'warning', path FROM wiki WHERE type = 'source' AND path NOT LIKE '%9' AND 'raw/articles/' || substring(path, 14) NOT IN (SELECT path FROM there)
    UNION ALL SELECT 'duplicate-title', 'warning', path FROM known WHERE key IN (SELECT key FROM known GROUP BY key HAVING count(*) > 1)
    UNION ALL SELECT 'cross-type-duplicate', 'warning', path FROM idents WHERE identity IN (SELECT identity FROM reported)
    UNION ALL SELECT 'missing-index', 'warning', 'wiki/index')"""))
def lint(spark, d):
    raw = table(spark, d, "documents").where("doc_id % 10 <> 0").select(F.concat(F.lit("raw/articles/doc-"), "doc_id", F.lit(".md")).alias("raw_path"))
    return index.lint(pages.parse_pages(wiki_files(spark, d)), raw)


def _questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id int, query string")


QUESTIONS_SQL = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, lower('{t}'))" for i, t in QUESTIONS) + ") AS v(query_id, query)), terms AS (SELECT query_id, query, list_distinct(regexp_extract_all(query, '[a-z0-9][a-z0-9.+#/-]*')) AS terms, list_distinct(regexp_extract_all(query, '[\\p{L}\\p{N}_.+#/-]{2,}')) AS words FROM q)"
SCORED = """texts AS (SELECT path, type, tags, lower(title || ' ' || array_to_string(aliases, ' ')) AS t, lower(array_to_string(tags, ' ')) AS g, lower(tldr) AS s, lower(body) AS b, lower(title || ' ' || tldr || ' ' || body) AS x FROM wiki),
    scored AS (SELECT query_id, path, sum(CASE WHEN contains(t, term) THEN 12 ELSE 0 END + CASE WHEN contains(g, term) THEN 6 ELSE 0 END + CASE WHEN contains(s, term) THEN 4 ELSE 0 END
        + least((length(b) - length(replace(b, term, ''))) // length(term), 5)) AS score, bool_or(contains(t, term) OR contains(g, term)) AS strong FROM texts, (SELECT query_id, unnest(terms) AS term FROM terms) GROUP BY 1, 2),
    hits AS (SELECT query_id, path, score, r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS r FROM scored WHERE score > 0) WHERE r <= 8),
    ends AS (SELECT query_id, score, r, unnest(links) AS to_path, unnest(generate_series(1, len(links))) AS k FROM hits JOIN wiki USING (path)),
    hop AS (SELECT query_id, to_path AS path, greatest(1.0, score * 0.25) AS score, row_number() OVER (PARTITION BY query_id ORDER BY r, k) AS n FROM (SELECT * FROM ends e
        WHERE to_path IN (SELECT path FROM wiki) AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = e.query_id AND h.path = e.to_path) QUALIFY row_number() OVER (PARTITION BY query_id, to_path ORDER BY r, k) = 1)),
    both_ AS (SELECT query_id, path, CAST(score AS DOUBLE) AS score FROM hits UNION ALL SELECT query_id, path, CAST(score AS DOUBLE) FROM hop WHERE n <= 12 - (SELECT count(*) FROM hits h WHERE h.query_id = hop.query_id)),
    ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS INTEGER) AS rank, path, score FROM both_)"""
CAPPED = "least((length({0}) - length(replace({0}, {1}, ''))) // length({1}), 5)"


@query("ranked_search", _with(QUESTIONS_SQL, SCORED, then="SELECT * FROM ranked"))
def ranked_search(spark, d):
    return search.ranked_search(_questions(spark), wiki_pages(spark, d))


@query("strong_matches", _with(QUESTIONS_SQL, SCORED, then="SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS INTEGER) AS rank, path, CAST(score AS BIGINT) AS score FROM scored WHERE score >= 12 AND strong QUALIFY rank <= 4"))
def strong_matches(spark, d):
    return search.strong_matches(_questions(spark), wiki_pages(spark, d))


@query("search_modes", _with(QUESTIONS_SQL, SCORED, f"m AS (SELECT query_id, path, x, query, words FROM texts, terms), s AS (SELECT query_id, path, list_sum(list_transform(words, lambda t: {CAPPED.format('x', 't')})) AS score, len(list_filter(words, lambda t: contains(x, t))) = len(words) AS every, {CAPPED.format('x', 'query')} AS phrase FROM m)", then="""SELECT query_id, 'exact' AS mode, path, CAST(phrase AS BIGINT) AS score FROM s WHERE phrase > 0
    UNION ALL SELECT query_id, 'all_terms', path, CAST(score AS BIGINT) FROM s WHERE every AND score > 0 UNION ALL SELECT query_id, 'any_terms', path, CAST(score AS BIGINT) FROM s WHERE score > 0"""))
def search_modes(spark, d):
    return search.search_modes(_questions(spark), wiki_pages(spark, d))


@query("card_search", _with(LINKS, RESOLVED, BACK, CARDS, QUESTIONS_SQL, SCORED, "texts2 AS (SELECT c.path, lower(concat_ws(chr(10), c.title, array_to_string(c.aliases, ' '), c.tldr, array_to_string(c.tags, ' '), array_to_string(c.headings, ' '), array_to_string(w.links, ' '))) AS x FROM cards c JOIN wiki w USING (path))",
    f"cs AS (SELECT query_id, path, CAST(list_sum(list_transform(words, lambda t: {CAPPED.format('x', 't')})) AS DOUBLE) AS score, 'card' AS source FROM texts2, terms)",
    "chosen AS (SELECT * FROM cs WHERE score > 0 UNION ALL SELECT query_id, path, score, 'body' FROM ranked WHERE query_id NOT IN (SELECT query_id FROM cs WHERE score > 0))",
    then="SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS INTEGER) AS rank, path, score, source FROM chosen JOIN wiki USING (path) WHERE type IN ('entity', 'output', 'source') QUALIFY rank <= 8"))
def card_search(spark, d):
    wiki = wiki_pages(spark, d)
    cards = index.nav_cards(wiki).join(wiki.select("path", "links"), "path")
    return search.card_search(_questions(spark), cards, wiki, types=["entity", "output", "source"])


SECTION_QUESTIONS = [(1, "the und"), (2, "la que"), (3, "zzzz")]


@query("section_search", f"""WITH {SECTIONS}, q AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in SECTION_QUESTIONS)}) AS v(query_id, query)),
    s AS (SELECT query_id, doc_id, section_id, content, CAST(list_sum(list_transform(string_split(query, ' '), lambda t: {CAPPED.format('lower(content)', 't')})) AS BIGINT) AS score FROM secs, q)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, section_id) AS INTEGER) AS rank, doc_id, section_id, score, substring(regexp_replace(content, '[{SPACE}]+', ' ', 'g'), 1, 800) AS excerpt FROM s WHERE score > 0 QUALIFY rank <= 8""")
def section_search(spark, d):
    asked = spark.createDataFrame(SECTION_QUESTIONS, "query_id int, query string")
    return search.section_search(asked, structure.sections(as_markdown(table(spark, d, "documents"))))


@query("candidate_matches", _with(IDENTS, rf"""c AS (SELECT n_nationkey AS candidate_id, 'entity' AS wanted, n_name AS title, ' asia europe' AS more FROM nation UNION ALL SELECT 1000 + p_partkey, 'concept', p_name, '' FROM part),
    k AS (SELECT *, regexp_replace(lower(title), '[{SPACE}·・,，.。:：;；''"“”‘’()（）\[\]【】/_-]', '', 'g') AS identity, list_distinct(list_filter(regexp_split_to_array(lower(title || more), '[\s,，.。:：;；/|()（）\[\]【】_-]+'), lambda x: length(x) >= 2)) AS terms FROM c),
    p AS (SELECT path, type, lower(title || ' ' || array_to_string(aliases, ' ') || ' ' || string_split(path, '/')[-1]) AS t, lower(array_to_string(tags, ' ')) AS g, lower(tldr) AS s FROM wiki WHERE type IN ('entity', 'concept', 'synthesis')),
    m AS (SELECT candidate_id, path, wanted = type AS same, EXISTS (SELECT 1 FROM idents i WHERE i.path = p.path AND i.identity = k.identity) AS exact,
        coalesce(list_sum(list_transform(terms, lambda x: CASE WHEN contains(t, x) THEN 12 ELSE 0 END + CASE WHEN contains(g, x) THEN 6 ELSE 0 END + CASE WHEN contains(s, x) THEN 4 ELSE 0 END)), 0) AS points FROM k, p),
    z AS (SELECT *, CAST(points + CASE WHEN exact THEN 100 ELSE 0 END + CASE WHEN same THEN 5 ELSE 0 END AS BIGINT) AS score FROM m)""",
    then="SELECT candidate_id, CAST(row_number() OVER (PARTITION BY candidate_id ORDER BY exact DESC, score DESC, same DESC, path) AS INTEGER) AS rank, path, score, exact FROM z WHERE exact OR score > CASE WHEN same THEN 5 ELSE 0 END QUALIFY rank <= 3"))
def candidate_matches(spark, d):
    wanted = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("candidate_id"), F.lit("entity").alias("type"), F.col("n_name").alias("title"), F.array(F.lit("asia"), F.lit("europe")).alias("queries"))
    parts = table(spark, d, "part").select((F.col("p_partkey") + 1000).alias("candidate_id"), F.lit("concept").alias("type"), F.col("p_name").alias("title"), F.array().cast("array<string>").alias("queries"))
    return search.candidate_matches(wanted.unionByName(parts), wiki_pages(spark, d))


def _proposals(spark, d):
    """Resolved proposals: orders are candidates (every eleventh without a decision, every
    thirteenth only a source) and propose the parts of their lines; lines of a multiple of
    ninety name two targets."""
    r = F.array(*map(F.lit, [*graph.RELATIONS, "mentions"]))
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    confidence = F.round(1 - F.col("l_discount") - 4 * F.col("l_tax"), 4)
    made = table(spark, d, "lineitem").select(
        (order * 10 + line).alias("ord"), F.concat(F.lit("o"), order).alias("from_candidate"), F.when(F.col("l_partkey") % 90 == 0, F.concat(F.lit("o"), order)).alias("to_candidate"),
        F.concat(F.lit("[[wiki/concepts/part-"), "l_partkey", F.lit(".md]]")).alias("to_path"), F.element_at(r, line).alias("relation"), confidence.alias("confidence"),
    )
    return graph.resolve_proposals(made, _candidates(spark, d), wiki_pages(spark, d))


def _candidates(spark, d):
    k = F.col("o_orderkey")
    decision = F.when(k % 13 == 0, "source_only").when(k % 11 == 0, "rejected").when(k % 2 == 0, "created").otherwise("updated")
    return table(spark, d, "orders").select(F.concat(F.lit("o"), k).alias("candidate_id"), decision.alias("decision"), F.concat(F.lit("wiki/outputs/order-"), k, F.lit(".md")).alias("target_path"))


JUDGED = """p AS (SELECT l_orderkey * 10 + l_linenumber AS ord, 'wiki/outputs/order-' || l_orderkey AS from_path, 'wiki/concepts/part-' || l_partkey AS to_path, l_linenumber AS priority, l_partkey % 90 = 0 AS two, l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0 AS from_ok, round(1 - l_discount - 4 * l_tax, 4) AS confidence FROM lineitem),
    a AS (SELECT *, CASE WHEN NOT from_ok THEN 'invalid_from' WHEN two THEN 'invalid_target_shape' WHEN priority > 6 THEN 'invalid_relation' WHEN confidence < 0.7 OR confidence > 1 THEN 'low_confidence' WHEN to_path NOT IN (SELECT path FROM wiki) THEN 'unknown_target' END AS r1 FROM p),
    b AS (SELECT *, row_number() OVER (PARTITION BY r1, from_path, to_path ORDER BY confidence DESC, priority, ord) = 1 AS best, EXISTS (SELECT 1 FROM a x WHERE x.r1 IS NULL AND x.from_path = a.from_path AND x.to_path = a.to_path AND x.ord < a.ord AND (x.confidence > a.confidence OR (x.confidence = a.confidence AND x.priority <= a.priority))) AS beaten FROM a),
    c AS (SELECT *, CASE WHEN r1 IS NOT NULL THEN r1 WHEN beaten THEN 'duplicate' WHEN best AND row_number() OVER (PARTITION BY r1, from_path, best ORDER BY confidence DESC, priority, to_path) > 5 THEN 'outgoing_limit' END AS reason FROM b),
    edges AS (SELECT from_path, to_path, priority, confidence, CAST(row_number() OVER (PARTITION BY from_path ORDER BY confidence DESC, priority, to_path) AS INTEGER) AS rank FROM c WHERE r1 IS NULL AND best AND reason IS NULL)"""


@query("link_plan", _with(JUDGED, then="SELECT from_path, to_path, rank FROM edges"))
def link_plan(spark, d):
    return graph.link_plan(graph.judge_proposals(_proposals(spark, d))).select("from_path", "to_path", "rank")


@query("link_drops", _with(JUDGED, then="SELECT reason, count(*) AS n FROM c WHERE reason IS NOT NULL GROUP BY 1"))
def link_drops(spark, d):
    return graph.drop_counts(graph.judge_proposals(_proposals(spark, d)))


@query("relation_counts", _with(JUDGED, then="SELECT ['prerequisite', 'component', 'contrast', 'implementation', 'lifecycle', 'related'][priority] AS relation, count(*) AS n FROM edges GROUP BY 1"))
def relation_counts(spark, d):
    return graph.relation_counts(graph.link_plan(graph.judge_proposals(_proposals(spark, d))))


@query("unlinked_pages", _with(JUDGED, then="SELECT 'wiki/outputs/order-' || o_orderkey AS path FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND 'wiki/outputs/order-' || o_orderkey NOT IN (SELECT from_path FROM edges)"))
def unlinked_pages(spark, d):
    return graph.unlinked_pages(_candidates(spark, d), graph.link_plan(graph.judge_proposals(_proposals(spark, d))))


@query("enrich_pages", _with(JUDGED, then="""SELECT path || '.md' AS path, sha256(regexp_replace(regexp_replace(f.content, 'related: \\[\\]\\n', ''), '\\n---\\n\\n', chr(10) || 'related:' || coalesce(yaml, ' []') || chr(10) || '---' || chr(10) || chr(10)) || coalesce(block, chr(10))) AS hash
    FROM (SELECT regexp_replace(path, '\\.md$', '') AS path, regexp_replace(content, '\\s+$', '') AS content FROM files) f LEFT JOIN (SELECT from_path AS path, string_agg(chr(10) || '  - ' || to_path, '' ORDER BY rank) AS yaml,
    chr(10) || chr(10) || '<!-- llm-wiki:related:start -->' || chr(10) || '## 关联条目' || chr(10) || chr(10) || string_agg('- [[' || to_path || ']]', chr(10) ORDER BY rank) || chr(10) || '<!-- llm-wiki:related:end -->' || chr(10) AS block FROM edges GROUP BY 1) e USING (path) WHERE path LIKE 'wiki/outputs/%'"""))
def enrich_pages(spark, d):
    parsed = pages.parse_pages(wiki_files(spark, d)).where("type = 'output'")
    found = pages.enrich_pages(parsed, graph.link_plan(graph.judge_proposals(_proposals(spark, d))))
    return found.select("path", F.sha2("content", 256).alias("hash"))


@query("strip_dangling", _with(LINKS, "valid AS (SELECT path FROM wiki WHERE path NOT LIKE '%7')", "bad AS (SELECT DISTINCT from_path, to_path FROM links WHERE to_path NOT IN (SELECT path FROM valid))", then="SELECT from_path || '.md' AS path, string_agg(to_path, ';' ORDER BY to_path) AS removed FROM bad GROUP BY 1"))
def strip_dangling(spark, d):
    """Pages whose key ends in 7 are taken for gone; what is left must have no link to them."""
    valid = wiki_pages(spark, d).where("path NOT LIKE '%7'").select(F.col("path").alias("key"))
    found = pages.strip_dangling(pages.parse_pages(wiki_files(spark, d)), valid)
    return found.where(F.size("removed") > 0).select("path", F.array_join("removed", ";").alias("removed"))


def _neighbour_sql(direction: str) -> str:
    way = {"outgoing": "SELECT a, b FROM along", "both": "SELECT a, b FROM along UNION SELECT b, a FROM along"}[direction]
    return f"""along AS (SELECT DISTINCT from_path AS a, to_path AS b FROM resolved WHERE from_path <> to_path), e AS ({way}), one AS (SELECT a AS start, b AS path, 1 AS hop FROM e QUALIFY row_number() OVER (PARTITION BY a ORDER BY b) <= 20),
    two AS (SELECT DISTINCT o.start, e.b AS path, 2 AS hop FROM one o JOIN e ON o.path = e.a WHERE e.b <> o.start AND NOT EXISTS (SELECT 1 FROM one x WHERE x.start = o.start AND x.path = e.b)),
    near AS (SELECT start, path, CAST(hop AS INTEGER) AS hop FROM (SELECT * FROM one UNION ALL SELECT * FROM two) QUALIFY row_number() OVER (PARTITION BY start ORDER BY hop, path) <= 20)"""


@query("two_hop_neighbors", _with(LINKS, RESOLVED, _neighbour_sql("outgoing"), then="SELECT * FROM near"))
def two_hop_neighbors(spark, d):
    wiki = wiki_pages(spark, d)
    links = index.resolved_links(index.page_links(wiki), wiki)
    return graph.neighbours(wiki.select("path"), links)


@query("backlink_neighbors", _with(LINKS, RESOLVED, """e AS (SELECT DISTINCT to_path AS a, from_path AS b FROM resolved WHERE from_path <> to_path), one AS (SELECT a AS start, b AS path FROM e QUALIFY row_number() OVER (PARTITION BY a ORDER BY b) <= 20)""", then="SELECT start, path, 1 AS hop FROM one"))
def backlink_neighbors(spark, d):
    wiki = wiki_pages(spark, d)
    return graph.neighbours(wiki.select("path"), index.resolved_links(index.page_links(wiki), wiki), "backlinks", depth=1)


def _routes_sql(direction: str) -> str:
    steps = {"outgoing": "SELECT a, b, 'outgoing' AS way FROM along", "both": "SELECT a, b, 'outgoing' AS way FROM along UNION ALL SELECT b, a, 'backlink' FROM along"}[direction]
    return f"""steps AS ({steps}), r1 AS (SELECT n.start, n.path, s.way || ': ' || n.start || ' > ' || n.path AS route FROM near n JOIN steps s ON s.a = n.start AND s.b = n.path),
    r2 AS (SELECT n.start, n.path, g.way || ': ' || n.start || ' > ' || f.b || ' > ' || n.path AS route FROM near n JOIN e f ON f.a = n.start JOIN steps g ON g.a = f.b AND g.b = n.path WHERE f.b <> n.path)"""


@query("neighbor_routes", _with(LINKS, RESOLVED, _neighbour_sql("outgoing"), _routes_sql("outgoing"), then="SELECT start, path, hop, string_agg(route, '; ' ORDER BY route) AS routes FROM near JOIN (SELECT * FROM r1 UNION SELECT * FROM r2) USING (start, path) GROUP BY 1, 2, 3"))
def neighbor_routes(spark, d):
    wiki = wiki_pages(spark, d)
    links = index.resolved_links(index.page_links(wiki), wiki)
    return graph.routes(wiki.select("path"), links, "outgoing").select("start", "path", "hop", F.array_join("routes", "; ").alias("routes"))


@query("neighbor_routes_both", _with(LINKS, RESOLVED, _neighbour_sql("both"), _routes_sql("both"), then="SELECT start, path, hop, count(*) AS n_routes, sha256(string_agg(route, '; ' ORDER BY route)) AS routes FROM near JOIN (SELECT * FROM r1 UNION SELECT * FROM r2) USING (start, path) GROUP BY 1, 2, 3"))
def neighbor_routes_both(spark, d):
    wiki = wiki_pages(spark, d)
    links = index.resolved_links(index.page_links(wiki), wiki)
    found = graph.routes(wiki.select("path"), links, "both")
    return found.select("start", "path", "hop", F.size("routes").cast("long").alias("n_routes"), F.sha2(F.array_join("routes", "; "), 256).alias("routes"))


@query("link_targets", _with(LINKS, then="SELECT from_path, ordinal, to_path, to_path IN (SELECT path FROM wiki) AS exists FROM links"))
def link_targets(spark, d):
    wiki = wiki_pages(spark, d)
    return graph.link_targets(index.page_links(wiki), wiki)


def _ops(spark, d):
    """An operation on every customer's page: updates (some against a stale hash, some without
    an expected one, some naming no page), creations, and content with flaws of all kinds."""
    now = stored(changes.with_hash(wiki_files(spark, d)))
    k = F.col("c_custkey")
    path = F.concat(F.lit("wiki/entities/customer-"), k)
    body = F.concat(F.lit("Revised "), "c_name", F.when(k % 6 == 0, " [[wiki/concepts/nowhere]]").otherwise(" [[wiki/entities/customer-1]]"))
    page = pages.page_template(F.lit("entity"), F.col("c_name"), F.when(k % 10 == 0, "").otherwise("Revised"), body, "2024-05-01")
    ops = table(spark, d, "customer").select(
        k.alias("ord"), F.when(k % 4 == 0, "create").when(k % 101 == 0, "drop").otherwise("update").alias("action"),
        F.concat(F.when(k % 8 == 0, F.concat(path, F.lit("-new"))).when(k % 97 == 0, "wiki/entities/customer-2").otherwise(path), F.when(k % 103 == 0, ".txt").otherwise(".md")).alias("path"),
        F.when(k % 15 == 0, " ").when(k % 14 == 0, "no page").otherwise(page).alias("content"), (k % 5 == 0).alias("stale"), (k % 7 == 0).alias("blind"),
    )
    ops = ops.join(now.select("path", "hash"), "path", "left")
    return now, stored(ops.select("ord", "action", "path", F.when(F.col("stale"), "stale").when(~F.col("blind"), F.col("hash")).alias("expected_hash"), "content"))


PLAN = """o AS (SELECT c_custkey AS ord, CASE WHEN c_custkey % 4 = 0 THEN 'create' WHEN c_custkey % 101 = 0 THEN 'drop' ELSE 'update' END AS action,
        CASE WHEN c_custkey % 8 = 0 THEN 'wiki/entities/customer-' || c_custkey || '-new' WHEN c_custkey % 97 = 0 THEN 'wiki/entities/customer-2' ELSE 'wiki/entities/customer-' || c_custkey END || CASE WHEN c_custkey % 103 = 0 THEN '.txt' ELSE '.md' END AS path,
        c_custkey % 5 = 0 AS stale, CASE WHEN c_custkey % 15 = 0 THEN 'blank' WHEN c_custkey % 14 = 0 THEN 'none' ELSE 'page' END AS kind, c_name FROM customer),
    j AS (SELECT o.*, f.path IS NOT NULL AS there FROM o LEFT JOIN files f ON o.path = f.path),
    checks AS (SELECT ord, path, 'invalid_action' AS code FROM j WHERE action = 'drop' UNION ALL SELECT ord, path, 'not_markdown' FROM j WHERE path LIKE '%.txt' UNION ALL SELECT ord, path, 'blank_content' FROM j WHERE kind = 'blank'
        UNION ALL SELECT ord, path, 'already_exists' FROM j WHERE action = 'create' AND there UNION ALL SELECT ord, path, 'missing_page' FROM j WHERE action = 'update' AND NOT there UNION ALL SELECT ord, path, 'stale_hash' FROM j WHERE action = 'update' AND there AND stale
        UNION ALL SELECT ord, path, 'repeated_path' FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ord) AS n FROM j) WHERE n > 1 UNION ALL SELECT ord, path, 'invalid_page' FROM j WHERE kind = 'none'
        UNION ALL SELECT ord, path, 'missing_field' FROM j WHERE kind = 'page' AND ord % 10 = 0 UNION ALL SELECT ord, path, 'dangling_link' FROM j WHERE kind = 'page' AND ord % 6 = 0),
    good AS (SELECT * FROM j WHERE ord NOT IN (SELECT ord FROM checks))"""


@query("plan_checks", _with(PLAN, then="SELECT * FROM checks"))
def plan_checks(spark, d):
    now, ops = _ops(spark, d)
    return changes.plan_checks(ops, now)


def _applied(spark, d):
    now, ops = _ops(spark, d)
    good = stored(ops.join(changes.plan_checks(ops, now).select("ord").distinct(), "ord", "left_anti"))
    return now, good, *changes.apply_plan(good, now)


@query("apply_plan", _with(PLAN, then="SELECT coalesce(f.path, g.path) AS path, CASE WHEN g.path IS NULL THEN sha256(content) ELSE 'Revised ' || c_name END AS version FROM files f FULL JOIN good g ON f.path = g.path"))
def apply_plan(spark, d):
    _, _, after, _ = _applied(spark, d)
    said = F.regexp_extract("content", r"\n(Revised \S+) ", 1)
    return after.select("path", F.when(F.col("content").contains("updated: 2024-05-01") | F.col("content").contains('updated: "2024-05-01"'), said).otherwise(F.col("hash")).alias("version"))


@query("rollback_conflicts", _with(PLAN, then="SELECT path, CASE WHEN ord % 7 = 0 THEN 'missing' ELSE 'changed' END AS code FROM good WHERE ord % 7 = 0 OR ord % 11 = 0"))
def rollback_conflicts(spark, d):
    _, good, after, receipt = _applied(spark, d)
    later = after.join(good.select("path", "ord"), "path", "left").where("ord IS NULL OR ord % 7 <> 0")
    later = later.withColumn("content", F.when(F.col("ord") % 11 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return changes.rollback_conflicts(receipt, changes.with_hash(later))


@query("intake_dedup", "SELECT doc_id AS source_id, sha256(text) AS hash, min(doc_id) OVER (PARTITION BY text) AS original_id, min(doc_id) OVER (PARTITION BY text) <> doc_id AS duplicate FROM documents")
def intake_dedup(spark, d):
    docs = table(spark, d, "documents")
    return intake.intake(docs, spark.createDataFrame([], "hash string, source_id long"))


BARE = r"regexp_replace(regexp_replace(url, '^(?i)(https?://)[^/?#]*@', '\1'), '^([A-Za-z]+://[^/?#]+)([?#]|$)', '\1/\2')"
SECRET = "list_transform(string_split(regexp_extract(b, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: CASE WHEN regexp_matches(url_decode(regexp_extract(p, '^[^=]*')), '(?i)(token|key|signature|authorization|auth|credential|secret)') THEN regexp_extract(p, '^[^=]*') || '=%5BREDACTED%5D' ELSE p END)"
#: Addresses of pages with a query and, for every fifth, credentials; the names vary by page.
NAMES = ["page", "X-Amz-Credential", "authorization", "lang", "%74oken", "monkey", "sig"]
#: Every seventh address is one of a video host, or nearly.
HOSTS = ["www.bilibili.com", "v.douyin.com", "notdouyin.com", "bilibili.com.example.org"]


@query("url_hygiene", rf"""WITH u AS (SELECT page_id, (CASE WHEN page_id % 5 = 0 THEN regexp_replace(h, '://', '://me:p@w@') ELSE h END) || '?a=1&' || {NAMES}[page_id % 7 + 1] || '=v%20x' AS url
        FROM (SELECT page_id, CASE WHEN page_id % 7 = 6 THEN regexp_replace(url, '://[^/?#]+', '://' || {HOSTS}[page_id // 7 % 4 + 1]) ELSE url END AS h FROM pages)),
    c AS (SELECT *, {BARE} AS b, regexp_matches(url, '^(?i)https?://[^/?#@\s]+([/?#]|$)') AS ok FROM u)
    SELECT page_id, CASE WHEN regexp_matches(url, '^(?i)https?://[^/?#]+') THEN CASE WHEN regexp_extract(b, '^[^?#]*\?([^#]*)', 1) = '' THEN b ELSE regexp_extract(b, '^[^?#]*\?') || array_to_string({SECRET}, '&') || regexp_extract(b, '#.*$') END END AS url, ok AS acceptable,
    CASE WHEN NOT ok THEN 'rejected' WHEN page_id % 7 = 6 AND page_id // 7 % 4 < 2 THEN 'video' ELSE 'web' END AS route FROM c""")
def url_hygiene(spark, d):
    k = F.col("page_id")
    host = F.element_at(F.array(*map(F.lit, HOSTS)), (F.floor(k / 7) % 4 + 1).cast("int"))
    url = F.when(k % 7 == 6, F.regexp_replace(F.col("url"), F.lit("://[^/?#]+"), F.concat(F.lit("://"), host))).otherwise(F.col("url"))
    url = F.when(k % 5 == 0, F.regexp_replace(url, "://", "://me:p@w@")).otherwise(url)
    name = F.element_at(F.array(*map(F.lit, NAMES)), (k % 7 + 1).cast("int"))
    return intake.url_hygiene(table(spark, d, "pages").withColumn("url", F.concat(url, F.lit("?a=1&"), name, F.lit("=v%20x"))))


@query("conversation_tail", "SELECT conv_id, turn, role, CASE WHEN length(text) > 4000 THEN substring(text, 1, 3999) || '…' ELSE text END AS text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS from_end FROM conversations QUALIFY from_end <= 8")
def conversation_tail(spark, d):
    return timeline.conversation_tail(table(spark, d, "conversations"))


@query("context_usage", f"SELECT role, count(*) AS turns, CAST(sum({TOKENS.format('text')}) AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def context_usage(spark, d):
    return timeline.context_usage(table(spark, d, "conversations"))


@query("gap_sessions", """WITH s AS (SELECT conv_id AS media_id, turn, turn * 4000 + (turn + 1) // 3 * 4000 AS a, turn * 4000 + (turn + 1) // 3 * 4000 + 1500 AS b FROM conversations), m AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY media_id ORDER BY a, turn) > 3000 THEN 1 ELSE 0 END AS n FROM s),
    g AS (SELECT *, sum(n) OVER (PARTITION BY media_id ORDER BY a, turn) AS session FROM m) SELECT media_id, CAST(session AS BIGINT) AS session, min(a) AS first_ms, max(b) AS last_ms, count(*) AS n_segments FROM g GROUP BY 1, 2""")
def gap_sessions(spark, d):
    return timeline.gap_sessions(segments_of(table(spark, d, "conversations")))


@query("paragraphs")
def paragraphs(spark, d):
    return timeline.paragraphs(segments_of(table(spark, d, "conversations")))


@query("chunk_plan", "SELECT o_orderkey AS media_id, i AS index, greatest(0, CAST(i AS BIGINT) * 900000 - CASE WHEN i > 0 THEN 2000 ELSE 0 END) AS start_ms, least(ms, (CAST(i AS BIGINT) + 1) * 900000) AS end_ms FROM (SELECT o_orderkey, ms, CAST(unnest(generate_series(0, greatest(1, CAST(ceil(ms / 900000.0) AS INT)) - 1)) AS INTEGER) AS i FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 50) AS BIGINT) AS ms FROM orders))")
def chunk_plan(spark, d):
    return timeline.chunk_plan(table(spark, d, "orders").select(F.col("o_orderkey").alias("media_id"), F.floor(F.col("o_totalprice") * 50).alias("duration_ms")))


@query("progress_percent", """WITH r AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 10 WHEN 'purchase' THEN 80 WHEN 'signup' THEN 95 ELSE 0 END AS a, CASE event_type WHEN 'click' THEN 10 WHEN 'view' THEN 70 WHEN 'purchase' THEN 15 WHEN 'signup' THEN 5 ELSE 0 END AS w,
    TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) SELECT user_id AS source_id, event_id AS seq, CAST(max(least(100.0, floor(a + w * CASE WHEN k >= 0 THEN least(1.0, k / 100.0) ELSE 0.0 END + 0.5))) OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS percent FROM r""")
def progress_percent(spark, d):
    return timeline.progress_percent(progress_events(table(spark, d, "events")), EVENT_PHASES)


@query("latest_events", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_events(spark, d):
    return timeline.latest_events(table(spark, d, "events"))
