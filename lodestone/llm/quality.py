"""Quality rules with host-level verdicts.

Each document gets its base counts and a base verdict. Failures are then counted by
host (`source`). A host is judged against a beta prior that is fitted by moments to all
other hosts: its own rate is shrunk towards their mean, and it fails where the shrunken
rate lies some deviations of the prior above that mean. Verdicts are joined back: a
document that passes on its own is still dropped where its host fails.

Null texts have no words and fail. A null source is a host of its own. A host without
others to compare it with passes. Rows that repeat a doc_id are judged one by one. With no
rows at all the result is empty. Columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrowtools import map_texts, stored

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
_SPACE = b" \t\n\v\f\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of `width` words that the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i : i + n] for i in range(width)), strict=True))
    if len(set(windows)) == n:
        return 0
    seen: dict = {}
    repeated = bytearray(n)
    for i, w in enumerate(windows):
        if (first := seen.setdefault(w, i)) != i:
            repeated[first] = repeated[i] = 1
    covered, reach = 0, 0
    for i, hit in enumerate(repeated):
        if hit:
            covered += i + width - max(reach, i)
            reach = i + width
    return covered


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


def base_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns with the five base counts, in one pass over the texts."""

    def make():
        def run(texts, *kept):
            rows = []
            for text in texts:
                data = (text or "").encode()
                words = data.split()
                spaces = len(data) - len(data.translate(None, _SPACE))
                symbols = len(data) - len(data.translate(None, SYMBOLS))
                rows.append((len(words), len(text or "") - spaces, symbols, duplicate_lines(data), repeat_words(words)))
            counts = list(zip(*rows, strict=True)) or [()] * len(COUNTS)
            return {c: pa.array(v, t) for c, v, t in zip(keep, kept, types, strict=True)} | {c: pa.array(v, pa.int64()) for c, v in zip(COUNTS, counts, strict=True)}

        return run

    types = [pa.int64() if c == "doc_id" else pa.string() for c in keep]
    kinds = ", ".join([f"{c} {'long' if c == 'doc_id' else 'string'}" for c in keep] + [f"{c} long" for c in COUNTS])
    return map_texts(docs, ["text", *keep], kinds, make)


def host_rates(judged: DataFrame, deviations: float, least_host_rate: float, most_strength: float) -> DataFrame:
    """source, n, failed, host_rate (shrunken), host_bar and host_failed.

    For each host, over all others: m is their pooled rate (with half a failure in one
    document added), the strength k follows from the variance of their rates about m in
    excess of binomial noise, between 1 and `most_strength` documents, and the prior's
    deviation is sqrt(m (1 - m) / (k + 1)). The sums of all hosts are one row, joined back;
    a host's own share is taken off.
    """
    hosts = judged.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    hosts = hosts.withColumn("rate", F.col("failed") / F.col("n"))
    every = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("all_n"), F.sum("failed").alias("all_failed"), F.sum("rate").alias("rates"),
        F.sum(F.col("rate") * F.col("rate")).alias("squares"), F.sum(1 / F.col("n")).alias("inverse"),
    )
    others, rate = F.col("hosts") - 1, F.col("rate")
    m = (F.col("all_failed") - F.col("failed") + 0.5) / (F.col("all_n") - F.col("n") + 1)
    rows = hosts.crossJoin(F.broadcast(every)).withColumn("m", m).withColumn("spread", F.col("m") * (1 - F.col("m")))
    apart = (F.col("squares") - rate * rate - 2 * F.col("m") * (F.col("rates") - rate)) / others + F.col("m") * F.col("m")
    excess = apart - F.col("spread") * (F.col("inverse") - 1 / F.col("n")) / others
    rows = rows.withColumn("excess", F.when(others > 0, excess))
    strength = F.when(F.col("excess") > 0, F.greatest(F.lit(1.0), F.least(F.lit(float(most_strength)), F.col("spread") / F.col("excess") - 1))).otherwise(float(most_strength))
    rows = rows.withColumn("k", strength)
    host_rate = F.round((F.col("failed") + F.col("m") * F.col("k")) / (F.col("n") + F.col("k")), 6)
    bar = F.round(F.greatest(F.lit(least_host_rate), F.col("m") + deviations * F.sqrt(F.col("spread") / (F.col("k") + 1))), 6)
    rows = rows.withColumn("host_rate", host_rate).withColumn("host_bar", bar)
    return rows.select("source", "n", "failed", "host_rate", "host_bar", ((others > 0) & (F.col("host_rate") > F.col("host_bar"))).alias("host_failed"))


def quality_rules(docs: DataFrame, min_words: int = 10, max_repeat_percent: int = 20, deviations: float = 3.0, least_host_rate: float = 0.05, most_strength: float = 200.0) -> DataFrame:
    """doc_id, base counts, base_failed, kept, host_rate and host_bar for every document.

    A host whose shrunken rate is `least_host_rate` or less never fails. The counts are
    thin rows; checkpoint() writes them to the shared folder once, so the texts are read
    once although host rates need a pass before the join.
    """
    judged = base_counts(docs, ["doc_id", "source"]).withColumn(
        "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    )
    judged = stored(judged)
    hosts = host_rates(judged, deviations, least_host_rate, most_strength).withColumnRenamed("source", "host").drop("n", "failed")
    joined = judged.join(hosts, judged.source.eqNullSafe(hosts.host), "left")
    return joined.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), "host_rate", "host_bar")
