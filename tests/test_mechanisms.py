"""Nested rows, captions, expiring jobs, inboxes, charsets, unique ids, artifacts, and mended rules."""

import datetime as dt
import json
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.functions import decoding, json_text, names, text
from lodestone.operators import artifacts, candidates, changes, graph, layout, pages, ranking, schema_check, structure
from lodestone.plans import checks
from lodestone.sources import captions, inbox, manifests, published
from lodestone.streaming import checkpoints, streams

T0 = dt.datetime(2024, 1, 1)


def each(spark, column, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_schema_check(spark):
    line = {"type": "object", "required": ["q"], "properties": {"q": {"type": "number", "maximum": 5}, "m": {"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^[A-Z]+$"}, "b": {"type": "boolean"}}}
    schema = {"type": "object", "required": ["id", "lines"], "additionalProperties": False, "properties": {
        "id": {"type": "integer", "minimum": 1}, "kind": {"const": "x"}, "e": {"enum": ["a", 1, None]}, "lines": {"type": "array", "minItems": 1, "maxItems": 2, "items": line}}}
    rows = [
        (1, json.dumps({"id": 1, "lines": [{"q": 1.5, "m": "AB", "b": True}]}), []),
        (2, '{"id":0,"x":1,"kind":"y","e":2}', [(".e", "enum"), (".id", "below_minimum"), (".kind", "const"), (".lines", "missing"), (".x", "unexpected")]),
        (3, "nope", [("", "invalid_json")]), (4, None, [("", "invalid_json")]), (5, "[]", [("", "not_object")]), (5, "[]", [("", "not_object")]),
        (6, json.dumps({"id": 1.0, "kind": "x", "e": None, "lines": [{"q": 6}, {"m": "a", "b": 1}, {"q": 1, "m": "ABCD"}]}),
         [(".lines", "too_many"), (".lines[0].q", "above_maximum"), (".lines[1].b", "not_boolean"), (".lines[1].m", "pattern"), (".lines[1].m", "too_short"), (".lines[1].q", "missing"), (".lines[2].m", "too_long")]),
        (7, '{"id":"1","e":{},"lines":[1]}', [(".e", "enum"), (".id", "not_integer"), (".lines[0]", "not_object")]),
        (8, '{"id":1,"lines":[]}', [(".lines", "too_few")]), (9, '{"id":1,"lines":{}}', [(".lines", "not_array")]),
        (10, '{"id":1,"e":1.0,"lines":[{"q":null,"m":"\U00010000"}]}', [(".lines[0].m", "pattern"), (".lines[0].q", "not_number")]),
    ]
    found = schema_check.violations(spark.createDataFrame([r[:2] for r in rows], "id int, json string"), schema)
    assert sorted(map(tuple, found.collect())) == sorted((i, "input" + p, c) for i, _, flaws in rows for p, c in flaws)
    assert schema_check.violations(spark.createDataFrame([], "id int, json string"), schema).count() == 0


def test_caption_source(spark, tmp_path):
    good = {"schemaVersion": 1, "bvid": "BV1a", "page": "2.7", "trackKind": "zz", "segments": [{"text": " hi ", "startMs": 0, "endMs": 900}, {"text": " "}, 3, {"text": 5, "startMs": "x", "endMs": True, "speaker": "A"}, {"text": "late", "startMs": 9000, "endMs": 9500}]}
    for n, t in (("a", json.dumps(good)), ("b", "nope"), ("c", json.dumps(good | {"bvid": "x"})), ("d", json.dumps(good | {"segments": []}))):
        (tmp_path / f"{n}.bili-caption").write_text(t)
    (tmp_path / "e.bili-caption").write_bytes(b"\xff\xfe{")
    (tmp_path / "other.json").write_text("{}")
    captions.register(spark)
    found = spark.read.format("caption_packages").option("path", str(tmp_path)).option("filesPerPartition", 2).load()
    rows = {os.path.basename(r.path)[0]: r for r in found.collect()}
    assert {k: r.error for k, r in rows.items()} == {"a": None, "b": "INVALID_JSON", "c": "INVALID_PACKAGE", "d": None, "e": "UNREADABLE"}
    assert (rows["a"].page, rows["a"].track_kind, rows["a"].cid, rows["a"].part_title) == (2, "unknown", "", captions.TITLE)
    parts = captions.segments(found)
    assert [tuple(r)[1:] for r in parts.orderBy("n").collect()] == [(1, 0.0, 900.0, "hi", None), (2, None, None, "5", "A"), (3, 9000.0, 9500.0, "late", None)]
    assert sorted(r.code for r in captions.issues(found).collect()) == ["INVALID_JSON", "INVALID_PACKAGE", "NO_SEGMENTS", "UNREADABLE"]
    rows = [("p", 1, 0.0, 900.0, "a"), ("p", 2, 1000.0, 1500.0, "b"), ("p", 3, 4000.0, 4100.0, "c"), ("q", 1, None, None, "x" * 401), ("q", 2, None, None, "y")]
    spark.createDataFrame(rows, "path string, n int, start_ms double, end_ms double, text string").createOrReplaceTempView("segments_of_test")
    told = spark.sql("SELECT * FROM caption_paragraphs(TABLE(segments_of_test) PARTITION BY path ORDER BY n)").collect()
    assert sorted(map(tuple, told), key=str) == sorted([("p", 1, 0.0, 1500.0, "a b"), ("p", 2, 4000.0, 4100.0, "c"), ("q", 1, None, None, "x" * 401), ("q", 2, None, None, "y")], key=str)


def loop(batches, hours=24, late=dt.timedelta(minutes=10)):
    """The stream's rule as a plain loop over batches."""
    held, out, newest = {}, [], None
    for batch in batches:
        by_job = defaultdict(list)
        for job, ts, source, chunk in batch:
            by_job[job].append((ts, chunk, source))
        for job, rows in by_job.items():
            for ts, chunk, source in sorted(rows, key=lambda r: r[:2]):
                have = held.get(job)
                if have and (have[0] != source or ts >= have[1]):
                    out.append((job, "replaced" if have[0] != source else "expired", have[0], len(have[2]), have[1]))
                    have = None
                have = have or [source, dt.datetime.min, set()]
                have[1] = max(have[1], ts + dt.timedelta(hours=hours))
                have[2].add(chunk)
                held[job] = have
            out.append((job, "saved", held[job][0], len(held[job][2]), held[job][1]))
        if batch:
            newest = max([*([newest] if newest else []), *(r[1] for r in batch)])
        for job in [j for j, h in held.items() if h[1] <= newest - late]:
            source, expires, done = held.pop(job)
            out.append((job, "expired", source, len(done), expires))
    return out


def test_expiring_checkpoints(spark, tmp_path):
    hour = lambda h: T0 + dt.timedelta(hours=h)
    batches = [[("a", hour(0), "x", 0), ("b", hour(0), "x", 0), ("a", hour(1), "x", 1), ("a", hour(1), "x", 1)], [("a", hour(20), "x", 2), ("c", hour(26), "y", 1)], [("c", hour(30), "z", 1), ("d", hour(60), "z", 1)], [("e", hour(200), None, 1)], [("e", hour(230), None, 2)]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", checkpoints.STORE)
    try:
        schema = "job_id string, ts timestamp, source_hash string, chunk int"
        query = None
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            if query is None:
                stream = checkpoints.expiring(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
                query = stream.writeStream.format("memory").queryName("expiring_out").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
            query.processAllAvailable()
        query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(map(tuple, spark.sql("SELECT * FROM expiring_out").collect()), key=str) == sorted(loop(batches), key=str)
    lives = checkpoints.replayed(spark.createDataFrame([r for b in batches for r in b], schema)).orderBy("job_id", "life").collect()
    assert [(r.job_id, r.life, r.chunks, r.ending) for r in lives] == [("a", 1, 3, "expired"), ("b", 1, 1, "expired"), ("c", 1, 1, "replaced"), ("c", 2, 1, "expired"), ("d", 1, 1, "expired"), ("e", 1, 1, "expired"), ("e", 2, 1, "expired")]


def test_inbox(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, content in (("a.md", b"one"), ("b.MD", b"one"), ("c.md", b"two"), ("d.md", b"\xff"), ("e.txt", b"no"), ("f.md", b"\xff\xfeo\x00"), ("g.md", b"x" * 50)):
        (folder / name).write_bytes(content)
    known = spark.createDataFrame([("s9", "3fc4ccfe745870e2c0d99f71f30ff0656c8dedd41cc1d7d3d376b0dbe685e2f3"), ("s8", "3fc4ccfe745870e2c0d99f71f30ff0656c8dedd41cc1d7d3d376b0dbe685e2f3")], "source_id string, hash string")
    rows = {os.path.basename(r.path): r for r in inbox.judged(inbox.read_inbox(spark, str(folder)), known, max_bytes=40).collect()}
    assert {k: (r.status, r.reason) for k, r in rows.items()} == {"a.md": ("imported", None), "b.MD": ("duplicate", None), "c.md": ("duplicate", None), "d.md": ("failed", "UNSUPPORTED_ENCODING"), "f.md": ("imported", None), "g.md": ("failed", "SOURCE_TOO_LARGE")}
    assert rows["c.md"].original == "s8" and rows["b.MD"].original.endswith("a.md") and rows["f.md"].text == "o"
    table = str(tmp_path / "table")
    counts, failures = inbox.scan(spark, str(folder), known, table)
    held = spark.read.parquet(table)
    assert counts == {"imported": 3, "duplicates": 2, "failed": 1, "bytes": 54} and counts["imported"] == held.where("status = 'imported'").count()
    assert [r.reason for r in failures.collect()] == ["UNSUPPORTED_ENCODING"]
    counts, _ = inbox.scan(spark, str(folder), inbox.known_sources(spark, table).unionByName(known), table)
    assert counts["imported"] == 0 and counts["duplicates"] == 5


def test_charsets(spark):
    meta = '<meta http-equiv="Content-Type" content="text/html; charset=shift_jis">'
    rows = [
        ("é".encode(), None, "utf-8", "é"), (b"\xe9", "text/html; charset=ISO-8859-1", "iso-8859-1", "é"), (b"\xef\xbb\xbfa", "text/html; charset=latin1", "utf-8", "a"),
        (b"\xff\xfea\x00", None, "utf-16-le", "a"), (b"\xfe\xff\x00a", None, "utf-16-be", "a"), (b"\xff\xfea\x00\x00\xd8", None, "utf-16-le", None), (b"\xff\xfea", None, "utf-16-le", None),
        ('<META Charset="gb2312">中'.encode("gbk"), "text/html", "gb2312", '<META Charset="gb2312">中'), (meta.encode() + "日".encode("cp932"), None, "shift_jis", meta + "日"),
        (b"<meta charset=utf-16x>", None, "utf-16x", None), (b" " * 8192 + b'<meta charset="gbk">\xd6', None, "utf-8", None), (b"a", "text/html; charset=base64", "base64", None), (b"", None, "utf-8", ""), (None, None, None, None),
    ]
    frame = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, content binary, header string")
    found = frame.select("i", decoding.decode_html(F.col("content"), F.col("header")).alias("d")).orderBy("i").collect()
    assert [(r.d.charset, r.d.text) for r in found] == [r[2:] for r in rows]
    assert [r.d.error for r in found] == [None if r[3] is not None or r[0] is None else "UNSUPPORTED_ENCODING" for r in rows]
    assert each(spark, decoding.decode_text, [b"\xff\xfe\x00\xd8", b"\xff\xfea", b"a"], "binary") == [None, None, "a"]


def one_by_one(rows):
    out, seen, number = {}, defaultdict(set), defaultdict(int)
    for run, ord_, wanted, kind in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        number[run] += 1
        base = (wanted or "").strip(" ") or f"{kind or ''}-{number[run]}"
        name, k = base, 2
        while name in seen[run]:
            name, k = f"{base}-{k}", k + 1
        seen[run].add(name)
        out[(run, ord_)] = name
    return out


def test_unique_ids(spark):
    r = random.Random(4)
    rows = [("r0", i, w, "entity") for i, w in enumerate(["a", "a-2", "a", "a", "a-3", "a-2-2", "a-2", "a-2", None, "  ", "a-1", "a-1", "entity-9"])]
    for run in range(12):
        for i in range(r.choice([1, 30, 120])):
            rows.append((f"r{run + 1}", i, r.choice(["a", "a", "a", "b", "a-2", "a-3", "a-4", "a-2-2", "a-2-3", "b-2", "b-10", "", "concept-3"]), r.choice(["entity", "concept"])))
    found = candidates.unique_ids(spark.createDataFrame(rows, "run_id string, ord int, wanted string, type string"))
    assert {(x.run_id, x.ord): x.id for x in found.collect()} == one_by_one(rows)
    assert candidates.unique_ids(spark.createDataFrame([], "run_id string, ord int, wanted string, type string")).count() == 0


def test_numbered(spark):
    r = random.Random(6)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), i, r.random()) for i in range(500)]
    found = ranking.numbered(spark.createDataFrame(rows, "k string, i int, x double"), ["k"], ["x"], parts=7).collect()
    for key in ("hot", "b", None):
        wanted = {i: n for n, (_, i, _) in enumerate(sorted((x for x in rows if x[0] == key), key=lambda x: x[2]), 1)}
        assert {x.i: x.n for x in found if x.k == key} == wanted


def test_artifacts(spark):
    rows = [("s", "a1", "image/png", b"xx"), ("s", "a2", "image/JPEG", b"y"), ("s", "bad id", "image/png", b"y"), ("s", "d", "image/png", b"1"), ("s", "d", "image/png", b"2"), ("s", "t", "image/tiff", b"1"), ("u", "a1", "image/gif", b"")]
    table = artifacts.asset_table(spark.createDataFrame(rows, "source_id string, asset_id string, mime string, content binary"))
    assert sorted((r.source_id, r.asset_id, r.error or r.path) for r in table.collect()) == [
        ("s", "a1", "raw/assets/s/a1.png"), ("s", "a2", "raw/assets/s/a2.jpg"), ("s", "bad id", "INVALID_ASSET_ID"), ("s", "d", "DUPLICATE_ASSET_ID"), ("s", "d", "DUPLICATE_ASSET_ID"), ("s", "t", "UNSUPPORTED_MIME"), ("u", "a1", "raw/assets/u/a1.gif")]
    assert {r.source_id: (r.bytes, r.error) for r in artifacts.asset_totals(table, 5).collect()} == {"s": (7, "ASSET_LIMIT"), "u": (0, "ASSET_INVALID")}
    texts = spark.createDataFrame([("s", "![](llm-wiki-asset:a2) $1 llm-wiki-asset:a1,llm-wiki-asset:a2"), ("u", "llm-wiki-asset:zz llm-wiki-asset:a1"), ("v", "plain \\"), ("w", None)], "source_id string, markdown string")
    placed, unknown = artifacts.place_assets(texts, table)
    assert {r.source_id: r.markdown for r in placed.collect()} == {"s": "![](../assets/s/a2.jpg) $1 ../assets/s/a1.png,../assets/s/a2.jpg", "u": None, "v": "plain \\", "w": None}
    assert [tuple(r) for r in unknown.collect()] == [("u", "zz")]
    payloads = texts.select("source_id", F.lit("text").alias("source_kind"), F.lit("h").alias("source_hash"), F.lit('a "b".md').alias("name"), F.lit("text/markdown").alias("mime"), F.lit("p").alias("parser_id"), F.lit("1.0").alias("parser_version"), "markdown")
    made, _ = artifacts.build(payloads, table)
    made = made.cache()
    assert {r.source_id for r in made.collect()} == {"s", "v"}
    assert 'original_name: "a \\"b\\".md"' in made.where("source_id = 's'").first().artifact
    # What was built passes verification, and does no more when a byte changes.
    revisions = made.select("source_id", F.lit("h").alias("source_hash"), F.lit("text").alias("source_kind"), F.lit(1).alias("revision"), F.lit(3).alias("schema_version"), F.concat(F.lit("raw/"), "source_id", F.lit(".md")).alias("raw_path"),
                            "artifact_hash", "content_hash", F.lit("p").alias("parser_id"), F.lit("1.0").alias("parser_version"), F.lit(None).cast("int").alias("page_count"), F.lit(None).cast("string").alias("map_path"), F.lit(None).cast("string").alias("map_hash"))
    files = made.select(F.concat(F.lit("raw/"), "source_id", F.lit(".md")).alias("path"), F.when(F.col("source_id") == "v", F.concat("artifact", F.lit("!"))).otherwise(F.col("artifact")).alias("content"))
    none = lambda schema: spark.createDataFrame([], schema)
    judged = artifacts.verify_revisions(revisions, files, none("path string, hash string, source_id string, source_hash string, content_hash string, entries array<struct<block_id string, start_line int, end_line int>>"), none("source_id string, revision int, path string, hash string"), none("path string, hash string"))
    assert {r.source_id: r.code for r in judged.collect()} == {"s": None, "v": "ARTIFACT_HASH"}


def test_addresses_and_urls(spark):
    pairs = {"0:0:0:0:0:0:0:1": False, "0:0:0:0:0:ffff:a00:1": False, ":::": False, "face:": False, "::ffff:1.2.3.4": False, "2606:4700::1111": True, "2001:DB8::1": False, "64:ff9b::8.8.8.8": True, "64:ff9b::8.8.8.256": False, "fe80::1%eth0": False, "1::2::3": False, "10.0.0.1": False, "8.8.8.8": True, "": False, None: False}
    assert each(spark, names.public_address, list(pairs)) == list(pairs.values())
    urls = ["https://x.org/?%74oken=abc&a=b#token=1", "https://u:p@q@h/p", "https://x.org", "https://x.org/a#b?key=1", "ftp://x", "https://x.org/?key&a=%zz"]
    assert each(spark, text.clean_url, urls) == ["https://x.org/?%74oken=%5BREDACTED%5D&a=b#token=1", "https://h/p", "https://x.org/", "https://x.org/a#b?key=1", None, "https://x.org/?key=%5BREDACTED%5D&a=%zz"]


@pytest.mark.parametrize(("block", "wanted"), [
    ('t: [a, "b, c"]', {"t": (True, ["a", "b, c"])}), ("t: T # note", {"t": (False, ["T"])}), ("t: 'a # b' # c", {"t": (False, ["a # b"])}), ('t: "a" b', None), ("t: [a, 'b']] x", None), ("t: [a # b", None), ("t: []", {"t": (True, [])}),
    ("t: [a, b] # c", {"t": (True, ["a", "b"])}), ("t:\n  - a # b\n  - 'c, d'", {"t": (True, ["a", "c, d"])}), ("t: null # x", {"t": None}), ("t: a#b", {"t": (False, ["a#b"])}), ("t: [[x]]", None), ('t: "[[a/b]]"', {"t": (False, ["[[a/b]]"])}),
])
def test_read_block(block, wanted):
    assert pages.read_block(block)[0] == wanted


def test_mended_rules(spark, tmp_path):
    kinds = manifests.upgraded(spark.createDataFrame([(n, None, None, []) for n in ("notes.md", "a.markdown", "a.pdf", "b.txt", "c.docx")], "name string, kind string, acquiredBy string, revisions array<struct<artifactSchemaVersion:int>>"))
    assert [r.kind for r in kinds.collect()] == ["markdown", "markdown", "pdf", "text", "unknown"]
    found = structure.block_rows("one\n<!-- llm-wiki:page=2 source=ocr -->\ntwo\n")
    assert [(r[1], r[-1]) for r in found] == [("paragraph", 1), ("paragraph", 2)]
    now = changes.with_hash(spark.createDataFrame([("wiki/entities/a.md", "x")], "path string, content string"))
    ops = spark.createDataFrame([(1, "update", "wiki/entities/a.md", ""), (2, "update", "wiki/entities/b.md", "z")], "ord int, action string, path string, expected_hash string").withColumn("content", F.lit("no page"))
    assert sorted((r.ord, r.code) for r in changes.plan_checks(ops, now).collect()) == [(1, "invalid_page"), (2, "invalid_page"), (2, "missing_page")]
    cands = spark.createDataFrame([(1, "c1", "created", "wiki/entities/old.md"), (2, "c1", "updated", "wiki/entities/new.md"), (1, "c2", "created", "wiki/concepts/t.md")], "ord int, candidate_id string, decision string, target_path string")
    props = spark.createDataFrame([(1, "c1", "c2", None, "related", 0.9)], "ord int, from_candidate string, to_candidate string, to_path string, relation string, confidence double")
    got = graph.resolve_proposals(props, cands, spark.createDataFrame([], "path string")).collect()
    assert [(r.from_path, r.to_path) for r in got] == [("wiki/entities/new", "wiki/concepts/t")]


def start(query, tmp_path, name):
    return query.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()


def test_streams_with_nulls(spark, tmp_path):
    spark.createDataFrame([("r", 1, "tool_start", None, "t1"), ("r", 2, "tool_end", 3, "t1"), ("r", 3, "text", None, None)], "run_id string, seq long, type string, iteration int, tool_call_id string").coalesce(1).write.parquet(str(tmp_path / "runs"))
    rows = spark.readStream.schema(spark.read.parquet(str(tmp_path / "runs")).schema).parquet(str(tmp_path / "runs"))
    start(streams.run_stream(rows).writeStream.format("memory").queryName("runs_out").outputMode("update"), tmp_path, "c1").awaitTermination()
    assert [(r.iterations, r.n_activities) for r in spark.sql("SELECT * FROM runs_out").collect()] == [(3, 2)]

    docs = tmp_path / "docs"
    table = str(tmp_path / "seen")
    for i, rows in enumerate(([(1, None), (2, None), (3, "a"), (4, "a")], [(5, "a"), (6, None), (7, "b")])):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(docs))
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(docs))
        streams.intake_batches(stream, table, str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.text or "") for r in spark.read.parquet(table).collect()) == ["", "", "", "a", "b"]

    events = tmp_path / "events"
    table = str(tmp_path / "links")
    for rows in ([(1, "wiki/a.md", "[[wiki/b]] [[wiki/c]]"), (2, "wiki/b.md", "[[wiki/a]]")], [(3, "wiki/a.md", "[[wiki/d]]"), (4, "wiki/b.md", None)], [(5, "wiki/e.md", "none")]):
        spark.createDataFrame(rows, "seq long, path string, content string").coalesce(1).write.mode("append").parquet(str(events))
        stream = spark.readStream.schema("seq long, path string, content string").parquet(str(events))
        streams.index_updates(stream, table, str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in streams.current_links(spark, table).collect()] == [("wiki/a", "wiki/d")]
    streams.compacted(spark, table, str(tmp_path / "compact"))
    assert [tuple(r) for r in streams.current_links(spark, str(tmp_path / "compact")).collect()] == [("wiki/a", "wiki/d")]


def test_json_in_text(spark):
    texts = ['x {"a":1} y', '```json\n{"a":2}\n```', 'say {"a":"}{\\"x"} and {b} end', '{"a": {"b": "c\\\\"}} } tail', "none", '{"a":1', '} {"q":1}', None, '```\nnope\n``` {"z":1}', '{"a":1} {"b":2}']
    found = each(spark, json_text.json_object, texts)
    assert [x and (x.json.strip(), x.source) for x in found] == [
        ('{"a":1}', "braces"), ('{"a":2}', "fenced"), ('{"a":"}{\\"x"}', "balanced"), ('{"a": {"b": "c\\\\"}}', "balanced"), None, None, ('{"q":1}', "braces"), None, ('{"z":1}', "balanced"), ('{"a":1}', "balanced")]
    assert each(spark, lambda x: json_text.strict_json(x).isNotNull(), ["1", "1 2", "1,2", "[1] x", '{"a":[]}', "", "null"]) == [True, False, False, False, True, False, True]


def test_published_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    assert published.current(spark, path) is None and published.published(spark, path) is None
    published.publish(spark.range(3), {"revision": "a"}, path, "one")
    broken = spark.range(5).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        published.publish(broken, {"revision": "b"}, path, "two")
    data, metadata = published.published(spark, path)
    assert data.count() == 3 and metadata == {"revision": "a"}
    published.publish(spark.range(7), {"revision": "c"}, path, "three")
    data, metadata = published.published(spark, path)
    assert data.count() == 7 and metadata == {"revision": "c"} and published.superseded(spark, path) == ["one", "two"]


def test_layout_blocks(spark):
    lines = [("Title", 800, 20, 1, False), ("one", 790, 10, 0, False), ("two", 778, 10, 0, False), ("三", 766, 10, 0, False), ("far", 740, 10, 0, False), ("end.", 728, 10, 0, True), ("next", 716, 10, 0, False), ("- a", 704, 10, 0, False), ("2) b", 692, 10, 0, False), ("tail", 680, 10, 0, False)]
    rows = [(1, 1, i, t, False, level, float(y), float(f), forced) for i, (t, y, f, level, forced) in enumerate(lines, 1)]
    ordered = spark.createDataFrame(rows, "doc_id int, page int, line_no int, text string, two_columns boolean, level int, y double, font_size double, forced_break boolean")
    found = layout.blocks(ordered)
    assert [(r.kind, r.markdown) for r in found.orderBy("block").collect()] == [("heading", "# Title"), ("text", "one two三"), ("text", "far" " " "end."), ("text", "next"), ("list", "- a"), ("list", "1. b"), ("text", "tail")]
    assert layout.page_markdown(found).first().markdown == "# Title\n\none two三\n\nfar end.\n\nnext\n\n- a\n1. b\n\ntail"


def test_raw_files_without_text(spark, tmp_path):
    """A null or empty text leaves an empty last line, which counts as one."""
    docs = spark.range(164).selectExpr("id AS doc_id", "CASE WHEN id < 82 THEN '' END AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    flaw = lambda k: (checks.RAW_FLAWS[k % 41:] or [None])[0]
    found = {r.source_id: r.code for r in checks.raw_revisions(spark, str(tmp_path)).collect()}
    assert found == {f"d{k}": flaw(k) for k in range(164)}
    ok = {r.subject: r.ok for r in checks.raw_checks(spark, str(tmp_path)).collect()}
    assert all(ok[f"d{k}"] == (not flaw(k) and (k % 43 == 5 or k % 47 != 6) and k % 53 != 7) for k in range(164))
