"""Names, transcripts, manifests and streams: small cases with known results."""

import json

from pyspark.sql import functions as F

from lodestone.functions import decoding, names
from lodestone.operators import structure, transcripts
from lodestone.sources import manifests
from lodestone.streaming import streams


def each(spark, column, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_names(spark):
    assert each(spark, names.slug, ["Caf\u00e9 Noir!", "--", "a" * 90]) == ["cafe-noir", "", "a" * 80]
    assert each(spark, names.canonical_basename, ["My: File  v2.PDF", "...", "a/b.txt"]) == ["my-file-v2", "document", "a-b"]
    assert each(spark, names.public_address, ["8.8.8.8", "10.1.2.3", "172.31.0.1", "172.32.0.1", "256.1.1.1", "::1", "fe80::1", "2606:4700::1111", "x"]) == [True, False, False, True, False, False, False, True, False]
    assert each(spark, lambda x: names.inbox_path_ok(x, "config"), ["Clippings/", "raw/x", "a/../b", "", "config", "wik"]) == [True, False, False, False, False, True]
    assert each(spark, names.relative_image, ["![[a.png]]", "![x](b.png)", "![x](https://a/b.png)", "![x](/a.png)"]) == [True, True, False, False]
    assert each(spark, names.summary_redacted, ["Token: abc at https://x.org/a?q=1  end"]) == ["Token=[REDACTED] at https://x.org/a end"]
    assert each(spark, names.resume_token_ok, ["ok", "", None, "Bearer x", "a" * 2049]) == [True, False, False, False, False]
    assert each(spark, decoding.decode_text, [b"\xef\xbb\xbfa", b"\xff\xfea\x00", b"\xfe\xff\x00a", b"\xff", "é".encode()], "binary") == ["a", "a", "a", None, "é"]
    kinds = spark.createDataFrame([("entity", "wiki/entities/a.md", "T", "c"), ("concept", "wiki/entities/A b.md", "T", "c"), ("synthesis", None, "  ", "?")], "k string, r string, t string, c string")
    found = [r[0] for r in kinds.select(names.knowledge_path(*(F.col(c) for c in "krtc"))).collect()]
    assert found[:2] == ["wiki/entities/a.md", "wiki/concepts/a-b.md"] and found[2].startswith("wiki/synthesis/synthesis-")


def test_markdown_blocks_chunks_and_normal_form():
    text = "# T\n\npara one\nmore\n- a\n  b\n- c\n> q\n> r\n| a | b |\n| --- | --- |\n| 1 | 2 |\n<!-- llm-wiki:page=3 -->\n<!-- llm-wiki:block=b000009 -->\n````\n```\n# no\n````\n<div>\nlast\n~~~\nopen\n"
    found = structure.block_rows(text)
    assert [(n, k, a, b, p) for n, k, _, _, a, b, p in found] == [
        (1, "heading", 1, 1, 1), (2, "paragraph", 3, 4, 1), (3, "list", 5, 7, 1), (4, "quote", 8, 9, 1), (5, "table", 10, 12, 1), (6, "code", 15, 18, 3), (7, "html", 19, 19, 3), (8, "paragraph", 20, 20, 3), (9, "code", 21, 22, 3),
    ]
    assert [(a, b) for _, _, a, b, *_ in found][:3] == [(2, 2), (5, 6), (8, 10)]
    parts = structure.split_markdown("intro\n\n# A\n" + "x" * 80 + "\n# B\n" + "y" * 400, 30)
    assert parts[0] == "intro\n\n\n# A\n" + "x" * 80 and all(structure.estimate(p) <= 30 for p in parts) and "".join(parts).count("y") == 400
    assert structure.split_markdown(" \n", 5) == [] and structure.split_markdown("ab", 5) == ["ab"]
    normal = structure.normal_markdown("\ufeffa  \r\n\r\n\r\n\r\nb\x07\n```\ncode \t\n```\n" + "w " * 700 + "e\u0301")
    assert normal.startswith("a\n\n\nb\n```\ncode\n```\nw w") and normal.endswith("\u00e9\n") and max(map(len, normal.split("\n"))) <= 1200


def test_untimed_paragraphs():
    sentence = "这是一个完整的句子，" * 8 + "结束。"
    found = transcripts.untimed_paragraphs(sentence * 12)
    assert "".join(found) == sentence * 12 and all(len(p) <= 480 and p.endswith("。") for p in found)
    words = "word " * 400
    found = transcripts.untimed_paragraphs(words)
    assert all(len(p) <= 480 for p in found) and " ".join(found).split() == words.split()


def test_adapter_and_groups(spark):
    bodies = [
        ("a", json.dumps({"duration": 10, "segments": [{"text": " hi ", "start": 1, "end": 2.5}, {"text": ""}]})), ("b", json.dumps({"result": {"chunks": [{"transcript": "x", "timestamp": [12000, 13000]}]}})),
        ("c", json.dumps({"text": "plain"})), ("d", "not json"), ("e", json.dumps({"words": [{"word": "w", "start_ms": 7}]})), ("f", json.dumps({"duration": 20, "segments": [{"text": "y", "start_time": 300, "end_time": 400}]})),
    ]
    found = {r.media_id: (r.start_ms, r.end_ms, r.text, r.from_words) for r in transcripts.adapt_responses(spark.createDataFrame(bodies, "media_id string, body string")).collect()}
    assert found == {"a": (1000, 2500, "hi", False), "b": (12000, 13000, "x", False), "c": (None, None, "plain", False), "d": (None, None, "not json", False), "e": (7, None, "w", True), "f": (300, 400, "y", False)}
    words = [("m", 0, 0, 100, None, "Hello"), ("m", 1, 200, 300, None, "there"), ("m", 2, 2000, 2100, None, "later"), ("n", 0, 0, 1, None, "x" * 130), ("n", 1, 2, 3, None, "y")]
    groups = transcripts.word_groups(spark.createDataFrame(words, "media_id string, ord int, start_ms long, end_ms long, speaker string, text string"))
    assert [(r.media_id, r.group_no, r.start_ms, r.end_ms, len(r.text)) for r in groups.orderBy("media_id", "group_no").collect()] == [("m", 0, 0, 300, 11), ("m", 1, 2000, 2100, 5), ("n", 0, 0, 1, 130), ("n", 1, 2, 3, 1)]


def test_budgets_and_checks(spark):
    evidence = spark.createDataFrame([("r", i, t) for i, t in enumerate([9000, 5000, 9000, 100, 9000])], "run_id string, ord int, tokens long")
    found = transcripts.evidence_budgets(evidence, total=20_000).orderBy("ord").collect()
    left, wanted = 20_000, []
    for t in (9000, 5000, 9000, 100, 9000):
        allowed = max(256, min(8000, left))
        wanted.append((allowed, min(t, allowed)))
        left = max(0, left - min(t, allowed))
    assert [(r.allowed, r.used) for r in found] == wanted
    frames = spark.createDataFrame([("m", "a"), ("m", "b")], "media_id string, frame_id string")
    said = spark.createDataFrame([("m", "a", 0.5), ("m", "a", 2.0), ("m", "z", 0.1)], "media_id string, frame_id string, confidence double")
    assert {(r.frame_id, r.code) for r in transcripts.assessment_issues(said, frames).collect()} == {("a", "duplicate_assessment"), ("a", "confidence_out_of_range"), ("b", "missing_assessment"), ("z", "unknown_frame")}
    tracks = spark.createDataFrame([("m", 0, "en", "English"), ("m", 1, "zh-TW", "x"), ("m", 2, "zh-CN", "x"), ("n", 0, "en", "E")], "media_id string, ord int, language string, label string")
    assert {r.media_id: r.language for r in transcripts.choose_tracks(tracks).collect()} == {"m": "zh-CN", "n": "en"}
    assert {r.media_id: r.language for r in transcripts.choose_tracks(tracks, "English").collect()}["m"] == "en"
    chunks = spark.createDataFrame([("a", "done", "h", "h"), ("a", "pending", None, None), ("b", "done", "h", "g"), ("c", "empty", "h", "h"), ("d", "empty", "h", "h"), ("d", "done", "h", "h"), ("e", "done", "h", "h")], "media_id string, status string, result_hash string, actual_hash string")
    assert {r.media_id: r.code for r in transcripts.chunk_coverage(chunks).collect()} == {"a": "COVERAGE_INCOMPLETE", "b": "RESULT_HASH_MISMATCH", "c": "EMPTY_TRANSCRIPT", "d": "EMPTY_CHUNKS"}


def test_manifests(spark, tmp_path):
    good = {"schemaVersion": 2, "id": "s1", "sourceHash": "a" * 64, "importedAt": "2024-01-01T00:00:00Z", "name": "x.pdf", "currentRevision": 2, "revisions": [{"revision": 1, "rawPath": "raw/a"}, {"revision": 2, "rawPath": "raw/b", "contentHash": "h"}]}
    for name, text in {"a": json.dumps(good), "b": "{", "c": json.dumps(good | {"sourceHash": "x"}), "d": json.dumps(good | {"id": ""})}.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows, errors = manifests.scan_manifests(spark, str(tmp_path))
    row = rows.first()
    assert (row.schemaVersion, row.kind, row.acquiredBy, row.revisions[0].artifactSchemaVersion) == (3, "pdf", "manual", 1)
    assert sorted(r.code for r in errors.collect()) == ["invalid_hash", "invalid_json", "missing_id"]
    assert manifests.current_revisions(rows).first().rawPath == "raw/b"
    files = spark.createDataFrame([("raw/a",), ("raw/z",)], "path string")
    assert [r.path for r in manifests.unmanaged_files(files, rows).collect()] == ["raw/z"]
    states = spark.createDataFrame([("parsing", None), ("waiting_remote", "t"), ("waiting_remote", None), ("parsed", None)], "status string, resume_token string")
    assert [r.status for r in manifests.recovered(states).collect()] == ["failed", "resumable", "failed", "parsed"]
    key = lambda m: spark.range(1).select(manifests.parse_key(F.lit("h"), F.lit("p"), F.lit("1"), F.create_map(*[F.lit(x) for kv in m for x in kv]), F.lit("f"))).first()[0]
    assert key([("a", "1"), ("b", "2")]) == key([("b", "2"), ("a", "1")]) != key([("a", "2"), ("b", "2")])


def run(stream, name, tmp_path, mode):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start().awaitTermination()


def test_streams(spark, tmp_path):
    polls = spark.createDataFrame([(1, "a", 5, 1), (2, "a", 9, 2), (3, "a", 9, 2), (4, "a", 9, 2), (1, "b", 1, 1)], "poll int, path string, size long, mtime long")
    polls.coalesce(1).write.parquet(str(tmp_path / "polls"))
    run(streams.settled_files(spark.readStream.schema(polls.schema).parquet(str(tmp_path / "polls"))), "settled", tmp_path, "append")
    assert [tuple(r) for r in spark.table("settled").collect()] == [("a", 9, 2)]
    events = spark.createDataFrame([("r", 1, "tool_started", 1, "t1"), ("r", 2, "text", 9, None), ("r", 3, "completed", 2, None), ("r", 4, "error", 3, None)], "run_id string, seq int, type string, iteration int, tool_call_id string")
    events.coalesce(1).write.parquet(str(tmp_path / "runs"))
    run(streams.run_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "runs"))), "runs", tmp_path, "update")
    assert [tuple(r) for r in spark.table("runs").collect()] == [("r", "completed", 2, 1)]
    schema = "seq int, path string, content string"
    for i, rows in enumerate([[(1, "wiki/a.md", "[[wiki/b]] [[wiki/c]]"), (2, "wiki/b.md", "[[wiki/a]]")], [(3, "wiki/a.md", "[[wiki/d]]"), (4, "wiki/b.md", None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "pages"))
        streams.index_updates(source, str(tmp_path / "links"), str(tmp_path / "c-links")).trigger(availableNow=True).start().awaitTermination()
        found = {tuple(r) for r in streams.current_links(spark, str(tmp_path / "links")).collect()}
        assert found == ({("wiki/a", "wiki/b"), ("wiki/a", "wiki/c"), ("wiki/b", "wiki/a")}, {("wiki/a", "wiki/d")})[i]
