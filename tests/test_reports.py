"""Layout, media, run and coverage operators on small cases and against brute force."""

import pandas as pd

from lodestone.operators import coverage, layout, media
from lodestone.plans import reports
from lodestone.sources.derived import table

DIR = "/root/testdata/sf0.001"


def test_lines_join_words_and_keep_rows_apart(spark):
    items = [(1, 0, t, x, y, 20.0, 10.0) for t, x, y in [("alpha", 0.0, 100.0), ("beta", 30.0, 101.0), ("，", 51.0, 100.0), (" ", 70.0, 100.0), ("below", 0.0, 80.0)]]
    found = layout.lines(spark.createDataFrame(items, "doc_id long, page int, text string, x double, y double, width double, font_size double")).orderBy("y").collect()
    assert [r.text for r in found] == ["below", "alpha beta，"]


def test_margins_and_empty_layout(spark):
    schema = "doc_id long, page int, text string, x double, y double, max_x double, font_size double"
    rows = [(1, p, t, 0.0, y, 50.0, 10.0) for p in range(3) for t, y in [(f"Page {p}", 90.0), (f"body {'abc'[p]}", 50.0), (f"end {'xyz'[p]}", 10.0)]]
    kept = {r.text for r in layout.without_margins(spark.createDataFrame(rows, schema)).collect()}
    assert kept == {"body a", "body b", "body c", "end x", "end y", "end z"}
    assert layout.reading_order(layout.without_margins(spark.createDataFrame([], schema)), 100.0).count() == 0


def test_columns_are_read_one_after_the_other(spark):
    schema = "doc_id long, page int, text string, x double, y double, max_x double, font_size double"
    rows = [(1, 0, f"{'lr'[i % 2]}{i}", i % 2 * 60.0, 100.0 - i, i % 2 * 60.0 + 30.0, 10.0) for i in range(8)] + [(1, 0, "across", 0.0, 95.5, 100.0, 20.0)]
    found = layout.reading_order(spark.createDataFrame(rows, schema), 100.0).orderBy("line_no").collect()
    assert [r.text for r in found] == ["l0", "l2", "l4", "r1", "r3", "across", "l6", "r5", "r7"]
    assert {r.text: r.level for r in found}["across"] == 1 and all(r.two_columns for r in found)


def test_boundary():
    assert media.boundary("and so the story ends here", "story ends here. Next") == len("story ends here.")
    assert media.boundary("no match at all", "different words") == 0


def test_chunk_merge_matches_a_plain_loop(spark):
    timeline = media.chunk_timeline(*reports._transcripts(spark, DIR))
    rows = sorted(timeline.select("media_id", "chunk", "ord", "text").collect())
    want, before = [], {}
    for m, c, o, text in rows:
        held = before.get(m)
        if held is not None:
            n = next((n for n in range(min(160, len(held), len(text)), 7, -1) if media.IGNORED.sub("", held[-n:]).lower() == media.IGNORED.sub("", text[:n]).lower()), 0)
            text = text[n:].lstrip() if n else text
        if held is None or text.strip():
            want.append((m, c, o, text))
            before[m] = text
    found = media.drop_overlaps(timeline).select("media_id", "chunk", "ord", "text").collect()
    assert sorted(map(tuple, found)) == want
    assert sum(len(r[3]) for r in rows) > sum(len(r[3]) for r in want)


def test_frames_match_a_plain_loop(spark):
    frames = reports.frames_of(table(spark, DIR, "events"))
    data = frames.toPandas()
    data = data[data.valuable & (data.category != "talking_head") & (data.confidence >= 0.8)].sort_values(["media_id", "confidence", "timestamp_ms", "frame_id"], ascending=[True, False, True, True])
    want = []
    for m, rows in data.groupby("media_id"):
        taken = []
        for r in rows.itertuples():
            if len(taken) < 5 and all(abs(r.timestamp_ms - t) >= 3_600_000 for t in taken):
                taken.append(r.timestamp_ms)
                want.append((m, r.frame_id))
    found = media.select_frames(frames, gap_ms=3_600_000, limit=5).select("media_id", "frame_id").collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_run_ends_once(spark):
    schema = "run_id string, seq int, type string, tool_call_id string, name string, is_error boolean, iteration int"
    rows = [("a", 1, "tool_started", "t", "n", False, 1), ("a", 2, "tool_completed", "t", "n", True, 4), ("a", 3, "completed", None, None, False, 2), ("a", 4, "error", None, None, True, 9), ("b", 1, "plan_ready", None, None, False, None)]
    found = {r.run_id: r for r in media.run_snapshots(spark.createDataFrame(rows, schema)).collect()}
    assert (found["a"].state, found["a"].iterations, found["a"].tools_started, found["a"].tools_failed, found["a"].last_seq) == ("completed", 4, 1, 1, 3)
    assert (found["b"].state, found["b"].iterations) == ("waiting", 0)


def test_raw_issues(spark):
    rows = [(1, None, "x"), (2, "```\na\n~~~\n", None), (3, "~~~\n```\n~~~\n", None), (4, "a�", "no")]
    found = coverage.raw_issues(spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text", "recorded_hash"]), "doc_id long, text string, recorded_hash string")).collect()
    assert sorted(map(tuple, found)) == [(1, "missing_text"), (2, "open_fence"), (4, "hash_mismatch"), (4, "replacement_character")]


def test_long_documents_are_laid_out_whole(spark, tmp_path):
    """A document of over 1,000 pages keeps all of them, and its running heads go as from a short one."""
    texts = [(1, " ".join(f"w{i}" for i in range(240 * 1001 + 1))), (2, "a b"), (3, " ".join(f"v{i}" for i in range(500))), (4, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = reports.page_markdown(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.page) for r in found) == [*((1, i) for i in range(1002)), (2, 0), *((3, i) for i in range(3))]
    blocks = reports.layout_blocks(spark, str(tmp_path)).where("markdown LIKE '%Reader page%'").collect()
    assert sorted((r.doc_id, r.page) for r in blocks) == [(2, 0)]


def test_margins_of_a_document_are_no_list_on_each_page(spark):
    """Keys of edges are rows beside their pages: what is made for margins grows as the pages do."""
    pages = spark.range(400).selectExpr("1L AS doc_id", "cast(id AS int) AS page", "array(struct('Head ' || id AS text, 0D AS x, 9D AS y, 1D AS max_x, 1D AS font_size), struct('t' || repeat('x', cast(id AS int)) AS text, 0D AS x, 1D AS y, 1D AS max_x, 1D AS font_size)) AS rows")
    found = layout.page_bodies(pages)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.page, [x.text for x in r.rows]) for r in found.collect()) == [(i, ["t" + "x" * i]) for i in range(400)]
