"""What travels between tasks, and how evenly, on small made tables."""

import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import candidates, graph, index, layout, pages, schema_check, search, transcripts
from lodestone.plans import checks
from lodestone.sources import inbox


def stages(spark, since=-1):
    """Finished stages behind `since` as the session's own store has them."""
    sc = spark.sparkContext
    jvm, gateway = sc._jvm, sc._gateway
    found = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [s for s in (found.apply(i) for i in range(found.size())) if s.stageId() > since]


def last_stage(spark):
    return max((s.stageId() for s in stages(spark)), default=-1)


def test_routes_over_wide_pages_travel_as_numbers(spark):
    rng = random.Random(5)
    names = ["wiki/" + "".join(rng.choices("0123456789abcdef", k=400)) for _ in range(150)]
    edges = {(a, names[0]) for a in names[1:110]} | {(names[1], b) for b in names[5:140]} | {tuple(rng.sample(names, 2)) for _ in range(450)}
    links, starts = spark.createDataFrame(sorted(edges), "from_path string, to_path string"), spark.createDataFrame([(n,) for n in names], "path string")
    before = last_stage(spark)
    found = {(r.start, r.path): (r.hop, r.routes) for r in graph.routes(starts, links, "both").collect()}
    written = sum(s.shuffleWriteBytes() for s in stages(spark, before))
    ways = {"outgoing": edges, "backlink": {(b, a) for a, b in edges}}
    step = {n: {b for e in ways.values() for a, b in e if a == n} for n in names}
    assert max(map(len, step.values())) > graph.WIDE
    wanted = {}
    for s in names:
        one = sorted(step[s])[:20]
        two = sorted({b for m in one for b in step[m]} - {s, *one})
        for hop, p in [(1, x) for x in one] + [(2, x) for x in two][: 20 - len(one)]:
            routes = [f"{w}: {s} > {p}" for w, e in ways.items() if (s, p) in e] + [f"{w}: {s} > {m} > {p}" for w, e in ways.items() for m in step[s] if m != p and (m, p) in e]
            wanted[s, p] = (hop, sorted(routes))
    assert found == wanted
    routes = sum(len(r) for _, r in wanted.values())
    assert written < 2 * 400 * routes, (written, routes)  # a route shows two names of 400 characters or three


def test_proposals_without_a_candidate_are_spread(spark):
    was = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        made = spark.range(1000).selectExpr("id AS ord", "concat('o', id) AS from_candidate", "CASE WHEN id < 0 THEN 'o' END AS to_candidate", "CASE WHEN id < 0 THEN 'w' END AS to_path", "'component' AS relation", "0.9D AS confidence")
        candidates = spark.range(1000).selectExpr("concat('o', id) AS candidate_id", "'created' AS decision", "concat('wiki/a/', id) AS target_path")
        found = graph.resolve_proposals(made, candidates, spark.createDataFrame([("wiki/a/1",)], "path string"))
        rows = found.withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == 1000 and max(Counter(r.part for r in rows).values()) < 500
    assert all(r.from_ok and r.to_path is None and not r.one_target for r in rows)


def test_equal_candidates_are_ranked_once(spark):
    titles = ["blue ring", "Blue-Ring", "old plate", "green gear"]
    pages = [(f"wiki/concepts/p{i:03d}", "concept" if i % 3 else "entity", titles[i % 3], [], [], "", "") for i in range(60)]
    pages = spark.createDataFrame(pages, "path string, type string, title string, aliases array<string>, tags array<string>, tldr string, body string")
    asked = spark.createDataFrame([(i, "concept", titles[i % 4]) for i in range(400)], "candidate_id long, type string, title string")
    before = last_stage(spark)
    found = {}
    for r in search.candidate_matches(asked, pages).orderBy("candidate_id", "rank").collect():
        found.setdefault(r.candidate_id, []).append((r.path, r.score, r.exact))
    records = sum(s.shuffleWriteRecords() for s in stages(spark, before))
    concepts = lambda k: [f"wiki/concepts/p{i:03d}" for i in range(60) if i % 3 and i % 3 in k][:3]
    assert sorted(found) == [i for i in range(400) if i % 4 != 3]
    assert all(found[i] == [(p, 129, True) for p in concepts({1})] for i in found if i % 4 < 2)
    assert all(found[i] == [(p, 129, True) for p in concepts({2})] for i in found if i % 4 == 2)
    assert records < 400 * 20, records  # candidates times pages: 24,000


def test_front_matter_is_read_once(spark):
    files = spark.createDataFrame([("wiki/a.md", "---\ntype: entity\ntitle: A\n---\nb"), ("wiki/b.md", "---\ntype: other\n---\nb")], "path string, content string")
    found = pages.parse_pages(files)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("EvalPython") == 1
    assert [(r.path, r.title) for r in found.collect()] == [("wiki/a.md", "A")]


def test_files_and_responses_come_to_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    files = spark.range(40, numPartitions=1).selectExpr("concat('in/', id, '.md') AS path", "1000000L AS length", "encode(repeat(cast(id % 10 AS string), 1000000), 'UTF-8') AS content")
    known = spark.createDataFrame([], "hash string, source_id string")
    for make in (lambda: inbox.judged(files, known), lambda: transcripts.adapt_responses(files.selectExpr("path AS media_id", "decode(content, 'UTF-8') AS body"))):
        spark.conf.unset(key)
        make()
        sizes = files.select("content").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long").collect()
        assert max(r.n for r in sizes) <= 16 and sum(r.n for r in sizes) == 40


def test_nested_rows_are_judged_where_they_stand(spark):
    """Rows are parsed, judged and turned to violations in one stage; values are neither shuffled nor stored."""
    schema = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "object", "properties": {"b": {"type": "integer"}}}}}}
    rows = spark.createDataFrame([(1, '{"a":[{"b":1},{"b":"x"},{}]}'), (2, '{"a":null}')], "id int, json string")
    before = last_stage(spark)
    found = schema_check.violations(rows, schema)
    assert last_stage(spark) == before
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, "input.a[1].b", "not_integer"), (2, "input.a", "not_array")]


def test_lines_of_a_type_stay_spread(spark):
    """The published list meets no type in a join: its lines stay in the parts that numbered them."""
    rows = [(f"wiki/concepts/p{i:05}", "concept", f"t{i:05}", "") for i in range(4000)] + [("wiki/x", None, "none", ""), ("wiki/y", "odd", "odd", "")]
    found = index.visible_index(spark.createDataFrame(rows, "path string, type string, title string, tldr string")).collect()
    assert [x.position for x in sorted(found) if x.type == "concept"] == list(range(1, 4001))
    assert sorted((x.type, x.position, x.line) for x in found if x.type != "concept") == [(t, 0, "") for t in ("entity", "output", "source", "synthesis")]
    plan = index.visible_index(spark.createDataFrame(rows, "path string, type string, title string, tldr string"))._jdf.queryExecution().executedPlan().toString()
    # The one that is left is the numbers' own, of parts and groups.
    assert plan.count("LeftOuter") == 1


def test_cards_of_the_root_view_are_made_once(spark):
    """Making a card is the cost of the root view, so each is made once, and sizes and ranks are of what is kept."""
    made = spark.sparkContext.accumulator(0)

    def card(x):
        made.add(1)
        return f'{{"path":"{x}"}}'

    rows = spark.createDataFrame([(f"wiki/p{i:04}", "concept" if i % 7 else "entity", 9) for i in range(400)], "path string, type string, tokens int")
    cards = rows.withColumn("card", F.udf(card, "string")("path"))
    view = sorted(map(tuple, index.root_view(cards, budget=500, each=2).collect()), key=lambda x: (x[3], x[4]))
    assert made.value == 400
    total = view[0][1]
    assert total > 500 and view == [("layered", total, f"wiki/p{i:04}", t, n, 9) for t, i, n in (("concept", 1, 1), ("concept", 2, 2), ("entity", 0, 1), ("entity", 7, 2))]
    assert {x.mode for x in index.root_view(cards, budget=50_000).collect()} == {"complete"}


def test_pages_travel_whole(spark):
    """A page's items, lines and blocks are a row from step to step, and go by document once as text and once as lines."""
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice(["alpha", "beta.", "12)", "- x", "三", "Long"]) for _ in range(n))) for i, n in enumerate([0, 1, 239, 240, 241, 900, 2000] * 3)] + [(99, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    before = last_stage(spark)
    found = layout.block_rows(layout.page_blocks(layout.page_bodies(layout.within_caps(layout.page_lines(layout.pages_of(docs)))), 640.0)).collect()
    records = sum(s.shuffleWriteRecords() for s in stages(spark, before))
    pages = sum(-(-len((t or "").split()) // 240) for _, t in texts)
    assert records <= len(texts) + pages, records  # an item a row: over 10,000
    rows = layout.reading_order(layout.without_margins(layout.lines(layout.items_of(docs))), 640.0, ("y", "font_size"))
    assert sorted(map(tuple, found)) == sorted(map(tuple, layout.blocks(rows).collect())) and len(found) > 500
    few = layout.within_caps(layout.page_lines(layout.pages_of(docs)), pages=4, most=500)
    over = {i for i, t in texts if len((t or "").split()) + -(-len((t or "").split()) // 240) > 500}
    assert {r.doc_id for r in few.collect()} == {i for i, t in texts if t} - over
    assert {(r.doc_id, r.code) for r in layout.over_caps(layout.pages_of(docs), 4, 500).collect()} == {(i, "PAGE_LIMIT" if len(t.split()) > 960 else "ITEM_LIMIT") for i, t in texts if i in over}


def test_ids_are_settled_by_numbers_alone(spark, monkeypatch):
    """Rows meet what their request skips once, however long requests displace each other, and rows equal in order share no id."""
    monkeypatch.setattr(candidates, "BLOCK", 4, raising=False)
    rng = random.Random(3)
    asks = ["a"] * 6 + ["a-2", "a-3", "a-7", "a-2-2", "a-2-2-2", "a-2-2-3", "a-3-2", "a-99999999999999999", "a-1", "b-4", " ", None]
    rows = [(run, i // 2, rng.choice(asks), rng.choice(["x", "y"])) for run in ("r", "s", "t") for i in range(150)] + [("u", i, "b" if i % 9 else f"b-{i + 2}", "x") for i in range(60)]
    found = sorted(map(tuple, candidates.unique_ids(spark.createDataFrame(rows, "run_id string, ord int, wanted string, type string")).collect()))
    wanted = []
    for run in ("r", "s", "t", "u"):
        seen = set()
        for place, (_, i, ask, kind) in enumerate(sorted((r for r in rows if r[0] == run), key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3])), 1):
            base = (ask or "").strip() or f"{kind}-{place}"
            name = next(n for n in [base, *(f"{base}-{k}" for k in range(2, 400))] if n not in seen)
            seen.add(name)
            wanted.append((run, i, name))
    assert found == sorted(wanted) and len({(r, n) for r, _, n in found}) == len(rows)


def test_backlinks_are_sorted_once_and_stay_dealt(spark):
    """Steps meet one sort and no hash table of themselves, in as many tasks as the session has partitions."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    links = spark.range(6000).selectExpr("concat('wiki/p', lpad(cast(id DIV 2 AS string), 5, '0')) AS from_path", "concat('wiki/p', lpad(cast(id DIV 2 % 7 AS string), 5, '0')) AS to_path")
    starts = spark.range(9).selectExpr("concat('wiki/p', lpad(cast(id AS string), 5, '0')) AS path")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        found = graph.neighbours(starts, links, "backlinks", depth=1)
        before = last_stage(spark)
        rows = found.collect()
        tasks = max((s.numTasks() for s in stages(spark, before) if s.shuffleReadRecords() > 5000), default=0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    wanted = {(f"wiki/p{a:05}", f"wiki/p{b:05}", 1) for a in range(7) for b in [x for x in range(a, 3000, 7) if x != a][:20]}
    assert {tuple(r) for r in rows} == wanted and len(rows) == len(wanted)
    plan = graph.neighbours(starts, links, "backlinks", depth=1)._jdf.queryExecution().executedPlan().toString()
    assert tasks == 24 and "WindowGroupLimit" in plan
    assert plan.count("HashAggregate(") == 2, plan  # the starts' own


def test_items_without_a_place_are_lines(spark):
    rows = [(1, 0, "far", None, 90.0, 5.0, 10.0), (1, 0, "low", 0.0, 10.0, 5.0, None), (1, 0, None, 0.0, 50.0, 5.0, 10.0), (1, 0, " ", 0.0, 40.0, 5.0, 10.0)]
    items = spark.createDataFrame(rows, "doc_id long, page int, text string, x double, y double, width double, font_size double")
    found = layout.reading_order(layout.lines(items), 100.0, ("y", "font_size"))
    assert [(r.text, r.y, r.font_size) for r in found.orderBy("line_no").collect()] == [("far", 90.0, 10.0), ("low", 10.0, None)]


def test_steps_of_routes_are_made_once(spark):
    """Links are read for the names and for the steps, and no more; steps are shuffled as numbers from one place."""
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    rng = random.Random(6)
    names = [f"wiki/p{i:04}" for i in range(400)]
    edges = sorted({(a, names[0]) for a in names[1:90]} | {tuple(rng.sample(names, 2)) for _ in range(2000)})
    links = spark.createDataFrame(edges, "from_path string, to_path string").select(F.udf(seen, "string")("from_path").alias("from_path"), "to_path")
    starts = spark.createDataFrame([(n,) for n in names], "path string")
    before = last_stage(spark)
    graph.routes(starts, links, "both").collect()
    written = sum(s.shuffleWriteRecords() for s in stages(spark, before))
    # Each reading judges a link and takes its end: twice. It was 22,858 times, with 50,738 rows shuffled.
    assert read.value <= 4 * len(edges), (read.value, len(edges))
    assert written < 20 * len(edges), (written, len(edges))


def test_proposals_that_fail_alone_meet_no_join(spark):
    """Of proposals whose edges are asked for, those that fail by themselves travel nowhere, and the rest are dealt by page once."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    was = {k: spark.conf.get(k, None) for k in keys}
    made = spark.range(3000).selectExpr("id AS ord", "concat('o', id % 300) AS from_candidate", "CASE WHEN id % 10 = 1 THEN 'o1' END AS to_candidate", "concat('[[wiki/a/', id % 7, ']]') AS to_path",
                                        "CASE WHEN id % 10 = 2 THEN 'mentions' ELSE 'component' END AS relation", "CASE WHEN id % 10 = 3 THEN 0.1D WHEN id % 10 = 4 THEN double('NaN') WHEN id % 10 <> 5 THEN 0.8D END AS confidence")
    candidates = spark.range(300).selectExpr("concat('o', id) AS candidate_id", "CASE WHEN id % 10 = 6 THEN 'rejected' ELSE 'created' END AS decision", "CASE WHEN id % 10 <> 7 THEN concat('wiki/b/', id) END AS target_path")
    known = spark.range(7).selectExpr("concat('wiki/a/', id) AS path")
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        judged = graph.judge_proposals(graph.resolve_proposals(made, candidates, known))
        before = last_stage(spark)
        found = graph.link_plan(judged).collect()
        written = sum(s.shuffleWriteRecords() for s in stages(spark, before))
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    good = [i for i in range(3000) if i % 10 in (0, 8, 9)]
    assert {(r.from_path, r.to_path) for r in found} == {(f"wiki/b/{i % 300}", f"wiki/a/{x}") for i in good for x in sorted({j % 7 for j in good if j % 300 == i % 300})[:5]}
    assert {r.reason: r.n for r in graph.drop_counts(judged).collect()} == {"invalid_target_shape": 300, "invalid_relation": 300, "low_confidence": 900, "invalid_from": 600, "duplicate": 270, "outgoing_limit": 180}
    # It was 11,324: all proposals went to the joins.
    assert written < 8000, written


def test_drafts_are_read_once_in_all_parts(spark):
    """A text is gone through once for its drafts, and texts made of few keys are dealt before they are made."""
    space = " \t\n\u00a0\u2003\u3000\ufeff"
    texts = [f"<!-- llm-wiki:draft={i} -->{a}{b}{c}<!--llm-wiki:end-draft-->" for i in ("a", " b ", "c-1") for a in ("", space) for b in ("", "x", f"x{space}y <!-- z -->", "<!-- llm-wiki:draft=d -->x") for c in ("", space)]
    texts += [f"{texts[0]}{texts[5]} {texts[7]}", "<!-- llm-wiki:draft=a -->x", "<!-- llm-wiki:end-draft -->", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "batch_id int, text string")
    found = candidates.marked_drafts(rows)
    assert found._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") == 1
    one = re.compile(r"<!--\s*llm-wiki:draft=([^>]+?)\s*-->([\s\S]*?)<!--\s*llm-wiki:end-draft\s*-->")
    wanted = [(i, m[1].strip(), n, m[2].strip(space)) for i, t in enumerate(texts) for n, m in enumerate(one.finditer(t or ""), 1)]
    assert sorted(map(tuple, found.collect())) == sorted(wanted) and len(wanted) > 50
    before = last_stage(spark)
    checks.draft_issues(spark, "/root/testdata/sf0.001").collect()
    assert max(s.numTasks() for s in stages(spark, before) if s.shuffleReadRecords() and s.shuffleWriteRecords()) >= 4
