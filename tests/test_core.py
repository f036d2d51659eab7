"""Operators on small rows, against results worked out by hand or in plain Python."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorebase.functions import numbers, text
from lorebase.functions.query_language import QuerySyntaxError, compile_query, with_categories
from lorebase.operators import crawl, experiments, gates, leaderboard, sections, similarity, upsert
from lorebase.operators.components import connected_components
from lorebase.operators.references import orphan_references, orphan_report
from lorebase.tables import empty, schema


def value(spark, column, **row):
    types = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in row.items())
    df = spark.createDataFrame([tuple(row.values())], types) if row else spark.range(1)
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "raw, slug",
    [("HM3D ObjectNav (val-unseen)", "hm3d_objectnav_val-unseen"), ("COCO  détection", "coco_détection"), ("", ""), ("中文 A", "中文_a")],
)
def test_slug(spark, raw, slug):
    assert value(spark, text.slug(F.col("c")), c=raw) == slug


def test_ids(spark):
    assert value(spark, text.safe_id(F.col("c")), c="cs/0501.001") == "cs_0501_001"
    assert value(spark, text.id_of_address(F.col("c")), c="http://x/abs/2401.12345v2") == "2401.12345v2"
    assert value(spark, text.paper_id_in(F.col("c")), c="see 2401.12345v2") == "2401.12345"
    assert value(spark, text.paper_id_in(F.col("c")), c="none") is None


def test_text_helpers(spark):
    assert value(spark, text.strip(F.col("c")), c=" \t a b　\n") == "a b"
    assert value(spark, text.clip_end(F.col("c"), 3), c="é中😀x") == "中😀x"
    assert value(spark, text.latter_two_thirds(F.col("c")), c="abcdefg") == "cdefg"
    assert value(spark, text.numbered_lines(F.col("c")), c="a\nb") == "    1| a\n    2| b"
    assert value(spark, text.without_code_fence(F.col("c")), c="```md\n# x\n```") == "# x"
    assert value(spark, text.fill("{a} of {b}{a}", a=F.col("c"), b=F.lit(None).cast("string")), c="x") == "x of x"
    assert value(spark, text.without_arrows(F.col("c")), c=" SR ↑") == "SR"


@pytest.mark.parametrize("raw, x", [("67.2", 67.2), ("67.2%", None), ("1.0d", None), ("1_000", 1000.0), (" 5 ", 5.0), ("inf", float("inf")), ("", None)])
def test_to_double(spark, raw, x):
    assert value(spark, numbers.to_double(F.col("c")), c=raw) == x


def test_score(spark):
    assert value(spark, numbers.to_score(F.col("c")), c="7") == 7
    assert value(spark, numbers.to_score(F.col("c")), c="7.9") is None


@pytest.mark.parametrize("new, old, hit", [(52.5, 50.0, False), (1.05, 1.0, True), (1.0, 0.0, False), (float("nan"), 1.0, False), (1.0, float("nan"), False)])
def test_conflict_bounds(spark, new, old, hit):
    assert value(spark, numbers.conflicts(F.col("a"), F.col("b")), a=new, b=old) is hit


# --- references ------------------------------------------------------------------------------


def day(n):
    return datetime(2024, 1 + n // 28, 1 + n % 28)


def refs(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "arxiv_id string, created_at timestamp_ntz")
    return df.withColumns({"ref": F.lit(1), "kind": F.lit("x")}) if extra else df


def test_orphans(spark):
    parents = refs(spark, [("1.1v1", day(10)), ("1.1v1", day(5)), (None, day(0)), ("3.3v1", None)])
    removed = spark.createDataFrame([("2.2v1",), ("1.1v1",), (None,)], "arxiv_id string")
    child = refs(
        spark,
        [(" ArXiv:1.1V1", day(4)), ("http://m/x/abs/1.1v1\n", day(5)), ("2.2v1", day(40)), ("2.2v1", day(41)), ("9.9", None), (None, day(1)), ("", day(1)), ("1.1v1", None), ("3.3v1", day(1))],
        extra=True,
    )
    got = orphan_references({"t": child, "e": refs(spark, [])}, parents, removed)
    rows = {tuple(r) for r in got.collect()}
    assert rows == {
        ("t", "1.1v1", "2024-01", "late", 2), ("t", "2.2v1", "2024-02", "deleted", 2), ("t", "9.9", "none", "missing", 1), ("t", "", "2024-01", "missing", 1),
    }
    assert orphan_report(got).count() == 4


def test_orphans_of_empty_parents(spark):
    none = refs(spark, [])
    got = orphan_references({"t": refs(spark, [("a", day(0))] * 3)}, none, none)
    assert [tuple(r) for r in got.collect()] == [("t", "a", "2024-01", "missing", 3)]
    assert orphan_references({"t": none}, none, none).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (3, 2), (None, 9), *[(100 + i, 101 + i) for i in range(40)], *[(500, 501 + i) for i in range(30)]]
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert {got[i] for i in (1, 2, 3)} == {1} and got[4] == got[5] == 4 and got[7] == 7
    assert {got[100 + i] for i in range(41)} == {100} and {got[501 + i] for i in range(30)} == {500}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- gates, crawl, upserts -------------------------------------------------------------------


def test_gates_are_anti_joins(spark):
    papers = spark.createDataFrame([("a",), ("b",), (None,)], "arxiv_id string")
    verdicts = spark.createDataFrame([("a", 7), ("c", 6), ("d", 5)], "arxiv_id string, score int")
    open_ = gates.unfiltered(papers, verdicts)
    assert {r[0] for r in open_.collect()} == {"b", None}
    assert "LeftAnti" in open_._jdf.queryExecution().toString()
    assert {r[0] for r in gates.unread_relevant(verdicts, papers.filter("arxiv_id = 'a'")).collect()} == {"c"}
    assert gates.by_ids(papers, papers.limit(0)).count() == 0
    errors = {r["arxiv_id"]: r["error"] for r in gates.fetch_or_error(verdicts.select("arxiv_id"), papers).collect()}
    assert errors["a"] is None and errors["c"] == "Paper c not found"


def test_last_topic_of_a_name_counts(spark):
    topics = spark.createDataFrame([("t", "old", 0), ("t", "new", 1), ("u", "", 2), ("v", None, 3)], "name string, research_profile string, pos int")
    papers = spark.createDataFrame([("a", "t"), ("b", "u"), ("c", "v"), ("d", "w")], "arxiv_id string, source_topic string")
    assert [(r["arxiv_id"], r["research_profile"]) for r in gates.with_topic(papers, topics, F.col("pos")).collect()] == [("a", "new")]


def test_lookback_is_inclusive_and_topk_is_grouped(spark):
    rows = [("a", "t", day(20), day(0)), ("b", "t", day(13), day(0)), ("c", "t", day(12), day(0)), ("d", "u", day(19), day(0))]
    papers = spark.createDataFrame(rows, "arxiv_id string, source_topic string, published timestamp_ntz, created_at timestamp_ntz")
    top = crawl.newest_per_topic(papers, 5, F.lit("2024-01-21").cast("timestamp_ntz"), 7)
    assert {r["arxiv_id"] for r in top.collect()} == {"a", "b", "d"}
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()
    assert {r[0] for r in crawl.newest_per_topic(papers, 1, F.lit("2024-01-21").cast("timestamp_ntz"), 30).select("arxiv_id").collect()} == {"a", "d"}


def test_upserts(spark):
    def paper(i, title, topic, when):
        return (i, title, "abs", ["x"], None, None, None, topic, when)

    old = spark.createDataFrame([paper("a", "old", "t1", day(0)), paper("b", "b", None, day(0))], schema("papers"))
    new = spark.createDataFrame([paper("a", "new", "t2", day(9)), paper("c", "c", "t3", day(9))], schema("papers"))
    once = upsert.upsert_papers(old, new)
    got = {r["arxiv_id"]: (r["title"], r["source_topic"], r["created_at"]) for r in once.collect()}
    assert got == {"a": ("new", "t1", day(0)), "b": ("b", None, day(0)), "c": ("c", "t3", day(9))}
    again = {r["arxiv_id"]: (r["title"], r["source_topic"], r["created_at"]) for r in upsert.upsert_papers(once, new).collect()}
    assert again == got
    v = "arxiv_id string, score int, created_at timestamp_ntz"
    rows = upsert.upsert_rows(spark.createDataFrame([("a", 1, day(0))], v), spark.createDataFrame([("a", None, day(5)), ("b", 2, day(5))], v))
    assert {tuple(r) for r in rows.collect()} == {("a", None, day(0)), ("b", 2, day(5))}
    runs = upsert.finish_run(upsert.start_run(empty(spark, "pipeline_runs"), F.lit("2024-01-01").cast("timestamp_ntz")), 1, F.lit("2024-01-02").cast("timestamp_ntz"), 1, 1, 1, "failed")
    assert runs.first()["status"] == "failed"


# --- sections --------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "line, name",
    [("3. Approach", "method"), ("3 Approach", "method"), ("3.1 Approach", None), ("III. Method", None), ("Results show that", "experiments"), ("  INTRODUCTION", "introduction"), ("", None), ("Future  work", "limitations")],
)
def test_headings(spark, line, name):
    assert value(spark, sections.heading(F.col("c")), c=line) == name


def test_sections(spark):
    body = "Title\n\nAbstract\nA b.\n1 Introduction\nx\n\ny\nMethod\nm\nIntroduction again\nz\n"
    docs = spark.createDataFrame([(1, body), (2, "\n \n"), (3, None), (4, "")], "id int, text string")
    got = {r["id"]: r["sections"] and [tuple(s) for s in r["sections"]] for r in sections.with_sections(docs).collect()}
    assert got[1] == [("preamble", "Title"), ("abstract", "Abstract\nA b."), ("introduction", "1 Introduction\nx\n\ny\nIntroduction again\nz"), ("method", "Method\nm")]
    assert got[2] == [] and got[3] is None and got[4] == []


def test_passes(spark):
    docs = spark.createDataFrame([("Experiments\n" + "e" * 2987,), ("Experiments\n" + "e" * 2988,), ("no sections",)], "text string")
    cut = sections.with_sections(docs).withColumn("m", sections.section_map(F.col("sections"), F.col("text")))
    a, b, c = cut.select(sections.text_for_pass(F.col("m"), "experiments"), F.col("text"), sections.text_for_pass(F.col("m"), "method_intro"), sections.text_for_pass(F.col("m"), "context")).collect()
    assert a[0] == a[1][len(a[1]) // 3 :] and b[0] == b[1] and c[2] == c[3] == "no sections"


# --- experiments and boards ------------------------------------------------------------------


def test_normalise(spark):
    raw = [
        '{"entries":[{"benchmark":"B","metric":"SR","results":[{"method":"m","value":"67.2%"},{"value":3},{"method":"k","value":null}]}]}',
        '{"entries":[]}', '{"entries":[{"metric":"SR","results":[]}]}', "broken",
    ]
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(raw)], "id string, raw string").withColumn("r", F.from_json("raw", experiments.REPLY))
    rows = df.select(experiments.normalise(F.col("r"), F.col("id")).alias("t"), experiments.reply_error(F.col("r")).alias("e")).collect()
    t = rows[0]["t"]
    assert (t["entries"][0]["setting"], t["entries"][0]["higher_is_better"]) == ("default", True)
    assert [tuple(x) for x in t["entries"][0]["results"]] == [("unknown", 3.0, False)]
    assert rows[1]["t"] is None and rows[2]["t"] is None and rows[2]["e"] and rows[3]["t"] is None


def reading(i, when, entries):
    return (i, None, None, None, None, None, None, None, (i, entries, "d"), when)


def entry(benchmark, setting, metric, *results, up=True):
    return (benchmark, setting, metric, up, list(results))


def test_nest_is_the_inverse_of_unnest(spark):
    rows = [reading("a", day(0), [entry("B", "s", "SR", ("m", 1.0, True), ("n", None, False)), entry("C", "s", "SR", ("m", 2.0, False))]), reading("b", day(1), []), ("c", *[None] * 8, day(2))]
    df = spark.createDataFrame(rows, schema("deep_readings"))
    flat = experiments.unnest(df)
    assert flat.count() == 3
    back = experiments.nest(flat.repartition(3), F.lit("d")).collect()
    assert [r["experiment_table"] for r in back] == [df.filter("arxiv_id = 'a'").first()["experiment_table"]]
    groups = {r["benchmark"]: r["summary"] for r in experiments.groups(flat).collect()}
    assert groups == {"B": "m on B (s)", "C": "baselines on C (s)"}


def test_boards(spark):
    rows = [
        reading("p1", day(0), [entry("Bench", "s1", "SR", ("Net", 50.0, True), ("Old", 40.0, False)), entry("Bench", "s2", "SR", ("Net", 30.0, True))]),
        reading("p2", day(1), [entry("bench", "s1", "sr", ("Net", 52.5, False), ("New", 60.0, True)), entry("Bench", "s1", "SR", ("Old", 60.0, False))]),
    ]
    board = leaderboard.board_rows(experiments.unnest(spark.createDataFrame(rows, schema("deep_readings"))), F.unix_micros(F.col("created_at").cast("timestamp")))
    found = leaderboard.conflicts_as_of(board)
    assert [(r["method"], r["existing_value"], r["paper_source"]) for r in found.collect()] == [("Old", 40.0, "p1")]
    grouped = board.groupBy("slug", "seq", "arxiv_id", "benchmark", "setting").agg(F.min("entry_pos").alias("group_pos"))
    acts = {(r["arxiv_id"], r["benchmark"], r["setting"]): r["action"] for r in leaderboard.actions(grouped, found).collect()}
    assert acts == {("p1", "Bench", "s1"): "new_entry", ("p1", "Bench", "s2"): "updated", ("p2", "bench", "s1"): "updated", ("p2", "Bench", "s1"): "conflict_resolved"}
    ranks = {(r["setting"], r["method"]): r["rank"] for r in leaderboard.ranked(board.filter("metric = 'SR'")).collect()}
    assert ranks[("s1", "Old")] == 1 and ranks[("s1", "Net")] == 2
    pages = leaderboard.rendered(board).collect()
    assert len(pages) == 1 and pages[0]["markdown"].startswith("# Bench\n\n## s1") and "| Rank | Method | SR↑ |" in pages[0]["markdown"]


MD = "# B\n| Rank | Method | SPL ↑ | SR ↑ | Paper | Notes |\n|---|---|---|---|---|---|\n| 1 | RankNet | 1 | 2 | x | |\n| 1 | |  | n/a | 2401.1 | |\n| 2 | Big Net v2 | 3.5 | 44.5 | see 2401.12345 | |\n"


@pytest.mark.parametrize("method, metric, hit", [("net", "sr", 44.5), ("Big Net v2 plus", "SPL", 3.5), ("net", "F1", None), ("zzz", "SR", None)])
def test_lookup(spark, method, metric, hit):
    assert value(spark, leaderboard.find_value(F.col("a"), F.col("b"), F.col("c")), a=MD, b=method, c=metric) == hit
    assert leaderboard.lookup(MD, method, metric) == hit


def test_lookup_of_papers(spark):
    assert value(spark, leaderboard.find_paper(F.col("a"), F.lit("net")), a=MD) == "2401.12345"
    assert value(spark, leaderboard.find_paper(F.col("a"), F.lit("net")), a="no table") is None


def test_fold_sees_earlier_papers_only(spark):
    rows = [reading("p1", day(0), [entry("B", "s", "SR", ("Net", 50.0, False), ("Net", 90.0, False))]), reading("p2", day(1), [entry("B", "other", "SR", ("Net", 70.0, False), ("Mine", 1.0, True))])]
    board = leaderboard.board_rows(experiments.unnest(spark.createDataFrame(rows, schema("deep_readings"))), F.unix_micros(F.col("created_at").cast("timestamp")))
    assert [(r["arxiv_id"], r["value"], r["existing_value"]) for r in leaderboard.fold(board).collect()] == [("p2", 70.0, 90.0)]


def test_nearest(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8)).round(1)
    v[7] = v[3]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(100, None), (101, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    queries = df.filter("vec_id % 10 = 3")
    w = v.astype(np.float32).astype(float)
    for prior in (False, True):
        got = {(r["query_id"], r["rank"]): r["vec_id"] for r in similarity.nearest(df, queries, 4, prior_only=prior).collect()}
        for q in range(3, 60, 10):
            ids = sorted((i for i in range(60) if i != q and (not prior or i < q)), key=lambda i: (((w[i] - w[q]) ** 2).sum().round(9), i))[:4]
            assert [got[(q, k + 1)] for k in range(len(ids))] == ids
    assert similarity.nearest(df, queries.limit(0)).count() == 0


# --- queries ---------------------------------------------------------------------------------


def test_query_language(spark):
    df = spark.createDataFrame(
        [(1, "Scene graph maps", "memory", ["cs.RO"], ["A B"]), (2, "Graph", None, [" CS.AI "], None), (3, None, "scene graph", None, ["C"])],
        "id int, title string, abstract string, categories array<string>, authors array<string>",
    )
    ids = lambda q: {r[0] for r in df.filter(compile_query(q)).select("id").collect()}
    assert ids('"scene graph"') == {1, 3} and ids("cat:cs.ai OR cat:cs.ro") == {1, 2} and ids("graph ANDNOT scene") == {2}
    assert ids("(ti:graph AND abs:memory) OR au:c") == {1, 3} and ids("NOT scene") == {2} and ids("") == {1, 2, 3} and ids("graph memory") == {1}
    for bad in ("(a", "a OR", "AND", 'cat:""'):
        with pytest.raises(QuerySyntaxError):
            compile_query(bad)
    assert with_categories("q", ["a", "b"]) == "(cat:a OR cat:b) AND (q)" and with_categories("cat:x", ["a"], True) == "cat:x"
