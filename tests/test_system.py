"""Sources, sinks, providers, stages, streams and the command line, end to end."""

import json
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lorebase import cli
from lorebase.plans import pipeline, providers
from lorebase.plans.catalogue import all_queries
from lorebase.session import rows_at_most, shared_dir, stage
from lorebase.sources import bundle, config, files
from lorebase.streaming import incremental
from lorebase.tables import empty, migrate, schema, violations

DATA = "/root/testdata/sf0.001"
NOW = datetime(2024, 1, 31, 1, 2, 3, 456789)


YAML = """# a comment
topics:
- name: Maps & Memory
  query: (cat:cs.RO) AND ("scene graph"
    OR "memory")
  categories:
  - cs.RO
  - cs.AI
  research_profile: Long text that
    goes on here.
- name: Other
  query: x
scraper:
  max_results_per_topic: 20
filter:
  relevance_threshold: 7
sota_dir: boards
"""


@pytest.mark.parametrize("library", [True, False])
def test_config(tmp_path, monkeypatch, library):
    if not library:
        monkeypatch.setitem(sys.modules, "yaml", None)
    p = tmp_path / "c.yaml"
    p.write_text(YAML)
    monkeypatch.setenv("LOREBASE_API_KEY", "k")
    c = config.load_config(str(p))
    assert [t.name for t in c.topics] == ["Maps & Memory", "Other"]
    assert c.topics[0].categories == ["cs.RO", "cs.AI"] and c.topics[0].query.endswith('OR "memory")') and "here." in c.topics[0].research_profile
    assert (c.scraper.max_results_per_topic, c.scraper.days_lookback, c.filter.relevance_threshold, c.sota_dir, c.llm.api_key) == (20, 7, 7, "boards", "k")
    assert config.load_config(str(tmp_path / "none.yaml")).filter.relevance_threshold == 6
    config.save_onboarding(str(p), "It's me", [{"name": "N", "query": "q", "categories": ["cs.RO"]}], 3)
    again = config.load_config(str(p))
    assert again.topics[0].query == "(cat:cs.RO) AND (q)" and again.topics[0].research_profile == "It's me"
    assert again.filter.borderline_min == 2 and again.scraper.max_results_per_topic == 20


def test_files(spark, tmp_path):
    (tmp_path / "a_1.pdf").write_bytes(b"p1\x0cp2\x0cp3")
    (tmp_path / "b_2.pdf").write_bytes(b"!")
    papers = spark.createDataFrame([("a/1", "u"), ("a/1", "u"), ("c.3", "v"), ("d", None)], "arxiv_id string, pdf_url string")
    stored = files.stored_files(spark, str(tmp_path))
    assert [tuple(r) for r in files.to_fetch(papers, stored).collect()] == [("c.3", "v", "c_3.pdf")]

    def pages(raw):
        if raw == b"!":
            raise ValueError("empty")
        return raw.decode().split("\x0c")

    got = {r["path"]: (r["text"], r["error"]) for r in files.extract(stored, pages, 2).collect()}
    assert got == {"a_1.pdf": ("p1\np2", None), "b_2.pdf": (None, "ValueError: empty")}
    html = "<html><script>x<y</script><h1>A &amp; B</h1><p>c<br>d &lt;e&gt;</p><!-- no --></html>"
    assert spark.createDataFrame([(html,)], "h string").select(files.html_text(F.col("h"))).first()[0] == "A & B\nc\nd <e>"
    n = files.write_boards(spark.createDataFrame([("b", "# B\n"), ("a", "# A\n")], "slug string, markdown string"), str(tmp_path / "boards"))
    assert n == 2 and [tuple(r) for r in files.boards(spark, str(tmp_path / "boards")).collect()] == [("a", "# A\n"), ("b", "# B\n")]
    for bad in ("../x.md", "a/b.md", "x.txt", ""):
        with pytest.raises(ValueError):
            files.valid_name(bad)
    page = files.baselines_page(spark.createDataFrame([(1, "N", None, None), (0, None, "p", "w")], "pos int, name string, paper string, note string")).first()[0]
    assert page.startswith("# Classic Baselines\n\n## Unknown") and "N/A" in page


def sample(spark):
    papers = spark.createDataFrame([("a", "A", None, ["x"], None, None, None, "t", NOW), ("b", None, "abs", None, "u", NOW, ["c"], None, NOW)], schema("papers"))
    reading = ("a", "p", "m", [], "s", "r", "l", "c", ("a", [("B", "s", "SR", True, [("n", 1.5, None)])], None), NOW)
    return {
        "papers": papers, "relevance_verdicts": spark.createDataFrame([("a", 7, "j", ["k", None], None)], schema("relevance_verdicts")),
        "deep_readings": spark.createDataFrame([reading], schema("deep_readings")), "contribution_deltas": empty(spark, "contribution_deltas"),
        "sota_updates": spark.createDataFrame([(1, "a", "B", "new_entry", "s", NOW)], schema("sota_updates")),
    }


def test_bundle_round_trip(spark, tmp_path):
    tables = sample(spark)
    out = str(tmp_path / "bundle")
    Path(out).mkdir()
    bundle.export_bundle(tables, out, NOW, {"filter": {}}, {"b.md": "# B", "classic_baselines.md": "C"})
    back, counts = bundle.import_bundle(spark, out, tables, False, str(tmp_path / "boards"))
    assert counts == {"papers": 2, "relevance_verdicts": 1, "deep_readings": 1, "contribution_deltas": 0, "sota_files": 2}
    for t in bundle.TABLES:
        assert sorted(map(str, back[t].select(*tables[t].columns).collect())) == sorted(map(str, tables[t].collect()))
    assert back["sota_updates"].count() == 0 and (tmp_path / "boards" / "classic_baselines.md").read_text() == "C"
    merged, _ = bundle.import_bundle(spark, out, tables, True)
    assert merged["papers"].count() == 2 and merged["sota_updates"].count() == 1
    doc = json.loads(bundle.one_document(tables, NOW).first()[0])
    assert doc["version"] == 1 and doc["papers"][0]["abstract"] is None
    m = json.loads(Path(out, "manifest.json").read_text())
    Path(out, "manifest.json").write_text(json.dumps(m | {"version": 2}))
    with pytest.raises(ValueError):
        bundle.read_bundle(spark, out)


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([("a", 1)], "arxiv_id string, extracted_benchmarks int")
    assert migrate("deep_readings", old).columns == ["arxiv_id", "experiment_table"]
    rows = spark.createDataFrame([("a",), ("a",), (None,)], "arxiv_id string")
    assert {r["rule"]: r["n"] for r in violations(rows, "papers").collect()} == {"null_key": 1, "repeated_key": 1}
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    bundle.write_table(spark.read.parquet(path).filter("id > 0"), path)
    assert spark.read.parquet(path).count() == 2
    assert stage(spark.range(5)).count() == 5 and shared_dir(spark) and rows_at_most(spark.range(5), 5) and not rows_at_most(spark.range(6), 5)


def test_providers(spark):
    asked = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", "none")], "request_key string, prompt string")

    def ask(prompt):
        if prompt == "bad":
            raise RuntimeError("down")
        return '{"score":"8","justification":"j"}' if prompt == "good" else '{"score":"high","justification":"j"}'

    out = {r["request_key"]: (r["score"], r["error"]) for r in providers.parse_verdicts(providers.remote(asked, ask, waits=(0.0,))).collect()}
    assert out == {"1": (8, None), "2": (None, "RuntimeError: down"), "3": (None, "score is no whole number")}
    recorded = spark.createDataFrame([("1", '{"justification":"j"}')], "request_key string, reply string")
    again = {r["request_key"]: r["error"] for r in providers.parse_verdicts(providers.replay(asked, recorded)).collect()}
    assert again == {"1": "score is missing", "2": "no reply", "3": "no reply"}
    assert providers.without_known(asked, recorded).count() == 2
    d = providers.parse_deltas(spark.createDataFrame([('{"novel_contributions":["x"]}',)], "reply string")).first()
    assert d["overall_significance"] == "marginal" and d["contradicts_prior"] == []


def as_of():
    return F.lit("2024-01-31").cast("timestamp_ntz")


def fake(replies):
    """A provider that answers by what the prompt holds."""

    def ask(requests):
        reply = F.lit(None).cast("string")
        for needle, text in replies.items():
            reply = F.when(F.contains(F.col("prompt"), F.lit(needle)), F.lit(text)).otherwise(reply)
        return requests.withColumn("reply", reply).withColumn("error", F.when(F.col("reply").isNull(), "no reply"))

    return ask


def test_pipeline(spark):
    tables = {t: empty(spark, t) for t in ("papers", "relevance_verdicts", "deep_readings", "contribution_deltas", "sota_updates", "leaderboard")}
    tables["topics"] = spark.createDataFrame([("t", "q", ["cs.RO"], "profile")], schema("topics"))
    feed = spark.createDataFrame(
        [("a", "A", "x", ["n"], None, datetime(2024, 1, 30), None, "t", None, 0), ("b", "B", "x", ["n"], None, datetime(2024, 1, 29), None, "t", None, 0), ("old", "O", "x", [], None, datetime(2023, 1, 1), None, "t", None, 0)],
        "arxiv_id string, title string, abstract string, authors array<string>, pdf_url string, published timestamp_ntz, categories array<string>, source_topic string, created_at timestamp_ntz, topic_pos int",
    )
    settings = pipeline.Settings()
    tables = pipeline.crawl_stage(tables, feed, as_of(), settings)
    assert {r[0] for r in tables["papers"].select("arxiv_id").collect()} == {"a", "b"}
    tables, errors = pipeline.filter_stage(tables, fake({"Title: A": '{"score":9,"justification":"j","key_topics":["k"]}'}), as_of(), settings)
    assert [tuple(r) for r in errors.collect()] == [("b", "no reply")]
    tables = {k: stage(v) for k, v in tables.items()}
    texts = spark.createDataFrame([("a", "Introduction\nfoo\nResults\nbar\nConclusion\nend")], "arxiv_id string, text string")
    reader = fake({
        "(method_intro)": '{"problem_statement":"p","proposed_method":"m","key_contributions":["c"]}',
        "(experiments)": '{"experimental_setup":"s","main_results":"r","entries":[{"benchmark":"B","metric":"SR","results":[{"method":"Net","value":"5","is_paper_method":true}]}]}',
        "(context)": '{"comparison_to_prior_work":"w","limitations":"l"}',
    })
    tables, errors = pipeline.read_stage(tables, texts, reader, as_of(), settings)
    assert errors.count() == 0 and tables["deep_readings"].first()["proposed_method"] == "m"
    tables = {k: stage(v) for k, v in tables.items()}
    tables, errors = pipeline.analyse_stage(tables, fake({"What is new": '{"novel_contributions":["n"],"overall_significance":"major"}'}), as_of(), settings, 1)
    assert tables["contribution_deltas"].first()["overall_significance"] == "major"
    assert [tuple(r)[1:5] for r in tables["sota_updates"].collect()] == [("a", "B", "new_entry", "Net on B (default)")]
    assert tables["leaderboard"].first()["value"] == 5.0 and tables["kb_documents"].count() == 3
    bad, failed = pipeline.read_stage(tables, texts, fake({"(context)": "{}"}), as_of(), settings, spark.createDataFrame([("a",), ("z",)], "arxiv_id string"))
    assert {r[0]: r[1] for r in failed.collect()}["z"] == "no text"


def test_streaming(spark, tmp_path):
    papers = spark.createDataFrame([("a", "A", None, None, None, None, None, "t", datetime(2024, 1, d)) for d in (1, 2)] + [("b", "B", None, None, None, None, None, "t", datetime(2024, 1, 3))], schema("papers"))
    papers.write.parquet(str(tmp_path / "in"))
    seen = []
    q = incremental.run_stage(incremental.first_seen(incremental.landed(spark, str(tmp_path / "in"), "papers")), lambda df, n: seen.extend(r["arxiv_id"] for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(seen) == ["a", "b"]
    refs = spark.createDataFrame([("a", 5, "j", [], datetime(2024, 1, 9)), ("zz", 5, "j", [], None)], schema("relevance_verdicts"))
    refs.write.parquet(str(tmp_path / "v"))
    gone = spark.createDataFrame([], "arxiv_id string")
    q = incremental.orphans_on_arrival(spark, str(tmp_path / "v"), "relevance_verdicts", lambda: papers, lambda: gone, str(tmp_path / "out"), str(tmp_path / "ck2"))
    q.awaitTermination(120)
    assert [r["arxiv_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["zz"]
    counts = incremental.windowed_counts(incremental.landed(spark, str(tmp_path / "in"), "papers"), "created_at", "source_topic")
    assert counts.isStreaming and counts.columns == ["start", "source_topic", "n"]


def test_command_line(spark, tmp_path, capsys):
    data = tmp_path / "data"
    data.mkdir()
    for t, df in sample(spark).items():
        df.write.parquet(str(data / f"{t}.parquet"))
    base = ["-c", str(tmp_path / "c.yaml"), "-d", str(data), "--as-of", "2024-01-31T00:00:00"]
    (tmp_path / "c.yaml").write_text(f"sota_dir: {tmp_path}/boards\n")
    assert cli.main([*base, "stats"], spark) == 0 and "papers: 2" in capsys.readouterr().out
    assert cli.main([*base, "export", str(tmp_path / "out")], spark) == 0
    assert cli.main([*base, "import", str(tmp_path / "out"), "--merge"], spark) == 0
    assert cli.main([*base, "sota"], spark) == 0
    assert cli.main([*base, "read", "unknown"], spark) == 1
    assert cli.main([*base, "pipeline"], spark) == 0
    assert cli.main([*base, "onboard", "--profile", "me", "--topic", "T", "q", "cs.RO"], spark) == 0
    assert config.load_config(str(tmp_path / "c.yaml")).topics[0].name == "T"


def test_every_query_has_a_stable_schema(spark):
    queries, sql = all_queries()
    assert set(sql) <= set(queries) and "gate_unfiltered_newest" in queries
    for name in ("gate_unfiltered_newest", "p1_found", "p1_report", "stats_counts"):
        df = queries[name](spark, DATA)
        assert df.columns and df.count() >= 0


def test_core_imports_nothing_for_training_data():
    root = Path(__file__).resolve().parents[1] / "lorebase"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "lorebase.llm" not in p.read_text(), p


def test_the_pipeline_saves_the_knowledge_documents(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    spark.createDataFrame([("a", "A", None, [], None, None, [], None, datetime(2024, 1, 1))], schema("papers")).write.parquet(str(data / "papers.parquet"))
    spark.createDataFrame([("a", "p", "m", ["c"], "s", "r", "l", "w", None, datetime(2024, 1, 2))], schema("deep_readings")).write.parquet(str(data / "deep_readings.parquet"))
    old = [("paper_methods", "a", [1.0], "Paper: A\nMethod: m", ("a", "A")), ("research_context", "a", [2.0], "Paper: A\nContext: before", ("a", "A")), ("paper_methods", "z", [3.0], "d", ("z", "Z"))]
    spark.createDataFrame(old, schema("kb")).write.parquet(str(data / "kb.parquet"))
    (tmp_path / "c.yaml").write_text(f"sota_dir: {tmp_path}/boards\n")
    for _ in range(2):
        assert cli.main(["-c", str(tmp_path / "c.yaml"), "-d", str(data), "--as-of", "2024-01-31T00:00:00", "pipeline"], spark) == 0
        got = {(r["collection"], r["id"]): (r["document"], r["embedding"]) for r in spark.read.parquet(str(data / "kb.parquet")).collect()}
        assert got == {
            ("paper_contributions", "a"): ("Paper: A\nContributions:\n- c", None), ("paper_methods", "a"): ("Paper: A\nMethod: m", [1.0]),
            ("research_context", "a"): ("Paper: A\nContext: w", None), ("paper_methods", "z"): ("d", [3.0]),
        }
