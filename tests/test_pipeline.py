"""The wired pipeline: boundaries, neighbours, vectors, conflicts, boards, run ledger, and stores that must not be lost."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorebase import cli
from lorebase.operators import experiments, knowledge
from lorebase.plans import pipeline, providers
from lorebase.session import stage, staged
from lorebase.sources import bundle, files, storage
from lorebase.tables import empty, schema

TABLES = ("papers", "relevance_verdicts", "deep_readings", "contribution_deltas", "sota_updates", "leaderboard", "kb", "pipeline_runs")


def at():
    return F.lit("2024-01-31").cast("timestamp_ntz")


def fake(replies, seen=None):
    """A provider that answers by what the prompt holds, the first needle first."""

    def ask(requests):
        reply = F.lit(None).cast("string")
        for needle, text in reversed(replies.items()):
            reply = F.when(F.contains(F.col("prompt"), F.lit(needle)), F.lit(text)).otherwise(reply)
        out = requests.withColumn("reply", reply).withColumn("error", F.when(F.col("reply").isNull(), "no reply"))
        if seen is not None:
            seen.extend(r["prompt"] for r in out.select("prompt").collect())
        return out

    return ask


def embed(texts):
    """Vectors by letters: texts with as many a, e and o are near."""
    count = lambda c: F.size(F.split(F.col("text"), c)).cast("float")
    return texts.withColumn("embedding", F.array(count("a"), count("e"), count("o")))


def reading(i, method, value, day, text="x"):
    results = [("Net", value, False), (method, value, True)]
    return (i, f"problem {text}", f"method {text}", [f"contribution {i}"], "s", "main", "l", f"context {i}", (i, [("Bench", "val", "SR", True, results)], "details"), datetime(2024, 1, day))


@pytest.fixture
def tables(spark):
    out = {t: empty(spark, t) for t in TABLES}
    out["papers"] = spark.createDataFrame([(i, f"Title {i}", "abs", [], None, None, [], "t", datetime(2024, 1, 1)) for i in "abc"], schema("papers"))
    out["deep_readings"] = spark.createDataFrame([reading("a", "A-Net", 50.0, 2), reading("b", "B-Net", 60.0, 3), reading("c", "C-Net", 60.5, 4)], schema("deep_readings"))
    return out


def test_analysis_sees_what_came_before(spark, tables):
    seen = []
    causes = json.dumps({"analyses": [{"method": "Net", "metric": "SR", "explanation": "other split", "cause": "setting", "recommendation": "keep both"}]})
    analyst = fake({"Why do these": causes, "What is new": '{"novel_contributions":["n"]}'}, seen)
    out, errors = pipeline.analyse_stage(tables, analyst, at(), pipeline.Settings(), 7, embed)
    assert errors.count() == 0 and out["contribution_deltas"].count() == 3
    asked = {p.split("Title ")[1][0]: p for p in seen if "What is new" in p}
    assert "No related work is stored yet." in asked["a"]
    assert "contribution a" in asked["b"].split("Known:")[1] and "contribution c" not in asked["b"].split("Known:")[1]
    assert {x for x in "abc" if f"contribution {x}" in asked["c"].split("Known:")[1]} == {"a", "b"}
    kb = out["kb"].collect()
    assert len(kb) == 9 and all(r["embedding"] is not None for r in kb) and {r["collection"] for r in kb} == set(knowledge.COLLECTIONS)
    notes = [tuple(r) for r in out["conflict_notes"].collect()]
    assert notes == [("b", "bench", "val", "> ⚠ Net/SR: other split (cause: setting, action: keep both)")]
    pages = {r["slug"]: r["markdown"] for r in out["board_pages"].collect()}
    assert set(pages) == {"bench"} and "| C-Net | 60.5 | c |" in pages["bench"]
    actions = {r["arxiv_id"]: r["action"] for r in out["sota_updates"].collect()}
    assert actions == {"a": "new_entry", "b": "conflict_resolved", "c": "updated"}


def test_a_second_run_sees_the_stored_ones(spark, tables):
    analyst = fake({"What is new": "{}"})
    first, _ = pipeline.analyse_stage({**tables, "deep_readings": tables["deep_readings"].filter("arxiv_id = 'a'")}, analyst, at(), pipeline.Settings(), 1, embed)
    held = {t: stage(first[t]) for t in TABLES}
    seen = []
    second, _ = pipeline.analyse_stage({**held, "deep_readings": tables["deep_readings"]}, fake({"What is new": "{}"}, seen), at(), pipeline.Settings(), 2, embed)
    asked = {p.split("Title ")[1][0]: p for p in seen if "What is new" in p}
    assert set(asked) == {"b", "c"} and "contribution a" in asked["b"].split("Known:")[1]
    notes = [r["notes"] for r in second["conflict_notes"].collect()]
    assert notes == ["> ⚠ Net/SR: paper reports 60.0, existing shows 50.0 (from a). Cause unknown."]
    assert second["kb"].count() == 9 and second["sota_updates"].select("id").distinct().count() == 3


def test_boundaries_and_their_fallback(spark):
    texts = spark.createDataFrame([("a", "x one\ny two\nz three"), ("b", "Introduction\nfoo\nConclusion\nend"), ("c", "q\nr")], "arxiv_id string, text string")
    told = fake({"x one": '[{"name":"Introduction","start_line":1,"end_line":2},{"name":"other","start_line":3,"end_line":3}]', "q\n": '[{"name":"nothing","start_line":1,"end_line":1}]'})
    got = {r["arxiv_id"]: [(s["name"], s["body"]) for s in r["sections"]] for r in pipeline.with_bounds(texts, told, pipeline.Settings()).collect()}
    assert got["a"] == [("introduction", "x one\ny two")]
    plain = {r["arxiv_id"]: [(s["name"], s["body"]) for s in r["sections"]] for r in pipeline.with_sections(texts).collect()}
    assert got["b"] == plain["b"] and got["c"] == plain["c"]


def test_vectors(spark):
    texts = spark.createDataFrame([("1", "aa"), ("2", "bad"), ("3", "c")], "id string, text string")

    def service(part):
        if "bad" in part:
            raise RuntimeError("down")
        return [[float(len(t))] for t in part]

    got = {r["id"]: r["embedding"] for r in providers.remote_vectors(texts, service, 1, waits=(0.0,)).collect()}
    assert got == {"1": [2.0], "2": None, "3": [1.0]}
    recorded = spark.createDataFrame([("aa",)], "t string").select(F.sha2("t", 256).alias("text_key"), F.array(F.lit(5.0).cast("float")).alias("embedding"))
    assert {r["id"]: r["embedding"] for r in providers.replay_vectors(texts, recorded).collect()} == {"1": [5.0], "2": None, "3": None}


def test_reports(spark, tables):
    r = experiments.reading_report(tables["deep_readings"].filter("arxiv_id = 'a'")).first()["report"]
    assert "Problem: problem x" in r and "  - contribution a" in r and "  Bench / val / SR↑:\n    Net: 50.0\n    A-Net: 50.0 [paper]" in r
    d = spark.createDataFrame([("a", ["n"], [], ["z"], "major", None)], schema("contribution_deltas"))
    assert experiments.delta_report(d).first()["report"] == "Contribution Analysis: MAJOR\nNovel:\n  + n\nContradicts prior work:\n  ! z"
    b = experiments.benchmarks_of(tables["deep_readings"].filter("arxiv_id = 'a'")).first()
    assert b["benchmarks"][0]["better"] == "higher" and b["benchmarks"][0]["results"][1]["is_paper_method"] and b["method_summary"] == "method x"


def command(tmp_path, *more):
    (tmp_path / "c.yaml").write_text(f"sota_dir: {tmp_path}/boards\n")
    return ["-c", str(tmp_path / "c.yaml"), "--as-of", "2024-01-31T00:00:00", "-d", *more]


@pytest.mark.parametrize("scheme", ["", "file:"])
def test_command_line_end_to_end(spark, tables, tmp_path, capsys, scheme):
    data = f"{scheme}{tmp_path}/data"
    for t in ("papers", "deep_readings"):
        tables[t].write.parquet(f"{data}/{t}.parquet")
    assert cli.main(command(tmp_path, data, "pipeline"), spark) == 0
    runs = spark.read.parquet(f"{data}/pipeline_runs.parquet").collect()
    assert [(r["id"], r["status"], r["papers_read"]) for r in runs] == [(1, "completed", 0)]
    assert spark.read.parquet(f"{data}/kb.parquet").count() == 9 and spark.read.parquet(f"{data}/papers.parquet").count() == 3
    capsys.readouterr()
    assert cli.main(command(tmp_path, data, "sota"), spark) == 0 and "| C-Net | 60.5 | c |" in capsys.readouterr().out
    assert cli.main(command(tmp_path, data, "stats"), spark) == 0 and "papers: 3" in capsys.readouterr().out
    assert cli.main(command(tmp_path, data, "export", f"{scheme}{tmp_path}/out"), spark) == 0
    assert cli.main(command(tmp_path, f"{scheme}{tmp_path}/copy", "import", f"{scheme}{tmp_path}/out"), spark) == 0
    assert spark.read.parquet(f"{scheme}{tmp_path}/copy/papers.parquet").count() == 3


def test_a_wrong_address_is_no_empty_store(spark, tables, tmp_path):
    for c in ("stats", "sota", "filter"):
        with pytest.raises(FileNotFoundError):
            cli.main(command(tmp_path, f"file:{tmp_path}/nowhere", c), spark)
    out = f"file:{tmp_path}/bundle"
    bundle.export_bundle({"papers": tables["papers"], "deep_readings": tables["deep_readings"]}, out, datetime(2024, 1, 1))
    storage.delete(spark, f"{out}/papers")
    with pytest.raises(FileNotFoundError, match="papers"):
        bundle.read_bundle(spark, out)


def test_a_failed_run_is_told(spark, tables, tmp_path, monkeypatch):
    tables["papers"].write.parquet(str(tmp_path / "data" / "papers.parquet"))
    monkeypatch.setattr(pipeline, "filter_stage", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        cli.main(command(tmp_path, str(tmp_path / "data"), "pipeline"), spark)
    assert spark.read.parquet(str(tmp_path / "data" / "pipeline_runs.parquet")).first()["status"] == "failed"


def test_a_crash_between_the_moves_loses_nothing(spark, tmp_path):
    path = f"file:{tmp_path}/t.parquet"
    spark.range(3).write.parquet(path)
    storage.rename(spark, path, f"{path}.old")
    storage.recover(spark, path)
    assert spark.read.parquet(path).count() == 3 and not storage.exists(spark, f"{path}.old")
    storage.replace_tables({path: spark.read.parquet(path).filter("id > 0")})
    assert spark.read.parquet(path).count() == 2 and storage.names(spark, f"file:{tmp_path}", ".parquet") == ["t.parquet"]


def test_files_with_an_extractor(spark, tmp_path):
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "a_1.pdf").write_bytes(b"p1\x0cp2")
    a = cli.parser().parse_args(["--files", str(tmp_path / "pdf"), "--extractor", "tests.test_pipeline:pages", "filter"])
    papers = spark.createDataFrame([("a.1",), ("b",)], "arxiv_id string")
    assert a.files and files.safe_id(F.lit("a.1")) is not None
    assert [tuple(r) for r in cli.texts_of(spark, a, {"papers": papers}).collect()] == [("a.1", "p1\np2")]


def pages(raw):
    return raw.decode().split("\x0c")


def test_staged_data_is_deleted(spark):
    with staged(spark):
        df = stage(spark.range(3))
        path = df.inputFiles()[0].rsplit("/", 1)[0]
        assert storage.exists(spark, path)
    assert not storage.exists(spark, path)
