"""Experiment tables: normalised, unnested, nested and grouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions.numbers import to_double
from lorebase.tables import EXPERIMENT_TABLE

#: What a model's reply about experiments looks like; values are read as text first.
REPLY = (
    "struct<experimental_setup:string,main_results:string,entries:array<struct<benchmark:string,setting:string,metric:string,"
    "higher_is_better:boolean,results:array<struct<method:string,value:string,is_paper_method:boolean>>>>,details:string>"
)


def normalise(reply: Column, arxiv_id: Column) -> Column:
    """A parsed reply as an experiment table.

    Results without a number are dropped, entries stay even if none is left; missing method,
    flag, setting and direction get their defaults. No entries: null. An entry without benchmark
    or metric makes the whole table null; ``reply_error`` says so.
    """

    def result(r: Column) -> Column:
        return F.struct(
            F.coalesce(r["method"], F.lit("unknown")).alias("method_name"), to_double(r["value"]).alias("value"),
            F.coalesce(r["is_paper_method"], F.lit(False)).alias("is_paper_method"),
        )

    def entry(e: Column) -> Column:
        results = F.filter(F.transform(F.coalesce(e["results"], F.array()), result), lambda r: r["value"].isNotNull())
        return F.struct(
            e["benchmark"].alias("benchmark"), F.coalesce(e["setting"], F.lit("default")).alias("setting"), e["metric"].alias("metric"),
            F.coalesce(e["higher_is_better"], F.lit(True)).alias("higher_is_better"), results.alias("results"),
        )

    table = F.struct(arxiv_id.alias("arxiv_id"), F.transform(reply["entries"], entry).alias("entries"), F.coalesce(reply["details"], F.lit("")).alias("details"))
    return F.when((F.size(reply["entries"]) > 0) & reply_error(reply).isNull(), table.cast(EXPERIMENT_TABLE))


def reply_error(reply: Column) -> Column:
    bad = F.exists(reply["entries"], lambda e: e["benchmark"].isNull() | e["metric"].isNull())
    return F.when(bad, "an entry lacks benchmark or metric")


def stored_form(table: Column) -> Column:
    """As it reads back: a table without entries is null, its details are lost."""
    return F.when(F.size(table["entries"]) > 0, table)


def unnest(readings: DataFrame) -> DataFrame:
    """One row per result: arxiv_id, seq, entry_pos, result_pos and the fields. Tables, entries
    and results that are null or empty give no row."""
    e = readings.select("arxiv_id", "created_at", F.posexplode("experiment_table.entries").alias("entry_pos", "e"))
    r = e.select("arxiv_id", "created_at", "entry_pos", "e.benchmark", "e.setting", "e.metric", "e.higher_is_better", F.posexplode("e.results").alias("result_pos", "r"))
    return r.select("*", "r.method_name", "r.value", "r.is_paper_method").drop("r")


def nest(results: DataFrame, details: Column | None = None) -> DataFrame:
    """The inverse of unnest, order kept by the positions."""
    fields = ["result_pos", "method_name", "value", "is_paper_method"]
    entry_key = ["arxiv_id", "entry_pos", "benchmark", "setting", "metric", "higher_is_better"]
    entries = results.groupBy(*entry_key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rs"))
    packed = entries.select(
        "arxiv_id",
        F.struct(
            "entry_pos", "benchmark", "setting", "metric", "higher_is_better",
            F.transform("rs", lambda r: F.struct(r["method_name"].alias("method_name"), r["value"].alias("value"), r["is_paper_method"].alias("is_paper_method"))).alias("results"),
        ).alias("e"),
    )
    lists = packed.groupBy("arxiv_id").agg(F.sort_array(F.collect_list("e")).alias("es"))
    bare = F.transform("es", lambda e: F.struct(*[e[c].alias(c) for c in ("benchmark", "setting", "metric", "higher_is_better", "results")]))
    text = F.lit("") if details is None else details
    return lists.select("arxiv_id", F.struct("arxiv_id", bare.alias("entries"), text.alias("details")).cast(EXPERIMENT_TABLE).alias("experiment_table"))


def groups(results: DataFrame) -> DataFrame:
    """One row per (paper, benchmark, setting): its place in the paper, the paper's own methods
    joined by ``|`` in order of name, or ``baselines``, and the audit summary."""
    own = F.when(F.col("is_paper_method"), F.col("method_name"))
    g = results.groupBy("arxiv_id", "benchmark", "setting").agg(
        F.min("entry_pos").alias("group_pos"), F.array_join(F.array_sort(F.collect_set(own)), "|").alias("joined"), F.count(F.lit(1)).alias("n_results")
    )
    methods = F.coalesce(F.nullif(F.col("joined"), F.lit("")), F.lit("baselines"))
    summary = F.concat(methods, F.lit(" on "), F.col("benchmark"), F.lit(" ("), F.col("setting"), F.lit(")"))
    return g.select("arxiv_id", "benchmark", "setting", "group_pos", methods.alias("methods"), "n_results", summary.alias("summary"))


def result_lines(results: DataFrame) -> DataFrame:
    """The results of a group as ``- method: metric↑ = value [paper method]`` lines."""
    sign = F.when(F.col("higher_is_better"), "↑").otherwise("↓")
    tag = F.when(F.col("is_paper_method"), " [paper method]").otherwise("")
    line = F.concat(F.lit("- "), F.col("method_name"), F.lit(": "), F.col("metric"), sign, F.lit(" = "), F.col("value").cast("string"), tag)
    rows = results.groupBy("arxiv_id", "benchmark", "setting").agg(F.array_sort(F.collect_list(F.struct("entry_pos", "result_pos", line.alias("line")))).alias("ls"))
    return rows.select("arxiv_id", "benchmark", "setting", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("lines"))


def benchmarks_of(readings: DataFrame) -> DataFrame:
    """(arxiv_id, benchmarks, method_summary, experimental_setup, main_results): what a reading says
    of its experiments, for whoever asks about one paper. No table gives an empty list."""
    entries = F.coalesce("experiment_table.entries", F.array().cast(dict(readings.select("experiment_table.entries").dtypes)["entries"]))

    def entry(e: Column) -> Column:
        better = F.when(F.coalesce(e["higher_is_better"], F.lit(True)), "higher").otherwise("lower")
        results = F.transform(e["results"], lambda r: F.struct(r["method_name"].alias("method"), r["value"].alias("value"), r["is_paper_method"].alias("is_paper_method")))
        return F.struct(e["benchmark"].alias("benchmark"), e["setting"].alias("setting"), e["metric"].alias("metric"), better.alias("better"), results.alias("results"))

    return readings.select("arxiv_id", F.transform(entries, entry).alias("benchmarks"), F.col("proposed_method").alias("method_summary"), "experimental_setup", "main_results")


def reading_report(readings: DataFrame) -> DataFrame:
    """(arxiv_id, report): a reading as text. Fixed format."""

    def entry(e: Column) -> Column:
        arrow = F.when(F.coalesce(e["higher_is_better"], F.lit(True)), "↑").otherwise("↓")
        line = lambda r: F.concat(F.lit("    "), F.coalesce(r["method_name"], F.lit("None")), F.lit(": "), F.coalesce(r["value"].cast("string"), F.lit("None")), F.when(r["is_paper_method"], " [paper]").otherwise(""))
        head = F.concat(F.lit("  "), F.coalesce(e["benchmark"], F.lit("None")), F.lit(" / "), F.coalesce(e["setting"], F.lit("default")), F.lit(" / "), F.coalesce(e["metric"], F.lit("None")), arrow, F.lit(":"))
        return F.concat_ws("\n", head, F.transform(e["results"], line))

    entries = F.col("experiment_table.entries")
    results = F.when(F.size(entries) > 0, F.concat(F.lit("\nExperiment Results:\n"), F.array_join(F.transform(entries, entry), "\n")))
    listed = F.concat_ws("\n", F.lit("\nKey Contributions:"), F.transform("key_contributions", lambda c: F.concat(F.lit("  - "), c)))
    said = lambda name, c: F.concat(F.lit(f"\n{name}: "), F.coalesce(c, F.lit("")))
    return readings.select("arxiv_id", F.concat_ws(
        "\n", F.concat(F.lit("Paper: "), "arxiv_id"), said("Problem", "problem_statement"), said("Method", "proposed_method"), listed, said("Experimental Setup", "experimental_setup"),
        said("Main Results", "main_results"), said("Limitations", "limitations"), said("Comparison to Prior Work", "comparison_to_prior_work"), results,
    ).alias("report"))


def delta_report(deltas: DataFrame) -> DataFrame:
    """(arxiv_id, report): what is new in a paper, its significance in capitals. Fixed format."""

    def part(name: str, sign: str, c: str) -> Column:
        return F.when(F.size(c) > 0, F.concat_ws("\n", F.lit(f"{name}:"), F.transform(c, lambda x: F.concat(F.lit(f"  {sign} "), x))))

    return deltas.select("arxiv_id", F.concat_ws(
        "\n", F.concat(F.lit("Contribution Analysis: "), F.upper("overall_significance")), part("Novel", "+", "novel_contributions"),
        part("Incremental", "~", "incremental_improvements"), part("Contradicts prior work", "!", "contradicts_prior"),
    ).alias("report"))
