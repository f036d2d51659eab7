"""Model-backed steps behind one interface.

A request is a row with ``prompt`` and ``request_key``; a provider turns a frame of requests into
the same frame with ``reply`` and ``error``. Replies are texts; the parsers below turn them into
columns and failures into errors, never into lost rows. Since Spark may run Python twice, a
provider's output is staged before anything reads it (``asked_once``), and a reply is known by
its request's key: a hash of prompt, model and temperature.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions.numbers import to_score
from lorebase.operators.gates import with_topic
from lorebase.session import stage

VERDICT = "struct<score:string,justification:string,key_topics:array<string>>"
DELTA = "struct<novel_contributions:array<string>,incremental_improvements:array<string>,contradicts_prior:array<string>,overall_significance:string>"
BOUNDS = "array<struct<name:string,start_line:int,end_line:int>>"
#: Keys of the three reading passes' replies without which a reading fails. Fixed values.
REQUIRED = ("problem_statement", "proposed_method", "experimental_setup", "main_results", "limitations", "comparison_to_prior_work")

#: At most so many requests at once in one task, attempts at each, and seconds before the next.
IN_FLIGHT, ATTEMPTS, WAITS = 5, 3, (1.0, 2.0)


def request_key(prompt: Column, model: str, temperature: float) -> Column:
    return F.sha2(F.concat_ws("\x1f", prompt, F.lit(model), F.lit(str(temperature))), 256)


def replay(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Replies out of a table (request_key, reply); a request without one gets an error."""
    one = recorded.groupBy("request_key").agg(F.max("reply").alias("reply"))
    return requests.join(one, "request_key", "left").withColumn("error", F.when(F.col("reply").isNull(), "no reply"))


def remote(requests: DataFrame, ask: Callable[[str], str], in_flight: int = IN_FLIGHT, waits: tuple[float, ...] = WAITS) -> DataFrame:
    """Replies from a service: a few threads a task, each request tried again after growing waits.

    ``ask`` must be picklable and raise on failure; its last error becomes the row's error.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in requests.dtypes) + ", reply string, error string"

    def one(prompt: str) -> tuple[str | None, str | None]:
        error = None
        for i in range(len(waits) + 1):
            try:
                return ask(prompt), None
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
                if i < len(waits):
                    time.sleep(waits[i])
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for b in batches:
                got = list(pool.map(one, b["prompt"]))
                yield b.assign(reply=[g[0] for g in got], error=[g[1] for g in got])

    return requests.mapInPandas(run, schema)


def replay_vectors(texts: DataFrame, recorded: DataFrame) -> DataFrame:
    """texts (text, ...) with their ``embedding`` out of a table (text_key, embedding), null where
    there is none. The provider of embeddings that a run can be repeated with."""
    one = recorded.groupBy("text_key").agg(F.max("embedding").alias("embedding"))
    return texts.withColumn("text_key", F.sha2("text", 256)).join(one, "text_key", "left").drop("text_key")


def remote_vectors(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 64, waits: tuple[float, ...] = WAITS) -> DataFrame:
    """texts (text, ...) with their ``embedding`` from a service that takes lists of texts; tried
    again after growing waits. A batch that fails to the end has null vectors and is asked for in
    the next run. ``embed`` must be picklable."""
    schema = ", ".join(f"`{n}` {t}" for n, t in texts.dtypes) + ", embedding array<float>"

    def ask(part: list[str]) -> list[list[float] | None]:
        for i in range(len(waits) + 1):
            try:
                return list(embed(part))
            except Exception:  # noqa: BLE001
                if i < len(waits):
                    time.sleep(waits[i])
        return [None] * len(part)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors: list[list[float] | None] = []
            for a in range(0, len(b), batch):
                vectors += ask([str(t) for t in b["text"][a : a + batch]])
            yield b.assign(embedding=vectors)

    return texts.mapInPandas(run, schema)


def asked_once(replies: DataFrame) -> DataFrame:
    return stage(replies, "replies")


def without_known(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Requests that have not been answered yet."""
    return requests.join(recorded.select("request_key"), "request_key", "left_anti")


def parse_verdicts(replies: DataFrame) -> DataFrame:
    """score, justification, key_topics; a missing or unreadable score or justification is an error."""
    r = F.from_json("reply", VERDICT)
    parsed = replies.withColumn("_r", r).withColumns({"score": to_score(F.col("_r.score")), "justification": F.col("_r.justification"), "key_topics": F.coalesce(F.col("_r.key_topics"), F.array())})
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("_r.score").isNull(), "score is missing")
        .when(F.col("score").isNull(), "score is no whole number")
        .when(F.col("justification").isNull(), "justification is missing")
    )
    out = parsed.withColumn("error", error)
    return out.withColumn("score", F.when(F.col("error").isNull(), F.col("score"))).drop("_r")


def parse_deltas(replies: DataFrame) -> DataFrame:
    """The four fields of a contribution analysis; what is missing gets its default."""
    r = F.from_json("reply", DELTA)
    lists = {c: F.coalesce(r[c], F.array().cast("array<string>")) for c in ("novel_contributions", "incremental_improvements", "contradicts_prior")}
    return replies.withColumns({**lists, "overall_significance": F.coalesce(r["overall_significance"], F.lit("marginal"))})


CAUSES = "struct<analyses:array<struct<method:string,metric:string,explanation:string,cause:string,recommendation:string>>>"


def parse_causes(reply: Column) -> Column:
    """Notes on the causes of conflicts, a line each; null where the reply holds none. Fixed format."""
    note = lambda a: F.concat(
        F.lit("> ⚠ "), a["method"], F.lit("/"), a["metric"], F.lit(": "), a["explanation"], F.lit(" (cause: "), a["cause"], F.lit(", action: "), a["recommendation"], F.lit(")")
    )
    notes = F.filter(F.transform(F.from_json(reply, CAUSES)["analyses"], note), lambda n: n.isNotNull())
    return F.when(F.size(notes) > 0, F.array_join(notes, "\n"))


def missing_keys(fields: dict[str, Column]) -> Column:
    """An error that names the first required field that is null."""
    out = F.lit(None).cast("string")
    for name in reversed(REQUIRED):
        out = F.when(fields[name].isNull(), F.lit(f"{name} is missing")).otherwise(out)
    return out


def judge_prompt(profile: Column, title: Column, abstract: Column) -> Column:
    return F.concat(
        F.lit("Rate from 0 to 10 how relevant the paper is to this profile.\n\nProfile:\n"), profile, F.lit("\n\nTitle: "), F.coalesce(title, F.lit("")),
        F.lit("\n\nAbstract:\n"), F.coalesce(abstract, F.lit("")), F.lit("\n\nAnswer in JSON with score, justification and key_topics."),
    )


def rule_scores(papers: DataFrame, topics: DataFrame) -> DataFrame:
    """A deterministic judge: 4 for a shared category, 3 for each of the topic's words in the
    title, 1 for each in the abstract, 10 at most."""
    cats = topics.groupBy("name").agg(F.max("categories").alias("_cats"))
    both = with_topic(papers, topics).join(cats, F.col("source_topic") == F.col("name"))
    clean = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    words = F.split(F.lower("source_topic"), " ")
    title, abstract = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("abstract", F.lit("")))
    points = (
        4 * F.arrays_overlap(clean("categories"), clean("_cats")).cast("int")
        + 3 * F.size(F.filter(words, lambda w: F.contains(title, w)))
        + F.size(F.filter(words, lambda w: F.contains(abstract, w)))
    )
    return both.withColumn("score", F.least(F.lit(10), points).cast("int")).drop("name", "_cats")
