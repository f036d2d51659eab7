"""The pipeline's stages as functions from tables to tables.

Each stage derives its input from what is stored, by an anti-join, so it can be run again after
any failure; what failed stays open. ``as_of`` is always given, never read from the clock.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions.text import bulleted, numbered_lines
from lorebase.operators import crawl, experiments, gates, knowledge, leaderboard, similarity, upsert
from lorebase.operators.sections import section_map, sections_from_bounds, text_for_pass, with_sections
from lorebase.plans import providers
from lorebase.session import stage

Provider = Callable[[DataFrame], DataFrame]
Tables = dict[str, DataFrame]
PASSES = ("method_intro", "experiments", "context")
#: Characters of a pass's text that go to the model; cut before the provider.
PASS_CHARS = 30_000


@dataclass
class Settings:
    per_topic: int = 50
    lookback_days: int = 7
    threshold: int = gates.THRESHOLD
    neighbours: int = 5
    model: str = "large"
    temperature: float = 0.3


def crawl_stage(tables: Tables, feed: DataFrame, as_of: Column, settings: Settings) -> Tables:
    """feed: papers with topic_pos. Newest per topic, one row per id, upserted."""
    newest = crawl.newest_per_topic(feed, settings.per_topic, as_of, settings.lookback_days)
    once = crawl.keep_first(newest, F.col("topic_pos"), [F.col("rank")]).drop("topic_pos", "rank")
    return {**tables, "papers": upsert.upsert_papers(tables["papers"], once.withColumn("created_at", as_of))}


def filter_stage(tables: Tables, judge: Provider, as_of: Column, settings: Settings) -> tuple[Tables, DataFrame]:
    """Judges papers without a verdict whose topic has a profile. Returns the errors too; such
    papers stay unfiltered."""
    open_ = gates.with_topic(gates.unfiltered(tables["papers"], tables["relevance_verdicts"]), tables["topics"])
    prompt = providers.judge_prompt(F.col("research_profile"), F.col("title"), F.col("abstract"))
    asked = open_.select("arxiv_id", prompt.alias("prompt")).withColumn("request_key", providers.request_key(F.col("prompt"), settings.model, settings.temperature))
    judged = providers.parse_verdicts(providers.asked_once(judge(asked)))
    good = judged.filter("error IS NULL").select("arxiv_id", "score", "justification", "key_topics", as_of.alias("created_at"))
    errors = judged.filter("error IS NOT NULL").select("arxiv_id", "error")
    return {**tables, "relevance_verdicts": upsert.upsert_rows(tables["relevance_verdicts"], good)}, errors


def requests_of(rows: DataFrame, prompt: Column, settings: Settings) -> DataFrame:
    """The rows with ``prompt`` and ``request_key``."""
    return rows.withColumn("prompt", prompt).withColumn("request_key", providers.request_key(F.col("prompt"), settings.model, settings.temperature))


def with_bounds(texts: DataFrame, parser: Provider, settings: Settings) -> DataFrame:
    """Texts (arxiv_id, text) with ``sections`` as a model bounds them, or as the headings do
    where it fails or names no section that is known."""
    prompt = F.concat(F.lit("Name the first and last line of each section. Answer in JSON: a list of name, start_line, end_line.\n\n"), numbered_lines(F.col("text")))
    replies = providers.asked_once(parser(requests_of(texts.select("arxiv_id", "text"), prompt, settings)))
    bounds = F.from_json("reply", providers.BOUNDS)
    told = replies.filter("error IS NULL").select("arxiv_id", bounds.alias("bounds"))
    cut = with_sections(texts).join(told, "arxiv_id", "left")
    return cut.withColumn("sections", F.coalesce(sections_from_bounds(F.col("text"), F.col("bounds")), F.col("sections"))).drop("bounds")


def pass_requests(texts: DataFrame, settings: Settings, parser: Provider | None = None) -> DataFrame:
    """Three requests per text (arxiv_id, text): one for each reading pass."""
    bounded = with_sections(texts) if parser is None else with_bounds(texts, parser, settings)
    cut = bounded.withColumn("_map", section_map(F.col("sections"), F.col("text")))
    each = [F.struct(F.lit(p).alias("pass"), F.substring(text_for_pass(F.col("_map"), p), 1, PASS_CHARS).alias("t")) for p in PASSES]
    rows = cut.select("arxiv_id", F.explode(F.array(*each)).alias("r"))
    prompt = F.concat(F.lit("Read this part of a paper and answer in JSON ("), F.col("r.pass"), F.lit("):\n\n"), F.col("r.t"))
    return requests_of(rows.select("arxiv_id", "r.pass", "r"), prompt, settings).drop("r")


def assemble_readings(replies: DataFrame, as_of: Column) -> DataFrame:
    """Readings out of the replies of the three passes (arxiv_id, pass, reply, error); a reading
    with a failed pass or a missing required field has an ``error`` and is not stored."""
    one = replies.groupBy("arxiv_id").agg(
        *[F.max(F.when(F.col("pass") == p, F.col("reply"))).alias(p) for p in PASSES], F.max("error").alias("failed")
    )
    intro = F.from_json("method_intro", "struct<problem_statement:string,proposed_method:string,key_contributions:array<string>>")
    exp = F.from_json("experiments", experiments.REPLY)
    ctx = F.from_json("context", "struct<comparison_to_prior_work:string,limitations:string>")
    p = one.select("arxiv_id", "failed", intro.alias("i"), exp.alias("e"), ctx.alias("c"))
    fields = {
        "problem_statement": F.col("i.problem_statement"), "proposed_method": F.col("i.proposed_method"), "experimental_setup": F.col("e.experimental_setup"),
        "main_results": F.col("e.main_results"), "limitations": F.col("c.limitations"), "comparison_to_prior_work": F.col("c.comparison_to_prior_work"),
    }
    error = F.coalesce("failed", providers.missing_keys(fields), experiments.reply_error(F.col("e")))
    return p.select(
        "arxiv_id", *[c.alias(k) for k, c in fields.items()], F.coalesce("i.key_contributions", F.array().cast("array<string>")).alias("key_contributions"),
        experiments.normalise(F.col("e"), F.col("arxiv_id")).alias("experiment_table"), as_of.alias("created_at"), error.alias("error"),
    )


def read_stage(
    tables: Tables, texts: DataFrame, reader: Provider, as_of: Column, settings: Settings, only: DataFrame | None = None, parser: Provider | None = None
) -> tuple[Tables, DataFrame]:
    """Reads relevant papers that have no reading, or exactly ``only`` (arxiv_id), gate or not.
    With a parser, sections are cut where it bounds them."""
    wanted = only if only is not None else gates.unread_relevant(tables["relevance_verdicts"], tables["deep_readings"], settings.threshold)
    own = gates.by_ids(texts.filter("text IS NOT NULL"), wanted)
    replies = providers.asked_once(reader(pass_requests(own.select("arxiv_id", "text"), settings, parser)))
    made = assemble_readings(replies, as_of)
    good = made.filter("error IS NULL").select(*tables["deep_readings"].columns)
    missing = wanted.select("arxiv_id").distinct().join(own.select("arxiv_id"), "arxiv_id", "left_anti").withColumn("error", F.lit("no text"))
    errors = made.filter("error IS NOT NULL").select("arxiv_id", "error").unionByName(missing)
    return {**tables, "deep_readings": upsert.upsert_rows(tables["deep_readings"], good)}, errors


def neighbours_of(fresh: DataFrame, titles: DataFrame, stored: DataFrame, documents: DataFrame, embed: Provider, settings: Settings) -> DataFrame:
    """(arxiv_id, neighbours): the documents of the contributions nearest to what each reading
    asks, out of what was stored before and what readings before it in order bring.

    stored: (id, embedding, document), documents: (id, document, embedding) of the fresh ones. A
    document's number is its place: stored ones are below all fresh ones, these in order of
    reading time, so "before" is a comparison of numbers.
    """
    placed = stage(fresh.select("arxiv_id", "created_at", "problem_statement", "proposed_method").orderBy("created_at", "arxiv_id"), "reading-order")
    placed = stage(placed.withColumn("vec_id", F.monotonically_increasing_id() + 1), "reading-places")
    query = knowledge.query_text(F.col("title"), F.col("problem_statement"), F.col("proposed_method"))
    asked = stage(embed(placed.join(titles, "arxiv_id").select("vec_id", "arxiv_id", query.alias("text"))), "reading-vectors")
    old = stored.join(documents.select("id"), "id", "left_anti").select((-F.monotonically_increasing_id() - 1).alias("vec_id"), "embedding", "document")
    new = documents.join(placed.select(F.col("arxiv_id").alias("id"), "vec_id"), "id").select("vec_id", "embedding", "document")
    known = stage(old.unionByName(new), "known-vectors")
    near = similarity.nearest(known, asked.select("vec_id", "embedding"), settings.neighbours, prior_only=True)
    told = near.join(known.select("vec_id", "document"), "vec_id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document"))), lambda x: x["document"]).alias("ds"))
    listed = knowledge.neighbours_text(F.coalesce("ds", F.array().cast("array<string>")))
    return placed.join(told, placed.vec_id == told.query_id, "left").select("arxiv_id", listed.alias("neighbours"))


def conflict_causes(found: DataFrame, readings: DataFrame, analyst: Provider, settings: Settings) -> DataFrame:
    """(arxiv_id, slug, setting, notes): what a model says of the causes of a group's conflicts, or
    the plain statement of them where it fails."""
    line = F.concat(
        F.lit("- "), "method", F.lit(" / "), "metric", F.lit(": current paper reports "), F.col("value").cast("string"), F.lit(", existing record shows "),
        F.col("existing_value").cast("string"), F.lit(" (from paper "), F.coalesce("paper_source", F.lit("unknown")), F.lit(")"),
    )
    plain = leaderboard.conflict_note(F.col("method"), F.col("metric"), F.col("value"), F.col("existing_value"), F.col("paper_source"))
    each = F.array_sort(F.collect_list(F.struct("entry_pos", "result_pos", line.alias("line"), plain.alias("plain"))))
    grouped = found.groupBy("arxiv_id", "slug", "setting").agg(each.alias("ls"))
    told = grouped.select("arxiv_id", "slug", "setting", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("lines"), F.array_join(F.transform("ls", lambda x: x["plain"]), "\n").alias("plain"))
    details = readings.select("arxiv_id", F.coalesce("experiment_table.details", F.lit("")).alias("details"))
    prompt = F.concat(F.lit("Why do these results differ from what is recorded? Answer in JSON with analyses.\n\n"), "lines", F.lit("\n\n"), "details")
    replies = providers.asked_once(analyst(requests_of(told.join(details, "arxiv_id"), prompt, settings)))
    notes = F.when(F.col("error").isNull(), providers.parse_causes(F.col("reply")))
    return replies.select("arxiv_id", "slug", "setting", F.coalesce(notes, F.col("plain")).alias("notes"))


def analyse_stage(
    tables: Tables, analyst: Provider, as_of: Column, settings: Settings, run: int, embed: Provider | None = None
) -> tuple[Tables, DataFrame]:
    """Deltas, board rows with their actions, audit rows and knowledge documents of the readings
    that have no delta yet.

    Papers are ordered by reading time, then id; what a paper sees of earlier ones comes from
    ordered set operations (``conflicts_as_of``, ``actions``, ``neighbours_of``), not from a loop.
    With ``embed`` (text to embedding) documents are stored with their vectors and the analyst is
    told the nearest earlier contributions; without it they are stored without. Also returned:
    ``board_pages`` (slug, markdown) of the boards that changed, ``conflict_notes``.
    """
    fresh = stage(gates.unanalysed(tables["deep_readings"], tables["contribution_deltas"]), "fresh-readings")
    titles = tables["papers"].groupBy("arxiv_id").agg(F.max_by("title", F.struct("created_at")).alias("title"))
    documents = knowledge.documents_of(fresh, tables["papers"])
    kb = tables.get("kb")
    merged = None if kb is None else upsert.upsert_documents(kb, documents)
    if merged is not None and embed is not None:
        bare = stage(merged.filter("embedding IS NULL").drop("embedding").withColumn("text", F.col("document")), "documents-without-vectors")
        made = stage(embed(bare), "document-vectors").drop("text").select(*kb.columns)
        merged = stage(merged.filter("embedding IS NOT NULL").unionByName(made), "documents")
    text = knowledge.query_text(F.col("title"), F.col("problem_statement"), F.col("proposed_method"))
    asking = fresh.join(titles, "arxiv_id")
    if merged is not None and embed is not None:
        mine = merged.filter(F.col("collection") == knowledge.COLLECTIONS[0]).select("id", "embedding", "document")
        own = mine.join(fresh.select(F.col("arxiv_id").alias("id")), "id", "left_semi")
        asking = asking.join(neighbours_of(fresh, titles, mine, own, embed, settings), "arxiv_id")
    else:
        asking = asking.withColumn("neighbours", knowledge.neighbours_text(F.array().cast("array<string>")))
    prompt = F.concat(
        F.lit("What is new here? Answer in JSON.\n\n"), text, F.lit("\n\nContributions:\n"), bulleted(F.col("key_contributions")),
        F.lit("\n\nResults:\n"), "main_results", F.lit("\n\nKnown:\n"), "neighbours",
    )
    asked = requests_of(asking, prompt, settings).select("arxiv_id", "prompt", "request_key")
    replies = providers.asked_once(analyst(asked))
    deltas = providers.parse_deltas(replies.filter("error IS NULL")).withColumn("created_at", as_of).select(*tables["contribution_deltas"].columns)

    seq = F.unix_micros(F.col("created_at").cast("timestamp"))
    rows = leaderboard.board_rows(experiments.unnest(fresh), seq)
    old = tables["leaderboard"]
    extra = {"entry_pos": F.lit(0), "result_pos": F.lit(0), "is_paper_method": F.lit(True)}
    all_rows = stage(old.withColumns(extra).select(*rows.columns).unionByName(rows), "board-rows")
    found = leaderboard.conflicts_as_of(all_rows).join(fresh.select("arxiv_id"), "arxiv_id", "left_semi")
    notes = stage(conflict_causes(found, fresh, analyst, settings), "conflict-notes")
    grouped = all_rows.groupBy("slug", "seq", "arxiv_id", "benchmark", "setting").agg(F.min("entry_pos").alias("group_pos"))
    acted = leaderboard.actions(grouped, found).join(fresh.select("arxiv_id"), "arxiv_id", "left_semi")
    summaries = experiments.groups(experiments.unnest(fresh)).select("arxiv_id", "benchmark", "setting", "summary")
    audit = upsert.log_updates(acted.join(summaries, ["arxiv_id", "benchmark", "setting"]).select("arxiv_id", "benchmark", "action", "summary", as_of.alias("created_at")), run)
    first = tables["sota_updates"].agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    ids = (F.col("_top") + 1 + F.monotonically_increasing_id()).alias("id")
    logged = stage(audit.join(F.broadcast(first)).select(ids, "arxiv_id", "benchmark", "action", "summary", "created_at"), "audit-rows")  # one row
    noted = all_rows.join(notes.withColumnRenamed("notes", "_notes"), ["arxiv_id", "slug", "setting"], "left")
    board = stage(leaderboard.latest_rows(noted.withColumn("note", F.coalesce("_notes", "note")).drop("_notes")).select(*old.columns), "board")
    changed = board.join(rows.select("slug").distinct(), "slug", "left_semi")
    return {
        **tables,
        **({} if merged is None else {"kb": merged}),
        "contribution_deltas": upsert.upsert_rows(tables["contribution_deltas"], deltas),
        "leaderboard": board,
        "sota_updates": tables["sota_updates"].unionByName(logged),
        "kb_documents": documents,
        "board_pages": leaderboard.rendered(changed.filter("value IS NOT NULL")),
        "conflict_notes": notes,
    }, replies.filter("error IS NOT NULL").select("arxiv_id", "error")
