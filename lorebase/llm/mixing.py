"""Mixing sources to target shares of tokens by entropy balancing."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.tokenise import BYTE_BPE, TOKENIZERS, encode
from lorebase.session import rows_at_most, stage

#: Sources that a table of targets may list; the duals and totals of sources are held by the driver.
MOST_SOURCES = 100_000
#: Newton stops at this relative distance from a source's tokens, or after so many rounds.
CLOSE, ROUNDS = 1e-6, 60
#: Documents of a source that are rounded together.
ROUNDING = 5_000


@dataclass
class Source:
    """A source's target, what it has, what it shall give, and the state of its dual."""

    share: float
    repeats: int
    docs: int = 0
    tokens: int = 0
    goal: float = 0.0
    dual: float = 0.0
    low: float = -math.inf
    high: float = math.inf

    @property
    def most(self) -> float:
        return float(self.repeats * self.tokens)


def nearest_total(sources: dict[str, Source]) -> float:
    """The largest mix in which every source that has documents reaches its target; the shares
    of sources without documents go to the others in proportion."""
    some = [s for s in sources.values() if s.share > 0 and s.most > 0]
    weight = sum(s.share for s in some)
    return min((s.most * weight / s.share for s in some), default=0.0)


def goals(sources: dict[str, Source], total: float) -> None:
    """Tokens of each source for a mix of ``total`` tokens: in proportion to the shares, at most
    what the repeats allow; what short sources leave goes to the others, in proportion again."""
    left = min(total, sum(s.most for s in sources.values() if s.share > 0))
    open_ = {k: s for k, s in sources.items() if s.share > 0 and s.most > 0}
    while open_:
        weight = sum(s.share for s in open_.values())
        short = {k: s for k, s in open_.items() if s.share / weight * left >= s.most}
        if not short:
            for s in open_.values():
                s.goal = s.share / weight * left
            return
        for k, s in short.items():
            s.goal = s.most
            left -= s.most
            del open_[k]


def balance(sizes: DataFrame, sources: dict[str, Source]) -> int:
    """Solves the duals; sizes: (source, n_tokens, n). Returns the rounds it took.

    The rates nearest to 1 in entropy that give each source its tokens are exp(dual * size),
    capped at the repeats; size is in units of the source's mean. The dual is convex and falls
    apart by source; each round is one aggregate of all sources' gradients and curvatures,
    followed by a Newton step kept inside the bracket known so far.
    """
    spark = sizes.sparkSession
    open_ = {k for k, s in sources.items() if 0 < s.goal < s.most}
    for k in open_:
        sources[k].dual = 0.0
    for done in range(ROUNDS):
        if not open_:
            return done
        rows = [(k, sources[k].dual, float(sources[k].repeats), sources[k].tokens / sources[k].docs) for k in sorted(open_)]
        state = spark.createDataFrame(rows, "source string, dual double, most double, unit double")
        u = F.col("n_tokens") / F.col("unit")
        raw = F.exp(F.least(F.lit(60.0), F.col("dual") * u))
        inside = raw < F.col("most")
        got = (
            sizes.join(state, "source")
            .groupBy("source")
            .agg(
                F.sum(F.col("n") * F.col("n_tokens") * F.least(raw, F.col("most"))).alias("f"),
                F.sum(F.when(inside, F.col("n") * F.col("n_tokens") * u * raw).otherwise(0.0)).alias("d"),
            )
            .collect()
        )
        for k, f, d in got:
            s = sources[k]
            miss = f - s.goal
            if abs(miss) <= CLOSE * s.goal or s.high - s.low < 1e-13:
                open_.discard(k)
                continue
            if miss > 0:
                s.high = s.dual
            else:
                s.low = s.dual
            step = s.dual - miss / d if d > 0 else math.nan
            if not (s.low < step < s.high) or abs(step - s.dual) > 8:
                if math.isinf(s.low) or math.isinf(s.high):
                    step = s.dual + (-4.0 if miss > 0 else 4.0)
                else:
                    step = (s.low + s.high) / 2
            s.dual = step
    return ROUNDS


def read_targets(targets: DataFrame) -> dict[str, Source]:
    """Null sources are dropped; null or negative shares and repeats count as 0. A source that is
    listed twice is an error: which of its targets holds would not be defined."""
    rows = targets.select("source", "target_share", "max_repeats").filter("source IS NOT NULL")
    if not rows_at_most(rows, MOST_SOURCES):
        raise ValueError(f"more than {MOST_SOURCES} sources")
    out: dict[str, Source] = {}
    for name, share, repeats in rows.collect():
        if name in out:
            raise ValueError(f"source {name!r} is listed twice")
        out[name] = Source(max(0.0, share or 0.0), max(0, repeats or 0))
    return out


def mix(
    docs: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    total_tokens: float | str | None = None,
    vocabulary: str = BYTE_BPE,
    folder: str = TOKENIZERS,
) -> DataFrame:
    """(<key>, source, n_tokens, copies), copies >= 1: the documents of the mix.

    total_tokens: the mix's size; without it, the largest size at which every source that has
    documents reaches its target (``nearest_total``), which brings all shares as near to their
    targets as they can come. With a size, each source gets its target share of it as far as its
    documents, each at most max_repeats times, allow; what small sources can't fill the others
    fill in proportion to their shares, so the mix keeps its size. ``listed_tokens`` as the size
    stands for all tokens of the listed sources. Within a source the copies come from exponentially tilted rates
    (``balance``), rounded in order of size by systematic sampling with a fixed offset, so a
    source's tokens end up within about one document, for large sources one per ROUNDING, of
    the goal, and no document above max_repeats.

    Token counts are staged once; Newton works on the number of documents per source and size, a
    table that does not grow with the text. A source with a third of all documents is summed on
    the map side and rounded in buckets.

    Nulls: null and empty texts have size 0 and are left out, as are null sources and sources
    that have no target. A key that repeats is a document of its own each time. Ties in size go
    by a hash of the key, then the key. An empty table gives an empty mix. Further columns are
    dropped.
    """
    sources = read_targets(targets)
    wanted = targets.select("source").filter("source IS NOT NULL").distinct()
    mine = docs.select(F.col(key).alias("k"), F.col("source"), F.col(text).alias("text")).filter("text <> ''")
    counts = encode(mine.join(wanted, "source", "left_semi"), "k", "text", "count", vocabulary, folder, keep=("source",))
    counted = stage(counts.filter("n_tokens > 0"), "token-counts")
    sizes = stage(counted.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")), "token-sizes")
    for k, n, t in sizes.groupBy("source").agg(F.sum("n"), F.sum(F.col("n") * F.col("n_tokens"))).collect():
        sources[k].docs, sources[k].tokens = n, t
    if total_tokens is None:
        total = nearest_total(sources)
    elif total_tokens == "listed_tokens":
        total = float(sum(s.tokens for s in sources.values()))
    else:
        total = float(total_tokens)
    goals(sources, total)
    sizes = sizes.persist()  # read once a round of Newton; what is lost is read again from its stage
    balance(sizes, sources)
    sizes.unpersist()
    used = [
        (k, s.dual, float(s.repeats), s.tokens / s.docs, s.goal >= s.most, max(1, -(-s.docs // ROUNDING)))
        for k, s in sorted(sources.items())
        if s.goal > 0
    ]
    plan = docs.sparkSession.createDataFrame(used, "source string, dual double, most double, unit double, full boolean, buckets int")
    tilt = F.least(F.exp(F.least(F.lit(60.0), F.col("dual") * F.col("n_tokens") / F.col("unit"))), F.col("most"))
    rate = F.when(F.col("full"), F.col("most")).otherwise(tilt)
    rated = counted.join(plan, "source").select(
        "k", "source", "n_tokens", "most", rate.alias("rate"), F.xxhash64("k").alias("h"), F.pmod(F.xxhash64("k", F.lit(1)), F.col("buckets")).alias("bucket")
    )
    before = F.coalesce(F.sum("rate").over(Window.partitionBy("source", "bucket").orderBy("n_tokens", "h", "k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    offset = F.pmod(F.xxhash64("source", "bucket"), F.lit(1_000_003)) / 1_000_003
    sampled = F.floor(before + F.col("rate") + offset) - F.floor(before + offset)
    copies = F.greatest(F.lit(0), F.least(F.col("most"), sampled)).cast("int")
    return rated.select(F.col("k").alias(key), "source", "n_tokens", copies.alias("copies")).filter("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, n_copies, most_copies, tokens, share) of every
    listed source, also of those that give nothing; share is of the mix's tokens."""
    got = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"),
        F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"),
    )
    all_ = got.agg(F.sum("tokens").alias("all_tokens"))
    zero = {"n_docs": 0, "n_copies": 0, "most_copies": 0, "tokens": 0}
    listed = targets.select("source", "target_share", "max_repeats").filter("source IS NOT NULL")
    out = listed.join(got, "source", "left").fillna(zero).join(F.broadcast(all_))  # one row
    share = F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0)
    return out.select(*listed.columns, *zero, share.alias("share"))


def copies_of(docs: DataFrame, mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mix as rows: every document as often as it occurs, with ``copy`` from 1."""
    times = mixed.select(key, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return docs.join(times, key)
