"""Near-duplicate texts: banded MinHash candidates, odd sketches, then the exact similarity."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.buckets import BLOCK, bucket_pairs, crowded_members
from lorebase.session import stage

#: MinHash values a text may have, and the chance that a pair exactly at the threshold is missed.
MOST_HASHES = 256
MISS = 0.001
#: The odd sketch: so many MinHash values folded into so many bits.
SKETCH_SAMPLES = 256
SKETCH_WORDS = 16


#: Letters and digits of words as numbers from 1, all other bytes 0.
_SIGNS = np.zeros(256, np.uint64)
_SIGNS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789"]] = np.arange(1, 37, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _BASE, np.uint64)), np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))


def shingles(texts: list[str], n: int) -> list[np.ndarray]:
    """Distinct 64-bit hashes of n consecutive words, sorted, of each text; empty for fewer words.

    Words are the runs of ``[a-z0-9]`` after lower-casing. All texts are one array of bytes; a
    word's hash is a difference of prefix sums of powers of an odd base.
    """
    # bytes of other letters than ASCII ones are no signs of words
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    signs = _SIGNS[np.frombuffer(b" ".join(parts), np.uint8)]
    inside = np.zeros(signs.size + 2, bool)
    inside[1:-1] = signs > 0
    start, stop = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    with np.errstate(over="ignore"):
        up, down = _powers(1 << signs.size.bit_length())
        total = np.zeros(signs.size + 1, np.uint64)
        np.cumsum(signs * up[: signs.size], out=total[1:])
        word = _mix((total[stop] - total[start]) * down[start])
        grams = word[: max(0, word.size - n + 1)].copy()
        for i in range(1, n):
            grams = _mix(grams * np.uint64(0x9FB21C651E98DF25) + word[i : i + grams.size])
    edges = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in parts)]))
    first = np.minimum(edges[:-1], grams.size)
    last = np.maximum(first, edges[1:] - n + 1)
    values, inside = grams.view(np.int64), np.zeros(grams.size + 1, np.int8)
    for i, j in zip(first.tolist(), last.tolist(), strict=True):
        values[i:j].sort()
    np.add.at(inside, first, 1)
    np.add.at(inside, last, -1)
    kept = np.cumsum(inside[:-1]) > 0
    same = np.zeros(grams.size, bool)
    same[1:] = values[1:] == values[:-1]
    same[first[first < last]] = False
    kept &= ~same
    sizes = np.concatenate([[0], np.cumsum(kept)])
    return np.split(values[kept], (sizes[last] - sizes[first]).cumsum()[:-1]) if texts else []


def shingle_sets(rows: DataFrame, n: int) -> DataFrame:
    """(k, shingles) of the rows (k, t) that have a shingle."""
    kind = dict(rows.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingles(b.column(1).to_pylist(), n)
            edges = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            whole = pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))], names=["k", "shingles"])
            yield whole.filter(pa.array(np.diff(edges) > 0))

    return rows.select("k", "t").mapInArrow(run, f"k {kind}, shingles array<bigint>")


def banding(threshold: float, most: int = MOST_HASHES, miss: float = MISS) -> tuple[int, int]:
    """(rows, bands): the longest bands with which a pair at the threshold is missed with a
    chance of at most ``miss``, out of at most ``most`` hashes."""
    best = (1, max(1, math.ceil(math.log(miss) / math.log1p(-threshold)))) if threshold < 1 else (1, 1)
    for rows in range(1, 33):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(miss) / math.log1p(-hit))
        if rows * bands <= most:
            best = (rows, bands)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Signer:
    """MinHash bands and odd sketch of shingle sets."""

    def __init__(self, rows: int, bands: int, samples: int = SKETCH_SAMPLES, words: int = SKETCH_WORDS, seed: int = 7):
        self.rows, self.bands, self.words = rows, bands, words
        self.k = max(rows * bands, samples)
        self.samples = samples
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**31, size=self.k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(1, 2**31, size=self.k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.band_salt = _mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.row_salt = np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.sample_salt = _mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def minhash(self, hashes: np.ndarray) -> np.ndarray:
        """hashes: uint64, not empty. In blocks, so a very long text needs no more memory."""
        x = (_mix(hashes) >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.k, 2**32 - 1, dtype=np.uint32)
        held = np.empty((min(256, x.size), self.k), dtype=np.uint32)
        for i in range(0, x.size, 256):
            part = x[i : i + 256, None]
            h = np.multiply(part, self.a, out=held[: part.shape[0]])
            h ^= h >> np.uint32(15)
            h *= self.b
            np.minimum(low, h.min(axis=0), out=low)
        return low

    def sign(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(band keys, sketch words), both int64."""
        keys, sketches = self.finish(self.minhash(hashes)[None, :])
        return keys[0], sketches[0]

    def finish(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(band keys, sketch words) of rows of MinHash values, all rows at once."""
        n, low = len(low), low.astype(np.uint64)
        keys = np.repeat(self.band_salt[None, :], n, axis=0)
        rows = low[:, : self.rows * self.bands].reshape(n, self.bands, self.rows)
        for r in range(self.rows):
            keys = _mix(keys ^ (rows[:, :, r] + self.row_salt[r]))
        bits = (_mix(low[:, : self.samples] ^ self.sample_salt) % np.uint64(64 * self.words)).astype(np.int64)
        places = (bits + np.arange(n, dtype=np.int64)[:, None] * (64 * self.words)).ravel()
        odd = np.bincount(places, minlength=n * 64 * self.words) & 1
        sketch = np.packbits(odd.astype(np.uint8).reshape(n, -1), axis=1, bitorder="little")
        return keys.view(np.int64), np.ascontiguousarray(sketch).view(np.int64)


def most_differing_bits(threshold: float, samples: int = SKETCH_SAMPLES, bits: int = 64 * SKETCH_WORDS, slack: float = 4.0) -> int:
    """XOR population count up to which a pair stays a candidate: what a pair at the threshold
    has, and ``slack`` standard deviations of sampling and folding more."""
    differ = 2 * samples * (1 - threshold)
    share = (1 - math.exp(-2 * differ / bits)) / 2
    sampling = 2 * math.sqrt(samples * threshold * (1 - threshold)) * math.exp(-2 * differ / bits)
    return math.ceil(bits * share + slack * math.hypot(math.sqrt(bits * share * (1 - share)), sampling))


def estimate(differing: float, samples: int = SKETCH_SAMPLES, bits: int = 64 * SKETCH_WORDS) -> float:
    """Jaccard similarity as an XOR population count has it."""
    inner = 1 - 2 * differing / bits
    return 0.0 if inner <= 0 else max(0.0, 1 + bits / (4 * samples) * math.log(inner))


def sign_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, bands, s0..) of the rows (row, shingles); row, a number, becomes the id.

    What goes through the large exchanges is numbers: neither keys nor shingles."""
    rows, bands = banding(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(rows, bands)
        for b in batches:
            sets = b.column(1)
            flat = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            edges = sets.offsets.to_numpy() - sets.offsets[0].as_py()
            count = len(sets)
            low = np.empty((count, signer.k), dtype=np.uint32)
            for i in range(count):
                low[i] = signer.minhash(flat[edges[i] : edges[i + 1]])
            keys, sketch = signer.finish(low)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, count * bands + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
            cols = [b.column(0), lists, *(pa.array(np.ascontiguousarray(sketch[:, w])) for w in range(SKETCH_WORDS))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["id", "bands", *(f"s{w}" for w in range(SKETCH_WORDS))]
    longs = ", ".join(f"s{w} bigint" for w in range(SKETCH_WORDS))
    return sets.select("row", "shingles").mapInArrow(run, f"id bigint, bands array<bigint>, {longs}")


def candidate_pairs(signed: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs that share a band and whose sketches are near.

    Only members of buckets with two or more get sketches; the XOR population count is part of
    the join's condition.
    """
    bands = signed.select(F.explode("bands").alias("key"), "id")
    sketches = signed.drop("bands")
    # staged: both sides of the pairing read it, and it is a small part of all bands
    members = stage(crowded_members(bands, block), "crowded").join(sketches, "id")
    cols = [f"s{w}" for w in range(SKETCH_WORDS)]
    most = most_differing_bits(threshold)

    def near(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
        differ = F.lit(0)
        for c in cols:
            differ = differ + F.bit_count(x(c).bitwiseXOR(y(c)))
        return differ <= most

    return bucket_pairs(members, cols, near)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """Links between different shingle sets, and which rows have which set.

    Returns (links, members): links (rep_a, rep_b, jaccard) between representatives whose sets
    have at least ``threshold`` in common, members (<key>, rep) of every row with a shingle. rep is
    the least key of the rows with the same set; such rows have similarity 1 without being
    expanded into pairs here.

    Equal sets are collapsed before anything is compared, so a text that a third of all rows
    share is one row from there on. Candidates share one of the MinHash bands (``banding``: a
    pair at the threshold is missed with a chance of MISS, more similar ones with far less);
    odd sketches reject most of the rest inside the join; what is left is decided exactly on the
    sets. All rows and whole texts take part and no bucket is capped.

    Nulls: null keys and texts are left out, as are texts with fewer than n words. Repeated
    rows are one. Ties: representatives are the least keys. An empty table gives empty results.
    Columns other than key and text are dropped first.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k IS NOT NULL AND t IS NOT NULL")
    # a number stands for the row: which row of a set represents it is then a look-up of numbers
    sets = shingle_sets(rows, n).withColumn("row", F.monotonically_increasing_id())
    sets = sets.select("k", "shingles", "row", F.xxhash64("shingles").alias("h1"), F.xxhash64(F.lit(1), F.reverse("shingles")).alias("h2"))
    hashed = stage(sets, "shingles")
    groups = hashed.groupBy("h1", "h2").agg(F.min("k").alias("rep"), F.min_by("row", F.struct("k", "row")).alias("row"))
    members = stage(hashed.select("k", "h1", "h2").join(groups.drop("row"), ["h1", "h2"]).select(F.col("k").alias(key), "rep").distinct(), "members")
    one = groups.select(F.col("row").alias("id"))
    signed = stage(sign_sets(hashed, threshold).join(one, "id", "left_semi"), "signed")
    pairs = candidate_pairs(signed, threshold)
    of = hashed.select(F.col("row").alias("id"), F.col("k").alias("rep"), "shingles")
    a, b = (of.select(F.col("id").alias(f"id_{x}"), F.col("rep").alias(f"rep_{x}"), F.col("shingles").alias(f"s{x}")) for x in "ab")
    limit = Fraction(threshold).limit_denominator(10_000)
    first, second = F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b")
    both = pairs.join(a, "id_a").join(b, "id_b").select(first, second, F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("s"))
    links = both.filter(F.col("i") * limit.denominator >= (F.col("s") - F.col("i")) * limit.numerator)
    return links.select("rep_a", "rep_b", (F.col("i") / (F.col("s") - F.col("i"))).alias("jaccard")), members


def all_pairs(links: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of all rows behind links, and of rows with equal sets."""
    m = members.select(F.col(key).alias("id"), "rep")
    a = m.select(F.col("id").alias("ia"), F.col("rep").alias("rep_a"))
    b = m.select(F.col("id").alias("ib"), F.col("rep").alias("rep_b"))
    across = links.select("rep_a", "rep_b").join(a, "rep_a").join(b, "rep_b").select("ia", "ib")
    shared = m.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rep")
    twins = m.join(shared, "rep", "left_semi")
    x, y = twins.alias("x"), twins.alias("y")
    within = x.join(y, (F.col("x.rep") == F.col("y.rep")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("ia"), F.col("y.id").alias("ib"))
    return across.unionByName(within).select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
