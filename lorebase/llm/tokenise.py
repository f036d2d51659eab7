"""Byte-level BPE encoding of a whole column, without a regex over the texts.

A batch of texts is one array of code points. A table gives each its class; two neighbouring
classes give nearly all token boundaries. What they can't give, whether an apostrophe begins a
token, is the state of a small automaton: each character is a function from state to state,
composition is associative, so the states of all characters come from a parallel prefix scan over
the automaton's (tiny) function monoid. The scan ends as soon as all composed functions are
constant, which for this automaton is after one round.

The slices between boundaries are an Arrow binary array over the batch's own bytes; Arrow's
dictionary encoding leaves the distinct slices, and only those are merged, through a bounded
cache. Ids and byte offsets of a document come from gathers.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"

SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE = range(6)

#: Bytes of text that are held as code points at once, and entries of a worker's slice cache.
CHUNK_BYTES = 4_000_000
CACHE_ENTRIES = 300_000
#: Slices above this many bytes are merged with a heap.
LONG_SLICE = 120


# --- code point classes --------------------------------------------------------------------


def class_runs() -> list[tuple[int, int, int]]:
    """(first, behind last, class) of the runs of letters, numbers and white space.

    The classes are read off a tokenizer library's own Unicode tables, so that code points that
    a newer Unicode version added fall into the class they have there; without the library,
    ``regex`` gives them.
    """
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF], dtype=np.int64)
    text = "".join(map(chr, points.tolist()))
    runs: list[tuple[int, int, int]] = []
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        try:
            from tokenizers import Regex
            from tokenizers.pre_tokenizers import Split

            gaps = [span for _, span in Split(Regex(pattern), behavior="removed").pre_tokenize_str(text)]
            edges = [0, *(x for span in gaps for x in span), len(text)]
            spans = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]
        except ImportError:
            import regex

            spans = [m.span() for m in regex.finditer(pattern, text)]
        runs += [(int(points[a]), int(points[b - 1]) + 1, kind) for a, b in spans]
    return runs


def class_table(runs: list[tuple[int, int, int]]) -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for a, b, kind in runs:
        table[a:b] = kind
    table[0xD800:0xE000] = OTHER
    table[ord(" ")] = SPACE
    table[ord("'")] = QUOTE
    return table


# --- the automaton and its scan ------------------------------------------------------------

#: States after a character: nothing that an apostrophe could join, a blank that attaches to what
#: follows, inside a run of other signs, an apostrophe that begins a token.
OPEN, BLANK, RUN, MARK = range(4)
_STEP = {
    SPACE: (BLANK,) * 4,
    WHITE: (OPEN,) * 4,
    LETTER: (OPEN,) * 4,
    NUMBER: (OPEN,) * 4,
    OTHER: (RUN,) * 4,
    QUOTE: (MARK, RUN, RUN, RUN),
}


@dataclass(frozen=True)
class Monoid:
    """The transition functions that compositions of the characters' functions can give."""

    of_class: np.ndarray  # class -> function
    compose: np.ndarray  # (first, then) -> function
    constant: np.ndarray  # function -> its only value, or -1
    at_start: np.ndarray  # function -> the constant function that it is from OPEN


def build_monoid(step: dict[int, tuple[int, ...]] = _STEP) -> Monoid:
    n = len(next(iter(step.values())))
    known = list(dict.fromkeys([*step.values(), *((s,) * n for s in range(n))]))
    grown = True
    while grown:
        fresh = {tuple(g[s] for s in f) for f in known for g in known} - set(known)
        grown = bool(fresh)
        known += sorted(fresh)
    at = {f: i for i, f in enumerate(known)}
    return Monoid(
        np.array([at[step[c]] for c in range(len(step))], dtype=np.uint8),
        np.array([[at[tuple(g[s] for s in f)] for g in known] for f in known], dtype=np.uint8),
        np.array([f[0] if len(set(f)) == 1 else -1 for f in known], dtype=np.int8),
        np.array([at[(f[OPEN],) * n] for f in known], dtype=np.uint8),
    )


_MONOID = build_monoid()


def marks(classes: np.ndarray, starts: np.ndarray, monoid: Monoid = _MONOID) -> np.ndarray:
    """Positions of apostrophes that begin a token. starts: first positions of the texts."""
    f = monoid.of_class[classes]
    f[starts] = monoid.at_start[f[starts]]
    open_ = np.flatnonzero(monoid.constant[f] < 0)
    where, reach = open_, 1
    while where.size:
        # a function that isn't constant has at least `reach` characters before it in its text
        f[where] = monoid.compose[f[where - reach], f[where]]
        where = where[monoid.constant[f[where]] < 0]
        reach *= 2
    quotes = np.flatnonzero(classes == QUOTE)
    return quotes[monoid.constant[f[quotes]] == MARK]


def boundaries(points: np.ndarray, classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First positions of all slices. points, classes: of all texts, one after the other;
    starts: first positions of the texts, without those of empty texts."""
    n = classes.size
    if not n:
        return np.zeros(0, dtype=np.int64)
    white = classes <= WHITE
    kind = np.where(classes == QUOTE, OTHER, classes)
    kind[white] = WHITE
    first = np.zeros(n, dtype=bool)
    first[starts] = True
    cut = np.empty(n, dtype=bool)
    cut[0] = True
    cut[1:] = kind[1:] != kind[:-1]
    # a blank belongs to what follows it
    cut[1:] &= ~((classes[:-1] == SPACE) & ~white[1:])
    # the last white space before anything else stands alone, or goes with what follows
    last = white.copy()
    last[:-1] &= ~white[1:] & ~first[1:]
    last[-1] = False
    cut |= last
    cut |= first
    at = marks(classes, starts)
    if at.size:
        # the shortened verb forms; the text's end is never crossed
        end = np.append(starts[1:], n)
        stop = end[np.searchsorted(starts, at, side="right") - 1]
        one = points[np.minimum(at + 1, n - 1)]
        two = points[np.minimum(at + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"]) & (at + 1 < stop)
        long = (at + 2 < stop) & np.logical_or.reduce(
            [(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")]
        )
        cut[at[short | long] + 1] = False
        behind = np.concatenate([at[short] + 2, at[long & ~short] + 3])
        cut[behind[behind < n]] = True
    return np.flatnonzero(cut)


# --- merging -------------------------------------------------------------------------------


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the pair of the lowest rank is merged first, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > LONG_SLICE:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
    while True:
        best, at = None, -1
        for i, r in enumerate(pairs):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge, in n log n: a heap of (rank, position) over a linked list of parts."""
    n = len(piece)
    end = list(range(1, n + 1))  # a part's end, by its first position; 0 once swallowed
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two has changed since
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
        if before[i] >= 0:
            push(before[i])
        push(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


# --- batches -------------------------------------------------------------------------------


def _safe_cuts(raw: np.ndarray, size: int) -> list[int]:
    """Where a long text can be cut without changing a token: before a blank or line feed that
    follows a visible ASCII sign, where every composed function is constant."""
    cuts, at = [0], size
    while at < raw.size:
        found = -1
        for a in range(at, raw.size, 1_000_000):
            part = raw[a : a + 1_000_000]
            ok = ((part == 32) | (part == 10)) & (raw[a - 1 : a - 1 + part.size] > 32) & (raw[a - 1 : a - 1 + part.size] < 127)
            if ok.any():
                found = a + int(ok.argmax())
                break
        if found < 0:
            break
        cuts.append(found)
        at = found + size
    return [*cuts, raw.size]


class Encoder:
    """Encodes Arrow string arrays. One per Python worker; its cache is bounded."""

    def __init__(self, ranks: dict[bytes, int], table: np.ndarray, cache_entries: int = CACHE_ENTRIES):
        self.ranks, self.table, self.cache_entries = ranks, table, cache_entries
        self.cache: dict[bytes, list[int]] = {}

    def ids_of(self, piece: bytes) -> list[int]:
        ids = self.cache.get(piece)
        if ids is None:
            ids = merge(piece, self.ranks)
            if len(piece) <= LONG_SLICE:
                if len(self.cache) >= self.cache_entries:
                    self.cache.clear()
                self.cache[piece] = ids
        return ids

    def _chunk(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]], np.ndarray]:
        """raw: UTF-8 of some texts; sizes: bytes of each, none 0. Gives the slices' byte starts,
        the slices of each text, the slices' codes, the ids of each code, and their numbers."""
        lead = (raw & 0xC0) != 0x80
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        if points.size == raw.size:
            at = None
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        else:
            at = np.flatnonzero(lead)
            starts = np.searchsorted(at, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        cuts = boundaries(points, self.table[points], starts)
        per_text = np.diff(np.append(np.searchsorted(cuts, starts), cuts.size))
        begins = cuts if at is None else at[cuts]
        offsets = np.append(begins, raw.size).astype(np.int32)
        slices = pa.BinaryArray.from_buffers(pa.binary(), begins.size, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        coded = slices.dictionary_encode()
        ids = [self.ids_of(p) for p in coded.dictionary.to_pylist()]
        codes = coded.indices.to_numpy(zero_copy_only=False)
        return begins, per_text, codes, ids, np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))

    def encode(self, texts: pa.Array, want: str = "ids") -> list[pa.Array]:
        """want: ``ids`` gives [list<int32>], ``offsets`` [ids, first byte of each id's bytes, as
        list<int32>], ``count`` [int64]. Null and empty texts give empty lists or 0."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        n = len(texts)
        buffer = texts.buffers()[2]
        offs = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1 + texts.offset)[texts.offset :]
        raw = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        total = np.zeros(n, dtype=np.int64)
        values: list[np.ndarray] = []
        firsts: list[np.ndarray] = []
        for rows, part, sizes, base in self._chunks(raw, offs):
            begins, per_text, codes, ids, lens = self._chunk(part, sizes)
            each = lens[codes]
            edges = np.concatenate([[0], np.cumsum(per_text)])
            sums = np.concatenate([[0], np.cumsum(each)])
            np.add.at(total, rows, sums[edges[1:]] - sums[edges[:-1]])
            if want == "count":
                continue
            flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(lens.sum()))
            from_ = np.concatenate([[0], np.cumsum(lens)[:-1]])
            inner = np.arange(int(sums[-1])) - np.repeat(sums[:-1], each)
            values.append(flat[np.repeat(from_[codes], each) + inner])
            if want == "offsets":
                width = np.fromiter((len(self.bytes_of(i)) for i in flat.tolist()), dtype=np.int64, count=flat.size)
                ahead = np.concatenate([[0], np.cumsum(width)[:-1]])
                ahead = ahead - np.repeat(ahead[np.minimum(from_, max(0, flat.size - 1))], lens)
                text_start = np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]) - base, per_text)
                firsts.append(np.repeat(begins - text_start, each) + ahead[np.repeat(from_[codes], each) + inner])
        if want == "count":
            return [pa.array(total)]
        edges = pa.array(np.concatenate([[0], np.cumsum(total)]).astype(np.int32))
        out = [values, firsts] if want == "offsets" else [values]
        return [
            pa.ListArray.from_arrays(edges, pa.array(np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32)))
            for x in out
        ]

    def _chunks(self, raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(row of each text or part of a text, bytes, sizes, bytes of the text before the part)."""
        sizes = np.diff(offs)
        rows = np.flatnonzero(sizes)
        i = 0
        while i < rows.size:
            r = rows[i]
            if sizes[r] > CHUNK_BYTES:
                text = _valid(raw[offs[r] : offs[r + 1]])
                cuts = _safe_cuts(text, CHUNK_BYTES)
                for a, b in zip(cuts, cuts[1:], strict=False):
                    yield np.array([r]), text[a:b], np.array([b - a]), np.array([a])
                i += 1
                continue
            j, size = i, 0
            while j < rows.size and size + sizes[rows[j]] <= CHUNK_BYTES:
                size += sizes[rows[j]]
                j += 1
            part = raw[offs[r] : offs[rows[j - 1] + 1]]
            try:
                part.tobytes().decode("utf-8")
                yield rows[i:j], part, sizes[rows[i:j]], np.zeros(j - i, dtype=np.int64)
            except UnicodeDecodeError:
                texts = [_valid(raw[offs[k] : offs[k + 1]]) for k in rows[i:j]]
                yield rows[i:j], np.concatenate(texts), np.array([t.size for t in texts]), np.zeros(j - i, dtype=np.int64)
            i = j

    def bytes_of(self, i: int) -> bytes:
        if not hasattr(self, "_back"):
            self._back = {v: k for k, v in self.ranks.items()}
        return self._back[i]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of, ids)).decode("utf-8", errors="replace")


def _valid(raw: np.ndarray) -> np.ndarray:
    """Bytes that aren't UTF-8 count as the replacement character."""
    data = raw.tobytes()
    try:
        data.decode("utf-8")
        return raw
    except UnicodeDecodeError:
        return np.frombuffer(data.decode("utf-8", errors="replace").encode("utf-8"), dtype=np.uint8)


# --- Spark ---------------------------------------------------------------------------------

_ENCODERS: dict[str, Encoder] = {}


def _encoder(key: str, ranks: bytes, runs: list[tuple[int, int, int]]) -> Encoder:
    """The worker's encoder; it lives as long as the worker, so its cache serves all its tasks."""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(ranks), class_table(runs))
    return _ENCODERS[key]


def encoder_source(spark: SparkSession, vocabulary: str = BYTE_BPE, folder: str = TOKENIZERS) -> Callable[[], Encoder]:
    """What a task calls to get its encoder. The vocabulary file, of a fixed size, is read by the
    driver and broadcast, so executors need not have it."""
    raw = Path(folder, vocabulary).read_bytes()
    shared = spark.sparkContext.broadcast((raw, class_runs()))
    key = f"{folder}/{vocabulary}"
    return lambda: _encoder(key, *shared.value)


_WANTED = {"ids": ("ids",), "offsets": ("ids", "offsets"), "count": ("n_tokens",)}


def encode(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    want: str = "ids",
    vocabulary: str = BYTE_BPE,
    folder: str = TOKENIZERS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Token ids of every text: (key, *keep, ids), one row per row of the input.

    want ``offsets`` adds the first byte of each token in the text's UTF-8, ``count`` gives
    n_tokens instead of ids. Special tokens' strings are ordinary text. A map over partitions:
    no shuffle, whole texts of any length, batch memory bounded by CHUNK_BYTES.

    Nulls: a null text and an empty text both give an empty list (0 tokens); a null key is kept.
    Repeated rows give repeated results; an empty table an empty result. Bytes that are no
    UTF-8 are read as U+FFFD. Columns other than key, text and keep are dropped before the map.
    """
    get = encoder_source(df.sparkSession, vocabulary, folder)
    names = [key, *keep]
    rows = df.select(*dict.fromkeys([*names, text]))
    kind: dict[str, T.DataType] = {"ids": T.ArrayType(T.IntegerType()), "offsets": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType()}
    fields = [T.StructField(c, rows.schema[c].dataType) for c in names] + [T.StructField(c, kind[c]) for c in _WANTED[want]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = get()
        for b in batches:
            done = encoder.encode(b.column(b.schema.get_field_index(text)), want)
            kept: list[Any] = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, *done], names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))
