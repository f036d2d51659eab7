"""Pages of repeated keywords, bare links and tags: bagged trees on weak labels, smoothed by host."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.session import stage

#: Rows with a weak label that the trees are fitted on, at most; the rest is only scored.
SAMPLE = 20_000
TREES, DEPTH, SEED = 25, 8, 17
#: Texts with fewer characters, white space not counted, are never cases.
LEAST_CHARS = 40
#: A host counts as so many pages of the overall rate more. At weight 1 its rate would stand for
#: the odds before a page is seen; sources are broader than hosts, so it weighs half of that.
PRIOR, WEIGHT = 20.0, 0.5

#: Classes of code points.
OTHER, WHITE, LINE, LETTER, DIGIT, SIGN, END, ITEM, HASH, TECHNICAL = range(10)
#: Marks that end sentences, part the items of a list, or are rare outside code, tables and references. Fixed values.
ENDS, ITEMS, TECHNICALS = ".!?。！？…", ",;|•·/»、，；", "=(){}[]<>_\\\""
LAST_CODE = 0x30000
#: Signs that join digits to larger numbers and marks: full stop, comma, hyphen, equals sign, low line, slash, colon.
JOINED = np.array([ord(c) for c in ".,-=_/:"], np.uint32)

_MARKUP = re.compile(r"\[url=[^\]]*\]|\[/url\]|<a\s[^>]*>|</a>|\]\((?:https?://|www\.)[^)\s]*\)|(?:https?://|www\.)[^\s\"'<>\])]+", re.I)
#: Names of the fields of shop entries. They give a weak label only; the trees never see them. Fixed values.
_FIELDS = re.compile(r"\bsku\b|\bisbn\b|\bprice\s*:|\btags?\s*:|\bmots[- ]clés\s*:|\betiquetas\s*:|\bschlagw\w+\s*:|标签\s*[:：]", re.I)
FIELD_PARTS = ("sku", "tag", "mots", "etiquetas", "schlagw", "标签", "price", "isbn")
#: Characters of a text that are measured at a time; texts are cut, and what is measured is summed.
SLICE, GROUP = 1 << 17, 1 << 19
#: Words within which a word, or a phrase of two words (three signs of scripts without spaces), comes again.
NEAR, PHRASE_NEAR, SIGNS_NEAR = 30, 9, 18

#: What the weak labels are voted from. ``spam_share`` is not voted on; it scores pages where no trees can be fitted.
SIGNALS = ["spam_share", "linked", "repeated", "listed", "fields", "prose", "marked", "named", "squeezed"]
#: What the trees see: other measures than the shares above, though of the same kinds of things;
#: ``compression`` alone is a signal (``squeezed``, one vote) as well.
FEATURES = [
    "mark_share", "links_per_100", "words_per_link", "hash_share", "digits", "technical", "items_per_word", "words_per_item", "short_items", "capital_items",
    "ended", "sentence_words", "piece_words", "line_chars", "short_lines", "word_again", "long_word_again", "phrase_again", "phrase_windows", "short_words",
    "word_letters", "signs", "capitals", "busiest", "compression", "line_spread",
]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, lower-case code, mixed number) of every code point below LAST_CODE."""
    kind, lower = np.zeros(LAST_CODE, np.uint8), np.arange(LAST_CODE, dtype=np.uint32)
    for i in range(LAST_CODE):
        c = chr(i)
        if c.isalpha():
            kind[i] = SIGN if 0x0E00 <= i < 0x0F00 or 0x3040 <= i < 0xA000 or 0xF900 <= i < 0xFB00 or i >= 0x20000 else LETTER
            if (low := c.lower()) != c and len(low) == 1:
                lower[i] = ord(low)
        elif c.isdigit():
            kind[i] = DIGIT
        elif c.isspace():
            kind[i] = LINE if c in "\n\r\x0b\x0c\x85  " else WHITE
    for marks, k in ((ENDS, END), (ITEMS, ITEM), ("#＃", HASH), (TECHNICALS, TECHNICAL)):
        kind[[ord(c) for c in marks]] = k
    with np.errstate(over="ignore"):
        mixed = (lower.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return kind, lower, mixed


_BASE = 0x5851F42D4C957F2D


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, _BASE, np.uint64))
        down = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))
    return up, down


def _again(keys: np.ndarray, near: np.ndarray, least: int = 2) -> np.ndarray:
    """Whether each key is one of ``least`` equal keys, each at most ``near`` places after the one before.

    One sort of numbers: the upper 40 bits of a key before its place.
    """
    n = keys.size
    if n < 2:
        return np.zeros(n, bool)
    order = np.sort((keys & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64))
    at = (order & np.uint64(0xFFFFFF)).astype(np.int64)
    top = order >> np.uint64(24)
    new = np.ones(n, bool)
    new[1:] = (top[1:] != top[:-1]) | (at[1:] - at[:-1] > near[at[1:]])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, n))
    out = np.zeros(n, bool)
    out[at] = np.repeat(sizes >= least, sizes)
    return out


#: Columns of sums: what is measured of a slice and added up over a text.
_SUMS = (
    "size mark links hashes digits technical items words item_words short_items capital_items lists ended sentence_words pieces chunks lines line_chars short_lines "
    "word_again long_words long_again phrase_again windows phrase_windows short_words letters signs capitals raw packed "
    "spam linked repeated listed fields prose marked named line_squares"
).split()
_AT = {c: i for i, c in enumerate(_SUMS)}


def _sums(slices: list[str]) -> np.ndarray:
    """_SUMS of each of some slices of texts, all at once on arrays of code points."""
    table, lower_of, mixed = _tables()
    text = "\n".join(slices) + "\n"
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, d = code.size, len(slices)
    code = np.minimum(code, LAST_CODE - 1)
    kind = table[code]
    lengths = np.fromiter(map(len, slices), np.int64, d) + 1
    begins = np.cumsum(lengths) - lengths

    # links and their markup belong to no word
    mark, link_at, field_at = np.zeros(n, bool), [], []
    for i, s in enumerate(slices):
        if "://" in s or "www." in s or "WWW." in s or "</a>" in s or "[/url]" in s:
            for m in _MARKUP.finditer(s):
                a, b = begins[i] + m.start(), begins[i] + m.end()
                mark[a:b] = True
                if not s.startswith(("</", "[/"), m.start()):
                    link_at.append(a)
        low = s.lower()
        if any(f in low for f in FIELD_PARTS):
            field_at += [begins[i] + m.start() for m in _FIELDS.finditer(s)]
    links, fields = np.array(link_at, np.int64), np.array(field_at, np.int64)
    white = (kind == WHITE) | (kind == LINE)

    # words: runs of letters and digits, and single signs of scripts without spaces
    sign = (kind == SIGN) & ~mark
    run = ((kind == LETTER) | (kind == DIGIT)) & ~mark
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = run[:-1], run[1:]
    start = np.flatnonzero((run & ~before) | sign)
    stop = np.flatnonzero((run & ~after) | sign) + 1
    k = start.size
    with np.errstate(over="ignore"):
        up, down = _powers(max(n, GROUP + SLICE))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed[code] * up[:n], out=total[1:])
        word = (total[stop] - total[start]) * down[start]
        word ^= word >> np.uint64(31)
        word *= np.uint64(0x94D049BB133111EB)
    length, of_sign = stop - start, sign[start]

    # lines, pieces (sentences and what is between them) and items, each numbered along the text
    # a word parted at the end of a line doesn't end it
    breaks = kind == LINE
    parted = np.flatnonzero(breaks[2:] & (code[1:-1] == 45) & (kind[:-2] == LETTER)) + 2
    breaks[parted[parted < n - 1]] = False
    breaks[begins[1:] - 1] = True
    next_white = np.ones(n, bool)
    next_white[:-1] = white[1:]
    ends = (kind == END) & ~mark
    bound = breaks | (ends & (next_white | (code > 0x3000)))
    seps = (kind == ITEM) & ~mark
    dash = np.flatnonzero((code == 45) & next_white)
    seps[dash[white[np.maximum(dash - 1, 0)]]] = True

    def numbers(b: np.ndarray) -> np.ndarray:
        out = np.cumsum(b, dtype=np.int32)
        out -= b
        return out

    line, piece, item = numbers(breaks), numbers(bound), numbers(bound | seps)
    lines, pieces, items = int(line[-1]) + 1, int(piece[-1]) + 1, int(item[-1]) + 1
    piece_end = np.flatnonzero(bound)
    piece_doc = np.searchsorted(begins, piece_end, "right") - 1
    line_end = np.flatnonzero(breaks)
    line_doc = np.searchsorted(begins, line_end, "right") - 1
    piece_line = line[piece_end]

    def per(at: np.ndarray, of: np.ndarray, m: int) -> np.ndarray:
        return np.bincount(of[at], minlength=m)

    filled = np.flatnonzero(~white)
    size = per(filled, piece, pieces)
    words = per(start, piece, pieces)
    marks, piece_links = per(np.flatnonzero(mark & ~white), piece, pieces), per(links, piece, pieces)
    last = np.searchsorted(filled, piece_end, "right") - 1
    tail = code[filled[np.maximum(last, 0)]] if filled.size else np.zeros(pieces, np.uint32)
    ended = (size > 0) & (np.isin(tail, [ord(c) for c in ENDS + ":："]))

    # hash tags, and what code, tables, logs and references have
    tags = np.flatnonzero((start > 0) & (kind[np.maximum(start - 1, 0)] == HASH) & ~mark[np.maximum(start - 1, 0)])
    hashes = np.bincount(piece[start[tags]], weights=length[tags] + 1, minlength=pieces)
    dots = np.flatnonzero(ends & (code == 46))
    double = dots[(kind[np.minimum(dots + 1, n - 1)] == END) | (kind[np.maximum(dots - 1, 0)] == END)]
    letter = start[(length == 1) & ~of_sign & (code[np.minimum(stop, n - 1)] == 46)]
    digit = np.flatnonzero((kind == DIGIT) & ~mark)
    # digits of small whole numbers and of years are not technical
    number = (kind[start] == DIGIT) & (kind[stop - 1] == DIGIT) if k else np.zeros(0, bool)
    year = (length == 4) & ((code[start] == 49) | (code[start] == 50))
    before_is, after_is = code[np.maximum(start - 1, 0)], code[np.minimum(stop, n - 1)]
    joined = np.isin(before_is, JOINED) | (np.isin(after_is, JOINED) & (kind[np.minimum(stop + 1, n - 1)] == DIGIT))
    small = number & ((length <= 2) | year) & ~joined
    digits_to = np.cumsum(kind == DIGIT)
    # of a long mark, as a hash in hexadecimal digits, only four count
    held = np.minimum(digits_to[stop - 1] - digits_to[start] + (kind[start] == DIGIT), 4) if k else np.zeros(0, np.int64)
    held[small] = 0
    technical = np.concatenate([np.flatnonzero((kind == TECHNICAL) & ~mark), double, letter])
    line_size = per(filled, line, lines)
    line_technical = per(technical, line, lines) + np.bincount(line[start], weights=held, minlength=lines)
    plain = line_technical[piece_line] <= 0.06 * line_size[piece_line] + 0.5

    # items: short ones, and those that begin with a capital
    item_words = per(start, item, items)
    head = np.zeros(items, np.int64)
    head[item[start[::-1]]] = np.arange(k - 1, -1, -1)
    some = item_words > 0
    capital = (lower_of[code[start]] != code[start]) if k else np.zeros(0, bool)
    item_piece = np.zeros(items, np.int64)
    item_piece[item[piece_end]] = np.arange(pieces)
    item_end = np.flatnonzero(bound | seps)
    item_piece = piece[item_end].astype(np.int64)
    head_sign = of_sign[head] if k else np.zeros(items, bool)
    short = some & (item_words <= 8)
    high = some & ((capital[head] if k else False) | head_sign)
    n_items = np.bincount(item_piece[some], minlength=pieces)
    n_short = np.bincount(item_piece[short], minlength=pieces)
    n_high = np.bincount(item_piece[high], minlength=pieces)

    # words and phrases that come again within a few words of the same text
    word_doc = np.searchsorted(begins, start, "right") - 1
    salt = (word_doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    with np.errstate(over="ignore"):
        seen = _again(word ^ salt, np.full(k, NEAR))
        two = np.roll(word, -1) * np.uint64(0x9FB21C651E98DF25) + word
        three = np.roll(word, -2) * np.uint64(0xC2B2AE3D27D4EB4F)
        phrase = np.where(of_sign, two + three, two) ^ salt
        phrase ^= phrase >> np.uint64(33)
        phrase *= np.uint64(0xFF51AFD7ED558CCD)
    # of two short words, as in "of the", sentences are made as well
    little = ~of_sign & (length <= 3)
    weak = little & np.roll(little, -1)
    hit = _again(phrase, np.where(of_sign, SIGNS_NEAR, PHRASE_NEAR), 3) & ~weak
    covered = hit.copy()
    covered[1:] |= hit[:-1]
    if k > 2:
        covered[2:] |= hit[:-2] & of_sign[:-2]
    word_piece = piece[start]
    plain_word = plain[word_piece] if k else np.zeros(0, bool)
    covered &= plain_word
    again = np.bincount(word_piece[covered], minlength=pieces)
    recur = np.bincount(word_piece[seen & (length >= 4) & plain_word | covered], minlength=pieces)
    n_little = np.bincount(word_piece[little], minlength=pieces)

    # what a piece is; the shares that the weak labels are voted from
    is_link = (piece_links > 0) & (marks >= 0.3 * size) & (words <= 9 * piece_links) & ~(ended & (words >= 4 * piece_links))
    is_hash = hashes >= 0.45 * size
    is_repeat = (again >= 0.3 * np.maximum(words, 1)) & (again > 0) & ~is_link
    # items are counted over runs of pieces that don't end as sentences, so a list may have a line an item
    loose = ~ended & plain & ~is_link & (size > 0)
    change = np.ones(pieces, bool)
    change[1:] = (loose[1:] != loose[:-1]) | (piece_doc[1:] != piece_doc[:-1])
    change &= ~((size == 0) & np.roll(loose, 1) & np.roll(loose, -1) & (np.roll(piece_doc, 1) == piece_doc))
    block_of = np.cumsum(change) - 1
    b_words, b_items, b_short, b_high, b_little, b_recur = (
        np.bincount(block_of, weights=w)[block_of] for w in (words, n_items, n_short, n_high, n_little, recur)
    )
    is_list = loose & (b_items >= 6) & (b_short >= 0.8 * b_items) & (b_little <= 0.25 * b_words) & ((2 * b_high < b_items) | (b_recur >= 0.3 * b_words))
    line_fields = per(fields, line, lines)[piece_line]
    is_field = (line_fields > 0) & (words > 0) & ~is_link & ((line_fields > 1) | (~ended & (n_items > 1)))
    is_spam = (is_link | is_hash | is_repeat | is_list | is_field) & (size > 0)
    is_prose = ended & (words >= 6) & ~is_spam & (n_items <= 0.34 * words + 1)
    is_marked = ~plain & ~is_spam
    is_named = loose & ~is_spam & (b_items >= 6) & (2 * b_high >= b_items)
    windows = -(-np.bincount(word_doc, minlength=d) // NEAR)
    place = np.arange(k) - np.searchsorted(start, begins[word_doc]) if k else np.zeros(0, np.int64)
    block = np.cumsum(np.concatenate([[0], windows]))[:-1][word_doc] + place // NEAR if k else np.zeros(0, np.int64)
    block_hits = np.bincount(block[covered], minlength=int(windows.sum()))
    block_doc = np.repeat(np.arange(d), windows)

    out = np.zeros((len(_SUMS), d))

    def add(name: str, doc: np.ndarray, weights: np.ndarray | None = None) -> None:
        out[_AT[name]] = np.bincount(doc, weights=weights, minlength=d)

    for name, w in (
        ("size", size), ("mark", marks), ("links", piece_links), ("hashes", hashes), ("words", words), ("items", n_items), ("short_items", n_short),
        ("capital_items", n_high), ("item_words", words * (n_items > 1)), ("lists", n_items * (n_items > 1)), ("ended", size * ended), ("sentence_words", words * is_prose),
        ("pieces", size > 0), ("chunks", is_prose), ("spam", size * is_spam), ("linked", size * is_link), ("repeated", size * is_repeat),
        ("listed", size * is_list), ("fields", size * (is_field | is_hash)), ("prose", size * is_prose), ("marked", size * is_marked), ("named", size * is_named),
    ):
        add(name, piece_doc, w)
    line_words = per(start, line, lines)
    for name, w in (
        ("technical", line_technical), ("lines", line_size > 0), ("line_chars", line_size), ("line_squares", line_size.astype(float) ** 2),
        ("short_lines", line_size * ((line_words <= 8) & (line_size > 0))),
    ):
        add(name, line_doc, w)
    add("digits", np.searchsorted(begins, digit, "right") - 1)
    for name, chosen in (
        ("word_again", seen), ("long_words", length >= 4), ("long_again", seen & (length >= 4)), ("phrase_again", covered), ("short_words", little),
        ("signs", of_sign), ("capitals", capital & ~of_sign),
    ):
        add(name, word_doc[chosen])
    add("letters", word_doc, length)
    out[_AT["windows"]] = windows
    add("phrase_windows", block_doc, block_hits >= 0.3 * NEAR)
    raw = [s.encode("utf-8", "replace") for s in slices]
    out[_AT["raw"]] = list(map(len, raw))
    out[_AT["packed"]] = [len(zlib.compress(r, 1)) for r in raw]
    return out


def measure(texts: list[str]) -> np.ndarray:
    """SIGNALS and FEATURES of whole texts, one row a text.

    Texts are cut into slices of at most SLICE characters, slices measured in groups, and sums
    added up by text, so a very long text needs no more memory than a group.
    """
    sums = np.zeros((len(_SUMS), len(texts)))
    group, owner, held = [], [], 0

    def flush() -> None:
        nonlocal group, owner, held
        if group:
            np.add.at(sums, (slice(None), np.array(owner)), _sums(group))
        group, owner, held = [], [], 0

    for i, t in enumerate(texts):
        for a in range(0, len(t), SLICE):
            part = t[a : a + SLICE]
            group.append(part)
            owner.append(i)
            held += len(part)
            if held >= GROUP:
                flush()
    flush()
    s = {c: sums[i] for c, i in _AT.items()}

    def per(a: str, b: str) -> np.ndarray:
        return s[a] / np.maximum(s[b], 1)

    mean_line = per("line_chars", "lines")
    columns = [
        per("spam", "size"), per("linked", "size"), per("repeated", "size"), per("listed", "size"), per("fields", "size"), per("prose", "size"), per("marked", "size"), per("named", "size"), per("packed", "raw"),
        per("mark", "size"), 100 * per("links", "words"), per("words", "links"), per("hashes", "size"), per("digits", "size"), per("technical", "size"),
        per("items", "words"), per("item_words", "lists"), per("short_items", "items"), per("capital_items", "items"), per("ended", "size"),
        per("sentence_words", "words"), per("words", "pieces"), mean_line, per("short_lines", "size"), per("word_again", "words"), per("long_again", "long_words"),
        per("phrase_again", "words"), per("phrase_windows", "windows"), per("short_words", "words"), per("letters", "words"), per("signs", "words"), per("capitals", "words"),
        np.maximum(per("mark", "size"), per("phrase_windows", "windows")), per("packed", "raw"),
        np.sqrt(np.maximum(0.0, per("line_squares", "lines") - mean_line**2)) / np.maximum(1.0, mean_line),
    ]
    return np.stack(columns, axis=1) if texts else np.zeros((0, len(SIGNALS) + len(FEATURES)))


def features(text: str) -> list[float]:
    """SIGNALS and FEATURES of one text."""
    return measure([text])[0].tolist()


def filled_chars(text: str) -> int:
    """Characters that aren't white space."""
    return len("".join(text.split()))


def page_features(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """(id, host, size, *SIGNALS, *FEATURES), one row per row; a map over partitions."""
    rows = docs.select(F.col(key).alias("id"), F.col(host).alias("host"), F.col(text).alias("text"))
    names = [*SIGNALS, *FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            table = measure(texts)
            cols = [b.column(0), b.column(1), pa.array(list(map(filled_chars, texts)), pa.int64())]
            cols += [pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "host", "size", *names])

    kinds = dict(rows.dtypes)
    out = f"id {kinds['id']}, host {kinds['host']}, size bigint, " + ", ".join(f"{f} double" for f in names)
    return rows.mapInArrow(run, out)


def weak_label() -> Column:
    """1 where the votes say stuffed, 0 where they say clean, null where they are even.

    Two votes for stuffed each: most of the text is links; is phrases that come again and again;
    is lists of short items; is fields of shop entries or hash tags. One: the text is squeezed
    to a fifth or less. Two for clean each: most of the text is sentences; is what code, logs,
    tables and references are made of; is lists of capitalised items that don't come again. Where two kinds share a page, or nothing is clear, there
    is no label.
    """
    stuffed = [F.when(F.col(c) >= 0.5, 2).otherwise(0) for c in ("linked", "repeated", "listed", "fields")]
    squeezed = F.when((F.col("squeezed") <= 0.2) & (F.col("size") >= 500), 1).otherwise(0)
    clean = [F.when(F.col(c) >= at, 2).otherwise(0) for c, at in (("prose", 0.6), ("marked", 0.5), ("named", 0.5))]
    votes = sum(stuffed, squeezed) - sum(clean, F.lit(0))
    return F.when(votes > 0, 1.0).when(votes < 0, 0.0)


def score_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", sample: int = SAMPLE) -> DataFrame:
    """(<key>, host, p_page, host_rate, p_spam) of every row.

    Weak labels are voted from signals (``weak_label``), of which the trees see but the compression.
    Bagged trees on FEATURES, fitted on at most ``sample`` labelled pages, half of each label at most, the first
    in the order of a hash of key and features, score all pages. The spam rate of a host, over
    all its pages, shrunk to the overall rate, then shifts the page's log-odds by WEIGHT times
    its distance from the overall log-odds.

    The page's host is whatever column says where pages come from. Features are computed once
    and staged; the host rates are one aggregate with few groups, summed on the map side, so a
    host with a third of all pages is no hot group. Hosts join on the rate's key with AQE.

    Nulls: null, blank and very short texts (fewer than LEAST_CHARS characters) get p_spam 0; a
    null host has the overall rate; null keys stay. Repeated rows are scored alike. With no
    labelled page of one kind, the share of stuffed characters itself is the score. An empty
    table gives no rows.
    """
    pages = stage(page_features(docs, key, text, host), "page-features")
    long = pages.filter(F.col("size") >= LEAST_CHARS)
    labelled = long.withColumn("label", weak_label()).filter("label IS NOT NULL")
    # a share of the hashes that holds about the sample goes on, so the exact cut sees few rows,
    # and the trees see one partition whose order is fixed
    mark = F.xxhash64("id", *FEATURES)
    order = [mark, *(F.col(f) for f in FEATURES)]
    counts = dict(labelled.groupBy("label").count().collect())
    part = []
    for v in (0.0, 1.0):
        share = min(1.0, 1.1 * (sample // 2) / max(1, counts.get(v, 0)) + 1e-9)
        near = F.pmod(mark, F.lit(1 << 40)) <= F.lit(int(share * (1 << 40)))
        part.append(labelled.filter((F.col("label") == v) & near).orderBy(*order).limit(sample // 2))
    fit = stage(part[0].unionByName(part[1]).coalesce(1), "page-sample")
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="v")
    if fit.select("label").distinct().count() == 2:
        forest = RandomForestClassifier(
            featuresCol="v", labelCol="label", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="0.5", subsamplingRate=1.0, seed=SEED
        ).fit(vectors.transform(fit))
        p = vector_to_array("probability")[1]
        scored = forest.transform(vectors.transform(long)).select("id", "host", p.alias("p"))
    else:
        scored = long.select("id", "host", F.col("spam_share").alias("p"))
    rest = pages.filter(F.col("size") < LEAST_CHARS).select("id", "host", F.lit(None).cast("double").alias("p"))
    scored = stage(scored.unionByName(rest), "page-scores")
    mean = scored.agg(F.avg("p")).first()[0]
    overall = min(max(mean if mean is not None else 0.0, 1e-4), 1 - 1e-4)
    rates = scored.filter("host IS NOT NULL").groupBy("host").agg(((F.sum(F.coalesce("p", F.lit(0.0))) + PRIOR * overall) / (F.count("p") + PRIOR)).alias("rate"))
    both = scored.join(rates, "host", "left").withColumn("rate", F.coalesce("rate", F.lit(overall)))

    def logit(c: Column) -> Column:
        c = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), c))
        return F.log(c / (1 - c))

    moved = logit(F.col("p")) + WEIGHT * (logit(F.col("rate")) - logit(F.lit(overall)))
    return both.select(
        F.col("id").alias(key), "host", F.coalesce("p", F.lit(0.0)).alias("p_page"), F.col("rate").alias("host_rate"),
        F.when(F.col("p").isNull(), 0.0).otherwise(1 / (1 + F.exp(-moved))).alias("p_spam"),
    )


def spam_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", sample: int = SAMPLE) -> DataFrame:
    """(<key>) of the pages that are more likely spam than not; see ``score_pages``."""
    return score_pages(docs, key, text, host, sample).filter("p_spam > 0.5").select(key)
