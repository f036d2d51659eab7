"""Values typed freely, mapped to the entries of a reference list."""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts that look like Latin ones. Fixed values.
LOOKALIKES = str.maketrans(
    "аеорсхуіјѕһԁԛԝтвмнкгАЕОРСХУІЈЅТВМНКαοερτικυνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcxyijshdqwtbmhkrAEOPCXYIJSTBMHKaoeptikuvABEZHIKMNOPTYX",
)
#: Digits that stand for letters inside words. Fixed values.
LEET = str.maketrans("015", "ols")
VOWELS = set("aeiou")

#: Entries that one broadcast list may hold; longer lists are matched part by part, with the same results.
LIST_BOUND = 50_000


def fold(value: str) -> str:
    """Compatibility form, look-alikes as Latin letters, without accents."""
    text = unicodedata.normalize("NFKC", value).translate(LOOKALIKES)
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def words(folded: str) -> list[str]:
    out = []
    for w in re.findall(r"[^\W_]+", folded.lower()):
        letters = sum(c.isalpha() for c in w)
        out.append(w.translate(LEET) if letters >= 3 and letters < len(w) and not re.fullmatch(r"[a-z]+\d+", w) else w)
    return out


def camel_words(folded: str) -> list[str]:
    """Words of a text written without separators: cut before capitals and version marks."""
    spaced = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z]{2})(?=v\d+\b)|(?<=[A-Za-z]{2})(?=\d+[A-Za-z]\b)", " ", folded)
    return words(spaced)


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    # what both begin and end with costs nothing, and one edit shows in what is left
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if len(a) <= 1 and len(b) <= 1 or len(a) == len(b) == 2 and a == b[::-1]:
        return min(1, most + 1)
    if most <= 1:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, now[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        two, one = one, now
    return one[-1]


def skeleton(w: str) -> str:
    """The first letter and all consonants after it."""
    return w[:1] + "".join(c for c in w[1:] if c not in VOWELS)


def word_cost(entry: str, typed: str) -> float | None:
    """What it takes to read ``typed`` as the entry's word; None if it can't be.

    Short words and those with digits (versions, sizes) are only read literally.
    """
    if entry == typed:
        return 0.0
    if len(entry) < 4 or any(c.isdigit() for c in entry):
        return None
    best: float | None = None
    most = 1 if len(entry) < 6 else 2
    if bin(_mask(entry) ^ _mask(typed)).count("1") <= 2 * most and (d := edits(entry, typed, most)) <= most:
        best = float(d)
    if len(typed) >= 3 and len(typed) < len(entry):
        short = None
        if entry.startswith(typed):
            short = 0.8
        elif (bones := skeleton(entry)) == typed:
            short = 0.8
        elif len(typed) >= 4 and typed[0] == entry[0] and edits(entry[: len(typed)], typed, 1) <= 1:
            short = 1.6
        elif len(bones) >= 4 and typed[0] == entry[0] and edits(bones, typed, 1) <= 1:
            short = 1.6
        if short is not None and (best is None or short < best):
            best = short
    return best


def _mask(w: str) -> int:
    m = 0
    for c in w:
        m |= 1 << (ord(c) % 61)
    return m


def lesser(w: str, most: int) -> set[str]:
    """A word and what is left of it without one, or up to ``most``, of its letters."""
    out = now = {w}
    for _ in range(most):
        now = {v[:i] + v[i + 1 :] for v in now for i in range(len(v))}
        out = out | now
    return out


class WordIndex:
    """Finds the words of a list that a typed word can be read as (``word_cost``), without a scan.

    Two words at most k edits apart share what is left of their first HEAD letters without up to
    k of them; shortenings are found by their beginnings and by the letters but vowels.
    """

    HEAD = 7

    def __init__(self, listed: Iterable[str]):
        self.words = sorted(listed)
        self.known = set(self.words)
        keys: dict[Any, list[int]] = defaultdict(list)
        for i, w in enumerate(self.words):
            if len(w) < 4 or any(c.isdigit() for c in w):
                continue
            for v in lesser(w[: self.HEAD], 1 if len(w) < 6 else 2):
                keys[v].append(i)
            for n in range(4, min(self.HEAD, len(w))):
                for v in lesser(w[:n], 1):
                    keys[n, v].append(i)
            bones = skeleton(w)
            for v in lesser(bones, 1) if len(bones) >= 4 else {bones}:
                keys["b", v].append(i)
        self.keys = dict(keys)

    def costs(self, typed: str) -> dict[str, float]:
        found: set[int] = set()
        head, n = typed[: self.HEAD], len(typed)
        for v in lesser(head, 2):
            found.update(self.keys.get(v, ()))
        for v in lesser(typed, 1):
            found.update(self.keys.get(("b", v), ()))
            if n < self.HEAD:
                found.update(self.keys.get((n, v), ()))
        if n >= 3:
            for i in range(bisect_left(self.words, typed), len(self.words)):
                if not self.words[i].startswith(typed):
                    break
                found.add(i)
        out = {self.words[i]: c for i in found if (c := word_cost(self.words[i], typed)) is not None}
        if typed in self.known:
            out[typed] = 0.0
        return out


class Matcher:
    """Maps values to the entries of one field's list.

    ``evidence`` is what a list, or a part of it, has to say of a value; ``decide`` makes the
    result of what all parts say, so it does not depend on how a list is parted.
    """

    #: The highest cost of a fuzzy match, in edits a word.
    MOST_PER_WORD = 1.3

    def __init__(self, entries: list[tuple[int, str, str | None]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        named: dict[str, set[int]] = defaultdict(set)
        self.tokens: dict[int, list[str]] = {}
        self.by_word: dict[str, list[int]] = defaultdict(list)
        for canon_id, name, short in entries:
            if name is None or canon_id is None:
                continue
            ws = words(fold(name))
            if not ws:
                continue
            named["".join(ws)].add(canon_id)
            self.tokens[canon_id] = ws
            for w in set(ws):
                self.by_word[w].append(canon_id)
            if short and (alias := "".join(words(fold(short)))):
                named[alias].add(canon_id)
        for pattern, ids in named.items():
            # two ids are enough to know that a pattern stands for no single entry
            self.automaton.add_word(pattern, (len(pattern), tuple(sorted(ids)[:2])))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()
        self.index = WordIndex(self.by_word)
        self.pieces: dict[tuple[int, int, str], list[tuple[str, int, int]]] = defaultdict(list)
        for canon_id, ws in self.tokens.items():
            s = "".join(ws)
            for i, (begin, end) in enumerate(cuts(len(s))):
                self.pieces[len(s), i, s[begin:end]].append((s, _mask(s), canon_id))
        self.memo: dict[str, dict[str, float]] = {}

    def match(self, value: str) -> tuple[int, float]:
        """(canon_id, cost); canon_id 0 if no entry is meant or several are as near."""
        return decide([self.evidence(value)])

    def evidence(self, value: str, all_of_it: bool = False) -> Evidence:
        """What the list says of a value; without ``all_of_it`` only as far as it decides alone."""
        if self.empty:
            return [], [], None, None
        folded = fold(value)
        hits = self.mentions(words(folded))
        if not all_of_it and settled(hits):
            return hits, [], None, None
        camel = self.mentions(camel_words(folded))
        if not all_of_it and settled(camel):
            return hits, camel, None, None
        bare = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", folded)
        best: dict[int, float] = {}
        for ws in {tuple(words(bare)), tuple(camel_words(bare))}:
            for canon_id, cost in self.by_words(ws).items():
                best[canon_id] = min(cost, best.get(canon_id, 99.0))
        read = least(best)
        return hits, camel, read, least(self.by_edits("".join(words(bare)))) if all_of_it or read is None else None

    def mentions(self, ws: list[str]) -> list[tuple[int, int, int]]:
        """(size, begin, canon_id) of the names and aliases that a text holds.

        The text is searched without separators; a mention must begin and end with a word.
        """
        text = "".join(ws)
        if not text:
            return []
        begins, ends, at = set(), set(), 0
        for w in ws:
            begins.add(at)
            at += len(w)
            ends.add(at)
        return [
            (size, end + 1 - size, canon_id)
            for end, (size, ids) in self.automaton.iter(text)
            if end + 1 in ends and end + 1 - size in begins
            for canon_id in ids
        ]

    def costs(self, typed: str) -> dict[str, float]:
        """Entry words that a typed word can be read as; remembered, in a bounded table."""
        got = self.memo.get(typed)
        if got is None:
            got = self.index.costs(typed)
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[typed] = got
        return got

    def by_words(self, ws: tuple[str, ...]) -> dict[int, float]:
        """Token-set similarity: entries all of whose words are read from different typed words, in
        any order; typed words beyond the set cost a little each."""
        read = [r for w in ws if (r := self.costs(w))]
        counts: dict[int, int] = defaultdict(int)
        for w in {w for r in read for w in r}:
            for canon_id in self.by_word[w]:
                counts[canon_id] += 1
        out = {}
        for canon_id, n in counts.items():
            need = self.tokens[canon_id]
            extra = len(ws) - len(need)
            if n < len(set(need)) or extra > max(3, len(need)):
                continue
            total = self.assign(need, read)
            if total is not None and total <= self.MOST_PER_WORD * len(need):
                out[canon_id] = total + 0.05 * max(0, extra)
        return out

    @staticmethod
    def assign(need: list[str], read: list[dict[str, float]]) -> float | None:
        """The cheapest way to give each needed word its own typed word.

        Only typed words that can be read as a needed one count; a word typed several times is
        one with so many uses, so repeats don't multiply the sets."""
        uses: dict[int, list[Any]] = {}
        for r in read:
            if not r.keys().isdisjoint(need):
                uses.setdefault(id(r), [r, 0])[1] += 1
        width = len(read).bit_length()
        typed = [(r, most, i * width) for i, (r, most) in enumerate(uses.values())]
        best: dict[int, float] = {0: 0.0}  # uses of each typed word, in bits -> cost
        for w in need:
            step: dict[int, float] = {}
            for used, cost in best.items():
                for r, most, at in typed:
                    if w in r and (used >> at & (1 << width) - 1) < most:
                        k = used + (1 << at)
                        if cost + r[w] < step.get(k, 99.0):
                            step[k] = cost + r[w]
            best = step
        return min(best.values(), default=None)

    def by_edits(self, text: str) -> dict[int, float]:
        """Entries whose letters, without separators, are a few edits from the text's: two, and
        for longer texts one for six letters, up to four.

        An edit touches at most two of the pieces that an entry is cut into (``cuts``), so one
        piece is left whole, at most as many places away as there are edits."""
        out: dict[int, float] = {}
        if len(text) >= 8:
            most = min(4, max(2, len(text) // 6))
            mask = _mask(text)
            for n in range(len(text) - most, len(text) + most + 1):
                for i, (begin, end) in enumerate(cuts(n)):
                    for at in range(max(0, begin - most), min(len(text), begin + most) + 1):
                        for s, m, canon_id in self.pieces.get((n, i, text[at : at + end - begin]), ()):
                            if canon_id not in out and bin(mask ^ m).count("1") <= 2 * most and (d := edits(s, text, most)) <= most:
                                out[canon_id] = float(d)
        return out


#: Mentions in the value as it is and cut at capitals; least costs by words and by letters, each with the ids.
Mentions = list[tuple[int, int, int]]
Least = tuple[float, list[int]] | None
Evidence = tuple[Mentions, Mentions, Least, Least]


def cuts(n: int) -> list[tuple[int, int]]:
    """Bounds of the pieces of an entry of n letters: more than twice as many as edits."""
    pieces = min(n, 2 * min(4, max(2, (n + 4) // 6)) + 1)
    return [(i * n // pieces, (i + 1) * n // pieces) for i in range(pieces)]


def least(costs: dict[int, float]) -> Least:
    """The least cost and the entries that have it, two at most: two are as good as none."""
    if not costs:
        return None
    low = min(costs.values())
    return low, sorted(k for k, v in costs.items() if v <= low + 1e-9)[:2]


def settled(hits: Mentions) -> int:
    """The entry that the longest non-overlapping mentions name, if they name just one, or 0.

    A name that two entries share is no mention of either."""
    at: dict[tuple[int, int], set[int]] = defaultdict(set)
    for size, begin, canon_id in hits:
        at[size, begin].add(canon_id)
    taken: list[tuple[int, int]] = []
    ids: set[int] = set()
    for size, begin in sorted((k for k, v in at.items() if len(v) == 1), key=lambda h: (-h[0], h[1])):
        if all(begin + size <= a or begin >= b for a, b in taken):
            taken.append((begin, begin + size))
            ids |= at[size, begin]
    return next(iter(ids)) if len(ids) == 1 else 0


def decide(parts: list[Evidence]) -> tuple[int, float]:
    """(canon_id, cost) from what all parts of a list say of a value."""
    for k in (0, 1):
        if found := settled([tuple(h) for p in parts for h in p[k]]):
            return found, 0.0
    for k in (2, 3):
        said = [p[k] for p in parts if p[k] is not None]
        if said:
            low = min(cost for cost, _ in said)
            ids = {i for cost, at in said if cost <= low + 1e-9 for i in at}
            return (next(iter(ids)), low) if len(ids) == 1 else (0, low)
    return 0, 0.0


def distinct_values(values: DataFrame) -> DataFrame:
    return values.select("field", "raw_value").distinct()


def map_values(values: DataFrame, entries: DataFrame, bound: int = LIST_BOUND) -> DataFrame:
    """(field, raw_value, canon_id) of each distinct (field, raw_value); canon_id 0 if none.

    Values are brought down to distinct ones first and spread over as many tasks as a shuffle
    has: names repeat, so the matching, the only part in Python, works on what is new. The list
    is collected and broadcast in parts of at most ``bound`` entries. With one part the list is
    asked only as far as it must be; with more, all parts say what they know of a value
    (``Matcher.evidence``) and the result is decided on all of it, so it is the same for any bound.

    Nulls: a null value or field is dropped, a null name or id in the list too, a null alias is
    no alias. A blank value maps to 0. Two entries that are equally near: 0. Repeated rows change
    nothing; an empty list maps everything to 0; an empty table gives an empty result. A name
    that two entries share after folding is no pattern for either.
    """
    wanted = distinct_values(values.filter("field IS NOT NULL AND raw_value IS NOT NULL"))
    wanted = wanted.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), "field", "raw_value")
    listed = entries.select(
        F.col("field").alias("f"), F.col("canon_id").alias("c"), F.col("name").alias("n"), F.col("short_name").alias("s")
    ).filter("c IS NOT NULL AND n IS NOT NULL AND f IS NOT NULL")
    parts = max(1, -(-listed.count() // bound))
    if parts == 1:
        return _map_part(wanted, [tuple(r) for r in listed.collect()], False).select("field", "raw_value", "canon_id")
    said = None
    for part in range(parts):
        own = listed.filter(F.pmod(F.xxhash64("c"), F.lit(parts)) == part)
        one = _map_part(wanted, [tuple(r) for r in own.collect()], True).select("field", "raw_value", "evidence")
        said = one if said is None else said.unionByName(one)
    assert said is not None
    together = said.groupBy("field", "raw_value").agg(F.collect_list("evidence").alias("evidence"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [decide([json.loads(e) for e in parts])[0] for parts in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.int64())], names=["field", "raw_value", "canon_id"])

    return together.mapInArrow(run, "field string, raw_value string, canon_id bigint")


def _map_part(wanted: DataFrame, rows: list[tuple[Any, ...]], all_of_it: bool) -> DataFrame:
    """(field, raw_value, canon_id, evidence): what a list decides, or all that it says, as JSON."""
    shared = wanted.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_field: dict[str, list[tuple[int, str, str | None]]] = defaultdict(list)
        for f, c, n, s in shared.value:
            by_field[f].append((c, n, s))
        matchers: dict[str, Matcher] = {}
        for b in batches:
            ids, told = [], []
            for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if f not in matchers:
                    matchers[f] = Matcher(by_field.get(f, []))
                said = matchers[f].evidence(v, all_of_it)
                ids.append(decide([said])[0])
                told.append(json.dumps(said) if all_of_it else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(ids, pa.int64()), pa.array(told, pa.string())], names=["field", "raw_value", "canon_id", "evidence"]
            )

    return wanted.mapInArrow(run, "field string, raw_value string, canon_id bigint, evidence string")


def map_to_list(values: DataFrame, entries: DataFrame, bound: int = LIST_BOUND) -> DataFrame:
    """(source_table, record_key, raw_value, canon_id), distinct, of the values (source_table,
    record_key, field, raw_value) that are neither null, nor blank, nor literally an entry's name.

    See ``map_values`` for the rules. The join back is on (field, raw_value), after both sides
    were made distinct; AQE splits it where one spelling is very frequent.
    """
    names = entries.select("field", F.col("name").alias("raw_value")).filter("raw_value IS NOT NULL").distinct()
    open_ = (
        values.select("source_table", "record_key", "field", "raw_value")
        .filter(F.col("raw_value").rlike(r"(?U)[^\s\x1c-\x1f]"))
        .distinct()
        .join(names, ["field", "raw_value"], "left_anti")
    )
    ids = map_values(open_, entries, bound)
    return open_.join(ids, ["field", "raw_value"]).select("source_table", "record_key", "raw_value", "canon_id")
