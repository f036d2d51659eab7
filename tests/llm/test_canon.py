"""The list matched in parts, and the indexes against a scan of the list."""

import random

import pytest
from pyspark.sql import functions as F

from lorebase.llm import canon

WORDS = "granary mapping belfry tracking arena jetty delivery arcade instruction challenge lantern retrieval orchard planner quarry ledger small large model bench v1 v2 2d 3d net xl mini tower".split()


def entries_of(rng, n):
    names = set()
    while len(names) < n:
        names.add(" ".join(rng.sample(WORDS, rng.randint(1, 4))).title())
    return [(i + 1, "f", name, "".join(w[0] for w in name.split()) + str(i % 7) if i % 3 == 0 else None) for i, name in enumerate(sorted(names))]


def typed_values(rng, entries, n):
    out = ["Netrix One vs Tabulo Two", "Netrix Small Model run", "", " ", "---"]
    for _ in range(n):
        name = rng.choice(entries)[2]
        ws = name.split()
        kind = rng.randrange(7)
        if kind == 0:
            rng.shuffle(ws)
        elif kind == 1:
            w = rng.choice(ws)
            ws[ws.index(w)] = w[:1] + w[2:]
        elif kind == 2:
            ws = [w[:3] for w in ws]
        elif kind == 3:
            ws += rng.choice(entries)[2].split()
        elif kind == 4:
            ws.append("run")
        elif kind == 5:
            ws = ["".join(ws)]
        out.append(rng.choice([str, str.lower, str.upper])(rng.choice([" ", "-", " "]).join(ws)))
    return out


@pytest.mark.parametrize("bound", [1, 7, 40])
def test_the_bound_changes_nothing(spark, bound):
    rng = random.Random(6)
    entries = entries_of(rng, 60) + [(201, "f", "Netrix One", None), (202, "f", "Tabulo Two", None), (203, "f", "netrix small", None), (204, "f", "netrix-small model", None), (205, "f", "Netrix Small", None)]
    values = spark.createDataFrame([("f", v) for v in typed_values(rng, entries, 250)], "field string, raw_value string")
    table = spark.createDataFrame(entries, "canon_id bigint, field string, name string, short_name string")
    whole = {r["raw_value"]: r["canon_id"] for r in canon.map_values(values, table).collect()}
    parts = {r["raw_value"]: r["canon_id"] for r in canon.map_values(values, table, bound).collect()}
    assert whole == parts and whole["Netrix One vs Tabulo Two"] == 0 and whole["Netrix Small Model run"] == 204
    assert sum(v > 0 for v in whole.values()) > 100


def noise(rng, w):
    for _ in range(rng.randint(0, 3)):
        at = rng.randrange(len(w) + 1)
        kind = rng.randrange(5)
        if kind == 0:
            w = w[:at] + rng.choice("aeist") + w[at:]
        elif kind == 1 and w:
            w = w[: at - 1] + w[at:] if at else w[1:]
        elif kind == 2 and 0 < at < len(w):
            w = w[: at - 1] + w[at] + w[at - 1] + w[at + 1 :]
        elif kind == 3:
            w = w[: max(3, at)]
        else:
            w = w[:1] + "".join(c for c in w[1:] if c not in "aeiou")
    return w


def test_word_index_is_the_scan():
    rng = random.Random(11)
    listed = {"".join(rng.choice("aeirstlnmg") for _ in range(rng.randint(2, 12))) for _ in range(600)} | set(WORDS)
    index = canon.WordIndex(listed)
    for w in [noise(rng, rng.choice(sorted(listed))) for _ in range(600)] + ["", "a", "zzzz", "v1"]:
        assert index.costs(w) == {x: c for x in listed if (c := canon.word_cost(x, w)) is not None}, w


def test_letters_index_is_the_scan():
    rng = random.Random(12)
    entries = entries_of(rng, 150)
    m = canon.Matcher([(i, n, s) for i, _, n, s in entries])
    for _ in range(300):
        text = noise(rng, noise(rng, "".join(canon.words(canon.fold(rng.choice(entries)[2])))))
        most = min(4, max(2, len(text) // 6))
        want = {i: float(d) for i, ws in m.tokens.items() if len(text) >= 8 and (d := canon.edits("".join(ws), text, most)) <= most}
        assert m.by_edits(text) == want, text


def test_values_are_spread_over_tasks(spark):
    values = spark.range(2000).select(F.lit("f").alias("field"), F.concat(F.lit("v"), "id").alias("raw_value"))
    table = spark.createDataFrame([(1, "f", "v1", None)], "canon_id bigint, field string, name string, short_name string")
    assert canon.map_values(values, table).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_held_out_spellings_are_found():
    """Reordered, shortened and misspelt names of entries of three words or more go to their entry."""
    rng = random.Random(3)
    entries = [e for e in entries_of(rng, 200) if len(e[2].split()) >= 3]
    m = canon.Matcher([(i, n, s) for i, _, n, s in entries])
    sets: dict[tuple[str, ...], int] = {}
    for _, _, n, _ in entries:
        k = tuple(sorted(n.lower().split()))
        sets[k] = sets.get(k, 0) + 1
    hit = all_ = 0
    for i, _, n, _ in entries:
        ws = n.lower().split()
        if sets[tuple(sorted(ws))] > 1:
            continue
        long = max(ws, key=len)
        for v in (" ".join(reversed(ws)), n.replace(" ", "-"), n.lower().replace(long, long[:2] + long[3:]), f"the {n} (ours) [3]", n.replace(" ", "")):
            all_ += 1
            hit += m.match(v)[0] == i
    assert hit >= 0.95 * all_
