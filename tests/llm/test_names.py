"""Variant spellings of names that no table knows, in several scripts."""

import itertools
import random

import pytest

from lorebase.llm import buckets, names

GIVEN = "Bartosz Lenka Anneke Tjark Oyelaran Kenji Solveig Ambrogio Katarzyna Ruaridh Ximena Goran Thandeka Aurelio Ildiko Pertti Yesenia Marguerite".split()


def entities(spark, rows):
    return {r["name"]: r["entity"] for r in names.link_variants(spark.createDataFrame([(x,) for x in rows], "name string")).collect()}


def together(got, *rows):
    return len({got[r] for r in rows}) == 1


def slipped(rng, w):
    at = rng.randrange(1, len(w) - 1)
    kind = rng.randrange(3)
    if kind == 0:
        return w[:at] + w[at + 1 :]
    if kind == 1:
        return w[:at] + rng.choice("aeioulrst") + w[at:]
    return w[:at] + w[at + 1] + w[at] + w[at + 2 :]


def people(n, seed=4):
    """Spellings of n people with different family names of three or four syllables."""
    rng = random.Random(seed)
    families = set()
    while len(families) < n:
        families.add("".join(rng.choice(["bran", "dor", "fel", "gast", "hom", "jun", "kel", "lim", "mor", "nast", "pel", "rov", "stir", "tum", "vand", "zor"]) + rng.choice("aeiou") for _ in range(3)) + rng.choice(["n", "sk", "rt", "m"]))
    out = []
    for i, family in enumerate(sorted(families)):
        g, f = GIVEN[i % len(GIVEN)], family.title()
        ways = [f"{g} {f}", f"{f} {g}", f"{f}, {g}", f"{g[0]}. {f}", f"{f}, {g[0]}.", f"{g} {f}".upper(), f"Dr. {g} {f}", f"{g} {slipped(rng, f)}", f"{slipped(rng, g)} {f}", f"  {g}  {f.lower()}", f"{f} {g[0]}"]
        out.append(sorted({ways[0], *rng.sample(ways, 4)}))
    return out


def test_held_out_given_names(spark):
    groups = people(150)
    assert not {g.lower() for g in GIVEN} & (set(names.NICKNAMES) | set(names._SHORT))
    got = entities(spark, [n for g in groups for n in g])
    want = {p for g in groups for p in itertools.combinations(g, 2)}
    by = {}
    for n, e in got.items():
        by.setdefault(e, []).append(n)
    found = {p for g in by.values() for p in itertools.combinations(sorted(g), 2)}
    assert len(found & want) >= 0.95 * len(want) and len(found & want) >= 0.95 * len(found)


def test_every_listed_name_has_short_forms_and_none_is_needed_for_the_order():
    assert len(names.NICKNAMES) < 200 and all(v.split() for v in names.NICKNAMES.values())
    for a, b in (("Weller Naledi", "Naledi Weller"), ("Weller Brandon", "Brandon Weller"), ("Osgood Kenneth", "Kenneth Osgood"), ("Katherine Osgood", "Osgood Katherine")):
        assert names.same_name(a, b)
        assert {k for k, _, _ in names.block_rows(a)} & {k for k, _, _ in names.block_rows(b)}


@pytest.mark.parametrize("a, b", [("Ken Osgood", "Kenneth Osgood"), ("Tim Osgood", "Osgood, Timothy"), ("Greg Osgood", "Gregory Osgood"), ("Paco Osgood", "Osgood Francisco"), ("Lena Osgood", "Anna-Lena Osgood"), ("Anna Lena Osgood", "Anna-Lena M. Osgood")])
def test_short_forms_share_blocks(a, b):
    assert names.same_name(a, b) and {k for k, _, _ in names.block_rows(a)} & {k for k, _, _ in names.block_rows(b)}


def test_scripts(spark):
    got = entities(spark, ["Иван Петренко", "Петренко Иван", "Петренко, И.", "Ivan Petrenko", "Иван Петренкоо", "Анна Петренко", "王小明", "王 小明", "小明 王", "王小华", "李小明", "김민서", "김 민서", "김민준", "Νίκος Παππάς", "Pappas Nikos", "أحمد الطيب", "الطيب أحمد", "محمد الطيب"])
    assert together(got, "Иван Петренко", "Петренко Иван", "Петренко, И.", "Ivan Petrenko", "Иван Петренкоо") and got["Анна Петренко"] != got["Иван Петренко"]
    assert together(got, "王小明", "王 小明", "小明 王") and len({got[n] for n in ("王小明", "王小华", "李小明")}) == 3
    assert together(got, "김민서", "김 민서") and got["김민준"] != got["김민서"]
    assert together(got, "Νίκος Παππάς", "Pappas Nikos") and together(got, "أحمد الطيب", "الطيب أحمد") and got["محمد الطيب"] != got["أحمد الطيب"]


def test_names_without_letters_have_no_block():
    assert names.block_rows("†") == names.block_rows("") == names.block_rows(" 12 ") == []
    assert names.same_name("PLATO", "Plato") and not names.same_name("†", "‡")


@pytest.mark.parametrize("block", [1, 2, 5, 100])
def test_role_pairs(spark, block):
    rng = random.Random(block)
    rows = list({(rng.randrange(5), rng.randrange(60)) for _ in range(150)})
    rows = [(k, i, i % 7 == 0, i % 3) for k, i in rows]
    df = spark.createDataFrame(rows, "key bigint, id bigint, short boolean, c int")
    got = [tuple(r) for r in buckets.role_pairs(df, "short", ["c"], lambda x, y: x("c") == y("c"), block).collect()]
    want = {(i, j) for (k, i, s, c), (m, j, t, d) in itertools.product(rows, rows) if k == m and i < j and (s or t) and c == d}
    assert len(got) == len(set(got)) and set(got) == want


def brute(rows):
    return {(x, y) for x, y in itertools.combinations(sorted(rows), 2) if names.fitting(x, y)}


def test_candidates_grow_as_what_is_alike(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("bp") + rng.choice(["a", "e", "i", "o", "u", "ai", "ou"]) + rng.choice("mn") + rng.choice("aeiou") for _ in range(2)) + rng.choice("lr") for _ in range(260)]
    people = [f"{g} {w.title()}" for i, w in enumerate(words) for g in [GIVEN[i % 3]]]
    groups = [f"{w.title()} {k}" for i, w in enumerate(words) for k in [["Institute", "Robotics Group", "Research Center"][i % 3]]]
    heads = [f"{g[0]}. {w.title()}" for i, w in enumerate(words[::3]) for g in [GIVEN[i % 3]]]
    slips = [f"{GIVEN[i % 3]} {slipped(rng, w).title()}" for i, w in enumerate(words[:60])] + [f"{slipped(rng, w).title()} Institute" for w in words[:60:3]]
    rows = sorted({*people, *groups, *heads, *slips})
    got = [tuple(r) for r in names.candidates(spark.createDataFrame([(x,) for x in rows], "id string")).collect()]
    want = brute(rows)
    assert len(want) > 100 and len(got) == len(set(got)) and want <= set(got)
    assert len(got) < 6 * len(want)  # 69,824 pairs of these share a code


def test_groups_share_a_key_only_if_two_words_at_most_differ():
    key = lambda x: set(names.blocks(names.readings(x)[0]))
    assert key("Raileth Institute").isdisjoint(key("Roludo Institute")) and key("Raileth Robotics Group").isdisjoint(key("Morvun Robotics Group"))
    for a, b in (("Raileth Institute", "Raieth Institute"), ("Raileth Research Center", "Raileht Researrch Center"), ("Raileth Robotics Group", "Group Raileth Robotics"), ("Railethovarim Institute", "Raliethvarim Institute"), ("Raileth Robotics Group", "Aileth Robtics Group"), ("Zaileth Robotics Lab", "Paileth Robotics Lab"), ("Saileth Robtics Lab", "Aileth Robotics Lab"), ("Zaileth Institute", "Aaileth Institute")):
        assert names.same_name(a, b) == (not key(a).isdisjoint(key(b))) == True, (a, b)  # noqa: E712


def test_halves():
    rng = random.Random(3)
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        at = rng.randrange(len(w))
        v = rng.choice([w[:at] + w[at + 1 :], w[:at] + "x" + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + w[at : at + 2][::-1] + w[at + 2 :]])
        assert set(names.halves(w)) & set(names.halves(v)), (w, v)
