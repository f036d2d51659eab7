"""Operators for training data on small rows, against brute force, round trips and hand-made cases."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorebase.llm import buckets, canon, cooccur, mixing, names, neardup, spam, tokenise
from lorebase.llm.queries import QUERIES
from lorebase.llm.sql import SQL

VOCABULARY = f"{tokenise.TOKENIZERS}/{tokenise.BYTE_BPE}"


def test_queries_are_named_after_problems():
    assert set(SQL) <= set(QUERIES) and all(re.match(r"p[2-8]_", q) for q in QUERIES)


# --- pairs -----------------------------------------------------------------------------------


def brute_pairs(records, support, lift):
    sets = [{re.sub(r"[\s_-]+", " ", x.lower()).strip() for x in r if x is not None} - {""} for r in records if r]
    sets = [s for s in sets if s]
    n, one, two = len(sets), {}, {}
    for s in sets:
        for a in s:
            one[a] = one.get(a, 0) + 1
        for p in itertools.combinations(sorted(s), 2):
            two[p] = two.get(p, 0) + 1
    return {(a, b, c) for (a, b), c in two.items() if c >= support and c * n >= lift * one[a] * one[b]}


@pytest.mark.parametrize("support, lift", [(1, 1), (2, 2), (5, 4)])
def test_pairs(spark, support, lift):
    rng = random.Random(3)
    items = ["a", "B ", "b", "c-d", "C  D", "e_f", "", None, "g", "h", "i", "\tj"]
    records = [rng.choices(items, k=rng.randint(0, 5)) for _ in range(300)] + [["x", "y"]] * 40 + [None, [], [None], ["", " "]]
    df = spark.createDataFrame([(r, 1) for r in records], "items array<string>, w int")
    got = {(r["item_a"], r["item_b"], r["n_both"]) for r in cooccur.frequent_pairs(df, "items", support, lift).collect()}
    assert got == brute_pairs(records, support, lift)
    assert cooccur.frequent_pairs(df.limit(0)).count() == 0


def test_scores_and_latest(spark):
    df = spark.createDataFrame([(["a", "b"],)] * 3 + [(["a"],), (["c"],)], "items array<string>")
    r = cooccur.frequent_pairs(df, min_support=1, min_lift=1).first()
    assert (r["n_both"], r["n_a"], r["n_b"], r["n"]) == (3, 4, 3, 5) and abs(r["lift"] - 1.25) < 1e-12
    assert abs(r["conviction_ab"] - (1 - 3 / 5) / (1 - 3 / 4)) < 1e-12 and r["conviction_ba"] is None
    rows = [("k", "2024-01-01", ["old"]), ("k", None, ["none"]), ("k", "2024-01-02", ["new"]), (None, "2024-01-02", ["x"]), ("m", None, None)]
    latest = cooccur.latest_per_key(spark.createDataFrame(rows, "k string, at string, items array<string>"), F.col("k"), "at", "items")
    assert {str(r[0]) for r in latest.collect()} == {"['new']", "None"}


# --- canonical names -------------------------------------------------------------------------

ENTRIES = [
    (1, "benchmark", "Granary Mapping", None), (2, "benchmark", "Belfry Tracking Arena 2D", "BTAR-2D"), (3, "benchmark", "Belfry Tracking Arena 3D", "BTAR-3D"),
    (4, "benchmark", "Jetty Delivery Long", None), (5, "benchmark", "Jetty Delivery Short", None), (6, "benchmark", "Arcade Instruction Challenge", "AICH"),
    (7, "method_name", "Narenon Reasoner v1", None), (8, "method_name", "Narenon Reasoner v2", None), (9, "benchmark", None, "X"), (None, "benchmark", "Y", None),
]


@pytest.mark.parametrize(
    "typed, canon_id",
    [
        ("GranaryMapping", 1), ("Granary  Mppng", 1), ("gRANARY mAPPING", 1), ("granayr mapping", 1), ("Ｇｒａｎａｒｙ Mapping", 1), ("The Granary Mapp. [7]", 1), ("Mapping Granary", 1),
        ("Grаnаry Mapping†", 1), ("Belfry/Tracking/Arena/2D", 2), ("b.t.a.r.-3d*", 3), ("Belfry Tracking Arena", 0), ("Belfry Tracking Arean 3D, 2024", 3), ("jetty delivery", 0),
        ("our Jetty Delivery Shrt (val unseen)", 5), ("aich", 6), ("Arcade Painting Challenge", 0), ("", 0), ("---", 0), ("N/A", 0), ("Granary Folding 10k", 0), ("Jetty Delivery Long Jetty Delivery Short", 0),
    ],
)
def test_matcher(typed, canon_id):
    m = canon.Matcher([(i, n, s) for i, f, n, s in ENTRIES if f == "benchmark"])
    assert m.match(typed)[0] == canon_id


def test_versions_stay_apart():
    m = canon.Matcher([(i, n, s) for i, f, n, s in ENTRIES if f == "method_name"])
    assert [m.match(x)[0] for x in ("NarenonRеаsоnerv1", "Narenon Reasnoer v2", "Narenon Reasoner", "v1")] == [7, 8, 0, 0]
    assert canon.Matcher([]).match("x") == (0, 0.0)


@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
@settings(max_examples=150, deadline=None)
def test_edits(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    assert canon.edits(a, b, 20) == d[-1][-1] and canon.edits(a, b, 1) == min(2, d[-1][-1])


@pytest.mark.parametrize("bound", [100, 3])
def test_mapping(spark, bound):
    entries = spark.createDataFrame(ENTRIES, "canon_id bigint, field string, name string, short_name string").withColumn("raw_value", F.lit("clash"))
    rows = [("s", "1", "benchmark", v) for v in ("Granary Mapping", "granary mapping", "granary mapping", " ", "", None, "Nothing Like It", "btar-2d")] + [("d", None, "method_name", "granary mapping")]
    values = spark.createDataFrame(rows, "source_table string, record_key string, field string, raw_value string").withColumn("name", F.lit("clash"))
    got = sorted(map(tuple, canon.map_to_list(values, entries, bound).collect()), key=str)
    assert got == sorted([("s", "1", "granary mapping", 1), ("s", "1", "Nothing Like It", 0), ("s", "1", "btar-2d", 2), ("d", None, "granary mapping", 0)], key=str)
    assert canon.map_to_list(values.limit(0), entries, bound).count() == 0
    assert {r["canon_id"] for r in canon.map_to_list(values, entries.limit(0), bound).collect()} == {0}


# --- names -----------------------------------------------------------------------------------

PEOPLE = [
    ["Elizabeth N. Dobruard", "E. Dobruard", "E. N. Dobruard", " Elizabeth Dobrruard", "Dobruard, Liz", "ELIZABETH DOBRUARD", "Dr. Elizabeth Dobruard, PhD", "Xlizabeth Dobruard"],
    ["Jean-Luc Draitvlunard", "J.-L. Draitvlunard", "Draitvlunard, Jean-Luc"], ["Tomáš G. Daiéda"], ["Tomáš K. Daiéda"], ["Zoë Dobruard"],
    ['Victoria "Tori" Dairreilard', "Tori Dairreilard", "V. A. Dairreilard", "Victoria A. Dairreilard"], ["The Pekzhirn Research Center", "Pekzhirn Research Center (on behalf of)", "Research Center Pekzhirn"],
    ["Railviovar Collaboration", "Railviovar Collaborstion"], ["Railviovar Institute"], ["Gabriella T. Doumström", "GT Doumström", "Gabriella Doumstrom"],
]


def test_names(spark):
    rows = [(n, 1) for group in PEOPLE for n in group] * 2 + [(None, 1), ("", 1), ("  ", 1), ("†", 1)]
    linked = names.link_variants(spark.createDataFrame(rows, "name string, entity int"))
    got = {}
    for r in linked.collect():
        got.setdefault(r["entity"], set()).add(r["name"])
    assert {frozenset(s) for s in got.values() if len(s) > 1} == {frozenset(g) for g in PEOPLE if len(g) > 1}
    pairs = {tuple(r) for r in names.variant_pairs(linked).collect()}
    assert pairs == {p for g in PEOPLE for p in itertools.combinations(sorted(g), 2)}
    assert names.link_variants(linked.select("name").limit(0)).count() == 0


def test_an_open_choice_is_not_made(spark):
    rows = ["Tomáš G. Daiéda", "Tomáš K. Daiéda", "Tomáš Daiéda", "T. Daiéda", "Omar Vitovar", "Otto Vitovar", "O. Vitovar"]
    linked = {r["name"]: r["entity"] for r in names.link_variants(spark.createDataFrame([(x,) for x in rows], "name string")).collect()}
    assert linked["Tomáš G. Daiéda"] != linked["Tomáš K. Daiéda"] and linked["Omar Vitovar"] != linked["Otto Vitovar"]
    assert linked["T. Daiéda"] == linked["Tomáš Daiéda"] and linked["O. Vitovar"] == "O. Vitovar"


def test_jaro_winkler():
    assert abs(names.jaro_winkler("martha", "marhta") - 0.9611) < 1e-4 and abs(names.jaro_winkler("dixon", "dicksonx") - 0.8133) < 1e-4
    assert names.jaro_winkler("", "a") == 0.0 and names.jaro_winkler("a", "a") == 1.0


# --- buckets and near-duplicates -------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 2, 5, 100])
def test_bucket_pairs(spark, block):
    rows = [(k, i) for i in range(40) for k in ([0] if i < 25 else []) + [1 + i % 7]]
    members = buckets.crowded_members(spark.createDataFrame(rows, "key bigint, id bigint"), block)
    got = [tuple(r) for r in buckets.bucket_pairs(members, []).collect()]
    want = {(i, j) for (k, i), (m, j) in itertools.product(rows, rows) if k == m and i < j}
    assert len(got) == len(set(got)) and set(got) == want


def corpus():
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(rng.randint(30, 90))) for _ in range(60)]
    texts = list(base)
    for t in base[:40]:
        w = t.split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = "edit"
        texts.append(" ".join(w).upper() + "!")
    return texts + [base[0]] * 5 + ["too short", "", None, "x"]


def brute_similar(texts, n, threshold):
    sets = []
    for t in texts:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    return {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}


@pytest.mark.parametrize("n, threshold", [(3, 0.5), (5, 0.8)])
def test_near_duplicates(spark, n, threshold):
    texts = corpus()
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, texts[0], 0)], "doc_id bigint, text string, rep int").repartition(3)
    links, members = neardup.near_duplicates(df, n=n, threshold=threshold)
    got = [tuple(r) for r in neardup.all_pairs(links, members, "doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_similar(texts, n, threshold)
    assert links.filter(f"jaccard < {threshold}").count() == 0


def test_near_duplicates_of_nothing(spark):
    links, members = neardup.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string"))
    assert links.count() == 0 and members.count() == 0


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    signer = neardup.Signer(4, 107)
    for j in (0.5, 0.7, 0.9):
        errors = []
        for _ in range(20):
            shared = rng.integers(0, 2**63, size=int(400 * j), dtype=np.uint64)
            rest = (400 - len(shared)) // 2
            a, b = (np.concatenate([shared, rng.integers(0, 2**63, size=rest, dtype=np.uint64)]) for _ in range(2))
            (ka, sa), (kb, sb) = signer.sign(a), signer.sign(b)
            differ = sum(bin(int(x) & (2**64 - 1)).count("1") for x in (sa ^ sb))
            assert differ <= neardup.most_differing_bits(j) and (ka == kb).any()
            errors.append(neardup.estimate(differ) - j)
        assert abs(np.mean(errors)) < 0.05
    rows, bands = neardup.banding(0.5)
    assert rows * bands <= neardup.MOST_HASHES and (1 - 0.5**rows) ** bands <= neardup.MISS
    assert neardup.banding(1.0)[1] >= 1


# --- tokens ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, "rb") as f:
        return tokenise.Encoder(tokenise.read_ranks(f.read()), tokenise.class_table(tokenise.class_runs()))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokenise.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


ODD = ["", " ", "a", "it's 'tis ''s 's's  don't  I'LL we've", "<|endoftext|>x", "\n\n a\r\n\tb  ", "中文 ，。é😀 1２३", "x" * 700, " " * 300 + "a", "ab" * 400, "a　 b c\u0085d", "'" * 50, "﻿a​b", "é̀"]


def test_tokens_of_odd_texts(encoder, library):
    assert encoder.encode(pa.array(ODD))[0].to_pylist() == library(ODD)


@given(st.lists(st.text(st.one_of(st.sampled_from(" '\tsrtevlmd.1é中\n　"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=8))
@settings(max_examples=200, deadline=None)
def test_tokens_equal_the_library(encoder, library, texts):
    ids, firsts = encoder.encode(pa.array(texts, pa.string()), "offsets")
    assert ids.to_pylist() == library(texts)
    for t, i, f in zip(texts, ids.to_pylist(), firsts.to_pylist(), strict=True):
        pieces = [encoder.bytes_of(k) for k in i]
        assert b"".join(pieces) == t.encode() and f == list(itertools.accumulate(map(len, pieces), initial=0))[:-1]
        assert encoder.decode(i) == t


def test_long_texts_are_cut_at_safe_places(encoder, library, monkeypatch):
    texts = ["word 'll  it's\n\n" * 30 + "z" * 90, "é" * 200, "", "short"]
    whole = library(texts)
    monkeypatch.setattr(tokenise, "CHUNK_BYTES", 64)
    ids, firsts = encoder.encode(pa.array(texts), "offsets")
    assert ids.to_pylist() == whole and encoder.encode(pa.array(texts), "count")[0].to_pylist() == list(map(len, whole))
    assert firsts.to_pylist()[0] == list(itertools.accumulate((len(encoder.bytes_of(k)) for k in whole[0]), initial=0))[:-1]


def test_scan_is_the_automaton(encoder):
    rng = np.random.default_rng(2)
    classes = rng.choice([tokenise.SPACE, tokenise.WHITE, tokenise.LETTER, tokenise.OTHER, tokenise.QUOTE, tokenise.QUOTE, tokenise.QUOTE], size=500).astype(np.uint8)
    starts, state, want = np.array([0, 37, 38, 300]), tokenise.OPEN, []
    for i, c in enumerate(classes):
        state = tokenise._STEP[int(c)][tokenise.OPEN if i in starts else state]
        if c == tokenise.QUOTE and state == tokenise.MARK:
            want.append(i)
    assert tokenise.marks(classes, starts).tolist() == want


def test_bytes_that_are_no_text(encoder, library):
    raw = pa.array([b"a\xffb", b"ok"], pa.binary())
    assert encoder.encode(raw)[0].to_pylist() == library(["a�b", "ok"])


def test_encode(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(100, None, "x"), (None, "a b", None), (3, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    got = sorted(((r["doc_id"], list(r["ids"])) for r in tokenise.encode(df).collect()), key=str)
    assert got == sorted(((i, ids) for (i, _, _), ids in zip(rows, library([t or "" for _, t, _ in rows]), strict=True)), key=str)
    assert tokenise.encode(df, want="count").agg(F.sum("n_tokens")).first()[0] == sum(len(i) for _, i in got)
    assert tokenise.encode(df, want="offsets", keep=("ids",)).columns == ["doc_id", "ids", "ids", "offsets"] and tokenise.encode(df.limit(0)).count() == 0


# --- mixing ----------------------------------------------------------------------------------

TARGETS = "source string, target_share double, max_repeats int"


def mixed(spark, docs, targets, **more):
    d = spark.createDataFrame([(i, s, t, 0) for i, (s, t) in enumerate(docs)], "doc_id bigint, source string, text string, copies int").repartition(3)
    t = spark.createDataFrame(targets, TARGETS)
    m = mixing.mix(d, t, **more)
    return m, {r["source"]: r for r in mixing.shares(m, t).collect()}


def test_shares_are_reached(spark):
    rng = random.Random(1)
    sizes = {"a": 600, "b": 80, "c": 300, "big": 400}
    docs = [(s, " ".join(["word"] * rng.randint(1, 60))) for s, n in sizes.items() for _ in range(n)] + [("a", None), ("a", ""), (None, "x"), ("unlisted", "y z")]
    targets = [("a", 0.4, 1), ("b", 0.2, 3), ("c", 0.3, 2), ("none", 0.1, 5), (None, 0.0, 1), ("big", 0.0, 9)]
    m, got = mixed(spark, docs, targets)
    assert abs(sum(r["share"] for r in got.values()) - 1) < 1e-9 and got["none"]["tokens"] == got["big"]["tokens"] == 0
    for s, share, most in targets[:3]:
        assert abs(got[s]["share"] - share / 0.9) < 0.005 and got[s]["most_copies"] <= most
    assert {r[0] for r in m.select("source").distinct().collect()} == {"a", "b", "c"} and m.count() == m.select("doc_id").distinct().count()
    m, got = mixed(spark, docs, targets, total_tokens="listed_tokens")
    assert got["b"]["n_copies"] == 3 * 80 and got["b"]["share"] < 0.2
    assert abs(got["a"]["share"] / got["c"]["share"] - 4 / 3) < 0.02 or got["a"]["n_copies"] == 600
    assert mixing.copies_of(spark.range(len(docs)).withColumnRenamed("id", "doc_id"), m).count() == sum(r["n_copies"] for r in got.values())


def test_mix_of_nothing(spark):
    m, got = mixed(spark, [("a", None)], [("a", 1.0, 2), ("b", None, None)])
    assert m.count() == 0 and got["a"]["share"] == 0.0


def test_goals():
    s = {"x": mixing.Source(0.5, 1, 10, 100), "y": mixing.Source(0.3, 2, 1, 10), "z": mixing.Source(0.2, 1, 0, 0)}
    mixing.goals(s, 80.0)
    assert (s["y"].goal, s["z"].goal, s["x"].goal) == (20.0, 0.0, 60.0)
    assert mixing.nearest_total(s) == pytest.approx(20 * 0.8 / 0.3)


# --- spam ------------------------------------------------------------------------------------

SENTENCES = "We study how a map can support a robot when the sensor is gone. The key idea is to let the planner ask the memory before it acts. Results hold for offices as well as for halls. "
SPAM = [
    "cheap drone near me Oslo, cheap drone near me Rome | cheap drone near me Paris " * 8, "[best mower deals](https://a.test/x) | [buy template coupon](https://b.test/y) · " * 9,
    "".join(f"https://site{i}.test/page-{i}\n" for i in range(12)), "#BuyDrone #Map #CheapMowerNearMe #FreeTemplate " * 9, "Best sensor price. Cheap sensor price. Top sensor price. " * 9,
    "".join(f"Thing XL set | SKU {i} | 9.99 | tags: cheap mower price, drone deals\n" for i in range(9)), "激光雷达 批发, 论文 代写, 传感器 团购 " * 20, SENTENCES[:120] + "\n" + "used lidar for sale, robot kit coupon, " * 20,
    "If you want lidar price, our lidar price page on lidar price has lidar price for lidar price fans. " * 7,
]
HAM = [
    SENTENCES * 3, SENTENCES + "\ncheap drone near me, buy lidar online", "".join(f"[{i}] A. Author. Title of the Paper. Proc. Things, 2020, pp. {i}-{i + 9}. https://papers.org/abs/{i}\n" for i in range(9)),
    "".join(f"* We wrote about the map of the hall. See https://lab{i}.org/x for the code of the planner.\n" for i in range(8)), "".join(f"{i}.1 The Map of the Hall ........ {i}\n" for i in range(20)),
    "".join(f"[epoch {i:03d}] loss=0.{i} lr=1e-4\n" for i in range(30)), "结果表明，场景规划器在医院走廊中经常依赖场景导航模块。我们研究语义地图如何在停车场中支持压缩导航模块。" * 4,
]


@pytest.mark.parametrize("text", SPAM)
def test_spam_share_of_spam(text):
    assert spam.features(text)[0] > 0.6


@pytest.mark.parametrize("text", HAM)
def test_spam_share_of_ham(text):
    assert spam.features(text)[0] < 0.4


def test_spam(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        bad = i % 5 == 0
        t = rng.choice(SPAM if bad else HAM)
        cut = rng.randint(0, 3)
        rows.append((i, t[cut:] + (" End of the text." if not bad else ""), "open" if bad or i % 3 else "lab", "clash"))
    extra = [(900, None, "lab", ""), (901, "", None, ""), (902, " \n ", "lab", ""), (903, "buy now", "open", ""), (904, SENTENCES * 3000, None, ""), (0, rows[0][1], "open", ""), (None, SPAM[0], None, "")]
    df = spark.createDataFrame(rows + extra, "doc_id bigint, text string, source string, host string")
    scores = [(r["doc_id"], r["p_spam"]) for r in spam.score_pages(df).collect()]
    assert len(scores) == 407
    found = {i for i, p in scores if p > 0.5}
    assert found == {i for i in range(400) if i % 5 == 0} | {None}
    assert spam.spam_pages(df.limit(0)).count() == 0
    one_kind = spam.score_pages(df.filter("doc_id < 400 AND doc_id % 5 = 1"))
    assert one_kind.filter("p_spam > 0.5").count() == 0


def test_spam_is_the_same_for_any_partitioning(spark):
    df = spark.createDataFrame([(i, (SPAM if i % 2 else HAM)[i % 7] + str(i), "s") for i in range(120)], "doc_id bigint, text string, source string")
    a, b = ({r["doc_id"]: round(r["p_spam"], 9) for r in spam.score_pages(d).collect()} for d in (df.repartition(1), df.repartition(7, "doc_id")))
    assert a == b


#: Without a word of the fixed lists: other modifiers, other languages, a keyword a line, Han without spaces.
STUFFED = [
    "robot kit Kanitz | robot kit Nenitz | robot kit Denitz, robot kit Drogate robot kit Safield " * 6,
    "tani dron Kraków, tani dron Gdańsk, tani dron Lublin; tani dron Poznań, tani dron Opole, tani dron Łódź, " * 5,
    "".join(f"robot aspirapolvere {c}\n" for c in "Roma Milano Torino Napoli Genova Verona Padova Trieste Pisa Lecce".split()) * 2,
    "kamera termowizyjna, wynajem kamera, kamera drony, kamera nocna, mała kamera, kamera polowa, kamera wodna, ",
    "If you want data labeling, our data labeling page on data labeling has data labeling for data labeling fans. " * 7,
    "扫地机器人上海扫地机器人北京扫地机器人广州扫地机器人深圳扫地机器人杭州" * 3,
    "".join(f"Vase XL | SKU {w}\n Krug M | SKU {w} | blau\n" for w in "abcdefghi"),
]
PROSE = [
    "Il robot osserva la sala, la mappa e il sensore prima di muoversi, e la memoria conserva ciò che il piano ha visto. " * 6,
    "Anna Nowak, Jan Kowalski, Maria Zielinska, Piotr Lewandowski, Ewa Wojcik, Adam Kaminski, Zofia Mazur, Marek Krawczyk",
    "".join(f"def run_{i}(map, map_{i}): return map[{i}] + map_{i}\n" for i in range(20)), "".join(f"model {c} | 0.{i} | 0.9{i} | 1.{i}\n" for i, c in enumerate("abcdefgh")),
    "".join(f"Müller A, Schmidt B, Weber C. Karten und Roboter. Verlag, ISBN 978-3-16-{i}.\n" for i in range(9)),
]


@pytest.mark.parametrize("text", STUFFED)
def test_stuffed_pages_are_found_by_structure(text):
    assert spam.features(text)[0] > 0.6


@pytest.mark.parametrize("text", PROSE)
def test_prose_names_code_tables_are_not_stuffed(text):
    assert spam.features(text)[0] < 0.4


def test_spam_without_listed_words(spark):
    rng = random.Random(9)
    rows = [(i, (rng.choice(SPAM) if i % 5 == 0 else rng.choice(HAM + PROSE))[rng.randint(0, 3) :], "open") for i in range(400)]
    rows += [(1000 + i, t, "open") for i, t in enumerate(STUFFED)]
    found = {r["doc_id"] for r in spam.spam_pages(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert found == {i for i in range(0, 400, 5)} | {1000 + i for i in range(len(STUFFED))}


def entities(spark, rows):
    return {r["name"]: r["entity"] for r in names.link_variants(spark.createDataFrame([(x,) for x in rows], "name string")).collect()}


def test_both_orders_of_unlisted_given_names(spark):
    got = entities(spark, ["Bartosz Wieczorek", "Wieczorek Bartosz", "Wieczorek, Bartosz", "B. Wieczorek", "Wieczorek Bartossz", "Lenka K. Horakova", "Horakova Lenka K.", "Lenka Svobodova", "Anneke Ruth Dijkstra", "Dijkstra Anneke Ruth"])
    assert len({got[n] for n in got if "zorek" in n}) == 1 and len({got[n] for n in got if "kova" in n}) == 1
    assert got["Anneke Ruth Dijkstra"] == got["Dijkstra Anneke Ruth"] and got["Lenka Svobodova"] == "Lenka Svobodova"


def test_an_open_order_is_not_chosen(spark):
    got = entities(spark, ["Bartosz Wieczorek", "B. Wieczorek", "W. Bartosz", "Wieczorek Bartosz"])
    assert got["Wieczorek Bartosz"] == got["Bartosz Wieczorek"] and got["B. Wieczorek"] == "B. Wieczorek" and got["W. Bartosz"] == "W. Bartosz"
    got = entities(spark, ["Bartosz Wieczorek", "B. Wieczorek", "W. Bartosz", "Witold Bartosz"])
    assert got["Bartosz Wieczorek"] == got["B. Wieczorek"] and got["Witold Bartosz"] == got["W. Bartosz"] and len(set(got.values())) == 2


@pytest.mark.parametrize("a, b", [("raiulu", "raiuku"), ("daieda", "daiea"), ("hainulu", "hainuu"), ("moore", "mooe"), ("aiuda", "aiuka"), ("moore", "moroe")])
def test_one_slip_in_a_short_family_name_leaves_a_common_key(a, b):
    x, y = (f"Omar {w.title()}" for w in (a, b))
    assert names.same_name(x, y) and not set(names.blocks(names.readings(x)[0])).isdisjoint(names.blocks(names.readings(y)[0]))


def test_one_slip_in_any_letter_leaves_a_common_key():
    rng = random.Random(2)
    for _ in range(4000):
        w = "".join(rng.choice("aeioulrkdmnst") for _ in range(rng.randint(4, 8)))
        at, c = rng.randrange(len(w)), rng.choice("aeioulrkdmnst")
        v = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :], w[:at] + c + w[at:]])
        for x, y in ((f"Omar {w.title()}", f"Omar {v.title()}"), (f"{w.title()} Institute", f"{v.title()} Institute")):
            one, two = names.readings(x)[0], names.readings(y)[0]
            if names.same_name(x, y):
                assert not set(names.blocks(one)).isdisjoint(names.blocks(two)), (x, y)


def test_one_slip_in_a_group_or_a_short_name(spark):
    got = entities(spark, ["Bruseth Institute", "Bruteth Institute", "Brusth Institute", "Daie Institute", "Daike Institute", "Omar Moore", "Omar Mooe", "Omar Railu"])
    assert got["Bruteth Institute"] == got["Bruseth Institute"] == got["Brusth Institute"] != got["Daie Institute"]
    assert got["Omar Moore"] == got["Omar Mooe"] != got["Omar Railu"]


def test_long_values_are_read_by_words():
    name = "unified benchmark suite covering robotic mapping navigation planning grasping perception memory dialogue transfer robustness"
    found = canon.Matcher([(1, name, None), (2, " ".join(["granary"] * 13), None)])
    ws = name.replace("navigation", "navigaton").replace("perception", "percepton").split()
    filler = "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12".split()
    value = " ".join(w for pair in itertools.zip_longest(reversed(ws), filler) for w in pair if w)
    assert len(value.split()) > 24 and found.match(value)[0] == 1
    assert found.match(" ".join(["granaryy"] * 26))[0] == 2


def test_assign_is_the_cheapest():
    rng = random.Random(8)
    for _ in range(300):
        need = [rng.choice("abc") for _ in range(rng.randint(1, 4))]
        typed = [{w: rng.randint(0, 8) / 8 for w in "abcd" if rng.random() < 0.6} for _ in range(3)]
        read = [rng.choice(typed) for _ in range(rng.randint(1, 5))]
        costs = [sum(read[i][w] for i, w in zip(p, need)) for p in itertools.permutations(range(len(read)), len(need)) if all(w in read[i] for i, w in zip(p, need))]
        assert canon.Matcher.assign(need, read) == min(costs, default=None)
