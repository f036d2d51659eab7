"""Shingles by arrays against the plain definition, and sets that a third of all rows share."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lorebase.llm import neardup
from lorebase.llm.queries import QUERIES
from lorebase.llm.sql import SQL


@given(st.lists(st.text(st.sampled_from("abZ 09.\néİK中\t-"), max_size=30), max_size=8), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_shingles_are_the_sets_of_words(texts, n):
    sets = []
    for t in texts:
        w = re.findall("[a-z0-9]+", t.lower())
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    got = [set(s.tolist()) for s in neardup.shingles(texts, n)]
    assert [len(s) for s in got] == [len(s) for s in sets]
    for a, b in ((i, j) for i in range(len(texts)) for j in range(i)):
        assert len(got[a] & got[b]) == len(sets[a] & sets[b])


def test_a_text_of_a_third_of_all_rows_is_one_row(spark):
    rng = random.Random(1)
    texts = ["the same text again and again for all of these rows"] * 300 + [" ".join(str(rng.randrange(9999)) for _ in range(20)) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, texts[5])], "doc_id bigint, text string").repartition(4)
    links, members = neardup.near_duplicates(df)
    assert links.count() == 0 and members.count() == 900 and members.select("rep").distinct().count() == 601
    assert {r["rep"] for r in members.filter("doc_id < 300").collect()} == {0}


def test_links_and_members_are_queries():
    assert {"p5_links", "p5_members"} <= set(QUERIES) and {"p5_links", "p5_members"} <= set(SQL)
