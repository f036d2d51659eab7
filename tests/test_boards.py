"""Hot boards ranked in parts, and neighbours against a scan."""

import random

from lorebase.operators import leaderboard, similarity


def test_a_hot_board_is_ranked_in_parts(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), "s", "m", f"n{i:03d}", rng.choice([None, float("nan"), 1.0, 2.0, float(rng.randint(0, 30))]), rng.random() < 0.9) for i in range(400)]
    df = spark.createDataFrame([(s, "B", t, m, up, n, v, "p", i, "") for i, (s, t, m, n, v, up) in enumerate(rows)], "slug string, benchmark string, setting string, metric string, higher_is_better boolean, method string, value double, arxiv_id string, seq bigint, note string")
    whole = {(r["slug"], r["method"]): r["rank"] for r in leaderboard.ranked(df).collect()}
    monkeypatch.setattr(leaderboard, "RANKED_AT_ONCE", 10)
    parts = {(r["slug"], r["method"]): r["rank"] for r in leaderboard.ranked(df).collect()}
    assert whole == parts and len(whole) == 400 and sorted(v for (s, _), v in whole.items() if s == "a") == list(range(1, 1 + sum(s == "a" for s, _ in whole)))


def test_neighbours_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(0, 3)) for _ in range(4)]) for i in range(300)] + [(900, None), (901, [1.0]), (None, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    for prior, own in ((False, False), (True, False), (True, True), (False, True)):
        got = {}
        for r in similarity.nearest(df, df.filter("vec_id % 7 = 0"), 5, prior, own).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["vec_id"]))
        for q, v in rows[:300]:
            if q % 7 == 0:
                all_ = sorted((sum((x - y) ** 2 for x, y in zip(v, w, strict=True)), i) for i, w in rows[:300] if (i < q or not prior or (own and i == q)) and (own or i != q))
                assert sorted(got.get(q, [])) == [(n + 1, d, i) for n, (d, i) in enumerate(all_[:5])]
