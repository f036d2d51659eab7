"""Pages stuffed with keywords in words and languages that the code names nowhere."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase.llm import spam

TERMS = {
    "it": "offerte scarpe online|prezzo divano usato|sconto borse pelle|mutuo prima casa|voli economici",
    "nl": "goedkope fietsen kopen|korting schoenen|tweedehands laptop|gratis verzending bank|aanbieding tv",
    "pt": "comprar celular barato|desconto tênis feminino|frete grátis|passagens promoção|aluguel carro",
    "casino": "casino bonus|slots jackpot|poker freispiele|roulette einzahlung|bingo wett tipp",
    "fi": "halvat lennot|alennus kengät|käytetty sohva|ilmainen toimitus|tarjous puhelin",
    "ru": "дешёвые билеты|купить диван|скидка обувь|аренда машины|бесплатная доставка",
    "ja": "格安航空券|中古車販売|送料無料|激安家具|割引クーポン",
}
PROSE = {
    "it": ["La memoria della mappa conserva ciò che il robot ha visto nella sala.", "Quando il sensore manca, il piano chiede aiuto prima di agire.", "Il metodo regge anche negli uffici e nei corridoi più lunghi."],
    "nl": ["De kaart onthoudt wat de robot in de hal heeft gezien.", "Als de sensor uitvalt, vraagt de planner eerst om hulp.", "De methode werkt ook in kantoren en in lange gangen."],
    "pt": ["O mapa guarda aquilo que o robô viu no salão.", "Quando o sensor falha, o planejador pede ajuda antes de agir.", "O método funciona também em escritórios e corredores longos."],
    "casino": ["The bank asked each player for a name before the game began.", "Nobody knew why the last card was missing from the table.", "In the morning the hall was empty and the lamps were out."],
    "fi": ["Kartta muistaa sen, minkä robotti näki aulassa ennen lähtöä.", "Kun anturi puuttuu, suunnittelija pyytää ensin apua muilta.", "Menetelmä toimii myös toimistoissa ja pitkillä käytävillä."],
    "ru": ["Карта хранит то, что робот видел в зале перед уходом.", "Когда датчик пропал, планировщик сначала просит о помощи.", "Метод работает и в офисах, и в длинных коридорах."],
    "ja": ["地図はロボットが廊下で見たものを覚えている。", "センサーが使えないとき、計画器はまず助けを求める。", "この方法は事務所でも長い通路でも役に立つ。"],
}
PLACES = "Roma Oslo Lyon Graz Brno Porto Turku Gent Vigo Pisa Kiel Bath Łódź Nara Omsk".split()


def stuffed(rng, lang):
    terms = TERMS[lang].split("|")
    kind = rng.randrange(6)
    term = rng.choice(terms)
    if kind == 0:
        return " | ".join(f"{term} {rng.choice(PLACES)}" for _ in range(rng.randint(12, 40)))
    if kind == 1:
        return "\n".join(f"{rng.choice(terms)} {rng.choice(PLACES).lower()}" for _ in range(rng.randint(12, 40)))
    if kind == 2:
        return " ".join("#" + rng.choice(terms).title().replace(" ", "") for _ in range(rng.randint(10, 40)))
    if kind == 3:
        return " · ".join(f"[{rng.choice(terms)}](https://s{rng.randint(1, 999)}.test/p{i})" for i in range(rng.randint(8, 25)))
    if kind == 4:
        return " ".join(f"{term}, {term} {rng.choice(PLACES)}. {term}!" for _ in range(rng.randint(6, 18)))
    return ", ".join(rng.choice(terms) for _ in range(rng.randint(14, 50)))


def prose(rng, lang, n=(4, 14)):
    """Sentences in turn, so that none follows itself as it does on stuffed pages."""
    first = rng.randrange(3)
    return " ".join(PROSE[lang][(first + i) % 3] for i in range(rng.randint(*n)))


def page(rng, lang, bad):
    if bad:
        text = stuffed(rng, lang)
        if rng.random() < 0.4:
            text = PROSE[lang][0] + "\n" + text + "\n" + PROSE[lang][1]
        return text if 0.55 * len(text) > (len(PROSE[lang][0]) + len(PROSE[lang][1])) else text * 3
    kind = rng.randrange(5)
    if kind == 0:
        return "\n".join(f"[{i}] {rng.choice(PLACES)} A., {rng.choice(PLACES)} B. {rng.choice(PROSE[lang])} Proc. 20{i:02d}, pp. {i}-{i + 9}." for i in range(10, 22))
    if kind == 1:
        return "\n".join(f"| {rng.choice(PLACES)}Net | {rng.random():.3f} | {rng.random():.3f} | {i} |" for i in range(12, 30))
    if kind == 2:
        return prose(rng, lang, (8, 16)) + "\n" + stuffed(rng, lang)[:60]
    return prose(rng, lang)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(12)
    rows = []
    for i in range(1400):
        lang = list(TERMS)[i % len(TERMS)]
        bad = i % 5 == 0
        rows.append((i, page(rng, lang, bad), "open" if bad or i % 3 else "lab", bad))
    return rows


def test_held_out_vocabularies_and_languages(spark, pages):
    df = spark.createDataFrame(pages, "doc_id bigint, text string, source string, bad boolean")
    found = {r["doc_id"] for r in spam.spam_pages(df).collect()}
    true = {i for i, _, _, bad in pages if bad}
    assert len(found & true) >= 0.95 * len(true) and len(found & true) >= 0.95 * len(found)


def test_trees_are_no_restatement_of_the_labels(spark, pages):
    df = spark.createDataFrame(pages, "doc_id bigint, text string, source string, bad boolean")
    labels = {r["id"]: r["label"] for r in spam.page_features(df, "doc_id", "text", "source").select("id", spam.weak_label().alias("label")).collect()}
    scores = {r["doc_id"]: r["p_page"] for r in spam.score_pages(df).collect()}
    decided = {i for i, v in labels.items() if v is not None}
    assert 0.5 * len(labels) < len(decided) < len(labels)
    assert not set(spam.SIGNALS) & set(spam.FEATURES)
    # pages without a label are decided by the trees, most of them rightly
    rest = [i for i in labels if i not in decided]
    assert np.mean([(scores[i] > 0.5) == pages[i][3] for i in rest]) >= 0.8


def test_hosts_move_pages_in_doubt(spark):
    rng = random.Random(3)
    rows = [(i, page(rng, "it", i % 2 == 0), "bad" if i % 2 == 0 else "good") for i in range(300)]
    mixed = [prose(rng, "it", (n, n)) + "\n" + "\n".join(f"sconto borse pelle {p.lower()}" for p in PLACES[:k]) for n in range(2, 7) for k in range(2, 15, 2)]
    rows += [(1000 + i, t, "bad") for i, t in enumerate(mixed)] + [(2000 + i, t, "good") for i, t in enumerate(mixed)]
    s = {r["doc_id"]: r for r in spam.score_pages(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    doubt = [i for i in range(len(mixed)) if 0.05 < s[1000 + i]["p_page"] < 0.95]
    assert doubt and all(s[1000 + i]["p_page"] == s[2000 + i]["p_page"] for i in range(len(mixed)))
    assert all(s[1000 + i]["p_spam"] > s[1000 + i]["p_page"] and s[2000 + i]["p_spam"] < s[2000 + i]["p_page"] for i in doubt)
    assert any(s[1000 + i]["p_spam"] > 0.5 > s[2000 + i]["p_spam"] for i in doubt)


def test_slices_add_up(monkeypatch):
    text = ("A map of the hall, seen by the robot. " * 40 + "\ncheap lidar Roma | cheap lidar Oslo | " * 30 + "\n") * 3
    whole = spam.measure([text, "", "x"])
    monkeypatch.setattr(spam, "SLICE", 500)
    monkeypatch.setattr(spam, "GROUP", 1200)
    cut = spam.measure([text, "", "x"])
    assert np.abs(whole - cut)[:, : len(spam.SIGNALS) - 1].max() < 0.1
    at = len(spam.SIGNALS) + spam.FEATURES.index("links_per_100")
    assert whole[0, at] == cut[0, at] == 0 and spam.measure([]).shape == (0, len(spam.SIGNALS) + len(spam.FEATURES))


@pytest.mark.parametrize("text", ["", " ", "\n", "a", "#", "https://x.test", "....", "中", "​", "a" * 300_000, "\ud800x"])
def test_odd_texts_are_measured(text):
    assert np.isfinite(spam.features(text)).all()


def test_phrases_come_again_within_reach():
    keys = np.array([5, 1, 5, 2, 5, 3, 3, 9, 9, 9, 5], np.uint64) << np.uint64(24)
    near = np.full(keys.size, 2)
    assert np.flatnonzero(spam._again(keys, near, 3)).tolist() == [0, 2, 4, 7, 8, 9]
    assert np.flatnonzero(spam._again(keys, near)).tolist() == [0, 2, 4, 5, 6, 7, 8, 9]


def test_columns(spark):
    df = spark.createDataFrame([(1, "x y", "s")], "doc_id bigint, text string, source string")
    assert spam.score_pages(df).columns == ["doc_id", "host", "p_page", "host_rate", "p_spam"]
    assert spam.score_pages(df).select(F.sum("p_spam")).first()[0] == 0.0
