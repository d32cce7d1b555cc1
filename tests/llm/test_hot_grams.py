import random
from itertools import combinations

import pytest

from corpusloom.llm import neardup


@pytest.mark.parametrize("hot", [1, 4, 1000])
def test_dealt_postings_give_the_same_pairs(spark, hot):
    """An n-gram of all texts is dealt to many cells; every pair still meets in one of them."""
    rng = random.Random(2)
    base = [f"w{k}" for k in range(30)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(30)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "pos bigint, text string").repartition(3)
    grams = {i: {tuple(t.split()[k : k + 3]) for k in range(28)} for i, t in rows}
    text = dict(rows)
    expected = {(a, b) for a, b in combinations(text, 2) if grams[a] != grams[b] and len(grams[a] & grams[b]) * 5 >= 3 * len(grams[a] | grams[b])}
    members, links = neardup.similar_classes(df, "pos", "text", ngram=3, threshold=0.6, hot=hot)
    key = {r.cls: [] for r in members.collect()}
    for r in members.collect():
        key[r.cls].append(r.key)
    got = {tuple(sorted((x, y))) for r in links.collect() for x in key[r.a] for y in key[r.b]}
    assert got == expected


def test_popular_classes_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOME_PAIRS", 3)
    monkeypatch.setattr(neardup, "HOME_SHARE", 10_000_000)
    base = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(base[:i] + [f"own{i}"] + base[i:])) for i in range(30)] + [(90, " ".join(base))]
    df = spark.createDataFrame(rows, "pos bigint, text string")
    got = {(r.pos_a, r.pos_b) for r in neardup.found_pairs(df, "pos", "text").collect()}
    assert {(i, 90) for i in range(30)} <= got and len(got) == 30 + 29 * 30 // 2
