import math
import random

import pytest

from corpusloom.llm import mixing


def test_water_filling():
    rows = [{"source": s, "target_share": t, "max_repeats": m, "tokens": n} for s, t, m, n in (("a", 0.5, 1, 100), ("b", 0.3, 4, 600), ("c", 0.2, 4, 300), ("d", 0.0, 9, 0))]
    assert mixing.filled(rows) == [100, 540, 360, 0]
    assert mixing.filled([{**r, "max_repeats": 1} for r in rows]) == [100, 600, 300, 0]
    assert mixing.filled([]) == []


def test_scale_meets_the_rest():
    rng = random.Random(1)
    for _ in range(200):
        classes = [(k, rng.randint(1, 5000)) for k in rng.sample(range(60), rng.randint(1, 20))]
        rest = rng.uniform(0.01, 0.99) * sum(t for _, t in classes)
        c = mixing._scale(classes, rest)
        assert math.isclose(sum(min(1.0, c * mixing.class_size(k) ** 0.5) * t for k, t in classes), rest, rel_tol=1e-9)


@pytest.mark.parametrize("edge_rows", [2_000, 3])
def test_filled_mix(spark, monkeypatch, edge_rows):
    """Every source lies within half a document of its budget, and budgets fill the total; any edge size gives the same mix."""
    monkeypatch.setattr(mixing, "EDGE_ROWS", edge_rows)
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(1, 60), rng.choice(["A", " a", "\tB ", "b", "b", "b", "c", None, "zzz"])) for i in range(1500)] + [(5000, None, "a"), (5001, "", "c"), (7, "w " * 9, "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.25, 1), ("d", 0.05, 9)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mixed(df, targets, "doc_id", "text", "source", fill=True)
    mix, got = mix.collect(), {r.source: r for r in shares.collect()}
    assert sum(r.budget for r in got.values()) == pytest.approx(sum(r.tokens for r in got.values()), abs=len(got))
    assert all(abs(r.mixed_tokens - r.budget) <= 30 for r in got.values())
    assert all(1 <= r.copies <= {"a": 1, "b": 3, "c": 1}[r.source] for r in mix)
    assert {r.source for r in mixing.used_up(shares).collect()} == {r.source for r in got.values() if not r.reachable} == {"c", "d"}
    monkeypatch.setattr(mixing, "EDGE_ROWS", 2_000)
    again = mixing.mixed(df.repartition(7), targets, "doc_id", "text", "source", fill=True)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, mix))


def test_larger_documents_are_likelier(spark):
    """Inclusion grows with the root of the size: of two sizes with equal numbers about twice as many of the fourfold size."""
    df = spark.createDataFrame([(i, "w " * (4 if i % 2 else 16), "a") for i in range(4000)] + [(9000 + i, "w " * 20, "b") for i in range(2000)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.1, 2), ("b", 0.9, 9)], "source string, target_share double, max_repeats int")
    mix = [r for r in mixing.mixed(df, targets, "doc_id", "text", "source")[0].collect() if r.source == "a"]
    large = sum(r.tokens == 16 for r in mix)
    assert 1.7 < large / (len(mix) - large) < 2.3


def test_no_documents(spark):
    targets = spark.createDataFrame([("a", None, None), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    mix, shares = mixing.mixed(df, targets, "doc_id", "text", "source", fill=True)
    assert mix.count() == 0 and shares.count() == 2
