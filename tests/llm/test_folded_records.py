import json
import random

import pytest

from corpusloom.llm import folddup


def nested(n, x="1"):
    return '{"text": "A text that is long enough.", "x": ' + "[" * n + x + "]" * n + "}"


def test_any_depth(spark):
    """Records nested 10,000 and 500,000 deep are compared as all others."""
    lines = [nested(150), nested(150), nested(10_000), nested(10_000, "1.0"), nested(10_000, "2"), nested(500_000), nested(500_000), nested(10_001)]
    df = spark.createDataFrame(list(enumerate(lines)), "line_number bigint, value string")
    got = sorted(map(tuple, folddup.record_copies(df, "line_number", "value", max_depth=None).collect()))
    assert got == [(0, 1), (2, 3), (5, 6)]


def test_own_parser_agrees():
    rng = random.Random(3)

    def value(d):
        kind = rng.random()
        if d and kind < 0.3:
            return [value(d - 1) for _ in range(rng.randint(0, 3))]
        if d and kind < 0.6:
            return {rng.choice(["a", "b\"", "ü", ""]): value(d - 1) for _ in range(rng.randint(0, 3))}
        return rng.choice([None, True, False, 0, -3, 1.5, 2e10, "text", "q\"\\\n ", ""])

    for _ in range(500):
        x = value(4)
        line = json.dumps(x, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        assert folddup._loads(line) == x
        assert folddup.same_json(x, json.loads(line))
        broken = line[: rng.randrange(len(line))] + rng.choice(["", ",", "]", "}", ":", '"', "1"]) + line[rng.randrange(len(line)) :]
        try:
            expected = json.loads(broken, parse_constant=folddup._no_constant)
        except ValueError:
            with pytest.raises(ValueError):
                folddup._loads(broken)
        else:
            assert folddup._loads(broken) == expected


def test_numbers_are_exact(spark):
    line = lambda n: '{"text": "A text that is long enough.", "n": ' + n + "}"
    numbers = ["9007199254740993", "9007199254740992", "9007199254740993", "1" + "0" * 5000, "1" + "0" * 5000, "NaN", "NaN", "1e2", "100", "-0.0", "0"]
    df = spark.createDataFrame([(i, line(n)) for i, n in enumerate(numbers)], "line_number bigint, value string")
    got = sorted(map(tuple, folddup.record_copies(df, "line_number", "value", max_depth=None).collect()))
    assert got == [(0, 2), (3, 4), (7, 8), (9, 10)]


def test_folding_needs_no_whole_text(spark):
    """Marks, ligatures and full-width letters fold in place; sigma has one form."""
    texts = ["Strasse ﬁné ΟΔΟΣ", "STRASSE finé, οδος", "ｓｔｒａｓｓｅ finé οδοσ", "strasse fine οδος", "\U0001d400bc", "ABC", "한", "한"]
    df = spark.createDataFrame(list(enumerate(texts)), "pos bigint, text string")
    assert sorted(map(tuple, folddup.text_copies(df, "pos", "text").collect())) == [(0, 1), (0, 2), (4, 5), (6, 7)]


def test_hot_groups_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(folddup, "GROUP_ROWS", 7)
    rows = [(i, "One and the same text!" if i % 3 == 0 else f"text number {i // 6}") for i in range(300)]
    df = spark.createDataFrame(rows, "pos bigint, text string").repartition(3)
    got = sorted(map(tuple, folddup.text_copies(df, "pos", "text").collect()))
    first = {}
    assert got == sorted((first[t], i) for i, t in rows if first.setdefault(t, i) != i)


def test_collisions_of_records_are_settled(spark, monkeypatch):
    values = ['{"text": "alpha", "n": 1}', '{"text": "beta"}', '{"text": "Beta!"}', '{"n": 1.0, "text": "ALPHA"}']
    df = spark.createDataFrame(list(enumerate(values)), "line_number bigint, value string")
    monkeypatch.setattr(folddup, "json_keys", lambda df, *a: df.selectExpr("line_number as key", "0L as k1", "0L as k2", "5L as size"))
    assert sorted(map(tuple, folddup.record_copies(df, "line_number", "value").collect())) == [(0, 3), (1, 2)]
