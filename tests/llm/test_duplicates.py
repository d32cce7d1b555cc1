import random
import re
from collections import defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

from corpusloom.functions.chars import normalize_text
from corpusloom.llm import folddup, leakage, neardup

SYLLABLES = ["ka", "lo", "mi", "ter", "vun", "sho", "pra", "zel"]


def corpus(seed: int, n: int = 60) -> list[tuple[int, str, str | None]]:
    """Texts with exact repeats, reformatted copies, edits, nulls, blanks and one long text."""
    rng = random.Random(seed)
    word = lambda: rng.choice(SYLLABLES) + rng.choice(SYLLABLES) + rng.choice(SYLLABLES)
    out: list[str | None] = [None, None, "", " \t\n", "...", "?!", "one", "two words", "a b c", "a, b. c"]
    for _ in range(n):
        kind = rng.random()
        held = [t for t in out if t and len(t) > 40]
        if kind < 0.35 or not held:
            out.append(" ".join(word() for _ in range(rng.randint(8, 60))))
        elif kind < 0.5:
            out.append(rng.choice(held))
        elif kind < 0.65:
            out.append("".join(c.upper() if rng.random() < 0.3 else c for c in rng.choice(held)).replace(" ", rng.choice([" ", ", ", "\n", "　"])))
        else:
            words = rng.choice(held).split()
            for _ in range(max(1, len(words) // rng.choice([8, 20, 40]))):
                words[rng.randrange(len(words))] = word()
            out.append(" ".join(words))
    out.append(" ".join(word() for _ in range(20_000)))
    splits = ["train", "train", "train", "validation", "test"]
    return [(i, rng.choice(splits), t) for i, t in enumerate(out)]


def frame(spark, rows, partitions=3):
    own = [(i, s, t, "clash", 7) for i, s, t in rows]
    return spark.createDataFrame(own, "pos bigint, split string, text string, cls string, key int").repartition(partitions)


def fold(text):
    plain = normalize_text(text)
    return None if plain is None else "".join(c for c in plain.lower() if c.isalnum())


def shingles(text, n):
    words = re.findall(r"[^\W_]+", (normalize_text(text) or "").lower())
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def similar(a, b, n, threshold):
    x, y = shingles(a, n), shingles(b, n)
    return bool(x and y) and Fraction(len(x & y), len(x | y)) >= threshold


@pytest.mark.parametrize("seed", [1, 2])
def test_text_copies(spark, seed):
    rows = corpus(seed)
    groups = defaultdict(list)
    for i, _, t in rows:
        if fold(t) is not None:
            groups[fold(t)].append(i)
    expected = {(g[0], i) for g in groups.values() for i in g[1:]}
    got = [(r.first_no, r.copy_no) for r in folddup.text_copies(frame(spark, rows), "pos", "text").collect()]
    assert sorted(got) == sorted(expected) and len(got) == len(set(got))
    counts = {r.pos: r.copies for r in folddup.collapsed(frame(spark, rows), "pos", "text").collect()}
    assert sum(v for v in counts.values()) == sum(t is not None for _, _, t in rows)
    assert all(counts[g[0]] == len(g) for g in groups.values())


def test_collisions_are_settled(spark, monkeypatch):
    rows = [(1, "train", "alpha"), (2, "train", "beta"), (3, "train", "Beta!"), (4, "train", "ALPHA")]
    df = frame(spark, rows)
    same = df.selectExpr("pos as key", "0L as k1", "0L as k2", "5L as size")
    monkeypatch.setattr(folddup, "text_keys", lambda *a: same)
    got = sorted((r.first_no, r.copy_no) for r in folddup.text_copies(df, "pos", "text").collect())
    assert got == [(1, 4), (2, 3)]


def test_records(spark):
    values = [
        '{"text": "A text that is long enough.", "meta": {"a": 1, "b": [1, 2]}}',
        '{"meta": {"b": [1.0, 2], "a": 1.0}, "text": "a TEXT that is, long enough"}',
        '{"meta": {"b": [2, 1], "a": 1}, "text": "A text that is long enough."}',
        '{"text": "A text that is long enough.", "meta": {"a": true, "b": [1, 2]}}',
        '{"text": "A text that is long enough.", "meta": {"a": "1", "b": [1, 2]}}',
        '{"text": "short", "x": 1}', '{"x": 1, "text": "short"}', "not json", "[1]", "", None, '{"text": 5}',
        '{"text": "A text that is long enough.", "meta": null}', '{"meta": null, "text": "A text that is long enough!"}',
    ]
    rows = [(i, v, "clash") for i, v in enumerate(values)] + [(0, values[0], "again")]
    df = spark.createDataFrame(rows, "line_number bigint, value string, text string")
    got = sorted((r.first_no, r.copy_no) for r in folddup.record_copies(df, "line_number", "value").collect())
    assert got == [(0, 1), (12, 13)]
    assert folddup.record_copies(df.limit(0), "line_number", "value").count() == 0
    nested = lambda n: '{"text": "A text that is long enough.", "x": ' + "[" * n + "]" * n + "}"
    deep = spark.createDataFrame([(i, nested(n)) for i, n in enumerate((150, 150, 5_000, 5_000, 500_000))], "line_number bigint, value string")
    assert [tuple(r) for r in folddup.record_copies(deep, "line_number", "value").collect()] == [(0, 1)]


def test_collapsed_records(spark):
    one, two = '{"text": "A text that is long enough.", "n": 1}', '{"n": 1.0, "text": "a TEXT that is long, enough"}'
    rows = [(5, one), (3, two), (9, one), (9, one), (4, '{"text": "A text that is long enough.", "n": 2}'), (1, "not json"), (2, "not json"), (7, None)]
    df = spark.createDataFrame(rows, "line_number bigint, value string").repartition(3)
    got = sorted(map(tuple, folddup.collapsed_records(df, "line_number", "value").collect()))
    assert got == [(1, 1), (2, 1), (3, 3), (4, 1)]
    assert folddup.collapsed_records(df.limit(0), "line_number", "value").count() == 0


@pytest.mark.parametrize("seed, ngram, threshold", [(1, 3, Fraction(3, 5)), (2, 5, Fraction(4, 5)), (3, 2, Fraction(1, 3)), (4, 3, Fraction(1))])
def test_near_duplicates(spark, seed, ngram, threshold):
    rows = corpus(seed)
    text = {i: t for i, _, t in rows}
    expected = {(a, b) for a, b in combinations(text, 2) if text[a] and text[b] and fold(text[a]) != fold(text[b]) and similar(text[a], text[b], ngram, threshold)}
    got = [(r.pos_a, r.pos_b) for r in neardup.found_pairs(frame(spark, rows, 5), "pos", "text", ngram=ngram, threshold=threshold).collect()]
    assert sorted(got) == sorted(expected)
    groups = {r.pos: (r.class_id, r.links) for r in neardup.grouped(frame(spark, rows), "pos", "text", ngram=ngram, threshold=threshold).collect()}
    assert len(groups) == len(rows)
    sets = {i: shingles(t, ngram) if t else frozenset() for i, t in text.items()}
    for i in text:
        same = [j for j in text if sets[j] and sets[j] == sets[i]]
        others = {sets[j] for j in text if sets[i] and sets[j] and sets[j] != sets[i] and similar(text[i], text[j], ngram, threshold)}
        assert groups[i] == (min(same, default=i), len(others))


def test_hot_group(spark):
    """A third of all rows are one text, others differ from it by an edit."""
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "train", base) for i in range(100)] + [(100 + i, "test", base.replace(f"w{i} ", f"x{i} ")) for i in range(3)] + [(200 + i, "train", f"other text number {i} with words " * 3) for i in range(50)]
    got = neardup.found_pairs(frame(spark, rows), "pos", "text", ngram=3, threshold=0.6).filter("pos_a < 100").count()
    assert got == 300
    assert leakage.cross_split_pairs(frame(spark, rows), "pos", "text", "split", ngram=3, threshold=0.6).count() == 300


@pytest.mark.parametrize("seed, shard_words", [(1, 10_000_000), (2, 200)])
def test_leakage(spark, seed, shard_words):
    rows = corpus(seed)
    expected = set()
    for i, s, t in rows:
        for j, z, u in rows:
            if s == "train" and z != "train" and t and u:
                copy = bool(fold(t)) and fold(t) == fold(u)
                if copy or similar(t, u, 3, Fraction(3, 5)):
                    expected.add((i, j, int(copy)))
    found = leakage.cross_split_pairs(frame(spark, rows), "pos", "text", "split", ngram=3, threshold=Fraction(3, 5), shard_words=shard_words)
    got = [(r.train, r.eval, r.copy) for r in found.collect()]
    assert sorted(got) == sorted(expected)


def test_coverage(spark):
    train = "one two three four five six seven eight nine ten"
    rows = [(0, "train", train), (1, "test", "zero " + train + " eleven"), (2, "test", "nothing of that is in here at all"), (3, "test", None)]
    got = {r.pos: (r.words, r.covered) for r in leakage.coverage(frame(spark, rows), "pos", "text", "split", ngram=3, threshold=0.6).collect()}
    assert got[2] == (8, 0) and got[1][0] == 12 and 3 <= got[1][1] <= 10


@pytest.mark.parametrize("seed, n", [(1, 3), (2, 2)])
def test_coverage_is_whole(spark, seed, n):
    words = lambda t: re.findall(r"[^\W_]+", (normalize_text(t) or "").lower())
    half = " ".join(f"own{i}" for i in range(30)) + " " + " ".join(f"w{i}" for i in range(20))
    again = " ".join(["w3 w4 w5 other"] * 4)
    rows = corpus(seed) + [(900, "train", " ".join(f"w{i}" for i in range(20))), (901, "test", half), (902, "validation", again), (903, "test", "w1")]
    held = set().union(*(shingles(t, n) for _, s, t in rows if s == "train" and t))
    expected = {}
    for i, s, t in rows:
        if s != "train" and t is not None:
            w = words(t)
            inside = {j + k for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in held for k in range(n)}
            expected[i] = (len(w), len(inside))
    assert expected[901] == (50, 20) and expected[902] == (16, 12)
    got = [(r.pos, (r.words, r.covered)) for r in leakage.coverage(frame(spark, rows), "pos", "text", "split", ngram=n, threshold=0.6).collect()]
    assert len(got) == len(expected) and dict(got) == expected


def test_empty_tables(spark):
    empty = frame(spark, [(0, "train", None)])
    for df in (empty, empty.limit(0)):
        assert folddup.text_copies(df, "pos", "text").count() == 0
        assert neardup.found_pairs(df, "pos", "text").count() == 0
        assert neardup.grouped(df, "pos", "text").count() == df.count()
        assert leakage.cross_split_pairs(df, "pos", "text", "split").count() == 0
        assert leakage.coverage(df, "pos", "text", "split").count() == 0
    with pytest.raises(ValueError):
        neardup.found_pairs(empty, "pos", "text", threshold=0)
    with pytest.raises(ValueError, match="missing"):
        folddup.text_copies(empty, "pos", "nope")


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64))
        shared = np.intersect1d(a, b).size
        maps = [neardup.Bitmaps(*neardup.parity_bitmaps(x, np.array([0, x.size])), np.array([x.size])) for x in (a, b)]
        zero = np.zeros(1, np.int64)
        assert neardup.may_share(maps[0], zero, maps[1], zero, np.array([shared]))[0]
