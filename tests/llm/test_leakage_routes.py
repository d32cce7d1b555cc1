import pytest

from corpusloom.llm import leakage, neardup


def test_a_short_text_is_covered_whole(spark):
    """An exact copy of a ten-word training text counts ten words, however much else a record holds."""
    train = "one two three four five six seven eight nine ten"
    rows = [(0, "train", train), (1, "test", train), (2, "test", train + " " + " ".join(f"own{i}" for i in range(30))), (3, "validation", "zero " + train + " eleven")]
    df = spark.createDataFrame(rows, "pos bigint, split string, text string")
    got = {r.pos: (r.words, r.covered) for r in leakage.coverage(df, "pos", "text", "split", ngram=3, threshold=0.6).collect()}
    assert got == {1: (10, 10), 2: (40, 10), 3: (12, 10)}


@pytest.mark.parametrize("shard_words", [1, 400, 10_000_000])
def test_many_shards(spark, shard_words):
    """The pairs are the same for any number of shards."""
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "train", base) for i in range(60)] + [(100 + i, "test", " ".join(f"a{i}x{k}" for k in range(30))) for i in range(20)]
    rows += [(300 + i, "train", " ".join(f"a{i}x{k}" for k in range(28))) for i in range(0, 20, 2)]
    rows += [(500, "validation", base), (501, "test", base.upper() + "."), (502, "test", None), (503, "test", base.replace("w0 w1 ", "w0w1 w1 ")), (504, "test", base.replace("w0 ", "w0, w0 w1 w2 w3 w4 "))]
    df = spark.createDataFrame(rows, "pos bigint, split string, text string").repartition(3)
    got = sorted((r.train, r.eval, r.copy) for r in leakage.cross_split_pairs(df, "pos", "text", "split", ngram=3, threshold=0.6, shard_words=shard_words if shard_words > 1 else 30).collect())
    assert got == sorted([(i, e, 1) for i in range(60) for e in (500, 501)] + [(i, e, 0) for i in range(60) for e in (503, 504)] + [(300 + i, 100 + i, 0) for i in range(0, 20, 2)])


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_hot_grams_are_dealt(spark, hot):
    """Stretches of a hot n-gram go to one task each, its passages to all of them: the pairs stay the same."""
    rows = [(i, "train", " ".join(f"w{k}" for k in range(40)) + f" own{i}") for i in range(30)] + [(100 + i, "test", " ".join(f"w{k}" for k in range(40)) + f" other{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "pos bigint, split string, text string").repartition(3)
    got = sorted((r.train, r.eval) for r in leakage.cross_split_pairs(df, "pos", "text", "split", ngram=3, threshold=0.6, hot=hot).collect())
    assert got == [(i, 100 + k) for i in range(30) for k in range(5)]


def test_copies_with_other_word_borders(spark):
    """Copies need not share an n-gram, and rows of one n-gram set need not be copies."""
    rows = [(1, "train", "alpha beta gamma delta"), (2, "test", "alp habe tagam madelta"), (3, "test", "alpha beta gamma delta alpha beta gamma delta"), (4, "train", "Alpha, beta gamma delta!")]
    df = spark.createDataFrame(rows, "pos bigint, split string, text string")
    got = sorted((r.train, r.eval, r.copy) for r in leakage.cross_split_pairs(df, "pos", "text", "split", ngram=1, threshold=0.6).collect())
    assert got == [(1, 2, 1), (1, 3, 0), (4, 2, 1), (4, 3, 0)]


def test_equal_rows_and_one_other_fold(spark):
    """A class of many equal rows and one row of another fold gives one pair a row and no more work."""
    one = "alpha beta gamma alpha beta gamma"
    rows = [(i, one) for i in range(20_000)] + [(50_000, one + " alpha beta gamma")]
    df = spark.createDataFrame(rows, "pos bigint, text string").repartition(4)
    assert neardup.found_pairs(df, "pos", "text", ngram=3, threshold=0.6).count() == 20_000


def test_classes_that_collide_are_made_anew(spark, monkeypatch):
    first = neardup.first_pass

    def colliding(df, ngram, bits, salt):
        cells, members = first(df, ngram, bits, salt)
        return (cells, members.withColumn("cls", members.cls * 0)) if salt == 0 else (cells, members)

    monkeypatch.setattr(neardup, "first_pass", colliding)
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "x y z u v w"), (3, "a b c d e f g")], "pos bigint, text string")
    assert [tuple(r) for r in neardup.found_pairs(df, "pos", "text", ngram=2, threshold=0.6).collect()] == [(1, 3)]
