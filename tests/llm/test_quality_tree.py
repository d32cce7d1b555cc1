import random

import pytest

from corpusloom.llm import quality

COMMON = ["the", "of", "and", "was", "in", "it", "to", "had", "by", "where", "и", "в", "que"]
PIECES = ["The tower of the old town was built in the spring, and it had to be mended. ", "alpha; beta; ", "\n", "x" * 150, " ", "и в ", "1 2 3 ", "ﬁne 🙂 ", "word", "­"]


def texts(n):
    rng = random.Random(n)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 90))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [128, 256, 1024])
def test_any_chunks_give_the_counts_of_one_pass(chunk):
    common = quality.common_hashes(COMMON)
    own = texts(60)
    sums, prose, _ = quality.measure(own, common)
    got, share = quality.whole_counts(own, common, chunk)
    assert got.tolist() == sums.tolist() and share.tolist() == prose.tolist()


def test_stretches_over_the_cluster(spark, monkeypatch):
    """Texts of many stretches, merged over several levels, agree with one pass."""
    monkeypatch.setattr(quality, "FAN_IN", 3)
    rows = [(i, t) for i, t in enumerate(texts(25))] + [(3, texts(25)[3]), (90, None)]
    df = spark.createDataFrame(rows, "pos bigint, text string").repartition(3)
    whole = sorted(map(str, quality.statistics(df, "pos", "text", COMMON).collect()))
    assert sorted(map(str, quality.statistics(df, "pos", "text", COMMON, chunk=128, spread=256).collect())) == whole
    with pytest.raises(ValueError):
        quality.statistics(df, "pos", "text", COMMON, chunk=256, spread=128)
