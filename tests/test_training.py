import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import model as M
from corpusloom.operators import sequences, training

SHAPE = M.Shape(13, 8, 12, 3, 48, 2)


def documents(spark, ids, partitions=2):
    return spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "doc_index bigint, token_ids array<int>").repartition(partitions)


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_sequences(spark, partitions):
    df = documents(spark, [[5, 6, 7, 8], None, [], [9, 10]], partitions)
    got = sequences.training_sequences(df, 6).orderBy("seq_index").collect()
    assert [(r.seq_index, r.doc_index, r.input_ids) for r in got] == [(0, 0, [2, 5, 6, 7, 8, 3]), (1, 3, [2, 9, 10, 3])]
    cut = sequences.training_sequences(documents(spark, [list(range(5, 12))], partitions), 5).orderBy("seq_index").collect()
    assert [r.input_ids for r in cut] == [[2, 5, 6, 7, 3], [2, 8, 9, 10, 3], [2, 11, 3]]
    with pytest.raises(ValueError):
        sequences.training_sequences(df, 2)


def test_batches(spark):
    rows = [(0, [2, 5, 3]), (1, [2, 6, 7, 8, 3]), (2, [2, 5, 3]), (3, [2, 5, 3]), (4, [2, 9, 3])]
    df = spark.createDataFrame(rows, "seq_index bigint, input_ids array<bigint>")
    got = sequences.padded_batches(df, 2).orderBy("seq_index").collect()
    assert got[0].input_ids == [2, 5, 3, 0, 0] and got[0].attention_mask == [1, 1, 1, 0, 0]
    shapes = sequences.batch_shapes(sequences.padded_batches(df, 2)).orderBy("batch_id").collect()
    assert [(r.batch_size, r.sequence_length) for r in shapes] == [(2, 5), (2, 3), (1, 3)]
    assert sequences.first_batches(sequences.padded_batches(df, 2), 2).count() == 4
    for bad in (0, -1):
        with pytest.raises(ValueError):
            sequences.padded_batches(df, bad)
    with pytest.raises(Exception, match="empty"):
        sequences.padded_batches(spark.createDataFrame([(0, [])], "seq_index bigint, input_ids array<bigint>"), 2).collect()


def masked(spark, rows, p, **more):
    df = spark.createDataFrame(rows, "seq_index bigint, input_ids array<bigint>, attention_mask array<bigint>")
    return sequences.mlm_mask(df, 50, mask_probability=p, **more).orderBy("seq_index").collect()


def test_masks(spark):
    rows = [(0, [2, 5, 6, 7, 3, 0], [1, 1, 1, 1, 1, 0]), (1, [2, 8, 9, 3, 0, 0], [1, 1, 1, 1, 0, 0])]
    got = masked(spark, rows, 0.5)
    assert [sum(x != -100 for x in r.labels) for r in got] == [2, 1]
    for (_, old, _), r in zip(rows, got):
        assert all(label in (-100, a) for label, a in zip(r.labels, old))
        assert all(new == a for new, a, label in zip(r.input_ids, old, r.labels) if label == -100)
    whole = masked(spark, rows, 1.0)[0].labels
    assert whole == [-100, 5, 6, 7, -100, -100]
    assert sum(x != -100 for x in masked(spark, [(0, [2, 5, 3], [1, 1, 1])], 0.01)[0].labels) == 1
    assert masked(spark, [(0, [2, 3], [1, 1])], 0.5)[0].labels == [-100, -100]
    assert masked(spark, rows, 0.5) == masked(spark, rows[::-1], 0.5)
    for size, p in ((5, 0.1), (50, 0.0), (50, 1.1)):
        with pytest.raises(ValueError):
            sequences.mlm_mask(spark.createDataFrame(rows, "seq_index bigint, input_ids array<bigint>, attention_mask array<bigint>"), size, mask_probability=p)


def test_mask_shares(spark):
    rows = [(i, [7] * 400, [1] * 400) for i in range(40)]
    got = masked(spark, rows, 0.5)
    kinds = [new for r in got for new, label in zip(r.input_ids, r.labels) if label != -100]
    assert len(kinds) == 8000
    assert abs(kinds.count(4) / 8000 - 0.8) < 0.02 and abs(kinds.count(7) / 8000 - 0.1) < 0.02
    assert min(kinds) >= 4 and max(kinds) < 50 and got != masked(spark, rows, 0.5, epoch=1)


def test_gradients_against_differences():
    p = M.init(SHAPE, 1, np.float64)
    rng = np.random.default_rng(0)
    for k in p:
        p[k] = p[k] + 0.1 * rng.standard_normal(p[k].shape)
    ids, mask = rng.integers(5, 13, (2, 6)), np.ones((2, 6), np.int64)
    mask[1, 4:] = 0
    labels = np.full((2, 6), -100)
    labels[0, 2], labels[1, 1], labels[0, 4] = 7, 9, 5
    _, n, grad = M.loss_and_gradients(p, SHAPE, ids, mask, labels)
    assert n == 3 and grad.keys() == p.keys()
    for k in p:
        at = tuple(rng.integers(0, d) for d in p[k].shape)
        old, values = p[k][at], []
        for step in (1e-6, -1e-6):
            p[k][at] = old + step
            values.append(M.loss(p, SHAPE, ids, mask, labels)[0])
        p[k][at] = old
        assert abs((values[0] - values[1]) / 2e-6 - grad[k][at]) < 1e-6, k


def test_model_shapes_and_errors():
    p = M.init(SHAPE)
    ids, mask = np.array([[2, 5, 3, 0]]), np.array([[1, 1, 1, 0]])
    out = M.logits(p, SHAPE, ids, mask)
    assert out.shape == (1, 4, 13) and np.isfinite(out).all()
    moved = ids.copy()
    moved[0, 3] = 7
    assert np.allclose(M.logits(p, SHAPE, moved, mask)[0, :3], out[0, :3])
    labels = np.array([[-100, 5, -100, -100]])
    full = M.logits(p, SHAPE, ids, mask)[0, 1].astype(float)
    assert math.isclose(M.loss(p, SHAPE, ids, mask, labels)[0], math.log(np.exp(full).sum()) - full[5], rel_tol=1e-5)
    with pytest.raises(ValueError):
        M.Shape(13, 8, 12, 5, 48, 2)
    with pytest.raises(ValueError):
        M.Shape(13, 8, 12, 3, 48, 0)
    for bad, kind in (((ids[0], mask), ValueError), ((ids.astype(np.int32), mask), TypeError), ((ids, mask[:, :2]), ValueError), ((np.full((1, 9), 5), np.ones((1, 9), np.int64)), ValueError), ((ids + 20, mask), ValueError)):
        with pytest.raises(kind):
            M.logits(p, SHAPE, *bad)
    for bad in (np.full((1, 4), -100), np.array([[-100, 13, -100, -100]]), np.array([[-100, -5, -100, -100]])):
        with pytest.raises(ValueError):
            M.loss(p, SHAPE, ids, mask, bad)


def test_training_and_evaluation(spark):
    df = documents(spark, [[5, 6, 7, 8, 9], [6, 7, 8, 9], [5, 6, 7]] * 4)
    p, optimizer = M.init(SHAPE, 3), M.AdamW(rate=1e-2)
    first = None
    for epoch in range(4):
        batches = training.masked_batches(df, vocab_size=13, max_length=8, batch_size=2, seed=1, epoch=epoch)
        got = training.train_epoch(batches, p, SHAPE, optimizer)
        first = first or got
    assert got.loss < first.loss and got.batches == 6 and got.masked_positions >= 12
    batches = training.masked_batches(df, vocab_size=13, max_length=8, batch_size=2, seed=1, epoch=0)
    whole = training.evaluate_epoch(batches, p, SHAPE)
    losses = training.evaluate_batches(batches, p, SHAPE).collect()
    assert math.isclose(whole.loss, sum(r.loss * r.masked for r in losses) / sum(r.masked for r in losses))
    assert training.masked_batches(df, vocab_size=13, max_length=8, batch_size=2, seed=1, epoch=0, max_batches=1).count() == 2
    with pytest.raises(ValueError):
        training.masked_batches(df, vocab_size=13, max_length=8, batch_size=2, seed=1, epoch=0, max_batches=0)
    with pytest.raises(ValueError):
        training.train_epoch(batches.limit(0), p, SHAPE, optimizer)
    with pytest.raises(RuntimeError):
        training.choose_device("cuda")
    vocab = spark.createDataFrame([(0, "a")], "id int, token string")
    training.require_same_vocabulary(vocab, vocab)
    with pytest.raises(ValueError):
        training.require_same_vocabulary(vocab, vocab.limit(0))


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 1), ([0.0, 0.0, 10.0], 2), ([5.0, 1.0, 0.0], -100)], "v array<double>, label int")
    losses = [r.x for r in df.select(V.token_loss("v", "label").alias("x")).collect()]
    assert math.isclose(losses[0], math.log(sum(map(math.exp, (1, 2, 3)))) - 2) and losses[1] < 0.001 and losses[2] is None
    normed = np.array(df.select(V.layer_norm("v").alias("x")).first().x)
    assert abs(normed.mean()) < 1e-9 and abs(normed.var() - 1) < 1e-4
    assert df.select(V.linear("v", [[1, 0, 0], [0, 1, 1]], [0.5, 0]).alias("x")).first().x == [1.5, 5.0]
    assert math.isclose(df.select(V.gelu(F.lit(1.0)).alias("x")).first().x, float(M.gelu(np.float64(1.0))))
    with pytest.raises(Exception, match="input size"):
        df.select(V.linear("v", [[1.0]])).collect()
    with pytest.raises(ValueError):
        V.layer_norm("v", epsilon=0)
    row = spark.createDataFrame([([1.0, 0.0], [[1.0, 0.0], [0.0, 1.0]], [1, 0])], "q array<double>, k array<array<double>>, m array<int>")
    assert row.select(V.attention("q", "k", "k", "m").alias("x")).first().x == [1.0, 0.0]
