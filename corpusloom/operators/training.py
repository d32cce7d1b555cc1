"""Training and evaluation epochs over masked batches, and their metrics.

Evaluation is distributed: every task runs the forward pass over its batches and
sums are combined by one aggregate.  Training is one sequence of optimizer steps
in the order of batches; its data plane is distributed (encoding, sequences,
padding, masking) and batches stream to the driver one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import model as M
from corpusloom.operators.sequences import first_batches, mlm_mask, padded_batches, training_sequences

METRICS = "batch_id bigint, loss double, masked bigint"


@dataclass(frozen=True)
class EpochMetrics:
    loss: float
    batches: int
    masked_positions: int


def choose_device(wanted: str = "auto") -> str:
    """``cpu``; asking for ``cuda`` is an error, as this library's passes run on CPUs."""
    if wanted not in ("auto", "cpu", "cuda"):
        raise ValueError(f"unknown device: {wanted}")
    if wanted == "cuda":
        raise RuntimeError("cuda is not available")
    return "cpu"


def masked_batches(documents: DataFrame, *, vocab_size: int, max_length: int, batch_size: int, seed: int, epoch: int, max_batches: int | None = None, **order: str) -> DataFrame:
    """Sequences, batches and masks of an epoch; a resumed run goes on with its epoch's own masks."""
    if max_batches is not None and max_batches < 1:
        raise ValueError("max_batches must be at least 1")
    batches = padded_batches(training_sequences(documents, max_length, **order), batch_size)
    if max_batches is not None:
        batches = first_batches(batches, max_batches)
    return mlm_mask(batches, vocab_size, seed=seed, epoch=epoch)


def epoch_metrics(per_batch: DataFrame) -> DataFrame:
    """(loss, batches, masked_positions) of (batch_id, loss, masked): losses weigh by masked places."""
    return per_batch.agg((F.sum(F.col("loss") * F.col("masked")) / F.sum("masked")).alias("loss"), F.count("*").alias("batches"), F.sum("masked").alias("masked_positions"))


CELLS = ("input_ids", "attention_mask", "labels")


def batch_rows(masked: DataFrame) -> DataFrame:
    """(batch_id, rows, input_ids, attention_mask, labels): one row for every batch, its arrays laid end to end.

    The padding of batches has brought their rows together, so this shuffles nothing.
    """
    held = masked.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("seq_index", *CELLS))).alias("rows"))
    flat = lambda name: F.flatten(F.transform("rows", lambda r: r[name])).alias(name)
    return held.select("batch_id", F.size("rows").alias("rows"), *map(flat, CELLS))


def evaluate_batches(masked: DataFrame, parameters: M.Parameters, shape: M.Shape) -> DataFrame:
    """(batch_id, loss, masked) of every batch; a batch without labels is an error."""
    sent = masked.sparkSession.sparkContext.broadcast(parameters)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            size = part.column("rows").to_numpy()
            cells = [part.column(c) for c in CELLS]
            flat = [c.flatten().to_numpy() for c in cells]
            ends = np.cumsum(cells[0].value_lengths().to_numpy())
            got = []
            for n, s, e in zip(size.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
                got.append(M.loss(sent.value, shape, *(x[s:e].reshape(n, -1) for x in flat)))
            yield pa.RecordBatch.from_arrays([part.column("batch_id"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())], ["batch_id", "loss", "masked"])

    return batch_rows(masked).mapInArrow(run, METRICS)


def evaluate_epoch(masked: DataFrame, parameters: M.Parameters, shape: M.Shape) -> EpochMetrics:
    row = epoch_metrics(evaluate_batches(masked, parameters, shape)).first()
    if not row["masked_positions"]:
        raise ValueError("the epoch has no masked places")
    return EpochMetrics(row["loss"], row["batches"], row["masked_positions"])


def _streamed(masked: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches in order, one row each; one partition at a time is held."""
    for row in batch_rows(masked).repartitionByRange("batch_id").sortWithinPartitions("batch_id").toLocalIterator():
        yield tuple(np.array(row[c], np.int64).reshape(row["rows"], -1) for c in CELLS)


def train_epoch(masked: DataFrame, parameters: M.Parameters, shape: M.Shape, optimizer: M.AdamW) -> EpochMetrics:
    """One optimizer step per batch, in order; parameters change in place."""
    weighted = positions = batches = 0
    for cells in _streamed(masked):
        value, n, grad = M.loss_and_gradients(parameters, shape, *cells)
        optimizer.step(parameters, grad)
        weighted, positions, batches = weighted + value * n, positions + n, batches + 1
    if not positions:
        raise ValueError("the epoch has no masked places")
    return EpochMetrics(weighted / positions, batches, positions)


def require_same_vocabulary(one: DataFrame, two: DataFrame) -> None:
    """Training and validation must use the same (id, token) table."""
    a, b = one.select("id", "token"), two.select("id", "token")
    if a.exceptAll(b).union(b.exceptAll(a)).limit(1).count():
        raise ValueError("training and validation vocabularies differ")


def embed(texts: DataFrame, parameters: M.Parameters, shape: M.Shape, *, key: str = "seq_index") -> DataFrame:
    """(key, state): the head state of the first place of every padded row."""
    sent = texts.sparkSession.sparkContext.broadcast(parameters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            longest = max(map(len, rows["input_ids"]), default=0)
            pad = lambda column: np.array([[*x, *[0] * (longest - len(x))] for x in rows[column]], np.int64)
            out = M.encode(sent.value, shape, pad("input_ids"), pad("attention_mask"))[:, 0].astype(float) if longest else []
            yield pd.DataFrame({"key": rows[key], "state": [list(x) for x in out]})

    return texts.select(key, "input_ids", "attention_mask").mapInPandas(run, "key bigint, state array<double>").withColumnRenamed("key", key)
