"""Problem 7: filling fixed-capacity containers with documents.

Method: hierarchical multi-length packing.  Every document is routed to a tier,
the smallest context size that holds it (the capacity, its half, quarter and
eighth).  Documents of the longest tier open windows of the whole capacity, and
their gaps are filled from shorter tiers.  The shorter tiers are then packed into
windows of their own size, longest tier first, gaps again filled from tiers
below; a window is kept where at most a 64th of it is empty.  Windows of shorter
tiers and the documents that made no full window are packed into containers as
they stand, longest first, and containers are dealt to step groups so that every
step costs about the same.

What is planned is the histogram of sizes, at most one count per size up to the
capacity, so the plan is the same work for any number of documents: a pattern
says which sizes share a container and how often it is used.  Every document
then finds its place from its size and its rank among documents of that size.
Ranks come from counts per (size, bucket) and a window within each bucket, so a
size that a third of all documents have is spread over all buckets.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.lineage import cut

from .arrow import need_columns
from .tokens import with_counts

CAPACITY = 512
BUCKET_ROWS = 500_000
STEP = 64


@dataclass
class Pattern:
    """Containers of one content: (size, how many of it) in order of size, used ``times`` times."""

    content: list[tuple[int, int]]
    times: int
    first: int = 0


def tiers_of(capacity: int) -> list[int]:
    """Context sizes, longest first: the capacity halved while it is at least an eighth of itself."""
    return sorted({max(1, capacity >> k) for k in range(4)}, reverse=True)


def tier_of(size: int, capacity: int) -> int:
    """The smallest context size that holds an item."""
    return min(t for t in tiers_of(capacity) if t >= size)


class Stock:
    """Item types left to pack, by size; a type is a document size or a filled window."""

    def __init__(self) -> None:
        self.sizes: list[tuple[int, int]] = []
        self.left: dict[tuple[int, int], int] = {}
        self.content: dict[tuple[int, int], dict[int, int]] = {}

    def add(self, size: int, n: int, content: dict[int, int]) -> None:
        item = (size, len(self.content) if len(content) > 1 or size not in content else -1)
        if item not in self.left:
            bisect.insort(self.sizes, item)
        self.left[item] = self.left.get(item, 0) + n
        self.content[item] = content

    def largest(self, most: int) -> tuple[int, int] | None:
        i = bisect.bisect_left(self.sizes, (most + 1, -1))
        return self.sizes[i - 1] if i else None

    def filled(self, first: tuple[int, int], room: int) -> tuple[dict[tuple[int, int], int], int]:
        """(items, unused room) of a window that the first item opens and the longest that fit fill up."""
        used: dict[tuple[int, int], int] = {}
        item: tuple[int, int] | None = first
        while item is not None:
            fit = max(1, min(room // item[0], self.left[item]))
            used[item] = fit
            room -= fit * item[0]
            i = bisect.bisect_left(self.sizes, min((room + 1, -1), item))
            item = self.sizes[i - 1] if i else None
        return used, room

    def take(self, used: dict[tuple[int, int], int]) -> tuple[dict[int, int], int]:
        """(document sizes, times): the window as often as all its items last."""
        times = min(self.left[item] // n for item, n in used.items())
        content: dict[int, int] = {}
        for item, n in used.items():
            for size, k in self.content[item].items():
                content[size] = content.get(size, 0) + n * k
            self.left[item] -= n * times
            if not self.left[item]:
                del self.left[item]
                self.sizes.remove(item)
        return content, times


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold every item of the histogram exactly once.

    A pattern repeats as long as all its sizes last, so every turn uses up a
    size or nearly so, and the number of patterns is bounded by the sizes.
    """
    if any(not 0 < s <= capacity or n < 0 for s, n in histogram.items()):
        raise ValueError("sizes must be between 1 and the capacity")
    stock = Stock()
    for size, n in histogram.items():
        if n:
            stock.add(size, n, {size: 1})
    tiers = tiers_of(capacity)
    out: list[Pattern] = []

    def close(item: tuple[int, int]) -> None:
        content, times = stock.take(stock.filled(item, capacity)[0])
        out.append(Pattern(sorted(content.items(), reverse=True), times))

    while (item := stock.largest(capacity)) and item[0] > (tiers[1] if len(tiers) > 1 else 0):
        close(item)
    windows: list[tuple[int, dict[int, int], int]] = []
    for tier in tiers[1:]:
        at = tier
        while item := stock.largest(at):
            used, room = stock.filled(item, tier)
            if item[0] * 2 <= tier and tier != tiers[-1]:
                break
            if room * 64 <= tier and sum(used.values()) > 1:
                content, times = stock.take(used)
                windows.append((tier - room, content, times))
            else:
                at = item[0] - 1
    for size, content, times in windows:
        stock.add(size, times, content)
    while item := stock.largest(capacity):
        close(item)
    first = 0
    out.sort(key=lambda p: (-sum(n * s * s for s, n in p.content), p.content))
    for p in out:
        p.first = first
        first += p.times
    return out


class Places:
    """Where the item of a size and rank goes: container and start inside it."""

    def __init__(self, patterns: list[Pattern]) -> None:
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        for p in patterns:
            start = 0
            for size, n in p.content:
                for _ in range(n):
                    lo = used.get(size, 0)
                    rows.setdefault(size, []).append((lo, p.first, start, p.times))
                    used[size] = lo + p.times
                    start += size
        self.rows = {s: np.array(r, np.int64) for s, r in rows.items()}
        self.containers = sum(p.times for p in patterns)

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        container, start = np.zeros(size.size, np.int64), np.zeros(size.size, np.int64)
        for s in np.unique(size).tolist():
            own = np.flatnonzero(size == s)
            table = self.rows[s]
            at = np.searchsorted(table[:, 0], rank[own], side="right") - 1
            container[own] = table[at, 1] + rank[own] - table[at, 0]
            start[own] = table[at, 2]
        return container, start


def step_of(container: np.ndarray, containers: int, step: int) -> np.ndarray:
    """Steps of ``step`` containers, dealt back and forth along containers of falling cost."""
    steps = max(1, -(-containers // step))
    row, column = np.divmod(container, steps)
    return np.where(row % 2 == 0, column, steps - 1 - column)


def packed(df: DataFrame, key: str, text: str, *, capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """(key, piece, pieces, tokens, first_token, container, start, step, tier): where every piece goes.

    ``tier``: the context size a piece is routed to.

    A document within the capacity is one piece; a larger one is divided into
    full containers and a rest.  Documents without tokens (null, blank) have no
    piece.  Rows that repeat a key are packed one by one.
    """
    need_columns(df, key, text)
    if capacity < 1 or step < 1:
        raise ValueError("capacity and step must be at least 1")
    spark = df.sparkSession
    sized = with_counts(df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")), "text", "key").filter("tokens > 0")
    cap = F.lit(capacity).cast("bigint")
    pieces = F.ceil(F.col("tokens") / cap).cast("bigint")
    items = sized.select("key", F.col("tokens").alias("all"), pieces.alias("pieces"), F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)).alias("piece"))
    items = cut(items.select("key", "pieces", "piece", (F.col("piece") * cap).alias("first_token"), F.least(cap, F.col("all") - F.col("piece") * cap).alias("tokens")))
    sizes = items.groupBy("tokens").agg(F.count("*").alias("n")).collect()
    histogram = {r["tokens"]: r["n"] for r in sizes}
    buckets = max(1, -(-sum(histogram.values()) // BUCKET_ROWS))
    patterns = plan(histogram, capacity)
    sent = spark.sparkContext.broadcast(Places(patterns))

    rows = items.withColumn("bucket", F.pmod(F.xxhash64("key", "piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("tokens", "bucket").agg(F.count("*").alias("n")).select("tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("tokens", "bucket").orderBy("key", "piece")
    ranked = rows.withColumn("own", F.row_number().over(within) - 1).join(offsets, ["tokens", "bucket"])
    ranked = ranked.select("key", "piece", "pieces", "tokens", "first_token", (F.col("own") + F.col("offset")).alias("rank"))
    names = ["key", "piece", "pieces", "tokens", "first_token", "container", "start", "step", "tier"]
    tiers = np.array(sorted(tiers_of(capacity)), np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = sent.value
        for batch in batches:
            container, start = places.find(batch.column("tokens").to_numpy(), batch.column("rank").to_numpy())
            at = step_of(container, places.containers, step)
            tier = tiers[np.searchsorted(tiers, batch.column("tokens").to_numpy())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:5]), pa.array(container), pa.array(start), pa.array(at), pa.array(tier)], names)

    return ranked.mapInArrow(run, ", ".join(f"{c} bigint" for c in names)).withColumnRenamed("key", key)


def report(rows: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, used_share, steps, least_step_cost, most_step_cost) of a packing."""
    per_step = rows.groupBy("step").agg(F.sum(F.col("tokens") * F.col("tokens")).alias("cost"), F.sum("tokens").alias("tokens"), F.count_distinct("container").alias("containers"))
    whole = per_step.agg(F.sum("containers").alias("containers"), F.sum("tokens").alias("tokens"), F.count("*").alias("steps"), F.min("cost").alias("least_step_cost"), F.max("cost").alias("most_step_cost"))
    return whole.withColumn("used_share", F.col("tokens") / (F.col("containers") * capacity))


def checks(rows: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """(documents, pieces, tokens, overfull, overlapping, misplaced): what a packing must satisfy; the last three are 0.

    Overfull containers hold more than the capacity, overlapping pieces begin
    before the one before them ends, misplaced pieces do not begin where the
    piece before them of their document ended.
    """
    inside = Window.partitionBy("container").orderBy("start")
    placed = rows.select("*", F.lag(F.col("start") + F.col("tokens")).over(inside).alias("__end"))
    per = placed.groupBy("container").agg(F.max(F.col("start") + F.col("tokens")).alias("end"), F.count_if(F.col("start") < F.col("__end")).alias("overlapping"), F.count_if(F.col("first_token") != F.col("piece") * capacity).alias("misplaced"), F.count_if(F.col("piece") == 0).alias("documents"), F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    return per.agg(F.sum("documents").alias("documents"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.count_if(F.col("end") > capacity).alias("overfull"), F.sum("overlapping").alias("overlapping"), F.sum("misplaced").alias("misplaced"))
