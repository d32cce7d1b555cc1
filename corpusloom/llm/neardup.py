"""Problem 6: groups of records that differ by small edits.

Method: rare-first prefix filtering over word n-grams with length, positional
and suffix filters, joined on prefix n-grams, each pair verified once.

1. Every text becomes its set of distinct n-gram hashes (``kernel``).  Rows with
   the same set form one *class*; from here on only classes take part, so a
   text that a third of all rows repeat costs one posting per task.
2. A count sketch, filled from all n-grams of all texts, orders n-grams
   rare-first.  Any order is exact; this one is merely quick.  Its cells grow
   with the input up to ``SKETCH_BITS``, so its broadcast is bounded.
3. A class posts the first n - ceil(t n) + 1 n-grams of its order, packed by
   bucket of n-gram; the number of buckets follows the number of postings.
   Within one n-gram the length filter and the positional filter choose
   candidates: behind the first common n-gram of a pair each side must have
   as many n-grams left as the pair must share.
4. Candidates are made distinct and pass the suffix filter, which compares
   parity bitmaps of the whole sets: the bits in which they differ are a lower
   bound of the symmetric difference, so no pair over the threshold is lost.
5. Both sets are brought together once per pair that is left, and the similarity
   is computed from the whole sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.lineage import cut

from .arrow import binaries, need_columns, parallelism, text_groups
from .kernel import Chunk, mix, unique_per_document

#: Cells of the sketch as powers of two: one for 256 bytes of input, within these.
SKETCH_BITS = (20, 24)
BLOCK = 1 << 14
#: Partners of a class that one task compares, and the share of all pairs a class must have to be dealt to several.
HOME_PAIRS, HOME_SHARE = 50_000, 1_000
BUCKET_POSTINGS = 500_000
#: Postings of an n-gram that are not dealt.
HOT_POSTINGS = 250_000
#: Bits of Bloom filters as powers of two: 16 for a key, within these; a full one only filters less.
BLOOM_BITS = (20, 28)
PAIR_BLOCK = 1 << 17
POSTING = np.dtype([("gram", "<u4"), ("at", "<u2")])


def packed_blocks(cells: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(block, cells): the blocks of an array of cells that are not all zero."""
    blocks = [cells[i : i + BLOCK] for i in range(0, cells.size, BLOCK)]
    held = [(i, b.tobytes()) for i, b in enumerate(blocks) if b.any()]
    return pa.array([i for i, _ in held], pa.int32()), pa.array([b for _, b in held], pa.binary())


def merged_blocks(parts: DataFrame, size: int, dtype: type, join: np.ufunc) -> np.ndarray:
    """Cells of all tasks, merged by block in a shuffle; the driver receives ``size`` cells."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist()):
                add = np.frombuffer(raw, dtype)
                total[i] = join(total[i], add) if i in total else add
        rows = sorted(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([b.tobytes() for _, b in rows], pa.binary())], ["block", "cells"])

    n = max(1, min(-(-size // BLOCK), parallelism(parts.sparkSession)))
    cells = np.zeros(size, dtype)
    for row in parts.repartition(n, "block").mapInArrow(run, "block int, cells binary").collect():
        own = np.frombuffer(bytes(row["cells"]), dtype)
        cells[row["block"] * BLOCK : row["block"] * BLOCK + own.size] = own
    return cells


def saturating_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a + b < a, np.uint32(0xFFFFFFFF), a + b)


def within(value: float, bounds: tuple[int, int]) -> int:
    """The power of two that holds a value, within bounds."""
    return max(bounds[0], min(bounds[1], math.ceil(math.log2(max(value, 1)))))


def sketch_bits(df: DataFrame) -> int:
    """Bits for the sketch of a table by what the optimizer says of its size."""
    return within(float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 256, SKETCH_BITS)


def first_pass(df: DataFrame, ngram: int, bits: int, salt: int = 0) -> tuple[np.ndarray, DataFrame]:
    """One pass over (key, text): the count sketch and (key, cls, seal, n, fold, bits).

    The sketch counts the distinct n-grams of every text in ``2**bits`` cells.
    ``cls`` names a text's n-gram set, ``seal`` is a second hash of it, ``fold``
    its letters and digits in order, ``bits`` is the set's parity bitmap; texts
    without n-grams are left out of the table.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, np.uint32)
        for batch, group in text_groups(batches, "text"):
            chunk = Chunk(group)
            value, doc = chunk.shingles(ngram)
            value, bounds = unique_per_document(value, doc, len(group))
            cell, count = np.unique((value >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
            cells[cell] = saturating_sum(cells[cell], count.astype(np.uint32))
            size = np.diff(bounds)
            has = pa.array(size > 0)
            one, two, length = chunk.fold_keys()
            fold = mix(one.view(np.uint64) ^ mix(two.view(np.uint64) + length.astype(np.uint64))).view(np.int64)
            key = batch.column("key").filter(has)
            none = pa.nulls(len(key), pa.int32()), pa.nulls(len(key), pa.binary())
            yield pa.RecordBatch.from_arrays([*none, key, *(pa.array(x).filter(has) for x in (*set_classes(value, bounds, salt), size, fold)), binaries(*parity_bitmaps(value, bounds)).filter(has)], names)
        block, raw = packed_blocks(cells)
        none = [*[pa.nulls(len(block), pa.int64())] * 5, pa.nulls(len(block), pa.binary())]
        yield pa.RecordBatch.from_arrays([block, raw, *none], names)

    names = ["block", "cells", "key", "cls", "seal", "n", "fold", "bits"]
    both = cut(df.select("key", "text").mapInArrow(run, "block int, cells binary, key bigint, cls bigint, seal bigint, n bigint, fold bigint, bits binary"))
    cells = merged_blocks(both.filter("block is not null").select("block", "cells"), 1 << bits, np.uint32, saturating_sum)
    return cells, both.filter("block is null").select("key", "cls", "seal", "n", "fold", "bits")


def set_classes(value: np.ndarray, bounds: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(class, seal) of every n-gram set: order-free sums of two mixes of its members."""
    size = np.diff(bounds).astype(np.uint64)
    out = []
    for k in (0x51ED27 + (salt << 32), 0xC0FFEE11):
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(k)), dtype=np.uint64)))
        out.append(run[bounds[1:]] - run[bounds[:-1]])
    return mix(out[0] ^ mix(size)).view(np.int64), mix(out[1]).view(np.int64)


def sealed_pass(df: DataFrame, ngram: int, bits: int) -> tuple[np.ndarray, DataFrame, int]:
    """``first_pass`` with a salt under which no two sets share a class, and that salt.

    Sets are told apart by both hashes, 128 bits; where two of one class differ
    in their seals, all classes are made anew.
    """
    for salt in range(16):
        cells, members = first_pass(df, ngram, bits, salt)
        if not members.groupBy("cls").agg(F.min("seal").alias("a"), F.max("seal").alias("b")).filter("a <> b").limit(1).count():
            return cells, members.drop("seal"), salt
    raise RuntimeError("sets share classes under every salt")


def bitmap_widths(size: np.ndarray) -> np.ndarray:
    """Bits of a set's parity bitmap: the power of two from 2.5 to 5 times its size, 64 at least."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 1) * 2.5)).astype(np.int64))


def parity_bitmaps(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of every set's bitmap: bit h(x) is the parity of its members there."""
    width = bitmap_widths(np.diff(bounds))
    base = np.concatenate(([0], np.cumsum(width)))
    owner = np.repeat(np.arange(width.size), np.diff(bounds))
    bit = base[owner] + (mix(value ^ np.uint64(0xB17)).astype(np.int64) & (width[owner] - 1))
    odd = (np.bincount(bit, minlength=int(base[-1])) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little"), base // 8


class Bitmaps:
    """Parity bitmaps of many sets, laid end to end, with the sets' sizes."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        self.words = np.frombuffer(np.ascontiguousarray(raw).tobytes(), "<u8")
        self.at, self.size, self.width = at // 8, size, bitmap_widths(size) // 64

    def take(self, row: np.ndarray, width: int) -> np.ndarray:
        """Bitmaps of rows of at least ``width`` words, folded to it."""
        own = int(self.width[row[0]]) if row.size else width
        got = self.words[self.at[row][:, None] + np.arange(own)]
        return got if own == width else np.bitwise_xor.reduce(got.reshape(len(row), -1, width), axis=1)


def may_share(one: Bitmaps, i: np.ndarray, two: Bitmaps, j: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Suffix filter: whether sets i and j can have ``least`` common members.

    Bits in which two parity bitmaps differ are a lower bound of the symmetric
    difference.  Wider bitmaps fold onto narrower ones.
    """
    ok = np.zeros(i.size, np.bool_)
    room = one.size[i] + two.size[j] - 2 * least
    for p, q in {*zip(one.width[i].tolist(), two.width[j].tolist())}:
        own = np.flatnonzero((one.width[i] == p) & (two.width[j] == q))
        narrow, step = min(p, q), max(1, PAIR_BLOCK // max(p, q))
        for s in range(0, own.size, step):
            part = own[s : s + step]
            differ = np.bitwise_count(one.take(i[part], narrow) ^ two.take(j[part], narrow))
            ok[part] = differ.sum(axis=1, dtype=np.int64) <= room[part]
    return ok


def postings(df: DataFrame, ngram: int, threshold: Fraction, order: object, bits: int, buckets: int, salt: int = 0, hot: int = HOT_POSTINGS) -> DataFrame:
    """(bucket, cls, n, grams): rare-first prefixes, packed by class and bucket; a class once per task chunk."""
    num, den = threshold.numerator, threshold.denominator

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = order.value
        for _, group in text_groups(batches, "text"):
            value, doc = Chunk(group).shingles(ngram)
            value, bounds = unique_per_document(value, doc, len(group))
            cls, size = set_classes(value, bounds, salt)[0], np.diff(bounds)
            _, first = np.unique(cls, return_index=True)
            once = np.zeros(len(group), np.bool_)
            once[first] = True
            once &= size > 0
            owner = np.repeat(np.arange(len(group)), size)
            count = cells[(value >> np.uint64(64 - bits)).astype(np.int64)]
            by = np.lexsort((value, count, owner))
            at = np.arange(value.size) - bounds[owner]
            prefix = size + (-size * num) // den + 1
            keep = once[owner] & (at < prefix[owner])
            gram, who, at = mix(value[by][keep]), owner[keep], at[keep]
            cells_of = 1 + count[by][keep].astype(np.int64) // hot
            if (cells_of > 1).any():
                own = np.repeat(np.arange(gram.size), cells_of)
                mine = (cls.view(np.uint64)[who[own]] % cells_of[own].astype(np.uint64)).astype(np.int64)
                other = np.arange(own.size) - np.searchsorted(own, own)
                cell = np.minimum(mine, other) * (1 << 32) + np.maximum(mine, other) + 1
                gram = np.where(cells_of[own] > 1, mix(gram[own] ^ mix(cell.astype(np.uint64))), gram[own])
                who, at = who[own], at[own]
            bucket = (gram >> np.uint64(32)).astype(np.int64) % buckets
            group_by = np.lexsort((bucket, who))
            gram, who, at, bucket = gram[group_by], who[group_by], at[group_by], bucket[group_by]
            row = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (bucket[1:] != bucket[:-1])))) if who.size else np.zeros(0, np.int64)
            packed = np.empty(gram.size, POSTING)
            packed["gram"] = gram.astype(np.uint32)
            packed["at"] = np.minimum(at, 0xFFFF)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[row], pa.int32()), pa.array(cls[who[row]]), pa.array(size[who[row]], pa.int64()), binaries(packed.view(np.uint8), np.concatenate((row, [gram.size])) * POSTING.itemsize)],
                ["bucket", "cls", "n", "grams"],
            )

    return df.select("text").mapInArrow(run, "bucket int, cls bigint, n bigint, grams binary")


class Bucket:
    """Postings of one bucket, and the search for its candidate pairs."""

    def __init__(self, rows: pa.Table, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.cls = rows["cls"].to_numpy()
        self.n = rows["n"].to_numpy()
        raw, at = flat(rows["grams"])
        packed = np.frombuffer(raw.tobytes(), POSTING)
        row = np.repeat(np.arange(self.cls.size), np.diff(at) // POSTING.itemsize)
        order = np.lexsort((self.n[row], packed["gram"]))
        self.gram, self.at, self.row = packed["gram"][order], packed["at"][order].astype(np.int64), row[order]

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (smaller, larger class) that pass all filters."""
        if not self.gram.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = np.flatnonzero(np.concatenate(([True], self.gram[1:] != self.gram[:-1])))
        ends = np.concatenate((starts[1:], [self.gram.size]))
        index, stop = np.arange(self.gram.size), np.repeat(ends, ends - starts)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        gap, held = 1, 0
        while True:
            within = index + gap < stop
            index, stop = index[within], stop[within]
            if not index.size:
                break
            i, j = self.row[index], self.row[index + gap]
            n, m = self.n[i], self.n[j]
            near = n * self.den >= m * self.num
            # sizes rise within an n-gram: once a partner is too large, so are all later ones
            index, stop, i, j, n, m = index[near], stop[near], i[near], j[near], n[near], m[near]
            least = -((-(n + m) * self.num) // (self.num + self.den))
            p, q = self.at[index], self.at[index + gap]
            # the first common n-gram of a pair has enough n-grams behind it on both sides
            can = (n - p >= least) & (m - q >= least)
            can |= (p == 0xFFFF) | (q == 0xFFFF)
            can &= self.cls[i] != self.cls[j]
            a, b = self.cls[i[can]], self.cls[j[can]]
            left.append(np.minimum(a, b))
            right.append(np.maximum(a, b))
            held += a.size
            if held > 1 << 21:
                a, b = _distinct_pairs(np.concatenate(left), np.concatenate(right))
                left, right, held = [a], [b], 0
            gap += 1
        return _distinct_pairs(np.concatenate(left), np.concatenate(right))


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column."""
    parts, sizes = [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)]
    for chunk in column.chunks:
        if len(chunk):
            at = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[at[0] : at[-1]])
            sizes.append(np.diff(at).astype(np.int64))
    return np.concatenate(parts), np.cumsum(np.concatenate(sizes))


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    if a.size:
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        a, b = a[new], b[new]
    return a, b


def candidates(posted: DataFrame, threshold: Fraction, buckets: int) -> DataFrame:
    """Distinct (a, b) of classes that share a prefix n-gram and pass the filters."""
    num, den = threshold.numerator, threshold.denominator

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def close() -> pa.RecordBatch:
            a, b = Bucket(pa.Table.from_batches(held), num, den).candidates()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                if held and bucket[s] != now:
                    yield close()
                    held.clear()
                now = bucket[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield close()

    return posted.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "a bigint, b bigint").distinct()


def suffix_filtered(pairs: DataFrame, members: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow the threshold; each class sends its bitmap once per pair."""
    num, den = threshold.numerator, threshold.denominator
    maps = members.groupBy("cls").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    side = lambda x: maps.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"m{x}"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (Bitmaps(*flat(pa.chunked_array([batch.column(f"m{x}")])), batch.column(f"n{x}").to_numpy()) for x in "ab")
            row = np.arange(len(batch))
            least = -((-(one.size + two.size) * num) // (num + den))
            keep = pa.array(may_share(one, row, two, row, least))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "na", "ma", "b", "nb", "mb")
    return both.mapInArrow(run, "a bigint, b bigint")


def _verify(batches: Iterable[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (home, salt, own first): compare every partner with the home's set."""
    home = salt = None
    mine = np.zeros(0, np.uint64)
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        for h, s, m, raw in zip(*(batch.column(c).to_pylist() for c in ("home", "salt", "member", "grams"))):
            grams = np.frombuffer(raw, np.uint64)
            if (h, s) != (home, salt):
                home, salt, mine = h, s, grams
                continue
            shared = int(np.isin(grams, mine, assume_unique=True, kind="sort").sum()) if mine.size else 0
            if shared * (num + den) >= (mine.size + grams.size) * num:
                out.append((h, m, shared))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], ["a", "b", "shared"])


def bloom(keys: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of fixed size over the keys; a full one only filters less."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            for bit in bloom_bits(batch.column("key").to_numpy(), bits):
                np.bitwise_or.at(cells, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([*packed_blocks(cells)], ["block", "cells"])

    return merged_blocks(keys.mapInArrow(run, "block int, cells binary"), 1 << (bits - 3), np.uint8, np.bitwise_or)


def bloom_bits(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(keys.astype(np.int64).view(np.uint64))
    return [(h & np.uint64((1 << bits) - 1)).astype(np.int64), (h >> np.uint64(64 - bits)).astype(np.int64)]


def similar_classes(df: DataFrame, key: str, text: str, *, ngram: int = 5, threshold: float | Fraction = Fraction(4, 5), bits: int | None = None, hot: int = HOT_POSTINGS) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``members(key, cls, n, fold, bits)`` and ``links(a, b, shared)`` between classes.

    Rows of null key take no part; repeated rows are members each.

    A link stands for a pair of different n-gram sets whose Jaccard similarity
    is at least ``threshold``; rows of one class have similarity 1.  Null and
    empty texts and texts of fewer than ``ngram`` words have no n-grams and
    appear in neither.  Other columns of ``df`` are ignored.
    """
    need_columns(df, key, text)
    threshold = Fraction(threshold).limit_denominator(10_000)
    if not 0 < threshold <= 1 or ngram < 1:
        raise ValueError("threshold must be in (0, 1] and ngram at least 1")
    spark: SparkSession = df.sparkSession
    base = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull() & F.col("text").isNotNull())
    bits = sketch_bits(base) if bits is None else bits
    cells, members, salt = sealed_pass(base, ngram, bits)
    order = spark.sparkContext.broadcast(cells)
    posted = float(cells.sum(dtype=np.float64)) * float(1 - threshold)
    buckets = max(spark.sparkContext.defaultParallelism, int(posted // BUCKET_POSTINGS) + 1)
    found = candidates(postings(base, ngram, threshold, order, bits, buckets, salt, hot), threshold, buckets)
    return members, verified(cut(suffix_filtered(found, members, threshold)), base, members, ngram, threshold)


def verified(pairs: DataFrame, base: DataFrame, members: DataFrame, ngram: int, threshold: Fraction) -> DataFrame:
    """(a, b, shared): the pairs of classes whose whole n-gram sets reach the threshold; ``base(key, text)`` holds them."""
    spark = base.sparkSession
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    chosen = cut(members.groupBy("cls").agg(F.min("key").alias("key")).join(wanted, "cls", "left_semi"))
    bloom_size = within(16.0 * chosen.count(), BLOOM_BITS)
    maybe = spark.sparkContext.broadcast(bloom(chosen.select("key"), bloom_size))

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in text_groups(likely(batches, maybe.value, bloom_size), "text"):
            value, doc = Chunk(group).shingles(ngram)
            value, bounds = unique_per_document(value, doc, len(group))
            yield pa.RecordBatch.from_arrays([batch.column("key"), binaries(value.view(np.uint8), bounds * 8)], ["key", "grams"])

    sets = base.select("key", "text").mapInArrow(grams, "key bigint, grams binary").join(chosen, "key").select("cls", "grams")
    # at most HOME_SHARE classes can have so many partners each
    least = max(HOME_PAIRS, pairs.count() // HOME_SHARE)
    dealt = pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > least).select("a", F.ceil(F.col("n") / HOME_PAIRS).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int")
    salted = pairs.join(F.broadcast(dealt), "a", "left").select(F.col("a").alias("home"), salt.alias("salt"), F.col("b").alias("member"))
    own = salted.select("home", "salt", F.col("home").alias("member")).distinct()
    sent = salted.unionByName(own).join(sets, F.col("member") == F.col("cls")).select("home", "salt", "member", "grams", (F.col("member") != F.col("home")).alias("other"))
    together = sent.repartition(parallelism(spark), "home", "salt").sortWithinPartitions("home", "salt", "other")
    return cut(together.mapInArrow(functools.partial(_verify, num=threshold.numerator, den=threshold.denominator), "a bigint, b bigint, shared bigint"))


def likely(batches: Iterable[pa.RecordBatch], cells: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """The rows whose key a Bloom filter lets through."""
    for batch in batches:
        keep = np.ones(len(batch), np.bool_)
        for bit in bloom_bits(batch.column("key").to_numpy(), bits):
            keep &= (cells[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
        yield batch.filter(pa.array(keep))


def expanded(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(ka, kb, ...): rows of linked classes that are no copies of one another.

    ``links(a, b, ...)`` are pairs of classes, ``left`` and ``right`` have (key,
    cls, fold).  Groups of copies within classes are paired first and only then
    expanded to rows, so no two rows meet that are not in the result.
    """
    extra = [c for c in links.columns if c not in ("a", "b")]
    side = lambda rows, x: rows.select(F.col("cls").alias(x), F.col("fold").alias(f"f{x}")).distinct()
    groups = links.join(side(left, "a"), "a").join(side(right, "b"), "b").filter("fa <> fb")
    rows = lambda rows, x: rows.select(F.col("cls").alias(x), F.col("fold").alias(f"f{x}"), F.col("key").alias(f"k{x}"))
    return groups.join(rows(left, "a"), ["a", "fa"]).join(rows(right, "b"), ["b", "fb"]).select("ka", "kb", "a", "b", "fa", "fb", *extra)


def found_pairs(df: DataFrame, key: str, text: str, *, ngram: int = 3, threshold: float | Fraction = Fraction(3, 5)) -> DataFrame:
    """(key_a, key_b) of all rows at or over the threshold that are no copies of one another.

    Copies have the same letters and digits in the same order (problem 5).
    Links between classes are expanded to rows by way of the groups of copies
    in them (``expanded``); only rows of linked classes take part.
    """
    members, links = similar_classes(df, key, text, ngram=ngram, threshold=threshold)
    mixed = members.groupBy("cls").agg(F.min("fold").alias("lo"), F.max("fold").alias("hi")).filter("lo <> hi")
    inner = mixed.select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    whole = links.select("a", "b").unionByName(inner)
    both = expanded(whole, members, members).filter("a <> b or fa < fb")
    return both.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b"))


def grouped(df: DataFrame, key: str, text: str, *, ngram: int = 5, threshold: float | Fraction = Fraction(4, 5)) -> DataFrame:
    """(key, class_id, links): the smallest key of the row's class and its number of linked classes.

    Rows without n-grams get a class of their own and no links.
    """
    members, links = similar_classes(df, key, text, ngram=ngram, threshold=threshold)
    first = members.groupBy("cls").agg(F.min("key").alias("class_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    rows = members.join(first, "cls").join(degree, "cls", "left").groupBy("key").agg(F.min("class_id").alias("class_id"), F.max("links").alias("links"))
    every = df.select(F.col(key).cast("bigint").alias("key"))
    out = every.join(rows, "key", "left").select("key", F.coalesce("class_id", "key").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return out.withColumnRenamed("key", key)
