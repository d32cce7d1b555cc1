"""Problem 3: records of evaluation splits that recur in the training split.

Method: Aho-Corasick automata over sharded evaluation passages.  Texts of
similarity t share at least ceil(t n) of the n distinct word n-grams of either,
so each of them holds a common one among its n - ceil(t n) + 1 rarest.  Those of
an evaluation record are its *passages*; they are dealt to shards by their hash,
and the passages of a shard form an automaton over hashed words.  All training
texts are scanned: of every text the stretches of words at its own rarest n-grams
are sent to the shards of these n-grams and run through the automaton there, once
whatever the number of shards.  Matches name candidate pairs, which must pass
length, positional and suffix filters before whole n-gram sets are compared.

N-grams are ordered by a count sketch of the whole collection; where its counts
say that an n-gram is hot, its stretches are dealt to several tasks, each of
which holds the passages once.  Records and texts with one n-gram set form a
class and take part once; pairs are expanded to rows at the end.

Copies (problem 5) are groups of rows in both splits with equal fold hashes,
compared letter by letter with the first row of their group.

Coverage asks for every place of every evaluation record, not for passages: the
n-grams of all places meet the distinct n-grams of the training texts in a join
on their 64-bit hashes, and the intervals that match are merged.

What passes through the driver or is broadcast are the sketch and Bloom filters,
of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.lineage import cut

from .arrow import binaries, need_columns, text_groups
from .folddup import groups_of_keys, text_keys
from .kernel import Chunk, mix
from .neardup import BLOOM_BITS, BUCKET_POSTINGS, HOT_POSTINGS, bloom, expanded, flat, likely, merged_blocks, packed_blocks, sealed_pass, set_classes, sketch_bits, suffix_filtered, verified, within

#: Words of evaluation text whose passages one shard holds.
SHARD_WORDS = 4_000_000
KNOWN_BITS = 25
SYMBOLS = 2
PAIR_ROWS = 1 << 20
TRAIN, EVAL = 1, 0


def _known_bits(value: np.ndarray) -> np.ndarray:
    return (mix(value ^ np.uint64(0xB100)) >> np.uint64(64 - KNOWN_BITS)).astype(np.int64)


def known_grams(df: DataFrame, ngram: int) -> np.ndarray:
    """A Bloom filter of fixed size of the n-grams of all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(1 << KNOWN_BITS, np.bool_)
        for _, group in text_groups(batches, "text"):
            known[_known_bits(Chunk(group).shingles(ngram)[0])] = True
        yield pa.RecordBatch.from_arrays([*packed_blocks(np.packbits(known, bitorder="little"))], ["block", "cells"])

    return merged_blocks(df.select("text").mapInArrow(run, "block int, cells binary"), 1 << (KNOWN_BITS - 3), np.uint8, np.bitwise_or)


def spelled(short: np.ndarray) -> np.ndarray:
    """Words as runs of ``SYMBOLS`` letters of a small alphabet, which keeps the automaton's nodes narrow.

    Different words may be spelled alike; what an occurrence suggests is verified.
    """
    return np.stack([(short >> np.uint64(32 + 8 * k)) & np.uint64(0xFF) for k in range(SYMBOLS)], -1).astype(np.uint8)


def stretches(df: DataFrame, ngram: int, threshold: Fraction, order: object, bits: int, shards: int, salt: int, hot: int = HOT_POSTINGS) -> DataFrame:
    """(shard, side, cls, n, words, at): the rarest n-grams of every class as stretches of spelled words, with their ranks.

    Evaluation passages of a hot n-gram go to all tasks of it, stretches of a
    training text to one.  ``df`` has text and side.
    """
    num, den = threshold.numerator, threshold.denominator
    step = ngram * SYMBOLS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = order.value
        for batch, group in text_groups(batches, "text"):
            side = batch.column("side").to_numpy()
            value, doc, place, word = Chunk(group).placed_shingles(ngram)
            by = np.lexsort((value, doc))
            value, doc, place = value[by], doc[by], place[by]
            new = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])))) if value.size else np.zeros(0, np.int64)
            value, doc, place = value[new], doc[new], place[new]
            bounds = np.searchsorted(doc, np.arange(len(group) + 1))
            cls, size = set_classes(value, bounds, salt)[0], np.diff(bounds)
            _, first = np.unique(np.stack((cls, side)), axis=1, return_index=True)
            once = np.zeros(len(group), np.bool_)
            once[first] = True
            count = cells[(value >> np.uint64(64 - bits)).astype(np.int64)]
            by = np.lexsort((value, count, doc))
            at = np.arange(value.size) - bounds[doc]
            take = size + (-size * num) // den + 1
            keep = once[doc] & (at < take[doc])
            by, who, at = by[keep], doc[keep], at[keep]
            gram, copies = mix(value[by]), 1 + count[by].astype(np.int64) // hot
            own = np.repeat(np.arange(by.size), np.where(side[who] == EVAL, copies, 1))
            turn = np.arange(own.size) - np.searchsorted(own, own)
            turn = np.where(side[who[own]] == EVAL, turn, cls.view(np.uint64)[who[own]].astype(np.int64) % copies[own])
            shard = ((gram[own] ^ mix(turn.astype(np.uint64) + np.uint64(0x5A17))) % np.uint64(shards)).astype(np.int64)
            letters = spelled(np.stack([word[place[by] + k] for k in range(ngram)], 1)).reshape(by.size, step)
            group_by = np.lexsort((own, shard, who[own]))
            own, shard = own[group_by], shard[group_by]
            who, at = who[own], np.minimum(at[own], 0xFFFF).astype(np.uint16)
            row = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (shard[1:] != shard[:-1])))) if who.size else np.zeros(0, np.int64)
            ends = np.concatenate((row, [who.size]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[row], pa.int32()), pa.array(side[who[row]], pa.int32()), pa.array(cls[who[row]]), pa.array(size[who[row]], pa.int64()), binaries(letters[own].reshape(-1), ends * step), binaries(at.view(np.uint8), ends * 2)],
                ["shard", "side", "cls", "n", "words", "at"],
            )

    return df.select("text", "side").mapInArrow(run, "shard int, side int, cls bigint, n bigint, words binary, at binary")


class Shard:
    """Automaton over the passages of one shard, and who holds each of them, by size."""

    def __init__(self, rows: pa.Table, ngram: int, num: int, den: int) -> None:
        import ahocorasick

        self.step, self.num, self.den = ngram * SYMBOLS, num, den
        self.cls, self.n = rows["cls"].to_numpy(), rows["n"].to_numpy()
        letters, ends = flat(rows["words"])
        self.at = np.frombuffer(flat(rows["at"])[0].tobytes(), np.uint16).astype(np.int64)
        owner = np.repeat(np.arange(self.cls.size), np.diff(ends) // self.step)
        text = letters.tobytes().decode("latin-1")
        numbers: dict[str, int] = {}
        number = np.array([numbers.setdefault(text[i : i + self.step], len(numbers)) for i in range(0, len(text), self.step)], np.int64)
        order = np.lexsort((self.n[owner], number))
        self.owner, self.at = owner[order], self.at[order]
        # passages by number, and by size within a number
        self.span = int(self.n.max(initial=0)) + 2
        self.rank = number[order] * self.span + self.n[self.owner]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for passage, i in numbers.items():
            self.machine.add_word(passage, i)
        self.machine.make_automaton()

    def candidates(self, rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(training class, evaluation class) of matches that pass the length and the positional filter."""
        letters, ends = flat(pa.chunked_array([rows.column("words")]))
        found = [(end, i) for end, i in self.machine.iter(letters.tobytes().decode("latin-1")) if end % self.step == self.step - 1]
        if not found:
            return
        hit = np.array(found, np.int64)
        window, number = hit[:, 0] // self.step, hit[:, 1]
        who = np.searchsorted(ends // self.step, window, side="right") - 1
        at = np.frombuffer(flat(pa.chunked_array([rows.column("at")]))[0].tobytes(), np.uint16).astype(np.int64)[window]
        cls, n = rows.column("cls").to_numpy()[who], rows.column("n").to_numpy()[who]
        low = np.searchsorted(self.rank, number * self.span + np.minimum(-(-n * self.num // self.den), self.span - 1))
        high = np.searchsorted(self.rank, number * self.span + np.minimum(n * self.den // self.num, self.span - 1), side="right")
        size = high - low
        part = np.cumsum(size) // PAIR_ROWS
        for p in np.unique(part):
            own = np.flatnonzero((part == p) & (size > 0))
            count = size[own]
            x = np.repeat(own, count)
            y = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[own], count)
            m, q = self.n[self.owner[y]], self.at[y]
            least = -(-(n[x] + m) * self.num // (self.num + self.den))
            # the first common n-gram of a pair has enough n-grams behind it on both sides
            can = (n[x] - at[x] >= least) & (m - q >= least) | (at[x] == 0xFFFF) | (q == 0xFFFF)
            other = self.cls[self.owner[y]]
            can &= cls[x] != other
            yield np.unique(np.stack((cls[x][can], other[can])), axis=1)


def scanned(posted: DataFrame, ngram: int, threshold: Fraction, shards: int) -> DataFrame:
    """Distinct (a, b): training and evaluation classes that meet in a shard and pass the filters."""
    num, den = threshold.numerator, threshold.denominator

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for batch in batches:
            at, side = batch.column("shard").to_numpy(), batch.column("side").to_numpy()
            edges = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(at)]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                if at[s] != now:
                    now, held, shard = at[s], [], None
                own = batch.slice(s, e - s)
                if side[s] == EVAL:
                    held.append(own)
                elif held or shard is not None:
                    if shard is None:
                        shard, held = Shard(pa.Table.from_batches(held), ngram, num, den), []
                    for a, b in shard.candidates(own):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return posted.repartitionById(shards, "shard").sortWithinPartitions("shard", "side").mapInArrow(run, "a bigint, b bigint").distinct()


def _rows(df: DataFrame, key: str, text: str, split: str, train: str) -> DataFrame:
    """(key, text, side) of the rows that take part."""
    need_columns(df, key, text, split)
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.when(F.col(split) == train, TRAIN).otherwise(EVAL).alias("side"), F.col(split).alias("split"))
    return rows.filter(F.col("key").isNotNull() & F.col("text").isNotNull() & F.col("split").isNotNull()).drop("split")


def _copy_groups(rows: DataFrame, sides: DataFrame) -> DataFrame:
    """(key, copy): the first row of every verified group of copies that has rows of both sides."""
    keys = cut(text_keys(rows, "key", "text").filter("size > 0"))
    by = ["k1", "k2", "size"]
    both = keys.join(sides, "key").groupBy(*by).agg(F.min("side").alias("lo"), F.max("side").alias("hi")).filter("lo <> hi").select(*by)
    kept = cut(keys.join(both, by, "left_semi"))
    size = within(16.0 * kept.count(), BLOOM_BITS)
    maybe = rows.sparkSession.sparkContext.broadcast(bloom(kept.select("key"), size))
    texts = rows.select("key", "text").mapInArrow(lambda batches: likely(batches, maybe.value, size), "key bigint, text string")
    found = cut(groups_of_keys(texts, "key", "text", kept))
    firsts = found.select(F.col("first_no").alias("key"), F.col("first_no").alias("copy")).distinct()
    return found.select(F.col("copy_no").alias("key"), F.col("first_no").alias("copy")).unionByName(firsts)


def cross_split_pairs(df: DataFrame, key: str, text: str, split: str, *, train: str = "train", ngram: int = 5, threshold: float | Fraction = Fraction(4, 5), shard_words: int = SHARD_WORDS, bits: int | None = None, hot: int = HOT_POSTINGS) -> DataFrame:
    """(train, eval, copy, shared): pairs across splits that are copies or similar enough.

    ``copy`` is 1 where letters and digits agree in order (problem 5), and
    ``shared`` is then 0; else ``shared`` of their distinct n-grams are common, a Jaccard similarity of at
    least ``threshold``.  Rows of null text or null split take no part; a text
    without letters and digits is no copy; empty splits give no rows.
    """
    threshold = Fraction(threshold).limit_denominator(10_000)
    spark = df.sparkSession
    rows = _rows(df, key, text, split, train)
    sides = rows.select("key", "side")
    groups = cut(_copy_groups(rows, sides))

    bits = sketch_bits(rows) if bits is None else bits
    cells, members, salt = sealed_pass(rows, ngram, bits)
    order = spark.sparkContext.broadcast(cells)
    posted = float(cells.sum(dtype=np.float64))
    shards = max(spark.sparkContext.defaultParallelism, int(posted * float(1 - threshold) // BUCKET_POSTINGS) + 1, int(posted // shard_words) + 1)
    pairs = scanned(stretches(rows, ngram, threshold, order, bits, shards, salt, hot), ngram, threshold, shards)
    links = verified(cut(suffix_filtered(pairs, members, threshold)), rows, members, ngram, threshold)

    # rows that are no copy of any other stand for themselves
    known = members.select("key", "cls", "n").join(sides, "key").join(groups, "key", "left").select("key", "cls", "n", "side", F.coalesce("copy", F.col("key")).alias("fold"))
    known = cut(known)
    ours, theirs = known.filter(F.col("side") == TRAIN), known.filter(F.col("side") == EVAL)
    same = known.groupBy("cls").agg(F.max("n").alias("shared"), F.min("side").alias("lo"), F.max("side").alias("hi")).filter("lo <> hi")
    within = same.select(F.col("cls").alias("a"), F.col("cls").alias("b"), "shared")
    near = expanded(links.unionByName(within), ours, theirs).select(F.col("ka").alias("train"), F.col("kb").alias("eval"), F.lit(0).cast("bigint").alias("copy"), "shared")
    marked = groups.join(sides, "key")
    side = lambda s, name: marked.filter(F.col("side") == s).select("copy", F.col("key").alias(name))
    copies = side(TRAIN, "train").join(side(EVAL, "eval"), "copy").select("train", "eval", F.lit(1).cast("bigint").alias("copy"), F.lit(0).cast("bigint").alias("shared"))
    return copies.unionByName(near)


def _sides(df: DataFrame, key: str, text: str, split: str, train: str) -> tuple[DataFrame, DataFrame]:
    """(key, text) of the training rows and of the evaluation rows."""
    rows = _rows(df, key, text, split, train)
    return rows.filter(F.col("side") == TRAIN).select("key", "text"), rows.filter(F.col("side") == EVAL).select("key", "text")


def _places(df: DataFrame, ngram: int) -> DataFrame:
    """(key, at, gram): every n-gram of every row with the word at which it begins."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in text_groups(batches, "text"):
            chunk = Chunk(group)
            value, doc = chunk.shingles(ngram)
            at = np.arange(doc.size) - np.searchsorted(doc, doc)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(doc)), pa.array(at), pa.array(value.view(np.int64))], ["key", "at", "gram"])

    return df.mapInArrow(run, "key bigint, at bigint, gram bigint")


def _word_counts(df: DataFrame) -> DataFrame:
    """(key, words) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in text_groups(batches, "text"):
            owner = Chunk(group).words()[1]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.bincount(owner, minlength=len(group)), pa.int64())], ["key", "words"])

    return df.mapInArrow(run, "key bigint, words bigint")


def _known_grams(df: DataFrame, ngram: int, order: object) -> DataFrame:
    """(gram): n-grams of the rows that the Bloom filter does not rule out, each once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = order.value
        for _, group in text_groups(batches, "text"):
            value = np.unique(Chunk(group).shingles(ngram)[0])
            bit = _known_bits(value)
            value = value[((known[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.bool_)]
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64))], ["gram"])

    return df.mapInArrow(run, "gram bigint").distinct()


def coverage(df: DataFrame, key: str, text: str, split: str, *, train: str = "train", ngram: int = 5, threshold: float | Fraction = Fraction(4, 5), shard_words: int = SHARD_WORDS, bits: int | None = None) -> DataFrame:
    """(key, words, covered): words of each evaluation record inside n-grams that training texts hold.

    All places of a record count, however little of it recurs, so ``threshold``,
    ``shard_words`` and ``bits``, which serve the search for pairs, change nothing here.
    Rows of null text or null split take no part; records shorter than ``ngram``
    words are not covered.
    """
    ours, theirs = _sides(df, key, text, split, train)
    order = df.sparkSession.sparkContext.broadcast(known_grams(theirs, ngram))
    found = _places(theirs, ngram).join(_known_grams(ours, ngram, order), "gram", "left_semi")
    runs = found.groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("at"))
    step = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(ngram).cast("bigint"), x + ngram - acc["end"])).alias("n"), (x + ngram).alias("end"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    merged = runs.select("key", F.aggregate("at", start, lambda acc, x: step(acc, x))["n"].alias("covered"))
    return _word_counts(theirs).join(merged, "key", "left").select(F.col("key").alias(key), "words", F.coalesce("covered", F.lit(0).cast("bigint")).alias("covered"))
