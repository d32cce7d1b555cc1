"""Word counts, piece and pair statistics, and learning a subword vocabulary.

Counting is distributed.  Learning merges is sequential by definition, each
merge depending on all before; its state is the table of distinct words, which
one task holds in memory (``MAX_WORDS``) and turns into the vocabulary.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import SPECIAL_TOKENS, basic_tokens

CONTINUED = "##"
#: Distinct words the learning task holds at most, about half a kilobyte each; more are an error.
MAX_WORDS = 10_000_000
DIGITS = "0123456789"


def word_counts(texts: DataFrame, *, text: str = "text", do_lower_case: bool = True, min_frequency: int = 1) -> DataFrame:
    """(word, n) over all texts; special tokens are not counted, null texts have none."""
    if min_frequency < 1:
        raise ValueError("min_frequency must be at least 1")
    tokens = texts.select(F.explode(basic_tokens(text, do_lower_case=do_lower_case, never_split=SPECIAL_TOKENS)).alias("word"))
    counted = tokens.filter(~F.col("word").isin(*SPECIAL_TOKENS)).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_frequency) if min_frequency > 1 else counted


def initial_pieces(word: Column | str) -> Column:
    """First character, then the others with the continuation mark."""
    chars = F.split(F.col(word) if isinstance(word, str) else word, "")
    chars = F.filter(chars, lambda c: c != "")
    return F.transform(chars, lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit(CONTINUED), c)))


def with_initial_pieces(counts: DataFrame) -> DataFrame:
    return counts.withColumn("pieces", initial_pieces("word"))


def alphabet(counts: DataFrame) -> DataFrame:
    """(id, token): special tokens, then the sorted initial pieces and digits."""
    spark = counts.sparkSession
    pieces = with_initial_pieces(counts).select(F.explode("pieces").alias("token"))
    digits = spark.createDataFrame([(d,) for d in DIGITS], "token string")
    found = sorted(r["token"] for r in pieces.union(digits).distinct().collect())
    return spark.createDataFrame(list(enumerate([*SPECIAL_TOKENS, *found])), "id int, token string")


def piece_counts(words: DataFrame) -> DataFrame:
    """(piece, n) of (word, n, pieces), weighted by the words' counts."""
    return words.select("n", F.explode("pieces").alias("piece")).groupBy("piece").agg(F.sum("n").alias("n"))


def _pairs(words: DataFrame, *keep: str) -> DataFrame:
    size = F.size("pieces")
    index = F.when(size > 1, F.sequence(F.lit(1), size - 1)).otherwise(F.array().cast("array<int>"))
    pair = F.transform(index, lambda i: F.struct(F.get("pieces", i - 1).alias("left"), F.get("pieces", i).alias("right")))
    return words.select(*keep, F.explode(pair).alias("p")).select(*keep, "p.left", "p.right")


def pair_counts(words: DataFrame) -> DataFrame:
    """(left, right, n): adjacent pieces, weighted, every occurrence in a word counted."""
    return _pairs(words, "n").groupBy("left", "right").agg(F.sum("n").alias("n"))


def pair_words(words: DataFrame) -> DataFrame:
    """(left, right, word): the reverse index from pairs to the words that hold them."""
    return _pairs(words, "word").distinct()


def pair_scores(words: DataFrame) -> DataFrame:
    """(left, right, n, left_n, right_n, score) with score n / (left_n * right_n)."""
    pieces = piece_counts(words)
    left = pieces.select(F.col("piece").alias("left"), F.col("n").alias("left_n"))
    right = pieces.select(F.col("piece").alias("right"), F.col("n").alias("right_n"))
    joined = pair_counts(words).join(left, "left").join(right, "right")
    score = F.col("n").cast("double") / (F.col("left_n").cast("decimal(19,0)") * F.col("right_n").cast("decimal(19,0)")).cast("double")
    return joined.select("left", "right", "n", "left_n", "right_n", score.alias("score"))


def best_pairs(words: DataFrame, k: int) -> DataFrame:
    """The k best pairs: score, then count, both falling, then the pair rising."""
    return pair_scores(words).orderBy(F.desc("score"), F.desc("n"), "left", "right").limit(k)


class MergeState:
    """Pieces of all words with piece and pair counts kept up to date by each merge.

    Candidates wait in a heap.  A merge changes the counts of three pieces at
    most; all pairs that touch them are scored anew and pushed again, and an
    entry whose score is no longer that of its pair is skipped when it comes up.
    """

    def __init__(self, counts: dict[str, int], pieces: dict[str, tuple[str, ...]] | None = None) -> None:
        self.weight = list(counts.values())
        start = pieces or {w: (w[:1], *(CONTINUED + c for c in w[1:])) for w in counts}
        self.words = [list(start[w]) for w in counts]
        self.piece: defaultdict[str, int] = defaultdict(int)
        self.pair: defaultdict[tuple[str, str], int] = defaultdict(int)
        self.where: defaultdict[tuple[str, str], set[int]] = defaultdict(set)
        self.touching: defaultdict[str, set[tuple[str, str]]] = defaultdict(set)
        for w in range(len(self.words)):
            self._count(w, 1)
        self.current: dict[tuple[str, str], tuple[float, int]] = {}
        self.heap: list[tuple[float, int, tuple[str, str]]] = []
        self._rescore(self.pair)

    def _count(self, w: int, sign: int) -> None:
        own, n = self.words[w], sign * self.weight[w]
        for p in own:
            self.piece[p] += n
        for pair in zip(own, own[1:]):
            self.pair[pair] += n
            if sign > 0:
                self.where[pair].add(w)
                self.touching[pair[0]].add(pair)
                self.touching[pair[1]].add(pair)
            else:
                self.where[pair].discard(w)

    def _rescore(self, pairs: Iterable[tuple[str, str]]) -> None:
        for pair in list(pairs):
            n = self.pair.get(pair, 0)
            if not n:
                self.pair.pop(pair, None)
                self.where.pop(pair, None)
                self.current.pop(pair, None)
                for p in pair:
                    self.touching[p].discard(pair)
                continue
            a, b = self.piece[pair[0]], self.piece[pair[1]]
            if a <= 0 or b <= 0:
                raise ValueError(f"a pair that occurs needs pieces that occur: {pair!r}")
            entry = (-(n / (a * b)), -n, pair)
            if self.current.get(pair) != entry[:2]:
                self.current[pair] = entry[:2]
                heapq.heappush(self.heap, entry)
        if len(self.heap) > 1024 + 4 * len(self.current):
            self.heap = [(*key, pair) for pair, key in self.current.items()]
            heapq.heapify(self.heap)

    def best(self) -> tuple[str, str] | None:
        """The best pair, which stays a candidate until it is merged away."""
        while self.heap:
            score, n, pair = self.heap[0]
            if self.current.get(pair) == (score, n):
                return pair
            heapq.heappop(self.heap)
        return None

    def pop(self) -> tuple[str, str] | None:
        """The best pair, which stays out until ``refresh`` or a merge that touches it scores it anew."""
        pair = self.best()
        if pair is not None:
            heapq.heappop(self.heap)
            del self.current[pair]
        return pair

    def refresh(self, pairs: Iterable[tuple[str, str]]) -> None:
        """Score pairs anew; those that still occur are candidates again."""
        self._rescore(pairs)

    def merge(self, pair: tuple[str, str]) -> int:
        """Join the pair in every word, left to right; the number of words changed."""
        new = pair[0] + pair[1].removeprefix(CONTINUED)
        changed = sorted(self.where.get(pair, ()))
        stale = set(self.touching[pair[0]]) | self.touching[pair[1]] | self.touching[new]
        for w in changed:
            self._count(w, -1)
            own, out, i = self.words[w], [], 0
            while i < len(own):
                if i + 1 < len(own) and (own[i], own[i + 1]) == pair:
                    out.append(new)
                    i += 2
                else:
                    out.append(own[i])
                    i += 1
            self.words[w] = out
            self._count(w, 1)
        self._rescore(stale | self.touching[pair[0]] | self.touching[pair[1]] | self.touching[new])
        return len(changed)


def learn_merges(counts: dict[str, int], vocab_size: int) -> list[str]:
    """The vocabulary's tokens in order; it may end short when no pair is left."""
    if not counts:
        raise ValueError("no words are left to learn from")
    pieces = {p for w in counts for p in (w[:1], *(CONTINUED + c for c in w[1:]))} | set(DIGITS)
    tokens = [*SPECIAL_TOKENS, *sorted(pieces)]
    if len(tokens) > vocab_size:
        raise ValueError("vocab_size is smaller than the initial alphabet")
    known = set(tokens)
    state = MergeState(counts)
    while len(tokens) < vocab_size:
        pair = state.best()
        if pair is None:
            break
        if not state.merge(pair):
            raise RuntimeError(f"the best pair occurs in no word: {pair!r}")
        new = pair[0] + pair[1].removeprefix(CONTINUED)
        if new not in known:
            tokens.append(new)
            known.add(new)
    return tokens


def train_vocabulary(texts: DataFrame, vocab_size: int, *, text: str = "text", do_lower_case: bool = True, min_frequency: int = 2) -> DataFrame:
    """(id, token) learned from all texts; the same for any order and partitioning of them."""
    if vocab_size <= len(SPECIAL_TOKENS):
        raise ValueError(f"vocab_size must be greater than {len(SPECIAL_TOKENS)}")
    counts = word_counts(texts, text=text, do_lower_case=do_lower_case, min_frequency=min_frequency)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        for batch in batches:
            held.update(zip(batch["word"].tolist(), batch["n"].tolist()))
            if len(held) > MAX_WORDS:
                raise ValueError(f"more than {MAX_WORDS} distinct words; raise min_frequency")
        tokens = learn_merges(dict(sorted(held.items())), vocab_size)
        yield pd.DataFrame({"id": range(len(tokens)), "token": tokens})

    return counts.select("word", "n").repartition(1).mapInPandas(learn, "id int, token string")
