"""Subword segmentation and encoding of documents to token ids."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import SPECIAL_TOKENS, UNKNOWN, basic_tokens
from corpusloom.operators.vocabulary import CONTINUED
from corpusloom.sources.io import Vocabulary

MAX_WORD = 100
CLS_ID, SEP_ID, UNK_ID = 2, 3, 1


class Segmenter:
    """Greedy longest match from the left; one unmatched place makes the whole word unknown."""

    def __init__(self, tokens: set[str] | frozenset[str], *, unknown: str = UNKNOWN, max_word: int = MAX_WORD) -> None:
        if unknown not in tokens:
            raise ValueError(f"the unknown token {unknown!r} is not in the vocabulary")
        if max_word < 1:
            raise ValueError("max_word must be at least 1")
        self.unknown, self.max_word = unknown, max_word
        self.first = set(tokens)
        self.later = {t[len(CONTINUED) :] for t in tokens if t.startswith(CONTINUED)}
        self.longest = max(map(len, tokens))

    def pieces(self, word: str) -> list[str]:
        if not isinstance(word, str):
            raise TypeError(f"word must be a string, not {type(word).__name__}")
        if len(word) > self.max_word:
            return [self.unknown]
        out: list[str] = []
        at = 0
        while at < len(word):
            known = self.later if at else self.first
            for end in range(min(len(word), at + self.longest), at, -1):
                if word[at:end] in known:
                    break
            else:
                return [self.unknown]
            out.append(word[at:end] if not at else CONTINUED + word[at:end])
            at = end
        return out


def segment_words(words: DataFrame, vocabulary: Vocabulary, *, max_word: int = MAX_WORD) -> DataFrame:
    """(word, pieces, ids) of every distinct word; specials stand for themselves."""
    own = Segmenter(set(vocabulary.tokens), max_word=max_word)
    sent = words.sparkSession.sparkContext.broadcast((own, vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segmenter, vocab = sent.value
        for batch in batches:
            pieces = [[w] if w in SPECIAL_TOKENS else segmenter.pieces(w) for w in batch["word"]]
            yield pd.DataFrame({"word": batch["word"], "pieces": pieces, "ids": [[vocab.token_id(p) for p in ps] for ps in pieces]})

    return words.select("word").distinct().mapInPandas(run, "word string, pieces array<string>, ids array<int>")


def encode_documents(texts: DataFrame, vocabulary: Vocabulary, *, key: str = "pos", text: str = "text", do_lower_case: bool = True, max_word: int = MAX_WORD, add_special_tokens: bool = False, keep_empty: bool = False) -> DataFrame:
    """(key, token_ids): ids of every document, documents without tokens left out.

    Texts are cut to words by built-ins; each batch segments its distinct words
    once and keeps what it has met, so a frequent word costs one look-up.  No
    shuffle is needed.  Nothing is truncated; a special token that stands alone
    in a text gets its id.
    """
    segmenter = Segmenter(set(vocabulary.tokens), max_word=max_word)
    sent = texts.sparkSession.sparkContext.broadcast((segmenter, {t: i for i, t in enumerate(vocabulary.tokens)}))
    words = texts.select(F.col(key).cast("bigint").alias("key"), basic_tokens(text, do_lower_case=do_lower_case, never_split=SPECIAL_TOKENS).alias("words"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segmenter, ids = sent.value
        known: dict[str, list[int]] = {t: [ids[t]] for t in SPECIAL_TOKENS}

        def of(word: str) -> list[int]:
            if word not in known:
                if len(known) > 1 << 18:
                    known.clear()
                    known.update({t: [ids[t]] for t in SPECIAL_TOKENS})
                known[word] = [ids.get(p, UNK_ID) for p in segmenter.pieces(word)]
            return known[word]

        for batch in batches:
            out = [[] if ws is None else [i for w in ws for i in of(w)] for ws in batch["words"]]
            yield pd.DataFrame({"key": batch["key"], "token_ids": out})

    encoded = words.mapInPandas(run, "key bigint, token_ids array<int>").withColumnRenamed("key", key)
    if not keep_empty:
        encoded = encoded.filter(F.size("token_ids") > 0)
    return encoded.withColumn("token_ids", with_special_tokens("token_ids")) if add_special_tokens else encoded


def with_special_tokens(ids: Column | str) -> Column:
    """``[CLS]`` before and ``[SEP]`` after the ids."""
    kind = "array<int>"
    return F.concat(F.array(F.lit(CLS_ID)).cast(kind), ids, F.array(F.lit(SEP_ID)).cast(kind))


def tokens_to_ids(tokens: DataFrame, vocabulary: DataFrame, *, token: str = "token") -> DataFrame:
    """Add ``id`` by a join with (id, token); unknown tokens get the unknown id."""
    table = vocabulary.select(F.col("token").alias(token), F.col("id"))
    return tokens.join(table, token, "left").withColumn("id", F.coalesce("id", F.lit(UNK_ID)))


def ids_to_tokens(ids: DataFrame, vocabulary: DataFrame, *, identifier: str = "id") -> DataFrame:
    """Add ``token``; an id outside the vocabulary is an error at the action."""
    table = vocabulary.select(F.col("id").alias(identifier), F.col("token"))
    wrong = F.raise_error(F.concat(F.lit("token id is outside the vocabulary: "), F.col(identifier)))
    return ids.join(table, identifier, "left").withColumn("token", F.when(F.col("token").isNull(), wrong).otherwise(F.col("token")))


def first_documents(texts: DataFrame, n: int, *, position: str = "pos", start: int = 0) -> DataFrame:
    """The first n documents by dense position: a filter that reaches the scan, not a limit."""
    if n < 1:
        raise ValueError("the number of documents must be at least 1")
    return texts.filter(F.col(position) < start + n)


def validate_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """One row of checks of an (id, token) table: size, duplicates, gaps, specials."""
    specials = F.create_map(*[F.lit(x) for pair in enumerate(SPECIAL_TOKENS) for x in pair])
    first = F.col("id") < len(SPECIAL_TOKENS)
    return vocabulary.agg(
        F.count("*").alias("size"),
        (F.count("*") - F.count_distinct("token")).alias("duplicates"),
        (F.max("id") + 1 - F.count_distinct("id")).alias("gaps"),
        F.count_if(first & (F.col("token") == specials[F.col("id")])).alias("specials"),
    )
