"""Sizes of texts in tokens of the project's basic tokenizer with lower-casing.

Counting needs no tokens: after dropping what the tokenizer drops, a token begins
at every punctuation mark and digit, at every run of letters of other scripts
than Latin, and at every run of anything else.  Characters are classified by
tables; texts with rarer characters go through a character loop.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import need_columns, text_groups
from .kernel import BMP, _lay

DROP, BLANK, SINGLE, OTHER_SCRIPT, REST, MARK, RARE = range(7)
_NON_LATIN = regex.compile(r"[\p{Letter}--\p{Script=Latin}]", regex.V1)


def _class(c: str) -> int:
    """Class of one character that is left after folding."""
    o, category = ord(c), unicodedata.category(c)
    if c in "   ":
        return BLANK
    if 33 <= o <= 47 or 58 <= o <= 64 or 91 <= o <= 96 or 123 <= o <= 126 or category[0] == "P" or c.isdecimal():
        return SINGLE
    if category[0] == "M":
        return MARK
    return OTHER_SCRIPT if category[0] == "L" and _NON_LATIN.match(c) else REST


def _fold(c: str) -> str:
    """What the tokenizer makes of one character before it splits."""
    category = unicodedata.category(c)
    if c in "\t\n\r" or category == "Zs":
        return " "
    if c in "\x00�" or category[0] == "C":
        return ""
    return "".join(x for x in unicodedata.normalize("NFD", c.lower()) if unicodedata.category(x) != "Mn")


@functools.lru_cache(maxsize=1)
def _table() -> np.ndarray:
    out = np.full(BMP, DROP, np.uint8)
    for i in range(BMP):
        if 0xD800 <= i < 0xE000:
            continue
        kinds = {_class(x) for x in _fold(chr(i))}
        if len(kinds) == 1:
            out[i] = kinds.pop()
            if out[i] == MARK:
                out[i] = RARE
        elif kinds:
            out[i] = RARE
    return out


def count_slow(text: str) -> int:
    """Tokens of one text, character by character."""
    tokens, before = 0, BLANK
    for c in text:
        for x in _fold(c):
            kind = _class(x)
            if kind == MARK:
                kind = OTHER_SCRIPT if before == OTHER_SCRIPT else REST
            if kind == SINGLE or kind in (OTHER_SCRIPT, REST) and kind != before:
                tokens += 1
            before = kind
    return tokens


def counts(texts: list[str]) -> np.ndarray:
    """Tokens of every text."""
    codes, starts, ends = _lay(texts)
    kind = np.where(codes < BMP, _table()[np.minimum(codes, BMP - 1)], RARE)
    live = np.flatnonzero(kind != DROP)
    k = kind[live]
    before = np.concatenate(([BLANK], k[:-1])) if k.size else k
    begins = (k == SINGLE) | (((k == OTHER_SCRIPT) | (k == REST)) & (k != before))
    run = np.concatenate(([0], np.cumsum(np.bincount(live[begins], minlength=codes.size))))
    out = run[ends] - run[starts]
    for i in np.unique(np.searchsorted(ends, np.flatnonzero(kind == RARE), side="right")).tolist():
        out[i] = count_slow(texts[i])
    return out


def with_counts(df: DataFrame, text: str, *carry: str) -> DataFrame:
    """The carried columns and ``tokens``; null texts have 0."""
    need_columns(df, text, *carry)
    kept = df.select(*carry, F.col(text).alias("__text"))
    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in carry), "tokens bigint"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in text_groups(batches, "__text"):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(counts(group), pa.int64())], [*carry, "tokens"])

    return kept.mapInArrow(run, schema)
