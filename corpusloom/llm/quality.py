"""Problem 1: per-document statistics that tell natural prose from lists, tables and junk.

Method: huge documents are split into chunks, every chunk gives associative
partial counts with the state of its borders, partial counts merge in a tree,
and ratios and rule outcomes are derived from the merged counts.

Every text is cut into chunks of ``CHUNK`` characters, whose counts merge in a
binary tree; a text over ``SPREAD`` characters is first cut into stretches of
that size, which are measured so by different tasks and merge in a tree of
fan-in ``FAN_IN`` over the cluster, level by level.

Partial counts live in two parts.  Additive counts are vectors that simply add.
The border state of a chunk holds what its first and last word and line lack:
the polynomial hash and length of an unfinished word at either end, whether a
line at either end is blank, and the last visible character of the open line.
``merge`` is associative, so any tree over consecutive chunks gives the same
result as one pass over the whole text.  The share of prose is measured in
windows of a fixed number of characters; a window is decided as soon as all
words that begin in it are known, and only those two at a chunk's ends wait.
"""

from __future__ import annotations

import functools
import pickle
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import need_columns, parallelism, text_groups
from .kernel import BASE_A, BMP, mix, powers

CHUNK = 1 << 10
SPREAD = 1 << 20
WINDOW = 128
FAN_IN, LEVELS = 64, 3
#: A window is prose when one word in 20 or more is a common word and a word takes 12
#: visible characters or less; single ASCII letters are no common words.
WINDOW_COMMON, WINDOW_SHARE, WINDOW_LENGTH = 1, 20, 12
#: A text is mostly sentences when half of its visible characters lie in such windows.
PROSE_SHARE = 0.5
MOST_SYMBOLS, MOST_DIGITS = 0.25, 0.3

SUMS = ("chars", "visible", "words", "word_chars", "common", "symbols", "digits", "lines", "ended_lines")
DROPPED, BLANK, WORD, SYMBOL = 0, 1, 2, 3
STATS = "words long, mean_word_length double, symbol_ratio double, digit_ratio double, line_count long, ended_line_share double, common_share double, prose_share double, is_prose boolean"


@functools.lru_cache(maxsize=None)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, folded, ends a sentence) of every character of the basic plane."""
    kind = np.full(BMP, SYMBOL, np.uint8)
    fold = np.arange(BMP, dtype=np.uint32)
    ends = np.zeros(BMP, np.bool_)
    for i in range(BMP):
        if 0xD800 <= i < 0xE000:
            kind[i] = DROPPED
            continue
        c = chr(i)
        plain = unicodedata.normalize("NFKC", c).lower()
        if len(plain) == 1:
            fold[i] = ord(plain)
        if c.isspace():
            kind[i] = BLANK
        elif unicodedata.category(c) in ("Cc", "Cf", "Mn"):
            kind[i] = DROPPED
        elif c.isalnum() or plain[:1].isalnum():
            kind[i] = WORD
        ends[i] = plain[-1:] in tuple(".!?…。\"”'’)»:;")
    return kind, fold, ends


@dataclass
class Partial:
    """Counts of consecutive chunks of one document; see the module's description.

    ``head`` and ``tail`` are (hash, length, place) of the words that touch the
    ends; ``whole``: they are one word.  ``live``: there is a character that is
    not dropped.  ``waiting``: undecided windows as (visible, words, common).
    """

    sums: np.ndarray
    prose: int
    waiting: dict[int, np.ndarray]
    head: tuple[int, int, int] | None
    tail: tuple[int, int, int] | None
    whole: bool
    live: bool
    head_line: tuple[bool, bool]
    tail_line: tuple[bool, bool]
    broken: bool


def _word_hash(codes: np.ndarray) -> np.uint64:
    up, _ = powers(BASE_A, codes.size + 1)
    return np.add.reduce(mix(codes + np.uint64(1)) * up[: codes.size], dtype=np.uint64)


def common_hashes(words: Iterable[str]) -> np.ndarray:
    """Sorted hashes of the frequent words, as ``measure`` makes them."""
    return np.unique(np.array([_word_hash(np.array([ord(c) for c in w], np.uint64)) for w in words if len(w) > 1 or not w.isascii() and w], np.uint64))


def _is_prose(cell: np.ndarray) -> np.ndarray:
    return (cell[..., 2] >= WINDOW_COMMON) & (cell[..., 2] * WINDOW_SHARE >= cell[..., 1]) & (cell[..., 0] <= cell[..., 1] * WINDOW_LENGTH)


def measure(texts: list[str], common: np.ndarray, places: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, list[Partial]]:
    """(sums, visible characters in prose windows, partials) of every text.

    Without ``places`` the texts are whole documents.  With them they are chunks
    that begin at those places of their documents; words and lines at their
    ends are then left out of the sums and kept in the partials.
    """
    chunked = places is not None
    kind_of, fold_of, ends_of = _tables()
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(texts)
    size = np.fromiter(map(len, texts), np.int64, n)
    first = np.cumsum(size) - size
    index = np.minimum(codes, BMP - 1)
    kind = np.where(codes < BMP, kind_of[index], SYMBOL)
    for i in np.flatnonzero(codes >= BMP):
        if chr(int(codes[i])).isalnum():
            kind[i] = WORD
    folded = np.where(codes < BMP, fold_of[index], codes)
    ends = ends_of[index] & (codes < BMP)
    doc = np.repeat(np.arange(n), size)
    place = np.arange(codes.size) - first[doc]
    if chunked:
        place += np.asarray(places, np.int64)[doc]
    sums = np.zeros((n, len(SUMS)), np.int64)
    sums[:, 0] = size
    seen = kind >= WORD
    sums[:, 1] = np.bincount(doc[seen], minlength=n)
    sums[:, 5] = np.bincount(doc[kind == SYMBOL], minlength=n)
    sums[:, 6] = np.bincount(doc[(kind == WORD) & (folded >= 48) & (folded <= 57)], minlength=n)

    live = np.flatnonzero(kind != DROPPED)
    ld, is_word = doc[live], kind[live] == WORD
    new_doc = np.concatenate(([True], ld[1:] != ld[:-1])) if live.size else np.zeros(0, np.bool_)
    last_of = np.concatenate((new_doc[1:], [True])) if live.size else new_doc
    before = np.concatenate(([False], is_word[:-1])) if live.size else is_word
    after = np.concatenate((is_word[1:], [False])) if live.size else is_word
    start = np.flatnonzero(is_word & (new_doc | ~before))
    end = np.flatnonzero(is_word & (last_of | ~after)) + 1
    up, down = powers(BASE_A, live.size + 1)
    value = np.where(is_word, mix(folded[live].astype(np.uint64) + np.uint64(1)), np.uint64(0)) * up[: live.size]
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    word = (run[end] - run[start]) * down[start]
    length, owner, begun = end - start, ld[start], place[live[start]]
    hit = np.isin(word, common)
    at_head, at_tail = new_doc[start], last_of[end - 1]
    inner = ~(at_head | at_tail) if chunked else np.ones(start.size, np.bool_)
    sums[:, 2] = np.bincount(owner[inner], minlength=n)
    sums[:, 3] = np.bincount(owner[inner], length[inner], n).astype(np.int64)
    sums[:, 4] = np.bincount(owner[inner & hit], minlength=n)

    span = np.int64(place.max(initial=0)) // WINDOW + 1
    keys, inverse = np.unique(doc * span + place // WINDOW, return_inverse=True)
    slot = inverse[live[start]]
    cells = np.stack([np.bincount(inverse[seen], minlength=keys.size), np.bincount(slot[inner], minlength=keys.size), np.bincount(slot[inner & hit], minlength=keys.size)], 1)
    prosy = _is_prose(cells)
    if chunked:
        wait = np.zeros(keys.size, np.bool_)
        wait[slot[~inner]] = True
        prosy &= ~wait
    prose = np.bincount(keys[prosy] // span, cells[prosy, 0], n).astype(np.int64)

    feed = np.flatnonzero(codes == 10)
    piece = np.unique(np.concatenate((first[size > 0], feed + 1)))
    piece = piece[piece < codes.size]
    if piece.size:
        has = np.add.reduceat(seen.astype(np.int64), piece) > 0
        last = np.maximum.reduceat(np.where(seen, np.arange(codes.size), -1), piece)
        closed = has & ends[np.maximum(last, 0)]
    else:
        has = closed = np.zeros(0, np.bool_)
    of = doc[piece]
    edge = np.zeros(piece.size, np.bool_)
    if chunked and piece.size:
        edge = np.concatenate(([True], of[1:] != of[:-1])) | np.concatenate((of[1:] != of[:-1], [True]))
        # after a final line feed the open last line is an empty one
        open_end = codes[np.maximum(first + size - 1, 0)] == 10 if codes.size else np.zeros(n, np.bool_)
        edge &= ~(np.concatenate((of[1:] != of[:-1], [True])) & open_end[of] & ~np.concatenate(([True], of[1:] != of[:-1])))
    sums[:, 7] = np.bincount(of[has & ~edge], minlength=n)
    sums[:, 8] = np.bincount(of[closed & ~edge], minlength=n)
    if not chunked:
        return sums, prose, []

    parts = []
    lively = np.bincount(ld, minlength=n) > 0
    feeds = np.bincount(doc[feed], minlength=n) > 0
    bounds = np.searchsorted(of, np.arange(n + 1))
    for d in range(n):
        lines = [(bool(has[k]), bool(closed[k])) for k in (bounds[d], bounds[d + 1] - 1)] if size[d] else [(False, False)] * 2
        if size[d] and open_end[d]:
            lines[1] = (False, False)
        parts.append(Partial(sums[d], int(prose[d]), {}, None, None, False, bool(lively[d]), lines[0], lines[1], bool(feeds[d])))
    for k in np.flatnonzero(wait).tolist():
        parts[keys[k] // span].waiting[int(keys[k] % span)] = cells[k].astype(np.int64)
    for i in np.flatnonzero(at_head | at_tail).tolist():
        p, state = parts[owner[i]], (int(word[i]), int(length[i]), int(begun[i]))
        p.head = state if at_head[i] else p.head
        p.tail = state if at_tail[i] else p.tail
        p.whole |= bool(at_head[i] and at_tail[i])
    return sums, prose, parts


def _count_word(p: Partial, state: tuple[int, int, int], common: np.ndarray) -> None:
    value, length, begun = state
    hit = int(np.isin(np.uint64(value), common))
    p.sums[2:5] += (1, length, hit)
    p.waiting[begun // WINDOW][1:] += (1, hit)


def _settle(p: Partial) -> Partial:
    """Decide the windows in which no unfinished word begins."""
    held = {w[2] // WINDOW for w in (p.head, p.tail) if w}
    for k in [k for k in p.waiting if k not in held]:
        cell = p.waiting.pop(k)
        p.prose += int(cell[0]) * int(_is_prose(cell))
    return p


def merge(a: Partial, b: Partial, common: np.ndarray) -> Partial:
    """Counts of two consecutive stretches, as if they had been measured as one."""
    waiting = {k: v.copy() for k, v in a.waiting.items()}
    for k, v in b.waiting.items():
        waiting[k] = waiting[k] + v if k in waiting else v.copy()
    out = Partial(a.sums + b.sums, a.prose + b.prose, waiting, a.head, b.tail, False, a.live or b.live, a.head_line, b.tail_line, a.broken or b.broken)
    if not (a.live and b.live):
        only = a if a.live else b
        out.head, out.tail, out.whole = only.head, only.tail, only.whole
    elif a.tail and b.head:
        joined = ((a.tail[0] + b.head[0] * pow(int(BASE_A), a.tail[1], 1 << 64)) % (1 << 64), a.tail[1] + b.head[1], a.tail[2])
        if a.whole:
            out.head = joined
        if b.whole:
            out.tail = joined
        out.whole = a.whole and b.whole
        if not (a.whole or b.whole):
            _count_word(out, joined, common)
    else:
        if a.tail and not a.whole:
            _count_word(out, a.tail, common)
        if b.head and not b.whole:
            _count_word(out, b.head, common)
    line = (a.tail_line[0] or b.head_line[0], b.head_line[1] if b.head_line[0] else a.tail_line[1])
    if a.broken and b.broken:
        out.sums[7:9] += (line[0], line[0] and line[1])
    if not a.broken:
        out.head_line = line
    if not b.broken:
        out.tail_line = line
    return _settle(out)


def finish(p: Partial, common: np.ndarray) -> tuple[np.ndarray, int]:
    """Sums and prose characters of a whole document: both ends are borders now."""
    for state in ([p.head] if p.whole else [p.head, p.tail]):
        if state:
            _count_word(p, state, common)
    for has, closed in [p.head_line] + ([p.tail_line] if p.broken else []):
        p.sums[7:9] += (has, has and closed)
    p.head = p.tail = None
    return p.sums, _settle(p).prose


def _ratios(sums: np.ndarray, prose: np.ndarray, blank: np.ndarray) -> list[pa.Array]:
    """Columns of ``STATS``; null where the text is null."""
    s = {c: sums[:, i] for i, c in enumerate(SUMS)}
    share = lambda x, y: x / np.maximum(y, 1)
    prose_share, symbols, digits = share(prose, s["visible"]), share(s["symbols"], s["visible"]), share(s["digits"], s["visible"])
    values = [s["words"], share(s["word_chars"], s["words"]), symbols, digits, s["lines"], share(s["ended_lines"], s["lines"]), share(s["common"], s["words"]), prose_share, (prose_share >= PROSE_SHARE) & (symbols <= MOST_SYMBOLS) & (digits <= MOST_DIGITS)]
    return [pa.array(v, mask=blank) for v in values]


NAMES = [c.split()[0] for c in STATS.split(", ")]
PARTIAL = "key bigint, part bigint, state binary"


def _frame(key: pa.Array, sums: np.ndarray, prose: np.ndarray, blank: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key, *_ratios(sums, prose, blank)], ["key", *NAMES])


def cut_places(text: str, chunk: int) -> list[tuple[int, str]]:
    """(place, chunk) of a text, each character copied once."""
    return [(i, text[i : i + chunk]) for i in range(0, len(text), chunk)] or [(0, "")]


def tree(parts: list[Partial], common: np.ndarray) -> Partial:
    """Consecutive partial counts merged two by two, level by level."""
    while len(parts) > 1:
        parts = [merge(*parts[i : i + 2], common) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def partials(texts: list[str], begins: list[int], common: np.ndarray, chunk: int) -> list[Partial]:
    """Counts of every text that begins at a place of its document, merged from its chunks."""
    held = [(i, begin + place, part) for i, (text, begin) in enumerate(zip(texts, begins)) for place, part in cut_places(text, chunk)]
    _, _, parts = measure([part for _, _, part in held], common, [place for _, place, _ in held])
    bounds = np.searchsorted([i for i, _, _ in held], np.arange(len(texts) + 1))
    return [tree(parts[bounds[i] : bounds[i + 1]], common) for i in range(len(texts))]


def whole_counts(texts: list[str], common: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, visible characters in prose windows) of whole texts; one of a single chunk needs no merging."""
    sums, prose = np.zeros((len(texts), len(SUMS)), np.int64), np.zeros(len(texts), np.int64)
    one = [i for i, t in enumerate(texts) if len(t) <= chunk]
    if one:
        sums[one], prose[one], _ = measure([texts[i] for i in one], common)
    more = [i for i, t in enumerate(texts) if len(t) > chunk]
    if more:
        done = [finish(p, common) for p in partials([texts[i] for i in more], [0] * len(more), common, chunk)]
        sums[more], prose[more] = np.stack([d[0] for d in done]), [d[1] for d in done]
    return sums, prose


def statistics(df: DataFrame, key: str, text: str, common: Iterable[str], *, chunk: int = CHUNK, spread: int = SPREAD) -> DataFrame:
    """(key, words, ratios, is_prose) for every row.

    Chunks of a text merge where they are measured; stretches of a text over
    ``spread`` characters are measured all over the cluster and merge by a tree
    of fan-in ``FAN_IN``.  Null texts have null statistics; empty and blank texts
    have zeros and are no prose.  Rows repeat as they come; other columns are
    ignored.
    """
    need_columns(df, key, text)
    if chunk < WINDOW or chunk % WINDOW or spread < chunk or spread % chunk:
        raise ValueError(f"chunk must be a multiple of {WINDOW}, and spread one of chunk")
    sent = df.sparkSession.sparkContext.broadcast(common_hashes(common))
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    schema = f"key bigint, {STATS}"

    def direct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in text_groups(batches, "text"):
            sums, prose = whole_counts(group, sent.value, chunk)
            yield _frame(batch.column("key"), sums, prose, ~np.asarray(batch.column("text").is_valid()))

    def stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row, text in zip(*(batch.column(c).to_pylist() for c in ("key", "row", "text"))):
                own = cut_places(text, spread)
                for part, (_, piece) in enumerate(own):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([row], pa.int64()), pa.array([part], pa.int64()), pa.array([piece], pa.string())], ["key", "row", "part", "text"])

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in text_groups(batches, "text"):
            begins = [p * spread for p in batch.column("part").to_pylist()]
            states = [pickle.dumps(p) for p in partials(group, begins, sent.value, chunk)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "row", "part")), pa.array(states, pa.binary())], ["key", "row", "part", "state"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        merged = tree([pickle.loads(x) for x in pdf["state"]], sent.value)
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "row": pdf["row"].iloc[:1], "part": pdf["part"].iloc[:1] // FAN_IN, "state": [pickle.dumps(merged)]})

    def last(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [finish(pickle.loads(x), sent.value) for x in batch.column("state").to_pylist()]
            if done:
                yield _frame(batch.column("key"), np.stack([d[0] for d in done]), np.array([d[1] for d in done]), np.zeros(len(done), np.bool_))

    small = rows.filter(F.col("text").isNull() | (F.length("text") <= spread)).mapInArrow(direct, schema)
    large = rows.filter(F.length("text") > spread).withColumn("row", F.monotonically_increasing_id())
    pieces = large.select("key", "row", "text").mapInArrow(stretches, "key bigint, row bigint, part bigint, text string")
    level = "key bigint, row bigint, part bigint, state binary"
    states = pieces.repartition(parallelism(df.sparkSession), "row", "part").mapInArrow(partial, level)
    for _ in range(LEVELS - 1):
        states = states.groupBy("row", F.floor(F.col("part") / FAN_IN).alias("of")).applyInPandas(join, level)
    whole = states.groupBy("row").applyInPandas(join, level).mapInArrow(last, schema)
    return small.unionByName(whole).withColumnRenamed("key", key)


def not_prose(stats: DataFrame, key: str) -> DataFrame:
    """Keys of rows with visible text that is mostly no connected sentences."""
    return stats.filter("not is_prose").select(key)
