"""Problem 4: cutting oversized items at natural boundaries, with overlap.

Method: structure-tree packing.  Headings, blank lines, list items, lines,
sentences, clauses and words of a text are boundaries of rising depth; the spans
between boundaries of depth d or less are the tree's nodes of depth d.  Only a
node over the limit is opened; pieces of sibling subtrees are merged bottom-up,
left to right, as long as they fit.  Where even a word is over the limit it is
cut at the limit, but not within a cluster of combining marks that fits.

Every piece but the first then begins earlier, at the first sentence or else
word boundary within the overlap, so pieces stay within the limit and the parts
without their overlaps give the item back exactly.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import bounded, need_columns

HEADINGS = 6
BLANK_LINE, LIST_ITEM, LINE, SENTENCE, CLAUSE, WORD = range(HEADINGS, HEADINGS + 6)
DEPTHS = HEADINGS + 6

_HEADING = re.compile(r"^[ ]{0,3}(?:(#{1,6}) +\S|\s*(={2,6})[^=\n]|\s*(=(?: =)*) +[^=\s]|\\(sub)?(sub)?section\*?\{|<h([1-6])\b)", re.M | re.I)
_FENCE = re.compile(r"^(?:```|~~~)[^\n]*\n.*?^(?:```|~~~)[^\n]*$", re.M | re.S)
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_ITEM = re.compile(r"^[^\S\n]*(?:[-*+•–▪»·]|\d{1,3}[.)]|\\item)\s", re.M)
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*\s+")
_CLAUSE = re.compile(r"[,;:]\s+")
_SPACE = re.compile(r"\s+")
_LINE_START = re.compile(r"\n[ \t]*")


def _within(spans: list[tuple[int, int]]):
    """A test for places inside one of the sorted spans."""
    starts = [s for s, _ in spans]

    def test(place: int) -> bool:
        i = bisect_left(starts, place) - 1
        return i >= 0 and place < spans[i][1]

    return test


@dataclass
class Tree:
    """Boundaries of an item by depth; ``at[d]`` holds those of depth d or less, sorted."""

    size: int
    at: list[list[int]]

    def children(self, start: int, end: int, depth: int) -> list[tuple[int, int]]:
        own = self.at[depth]
        cuts = own[bisect_right(own, start) : bisect_left(own, end)]
        return list(zip([start, *cuts], [*cuts, end]))

    def within(self, low: int, high: int, depth: int) -> int | None:
        """The first boundary of depth or less in [low, high)."""
        own = self.at[depth]
        i = bisect_left(own, low)
        return own[i] if i < len(own) and own[i] < high else None


def _tree(size: int, depth_at: dict[int, int]) -> Tree:
    at: list[list[int]] = [[] for _ in range(DEPTHS)]
    for place in sorted(depth_at):
        if 0 < place < size:
            for d in range(depth_at[place], DEPTHS):
                at[d].append(place)
    return Tree(size, at)


def text_tree(text: str) -> Tree:
    """Boundaries of a text; inside fenced code only lines and blank lines count."""
    depth: dict[int, int] = {}

    def put(place: int, d: int) -> None:
        depth[place] = min(d, depth.get(place, d))

    for m in _SPACE.finditer(text):
        put(m.end(), LINE if "\n" in m[0] else WORD)
    for m in _CLAUSE.finditer(text):
        put(m.end(), CLAUSE)
    for m in _SENTENCE.finditer(text):
        put(m.end(), SENTENCE)
    for m in _ITEM.finditer(text):
        put(m.start(), LIST_ITEM)
    for m in _BLANK.finditer(text):
        put(m.end(), BLANK_LINE)
    for m in _HEADING.finditer(text):
        level = len(m[1] or m[2] or "") or (m[3] or "").count("=") or int(m[6] or 0) or 1 + bool(m[4]) + bool(m[5])
        put(m.start(), min(level, HEADINGS) - 1)
    fences = [(m.start(), m.end()) for m in _FENCE.finditer(text)]
    if fences:
        # after a line feed, or after one and blanks, begins a line
        lines = {m.end() for m in _LINE_START.finditer(text)}
        inside = _within(fences)
        for place in depth:
            if inside(place):
                depth[place] = max(depth[place], BLANK_LINE) if place in lines else WORD
    return _tree(len(text), depth)


def token_tree(tokens: list[str]) -> Tree:
    """Boundaries of a token sequence: after sentence ends, after clauses, before words."""
    depth: dict[int, int] = {}
    for i in range(1, len(tokens)):
        before, own = tokens[i - 1], tokens[i]
        if own.startswith("##"):
            continue
        depth[i] = WORD
        if before in (".", "!", "?", "…") and own not in (".", "!", "?", "…", '"', "'", "”", "’", "»", ")", "]"):
            depth[i] = SENTENCE
        elif before in (",", ";", ":"):
            depth[i] = CLAUSE
    return _tree(len(tokens), depth)


def pack(tree: Tree, limit: int, hard) -> list[tuple[int, int]]:
    """Consecutive spans of at most ``limit``; ``hard(place, start)`` moves a forced cut left where it may not be."""

    def open_(start: int, end: int, depth: int) -> list[tuple[int, int]]:
        if end - start <= limit:
            return [(start, end)]
        while depth < DEPTHS and len(parts := tree.children(start, end, depth)) == 1:
            depth += 1
        out: list[tuple[int, int]] = []
        if depth == DEPTHS:
            while end - start > limit:
                place = max(hard(start + limit, start), start + 1)
                out.append((start, place))
                start = place
            return [*out, (start, end)]
        for part in parts:
            for s, e in open_(*part, depth + 1):
                if out and e - out[-1][0] <= limit:
                    out[-1] = (out[-1][0], e)
                else:
                    out.append((s, e))
        return out

    return open_(0, tree.size, 0) if tree.size else []


def with_overlap(tree: Tree, spans: list[tuple[int, int]], overlap: int) -> list[tuple[int, int, int]]:
    """(start with overlap, start of the new part, end) of every piece."""
    out = []
    for i, (s, e) in enumerate(spans):
        early = s
        if i and overlap:
            low = max(s - overlap, out[-1][1])
            found = tree.within(low, s, SENTENCE)
            found = tree.within(low, s, WORD) if found is None else found
            early = s if found is None else found
        out.append((early, s, e))
    return out


def _check(limit: int, overlap: int) -> None:
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap at least 0 and under the limit")


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces of one text; a text within the limit is one piece, an empty one has none."""
    _check(limit, overlap)
    if len(text) <= limit:
        return [(0, 0, len(text))] if text else []
    tree = text_tree(text)

    def hard(place: int, start: int) -> int:
        """The last place up to this one that is not within a cluster; a cluster over the limit is cut at the limit."""
        first = place
        while place > start and (unicodedata.category(text[place])[0] == "M" or text[place] in "‍️" or text[place - 1] == "‍"):
            place -= 1
        return place if place > start else first

    return with_overlap(tree, pack(tree, limit - overlap, hard), overlap)


def split_tokens(tokens: list[str] | None, size: int, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces of a token sequence; without tokens only its size is known and cuts fall at the limit."""
    _check(limit, overlap)
    if size <= limit:
        return [(0, 0, size)] if size > 0 else []
    tree = token_tree(tokens) if tokens is not None and len(tokens) == size else Tree(size, [list(range(1, size)) if d >= WORD else [] for d in range(DEPTHS)])
    return with_overlap(tree, pack(tree, limit - overlap, lambda p, s: p), overlap)


def text_pieces(df: DataFrame, key: str, text: str, *, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """(key, piece, start, new_start, end, piece_text) of texts over ``limit`` code points.

    ``start`` to ``end`` is the piece; from ``start`` to ``new_start`` it repeats
    the piece before.  Null, empty and short texts have no pieces: they need no
    cut.  Rows with one key are cut one by one; other columns are ignored.
    """
    need_columns(df, key, text)
    _check(limit, overlap)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                cuts = split_text(text, limit, overlap)
                columns = [pa.array([key] * len(cuts), pa.int64()), pa.array(range(len(cuts)), pa.int32()), *(pa.array([c[k] for c in cuts], pa.int64()) for k in range(3)), pa.array([text[s:e] for s, _, e in cuts], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "piece", "start", "new_start", "end", "piece_text"])

    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).filter(F.length("text") > limit)
    return rows.mapInArrow(run, "key bigint, piece int, start bigint, new_start bigint, end bigint, piece_text string").withColumnRenamed("key", key)


MAX_VOCABULARY = 1 << 16


def token_pieces(df: DataFrame, vocabulary: DataFrame, *, limit: int = 510, overlap: int = 50) -> DataFrame:
    """(store, doc_index, pos, piece, start, new_start, end) of documents over ``limit`` tokens.

    Offsets are those of the store.  Repeated rows count once; where one of them
    has the token ids they are used.  Without ids, or with ids that do not match
    the offsets, pieces are cut at the limit.  Rows with null offsets are left out.
    """
    need_columns(df, "store", "doc_index", "pos", "start_offset", "end_offset", "token_ids")
    need_columns(vocabulary, "id", "token")
    _check(limit, overlap)
    rows = bounded(vocabulary.filter("id is not null and token is not null"), MAX_VOCABULARY)
    sent = df.sparkSession.sparkContext.broadcast({r["id"]: r["token"] for r in rows})
    keys = ["store", "doc_index", "pos", "start_offset", "end_offset"]
    names = ["store", "doc_index", "pos", "piece", "start", "new_start", "end"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = sent.value
        for batch in batches:
            out = []
            for store, doc, pos, first, last, ids in zip(*(batch.column(c).to_pylist() for c in (*keys, "token_ids"))):
                known = None if ids is None else [token.get(i, "") for i in ids]
                for k, (s, n, e) in enumerate(split_tokens(known, last - first, limit, overlap)):
                    out.append((store, doc, pos, k, first + s, first + n, first + e))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names)

    large = df.select(*keys, "token_ids").filter(F.col("end_offset") - F.col("start_offset") > limit)
    once = large.groupBy(*keys).agg(F.max("token_ids").alias("token_ids"))
    return once.mapInArrow(run, "store int, doc_index bigint, pos bigint, piece int, start bigint, new_start bigint, end bigint")


def oversized(pieces: DataFrame, key: str) -> DataFrame:
    """Keys of the items that were cut, each once."""
    return pieces.filter("piece = 0").select(key).distinct()


def rejoined(pieces: DataFrame, key: str) -> DataFrame:
    """(key, id, fits) of texts: SHA-256 of the pieces without their overlaps, in order.

    ``fits``: every piece but the first begins where the one before ends or up
    to 200 characters earlier, and none is over 2,000.  Repeated keys are one text.
    """
    own = F.struct("piece", F.expr("substring(piece_text, cast(new_start - start + 1 as int))").alias("own"))
    fits = (F.col("end") - F.col("start") <= 2000) & (F.col("new_start") - F.col("start") <= 200) & (F.length("piece_text") == F.col("end") - F.col("start"))
    whole = pieces.groupBy(key).agg(F.array_sort(F.collect_set(own)).alias("parts"), F.min(fits).alias("fits"))
    return whole.select(key, F.sha2(F.array_join(F.transform("parts", lambda p: p["own"]), ""), 256).alias("id"), "fits")


def token_cover(pieces: DataFrame) -> DataFrame:
    """(store, doc_index, pos, tokens, fits) of documents: tokens of the pieces without their overlaps."""
    fits = (F.col("end") - F.col("start") <= 510) & (F.col("new_start") - F.col("start") <= 50) & (F.col("end") > F.col("new_start"))
    whole = pieces.groupBy("store", "doc_index", "pos").agg(F.sum(F.col("end") - F.col("new_start")).alias("tokens"), F.min(fits).alias("fits"), (F.max("end") - F.min("start")).alias("span"))
    return whole.select("store", "doc_index", "pos", "tokens", (F.col("fits") & (F.col("span") == F.col("tokens"))).alias("fits"))
