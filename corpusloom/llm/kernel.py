"""Vectorised text kernels shared by the training-data operators.

Texts of an Arrow batch are laid end to end as one array of code points, so
folding, word splitting and hashing run in numpy over millions of characters
at a time instead of per row.  Working memory is bounded by ``CHUNK_CHARS``,
whatever the batch size; a single longer text makes a chunk of its own.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

from corpusloom.functions.chars import is_dropped_by_normalization

CHUNK_CHARS = 1 << 20
BMP = 1 << 16
BASE_A = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_B = np.uint64(0xD6E8FEB86659FD93 | 1)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (xor-shift multiply), wrapping on overflow."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


SIGMA, FINAL_SIGMA = 0x3C3, 0x3C2


@functools.lru_cache(maxsize=None)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(plain, lower, alnum, opens) over the basic plane, built from ``unicodedata``.

    plain[c]: normalisation leaves c alone wherever it stands (or turns it into
    a blank), and lower-casing maps it to one character without context.
    opens[c]: c never joins with what stands before it.
    """
    plain = np.zeros(BMP, np.bool_)
    lower = np.arange(BMP, dtype=np.uint32)
    alnum = np.zeros(BMP, np.bool_)
    opens = np.ones(BMP, np.bool_)
    for i in range(BMP):
        parts = unicodedata.decomposition(chr(i)).split()
        if len(parts) == 2 and not parts[0].startswith("<") and int(parts[1], 16) < BMP:
            opens[int(parts[1], 16)] = False
    opens[0x1100:0x1200] = False
    for i in range(BMP):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        low = c.lower()
        alnum[i] = c.isalnum()
        first = unicodedata.normalize("NFKD", c)[:1]
        if unicodedata.combining(c) or unicodedata.combining(first) or (ord(first) < BMP and not opens[ord(first)]):
            opens[i] = False
        if len(low) == 1:
            lower[i] = ord(low)
        if c.isspace():
            plain[i] = True
        elif len(low) == 1 and opens[i] and not is_dropped_by_normalization(c) and unicodedata.normalize("NFKC", c) == c:
            plain[i] = True
    lower[[0x3A3, FINAL_SIGMA]] = SIGMA
    return plain, lower, alnum, opens


@functools.lru_cache(maxsize=1 << 16)
def _settled(cluster: str) -> np.ndarray:
    """What normalising and lower-casing makes of a character and the marks behind it."""
    kept = (" " if c.isspace() else c for c in unicodedata.normalize("NFKC", cluster) if not is_dropped_by_normalization(c))
    codes = np.array([ord(c) for c in "".join(kept).lower()], np.uint32)
    codes[codes == FINAL_SIGMA] = SIGMA
    return codes


@functools.lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(base: np.uint64, size: int) -> tuple[np.ndarray, np.ndarray]:
    room = 2 * CHUNK_CHARS
    while room < size:
        room *= 2
    return _powers(int(base), room)


class Chunk:
    """Lower-cased normalised code points of consecutive texts, blank-separated."""

    def __init__(self, texts: list[str]) -> None:
        plain, lower, alnum, _ = _tables()
        codes, starts, ends = _lay(texts)
        odd = np.flatnonzero(~plain[np.minimum(codes, BMP - 1)] | (codes >= BMP))
        settled = odd.size > 0
        if settled:
            codes, starts, ends, done = _settle(codes, starts, ends, odd)
        self.codes = np.where(codes < BMP, lower[np.minimum(codes, BMP - 1)], codes)
        if settled:
            self.codes[done] = codes[done]
        self.starts, self.ends = starts, ends
        self.alnum = alnum[np.minimum(self.codes, BMP - 1)]
        for i in np.flatnonzero(self.codes >= BMP):
            self.alnum[i] = chr(int(self.codes[i])).isalnum()

    def fold_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two rolling polynomial hashes and the length of letters and digits."""
        at = np.concatenate(([0], np.cumsum(self.alnum)))
        kept = mix(self.codes[self.alnum].astype(np.uint64) + _U(1))
        first, last = at[self.starts], at[self.ends]
        keys = []
        for base in (BASE_A, BASE_B):
            up, down = powers(base, kept.size + 1)
            run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(kept * up[: kept.size], dtype=np.uint64)))
            keys.append(mix((run[last] - run[first]) * down[first]).view(np.int64))
        return keys[0], keys[1], last - first

    def letters(self, i: int) -> bytes:
        """Letters and digits of one text in order, for whole comparisons."""
        own = slice(self.starts[i], self.ends[i])
        return self.codes[own][self.alnum[own]].tobytes()

    def pointers(self, i: int) -> np.ndarray:
        """Places of a text's letters and digits: where a pointer stops that skips all else."""
        return self.starts[i] + np.flatnonzero(self.alnum[self.starts[i] : self.ends[i]])

    def same(self, i: int, other: Chunk, j: int) -> bool:
        """Whether two texts agree at all stops of two pointers, compared stretch by stretch."""
        a, b = self.pointers(i), other.pointers(j)
        return a.size == b.size and all(np.array_equal(self.codes[a[s : s + BMP]], other.codes[b[s : s + BMP]]) for s in range(0, a.size, BMP))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, document, start, end) of the runs of letters and digits."""
        edge = np.diff(np.concatenate(([0], self.alnum.view(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        n = self.codes.size
        up, down = powers(BASE_A, n + 1)
        value = mix(self.codes.astype(np.uint64) + _U(1)) * up[:n]
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
        word = mix((run[end] - run[start]) * down[start])
        return word, np.searchsorted(self.ends, start, side="right"), start, end

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, document) of every run of ``size`` consecutive words."""
        return self.placed_shingles(size)[:2]

    def placed_shingles(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, document, first word) of every run of ``size`` consecutive words, and the hashes of all words."""
        word, doc, _, _ = self.words()
        if word.size < size:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), word
        up, _ = powers(BASE_B, size + 1)
        m = word.size - size + 1
        value = np.zeros(m, np.uint64)
        for k in range(size):
            value += word[k : k + m] * up[k + 1]
        whole = np.flatnonzero(doc[:m] == doc[size - 1 :])
        return mix(value)[whole], doc[whole], whole, word


def _settle(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with every cluster that holds an odd character replaced by its normalised, lower-cased form.

    A cluster is a character that opens one and those that may join with it;
    texts and blanks between them are never joined.  Also returned: the places
    of what was replaced.
    """
    opens = np.where(codes < BMP, _tables()[3][np.minimum(codes, BMP - 1)], True)
    for i in np.flatnonzero(codes >= BMP).tolist():
        opens[i] = unicodedata.combining(chr(int(codes[i]))) == 0
    opens[starts[starts < codes.size]] = True
    opens[ends] = True
    first = np.flatnonzero(opens)
    which = np.unique(np.searchsorted(first, odd, side="right") - 1)
    begin, end = first[which], np.append(first, codes.size)[which + 1]
    counts = np.ones(codes.size, np.int64)
    new = []
    for a, b in zip(begin.tolist(), end.tolist()):
        own = _settled(codes[a:b].tobytes().decode("utf-32-le", "surrogatepass"))
        counts[a:b] = 0
        counts[a] = own.size
        new.append(own)
    offset = np.cumsum(counts) - counts
    out = np.repeat(codes, counts)
    size = counts[begin]
    done = np.repeat(offset[begin] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    out[done] = np.concatenate(new)
    at = np.append(offset, out.size)
    return out, at[starts], at[ends], done


def _lay(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a line feed; starts and ends."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size + 1) - 1
    return codes, ends - size, ends


def chunks(texts: Iterable[str], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Consecutive texts, at most ``limit`` characters or one text a list."""
    own: list[str] = []
    held = 0
    for text in texts:
        if own and held + len(text) > limit:
            yield own
            own, held = [], 0
        own.append(text)
        held += len(text) + 1
    if own:
        yield own


def unique_per_document(value: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, sorted, and bounds: n + 1 offsets."""
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    if value.size:
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])))
        value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(n + 1))
