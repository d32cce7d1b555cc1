"""Problem 9: the language of documents and of their segments.

Method: script ranges narrow the candidates of every word (Cyrillic words admit
Cyrillic languages only, Latin words the others, words of any other script or with
letters that no language of the sample uses none of them: ``other``), then Viterbi
over per-word scores with a switching penalty labels spans.  Long texts are
labelled in blocks of words at a time: each block is solved for every label that
may stand before it, and the blocks are chained, which gives the same labels.  Scores are clipped log-likelihood
ratios of whole words, and of endings for words the model has not seen, fitted
on a bounded sample of labelled rows together with the frequent words given.
A switch is cheap where a sentence ends, dearer at a line break and dearest
inside a sentence, so a foreign phrase does not become a segment of its own.

Confidence is calibrated: windows of 1 to 64 words of texts that the word scores
were not fitted on are labelled, and the share of right ones, made monotone in
the lead of the best language over the second, is what a lead is worth.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import bounded, need_columns, text_groups
from .kernel import BMP, Chunk, mix

FIT_ROWS = 4_000
MAX_FREQUENT = 100_000
SENTENCE, LINE, INSIDE = 3.0, 6.0, 14.0
CLIP = 4.0
ENDING = 3
OTHER = "other"
#: Words a block of a long text holds, and blocks that make a text long; words from which on a script's letters are known; windows that calibrate.
BLOCK_WORDS, LONG = 512, 16
ALPHABET_WORDS = 1_000
LEAST_WINDOWS = 500

# Languages of the project and the names labels give them.
LANGUAGES = ("en", "fr", "de", "es", "it", "nl", "ru")
CYRILLIC = ("ru",)
NAMES = {
    "en": "en eng english",
    "fr": "fr fra fre french français francais",
    "de": "de deu ger german deutsch",
    "es": "es spa esp spanish español espanol castellano",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands",
    "ru": "ru rus russian русский",
}
_BY_NAME = {name: code for code, names in NAMES.items() for name in names.split()}


def read_label(label: str | None) -> str | None:
    """The language a label names; None where it is missing or names none of the project's."""
    first = re.split(r"[-_\s(]", (label or "").strip().lower(), maxsplit=1)[0]
    return _BY_NAME.get(first)


@dataclass
class Model:
    """Scores of known words and endings; rows of ``score`` in the order of ``known``.

    ``foreign[c]``: no language writes with the letter c of the basic plane.
    ``leads`` and ``worth``: the share of right labels at rising leads; empty
    where too little was there to calibrate.
    """

    languages: tuple[str, ...]
    known: np.ndarray
    score: np.ndarray
    cyrillic: np.ndarray
    foreign: np.ndarray
    leads: np.ndarray
    worth: np.ndarray

    @property
    def names(self) -> tuple[str, ...]:
        return (*self.languages, OTHER)

    def words(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(score, document, start, end) of every word of a chunk; the last column is ``other``."""
        word, doc, start, end = chunk.words()
        k = len(self.languages)
        out = np.zeros((word.size, k + 1), np.float32)
        if not word.size:
            return out, doc, start, end
        out[:, k] = -0.5
        hit, row = self._find(word)
        out[hit, :k] = self.score[row]
        out[hit, k] = -CLIP
        rest = np.flatnonzero(~hit & (end - start > ENDING + 1))
        found, row = self._find(ending_hash(chunk.codes, end[rest]))
        out[rest[found], :k] = self.score[row] * 0.5
        code = chunk.codes[start]
        letter = (code > 57) | (code < 48)
        east = (code >= 0x400) & (code < 0x530)
        wrong = np.where(east[:, None], ~self.cyrillic[None, :], self.cyrillic[None, :]) & letter[:, None]
        out[~letter] = 0
        out[:, :k][wrong] = -CLIP
        strange = np.concatenate(([0], np.cumsum(self.foreign[np.minimum(chunk.codes, self.foreign.size - 1)] | (chunk.codes >= self.foreign.size))))
        away = np.flatnonzero((strange[end] > strange[start]) & letter & ~hit)
        out[away, :k], out[away, k] = -CLIP, CLIP
        return out, doc, start, end

    def confidence(self, sums: np.ndarray) -> np.ndarray:
        """What the lead of the best of each row of summed scores is worth."""
        if not self.leads.size:
            return _softmax(sums)
        return np.interp(_lead(sums), self.leads, self.worth)

    def _find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.known.size:
            return np.zeros(value.size, np.bool_), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, value), self.known.size - 1)
        hit = self.known[at] == value
        return hit, at[hit]


def ending_hash(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the last letters of words that end before ``end``."""
    value = np.full(end.size, 0xE0D1, np.uint64)
    for k in range(ENDING, 0, -1):
        value = mix(value * np.uint64(31) + codes[end - k].astype(np.uint64))
    return value


def _scripts(code: np.ndarray) -> np.ndarray:
    """0 for Latin letters, 1 for Cyrillic ones, 2 for letters of other scripts."""
    latin = (code < 0x250) | (code >= 0x1E00) & (code < 0x1F00) | (code >= 0x2C60) & (code < 0x2C80) | (code >= 0xA720) & (code < 0xA800)
    return np.where(latin, 0, np.where((code >= 0x400) & (code < 0x530), 1, 2))


def _foreign(texts: list[str], labels: list[str], index: dict[str, int]) -> np.ndarray:
    """Letters that no language of the sample uses: those of other scripts, and rare ones of a script that is well known."""
    letter = np.array([chr(i).isalpha() for i in range(BMP)])
    script = _scripts(np.arange(BMP))
    seen, words = np.zeros(BMP, np.int64), np.zeros(3, np.int64)
    for s in range(0, len(texts), 256):
        chunk = Chunk([t if x in index else "" for t, x in zip(texts[s : s + 256], labels[s : s + 256])])
        own = np.minimum(chunk.codes, BMP - 1)
        seen += np.bincount(own, minlength=BMP)
        words += np.bincount(_scripts(chunk.codes[chunk.words()[2]]), minlength=3)
    total = np.bincount(script[letter], seen[letter], 3)
    rare = seen < 1e-5 * total[script] + 1
    out = letter & ((script == 2) | (rare & (words[script] >= ALPHABET_WORDS)))
    out[np.arange(BMP) < 128] = False
    return out


def _lead(sums: np.ndarray) -> np.ndarray:
    top = np.sort(sums, axis=1)
    return top[:, -1] - top[:, -2]


def calibrated(model: Model, texts: list[str], labels: list[str]) -> Model:
    """The model with the worth of leads, from windows of texts it was not fitted on."""
    index = {code: i for i, code in enumerate(model.languages)}
    lead, right = [np.zeros(0)], [np.zeros(0)]
    for s in range(0, len(texts), 256):
        told = np.array([index.get(x, -1) for x in labels[s : s + 256]])
        chunk = Chunk(texts[s : s + 256])
        score, doc, start, _ = model.words(chunk)
        run = np.concatenate((np.zeros((1, score.shape[1])), np.cumsum(score, axis=0)))
        bounds = np.searchsorted(doc, np.arange(len(told) + 1))
        for size in (1, 2, 4, 8, 16, 32, 64):
            first = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b - size + 1, max(size, 16)) for a, b in zip(bounds, bounds[1:]))])
            own = told[doc[first]] if first.size else first
            first, own = first[own >= 0], own[own >= 0]
            sums = run[first + size] - run[first]
            ahead = _lead(sums)
            lead.append(ahead[ahead > 0])
            right.append((sums.argmax(axis=1) == own)[ahead > 0])
    x, y = np.concatenate(lead), np.concatenate(right).astype(float)
    if x.size < LEAST_WINDOWS:
        return model
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    # bins of equal numbers, then pooled until their shares rise
    bins = np.array_split(np.arange(x.size), min(64, x.size // 50))
    pools: list[list[float]] = []
    for b in bins:
        pools.append([y[b].sum(), b.size, x[b].sum()])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last)]
    leads = np.array([0.0, *(p[2] / p[1] for p in pools)])
    worth = np.array([1 / len(model.names), *((p[0] + 1) / (p[1] + 2) for p in pools)])
    model.leads, model.worth = leads, np.maximum.accumulate(worth)
    return model


def fit(texts: list[str], labels: list[str], frequent: list[tuple[str, str]], languages: tuple[str, ...] = LANGUAGES) -> Model:
    """A model from labelled texts and (language, word) pairs.

    Texts whose frequent words speak for another language than their label are
    left out, so wrong labels do not teach.
    """
    k = len(languages)
    index = {code: i for i, code in enumerate(languages)}
    given = sorted({(index[code], w) for code, w in frequent if code in index})
    value, kind, weight = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    often, speaks = np.zeros(0, np.uint64), np.zeros((1, k))
    if given:
        hashes, doc, _, _ = Chunk([w for _, w in given]).words()
        own = np.array([i for i, _ in given])[doc]
        often, at = np.unique(hashes, return_inverse=True)
        speaks = np.zeros((often.size + 1, k))
        speaks[at, own] = 1
        value, kind, weight = [hashes], [own], [np.full(own.size, 20.0)]
    for s in range(0, len(texts), 256):
        part = texts[s : s + 256]
        told = np.array([index.get(x, -1) for x in labels[s : s + 256]])
        chunk = Chunk(part)
        word, doc, start, end = chunk.words()
        votes = np.zeros((len(part), k))
        if often.size:
            at = np.minimum(np.searchsorted(often, word), often.size - 1)
            np.add.at(votes, doc, speaks[np.where(often[at] == word, at, often.size)])
        trusted = (told >= 0) & (~votes.any(axis=1) | (votes.argmax(axis=1) == told))
        keep = trusted[doc]
        tail = np.flatnonzero(keep & (end - start > ENDING + 1))
        value += [word[keep], ending_hash(chunk.codes, end[tail])]
        kind += [told[doc[keep]], told[doc[tail]]]
        weight += [np.ones(int(keep.sum())), np.ones(tail.size)]
    foreign = _foreign(texts, labels, index)
    known, at = np.unique(np.concatenate(value), return_inverse=True)
    counts = np.bincount(at * k + np.concatenate(kind), np.concatenate(weight), known.size * k).reshape(-1, k)
    enough = counts.sum(axis=1) >= 3
    total = counts.sum(axis=0) + 1
    known, counts = known[enough], counts[enough]
    rate = (counts + 0.5) / (total + 1000)
    score = np.log(rate)
    if known.size:
        score -= np.sort(score, axis=1)[:, -2:].mean(axis=1, keepdims=True)
        score = np.clip(score, -CLIP, CLIP)
    return Model(tuple(languages), known, score.astype(np.float32), np.array([c in CYRILLIC for c in languages]), foreign, np.zeros(0), np.zeros(0))


def _switch_costs(chunk: Chunk, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost of a switch before each word, whether a sentence ends before it)."""
    code = chunk.codes
    stop = np.isin(code, np.array([0x2E, 0x21, 0x3F, 0x2026, 0x3B, 0x3002], np.uint32))
    line = code == 10
    at_stop = np.concatenate(([0], np.cumsum(stop)))
    at_line = np.concatenate(([0], np.cumsum(line)))
    before = np.concatenate(([0], end[:-1])) if end.size else end
    ended = at_stop[start] > at_stop[before]
    broke = at_line[start] > at_line[before]
    twice = at_line[start] > at_line[before] + 1
    first = np.concatenate(([True], doc[1:] != doc[:-1])) if doc.size else np.zeros(0, np.bool_)
    sentence = ended | twice | first
    return np.where(sentence, SENTENCE, np.where(broke, LINE, INSIDE)).astype(np.float32), sentence


def _blocks(score: np.ndarray, cost: np.ndarray, first: int, last: int, block: int) -> np.ndarray:
    """Best labels of one long sequence, whose blocks advance together for every label before them."""
    k, n = score.shape[1], last - first
    count = -(-n // block)
    pad = count * block - n
    # words that are only padding change nothing: no score, and a switch that never pays
    s = np.concatenate((score[first:last], np.zeros((pad, k), score.dtype))).reshape(count, block, k)
    c = np.concatenate((cost[first:last], np.full(pad, np.inf, cost.dtype))).reshape(count, block)
    value = np.where(np.eye(k, dtype=np.bool_)[None], 0, -np.inf).repeat(count, 0).astype(np.float64)
    value[0] = 0
    stay = np.ones((block, count, k, k), np.bool_)
    best = np.zeros((block, count, k), np.int8)
    for t in range(block):
        top = value.argmax(axis=2)
        jump = np.take_along_axis(value, top[:, :, None], 2) - c[:, t, None, None]
        if t == 0:
            jump[0] = -np.inf
        keep = value >= jump
        stay[t], best[t] = keep, top
        value = np.where(keep, value, jump) + s[:, t, None, :]
    entry = np.zeros((count, k), np.int64)
    ahead = value[0, 0]
    for b in range(1, count):
        both = ahead[:, None] + value[b]
        entry[b] = both.argmax(axis=0)
        ahead = both.max(axis=0)
    leave = np.zeros(count, np.int64)
    leave[-1] = ahead.argmax()
    for b in range(count - 1, 0, -1):
        leave[b - 1] = entry[b, leave[b]]
    begin = np.concatenate(([0], leave[:-1]))
    out = np.zeros((count, block), np.int8)
    now, rows = leave.copy(), np.arange(count)
    for t in range(block - 1, -1, -1):
        out[:, t] = now
        now = np.where(stay[t, rows, begin, now], now, best[t, rows, begin])
    return out.reshape(-1)[:n]


def viterbi(score: np.ndarray, cost: np.ndarray, first: np.ndarray, last: np.ndarray, block: int = BLOCK_WORDS) -> np.ndarray:
    """Best label of every word; sequences [first, last) advance together, step by step, long ones in blocks."""
    label = np.zeros(score.shape[0], np.int8)
    size = last - first
    for i in np.flatnonzero(size > LONG * block).tolist():
        label[first[i] : last[i]] = _blocks(score, cost, int(first[i]), int(last[i]), block)
    short = size <= LONG * block
    first, last, size = first[short], last[short], size[short]
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    steps = int(size[0]) if size.size else 0
    if not steps:
        return label
    stay = np.ones(score.shape, np.bool_)
    best = np.zeros(score.shape[0], np.int8)
    active = np.searchsorted(-size, -np.arange(steps), side="left")
    value = score[first[: active[0]]].copy()
    for t in range(1, steps):
        n = active[t]
        at = first[:n] + t
        value = value[:n]
        top = value.argmax(axis=1)
        jump = value[np.arange(n), top] - cost[at]
        keep = value >= jump[:, None]
        stay[at] = keep
        best[at] = top
        value = np.where(keep, value, jump[:, None]) + score[at]
        if t + 1 == steps or active[t + 1] < n:
            done = active[t + 1] if t + 1 < steps else 0
            label[first[done:n] + t] = value[done:n].argmax(axis=1)
    ones = np.flatnonzero(size == 1)
    label[first[ones]] = score[first[ones]].argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        at = first[: active[t]] + t
        now = label[at]
        label[at - 1] = np.where(stay[at, now], now, best[at])
    return label


SEGMENT = "key bigint, segment int, lang string, confidence double, start_word bigint, words bigint"
DOCUMENT = "key bigint, lang string, confidence double, langs array<string>"


def _softmax(sums: np.ndarray) -> np.ndarray:
    """Softmax weight of the best of each row of summed scores."""
    shifted = sums - sums.max(axis=1, keepdims=True)
    return 1.0 / np.exp(np.minimum(shifted, 0)).sum(axis=1)


def _label_groups(batches: Iterable[pa.RecordBatch], model: Model):
    for batch, group in text_groups(batches, "text"):
        chunk = Chunk(group)
        score, doc, start, end = model.words(chunk)
        cost, sentence = _switch_costs(chunk, doc, start, end)
        bounds = np.searchsorted(doc, np.arange(len(group) + 1))
        some = np.flatnonzero(np.diff(bounds) > 0)
        label = viterbi(score, cost, bounds[some], bounds[some + 1])
        letter = ~((chunk.codes[start] >= 48) & (chunk.codes[start] <= 57)) if start.size else np.zeros(0, np.bool_)
        yield batch, group, score, doc, sentence, bounds, label, letter


def segments(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, segment, lang, confidence, start_word, words): labelled spans of every text.

    Null and blank texts and texts without a letter have no segments.
    """
    need_columns(df, key, text)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch, group, score, doc, _, bounds, label, letter in _label_groups(batches, model):
            has = np.add.reduceat(letter, bounds[:-1][np.diff(bounds) > 0]) > 0 if letter.size else np.zeros(0, np.bool_)
            spoken = np.zeros(len(group), np.bool_)
            spoken[np.diff(bounds) > 0] = has
            new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])))) if doc.size else np.zeros(0, np.int64)
            new_doc = doc[new]
            length = np.diff(np.concatenate((new, [doc.size])))
            sums = np.add.reduceat(score, new, axis=0) if new.size else np.zeros((0, len(model.names)))
            first = np.searchsorted(new_doc, new_doc)
            keep = spoken[new_doc]
            names = np.array(model.names, object)[label[new]]
            rows = [batch.column("key").take(pa.array(new_doc[keep])), pa.array((np.arange(new.size) - first)[keep], pa.int32()), pa.array(names[keep].tolist(), pa.string()), pa.array(model.confidence(sums)[keep].astype(float), pa.float64()), pa.array((new - bounds[new_doc])[keep], pa.int64()), pa.array(length[keep], pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, ["key", "segment", "lang", "confidence", "start_word", "words"])

    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    return rows.mapInArrow(run, SEGMENT).withColumnRenamed("key", key)


def documents(df: DataFrame, key: str, text: str, model: Model, *, least_words: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, lang, confidence, langs) and the string columns to carry: main language, and all languages with whole sentences.

    A sentence counts for a language when four fifths of its words carry that
    label and it has ``least_words`` words or more; a text without such a
    sentence has its main language only.  Null and blank texts and texts without
    a letter have a null language and no languages.
    """
    need_columns(df, key, text)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        k = len(model.names)
        for batch, group, score, doc, sentence, bounds, label, letter in _label_groups(batches, model):
            votes = np.zeros((len(group), k), np.int64)
            np.add.at(votes, (doc[letter], label[letter]), 1)
            sums = np.zeros((len(group), k))
            some = np.diff(bounds) > 0
            if doc.size:
                sums[some] = np.add.reduceat(score, bounds[:-1][some], axis=0)
            main = votes.argmax(axis=1)
            spoken = votes.sum(axis=1) > 0
            whole = np.zeros((len(group), k), np.bool_)
            if doc.size:
                begin = np.flatnonzero(sentence)
                of = np.cumsum(sentence) - 1
                inside = np.zeros((begin.size, k), np.int64)
                np.add.at(inside, (of[letter], label[letter]), 1)
                words = inside.sum(axis=1)
                top = inside.argmax(axis=1)
                strong = np.add.reduceat(score, begin, axis=0)[np.arange(begin.size), top] > 0
                ok = (words >= least_words) & (inside.max(axis=1) * 5 >= words * 4) & strong
                whole[doc[begin[ok]], top[ok]] = True
            whole[spoken & ~whole.any(axis=1), main[spoken & ~whole.any(axis=1)]] = True
            names = model.names
            lang = [names[m] if s else None for m, s in zip(main.tolist(), spoken.tolist())]
            langs = [[names[j] for j in np.flatnonzero(w)] for w in whole]
            sure = [float(c) if s else None for c, s in zip(model.confidence(sums), spoken)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(langs, pa.list_(pa.string())), *(batch.column(c) for c in carry)], ["key", "lang", "confidence", "langs", *carry])

    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), *carry)
    return rows.mapInArrow(run, ", ".join([DOCUMENT, *(f"{c} string" for c in carry)])).withColumnRenamed("key", key)


def fit_from(df: DataFrame, key: str, text: str, label: str, frequent: DataFrame, *, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``fit_rows`` labelled rows, those of smallest key hash, and the frequent words.

    The sample is the only part that is bounded; every row is labelled.
    """
    known = F.regexp_extract(F.lower(F.col(label)), r"^\s*([^-_\s(]+)", 1).isin(*_BY_NAME)
    told = df.filter(known & F.col(text).isNotNull())
    share = min(1.0, 2 * fit_rows / max(1, told.count()))
    # twice the rows wanted are left to sort, whatever the table's size
    most = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    rows = told.select(F.xxhash64(key).alias("h"), F.col(text).alias("text"), F.col(label).alias("label")).filter(F.col("h") <= most)
    taken = rows.orderBy("h", "label").limit(fit_rows).toArrow()
    labels = [read_label(x) or "" for x in taken["label"].to_pylist()]
    words = [(r["lang"], r["word"]) for r in bounded(frequent.select("lang", "word").filter("lang is not null and word is not null"), MAX_FREQUENT)]
    texts = taken["text"].to_pylist()
    # three quarters give the scores, the rest says what their leads are worth
    held = [i for i in range(len(texts)) if i % 4 == 3]
    rest = [i for i in range(len(texts)) if i % 4 != 3]
    model = fit([texts[i] for i in rest], [labels[i] for i in rest], words)
    trusted = [i for i in held if _speaks(model, texts[i]) in (None, labels[i])]
    return calibrated(model, [texts[i] for i in trusted], [labels[i] for i in trusted])


def _speaks(model: Model, text: str) -> str | None:
    """The language of a text by all its words; a label against it is taken for wrong, as in ``fit``."""
    sums = model.words(Chunk([text]))[0].sum(axis=0)
    return model.names[int(sums.argmax())] if sums.any() else None


def wrong_or_mixed(df: DataFrame, key: str, text: str, label: str, model: Model) -> DataFrame:
    """(key, lang): rows with a missing or wrong label, and mixed rows, one row per language of the model."""
    known = F.create_map(*[F.lit(x) for pair in _BY_NAME.items() for x in pair])
    told = known[F.regexp_extract(F.lower(F.col(label)), r"^\s*([^-_\s(]+)", 1)]
    named = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), told.alias("told"))
    found = documents(named, "key", "text", model, carry=("told",))
    case = found.filter("lang is not null and (size(langs) > 1 or told is null or told <> get(langs, 0))")
    return case.select(F.col("key").alias(key), F.explode("langs").alias("lang")).filter(F.col("lang") != OTHER)
