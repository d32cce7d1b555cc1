"""Problem 5: duplicates hidden by case, blanks, punctuation or field order.

Method: every text is streamed through a skip-and-fold table (``kernel``): blanks,
punctuation and symbols have no entry, letters are folded to lower case, and what
is left feeds two rolling polynomial hashes.  No canonical string is built; a
character that joins with marks is folded together with them.  Rows whose hashes
and lengths agree are sent to the first row of their group, which streams past
them: two pointers that skip the same characters compare the texts.  A row that
fails the comparison (a hash collision) is grouped again by a digest of its
folded characters, so the result is exact.

JSON records hash the same way: strings by their folded characters, numbers by
value, objects as the sum over fields of a mix of name and value (field order
cannot matter), arrays as a polynomial over their elements.  Parsing, hashing
and comparing use no recursion, so nesting may be of any depth.

A group of more than ``GROUP_ROWS`` rows is dealt to several tasks, each of which
gets the first row once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from decimal import Decimal
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.chars import normalize_text
from corpusloom.plans.lineage import cut

from .arrow import need_columns, parallelism, text_groups
from .kernel import Chunk, chunks

M = (1 << 64) - 1
#: Rows of a group that one task compares, and the share of all rows a group must have to be dealt to several.
GROUP_ROWS, GROUP_SHARE = 50_000, 1_000
#: Nesting up to which ``record_copies`` looks unless told otherwise.
MAX_DEPTH = 200


def same_folded(a: str, b: str) -> bool:
    """Whether two texts have the same letters and digits in order; case does not count."""
    return a == b or Chunk([a]).same(0, Chunk([b]), 0)


def same_json(a: object, b: object) -> bool:
    """Equal fields in any order; strings as in ``same_folded``, numbers by value."""
    left = [(a, b)]
    while left:
        a, b = left.pop()
        if isinstance(a, str) and isinstance(b, str):
            if not same_folded(a, b):
                return False
        elif isinstance(a, bool) or isinstance(b, bool) or a is None or b is None:
            if a is not b:
                return False
        elif isinstance(a, dict) and isinstance(b, dict):
            if a.keys() != b.keys():
                return False
            left.extend((v, b[k]) for k, v in a.items())
        elif isinstance(a, list) and isinstance(b, list):
            if len(a) != len(b):
                return False
            left.extend(zip(a, b))
        elif isinstance(a, (dict, list, str)) or isinstance(b, (dict, list, str)) or a != b:
            return False
    return True


def _scramble(x: int) -> int:
    x &= M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def _name(key: str, salt: int) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=8, salt=salt.to_bytes(2, "big")).digest(), "big")


def _nodes(record: dict) -> list[tuple[object, list[int]]]:
    """Values of a record with the places of their own values, children behind their parents."""
    out: list[tuple[object, list[int]]] = [(record, [])]
    for value, below in out:
        if isinstance(value, (dict, list)):
            own = list(value.values()) if isinstance(value, dict) else value
            below.extend(range(len(out), len(out) + len(own)))
            out.extend((v, []) for v in own)
    return out


def _json_key(nodes: list[tuple[object, list[int]]], folded: Iterator[int], salt: int) -> int:
    """Structural hash; ``folded`` yields the hash of each string in the order of the nodes."""
    key = [_scramble(next(folded) + 0x11 + salt) if isinstance(v, str) else 0 for v, _ in nodes]
    for i in range(len(nodes) - 1, -1, -1):
        value, below = nodes[i]
        if isinstance(value, str):
            continue
        if value is None or isinstance(value, bool):
            key[i] = _scramble((2 if value is None else int(value)) + 0x2200 + salt)
        elif isinstance(value, dict):
            total = sum(_scramble(_name(k, salt) ^ _scramble(key[j] + 0x33)) for k, j in zip(value, below))
            key[i] = _scramble(total + 0x44 + len(value))
        elif isinstance(value, list):
            run = 0x55
            for j in below:
                run = (run * 0x9E3779B97F4A7C15 + key[j]) & M
            key[i] = _scramble(run)
        else:
            key[i] = _scramble(hash(value) + 0x66 + salt)
    return key[0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, k1, k2, size): hash pair and count of the letters and digits of non-blank texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in text_groups(batches, "text"):
            one, two, size = Chunk(group).fold_keys()
            blank = np.fromiter((s == 0 and normalize_text(t) is None for s, t in zip(size, group)), np.bool_, len(group))
            keep = pa.array(~blank)
            yield pa.RecordBatch.from_arrays([batch.column("key").filter(keep), pa.array(one).filter(keep), pa.array(two).filter(keep), pa.array(size, pa.int64()).filter(keep)], ["key", "k1", "k2", "size"])

    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull() & F.col("text").isNotNull())
    return rows.mapInArrow(run, "key bigint, k1 bigint, k2 bigint, size bigint")


_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|(")|(-?(?:0|[1-9]\d*))((?:\.\d+)?(?:[eE][-+]?\d+)?)|(true|false|null))')
_NAMED = {"true": True, "false": False, "null": None}


def _whole(digits: str) -> int | Decimal:
    return int(digits) if len(digits) <= 4_000 else Decimal(digits)


def _no_constant(name: str) -> object:
    raise ValueError(f"{name} is no JSON")


def _loads(line: str) -> object:
    """A JSON value of any depth, by the rules of ``json.loads`` without NaN and infinities."""
    open_: list[tuple[object, list]] = []
    at, wait = 0, "value"
    value: object = None
    while True:
        m = _TOKEN.match(line, at)
        if not m:
            raise ValueError("no JSON value")
        at, mark, closed = m.end(), m[1], False
        if wait in ("value", "first", "name", "first name") and mark not in ("]", "}"):
            if wait.endswith("name"):
                if not m[2]:
                    raise ValueError("a name must be a string")
                name, at = scanstring(line, at)
                open_[-1][1].append(name)
                wait = "colon"
                continue
            if mark in ("{", "["):
                open_.append(({} if mark == "{" else [], []))
                wait = "first name" if mark == "{" else "first"
                continue
            if mark:
                raise ValueError("no JSON value")
            if m[2]:
                value, at = scanstring(line, at)
            elif m[5]:
                value = _NAMED[m[5]]
            else:
                value = float(m[3] + m[4]) if m[4] else _whole(m[3])
            closed = True
        elif wait == "colon" and mark == ":":
            wait = "value"
        elif wait == "comma" and mark == ",":
            wait = "name" if isinstance(open_[-1][0], dict) else "value"
        elif open_ and mark == ("}" if isinstance(open_[-1][0], dict) else "]") and wait in ("comma", "first name" if mark == "}" else "first"):
            value, closed = open_.pop()[0], True
        else:
            raise ValueError("no JSON value")
        if closed:
            if not open_:
                if line[at:].strip(" \t\n\r"):
                    raise ValueError("more than one value")
                return value
            holder, names = open_[-1]
            if isinstance(holder, dict):
                holder[names.pop()] = value
            else:
                holder.append(value)
            wait = "comma"


def load_object(line: str, depth: int | None = None) -> dict | None:
    """The JSON object of a line; None for anything else, or one nested deeper than ``depth``."""
    try:
        value = json.loads(line, parse_int=_whole, parse_constant=_no_constant)
    except RecursionError:
        try:
            value = _loads(line)
        except ValueError:
            return None
    except ValueError:
        return None
    if not isinstance(value, dict):
        return None
    level, n = [value], 0
    while depth is not None and level and n <= depth:
        level = [v for x in level for v in (x.values() if isinstance(x, dict) else x) if isinstance(v, (dict, list))]
        n += 1
    return None if depth is not None and level else value


def json_keys(df: DataFrame, key: str, value: str, least: int, depth: int | None = None) -> DataFrame:
    """(key, k1, k2, size) of JSON objects with a string ``text`` of ``least`` characters when normalised."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            at = 0
            for lines in chunks(batch.column("text").to_pylist()):
                held, flat = [], []
                for k, line in zip(keys[at : at + len(lines)], lines):
                    record = load_object(line, depth)
                    text = record.get("text") if record else None
                    if isinstance(text, str) and len(normalize_text(text) or "") >= least:
                        nodes = _nodes(record)
                        held.append((k, nodes))
                        flat.extend(v for v, _ in nodes if isinstance(v, str))
                at += len(lines)
                one, two, size = Chunk(flat).fold_keys() if flat else ([], [], [])
                a = iter([int(x) & M for x in one])
                b = iter([int(x) & M for x in two])
                rows = [(k, _signed(_json_key(r, a, 0)), _signed(_json_key(r, b, 1)), len(r)) for k, r in held]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["key", "k1", "k2", "size"])

    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(value).alias("text")).filter(F.col("key").isNotNull() & F.col("text").isNotNull())
    return rows.mapInArrow(run, "key bigint, k1 bigint, k2 bigint, size bigint")


def _letters(text: str) -> bytes:
    return Chunk([text]).letters(0)


def _digest(value: object) -> str:
    """Digest of the folded content of a text or a record, used only for rows that fail the comparison."""
    if isinstance(value, str):
        return hashlib.sha256(_letters(value)).hexdigest()
    nodes = _nodes(value)
    own: list[bytes] = [b""] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        v, below = nodes[i]
        if isinstance(v, str):
            plain = b"s" + _letters(v)
        elif isinstance(v, dict):
            plain = b"o" + b"".join(sorted(hashlib.sha256(k.encode("utf-8", "surrogatepass")).digest() + own[j] for k, j in zip(v, below)))
        elif isinstance(v, list):
            plain = b"a" + b"".join(own[j] for j in below)
        elif v is None or isinstance(v, bool):
            plain = b"c" + repr(v).encode()
        else:
            whole = v == v and v not in (float("inf"), float("-inf")) and v == int(v)
            plain = b"n" + (hex(int(v)) if whole else repr(v)).encode()
        own[i] = hashlib.sha256(plain).digest()
    return own[0].hex()


def _compared(batches: Iterable[pa.RecordBatch], is_json: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (first_no, salt, kind): every member against the first row of its group."""
    now, head, whole = None, None, None
    for batch in batches:
        for own, group in text_groups([batch], "text"):
            chunk = None if is_json else Chunk(group)
            ok, digest, keep = [], [], []
            rows = zip(*(own.column(c).to_pylist() for c in ("first_no", "salt", "kind")))
            for i, (first, salt, kind) in enumerate(rows):
                if kind == 0:
                    now, head, whole = (first, salt), group[i], (load_object(group[i]) if is_json else Chunk([group[i]]))
                    continue
                if (first, salt) != now:
                    raise ValueError("a member came without the first row of its group")
                same = head == group[i] or (same_json(whole, load_object(group[i])) if is_json else whole.same(0, chunk, i))
                ok.append(same)
                digest.append(None if same else _digest(load_object(group[i]) if is_json else group[i]))
                keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([own.column("first_no").take(at), own.column("copy_no").take(at), pa.array(ok, pa.bool_()), pa.array(digest, pa.string())], ["first_no", "copy_no", "ok", "digest"])


def _groups(df: DataFrame, key: str, text: str, keys: DataFrame, is_json: bool) -> DataFrame:
    """(first_no, copy_no) for every verified member other than the smallest of its group."""
    by = ["k1", "k2", "size"]
    keys = cut(keys)
    groups = keys.groupBy(*by).agg(F.min("key").alias("first_no"), F.count("*").alias("copies")).filter("copies > 1")
    # at most GROUP_SHARE groups can hold so many rows each
    least = max(GROUP_ROWS, keys.count() // GROUP_SHARE)
    parts = F.ceil(F.col("copies") / GROUP_ROWS).cast("int")
    hot = F.broadcast(groups.filter(F.col("copies") > least).select(*by, parts.alias("parts")))
    salted = keys.join(hot, by, "left").withColumn("salt", F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.when(F.col("copies") > least, parts).otherwise(F.lit(1)) - 1)).alias("salt")
    firsts = groups.select(*by, "first_no", F.when(F.col("copies") > least, parts).otherwise(F.lit(1)).alias("of"), salts)
    pairs = cut(salted.drop("parts").join(firsts, [*by, "salt"]).select("first_no", F.col("key").alias("copy_no"), "salt", "of"))

    texts = df.select(F.col(key).cast("bigint").alias("copy_no"), F.col(text).alias("text"))
    sent = pairs.join(texts, "copy_no")
    heads = sent.filter("copy_no = first_no").groupBy("first_no", "of").agg(F.first("text").alias("text"))
    heads = heads.select("first_no", F.col("first_no").alias("copy_no"), F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("salt"), F.lit(0).alias("kind"), "text")
    members = sent.filter("copy_no <> first_no").select("first_no", "copy_no", "salt", F.lit(1).alias("kind"), "text")
    together = heads.unionByName(members).repartition(parallelism(df.sparkSession), "first_no", "salt").sortWithinPartitions("first_no", "salt", "kind")
    checked = cut(together.mapInArrow(lambda batches: _compared(batches, is_json), "first_no bigint, copy_no bigint, ok boolean, digest string"))
    lost = checked.filter("not ok")
    again = lost.groupBy("digest").agg(F.min("copy_no").alias("first_no"))
    rest = lost.select("digest", "copy_no").join(again, "digest").filter("copy_no <> first_no")
    return checked.filter("ok").select("first_no", "copy_no").unionByName(rest.select("first_no", "copy_no"))


def groups_of_keys(df: DataFrame, key: str, text: str, keys: DataFrame) -> DataFrame:
    """(first_no, copy_no) of the texts that ``keys(key, k1, k2, size)`` holds."""
    return _groups(df, key, text, keys, False)


def text_copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """(first_no, copy_no) of texts equal but for case, blanks, punctuation and symbols.

    Null texts and texts that are blank when normalised are no copies.  Texts
    without any letter or digit are copies of one another.  Other columns are
    ignored; an empty table gives no rows.
    """
    need_columns(df, key, text)
    return _groups(df, key, text, text_keys(df, key, text), False)


def record_copies(df: DataFrame, key: str, value: str, *, min_characters: int = 20, max_depth: int | None = MAX_DEPTH) -> DataFrame:
    """(first_no, copy_no) of JSON lines with the same fields in any order.

    Repeats of one key count once.  Null, broken and non-object lines (NaN and
    infinities are no JSON), lines without a string ``text`` and short texts are
    left out, as are objects nested deeper than ``max_depth``; with None, as in
    the queries, any depth is looked at.
    """
    need_columns(df, key, value)
    once = df.select(key, value).filter(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value))
    once = cut(once)
    return _groups(once, key, value, json_keys(once, key, value, min_characters, max_depth), True)


def _first_of_groups(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """(key, copies): rows that are no copy of an earlier one, with the size of their group."""
    counts = found.groupBy(F.col("first_no").alias(key)).agg((F.count("*") + 1).alias("copies"))
    kept = rows.join(found.select(F.col("copy_no").alias(key)), key, "left_anti")
    return kept.join(counts, key, "left").select(key, F.coalesce("copies", F.lit(1)).alias("copies"))


def collapsed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, copies): the first record of every group with its number of records.

    Rows of null text are left out; blank texts are kept with one copy each.
    """
    found = cut(text_copies(df, key, text))
    return _first_of_groups(df.filter(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias(key)), key, found)


def collapsed_records(df: DataFrame, key: str, value: str, *, min_characters: int = 20, max_depth: int | None = MAX_DEPTH) -> DataFrame:
    """(key, copies): the first line of every group of JSON records with its number of lines.

    Groups are those of ``record_copies``: repeats of one key count once.  Lines
    that take no part in them are kept with one copy each; null keys and lines
    are left out.
    """
    found = cut(record_copies(df, key, value, min_characters=min_characters, max_depth=max_depth))
    rows = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).cast("bigint").alias(key)).distinct()
    return _first_of_groups(rows, key, found)
