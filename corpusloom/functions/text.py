"""Scalar text functions as Column expressions: normalisation, ids and basic tokenization.

Document normalisation and tokenizer cleaning treat blanks and controls by
different rules and share no helper on purpose.
"""

from __future__ import annotations

import re
from collections.abc import Collection

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .chars import accent_table, digit_table, normalize_text

# Special tokens in the order of their ids.
SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
UNKNOWN = "[UNK]"

#: Every character for which Python's ``str.isspace`` holds.
BLANKS = "\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PUNCTUATION = "!-/:-@\\[-`{-~\\p{P}"

_RUN, _OPEN, _CLOSE, _NAMES = 0xE000, 0xE001, 0xE002, 0xE100


@F.pandas_udf(StringType())
def _normalized(texts: pd.Series) -> pd.Series:
    return texts.map(normalize_text, na_action="ignore")


# A filter on the result would otherwise be pushed below and evaluate the function twice.
_normalized = _normalized.asNondeterministic()


def normalize_document(text: Column | str) -> Column:
    """Canonical text of a document: NFKC, single spaces, no controls; null when nothing is left.

    NFKC has no built-in counterpart, so this is one Arrow-batched function.
    """
    return _normalized(F.col(text) if isinstance(text, str) else text)


def document_id(text: Column | str) -> Column:
    """SHA-256 of the UTF-8 text as lower-case hexadecimal digits."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def strip_blanks(text: Column) -> Column:
    """Remove Unicode blanks at both ends, as ``str.strip`` does."""
    return F.regexp_replace(text, f"^[{BLANKS}]+|[{BLANKS}]+\\z", "")


def is_blank(text: Column) -> Column:
    return text.rlike(f"\\A[{BLANKS}]*\\z")


def clean_for_tokens(text: Column) -> Column:
    """Blanks become spaces, then NUL, U+FFFD and all other category C characters go."""
    spaced = F.regexp_replace(text, "[\\t\\n\\r\\p{Zs}]", " ")
    return F.regexp_replace(spaced, "[\\x00\\uFFFD\\p{C}]", "")


def strip_accents(text: Column) -> Column:
    """Drop nonspacing marks after canonical decomposition of single characters."""
    source, target = accent_table()
    return F.translate(text, source, target)


def ascii_digits(text: Column) -> Column:
    source, target = digit_table()
    return F.translate(text, source, target)


def basic_tokens(text: Column | str, *, do_lower_case: bool = True, never_split: Collection[str] = ()) -> Column:
    """Basic tokens of a text as ``array<string>``; null for null.

    One projection of built-ins: clean, protect ``never_split`` names that stand
    alone between blanks, lower and strip accents, map digits, replace runs of
    non-Latin letters, then extract punctuation, digits and runs.  Protected
    names and unknown runs travel as private-use characters, of which cleaning
    has left none.
    """
    column = F.col(text) if isinstance(text, str) else text
    names = sorted(never_split)
    if len(names) > 0x1800:
        raise ValueError("too many names that are never split")
    out = clean_for_tokens(column)
    edge = "[ \\u2028\\u2029]"
    for i, name in enumerate(names):
        out = F.regexp_replace(out, f"(?<=\\A|{edge}){_quoted(name)}(?=\\z|{edge})", f"{chr(_OPEN)}{chr(_NAMES + i)}{chr(_CLOSE)}")
    if do_lower_case:
        out = strip_accents(F.lower(out))
    out = ascii_digits(out)
    out = F.regexp_replace(out, "(?:[\\p{L}&&[^\\p{IsLatin}]]\\p{M}*)+", chr(_RUN))
    pattern = f"[^ \\u2028\\u2029\\uE000-\\uE002\\uE100-\\uF8FF0-9{PUNCTUATION}]+|\\uE001[\\uE100-\\uF8FF]\\uE002|[\\uE000-\\uF8FF0-9{PUNCTUATION}]"
    found = F.regexp_extract_all(out, F.lit(pattern), F.lit(0))
    back = F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (f"{chr(_OPEN)}{chr(_NAMES + i)}{chr(_CLOSE)}", name)]) if names else None

    def restored(token: Column) -> Column:
        token = F.when(token == chr(_RUN), UNKNOWN).otherwise(token)
        return F.coalesce(back[token], token) if names else token

    return F.transform(found, restored)


def _quoted(name: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", name)
