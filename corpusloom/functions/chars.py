"""Character rules of document normalisation, derived from ``unicodedata``."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata


def is_dropped_by_normalization(c: str) -> bool:
    """NUL, the replacement character and control or format characters that are no blanks."""
    return not c.isspace() and (c in "\x00�" or unicodedata.category(c) in ("Cc", "Cf"))


def char_class(test) -> str:
    """Body of a regex character class for all code points that satisfy ``test``."""
    spans: list[list[int]] = []
    for i in range(sys.maxunicode + 1):
        if 0xD800 <= i < 0xE000 or not test(chr(i)):
            continue
        if spans and spans[-1][1] == i - 1:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


@functools.lru_cache(maxsize=None)
def _dropped() -> re.Pattern[str]:
    return re.compile(f"[{char_class(is_dropped_by_normalization)}]")


def normalize_text(text: str | None) -> str | None:
    """Normalise one document; None for null or when nothing is left.

    NFKC once, every blank becomes a space, dropped characters vanish, then
    runs of spaces collapse and the ends are trimmed.
    """
    if text is None:
        return None
    if not isinstance(text, str):
        raise TypeError(f"text must be a string, not {type(text).__name__}")
    text = " ".join(unicodedata.normalize("NFKC", text).split())
    if not text.isprintable():
        text = " ".join(_dropped().sub("", text).split())
    return text or None


@functools.lru_cache(maxsize=None)
def accent_table() -> tuple[str, str]:
    """(characters, replacements) that strip accents; characters beyond the replacements are deleted.

    A character maps to what its canonical decomposition leaves without
    nonspacing marks, where that is one other character.
    """
    single, bare, gone = [], [], []
    for i in range(sys.maxunicode + 1):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        left = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if not left:
            gone.append(c)
        elif left != c and len(left) == 1:
            single.append(c)
            bare.append(left)
    return "".join(single) + "".join(gone), "".join(bare)


@functools.lru_cache(maxsize=None)
def digit_table() -> tuple[str, str]:
    """(decimal digits of other scripts, their ASCII digits)."""
    found = [chr(i) for i in range(128, sys.maxunicode + 1) if chr(i).isdecimal()]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)
