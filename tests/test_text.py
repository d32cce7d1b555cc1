import unicodedata

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.functions.chars import normalize_text
from corpusloom.functions.text import SPECIAL_TOKENS, basic_tokens, document_id, normalize_document

# Stated inputs and their tokens.
CASES = [
    ("UNwantéd,running", ["unwanted", ",", "running"]),
    ("Hello... world! Isn't this (fun)?", ["hello", ".", ".", ".", "world", "!", "isn", "'", "t", "this", "(", "fun", ")", "?"]),
    ("  hello\tworld\u0000 ​test\n", ["hello", "world", "test"]),
    ("abc2026def", ["abc", "2", "0", "2", "6", "def"]),
    ("-3.14%", ["-", "3", ".", "1", "4", "%"]),
    ("abc１２３def", ["abc", "1", "2", "3", "def"]),
    ("hello中文world", ["hello", "[UNK]", "world"]),
    ("Ελληνικά Русский العربية", ["[UNK]"] * 3),
    ("Café Straße", ["cafe", "straße"]),
    ("a\x0bb c d", ["ab", "c", "d"]),
    ("", []),
]


def slow_tokens(text: str) -> list[str]:
    """The tokenizer's rules stated character by character."""
    kept = "".join(" " if c in "\t\n\r" or unicodedata.category(c) == "Zs" else c for c in text if c in "\t\n\r" or not (c in "\x00�" or unicodedata.category(c)[0] == "C"))
    out = []
    for chunk in kept.split():
        bare = "".join(c for c in unicodedata.normalize("NFD", chunk.lower()) if unicodedata.category(c) != "Mn")
        run = ""
        for c in bare + " ":
            single = c != " " and (c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" or unicodedata.category(c)[0] == "P" or c.isdecimal())
            if c == " " or single:
                at = 0
                for m in regex.finditer(r"(?V1)(?:[\p{L}--\p{Script=Latin}]\p{M}*)+", run):
                    out += [run[at : m.start()]] * (m.start() > at) + ["[UNK]"]
                    at = m.end()
                out += [run[at:]] * (len(run) > at)
                out += [str(unicodedata.decimal(c)) if c.isdecimal() else c] * single
                run = ""
            else:
                run += c
    return out


def test_basic_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", basic_tokens("t").alias("x")).collect()}
    for i, (text, expected) in enumerate(CASES):
        assert got[i] == expected == slow_tokens(text), text


def test_never_split_and_case(spark):
    df = spark.createDataFrame([("[CLS] Hello [SEP] [MASK].",), ("Café's Here",), (None,)], "t string")
    got = [r.x for r in df.select(basic_tokens("t", never_split=SPECIAL_TOKENS).alias("x")).collect()]
    assert got[0] == ["[CLS]", "hello", "[SEP]", "[", "mask", "]", "."] and got[2] is None
    kept = [r.x for r in df.select(basic_tokens("t", do_lower_case=False).alias("x")).collect()]
    assert kept[1] == ["Café", "'", "s", "Here"]
    own = [r.x for r in df.select(basic_tokens("t", never_split={"Café's"}).alias("x")).collect()]
    assert own[1] == ["Café's", "here"]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZé ß.１9中дй́\t​\x85-$½"), max_size=12), min_size=30, max_size=30))
def test_basic_tokens_against_rules(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", basic_tokens("t").alias("x")).collect():
        assert r.x == slow_tokens(r.t), repr(r.t)


def test_normalize_document(spark):
    rows = [("  Hello,\tworld!\nThis is a test.", "Hello, world! This is a test."), ("ＡＢＣ　１２３", "ABC 123"), ("hello\x00 world​!", "hello world!"), ("Café -- Don't LOWERCASE me.",) * 2, ("", None), (" \t\n\r", None), ("\x00​", None), ("a\x0b\x85b ​ c", "a b c"), ("ﬁ ½", "fi 1⁄2"), ("͸", "͸"), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", normalize_document("t").alias("x")).collect()}
    assert [got[i] for i in range(len(rows))] == [e for _, e in rows]
    with pytest.raises(TypeError):
        normalize_text(3)


def test_document_id(spark):
    row = spark.createDataFrame([("Café",)], "t string").select(document_id("t").alias("x")).first()
    import hashlib

    assert row.x == hashlib.sha256("Café".encode()).hexdigest()
