import functools
import random

import pytest

from corpusloom.llm import markup, quality
from corpusloom.llm.kernel import Chunk

COMMON = ["the", "of", "and", "was", "in", "it", "to", "had", "by", "where", "и", "в", "que"]
PROSE = "The tower of the old town was built in the spring, and it had to be mended by the end of the war. "
SAMPLES = [PROSE * 3, PROSE.upper(), "alpha; beta; gamma; " * 20, "a b\n" * 40, "", "\n\n", " ", "x" * 700, "ab­cd the\nof", "word-", "-word\n", PROSE + "\n" + "x;y;z\n" * 50, "и в " * 60, "ﬁne 🙂 the 𝄞 of"]


def test_chunks_merge_to_the_whole():
    common = quality.common_hashes(COMMON)
    for text in SAMPLES:
        sums, prose, _ = quality.measure([text], common)
        for size in (128, 256):
            parts = [text[i : i + size] for i in range(0, len(text), size)] or [""]
            places = [i * size for i in range(len(parts))]
            left = functools.reduce(lambda a, b: quality.merge(a, b, common), quality.measure(parts, common, places)[2])
            tree = quality.measure(parts, common, places)[2]
            while len(tree) > 1:
                tree = [quality.merge(*tree[i : i + 2], common) if i + 1 < len(tree) else tree[i] for i in range(0, len(tree), 2)]
            for state in (left, tree[0]):
                got, share = quality.finish(state, common)
                assert got.tolist() == sums[0].tolist() and share == prose[0], text[:40]


def test_counts():
    common = quality.common_hashes(COMMON)
    sums, _, _ = quality.measure(["The cat, of 12!\nno end\n\nthe"], common)
    got = dict(zip(quality.SUMS, sums[0].tolist()))
    assert got == {"chars": 27, "visible": 20, "words": 7, "word_chars": 18, "common": 3, "symbols": 2, "digits": 2, "lines": 3, "ended_lines": 1}


def test_statistics(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(SAMPLES)] + [(50, None, None, None), (0, SAMPLES[0], "x", 1)]
    df = spark.createDataFrame(rows, "pos int, text string, words string, key int").repartition(3)
    small = {(r.pos, tuple(r)[1:]) for r in quality.statistics(df, "pos", "text", COMMON, chunk=128).collect()}
    whole = {(r.pos, tuple(r)[1:]) for r in quality.statistics(df, "pos", "text", COMMON).collect()}
    assert small == whole and len(whole) == len(SAMPLES) + 1
    out = {k: v for k, v in whole}
    assert out[0][-1] and out[1][-1] and out[12][-1] and not out[2][-1] and not out[3][-1] and out[50] == (None,) * 9
    assert quality.statistics(df, "pos", "text", COMMON).count() == len(rows)
    assert quality.statistics(df.limit(0), "pos", "text", []).count() == 0
    assert 2 in {r.pos for r in quality.not_prose(quality.statistics(df, "pos", "text", COMMON), "pos").collect()}
    with pytest.raises(ValueError):
        quality.statistics(df, "pos", "text", COMMON, chunk=100)
    with pytest.raises(ValueError, match="missing columns"):
        quality.statistics(df, "pos", "body", COMMON)


def test_mostly_no_sentences(spark):
    """A list stays one beside an intro and a stray common word; prose stays prose beside a short list."""
    items = [f"Gluonon{i} porto" for i in range(60)]
    listed = PROSE + "\n" + " · ".join([*items[:20], "where", *items[20:24]])
    rows = [(0, listed), (1, PROSE * 8 + "\n" + " · ".join(items[:24]))]
    df = spark.createDataFrame(rows, "pos int, text string")
    stats = quality.statistics(df, "pos", "text", COMMON)
    share = {r.pos: r.prose_share for r in stats.collect()}
    assert 0.33 <= share[0] < 0.5 < share[1]
    assert [r.pos for r in quality.not_prose(stats, "pos").collect()] == [0]


CASES = [
    ("A <b>bold</b> word", ["html"]), ("x<!-- c -->", ["html"]), ("a &nbsp; b", ["html"]), ("a <unk> b 3 < 4 and 7 > 2", []), ("The R&D room; AT&T", []),
    ("## Heading\n\ntext", ["markdown"]), ("Title\n=====\n\ntext", ["markdown"]), ("see [here](#there) now", ["markdown"]), ("| a | b |\n|---|:--|\n| 1 | 2 |", ["markdown"]),
    ("```\ncode\n```", ["markdown"]), ("~~gone~~ and **bold**", ["markdown"]), ("- [x] done", ["markdown"]), ("He wrote [sic] beside 5 * 3 * 2 = 30.", []),
    ("= Title =\nbody", ["wiki"]), ("= = Section = =\nbody", ["wiki"]), ("[[File:a.jpg|thumb|b]]", ["wiki"]), ("{{main|x}}", ["wiki"]), ("{| class='w'\n|-\n| 1\n|}", ["wiki"]),
    ("a '''bold''' word", ["wiki"]), ("The mark '' was used for seconds, and ' for minutes.", []), ("well @-@ known 1 @,@ 200", []),
    ("\\section{A}\ntext", ["latex"]), ("$x_{5} = \\frac{1}{2}$", ["latex"]), ("It cost $40 then, and $75 after.", []), ("C:\\records\\old and old_mill_road", []), ("end \\\\\nnext", ["latex"]),
    ("<p>a</p>\n\n\\emph{b}", ["html", "latex"]), ("1817. Hobrab came\nand went", []), ("About ~20 of the {many} copies, section § 12 (*).", []), ("", []), (None, []),
]


@pytest.mark.parametrize("text, expected", CASES)
def test_markups(text, expected):
    assert markup.markups(text) == expected


def test_ambiguous_lines_follow_their_neighbours():
    assert markup.markups("- one\n- two\n- three") == []
    blocks, labels = markup.labelled("## Head\n- one\n- two\n\nPlain words here.")
    assert labels["markdown"][:3] == [True, True, True] and not labels["markdown"][3]


def brute_cut(blocks, yes, no):
    """Least cost over all labellings."""
    import itertools

    best = None
    for labels in itertools.product([False, True], repeat=len(blocks)):
        graph_cost = sum(y if not v else n for v, y, n in zip(labels, yes, no))
        last = {}
        for i, b in enumerate(blocks):
            if i:
                near = b.start == blocks[i - 1].start + len(blocks[i - 1].text) + 1
                graph_cost += (markup.SMOOTH_NEXT * near + 1) * (labels[i] != labels[i - 1])
            keys = [(("section", b.section), markup.SMOOTH_SECTION), *((("element", e), markup.SMOOTH_ELEMENT) for e in b.element[-1:])]
            for key, weight in keys:
                if key in last and last[key] != i - 1:
                    graph_cost += weight * (labels[i] != labels[last[key]])
                last[key] = i
        best = graph_cost if best is None else min(best, graph_cost)
    return best


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(40):
        blocks = [markup.Block("x" * 3, 4 * i + rng.randrange(2) * 50 * i, section=rng.randrange(2), element=(rng.randrange(2),) * rng.randrange(2)) for i in range(8)]
        yes, no = [rng.randrange(8) for _ in blocks], [rng.randrange(8) for _ in blocks]
        labels = markup.label(blocks, yes, no)
        cost = sum(y if not v else n for v, y, n in zip(labels, yes, no))
        last = {}
        for i, b in enumerate(blocks):
            if i:
                near = b.start == blocks[i - 1].start + len(blocks[i - 1].text) + 1
                cost += (markup.SMOOTH_NEXT * near + 1) * (labels[i] != labels[i - 1])
            for key, weight in [(("section", b.section), markup.SMOOTH_SECTION), *((("element", e), markup.SMOOTH_ELEMENT) for e in b.element[-1:])]:
                if key in last and last[key] != i - 1:
                    cost += weight * (labels[i] != labels[last[key]])
                last[key] = i
        assert cost == brute_cut(blocks, yes, no)


def test_clean_text():
    text = "## Head\n\nSome **bold** [words](#x).\n\n- one\n- two\n\n```\ncode *stays*\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n$x_{1} = 2$ here"
    assert markup.to_text(text) == "## Head\n\nSome bold words.\n\n- one\n- two\n\n```\ncode *stays*\n```\n\na | b\n1 | 2\n\n$x_{1} = 2$ here"
    assert markup.to_text("<h3>T</h3>\n<p>a &amp; b</p>\n<script>bad()</script>") == "### T\na & b"
    assert markup.to_text("= = Sec = =\nbody [[a|b]] {{cite|x}}\n[[Category:Z]]") == "## Sec\nbody b"
    assert markup.to_text("\\section{S}\n\\emph{a} b.~\\cite{k} \\\\") == "# S\na b."
    assert markup.to_text("plain  text * as is") == "plain  text * as is" and markup.to_text(None) is None and markup.to_text("") == ""


LONG = [
    ("a b.\n<pre><code>x = [\n    1,  2 * 3 * 4,\n]</code></pre>\nc d.", "a b.\n```\nx = [\n    1,  2 * 3 * 4,\n]\n```\nc d.", ["html"]),
    ("<pre>\n  if a &lt; b:\n\n    - [x](y) **z**\n</pre>", "```\n  if a < b:\n\n    - [x](y) **z**\n```", ["html"]),
    ("a\n\\begin{verbatim}\n  \\emph{x} & <b>y</b>\n\\end{verbatim}\nb", "a\n```\n  \\emph{x} & <b>y</b>\n```\nb", ["latex"]),
    ("a<!-- one\n\n**two** [[x]]\n--> b", "a b", ["html"]),
    ("A is.<script>\nvar x = 1;\nvar y;\n</script> B was.", "A is. B was.", ["html"]),
    ("a\n$$\nx + *y* * z\n$$\nb", "a\n$$\nx + *y* * z\n$$\nb", ["latex"]),
    ("a\n\\[\n x  = 1\n\\]\nb", "a\n\\[\n x  = 1\n\\]\nb", ["latex"]),
    ("\\begin{align}\na &= b \\\\\n  c &= d\n\\end{align}", "$$\na &= b \\\\\n  c &= d\n$$", ["latex"]),
    ("\\begin{tabular}{ll}\na & b \\\\ \\hline\nc & d \\\\\n\\end{tabular}", "a | b\nc | d", ["latex"]),
    ("Paid $$ then.\n\nNot $$ now.", "Paid $$ then.\n\nNot $$ now.", []),
]


@pytest.mark.parametrize("text, clean, kinds", LONG)
def test_constructs_over_several_lines(text, clean, kinds):
    assert markup.to_text(text) == clean
    assert markup.markups(text) == kinds
    assert not kinds or any(b.text.count("\n") for b in markup.blocks_of(text))


def test_unclosed_constructs_take_linear_time():
    text = "<!-- <pre> $$ \\begin{a} \\[ {|\n" * 20_000
    assert len(markup.blocks_of(text)) <= 20_000


def test_markup_rows(spark):
    rows = [(1, "<b>x</b> and [[y]]", "z"), (1, "<b>x</b> and [[y]]", "z"), (2, None, "z"), (3, "", "z"), (4, "plain " * 50_000, "z"), (5, "# h\n" * 3_000, "z")]
    df = spark.createDataFrame(rows, "pos bigint, text string, markup string")
    got = sorted((r.pos, r.markup) for r in markup.found(df, "pos", "text").collect())
    assert got == [(1, "html")] * 2 + [(1, "wiki")] * 2 + [(5, "markdown")]
    assert markup.cleaned(df, "pos", "text").count() == 6
    assert markup.found(df.limit(0), "pos", "text").count() == 0


def test_kernel_folding():
    one, two, n = Chunk(["Straße, ÉTÉ!", "strasse été", "ＳＴＲＡẞＥ e\u0301te\u0301", ""]).fold_keys()
    assert one[0] == one[2] and two[0] == two[2] and one[0] != one[1] and n.tolist() == [9, 10, 9, 0]
