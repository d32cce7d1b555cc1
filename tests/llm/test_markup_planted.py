"""Planted documents: one structure written in every markup must come back in plain notation, nothing lost."""

import random
import re

import pytest

from corpusloom.llm import markup

WORDS = "tower harbour valley council bridge winter garden market river stone music letter".split()


def structure(rng):
    """Headings, paragraphs, nested lists, tables, code and formulas with invented words."""
    sentence = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 12))).capitalize() + "."
    parts = []
    for _ in range(rng.randint(2, 9)):
        kind = rng.choice(["heading", "prose", "short", "list", "table", "code", "formula", "junk"])
        if kind == "heading":
            parts.append((kind, (rng.randint(2, 3), rng.choice(WORDS).capitalize())))
        elif kind in ("prose", "short"):
            parts.append((kind, [sentence() for _ in range(rng.randint(1, 4) if kind == "prose" else 1)]))
        elif kind == "list":
            parts.append((kind, [(rng.choice(WORDS), [rng.choice(WORDS) for _ in range(rng.randint(0, 2))]) for _ in range(rng.randint(1, 4))]))
        elif kind == "table":
            parts.append((kind, [[rng.choice(WORDS) for _ in range(2)] for _ in range(rng.randint(2, 4))]))
        elif kind == "code":
            parts.append((kind, "\n".join("    " * k + f"{rng.choice(WORDS)}({k}, x_*y*)" for k in range(rng.randint(1, 3)))))
        elif kind == "formula":
            parts.append((kind, f"x_{rng.randint(1, 9)} = y^2"))
        else:
            parts.append((kind, rng.choice(WORDS)))
    return [("heading", (2, "Start")), *parts]


def plain(parts, own):
    out = []
    for kind, x in parts:
        if kind == "heading":
            out.append(f"{'#' * x[0]} {x[1]}")
        elif kind in ("prose", "short"):
            out.append(" ".join(x))
        elif kind == "list":
            out.append("\n".join("\n".join([f"- {a}", *(f"  - {b}" for b in inner)]) for a, inner in x))
        elif kind == "table":
            out.append("\n".join(" | ".join(row) for row in x))
        elif kind == "code":
            out.append(f"```\n{x}\n```")
        elif kind == "formula" and own == "latex":
            out.append(f"$$\n{x}\n$$")
        elif kind == "formula":
            out.append(f"${x}$")
    return "\n\n".join(out)


def written(parts, own, rng):
    out = []
    for kind, x in parts:
        if kind == "heading":
            n, title = x
            out.append({"html": f"<h{n} class='a'>{title}</h{n}>", "markdown": f"{'#' * n} {title}", "wiki": f"{'=' * n} {title} {'=' * n}", "latex": f"\\{'sub' * (n - 1)}section{{{title}}}"}[own])
        elif kind in ("prose", "short"):
            text = " ".join(x)
            if rng.random() < 0.5:
                first, rest = text.split(" ", 1)
                text = {"html": f"<b>{first}</b> ", "markdown": f"**{first}** ", "wiki": f"[[Page|{first}]] ", "latex": f"\\emph{{{first}}} "}[own] + rest
            out.append(f"<p>{text}</p>" if own == "html" else text)
        elif kind == "list":
            if own == "html":
                items = "".join(f"<li>{a}" + (f"\n<ul>{''.join(f'<li>{b}</li>' for b in inner)}</ul>\n" if inner else "") + "</li>" for a, inner in x)
                out.append(f"<ul>{items}</ul>")
            elif own == "latex":
                item = lambda a, inner: f"\\item {a}" + ("\n\\begin{itemize}\n" + "\n".join(f"\\item {b}" for b in inner) + "\n\\end{itemize}" if inner else "")
                out.append("\\begin{itemize}\n" + "\n".join(item(a, inner) for a, inner in x) + "\n\\end{itemize}")
            else:
                mark = ("*", "**") if own == "wiki" else ("-", "  -")
                out.append("\n".join("\n".join([f"{mark[0]} {a}", *(f"{mark[1]} {b}" for b in inner)]) for a, inner in x))
        elif kind == "table":
            if own == "html":
                out.append("<table>\n" + "\n".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in x) + "\n</table>")
            elif own == "markdown":
                rows = ["| " + " | ".join(row) + " |" for row in x]
                out.append("\n".join([rows[0], "|---|---|", *rows[1:]]))
            elif own == "wiki":
                out.append("{| class='w'\n" + "\n|-\n".join("| " + " || ".join(row) for row in x) + "\n|}")
            else:
                out.append("\\begin{tabular}{ll}\n" + "\n".join(" & ".join(row) + " \\\\" for row in x) + "\n\\end{tabular}")
        elif kind == "code":
            out.append({"html": f"<pre><code>{x}</code></pre>", "markdown": f"```py\n{x}\n```", "wiki": f"<pre>{x}</pre>", "latex": f"\\begin{{verbatim}}\n{x}\n\\end{{verbatim}}"}[own])
        elif kind == "formula":
            out.append(f"\\begin{{equation}}\n{x}\n\\end{{equation}}" if own == "latex" else f"${x}$")
        else:
            out.append({"html": f"<nav><a href='#'>{x}</a>\n<a href='/'>{x}</a></nav>", "markdown": f"<!-- {x} -->", "wiki": f"{{{{Infobox {x}\n| name = {x}\n| area = {{{{n|3}}}}\n}}}}\n[[Category:{x}]]", "latex": f"\\label{{{x}}}"}[own])
    return "\n\n".join(out)


@pytest.mark.parametrize("own", markup.MARKUPS)
def test_round_trip(own):
    rng = random.Random(7)
    for _ in range(150):
        parts = structure(rng)
        text = written(parts, own, rng)
        got = re.sub(r"\n{2,}", "\n\n", markup.to_text(text)).strip()
        assert got == plain([p for p in parts if p[0] != "junk"], own), text
        assert own in markup.markups(text)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("<nav>Home</nav>\n<p>A short note.</p>\n<footer>c</footer>", "A short note."),
        ("[[Category:A]]\nHello world today.", "Hello world today."),
        ("[[Category:A]] Hello [[b|world]].", "Hello world."),
        ("{{Infobox place\n| name = X\n| area = {{n|2}}\n}}\nThe [[place]] lies here.", "The place lies here."),
        ("<p>see <img src='a.png' alt='a tower'> there</p>", "see a tower there"),
        ("[[File:a.jpg|thumb|200px|The old tower]] stands.", "The old tower stands."),
        ("## Code\n\n    if a:\n        b  = 1\n\nEnd *here*.", "## Code\n\n    if a:\n        b  = 1\n\nEnd here."),
        ("\\section{A} It was\\footnote{in winter} cold.", "# A\nIt was (in winter) cold."),
        ("<script>x</script>", ""),
        ("<nav>Home</nav> It was late.", "It was late."),
    ],
)
def test_content_stays(text, expected):
    assert markup.to_text(text) == expected


def test_links_follow_their_neighbours():
    """The second cut: a line of a link goes with navigation around it and stays beside prose."""
    link = "<a href='x'>Index</a>"
    nav = "<nav><a href='y'>Up</a></nav>"
    assert markup.to_text(f"{nav}\n{link}\n{nav}") == ""
    assert markup.to_text(f"The tower was old.\n{link}\nIt fell in <b>1800</b>.") == "The tower was old.\nIndex\nIt fell in 1800."


def test_labels_decide_how_a_line_is_read():
    """The first cut: the same line is a table row beside a rule of a table and plain text elsewhere."""
    row = "| old * tower | new |"
    assert markup.to_text(f"{row}\n|---|---|\n{row}") == "old * tower | new\nold * tower | new"
    assert markup.to_text(f"<b>A</b>\n\nPlain words.\n\n{row}\n\nMore words.") == f"A\n\nPlain words.\n\n{row}\n\nMore words."


def test_fitted_costs(spark):
    """Constructs that stand beside certain ones get dear, those of plain texts get cheap."""
    rows = [(i, "## Head\n- one\n- two\n* * *\n") for i in range(40)] + [(100 + i, "1. one\n2. two\n3. three") for i in range(40)] + [(500, None), (501, "")]
    df = spark.createDataFrame(rows, "pos bigint, text string")
    costs = markup.fit_costs(df, "pos", "text")
    given = [w for _, w in markup.MAYBE["markdown"]]
    assert costs["markdown"][0] == markup.PLAIN - 1 and costs["markdown"][1] < 4
    assert costs["wiki"] != [] and costs["markdown"][2] == given[2]
    assert markup.markups("1. one\n2. two\n3. three", costs) == []
    assert markup.fit_costs(df.limit(0), "pos", "text")["markdown"] == given
