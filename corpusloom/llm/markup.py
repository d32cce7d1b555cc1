r"""Problem 2: markup residue in texts, and clean text that keeps their structure.

Method: a text is cut into blocks (lines; code, scripts, comments, tables,
formulas and environments stay whole over all their lines), which are the nodes of a graph.  For each markup a classifier puts a
cost on either label of every block; adjacent blocks, blocks under the same
heading or inside the same element are joined by smoothness edges.  The minimum
cut between the two terminals is the labelling of least total cost.  Certain
constructs (a tag, a ``\section{``) outweigh any cut; ambiguous ones (a hyphen
list, a row of pipes, a rule of dashes) take the side of their neighbourhood.

The capacities of ambiguous constructs are fitted (``fit_costs``): how much more
often a construct stands in texts that hold a certain one of its markup than
elsewhere, counted on a bounded sample; the weights below are what is used
without a sample.

A second cut of the same graph separates content from boilerplate.  Blocks in
which nothing but category links, navigation, templates, comments or scripts is
left are boilerplate, blocks that say anything else are content, whatever stands
beside them; the cut settles lines of mere links.  ``to_text`` renders every
content block by its own labels, with headings, nested lists, code, tables and
formulas kept in one plain notation, and leaves unlabelled blocks as they are.
"""

from __future__ import annotations

import html
import html.entities
import math
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import need_columns

MARKUPS = ("html", "markdown", "wiki", "latex")
CERTAIN = 1000
#: What an ambiguous block pays for being labelled in a text without, and with, a certain construct.
PLAIN, MARKED = 11, 7
SMOOTH_NEXT, SMOOTH_SECTION, SMOOTH_ELEMENT = 8, 4, 9

# Element names of HTML.
ELEMENTS = (
    "a abbr acronym address applet area article aside audio b base bdi bdo big blockquote body br button canvas caption "
    "center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption "
    "figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label "
    "legend li link main map mark menu meta meter nav noframes noscript object ol optgroup option output p param picture "
    "pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg "
    "table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
)
_NAMES = "|".join(sorted(ELEMENTS.split(), key=len, reverse=True))

# LaTeX commands that stand without an argument.
BARE = "item noindent hline maketitle tableofcontents newpage clearpage par bigskip medskip smallskip centering alpha beta gamma delta epsilon lambda mu pi sigma omega sum prod int infty leq geq neq cdot times ldots dots quad qquad toprule midrule bottomrule appendix"

TAG = re.compile(rf"</?(?:{_NAMES})(?:\s+[^<>]*|\s*/)?>", re.I)
COMMENT = re.compile(r"<!--.*?-->|<!doctype[^<>]*>", re.S | re.I)
ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,31});", re.I)
_ENTITIES = {n.rstrip(";").lower() for n in html.entities.html5}

SURE = {
    "html": [TAG, COMMENT],
    "markdown": [
        re.compile(r"^ {0,3}#{1,6} +\S"),
        re.compile(r"^ {0,3}(?:```|~~~)[\w+-]*\s*$"),
        re.compile(r"(?<![\w*])\*\*\*?(?=[^\s*])[^*\n]+(?<=[^\s*])\*\*\*?(?![\w*])"),
        re.compile(r"(?<![\w_])__(?=[^\s_])[^_\n]+(?<=[^\s_])__(?![\w_])"),
        re.compile(r"(?<![\w~])~~(?=\w)[^~\n]+(?<=[\w.,;:!?])~~(?![\w~])"),
        re.compile(r"!\[[^\]\n]*\]\([^()\s]+(?: \"[^\"\n]*\")?\)"),
        re.compile(r"(?<!\[)\[[^\[\]\n]+\]\((?:[#/\w][^()\s]*)(?: \"[^\"\n]*\")?\)"),
        re.compile(r"\[\^[\w-]+\]"),
        re.compile(r"^\s*[-*+] \[[ xX]\] "),
        re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$"),
        re.compile(r"(?<![`\w])`(?=[^\s`])[^`\n]+(?<=[^\s`])`(?![`\w])"),
        re.compile(r"^> ?\S"),
    ],
    "wiki": [
        re.compile(r"^\s*=(?: =)* +(?=\S)[^=\n]*[^=\s] +=(?: =)*\s*$"),
        re.compile(r"(?:^|\s)= =(?: =)* [^=\n]*[^=\s] = =(?: =)*(?=\s|$)"),
        re.compile(r"^\s*(={2,6})(?!=)[^=\n]+(?<!=)\1\s*$"),
        re.compile(r"\[\[[^\[\]\n]+\]\]"),
        re.compile(r"\{\{\s*[\w#:][^{}\n]*(?:\}\}|$)"),
        re.compile(r"^\s*\{\|"),
        re.compile(r"^\s*\|\}\s*$"),
        re.compile(r"'''(?=[^\s'])[^\n]*?(?<=[^\s'])'''"),
        re.compile(r"(?<!')''(?=[^\s'])[^'\n]+(?<=[^\s'])''(?!')"),
        re.compile(r"<ref(?:\s[^<>]*)?/?>|<nowiki>", re.I),
        re.compile(r"^#redirect\b", re.I),
    ],
    "latex": [
        re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{"),
        re.compile(rf"\\(?:{'|'.join(BARE.split())})(?![A-Za-z])"),
        re.compile(r"\$\$[^$]+\$\$"),
        re.compile(r"\\\[.*\\\]|\\\(.*\\\)", re.S),
        re.compile(r"\$(?=[^\s$])[^$\n]*[\\^_=][^$\n]*(?<=[^\s$])\$"),
        re.compile(r"\\\\(?:\s*$|\s)"),
    ],
}

# Ambiguous constructs and the capacity with which they speak for a markup: most a
# little under PLAIN, so that alone they are plain and beside certain ones they are not.
MAYBE = {
    "html": [],
    "markdown": [
        (re.compile(r"^\s*[-*+] +\S"), 10),
        (re.compile(r"^\s*\d{1,3}[.)] +\S"), 8),
        (re.compile(r"^\s*\|.*\|\s*$"), 10),
        (re.compile(r"^\s*(?:-{3,}|\*{3,}|_{3,})\s*$"), 10),
        (re.compile(r"(?<![\w*])\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?![\w*])"), 13),
        (re.compile(r"(?<![\w_])_(?=[^\s_])[^_\n]+(?<=[^\s_])_(?![\w_])"), 13),
    ],
    "wiki": [
        (re.compile(r"^[*#:;]+ *\S"), 10),
        (re.compile(r"^\s*(?:\|-|\||!)"), 10),
        (re.compile(r"\}\}\s*$"), 10),
    ],
    "latex": [(re.compile(r"(?<!\\)~\\|\s&\s.*\\\\"), 10), (re.compile(r"^\s*%"), 4)],
}

#: One pass that every text with a construct passes; texts without any are done.
HINT = re.compile(r"[<&\\`]|\$.*\$|\[\[|\{\{|\{\||''|\*\S|__|~~|\]\(|\[\^|^ {0,3}#{1,6} |^\s*[-*+>] ?\S|= =|==|^\s*= |--\|?|^\s*\|", re.M)
UNDERLINE = re.compile(r"^(?:={3,}|-{3,})\s*$")


@dataclass
class Block:
    """A node: one line, or all lines of a construct that spans several (see ``_reach``)."""

    text: str
    start: int
    section: int = 0
    element: tuple[int, ...] = ()
    fenced: str = ""
    sure: dict[str, bool] = field(default_factory=dict)
    maybe: dict[str, int] = field(default_factory=dict)


# Constructs that may span lines: code and formulas are kept as they are, comments and scripts go.
OPEN = re.compile(r"<!--|<(pre|script|style|table|nav|footer|form)\b[^<>]*>|\\begin\{([A-Za-z]+\*?)\}|\$\$|\\\[|\{\{|(?:^|(?<=\n))[ \t]*\{\|", re.I)
CLOSE = {
    "<!--": re.compile("-->"),
    "$$": re.compile(r"\$\$"),
    "\\[": re.compile(r"\\\]"),
    "{|": re.compile(r"(?:^|(?<=\n))[ \t]*\|\}"),
    **{n: re.compile(rf"</{n}\s*>", re.I) for n in ("pre", "script", "style", "table", "nav", "footer", "form")},
}
ENVIRONMENT = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}")
PARAGRAPH = re.compile(r"\n[ \t]*\n")
BRACES = re.compile(r"\{\{|\}\}")
GONE = r"<!--.*?-->|<(?P<gone>script|style)\b[^<>]*>.*?</(?P=gone)\s*>"
CODE = (
    r"<pre\b[^<>]*>(?:\s*<code\b[^<>]*>)?(?P<pre>.*?)(?:</code>\s*)?</pre\s*>"
    r"|\\begin\{(?P<env>[vVB]?[vV]erbatim\*?|lstlisting|minted|alltt)\}(?:\[[^\]\n]*\])?(?P<verbatim>.*?)\\end\{(?P=env)\}"
)
FORMULA = (
    r"(?P<math>\$\$[^$]+\$\$|\\\[.*?\\\])"
    r"|\\begin\{(?P<display>(?:equation|align|alignat|gather|multline|eqnarray|displaymath|flalign)\*?)\}(?P<body>.*?)\\end\{(?P=display)\}"
)
WHOLE = re.compile(f"{GONE}|{CODE}|{FORMULA}", re.S | re.I)


def _environments(text: str) -> dict[int, int]:
    """Where each environment that begins at a place ends; ``document`` holds a text and is none."""
    begun: dict[str, list[int]] = {}
    ends = {}
    for m in ENVIRONMENT.finditer(text):
        if m[1] == "begin":
            begun.setdefault(m[2], []).append(m.start())
        elif begun.get(m[2]):
            ends[begun[m[2]].pop()] = m.end()
    return {a: b for a, b in ends.items() if not text.startswith("\\begin{document}", a)}


def _templates(text: str) -> dict[int, int]:
    """Where each pair of double braces that opens at a place closes."""
    begun: list[int] = []
    ends = {}
    for m in BRACES.finditer(text):
        if m[0] == "{{":
            begun.append(m.start())
        elif begun:
            ends[begun.pop()] = m.end()
    return ends


def _without_templates(text: str) -> str:
    """The text without what stands in double braces, nested ones included."""
    out, at = [], 0
    for a, b in sorted(_templates(text).items()):
        if a >= at:
            out.append(text[at:a])
            at = b
    return "".join([*out, text[at:]])


def _reach(text: str, start: int, end: int, ends: dict[int, int], missing: set[str]) -> int:
    """End of the last line of the constructs that begin in the line from start to end.

    A construct without an end is none; a formula lies within a paragraph.
    ``missing``: constructs known to have no end in the rest of the text.
    """
    at = start
    while m := OPEN.search(text, at, end):
        at = m.end()
        name = (m[1] or m[0]).strip().lower()
        if m[2] or name == "{{":
            closed = ends.get(m.start(), 0)
        elif name in missing:
            continue
        else:
            found = CLOSE[name].search(text, at)
            closed = found.end() if found else 0
            if not found:
                missing.add(name)
            elif name in ("$$", "\\[") and PARAGRAPH.search(text, at, found.start()):
                continue
        if closed:
            # tables and other environments may hold constructs, which end within them
            at = closed
            if closed > end:
                end = text.find("\n", closed)
                end = len(text) if end < 0 else end
    return end


def _outside(text: str) -> str:
    """The text with the constructs in it, but not what code, scripts and comments hold."""

    def hollow(m: re.Match) -> str:
        if m["math"] or m["display"]:
            return m[0]
        if m["env"]:
            return f"\\begin{{{m['env']}}}\\end{{{m['env']}}}"
        return "<pre></pre>" if m["pre"] is not None else f"<{m['gone']}></{m['gone']}>" if m["gone"] else "<!---->"

    return WHOLE.sub(hollow, text)


def blocks_of(text: str) -> list[Block]:
    """Blocks in order, with their section and the stack of open elements."""
    out: list[Block] = []
    section, depth, at, serial = 0, [], 0, 0
    fence = None
    lines = text.split("\n")
    ends, missing, reached = _environments(text) | _templates(text), set(), 0
    for i, line in enumerate(lines):
        start, at = at, at + len(line) + 1
        if start < reached:
            continue
        mark = re.match(r" {0,3}(```|~~~)", line)
        if fence:
            out[-1].text += "\n" + line
            if line.strip().startswith(fence):
                fence = None
            continue
        if mark and any(x.strip().startswith(mark[1]) for x in lines[i + 1 :]):
            fence = mark[1]
            out.append(Block(line, start, section, tuple(depth), "code"))
            continue
        if not line.strip():
            continue
        if SURE["markdown"][0].match(line) or any(p.match(line) for p in SURE["wiki"][:3]) or line.lstrip().startswith(("\\section", "\\subsection")):
            section += 1
        reached = _reach(text, start, start + len(line), ends, missing)
        block = Block(text[start:reached], start, section, tuple(depth))
        outside = _outside(block.text)
        for m in TAG.finditer(outside):
            name = re.match(r"</?(\w+)", m[0])[1].lower()
            if m[0].startswith("</"):
                if depth:
                    depth.pop()
            elif not m[0].endswith("/>") and name not in ("br", "hr", "img", "meta", "link", "input"):
                serial += 1
                depth.append(serial)
        for m in re.finditer(r"\\(begin|end)\{", outside):
            if m[1] == "begin":
                serial += 1
                depth.append(serial)
            elif depth:
                depth.pop()
        block.element = block.element or tuple(depth)
        out.append(block)
    return out


def classify(blocks: list[Block], costs: dict[str, list[int]] | None = None) -> None:
    """Evidence of every block for every markup; ``costs``: fitted capacities of the ambiguous constructs."""
    costs = costs or {kind: [w for _, w in MAYBE[kind]] for kind in MARKUPS}
    for i, b in enumerate(blocks):
        text = b.text.split("\n", 1)[0] if b.fenced else _outside(b.text)
        lines = text.split("\n")
        for kind in MARKUPS:
            b.sure[kind] = any(p.search(x) for x in [*lines, *([text] if len(lines) > 1 else [])] for p in SURE[kind])
            b.maybe[kind] = max(sum(w for (p, _), w in zip(MAYBE[kind], costs[kind]) if p.search(x)) for x in lines)
        if not b.sure["html"]:
            b.sure["html"] = any(m[0][1] == "#" or m[0][1:-1].lower() in _ENTITIES for m in ENTITY.finditer(b.text if b.fenced else text))
        if UNDERLINE.match(b.text) and i and not UNDERLINE.match(blocks[i - 1].text) and blocks[i - 1].start + len(blocks[i - 1].text) + 1 == b.start:
            b.sure["markdown"] = b.sure["markdown"] or (b.text[0] == "=" and len(blocks[i - 1].text) <= 120)
            b.maybe["markdown"] += 10


class Cut:
    """Minimum cut by augmenting along levels (blocking flows) on a small graph."""

    def __init__(self, n: int) -> None:
        self.n, self.to, self.room = n, [], []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, forward: int, backward: int) -> None:
        for u, v, c in ((a, b, forward), (b, a, backward)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.room.append(c)

    def _levels(self, source: int) -> list[int]:
        level = [-1] * self.n
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in self.out[u]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[u] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """Which nodes stay with the source after a maximum flow."""
        while (level := self._levels(source))[sink] >= 0:
            turn = [0] * self.n
            while True:
                path, u = [], source
                while u != sink:
                    while turn[u] < len(self.out[u]):
                        e = self.out[u][turn[u]]
                        if self.room[e] and level[self.to[e]] == level[u] + 1:
                            break
                        turn[u] += 1
                    if turn[u] < len(self.out[u]):
                        path.append(self.out[u][turn[u]])
                        u = self.to[path[-1]]
                    elif path:
                        level[u] = -1
                        u = self.to[path.pop() ^ 1]
                    else:
                        break
                if u != sink:
                    break
                flow = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= flow
                    self.room[e ^ 1] += flow
        return [x >= 0 for x in self._levels(source)]


def label(blocks: list[Block], yes: list[int], no: list[int]) -> list[bool]:
    """Labels of least cost: a block labelled false pays ``yes``, one labelled true pays ``no``."""
    n = len(blocks)
    graph = Cut(n + 2)
    for i in range(n):
        both = min(yes[i], no[i])
        graph.edge(n, i, yes[i] - both, 0)
        graph.edge(i, n + 1, no[i] - both, 0)
    last: dict[tuple, int] = {}
    for i, b in enumerate(blocks):
        if i:
            near = b.start == blocks[i - 1].start + len(blocks[i - 1].text) + 1
            graph.edge(i - 1, i, SMOOTH_NEXT * near + 1, SMOOTH_NEXT * near + 1)
        for key, weight in ((("section", b.section), SMOOTH_SECTION), *((("element", e), SMOOTH_ELEMENT) for e in b.element[-1:])):
            if key in last and last[key] != i - 1:
                graph.edge(last[key], i, weight, weight)
            last[key] = i
    return graph.source_side(n, n + 1)[:n]


def labelled(text: str, costs: dict[str, list[int]] | None = None) -> tuple[list[Block], dict[str, list[bool]]]:
    """Blocks of a text and, per markup, which of them hold it."""
    blocks = blocks_of(text)
    classify(blocks, costs)
    labels = {}
    for kind in MARKUPS:
        yes = [CERTAIN if b.sure[kind] else b.maybe[kind] for b in blocks]
        if any(yes):
            plain = MARKED if any(b.sure[kind] for b in blocks) else PLAIN
            no = [0 if b.sure[kind] else plain if b.maybe[kind] else CERTAIN for b in blocks]
            labels[kind] = label(blocks, yes, no)
    return blocks, labels


def _plain_blanks(text: str | None) -> str | None:
    """The text with odd blanks as spaces and invisible characters gone, lines kept."""
    if not text or text.isascii() and "\r" not in text:
        return text
    return re.sub(r"[^\S\n]", " ", re.sub("[\u00ad\u200b-\u200f\u2060\ufeff]", "", text))


def markups(text: str | None, costs: dict[str, list[int]] | None = None) -> list[str]:
    """Markups of which at least one block holds a construct, in a fixed order."""
    text = _plain_blanks(text)
    if not text or not HINT.search(text):
        return []
    _, labels = labelled(text, costs)
    return [k for k in MARKUPS if any(labels.get(k, ()))]


# Prefixes of category and file links, and options of file links.
_CATEGORY = re.compile(r"\[\[\s*(?:category|kategorie|catégorie|categoría|categoria|категория)\s*:[^\[\]]*\]\]", re.I)
_FILE = re.compile(r"\[\[\s*(?:file|image|datei|bild|fichier|archivo|файл)\s*:[^\[\]|]*((?:\|[^\[\]|]*)*)\]\]", re.I)
_OPTION = re.compile(r"\s*(?:thumb|thumbnail|frame|frameless|border|left|right|center|none|upright(?:=.*)?|\d*x?\d+px|(?:alt|link|class)=.*)\s*", re.I)
_PARTS = re.compile(r"<(?P<part>nav|footer|form)\b[^<>]*>.*?</(?P=part)\s*>", re.S | re.I)
_LINK = re.compile(r"<a\b[^<>]*>.*?</a>|\[\[[^\]]*\]\]|\[[^\]]*\]\([^)]*\)", re.I)


def _is_boilerplate(b: Block) -> int:
    """12 where nothing but boilerplate is in a block, 6 where hardly more than links is, else 0."""
    if b.fenced:
        return 0
    text = _outside(b.text)
    if "<pre></pre>" in text or re.search(r"\\begin\{(\w+\*?)\}\\end\{\1\}", text):
        return 0
    rest = _CATEGORY.sub(" ", _PARTS.sub(" ", COMMENT.sub(" ", re.sub(r"<(script|style)></\1>", " ", text, flags=re.I))))
    if b.sure.get("wiki"):
        rest = _without_templates(rest)
    plain = re.sub(r"\s+", " ", TAG.sub(" ", rest)).strip()
    if rest != text and not re.search(r"\w|\$\$|<img\b", rest if "<img" in rest else plain):
        return 12
    links = sum(len(m[0]) for m in _LINK.finditer(b.text))
    return 6 if plain and links > 0.7 * len(b.text) and len(plain) < 80 and not re.match(r"\s*[*#-]", b.text) else 0


def content(blocks: list[Block]) -> list[bool]:
    """The second cut: true for content, false for boilerplate; both are settled but for lines of links."""
    weight = [_is_boilerplate(b) for b in blocks]
    words = [len(re.findall(r"\w+", b.text)) for b in blocks]
    yes = [CERTAIN if not w else 0 if w >= 12 else 2 + min(10, n) for w, n in zip(weight, words)]
    return label(blocks, yes, [0 if not w else CERTAIN if w >= 12 else w for w in weight])


def _caption(m: re.Match) -> str:
    """The caption of a file link, if it has one."""
    own = [x.strip() for x in m[1].split("|")[1:] if not _OPTION.fullmatch(x)]
    return own[-1] if own else ""


# LaTeX commands whose argument is no text.
_NO_TEXT = "cite citep citet label ref eqref pageref includegraphics usepackage documentclass bibliography bibliographystyle vspace hspace input include setlength pagestyle thispagestyle"
_WIKI = [
    (_CATEGORY, ""),
    (_FILE, _caption),
    (re.compile(r"\[\[(?:[^\[\]|\n]*\|)*([^\[\]|\n]*)\]\]"), r"\1"),
    (re.compile(r"'{2,5}(?=\S)([^\n]*?\S)'{2,5}"), r"\1"),
]
_HTML = [
    (COMMENT, ""),
    (re.compile(r"<script\b.*?</script>|<style\b.*?</style>", re.S | re.I), ""),
    (_PARTS, " "),
    (re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>", re.S | re.I), ""),
    (re.compile(r"<img\b[^<>]*?\balt\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)')[^<>]*>", re.I), lambda m: m[1] or m[2] or ""),
]
_MARKDOWN = [
    (re.compile(r"!\[([^\]\n]*)\]\([^)\n]*\)"), r"\1"),
    (re.compile(r"(?<!\[)\[([^\[\]^\n]+)\]\([^)\n]*\)"), r"\1"),
    (re.compile(r"\[\^[\w-]+\]:?"), ""),
    (re.compile(r"(\*{1,3})(?=[^\s*])([^*\n]+?)(?<=[^\s*])\1(?!\w)"), r"\2"),
    (re.compile(r"(?<![\w_])(_{1,3})(?=[^\s_])([^_\n]+?)(?<=[^\s_])\1(?![\w_])"), r"\2"),
    (re.compile(r"~~(?=\w)([^~\n]+)~~"), r"\1"),
    (re.compile(r"(?<![`\w])`([^`\n]+)`(?![`\w])"), r"\1"),
]
_LATEX = [
    (re.compile(rf"~?\\(?:{'|'.join(_NO_TEXT.split())})\*?(?:\[[^\]\n]*\])?\{{[^{{}}]*\}}"), ""),
    (re.compile(r"\s*\\footnote\{([^{}]*)\}"), r" (\1)"),
    (re.compile(r"\\(?!begin|end)[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\noindent\s*|\\\\\s*$", re.M), ""),
]


def _inline(text: str, kinds: set[str] = frozenset(MARKUPS)) -> str:
    """One line without inline markup of its kinds; formulas stay as they are."""
    parts = re.split(r"(\$\$[^$]+\$\$|\$(?=[^\s$])[^$\n]*[\\^_=][^$\n]*\$|\\\[.*?\\\])", text)
    for i in range(0, len(parts), 2):
        for kind, rules in (("html", _HTML), ("wiki", _WIKI), ("markdown", _MARKDOWN), ("latex", _LATEX)):
            if kind in kinds or kind == "html" and "wiki" in kinds:
                for pattern, new in rules:
                    parts[i] = pattern.sub(new, parts[i])
        if "wiki" in kinds:
            parts[i] = _without_templates(parts[i])
        parts[i] = TAG.sub("", parts[i])
        if "html" in kinds:
            parts[i] = html.unescape(parts[i]).replace("\xa0", " ")
    return re.sub(r"[ \t]+", " ", "".join(parts)).strip()


def _fenced(body: str) -> str:
    """Code between fences that it does not hold itself, without the line ends next to them."""
    body = re.sub(r"^[ \t]*\n|\n[ \t]*$", "", body)
    fence = "```"
    while fence in body:
        fence += "`"
    return f"{fence}\n{body}\n{fence}"


INDENT = "\1"


class Renderer:
    """Blocks in plain notation: ``# heading``, ``- item``, fenced code, ``a | b`` rows, ``$$`` formulas.

    Code and formulas over several lines are kept as they are; of HTML code the
    tags go and the entities are read.  ``depth``: lists open at this place, as
    nested items are set in by two blanks a level.
    """

    def __init__(self) -> None:
        self.depth = 0

    def block(self, b: Block, kinds: set[str]) -> str:
        if b.fenced:
            body = b.text.split("\n")[1:]
            return "\n".join(["```", *(body[:-1] if body and body[-1].strip().startswith(("```", "~~~")) else body), "```"])
        if not kinds:
            return b.text
        kept: list[str] = []

        def keep(m: re.Match) -> str:
            if m["pre"] is not None:
                own = _fenced(html.unescape(TAG.sub("", m["pre"])).replace("\xa0", " "))
            elif m["env"]:
                own = _fenced(m["verbatim"])
            elif m["display"]:
                own = "$$\n" + m["body"].strip("\n") + "\n$$"
            elif m["math"]:
                if "\n" not in m["math"]:
                    return m[0]
                own = m["math"]
            else:
                return ""
            kept.append(own)
            return "\n\0\n"

        text = WHOLE.sub(keep, b.text.replace("\0", ""))
        if "html" in kinds:
            text = _PARTS.sub(" ", text)
        if "wiki" in kinds:
            text = _without_templates(text)
        out = []
        for line in text.split("\n"):
            own = kept.pop(0) if line == "\0" else self.line(line, kinds) if line.strip() else ""
            if own:
                out.append(own.replace(INDENT, "  "))
        return "\n".join(out)

    def _list_tag(self, m: re.Match) -> str:
        name = m[1].lower()
        if name == "li":
            return "\n" + INDENT * max(0, self.depth - 1) + "- "
        self.depth = max(0, self.depth + (-1 if m[0][1] == "/" else 1))
        return "\n"

    def line(self, line: str, kinds: set[str]) -> str:
        """One line outside code and formulas."""
        line = line.replace(INDENT, "")
        if "html" in kinds:
            line = re.sub(r"<pre\b[^<>]*>(?:\s*<code\b[^<>]*>)?", "\n```\n", line, flags=re.I)
            line = re.sub(r"(?:</code>\s*)?</pre>", "\n```\n", line, flags=re.I)
            line = re.sub(r"<h([1-6])\b[^<>]*>(.*?)</h\1>", lambda m: f"\n{'#' * int(m[1])} {m[2]}\n", line, flags=re.I)
            line = re.sub(r"</?(ul|ol)\b[^<>]*>|<(li)\b[^<>]*>", lambda m: self._list_tag(re.match(r"</?(\w+)", m[0])), line, flags=re.I)
            line = re.sub(r"</t[dh]>\s*<t[dh]\b[^<>]*>", " | ", line, flags=re.I)
            line = re.sub(r"</?(?:p|div|table|tr|br|blockquote|html|body|section|article|header|dl|dt|dd|caption)\b[^<>]*>|</li\b[^<>]*>", "\n", line, flags=re.I)
            if "\n" in line:
                return "\n".join(x for x in (_inline(y, kinds) for y in line.split("\n")) if x)
        m = re.match(r"\s*(={2,6})([^=]+)\1\s*$", line) or re.match(r"\s*(=(?: =)*) ([^=]+) =(?: =)*\s*$", line)
        if m and "wiki" in kinds:
            return f"{'#' * m[1].count('=')} {_inline(m[2], kinds)}"
        m = re.match(r"\s*\\(chapter|(?:sub)*section|paragraph)\*?\{([^{}]*)\}", line)
        if m and "latex" in kinds:
            level = 1 + m[1].count("sub") if "section" in m[1] else 1 if m[1] == "chapter" else 4
            rest = _inline(line[m.end() :], kinds)
            return f"{'#' * level} {_inline(m[2], kinds)}" + (f"\n{rest}" if rest else "")
        if "latex" in kinds and (m := re.match(r"\s*\\(begin|end)\{(itemize|enumerate|description)\}", line)):
            self.depth = max(0, self.depth + (1 if m[1] == "begin" else -1))
            return ""
        m = re.match(r"(\s*)([*#]+|[-+]|\\item)\s+(\S.*)", line)
        if m and not re.match(r"#{1,6} ", line.lstrip() if "markdown" in kinds else ""):
            level = len(m[2]) - 1 if m[2][0] in "*#" and "wiki" in kinds else self.depth - 1 if m[2][0] == "\\" else len(m[1].expandtabs(4)) // 2
            return INDENT * max(0, level) + f"- {_inline(m[3], kinds)}"
        if re.match(r"\s*\\(?:begin|end)\{|\s*\\hline\s*$|\s*\{\||\s*\|\}|\s*\|-|\s*\|?\s*:?-{3,}", line):
            return ""
        if "latex" in kinds and re.search(r"\s&\s.*\\\\", line):
            return " | ".join(_inline(x, kinds) for x in re.sub(r"\\\\.*", "", line).split("&"))
        if re.match(r"\s*[|!]", line) and kinds & {"markdown", "wiki"}:
            return " | ".join(_inline(x, kinds) for x in re.split(r"\|\|?|!!", line.strip().strip("|!").strip()))
        if "markdown" in kinds:
            line = re.sub(r"^> ?", "", line)
        return _inline(line, kinds)


def to_text(text: str | None, costs: dict[str, list[int]] | None = None) -> str | None:
    """Clean text: boilerplate gone, structure kept; blocks without markup as they are.

    Null stays null.  Texts that are all boilerplate become empty.  Of content
    only what names nothing visible goes: tags, link targets, marks, labels and
    citations; footnotes and captions stay.
    """
    if not text or not HINT.search(text):
        return text
    blocks, labels = labelled(text, costs)
    if not any(any(x) for x in labels.values()):
        return text
    keep = content(blocks)
    out, before, render = [], -1, Renderer()
    code = False
    for i, b in enumerate(blocks):
        kinds = {k for k, x in labels.items() if x[i]}
        if UNDERLINE.match(b.text) and "markdown" in kinds:
            if out and b.text[0] in "=-":
                out[-1] = f"{'#' if b.text[0] == '=' else '##'} {out[-1]}"
            continue
        # an indented block after a blank line is code, and stays code
        gap = before < 0 or b.start > before + 1
        code = bool(labels.get("markdown")) and any(labels["markdown"]) and re.match(r"(?: {4}|\t)", b.text) is not None and (gap or code) and not re.match(r"\s*(?:[-*+]|\d+[.)])\s", b.text)
        own = b.text if code else render.block(b, kinds)
        if not keep[i]:
            continue
        if own:
            if out and before >= 0 and gap:
                out.append("")
            out.append(own)
        before = b.start + len(b.text)
    return "\n".join(out)


FIT_ROWS = 4_000


def fit_costs(df: DataFrame, key: str, text: str, *, fit_rows: int = FIT_ROWS) -> dict[str, list[int]]:
    """Capacities of the ambiguous constructs, fitted on about ``fit_rows`` rows of smallest key hash.

    Of every construct those blocks are counted that stand in texts with a
    certain construct of its markup in another block, and those that do not.
    The capacity is ``PLAIN`` plus the log-odds of the two in half nats, kept
    within 1 and ``PLAIN`` - 1: one ambiguous block alone never outweighs being
    plain, several evidences of one block and neighbours may.
    """
    need_columns(df, key, text)
    rows = df.select(F.xxhash64(key).alias("h"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    share = min(1.0, fit_rows / max(1, df.count()))
    most = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    names = ["kind", "construct", "within", "n"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int, bool], int] = {}
        for batch in batches:
            for t in batch.column("text").to_pylist():
                blocks = blocks_of(_plain_blanks(t))
                classify(blocks)
                for kind in MARKUPS:
                    certain = [b.sure[kind] for b in blocks]
                    total = sum(certain)
                    for b, own in zip(blocks, certain):
                        if not b.maybe[kind]:
                            continue
                        lines = (b.text.split("\n", 1)[0] if b.fenced else _outside(b.text)).split("\n")
                        for k, (p, _) in enumerate(MAYBE[kind]):
                            if any(p.search(x) for x in lines):
                                cell = (kind, k, total - own > 0)
                                seen[cell] = seen.get(cell, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in seen], pa.string()), pa.array([c[1] for c in seen], pa.int32()), pa.array([c[2] for c in seen], pa.bool_()), pa.array(list(seen.values()), pa.int64())], names)

    counted = rows.filter(F.col("h") <= most).select("text").mapInArrow(run, "kind string, construct int, within boolean, n bigint")
    found = {(r["kind"], r["construct"], r["within"]): r["n"] for r in counted.groupBy("kind", "construct", "within").agg(F.sum("n").alias("n")).collect()}
    costs = {}
    for kind in MARKUPS:
        costs[kind] = []
        for k, (_, given) in enumerate(MAYBE[kind]):
            inside, outside = found.get((kind, k, True), 0), found.get((kind, k, False), 0)
            fitted = PLAIN + round(2 * math.log((inside + 1) / (outside + 1)))
            costs[kind].append(given if inside + outside < 20 else max(1, min(PLAIN - 1, fitted)))
    return costs


#: A superset of ``HINT`` before odd blanks are read: texts without any of it stay in the JVM.
_JVM_HINT = "(?m)[<&\\\\`$\\[{*_~=|#>+]|'[\\u00ad\\u200b-\\u200f\\u2060\\ufeff]*'|-[\\u00ad\\u200b-\\u200f\\u2060\\ufeff]*-|(?:^|\\R)[\\s\\h\\u00ad\\u200b-\\u200f\\u2060\\ufeff]*-"


def _apply(df: DataFrame, key: str, text: str, kind: str, make) -> DataFrame:
    need_columns(df, key, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, v) for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()) for v in make(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["key", kind])

    return df.mapInArrow(run, f"key bigint, {kind} string")


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    need_columns(df, key, text)
    return df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))


def found(df: DataFrame, key: str, text: str, costs: dict[str, list[int]] | None = None) -> DataFrame:
    """(key, markup): one row for every markup of which a text holds a construct.

    Null, empty and plain texts have no rows; other columns are ignored.
    """
    rows = _rows(df, key, text).filter(F.col("text").rlike(_JVM_HINT))
    return _apply(rows, "key", "text", "markup", lambda t: markups(t, costs)).withColumnRenamed("key", key)


def cleaned(df: DataFrame, key: str, text: str, costs: dict[str, list[int]] | None = None) -> DataFrame:
    """(key, text): every row's clean text (see ``to_text``)."""
    return _apply(_rows(df, key, text), "key", "text", "text", lambda t: [to_text(t, costs)]).withColumnRenamed("key", key)
