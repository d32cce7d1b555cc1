import random

import numpy as np
import pytest

from corpusloom.functions.text import basic_tokens
from corpusloom.llm import language, mixing, packing, pieces, tokens

TEXTS = [
    "# Head\n\n" + "A sentence here. " * 30 + "\n\n## Next\n\n" + "- item one\n- item two\n" * 20,
    "word " * 500, "x" * 3000, "a\n\n" * 900, "é́" * 900, "One. " + "y" * 2500 + " end.", "```\n" + "code line\n" * 200 + "```\n" + "Tail text. " * 100, " \n" * 1500,
]


@pytest.mark.parametrize("limit, overlap", [(200, 20), (300, 0), (50, 49), (1, 0)])
def test_round_trip(limit, overlap):
    for text in [*TEXTS, "short", ""]:
        text = text[:400] if limit == 1 else text
        cuts = pieces.split_text(text, limit, overlap)
        assert "".join(text[n:e] for _, n, e in cuts) == text
        assert all(e - s <= limit and n - s <= overlap and e > n for s, n, e in cuts)
    with pytest.raises(ValueError):
        pieces.split_text("x", 10, 10)


def test_natural_places():
    text = "# A\n\n" + "Short one. " * 10 + "\n\n# B\n\n" + "Other one. " * 10
    cuts = pieces.split_text(text, 140, 0)
    assert [text[s:e][:3] for s, _, e in cuts] == ["# A", "# B"]
    cuts = pieces.split_text("One two three. Four five six. Seven eight nine.", 32, 15)
    assert cuts == [(0, 0, 15), (4, 15, 30), (15, 30, 47)]
    assert all(text[e] != "́" for text in [TEXTS[4]] for _, _, e in pieces.split_text(text, 101, 0)[:-1])


def test_tokens_are_cut_between_words():
    own = ["a", "##b", "c", ".", "d", "##e", "##f", ",", "g"] * 30
    cuts = pieces.split_tokens(own, len(own), 40, 8)
    assert sum(e - n for _, n, e in cuts) == len(own) and all(e - s <= 40 for s, _, e in cuts)
    assert all(not own[s].startswith("##") and not own[n].startswith("##") for s, n, _ in cuts)
    assert all(own[e - 1] == "." for _, _, e in cuts[:-1])
    blind = pieces.split_tokens(None, 100, 40, 8)
    assert [c[1:] for c in blind] == [(0, 32), (32, 64), (64, 96), (96, 100)]


def test_piece_rows(spark):
    df = spark.createDataFrame([(1, "x y " * 1000, 0), (1, "x y " * 1000, 0), (2, None, 0), (3, "", 0), (4, "z" * 2000, 0)], "pos bigint, text string, piece int")
    got = pieces.text_pieces(df, "pos", "text").collect()
    assert {r.pos for r in got} == {1} and all(len(r.piece_text) <= 2000 for r in got)
    assert [r.pos for r in pieces.oversized(pieces.text_pieces(df, "pos", "text"), "pos").collect()] == [1]
    vocab = spark.createDataFrame([(0, "a"), (1, "##b"), (2, ".")], "id int, token string")
    rows = [(0, 0, 7, 0, 600, [0, 1, 2] * 200), (0, 0, 7, 0, 600, [0, 1, 2] * 200), (0, 1, 8, 600, 1200, None), (0, 2, 9, 1200, 1210, [0] * 10), (0, 3, 10, None, None, [0])]
    store = spark.createDataFrame(rows, "store int, doc_index bigint, pos bigint, start_offset bigint, end_offset bigint, token_ids array<int>")
    got = sorted((r.pos, r.start, r.new_start, r.end) for r in pieces.token_pieces(store, vocab).collect())
    assert {g[0] for g in got} == {7, 8} and got[0][:3] == (7, 0, 0) and max(g[3] for g in got if g[0] == 7) == 600
    assert sum(e - n for p, _, n, e in got if p == 8) == 600
    assert pieces.token_pieces(store.limit(0), vocab).count() == 0


def test_token_counts(spark):
    texts = ["UNwantéd, running 12", "中文 и русский й", "नमस्ते café", "İ ≠ ½ ΣΑΣ", "", "​", "a\x0bb c", "ﬁ🙂x", "한국어 ọ́"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    exact = {r.i: len(r.x) for r in df.select("i", basic_tokens("t").alias("x")).collect()}
    assert tokens.counts(texts).tolist() == [exact[i] for i in range(len(texts))] == [tokens.count_slow(t) for t in texts]


def test_plan_holds_everything():
    rng = random.Random(2)
    for capacity in (1, 7, 64, 512):
        histogram = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(60)}
        patterns = packing.plan(histogram, capacity)
        held: dict[int, int] = {}
        for p in patterns:
            assert sum(s * n for s, n in p.content) <= capacity
            for s, n in p.content:
                held[s] = held.get(s, 0) + n * p.times
        assert held == histogram
        assert len(patterns) <= 4 * len(histogram) + 8
        places = packing.Places(patterns)
        size = np.repeat(list(histogram), list(histogram.values()))
        rank = np.concatenate([np.arange(n) for n in histogram.values()])
        container, start = places.find(size, rank)
        for c in np.unique(container):
            own = sorted(zip(start[container == c].tolist(), size[container == c].tolist()))
            assert all(a + n <= b for (a, n), (b, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] <= capacity
    with pytest.raises(ValueError):
        packing.plan({9: 1}, 8)


def test_packing(spark):
    rng = random.Random(4)
    rows = [(i, "w " * (100 if i % 3 == 0 else rng.randint(0, 700)), 5) for i in range(150)] + [(999, None, 5), (1000, " ", 5), (0, "w " * 20, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tokens int").repartition(4)
    got = packing.packed(df, "doc_id", "text", step=4).collect()
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.container, []).append((r.start, r.tokens))
    for own in by.values():
        own.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] <= 512
    assert sum(r.tokens for r in got) == sum(len((t or "").split()) for _, t, _ in rows)
    assert set(by) == set(range(len(by))) and all(r.pieces == 1 for r in got if r.doc_id % 3 == 0)
    assert sum(r.tokens for r in got) / (512 * len(by)) > 0.95
    report = packing.report(packing.packed(df, "doc_id", "text", step=4)).first()
    assert report.containers == len(by) and report.steps == -(-len(by) // 4)
    assert packing.packed(df.limit(0), "doc_id", "text").count() == 0


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(1, 60), rng.choice(["A", " a", "\tB ", "b", "c", None, "zzz"])) for i in range(900)] + [(5000, None, "a"), (5001, "", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.25, 1), ("d", 0.05, 9)], "source string, target_share double, max_repeats int")
    size = {n: sum(len((t or "").split()) for _, t, s in rows if s and s.strip().lower() == n) for n in "abcd"}
    total = sum(size.values())
    expected = {n for n, share, most in (("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.25, 1), ("d", 0.05, 9)) if share * total > most * size[n]}
    sized = mixing.sized_rows(df, targets, "doc_id", "text", "source")
    assert {r.source for r in mixing.allocation(sized, targets).filter("not reachable").collect()} == expected
    mix, shares = mixing.mixed(df, targets, "doc_id", "text", "source")
    mix, shares = mix.collect(), {r.source: r for r in shares.collect()}
    repeats = {"a": 1, "b": 3, "c": 1, "d": 9}
    assert all(r.copies <= repeats[r.source] for r in mix) and len({r.doc_id for r in mix}) == len(mix)
    for name in "abc":
        budget = min({"a": 0.2, "b": 0.5, "c": 0.25}[name] * total, repeats[name] * size[name])
        assert abs(shares[name].mixed_tokens - budget) < 0.12 * budget, name
    again = mixing.mixed(df.repartition(7), targets, "doc_id", "text", "source")[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, mix))
    for empty in (df.limit(0), df.filter("source is null")):
        mix, shares = mixing.mixed(empty, targets, "doc_id", "text", "source")
        assert mix.count() == 0 and shares.count() == 4


EN = "The tower was built by the men who had come from the north. They said that it would be the last one of all."
FR = "La tour est dans la ville et les hommes qui sont venus avec nous ont dit que c'est pour tous les autres."
DE = "Der Turm ist in der Stadt und die Leute haben gesagt, dass sie nicht mehr auf den Berg gehen werden."
RU = "Там было много домов, и все они были под городом, который никто не видел."
FREQUENT = [("en", w) for w in "the was by who had from they that it would be of all come".split()] + [("fr", w) for w in "la est dans et les qui sont avec ont que pour tous".split()] + [("de", w) for w in "der ist in und die haben dass sie nicht mehr auf den werden".split()] + [("ru", w) for w in "и все они были под который не".split()]


def model():
    return language.fit([EN, FR, DE, RU] * 3, ["en", "fr", "de", "ru"] * 3, FREQUENT)


def test_languages(spark):
    cases = [(1, EN, "en"), (2, EN, "fr"), (3, FR, None), (4, EN + " " + FR, "en"), (5, EN[:59] + " " + RU + " " + DE, "en"), (6, "12 34 56", "en"), (7, None, None), (8, " ", "xx"), (9, FR, "fr-FR"), (10, DE, "German"), (11, EN.replace("men", "les hommes"), "EN"), (12, RU, "unknown"), (13, EN * 400, "en"), (1, EN, "en")]
    df = spark.createDataFrame([(*c, "clash") for c in cases], "doc_id bigint, text string, lang string, key string").repartition(3)
    got = sorted((r.doc_id, r.lang) for r in language.wrong_or_mixed(df, "doc_id", "text", "lang", model()).collect())
    assert got == [(2, "en"), (3, "fr"), (4, "en"), (4, "fr"), (5, "de"), (5, "en"), (5, "ru"), (12, "ru")]
    whole = {r.doc_id: r for r in language.documents(df, "doc_id", "text", model()).collect()}
    assert whole[6].lang is None and whole[7].lang is None and whole[8].langs == [] and whole[1].confidence > 0.99
    spans = language.segments(df, "doc_id", "text", model()).orderBy("doc_id", "segment").collect()
    assert [r.lang for r in spans if r.doc_id == 4] == ["en", "fr"] and not [r for r in spans if r.doc_id in (6, 7, 8)]
    assert language.segments(df.limit(0), "doc_id", "text", model()).count() == 0
    frequent = spark.createDataFrame(FREQUENT, "lang string, word string")
    fitted = language.fit_from(df, "doc_id", "text", "lang", frequent)
    assert {r.doc_id: r.lang for r in language.documents(df, "doc_id", "text", fitted).collect()}[9] == "fr"
    assert language.fit_from(df.limit(0), "doc_id", "text", "lang", frequent).known.size


def test_labels():
    assert [language.read_label(x) for x in ("en", "EN ", "en-US", "English", "deu", "русский", "xx", "und", "", "--", None)] == ["en", "en", "en", "en", "de", "ru", None, None, None, None, None]


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = rng.integers(1, 6, 4)
        score = rng.normal(size=(sizes.sum(), 3)).astype(np.float32) * 3
        cost = rng.random(sizes.sum()).astype(np.float32) * 4
        first = np.cumsum(sizes) - sizes
        label = language.viterbi(score, cost, first, first + sizes)
        for f, n in zip(first, sizes):
            value = lambda path, f=f: sum(score[f + t, k] - (cost[f + t] if t and path[t - 1] != k else 0) for t, k in enumerate(path))
            best = max(map(value, itertools.product(range(3), repeat=int(n))))
            assert abs(value(label[f : f + n].tolist()) - best) < 1e-4


def test_held_out_accuracy(spark):
    """Half of the smallest documents teach, the other half is labelled."""
    from pathlib import Path

    path = Path("/root/testdata/sf0.01")
    if not path.exists():
        pytest.skip("test tables are not here")
    df = spark.read.parquet(f"{path}/documents.parquet").filter("text is not null")
    words = spark.read.parquet(f"{path}/common_words.parquet")
    fitted = language.fit_from(df.filter("doc_id % 2 = 0"), "doc_id", "text", "lang", words)
    rows = language.documents(df.filter("doc_id % 2 = 1").withColumnRenamed("lang", "told"), "doc_id", "text", fitted, carry=("told",)).collect()
    known = [r for r in rows if language.read_label(r.told) and r.lang]
    assert sum(language.read_label(r.told) == r.lang for r in known) / len(known) > 0.93
