import random

from corpusloom.llm import packing, pieces


def test_tiers_are_packed_apart():
    """Documents of a shorter tier share full windows of their own tier, which one greedy run over sizes would not make."""
    assert packing.tiers_of(512) == [512, 256, 128, 64] and [packing.tier_of(s, 512) for s in (1, 64, 65, 300, 512)] == [64, 64, 128, 512, 512]
    patterns = packing.plan({300: 2, 212: 2, 200: 2, 100: 2, 56: 2}, 512)
    # one greedy run would put 200 + 200 + 100 together
    assert sorted((p.content, p.times) for p in patterns) == [([(100, 2)], 1), ([(200, 2), (56, 2)], 1), ([(300, 1), (212, 1)], 2)]


def test_windows_of_shorter_tiers_fill_containers():
    patterns = packing.plan({64: 80, 200: 30, 56: 30, 100: 7}, 512)
    assert sum(p.times for p in patterns) <= -(-(64 * 80 + 256 * 30 + 700) // 512) + 1


def test_tiers_of_packed_rows(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([10, 60, 64, 100, 128, 250, 256, 400, 512, 700]), 5) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tier int")
    got = packing.packed(df, "doc_id", "text", step=4)
    assert all(r.tier == packing.tier_of(r.tokens, 512) for r in got.collect())
    assert packing.checks(got).first().asDict() == {"documents": 200, "pieces": sum(-(-len(t.split()) // 512) for _, t, _ in rows), "tokens": sum(len(t.split()) for _, t, _ in rows), "overfull": 0, "overlapping": 0, "misplaced": 0}


def test_long_runs_of_marks_and_blanks_stay_whole():
    marks = "a" + "́" * 100
    text = "b" * 150 + marks + "c" * 300
    cuts = pieces.split_text(text, 200, 0)
    at = [e for _, _, e in cuts[:-1]]
    assert 150 in at and not any(150 < e < 251 for e in at)
    huge = "a" + "́" * 500
    assert "".join(huge[n:e] for _, n, e in pieces.split_text(huge, 100, 0)) == huge
    code = "```\n" + "x = 1\n" + " " * 1000 + "y = 2\n" + "z\n" * 30 + "```\n" + "Tail words. " * 20
    tree = pieces.text_tree(code)
    assert code.index("y = 2") in tree.at[pieces.LINE]


def test_rejoined(spark):
    import hashlib

    texts = ["Some words here. " * 300, "x" * 5000, "# A\n\n" + "- item\n" * 900]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "pos bigint, text string")
    got = {r.pos: (r.id, r.fits) for r in pieces.rejoined(pieces.text_pieces(df, "pos", "text"), "pos").collect()}
    assert got == {i: (hashlib.sha256(t.encode()).hexdigest(), True) for i, t in enumerate(texts)}
