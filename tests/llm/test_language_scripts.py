from pathlib import Path

import numpy as np
import pytest

from corpusloom.llm import language
from corpusloom.llm.kernel import Chunk

EN = "The tower was built by the men who had come from the north. They said that it would be the last one of all."
RU = "Там было много домов, и все они были под городом, который никто не видел."
FREQUENT = [("en", w) for w in "the was by who had from they that it would be of all come".split()] + [("ru", w) for w in "и все они были под который не".split()]
DATA = Path("/root/testdata/sf0.01")


def test_other_scripts(spark):
    rows = [(1, "塔は北から来た人々によって建てられた。 彼らは言った。"), (2, "Ο πύργος χτίστηκε από τους άνδρες που ήρθαν."), (3, "بني البرج من قبل الرجال الذين جاءوا من الشمال"), (4, EN), (5, EN + " Ο πύργος χτίστηκε από τους άνδρες που ήρθαν από τον βορρά."), (6, RU)]
    df = spark.createDataFrame([(*r, None) for r in rows], "doc_id bigint, text string, lang string")
    model = language.fit([EN, RU] * 3, ["en", "ru"] * 3, FREQUENT)
    got = {r.doc_id: r for r in language.documents(df, "doc_id", "text", model).collect()}
    assert {i: got[i].lang for i in got} == {1: "other", 2: "other", 3: "other", 4: "en", 5: "en", 6: "ru"} and got[5].langs == ["en", "other"]
    assert [r.lang for r in language.segments(df, "doc_id", "text", model).filter("doc_id = 5").orderBy("segment").collect()] == ["en", "other"]
    assert sorted((r.doc_id, r.lang) for r in language.wrong_or_mixed(df, "doc_id", "text", "lang", model).collect()) == [(4, "en"), (5, "en"), (6, "ru")]


@pytest.mark.parametrize("block", [1, 3, 8])
def test_blocks_give_the_labels_of_one_pass(block):
    rng = np.random.default_rng(block)
    for _ in range(20):
        sizes = rng.integers(1, 80, 5)
        score = rng.normal(size=(sizes.sum(), 4)).astype(np.float32)
        cost = (rng.random(sizes.sum()) * 3).astype(np.float32)
        first = np.cumsum(sizes) - sizes
        whole = language.viterbi(score, cost, first, first + sizes, 10_000)
        assert language.viterbi(score, cost, first, first + sizes, block).tolist() == whole.tolist()


@pytest.fixture(scope="module")
def fitted(spark):
    if not DATA.exists():
        pytest.skip("test tables are not here")
    df = spark.read.parquet(f"{DATA}/documents.parquet").filter("text is not null")
    return df, language.fit_from(df.filter("doc_id % 2 = 0"), "doc_id", "text", "lang", spark.read.parquet(f"{DATA}/common_words.parquet"))


def test_letters_no_language_uses(fitted):
    model = fitted[1]
    chunk = Chunk(["Він прийшов до міста і побачив її дім, але ніхто не відповів їй.", "Она пришла в город и увидела дом, но никто не ответил ей."])
    score, doc, _, _ = model.words(chunk)
    assert [model.names[int(score[doc == d].sum(axis=0).argmax())] for d in (0, 1)] == ["other", "ru"]


def test_confidence_is_calibrated(fitted):
    """On rows that taught nothing, windows of a stated confidence are right about so often."""
    df, model = fitted
    assert model.leads.size > 3 and (np.diff(model.worth) >= 0).all() and model.worth[0] < 0.2 and model.worth[-1] < 1
    rows = [(r.text, language.read_label(r.lang)) for r in df.filter("doc_id % 2 = 1").select("text", "lang").collect()]
    rows = [(t, x) for t, x in rows if x and language._speaks(model, t) in (None, x)]
    sure, right = [], []
    for text, told in rows:
        score = model.words(Chunk([text]))[0]
        for a in range(0, len(score), 7):
            sums = score[a : a + 1]
            if language._lead(sums)[0] > 0:
                sure.append(model.confidence(sums)[0])
                right.append(model.names[int(sums.argmax())] == told)
    sure, right = np.array(sure), np.array(right)
    assert len(sure) > 1000 and 0.02 < (sure < 0.9).mean()
    for low, high in ((0.3, 0.8), (0.8, 0.95), (0.95, 1.0)):
        own = (sure >= low) & (sure < high)
        if own.sum() > 100:
            assert abs(sure[own].mean() - right[own].mean()) < 0.08, (low, sure[own].mean(), right[own].mean())
