import random
from collections import Counter

import pytest

from corpusloom.functions.text import SPECIAL_TOKENS
from corpusloom.operators import encode, vocabulary
from corpusloom.operators.vocabulary import MergeState, learn_merges
from corpusloom.sources.io import Vocabulary


def texts(spark, values, partitions=2):
    return spark.createDataFrame([(i, t) for i, t in enumerate(values)], "pos bigint, text string").repartition(partitions)


def recount(words, weight):
    piece, pair = Counter(), Counter()
    for own, n in zip(words, weight):
        for p in own:
            piece[p] += n
        for q in zip(own, own[1:]):
            pair[q] += n
    return piece, pair


def brute_force(counts, size):
    """Everything recounted before every merge."""
    words = {w: [w[0], *("##" + c for c in w[1:])] for w in counts}
    tokens = [*SPECIAL_TOKENS, *sorted({p for w in words.values() for p in w} | set("0123456789"))]
    while len(tokens) < size:
        piece, pair = recount(words.values(), counts.values())
        if not pair:
            break
        best = min(pair, key=lambda q: (-(pair[q] / (piece[q[0]] * piece[q[1]])), -pair[q], q))
        new = best[0] + best[1].removeprefix("##")
        for own in words.values():
            i = 0
            while i + 1 < len(own):
                if (own[i], own[i + 1]) == best:
                    own[i : i + 2] = [new]
                i += 1
        if new not in tokens:
            tokens.append(new)
    return tokens


@pytest.mark.parametrize("size, merges", [(19, []), (20, ["ac"]), (21, ["ac", "ab"]), (22, ["ac", "ab", "db"]), (30, ["ac", "ab", "db"])])
def test_stated_merges(spark, size, merges):
    got = vocabulary.train_vocabulary(texts(spark, ["ab ac db"]), size, min_frequency=1).orderBy("id").collect()
    assert [r.token for r in got] == [*SPECIAL_TOKENS, "##b", "##c", *"0123456789", "a", "d", *merges]
    assert [r.id for r in got] == list(range(len(got)))


def test_learning_against_brute_force():
    rng = random.Random(3)
    for _ in range(25):
        counts = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))): rng.randint(1, 9) for _ in range(12)}
        assert learn_merges(counts, 60) == brute_force(counts, 60)


def test_state_is_kept_up_to_date():
    counts = {"play": 3, "played": 2, "aaaa": 4, "go": 1}
    state = MergeState(counts)
    while (pair := state.best()) is not None:
        assert state.merge(pair) > 0
        piece, pairs = recount(state.words, state.weight)
        assert {k: v for k, v in state.piece.items() if v} == piece
        assert {k: v for k, v in state.pair.items() if v} == pairs
    assert state.merge(("x", "##y")) == 0


def test_training_is_independent_of_order(spark):
    own = ["Playing played playing.", "Players play."]
    a = vocabulary.train_vocabulary(texts(spark, own), 30, min_frequency=1).collect()
    b = vocabulary.train_vocabulary(texts(spark, own[::-1], 5), 30, min_frequency=1).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    mixed = vocabulary.train_vocabulary(texts(spark, ["ab中文cd ab中文cd 東京 Русский", None, ""]), 64).collect()
    assert "ab" in {r.token for r in mixed} and all(r.token.isascii() for r in mixed)


def test_training_errors(spark):
    with pytest.raises(ValueError):
        vocabulary.train_vocabulary(texts(spark, ["a"]), 5)
    with pytest.raises(ValueError):
        vocabulary.train_vocabulary(texts(spark, ["a"]), 50, min_frequency=0)
    with pytest.raises(Exception, match="alphabet"):
        vocabulary.train_vocabulary(texts(spark, ["ab ab"]), 8).collect()
    with pytest.raises(Exception, match="no words"):
        vocabulary.train_vocabulary(texts(spark, ["ab"]), 50).collect()


def test_scores_and_ties(spark):
    df = vocabulary.with_initial_pieces(spark.createDataFrame([("ab", 1), ("ac", 1), ("db", 1)], "word string, n bigint"))
    got = [(r.left, r.right, r.score) for r in vocabulary.best_pairs(df, 3).collect()]
    assert got == [("a", "##c", 0.5), ("d", "##b", 0.5), ("a", "##b", 0.25)]
    assert {(r.left, r.right, r.n) for r in vocabulary.pair_counts(vocabulary.with_initial_pieces(spark.createDataFrame([("aaaa", 4), ("x", 2)], "word string, n bigint"))).collect()} == {("a", "##a", 4), ("##a", "##a", 8)}


def test_segmenter():
    own = encode.Segmenter({"[UNK]", "un", "##want", "##ed", "want", "play", "##ing", "hello", "world", ","})
    assert own.pieces("unwanted") == ["un", "##want", "##ed"] and own.pieces("playing") == ["play", "##ing"]
    assert own.pieces("unknown") == ["[UNK]"] and own.pieces("") == []
    assert encode.Segmenter({"[UNK]", "a", "##a"}, max_word=5).pieces("aaaaaa") == ["[UNK]"]
    with pytest.raises(ValueError):
        encode.Segmenter({"a"})
    with pytest.raises(ValueError):
        encode.Segmenter({"[UNK]"}, max_word=0)
    with pytest.raises(TypeError):
        own.pieces(3)


def test_encoding(spark):
    vocab = Vocabulary((*SPECIAL_TOKENS, "hello", "world", "play", "##ing", ",", "!"))
    df = texts(spark, ["Hello, playing!", "", None, "hello [SEP] zzz", "hello " * 600])
    got = {r.pos: r.token_ids for r in encode.encode_documents(df, vocab).collect()}
    assert got == {0: [5, 9, 7, 8, 10], 3: [5, 3, 1], 4: [5] * 600}
    whole = {r.pos: r.token_ids for r in encode.encode_documents(df, vocab, add_special_tokens=True).collect()}
    assert whole[0] == [2, 5, 9, 7, 8, 10, 3]
    frame = vocab.frame(spark)
    ids = encode.tokens_to_ids(spark.createDataFrame([("hello",), ("nope",)], "token string"), frame).collect()
    assert {(r.token, r.id) for r in ids} == {("hello", 5), ("nope", 1)}
    back = encode.ids_to_tokens(spark.createDataFrame([(5,), (10,)], "id int"), frame).collect()
    assert {(r.id, r.token) for r in back} == {(5, "hello"), (10, "!")}
    with pytest.raises(Exception, match="outside the vocabulary"):
        encode.ids_to_tokens(spark.createDataFrame([(99,)], "id int"), frame).collect()
    assert encode.first_documents(df, 2).count() == 2
    row = encode.validate_vocabulary(frame).first()
    assert (row["size"], row.duplicates, row.gaps, row.specials) == (11, 0, 0, 5)


def test_vocabulary(spark, tmp_path):
    vocab = Vocabulary((*SPECIAL_TOKENS, "hello"))
    vocab.save(tmp_path / "v.txt")
    assert Vocabulary.load(tmp_path / "v.txt") == vocab and len(vocab) == 6 and "hello" in vocab
    assert Vocabulary.from_frame(vocab.frame(spark)) == vocab
    assert vocab.token_id("zzz") == 1 and vocab.token_for_id(5) == "hello"
    for bad, kind in (("5", TypeError), (True, TypeError), (6, ValueError), (-1, ValueError)):
        with pytest.raises(kind):
            vocab.token_for_id(bad)
    for tokens in (("a",), (*SPECIAL_TOKENS, "a", "a")):
        with pytest.raises(ValueError):
            Vocabulary(tokens)
