import json
import random

import pytest

from corpusloom.operators import clean, segment
from corpusloom.sources import io

LINES = [
    '{"text": "  A sufficiently long\\tfirst document.  "}',
    '{"text": "A sufficiently long first document."}',
    '{"text": "too short"}',
    '{"text": "  \\t\\n  "}',
    '{"url": "https://example.com"}',
]


def lines(spark, values, partitions=2):
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "line_number bigint, value string").repartition(partitions)


def test_cascade(spark):
    rows = clean.classify(clean.parse_records(lines(spark, LINES))).orderBy("position").collect()
    assert [r.status for r in rows] == ["kept", "duplicate", "short", "empty", "invalid_schema"]
    kept = clean.clean_documents(clean.parse_records(lines(spark, LINES))).collect()
    assert [(r.position, r.text) for r in kept] == [(1, "A sufficiently long first document.")]
    stats = clean.cleaning_stats(clean.classify(clean.parse_records(lines(spark, LINES)))).first()
    assert stats.total == 5 and stats.kept == 1 and stats.invalid_json == 0
    with pytest.raises(ValueError):
        clean.classify(clean.parse_records(lines(spark, LINES)), min_characters=0)


def test_json_kinds(spark):
    values = ["not json", '["x"]', '{"text": 123}', '{"text": NaN}', '{"text": "a"} junk', '{"text": "a", "text": "b"}', "", "   ", None, "{", '{"text": "\\ud800x"}', "1", "null"]
    got = {r.line_number: (r.kind, r.text) for r in clean.parse_records(lines(spark, values)).collect()}
    kinds = [got[i + 1][0] for i in range(len(values))]
    assert kinds == ["invalid", "not_object", "no_text", "no_text", "invalid", "text", "blank", "blank", "blank", "invalid", "text", "not_object", "not_object"]
    assert got[6][1] == "b" and got[11][1] == "?x"
    with pytest.raises(Exception, match="line 2"):
        clean.require_objects(clean.parse_records(lines(spark, ['{"a": 1}', "not json"]))).collect()
    assert clean.classify(clean.parse_records(lines(spark, []).limit(0))).count() == 0


def splits(spark, rows):
    order = {"train": 0, "validation": 1, "test": 2}
    counts: dict[str, int] = {}
    out = []
    for split, key in rows:
        counts[split] = counts.get(split, 0) + 1
        out.append((split, order[split], counts[split], key, f"text {key}"))
    return spark.createDataFrame(out, "split string, split_ord int, line_number bigint, id string, text string").repartition(3)


def test_splits(spark):
    df = splits(spark, [("train", "a"), ("train", "b"), ("validation", "b"), ("validation", "c"), ("test", "a"), ("test", "c"), ("test", "d")])
    kept = {(r.split, r.id) for r in clean.deduplicate_splits(df).collect()}
    assert kept == {("train", "a"), ("train", "b"), ("validation", "c"), ("test", "d")}
    assert {r.split: r.removed for r in clean.split_stats(df).collect()} == {"train": 0, "validation": 1, "test": 2}
    with pytest.raises(ValueError, match="'train' and 'validation'"):
        clean.validate_disjoint(df)
    assert clean.validate_disjoint(clean.deduplicate_splits(df)) == {"train": 2, "validation": 1, "test": 1}
    with pytest.raises(ValueError, match="both 'train' and 'train'"):
        clean.validate_disjoint(splits(spark, [("train", "x"), ("train", "x")]))
    with pytest.raises(Exception, match="id must be a string"):
        clean.deduplicate_splits(splits(spark, [("train", None)])).collect()
    with pytest.raises(ValueError):
        clean.validate_disjoint(df.limit(0))
    assert clean.deduplicate_splits(splits(spark, [("train", None), ("test", "z")]), strict=False).count() == 1


def shard(spark, rows, partitions):
    return spark.createDataFrame([(s, i, t) for s, i, t in rows], "shard int, row_index bigint, line string").repartition(partitions)


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_line_documents(spark, partitions):
    text = ["= First article =", "", "First article body.", "= = First section = =", "More body text.", "", "= Second article =", "A second article."]
    rows = [(i // 3, i % 3, t) for i, t in enumerate(text)]
    got = segment.line_documents(shard(spark, rows + rows[:2], partitions), block=2).orderBy("doc_no").collect()
    assert [r.text for r in got] == ["First article First article body. = = First section = = More body text.", "Second article A second article."]
    plain = segment.line_documents(shard(spark, [(0, 0, "A plain document."), (0, 1, " With another line. 　")], partitions)).collect()
    assert [r.text for r in plain] == ["A plain document. With another line."]
    assert segment.line_documents(shard(spark, [(0, 0, " "), (0, 1, "")], partitions)).count() == 0
    with pytest.raises(Exception, match="line must be a string"):
        segment.line_documents(shard(spark, [(0, 0, None)], partitions)).collect()
    assert segment.line_documents(shard(spark, [(0, 0, None), (0, 1, "x")], partitions), strict=False).count() == 1


def test_titles(spark):
    cases = [("= a =", "a"), ("= a = =", "a ="), ("= = a = =", None), ("=a=", None), ("　= Title (x) =\t", "Title (x)"), (None, None), ("= =", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, line string")
    got = {r.i: r.x for r in df.select("i", segment.article_title("line").alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [e for _, e in cases]


def test_json_files(spark, tmp_path):
    values = [json.dumps({"text": f"line {i}", "n": i}) for i in range(300)]
    values[7] = ""
    (tmp_path / "a.jsonl").write_text("\r\n".join(values), encoding="utf-8")
    rows = io.read_corpus_texts(spark, str(tmp_path / "a.jsonl")).collect()
    assert [(r.line_number, r.text) for r in sorted(rows)] == [(i + 1, f"line {i}") for i in range(300) if i != 7]
    n = io.write_texts(spark.createDataFrame([("First document.",), ("Café document.",)], "text string"), str(tmp_path / "out"))
    assert n == 2 and sorted(r.text for r in spark.read.json(str(tmp_path / "out")).collect()) == ["Café document.", "First document."]
    with pytest.raises(Exception, match="text must be a string"):
        io.write_texts(spark.createDataFrame([(None,)], "text string"), str(tmp_path / "bad"))
    (tmp_path / "b.jsonl").write_text('{"text": "x"}\n{"id": "one", "text": 123}\n', encoding="utf-8")
    with pytest.raises(Exception, match="on line 2"):
        io.read_corpus_texts(spark, str(tmp_path / "b.jsonl")).collect()


def test_parquet_texts(spark, tmp_path):
    for name, texts in (("a", ["First.", "Second."]), ("b", ["Third."])):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.parquet(str(tmp_path / name))
    rows = io.read_texts(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).orderBy("shard", "row_index").collect()
    assert [r.text for r in rows] == ["First.", "Second.", "Third."]
    with pytest.raises(ValueError):
        io.read_texts(spark, str(tmp_path / "a"), batch_size=0)
    for bad in ("content string", "text int"):
        path = str(tmp_path / bad.split()[1])
        spark.createDataFrame([], bad).write.mode("overwrite").parquet(path)
        with pytest.raises(ValueError):
            io.read_texts(spark, path)
    spark.createDataFrame([(None,)], "text string").write.parquet(str(tmp_path / "null"))
    with pytest.raises(Exception, match="row 1"):
        io.read_texts(spark, str(tmp_path / "null")).collect()


def test_metrics_and_checkpoints(tmp_path):
    io.append_metrics(tmp_path / "m" / "log.jsonl", {"epoch": 1})
    io.append_metrics(tmp_path / "m" / "log.jsonl", {"epoch": 2})
    assert [json.loads(x)["epoch"] for x in (tmp_path / "m" / "log.jsonl").read_text().splitlines()] == [1, 2]
    path = io.save_checkpoint(tmp_path / "c", 3, {"model": {}, "optimizer": {}})
    assert path.name == "epoch_0003.ckpt" and io.load_checkpoint(path)["epoch"] == 3
    io.save_checkpoint(tmp_path / "c", 4, {"model": {}})
    with pytest.raises(ValueError):
        io.load_checkpoint(tmp_path / "c" / "epoch_0004.ckpt")
    with pytest.raises(Exception):
        io.save_checkpoint(tmp_path / "c", 5, {"model": lambda: 0})
    assert len(list((tmp_path / "c").iterdir())) == 2


def test_running_totals(spark):
    from pyspark.sql import functions as F

    from corpusloom.operators.positions import dense_index, running_totals

    rng = random.Random(1)
    keys = sorted({(rng.randrange(4), rng.randrange(200)) for _ in range(150)})
    df = spark.createDataFrame([(a, b, rng.randrange(5)) for a, b in keys], "a int, b bigint, v int").repartition(5)
    rows = sorted((r.a, r.b, r.v, r.t, r.i) for r in dense_index(running_totals(df, "a", "b", {"t": F.col("v")}, block=16), "a", "b", "i", block=7).collect())
    total = 0
    for i, (_, _, v, t, index) in enumerate(rows):
        total += v
        assert (t, index) == (total, i)
