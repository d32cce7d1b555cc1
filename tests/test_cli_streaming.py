import json

import pytest

from corpusloom import cli
from corpusloom.sources import io, store
from corpusloom.streaming.ingest import cleaned_stream, start_cleaning


def lines(path):
    return [json.loads(x) for p in sorted(path.glob("part-*")) for x in p.read_text(encoding="utf-8").splitlines()]


def test_stages_end_to_end(spark, tmp_path, capsys):
    text = [f"= Title {i} =\n\nThe body of article {i % 7} tells of a tower and a bridge .\n" for i in range(12)]
    shard = [(line,) for t in text for line in t.split("\n")]
    spark.createDataFrame(shard, "text string").coalesce(1).write.parquet(str(tmp_path / "shard"))
    cli.main(["prepare-wikitext", "--inputs", str(tmp_path / "shard"), "--output", str(tmp_path / "raw")])
    raw = lines(tmp_path / "raw")
    assert len(raw) == 12 and raw[3]["text"].startswith("Title 3 The body of article 3")
    merged = tmp_path / "raw.jsonl"
    merged.write_text("\n".join(json.dumps(r) for r in [*raw, raw[0], {"x": 1}]), encoding="utf-8")
    cli.main(["clean-corpus", "--input", str(merged), "--output", str(tmp_path / "clean")])
    clean = lines(tmp_path / "clean")
    assert [r["text"] for r in clean] == [r["text"] for r in raw] and "duplicate: 1" in capsys.readouterr().out
    for name, part in (("train", clean[:8]), ("validation", clean[6:10]), ("test", clean[9:])):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps(r) for r in part), encoding="utf-8")
    splits = [x for s in cli.SPLITS for x in (f"--{s}", str(tmp_path / f"{s}.jsonl"))]
    with pytest.raises(ValueError, match="both"):
        cli.main(["validate-splits", *splits])
    cli.main(["deduplicate-splits", *splits, "--output-dir", str(tmp_path / "splits")])
    assert [len(lines(tmp_path / "splits" / f"{s}.jsonl")) for s in cli.SPLITS] == [8, 2, 2]
    cli.main(["train-vocab", "--input", str(tmp_path / "train.jsonl"), "--output", str(tmp_path / "vocab.txt"), "--vocab-size", "60"])
    assert len(io.Vocabulary.load(tmp_path / "vocab.txt")) <= 60
    for name in ("train", "validation"):
        cli.main(["encode-corpus", "--input", str(tmp_path / f"{name}.jsonl"), "--vocab", str(tmp_path / "vocab.txt"), "--output", str(tmp_path / f"{name}.store")])
    cli.main(["encode-corpus", "--packed", "--max-documents", "3", "--input", str(tmp_path / "train.jsonl"), "--vocab", str(tmp_path / "vocab.txt"), "--output", str(tmp_path / "packed")])
    assert len(store.PackedStore(tmp_path / "packed")) == 3
    with pytest.raises(FileExistsError):
        cli.main(["encode-corpus", "--input", str(tmp_path / "train.jsonl"), "--vocab", str(tmp_path / "vocab.txt"), "--output", str(tmp_path / "packed")])
    small = ["--hidden-size", "12", "--num-heads", "3", "--intermediate-size", "24", "--num-layers", "1", "--max-length", "32"]
    common = ["train-model", "--train", str(tmp_path / "train.store"), "--validation", str(tmp_path / "validation.store"), "--checkpoints", str(tmp_path / "c"), "--metrics", str(tmp_path / "m.jsonl"), *small]
    cli.main(common)
    cli.main([*common, "--resume", str(tmp_path / "c" / "epoch_0001.ckpt")])
    assert [json.loads(x)["epoch"] for x in (tmp_path / "m.jsonl").read_text().splitlines()] == [1, 2]
    with pytest.raises(ValueError):
        cli.main([*common, "--max-length", "200"])


def test_stream(spark, tmp_path):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    first = [(1, '{"text": "A document of some length."}', at), (2, '{"text": " a document"}', at), (3, "broken", at), (4, '{"text": "Another long document."}', None)]
    second = [(5, '{"text": "A  document of some length."}', at), (6, '{"text": "The third long document."}', at)]
    for rows in (first, second):
        spark.createDataFrame(rows, "line_number bigint, value string, received_at timestamp").write.mode("append").parquet(str(tmp_path / "in"))
        start_cleaning(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.line_number: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "A document of some length.", 6: "The third long document."}
    with pytest.raises(ValueError):
        cleaned_stream(spark.createDataFrame(first, "line_number bigint, value string, received_at timestamp"), min_characters=0)
