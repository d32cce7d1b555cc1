"""Command line: every stage from raw shards to a trained model.

    python -m corpusloom.cli STAGE --help
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import clean, encode, model, segment, training, vocabulary
from corpusloom.sources import io, store

SPLITS = ("train", "validation", "test")


def _spark() -> SparkSession:
    return SparkSession.builder.appName("corpusloom").getOrCreate()


def _documents(spark: SparkSession, path: str, most: int | None) -> DataFrame:
    texts = io.read_corpus_texts(spark, path)
    return encode.first_documents(texts, most, position="line_number", start=1) if most else texts


def prepare_wikitext(a: argparse.Namespace) -> None:
    lines = io.read_texts(_spark(), a.inputs, batch_size=a.batch_size).withColumnRenamed("text", "line")
    documents = segment.line_documents(lines)
    print(f"documents: {io.write_texts(documents.repartitionByRange('doc_no').sortWithinPartitions('doc_no'), a.output)}")


def clean_corpus(a: argparse.Namespace) -> None:
    records = io.read_json_lines(_spark(), a.input)
    kept = clean.clean_documents(records, min_characters=a.min_characters)
    kept.repartitionByRange("position").sortWithinPartitions("position").select("id", "text").write.mode("overwrite").json(a.output)
    for name, value in clean.cleaning_stats(clean.classify(records, min_characters=a.min_characters)).first().asDict().items():
        print(f"{name}: {value}")


def _splits(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    out = None
    for order, name in enumerate(SPLITS):
        rows = io.read_json_lines(spark, getattr(a, name)).select(F.lit(name).alias("split"), F.lit(order).alias("split_ord"), "line_number", F.get_json_object("value", "$.id").alias("id"), "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def deduplicate_splits(a: argparse.Namespace) -> None:
    paths = [getattr(a, s) for s in SPLITS]
    if len(set(map(str, map(Path.resolve, map(Path, [*paths, a.output_dir]))))) != 4:
        raise ValueError("inputs and output must be different paths")
    rows = _splits(_spark(), a)
    kept = clean.deduplicate_splits(rows)
    for name in SPLITS:
        own = kept.filter(F.col("split") == name).repartitionByRange("line_number").sortWithinPartitions("line_number")
        own.select("value").write.mode("overwrite").text(f"{a.output_dir}/{name}.jsonl")
    for r in clean.split_stats(rows).collect():
        print(f"{r.split}: {r.input} in, {r.kept} kept, {r.removed} removed")


def validate_splits(a: argparse.Namespace) -> None:
    for name, n in clean.validate_disjoint(_splits(_spark(), a)).items():
        print(f"{name}: {n}")


def train_vocab(a: argparse.Namespace) -> None:
    spark, began = _spark(), time.time()
    table = vocabulary.train_vocabulary(_documents(spark, a.input, a.max_documents), a.vocab_size, min_frequency=a.min_frequency)
    own = io.Vocabulary.from_frame(table)
    own.save(a.output)
    print(f"tokens: {len(own)}, seconds: {time.time() - began:.1f}")


def encode_corpus(a: argparse.Namespace) -> None:
    if Path(a.output).exists():
        raise FileExistsError(a.output)
    spark, began = _spark(), time.time()
    vocab = io.Vocabulary.load(a.vocab)
    rows = encode.encode_documents(_documents(spark, a.input, a.max_documents), vocab, key="line_number")
    if a.packed:
        store.write_packed(rows, a.output, a.vocab, order="line_number")
        opened = store.PackedStore(a.output)
    else:
        store.write_store(rows, a.output, vocab, order="line_number")
        opened = store.Store.open(spark, a.output)
    print(f"documents: {len(opened)}, tokens: {opened.num_tokens}, seconds: {time.time() - began:.1f}")


def train_model(a: argparse.Namespace) -> None:
    if not 3 <= a.max_length <= 128:
        raise ValueError("max_length must be from 3 to 128")
    training.choose_device(a.device)
    spark = _spark()
    train, validation = store.Store.open(spark, a.train), store.Store.open(spark, a.validation)
    if train.vocabulary != validation.vocabulary:
        raise ValueError("training and validation vocabularies differ")
    size = len(train.vocabulary)
    shape = model.Shape(size, 128, a.hidden_size, a.num_heads, a.intermediate_size, a.num_layers)
    parameters, optimizer, done = model.init(shape, a.seed), model.AdamW(a.learning_rate), 0
    if a.resume:
        state = io.load_checkpoint(a.resume)
        if state.get("shape") != shape:
            raise ValueError("the checkpoint is of another model")
        parameters, done = state["model"], state["epoch"]
        optimizer.load(state["optimizer"])
    for epoch in range(done + 1, done + a.epochs + 1):
        began, row = time.time(), {"epoch": epoch}
        batches = lambda s, e: training.masked_batches(s.documents, vocab_size=size, max_length=a.max_length, batch_size=a.batch_size, seed=a.seed, epoch=e, max_batches=a.max_batches)
        for name, got in (("train", training.train_epoch(batches(train, 2 * epoch), parameters, shape, optimizer)), ("validation", training.evaluate_epoch(batches(validation, 2 * epoch + 1), parameters, shape))):
            row |= {f"{name}_loss": got.loss, f"{name}_batches": got.batches, f"{name}_masked_positions": got.masked_positions}
        row |= {"seconds": time.time() - began, "max_length": a.max_length, "batch_size": a.batch_size, "learning_rate": a.learning_rate, "seed": a.seed, "vocab_size": size, "device": "cpu"}
        io.append_metrics(a.metrics, row)
        io.save_checkpoint(a.checkpoints, epoch, {"model": parameters, "optimizer": optimizer.state(), "shape": shape, "metrics": row})
        print(row)


def check_environment(a: argparse.Namespace) -> None:
    import numpy as np
    import pyspark

    print(f"python {sys.version.split()[0]}, pyspark {pyspark.__version__}, numpy {np.__version__}")
    one = np.ones((1024, 1024), np.float32)
    print(f"matrix product: {float((one @ one).sum()):.0f}, rows counted: {_spark().range(1024).count()}")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    stages = out.add_subparsers(required=True)

    def stage(run: Callable, *needed: str, **optional) -> argparse.ArgumentParser:
        p = stages.add_parser(run.__name__.replace("_", "-"))
        p.set_defaults(run=run)
        for name in needed:
            p.add_argument(f"--{name}", required=True)
        for name, default in optional.items():
            p.add_argument(f"--{name.replace('_', '-')}", default=default, type=type(default) if default is not None else None)
        return p

    stage(prepare_wikitext, "output", batch_size=8192).add_argument("--inputs", nargs="+", required=True)
    stage(clean_corpus, "input", "output", min_characters=20)
    stage(deduplicate_splits, *SPLITS, "output-dir")
    stage(validate_splits, *SPLITS)
    p = stage(train_vocab, "input", "output", min_frequency=2)
    p.add_argument("--vocab-size", type=int, required=True)
    p.add_argument("--max-documents", type=int)
    p = stage(encode_corpus, "input", "vocab", "output")
    p.add_argument("--max-documents", type=int)
    p.add_argument("--packed", action="store_true", help="write the packed binary layout")
    p = stage(train_model, "train", "validation", "checkpoints", "metrics", epochs=1, batch_size=2, max_length=128, hidden_size=384, num_heads=6, intermediate_size=1536, num_layers=6, learning_rate=1e-4, seed=42, device="auto")
    p.add_argument("--max-batches", type=int)
    p.add_argument("--resume")
    stage(check_environment)
    return out


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(a)


if __name__ == "__main__":
    main()
