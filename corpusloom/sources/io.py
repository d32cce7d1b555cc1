"""Scans and sinks: text Parquet, JSON lines, vocabularies, metrics and checkpoints."""

from __future__ import annotations

import json
import os
import pickle
import re
import tempfile
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions.text import SPECIAL_TOKENS
from corpusloom.operators.clean import parse_records, require_objects
from corpusloom.operators.positions import dense_index


def read_texts(spark: SparkSession, paths: str | Sequence[str], *, batch_size: int = 8192) -> DataFrame:
    """(shard, row_index, text) of Parquet files in the order given; only ``text`` is read.

    A missing or non-string column is an error at once, a null value one at the
    action, naming its row.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("at least one path is required")
    for path in paths:
        # schemas come from the footers; the rows of all paths are one scan
        schema = spark.read.parquet(path).schema
        if "text" not in schema.fieldNames():
            raise ValueError(f"{path} has no text column")
        if not isinstance(schema["text"].dataType, StringType):
            raise ValueError(f"{path}: text must be a string column")
    rows = spark.read.schema("text string").option("spark.sql.parquet.columnarReaderBatchSize", batch_size).parquet(*paths)
    rows = rows.select("text", F.col("_metadata.row_index").alias("__row"), F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("__file"))
    placed = rows.join(F.broadcast(_file_order(spark, paths)), "__file", "left")
    lost = F.raise_error(F.concat(F.lit("a file was not listed: "), F.col("__file")))
    wrong = F.raise_error(F.concat(F.lit("text must be a string at row "), F.col("__row") + 1))
    shard = F.when(F.col("__shard").isNull(), lost).otherwise(F.col("__shard"))
    index = F.col("__index") * _FILE_ROWS + F.col("__row")
    return placed.select(shard.cast("int").alias("shard"), index.alias("row_index"), F.when(F.col("text").isNull(), wrong).otherwise(F.col("text")).alias("text"))


#: Rows of a file that keep the order of files of one path in ``row_index``.
_FILE_ROWS = 1 << 40


def _file_order(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(__file, __shard, __index): the path every file belongs to and its place in it; one row for every file the driver lists."""
    seen: dict[str, tuple[int, int]] = {}
    for shard, path in enumerate(paths):
        for index, name in enumerate(sorted(re.sub("^file:/+", "file:/", f) for f in spark.read.parquet(path).inputFiles())):
            if name in seen:
                raise ValueError(f"{path} is given twice")
            seen[name] = shard, index
    return spark.createDataFrame([(name, *at) for name, at in seen.items()], "__file string, __shard int, __index bigint")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_number, value) of a text file, or of a folder's files by name, numbered from 1, blank lines included."""
    block = F.concat("_metadata.file_path", F.lit(" "), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"))
    rows = spark.read.text(path).select("value", block.alias("__block"), F.monotonically_increasing_id().alias("__id"))
    first = rows.groupBy("__block").agg(F.min("__id").alias("__first"))
    placed = rows.join(first, "__block").withColumn("__row", F.col("__id") - F.col("__first"))
    return dense_index(placed, "__block", "__row", "__n").select((F.col("__n") + 1).alias("line_number"), "value")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_number, value, kind, text) of non-blank lines; broken or non-object lines are errors."""
    return require_objects(parse_records(read_lines(spark, path)))


def read_corpus_texts(spark: SparkSession, path: str) -> DataFrame:
    """(line_number, text); a record without a string ``text`` is an error naming its line."""
    rows = read_json_lines(spark, path)
    wrong = F.raise_error(F.concat(F.lit("text must be a string on line "), F.col("line_number")))
    return rows.select("line_number", F.when(F.col("kind") != "text", wrong).otherwise(F.col("text")).alias("text"))


def write_texts(df: DataFrame, path: str, *, mode: str = "overwrite") -> int:
    """Write ``text`` as JSON lines and return the number of records; null is an error."""
    seen = Observation("written")
    wrong = F.raise_error(F.lit("text must be a string"))
    rows = df.select(F.when(F.col("text").isNull(), wrong).otherwise(F.col("text")).alias("text"))
    rows.observe(seen, F.count(F.lit(1)).alias("records")).write.mode(mode).json(path)
    return seen.get["records"]


#: What a driver and every task may be asked to hold.
MAX_TOKENS = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Immutable ordered tokens; a token's id is its place."""

    tokens: tuple[str, ...]

    def __post_init__(self) -> None:
        if len(set(self.tokens)) != len(self.tokens):
            raise ValueError("vocabulary tokens must be unique")
        if self.tokens[: len(SPECIAL_TOKENS)] != SPECIAL_TOKENS:
            raise ValueError("vocabulary must begin with the special tokens")

    def __len__(self) -> int:
        return len(self.tokens)

    def __contains__(self, token: str) -> bool:
        return token in self._ids

    @property
    def _ids(self) -> dict[str, int]:
        if "ids" not in self.__dict__:
            self.__dict__["ids"] = {t: i for i, t in enumerate(self.tokens)}
        return self.__dict__["ids"]

    def token_id(self, token: str) -> int:
        """The token's id, or that of the unknown token."""
        return self._ids.get(token, 1)

    def token_for_id(self, identifier: int) -> str:
        if type(identifier) is not int:
            raise TypeError("token id must be an integer")
        if not 0 <= identifier < len(self.tokens):
            raise ValueError("token id is outside the vocabulary")
        return self.tokens[identifier]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.tokens)), "id int, token string")

    @classmethod
    def from_frame(cls, df: DataFrame) -> Vocabulary:
        """From (id, token) of at most ``MAX_TOKENS`` rows; ids must run from 0 without gaps."""
        rows = sorted((r["id"], r["token"]) for r in df.select("id", "token").limit(MAX_TOKENS + 1).collect())
        if len(rows) > MAX_TOKENS:
            raise ValueError(f"a vocabulary holds at most {MAX_TOKENS} tokens")
        if [i for i, _ in rows] != list(range(len(rows))):
            raise ValueError("vocabulary ids must be dense from 0")
        return cls(tuple(t for _, t in rows))

    def save(self, path: str | Path) -> None:
        Path(path).write_text("".join(f"{t}\n" for t in self.tokens), encoding="utf-8")

    @classmethod
    def load(cls, path: str | Path) -> Vocabulary:
        return cls(tuple(Path(path).read_text(encoding="utf-8").removesuffix("\n").split("\n")))


def append_metrics(path: str | Path, record: dict) -> None:
    """Add one JSON line to a log without reading it."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a", encoding="utf-8") as log:
        log.write(json.dumps(record, ensure_ascii=False) + "\n")


CHECKPOINT_KEYS = ("epoch", "model", "optimizer")


def save_checkpoint(directory: str | Path, epoch: int, state: dict) -> Path:
    """Write ``epoch_NNNN.ckpt`` under another name, then rename it into place."""
    target = Path(directory) / f"epoch_{epoch:04d}.ckpt"
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent)
    try:
        with os.fdopen(handle, "wb") as out:
            pickle.dump({"epoch": epoch, **state}, out)
        os.replace(name, target)
    except BaseException:
        os.unlink(name)
        raise
    return target


def load_checkpoint(path: str | Path) -> dict:
    """A checkpoint this library wrote; its keys and epoch are checked."""
    with open(path, "rb") as source:
        state = pickle.load(source)
    if not isinstance(state, dict) or any(k not in state for k in CHECKPOINT_KEYS):
        raise ValueError(f"checkpoint must have {', '.join(CHECKPOINT_KEYS)}")
    if type(state["epoch"]) is not int or state["epoch"] < 0:
        raise ValueError("checkpoint epoch must be a non-negative integer")
    return state
