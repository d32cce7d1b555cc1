"""Cleaning, exact deduplication within and across ordered splits, and the disjointness check.

Every duplicate is settled by a grouped minimum of positions, which combines on
the map side, so an id that a third of all rows share shuffles as one row a task.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusloom.functions.text import document_id, is_blank, normalize_document

MIN_CHARACTERS = 20
KEPT, DUPLICATE, SHORT, EMPTY = "kept", "duplicate", "short", "empty"
INVALID_SCHEMA, INVALID_JSON = "invalid_schema", "invalid_json"


@F.pandas_udf(StructType([StructField("kind", StringType()), StructField("text", StringType())]))
def _parsed(values: pd.Series, fields: pd.Series) -> pd.DataFrame:
    def one(value: str | None, name: str) -> tuple[str, str | None]:
        try:
            record = json.loads(value)
        except (ValueError, TypeError, RecursionError):
            return "invalid", None
        if not isinstance(record, dict):
            return "not_object", None
        text = record.get(name)
        if not isinstance(text, str):
            return "no_text", None
        return "text", text.encode("utf-8", "replace").decode("utf-8")

    return pd.DataFrame([one(v, f) for v, f in zip(values, fields)], columns=["kind", "text"])


# A filter on the kind would otherwise be pushed below and parse every line twice.
_parsed = _parsed.asNondeterministic()


def parse_records(lines: DataFrame, *, value: str = "value", field: str = "text") -> DataFrame:
    """Add ``kind`` and ``text``: blank, invalid, not_object, no_text or text.

    JSON is read by strict rules (no trailing content, no coercion of numbers;
    the last of repeated names counts), which the built-in readers do not keep.
    Null lines are blank.
    """
    blank = F.col(value).isNull() | is_blank(F.col(value))
    rows = lines.withColumn("__parsed", _parsed(F.coalesce(value, F.lit("")), F.lit(field)))
    kind = F.when(blank, "blank").otherwise(F.col("__parsed.kind"))
    return rows.withColumn("kind", kind).withColumn("text", F.when(kind == "text", F.col("__parsed.text"))).drop("__parsed")


def require_objects(parsed: DataFrame, line_number: str = "line_number") -> DataFrame:
    """Strict reading: the first broken or non-object line is an error naming it; blank lines go."""
    broken = F.col("kind").isin("invalid", "not_object")
    what = F.when(F.col("kind") == "invalid", "invalid JSON").otherwise("record must be a JSON object")
    checked = F.when(broken, F.raise_error(F.concat(what, F.lit(" on line "), F.col(line_number)))).otherwise(F.col("kind"))
    return parsed.withColumn("kind", checked).filter("kind <> 'blank'")


def classify(parsed: DataFrame, *, position: str = "line_number", min_characters: int = MIN_CHARACTERS) -> DataFrame:
    """(position, status, id, text): first match of schema, empty, short, duplicate, kept.

    A duplicate repeats the id of an earlier record among those long enough.
    """
    if min_characters < 1:
        raise ValueError("min_characters must be at least 1")
    rows = parsed.filter("kind <> 'blank'").select(F.col(position).alias("position"), "kind", normalize_document("text").alias("text"))
    status = F.when(F.col("kind").isin("invalid", "not_object"), INVALID_JSON).when(F.col("kind") != "text", INVALID_SCHEMA)
    status = status.when(F.col("text").isNull(), EMPTY).when(F.length("text") < min_characters, SHORT).otherwise(KEPT)
    rows = rows.withColumn("status", status)
    long_enough = F.col("status") == KEPT
    rows = rows.withColumn("id", F.when(long_enough, document_id("text")))
    first = rows.filter(long_enough).groupBy("id").agg(F.min("position").alias("first"))
    # rows without an id get a key of their own, else all of them would meet in one task
    keyed = rows.withColumn("__key", F.coalesce("id", F.concat(F.lit("#"), F.col("position").cast("string"))))
    joined = keyed.join(first.withColumnRenamed("id", "__key"), "__key", "left")
    final = F.when((F.col("status") == KEPT) & (F.col("position") > F.col("first")), DUPLICATE).otherwise(F.col("status"))
    return joined.select("position", final.alias("status"), "id", "text")


def clean_documents(parsed: DataFrame, *, position: str = "line_number", min_characters: int = MIN_CHARACTERS) -> DataFrame:
    """(position, id, text) of the kept documents; one aggregation, no join."""
    if min_characters < 1:
        raise ValueError("min_characters must be at least 1")
    rows = parsed.filter("kind = 'text'").select(F.col(position).alias("position"), normalize_document("text").alias("text"))
    rows = rows.filter(F.length("text") >= min_characters).withColumn("id", document_id("text"))
    return rows.groupBy("id").agg(F.min("position").alias("position"), F.first("text").alias("text")).select("position", "id", "text")


def cleaning_stats(classified: DataFrame) -> DataFrame:
    """One row of counters; ``total`` is the sum of the others."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return classified.agg(F.count("*").alias("total"), *(count(s) for s in (KEPT, INVALID_JSON, INVALID_SCHEMA, EMPTY, SHORT, DUPLICATE)))


def _check_ids(splits: DataFrame) -> DataFrame:
    wrong = F.raise_error(F.concat(F.lit("id must be a string on line "), F.col("line_number"), F.lit(" of "), F.col("split")))
    return splits.withColumn("id", F.when(F.col("id").isNull(), wrong).otherwise(F.col("id")))


def deduplicate_splits(splits: DataFrame, *, strict: bool = True) -> DataFrame:
    """Whole records, the first of every id in the order (split_ord, line_number).

    Expects ``split, split_ord, line_number, id``; all other columns are kept.
    A null id is an error where ``strict`` holds, else such rows are left out.
    """
    rows = _check_ids(splits) if strict else splits.filter("id is not null")
    record = F.struct(*splits.columns)
    return rows.groupBy(F.col("id").alias("__id")).agg(F.min_by(record, F.struct("split_ord", "line_number")).alias("r")).select("r.*")


def split_stats(splits: DataFrame, *, strict: bool = True) -> DataFrame:
    """(split, input, kept, removed) for every split."""
    splits = splits.select("split", "split_ord", "line_number", "id")
    kept = deduplicate_splits(splits, strict=strict).groupBy("split").agg(F.count("*").alias("kept"))
    rows = splits if strict else splits.filter("id is not null")
    counts = rows.groupBy("split").agg(F.count("*").alias("input")).join(kept, "split", "left").fillna(0, ["kept"])
    return counts.select("split", "input", "kept", (F.col("input") - F.col("kept")).alias("removed"))


def split_overlaps(splits: DataFrame) -> DataFrame:
    """(id, split, line_number, first_split) of every record whose id came before."""
    first = splits.filter("id is not null").groupBy("id").agg(F.min(F.struct("split_ord", "line_number", "split")).alias("first"), F.count("*").alias("n"))
    later = splits.join(first.filter("n > 1"), "id").filter(F.struct("split_ord", "line_number") > F.struct("first.split_ord", "first.line_number"))
    return later.select("id", "split", "split_ord", "line_number", F.col("first.split").alias("first_split"))


def validate_disjoint(splits: DataFrame) -> dict[str, int]:
    """Rows per split; an id that comes twice anywhere is an error naming both splits."""
    if not splits.limit(1).count():
        raise ValueError("at least one split is required")
    counts = {r["split"]: r["count"] for r in _check_ids(splits).groupBy("split").count().collect()}
    worst = split_overlaps(splits).orderBy("split_ord", "line_number").limit(1).collect()
    if worst:
        r = worst[0]
        raise ValueError(f"id {r['id']} occurs in both '{r['first_split']}' and '{r['split']}'")
    return counts
