"""Cleaning raw JSON lines as they arrive: the batch operators over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import document_id, normalize_document
from corpusloom.operators.clean import MIN_CHARACTERS, parse_records

SCHEMA = "line_number bigint, value string, received_at timestamp"


def cleaned_stream(lines: DataFrame, *, min_characters: int = MIN_CHARACTERS, delay: str = "7 days") -> DataFrame:
    """(received_at, line_number, id, text) of new documents.

    Of documents with one id that arrive within ``delay`` of one another the
    first is kept; the watermark bounds what the state must remember.  Rows of
    null time could never leave the state; they and rows behind the watermark
    are what ``start_cleaning`` sets aside and ``settle`` adds.
    """
    if min_characters < 1:
        raise ValueError("min_characters must be at least 1")
    rows = parse_records(lines.filter("received_at is not null")).filter("kind = 'text'")
    rows = rows.select("received_at", "line_number", normalize_document("text").alias("text")).filter(F.length("text") >= min_characters)
    return rows.withColumn("id", document_id("text")).withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["id"]).select("received_at", "line_number", "id", "text")


def start_cleaning(spark: SparkSession, source: str, target: str, state: str, *, aside: str | None = None, **options) -> StreamingQuery:
    """Clean what lies in a folder of Parquet files of raw lines now, exactly once over restarts.

    With ``aside`` every batch also writes the kept documents that the stream
    cannot settle to that folder: those of null time, and those older than what
    the watermark may have passed (the latest time seen before the batch less
    the delay).  ``settle`` merges them, so no document is lost.
    """
    lines = spark.readStream.schema(SCHEMA).parquet(source)
    if aside is not None:
        _set_aside(spark, lines, aside, f"{state}-aside", **options)
    out = cleaned_stream(lines, **options).writeStream.format("parquet").outputMode("append")
    return out.option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start()


def _set_aside(spark: SparkSession, lines: DataFrame, aside: str, state: str, *, min_characters: int = MIN_CHARACTERS, delay: str = "7 days") -> None:
    """Write documents of null time and late ones to ``aside``; a batch that runs again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        seen = batch.sparkSession.read.schema("number bigint, latest timestamp").parquet(f"{aside}-times").filter(F.col("number") < number).agg(F.max("latest").alias("latest")).first()["latest"] if number else None
        latest = batch.agg(F.max("received_at").alias("latest")).select(F.lit(number).cast("bigint").alias("number"), "latest")
        latest.write.mode("overwrite").parquet(f"{aside}-times/at={number}")
        late = F.col("received_at").isNull()
        if seen is not None:
            late = late | (F.col("received_at") <= F.lit(seen) - F.expr(f"interval {delay}"))
        rows = parse_records(batch.filter(late)).filter("kind = 'text'").select("received_at", "line_number", normalize_document("text").alias("text"))
        rows.filter(F.length("text") >= min_characters).withColumn("id", document_id("text")).select("received_at", "line_number", "id", "text").write.mode("overwrite").parquet(f"{aside}/at={number}")

    lines.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def settle(settled: DataFrame, aside: DataFrame) -> DataFrame:
    """(received_at, line_number, id, text): documents of the stream and those set aside, each id once, the smallest line first."""
    columns = ["received_at", "line_number", "id", "text"]
    rows = settled.select(*columns).unionByName(aside.select(*columns))
    return rows.groupBy("id").agg(F.min_by(F.struct(*columns), F.struct("line_number", "received_at")).alias("r")).select("r.*")
