"""Grouping the lines of raw shards into documents at title lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip_blanks
from corpusloom.operators.positions import BLOCK, running_totals
from corpusloom.plans.lineage import cut


def article_title(line: Column | str) -> Column:
    """The title a line states as ``= title =``; null for other lines, section lines included."""
    own = strip_blanks(F.col(line) if isinstance(line, str) else line)
    title = F.regexp_extract(own, r"\A= ([^\n]+) =\z", 1)
    return F.when(~own.startswith("= =") & (title != ""), title)


def line_documents(lines: DataFrame, *, strict: bool = True, block: int = BLOCK) -> DataFrame:
    """(doc_no, text) from (shard, row_index, line).

    A title begins a document; its lines are stripped and joined by spaces, the
    title standing for its line.  Lines before the first title are a document of
    their own, blank lines vanish and groups without text give nothing.
    Repeated rows of one (shard, row_index) count once.  A null line is an error
    where ``strict`` holds, else it vanishes like a blank one.
    """
    line = F.col("line")
    if strict:
        line = F.when(line.isNull(), F.raise_error(F.concat(F.lit("line must be a string at row "), F.col("row_index")))).otherwise(line)
    once = lines.groupBy("shard", "row_index").agg(F.min("line").alias("line"))
    rows = once.select("shard", "row_index", strip_blanks(line).alias("own"))
    rows = cut(rows.filter("own <> ''").withColumn("title", article_title("own")))
    numbered = running_totals(rows, "shard", "row_index", {"doc_no": F.col("title").isNotNull().cast("int")}, block=block)
    part = F.struct("shard", "row_index", F.coalesce("title", "own").alias("own"))
    grouped = numbered.groupBy("doc_no").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return grouped.select("doc_no", F.array_join(F.transform("parts", lambda p: p["own"]), " ").alias("text"))
