"""Training sequences, padded batches and dynamic masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.encode import CLS_ID, SEP_ID
from corpusloom.operators.positions import running_totals
from corpusloom.plans.lineage import cut as kept_once

PAD_ID, MASK_ID, IGNORE = 0, 4, -100
LONGS = "array<bigint>"


def training_sequences(documents: DataFrame, max_length: int, *, major: str | None = None, index: str = "doc_index", ids: str = "token_ids") -> DataFrame:
    """(seq_index, doc_index, chunk, input_ids): ``[CLS]`` ... ``[SEP]`` of at most ``max_length``.

    Documents are cut into chunks of max_length - 2; no chunk crosses documents.
    ``seq_index`` is dense in the order (major, index, chunk).  Null or empty ids
    give no sequence.
    """
    if max_length < 3:
        raise ValueError("max_length must be at least 3")
    body = max_length - 2
    own = F.col(major) if major else F.lit(0)
    rows = documents.filter(F.size(ids) > 0).select(own.alias("major"), F.col(index).alias("doc_index"), F.col(ids).cast(LONGS).alias("ids"))
    rows = kept_once(rows)
    starts = F.sequence(F.lit(0), F.size("ids") - 1, F.lit(body))
    cut = rows.select("major", "doc_index", "ids", F.posexplode(starts).alias("chunk", "start"))
    wrap = lambda i: F.array(F.lit(i)).cast(LONGS)
    out = cut.select("major", "doc_index", "chunk", F.concat(wrap(CLS_ID), F.slice("ids", F.col("start") + 1, F.lit(body)), wrap(SEP_ID)).alias("input_ids"))
    before = rows.select("major", "doc_index", F.ceil(F.size("ids") / body).alias("__n"))
    placed = running_totals(before, "major", "doc_index", {"__first": F.col("__n")}, inclusive=False).select("major", "doc_index", "__first")
    joined = out.join(placed, ["major", "doc_index"])
    kept = ["seq_index", *(["major"] if major else []), "doc_index", "chunk", "input_ids"]
    done = joined.withColumn("seq_index", F.col("__first") + F.col("chunk")).select(*kept)
    return done.withColumnRenamed("major", major) if major else done


def padded_batches(sequences: DataFrame, batch_size: int) -> DataFrame:
    """Add ``batch_id`` and ``attention_mask``; ids and mask padded to the longest of the batch.

    An empty or null sequence is an error at the action.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    wrong = F.raise_error(F.concat(F.lit("sequence is empty: "), F.col("seq_index")))
    size = F.when(F.col("input_ids").isNull() | (F.size("input_ids") == 0), wrong).otherwise(F.size("input_ids"))
    rows = sequences.withColumn("batch_id", F.floor(F.col("seq_index") / batch_size)).withColumn("__size", size)
    rows = rows.withColumn("__max", F.max("__size").over(Window.partitionBy("batch_id")))
    fill = F.col("__max") - F.col("__size")
    pad = lambda value, times: F.array_repeat(F.lit(value).cast("bigint"), times)
    out = rows.withColumn("attention_mask", F.concat(pad(1, F.col("__size")), pad(0, fill)))
    return out.withColumn("input_ids", F.concat("input_ids", pad(PAD_ID, fill))).drop("__size", "__max")


def batch_shapes(batches: DataFrame) -> DataFrame:
    """(batch_id, batch_size, sequence_length) of padded batches."""
    return batches.groupBy("batch_id").agg(F.count("*").alias("batch_size"), F.max(F.size("input_ids")).alias("sequence_length"))


def first_batches(batches: DataFrame, n: int) -> DataFrame:
    if n < 1:
        raise ValueError("the number of batches must be at least 1")
    return batches.filter(F.col("batch_id") < n)


def hex_hashed(*parts: Column) -> Column:
    """60 random bits, as 15 digits that order like their number, from the MD5 of parts joined by bars."""
    return F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15)


def hashed(*parts: Column) -> Column:
    """``hex_hashed`` as a number: the same in any engine and partitioning."""
    return F.conv(hex_hashed(*parts), 16, 10).cast("bigint")


def mlm_mask(batches: DataFrame, vocab_size: int, *, seed: int = 42, epoch: int = 0, mask_probability: float = 0.15) -> DataFrame:
    """Add ``labels`` and mask ``input_ids``.

    Of the c candidates of a row (mask 1, no padding, ``[CLS]`` or ``[SEP]``),
    min(max(1, rint(c p)), c) are selected by the rank of a hash of seed, epoch,
    sequence and place; of these eight tenths become ``[MASK]``, one tenth a
    random token and one tenth stay.  Labels are the old ids there, -100 elsewhere.
    Expects ``seq_index, input_ids, attention_mask``; other columns are kept.
    """
    if vocab_size <= MASK_ID + 1:
        raise ValueError(f"vocab_size must be greater than {MASK_ID + 1}")
    if not 0.0 < mask_probability <= 1.0:
        raise ValueError("mask_probability must be in (0, 1]")
    wrong = F.raise_error(F.concat(F.lit("attention_mask must have the shape of input_ids in sequence "), F.col("seq_index")))
    ids = F.when(F.size("input_ids") != F.size("attention_mask"), wrong).otherwise(F.col("input_ids"))
    rows = batches.withColumn("input_ids", ids)
    draw = lambda place, kind: hashed(F.lit(seed), F.lit(epoch), F.col("seq_index"), place, F.lit(kind))
    is_candidate = lambda old, i: (F.get("attention_mask", i) == 1) & ~old.isin(PAD_ID, CLS_ID, SEP_ID)
    drawn = F.transform("input_ids", lambda old, i: F.when(is_candidate(old, i), F.struct(hex_hashed(F.lit(seed), F.lit(epoch), F.col("seq_index"), i, F.lit("pick")).alias("h"), i.alias("i"))))
    rows = rows.withColumn("__drawn", drawn)
    ranked = F.array_sort(F.filter("__drawn", lambda s: s.isNotNull()))
    count = F.size("__ranked")
    n = F.least(F.greatest(F.lit(1), F.rint(count * F.lit(mask_probability)).cast("int")), count)
    # the last selected rank: a place is selected when its own is no larger
    rows = rows.withColumn("__ranked", ranked).withColumn("__edge", F.get("__ranked", n - 1))
    picked = lambda i: F.coalesce(F.get("__drawn", i) <= F.col("__edge"), F.lit(False))
    bits = F.lit(float(1 << 60))

    def masked(old: Column, i: Column) -> Column:
        u = draw(i, "kind").cast("double") / bits
        other = F.lit(MASK_ID + 1) + F.pmod(draw(i, "token"), F.lit(vocab_size - MASK_ID - 1))
        new = F.when(u < 0.8, F.lit(MASK_ID)).when(u < 0.9, other).otherwise(old)
        return F.when(picked(i), new).otherwise(old).cast("bigint")

    label = F.transform("input_ids", lambda old, i: F.when(picked(i), old).otherwise(F.lit(IGNORE)).cast("bigint"))
    out = rows.withColumn("labels", label).withColumn("input_ids", F.transform("input_ids", masked))
    return out.drop("__drawn", "__ranked", "__edge")


def label_counts(masked: DataFrame) -> DataFrame:
    """(seq_index, selected): how many places of every row have a label."""
    return masked.select("seq_index", F.size(F.filter("labels", lambda x: x != IGNORE)).alias("selected"))

