"""Queries of the training-data operators over the project's tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.scan import table

from . import folddup, language, leakage, markup, mixing, neardup, packing, pieces, quality
from .arrow import bounded


FIXED = ("vocabulary", "source_targets", "common_words")


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet") if name in FIXED else table(spark, sf, name)


def p1_stats(spark: SparkSession, sf: str) -> DataFrame:
    words = [r["word"] for r in bounded(_read(spark, sf, "common_words").filter("word is not null"), language.MAX_FREQUENT)]
    return quality.statistics(_read(spark, sf, "clean_corpus"), "pos", "text", words)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return quality.not_prose(p1_stats(spark, sf), "pos")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "clean_corpus")
    return markup.found(rows, "pos", "text", markup.fit_costs(rows, "pos", "text"))


def p2_clean(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "clean_corpus")
    return markup.cleaned(rows, "pos", "text", markup.fit_costs(rows, "pos", "text"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    found = leakage.cross_split_pairs(_read(spark, sf, "clean_corpus"), "pos", "text", "split", ngram=3, threshold=Fraction(3, 5))
    return found.select(F.least("train", "eval").alias("pos_a"), F.greatest("train", "eval").alias("pos_b"))


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per split and source: records, records found in train, pairs, copies."""
    rows = _read(spark, sf, "clean_corpus")
    found = leakage.cross_split_pairs(rows, "pos", "text", "split", ngram=3, threshold=Fraction(3, 5))
    per = found.groupBy(F.col("eval").alias("pos")).agg(F.count("*").alias("pairs"), F.sum("copy").alias("copies"))
    joined = rows.filter("split <> 'train'").select("pos", "split", "source").join(per, "pos", "left")
    return joined.groupBy("split", "source").agg(F.count("*").alias("records"), F.count("pairs").alias("leaked"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("copies"), F.lit(0)).alias("copies"))


def p3_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.coverage(_read(spark, sf, "clean_corpus"), "pos", "text", "split", ngram=3, threshold=Fraction(3, 5))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    texts = pieces.oversized(p4_text_pieces(spark, sf), "pos")
    tokens = pieces.oversized(p4_token_pieces(spark, sf), "pos")
    name = lambda d, n: d.select(F.lit(n).alias("table_name"), "pos")
    return name(texts, "clean_corpus").unionByName(name(tokens, "token_store"))


def p4_text_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.text_pieces(_read(spark, sf, "clean_corpus"), "pos", "text")


def p4_token_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.token_pieces(_read(spark, sf, "token_store"), _read(spark, sf, "vocabulary"))


def p4_rejoined(spark: SparkSession, sf: str) -> DataFrame:
    """(pos, id, fits): the hash of a text's pieces joined without their overlaps, and whether all keep limit and overlap."""
    return pieces.rejoined(p4_text_pieces(spark, sf), "pos")


def p4_token_cover(spark: SparkSession, sf: str) -> DataFrame:
    """(store, doc_index, pos, tokens, fits): tokens of a document's pieces without their overlaps."""
    return pieces.token_cover(p4_token_pieces(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    texts = folddup.text_copies(_read(spark, sf, "clean_corpus"), "pos", "text")
    records = folddup.record_copies(_read(spark, sf, "raw_records"), "line_number", "value", max_depth=None)
    name = lambda d, n: d.select(F.lit(n).alias("table_name"), "first_no", "copy_no")
    return name(texts, "clean_corpus").unionByName(name(records, "raw_records"))


def p5_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return folddup.collapsed(_read(spark, sf, "clean_corpus"), "pos", "text")


def p5_collapsed_records(spark: SparkSession, sf: str) -> DataFrame:
    return folddup.collapsed_records(_read(spark, sf, "raw_records"), "line_number", "value", max_depth=None)


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.grouped(_read(spark, sf, "clean_corpus"), "pos", "text")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.found_pairs(_read(spark, sf, "clean_corpus"), "pos", "text")


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(_read(spark, sf, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_containers(spark, sf).filter("pieces > 1 and piece = 0").select("doc_id")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.report(p7_containers(spark, sf))


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """One row: what is packed, and counts of overfull containers, overlapping and misplaced pieces."""
    return packing.checks(p7_containers(spark, sf))


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixed(_read(spark, sf, "documents"), _read(spark, sf, "source_targets"), "doc_id", "text", "source", fill=True)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.used_up(_mixed(spark, sf)[1])


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1]


def _language_model(spark: SparkSession, sf: str) -> language.Model:
    return language.fit_from(_read(spark, sf, "documents"), "doc_id", "text", "lang", _read(spark, sf, "common_words"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return language.wrong_or_mixed(_read(spark, sf, "documents"), "doc_id", "text", "lang", _language_model(spark, sf))


def p9_documents(spark: SparkSession, sf: str) -> DataFrame:
    return language.documents(_read(spark, sf, "documents"), "doc_id", "text", _language_model(spark, sf))


def p9_segments(spark: SparkSession, sf: str) -> DataFrame:
    return language.segments(_read(spark, sf, "documents"), "doc_id", "text", _language_model(spark, sf))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_stats": p1_stats,
        "p2_found": p2_found,
        "p2_clean": p2_clean,
        "p3_found": p3_found,
        "p3_report": p3_report,
        "p3_coverage": p3_coverage,
        "p4_found": p4_found,
        "p4_text_pieces": p4_text_pieces,
        "p4_token_pieces": p4_token_pieces,
        "p4_rejoined": p4_rejoined,
        "p4_token_cover": p4_token_cover,
        "p5_found": p5_found,
        "p5_collapsed": p5_collapsed,
        "p5_collapsed_records": p5_collapsed_records,
        "p6_found": p6_found,
        "p6_groups": p6_groups,
        "p7_found": p7_found,
        "p7_containers": p7_containers,
        "p7_report": p7_report,
        "p7_checks": p7_checks,
        "p8_found": p8_found,
        "p8_mix": p8_mix,
        "p8_shares": p8_shares,
        "p9_found": p9_found,
        "p9_documents": p9_documents,
        "p9_segments": p9_segments,
    }
