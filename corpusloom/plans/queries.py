"""Queries of the core operators over the project's tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.functions.text import SPECIAL_TOKENS, basic_tokens, document_id, normalize_document
from corpusloom.operators import clean, encode, model, segment, sequences, training, vocabulary
from corpusloom.plans.scan import table
from corpusloom.plans.lineage import shared_folder
from corpusloom.sources.io import Vocabulary, read_corpus_texts, read_texts, write_texts
from corpusloom.sources.store import Store, document_offsets, length_offsets, store_checks, write_packed, write_store

MAX_LENGTH, BATCH = 128, 16
TINY = model.Shape(vocab_size=2111, max_positions=MAX_LENGTH, hidden_size=24, num_heads=3, intermediate_size=48, num_layers=1)
# A small projection used by the numeric queries.
WEIGHT = ((0.5, -0.25, 0.125, 1.0), (-1.0, 0.75, 0.5, 0.25), (0.0, 1.5, -0.5, -0.125))
BIAS = (0.1, -0.2, 0.3)
#: Weights and positions for whole embeddings: multiples of an eighth and a quarter, other ones in each row.
PLACES, HEAD = 64, 8
WHOLE_WEIGHT = tuple(tuple(((31 * i + 17 * j + i * j) % 13 - 6) / 8 for j in range(PLACES)) for i in range(HEAD))
WHOLE_BIAS = tuple((i - 3) / 4 for i in range(HEAD))
POSITIONS = tuple(tuple(((5 * i + 3 * j) % 9 - 4) / 4 for j in range(HEAD)) for i in range(PLACES // HEAD))


def _joined(ids: str):
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), " ")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "lang")


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.with_initial_pieces(vocabulary.word_counts(_documents(spark, sf), min_frequency=2))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Raw lines, each once: redelivered lines have the same number and value."""
    lines = table(spark, sf, "raw_records").groupBy("line_number").agg(F.min("value").alias("value"))
    return clean.parse_records(lines)


def _splits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "clean_corpus").select("pos", "split", "split_ord", "line_number", "id", "source")


def _store(spark: SparkSession, sf: str) -> DataFrame:
    """Stored documents, each once."""
    keys = ["store", "doc_index", "start_offset", "end_offset"]
    return table(spark, sf, "token_store").groupBy(*keys).agg(F.max("token_ids").alias("token_ids"))


def _vocabulary(spark: SparkSession, sf: str) -> Vocabulary:
    return Vocabulary.from_frame(table(spark, sf, "vocabulary"))


def basic_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", F.size(basic_tokens(F.coalesce("text", F.lit("")))).alias("n_tokens"))


def basic_token_lists(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).filter("text is not null").select("doc_id", F.array_join(basic_tokens("text", never_split=SPECIAL_TOKENS), " ").alias("tokens"))


def token_counts_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    sizes = _documents(spark, sf).select("lang", F.size(basic_tokens(F.coalesce("text", F.lit("")))).cast("bigint").alias("n"))
    return sizes.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n").alias("n_tokens"))


def normalized_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", normalize_document("text").alias("text_norm"))


def document_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", document_id("text").alias("id"))


def record_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).groupBy("kind").agg(F.count("*").alias("lines"))


def clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_documents(_records(spark, sf)).select("position", "id", "text")


def clean_statuses(spark: SparkSession, sf: str) -> DataFrame:
    return clean.classify(_records(spark, sf)).select("position", "status")


def clean_stats(spark: SparkSession, sf: str) -> DataFrame:
    return clean.cleaning_stats(clean.classify(_records(spark, sf)))


def split_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return clean.deduplicate_splits(_splits(spark, sf), strict=False).select("pos", "split", "line_number", "id")


def split_dedup_stats(spark: SparkSession, sf: str) -> DataFrame:
    return clean.split_stats(_splits(spark, sf), strict=False)


def split_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return clean.split_overlaps(_splits(spark, sf)).select("id", "split", "line_number", "first_split")


def article_titles(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "shard_lines").select("shard", "row_index", segment.article_title("line").alias("title"))
    return lines.filter("title is not null").distinct()


def line_documents(spark: SparkSession, sf: str) -> DataFrame:
    return segment.line_documents(table(spark, sf, "shard_lines"), strict=False)


def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.word_counts(_documents(spark, sf))


def top_words(spark: SparkSession, sf: str) -> DataFrame:
    return word_counts(spark, sf).orderBy(F.desc("n"), "word").limit(100)


def alphabet(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.alphabet(vocabulary.word_counts(_documents(spark, sf), min_frequency=2))


def piece_counts(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.piece_counts(_words(spark, sf))


def pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.pair_counts(_words(spark, sf))


def pair_words(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.pair_words(_words(spark, sf))


def best_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.best_pairs(_words(spark, sf), 50).select("left", "right", "n", F.round("score", 12).alias("score"))


def vocabulary_training(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.train_vocabulary(_documents(spark, sf), 2000)


def vocabulary_checks(spark: SparkSession, sf: str) -> DataFrame:
    return encode.validate_vocabulary(table(spark, sf, "vocabulary"))


def word_segments(spark: SparkSession, sf: str) -> DataFrame:
    words = vocabulary.word_counts(_documents(spark, sf))
    return encode.segment_words(words, _vocabulary(spark, sf)).select("word", F.array_join("pieces", " ").alias("pieces"))


def encoded_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = encode.encode_documents(_documents(spark, sf), _vocabulary(spark, sf), key="doc_id")
    return rows.select("doc_id", _joined("token_ids").alias("ids"))


def encoded_offsets(spark: SparkSession, sf: str) -> DataFrame:
    rows = encode.encode_documents(_documents(spark, sf), _vocabulary(spark, sf), key="doc_id")
    return length_offsets(rows.select(F.col("doc_id").alias("pos"), F.size("token_ids").alias("length")))


def _local(path: str) -> Path:
    """A shared folder as a plain path, which the packed layout needs."""
    if ":" in path.split("/", 1)[0] and not path.startswith("file:"):
        raise ValueError("packed stores need a checkpoint folder with a plain path")
    return Path(re.sub("^file:/+", "/", path))


def store_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded documents written to a Parquet store, which is opened, checked and read."""
    rows = encode.encode_documents(_documents(spark, sf), _vocabulary(spark, sf), key="doc_id")
    path = shared_folder(spark, "store")
    write_store(rows, path, _vocabulary(spark, sf), order="doc_id")
    return Store.open(spark, path).documents.select("doc_index", "start", "length", _joined("token_ids").alias("ids"))


def packed_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded documents written to a packed store by all tasks at once and read in ranges."""
    vocab = _vocabulary(spark, sf)
    rows = encode.encode_documents(_documents(spark, sf), vocab, key="doc_id")
    path = _local(shared_folder(spark, "packed"))
    path.parent.mkdir(parents=True, exist_ok=True)
    vocab.save(f"{path}.vocab")
    write_packed(rows, str(path), f"{path}.vocab", order="doc_id")
    read = spark.read.format("tokenbin").option("documentsPerPartition", 500).load(str(path))
    return read.select("doc_index", "start", "length", _joined("token_ids").alias("ids"))


def text_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """(text, n): texts read from Parquet shards, written as JSON lines and read again."""
    texts = _documents(spark, sf).filter("text is not null").select("text")
    shards = [shared_folder(spark, "texts") for _ in range(2)]
    for k, path in enumerate(shards):
        texts.filter(F.pmod(F.xxhash64("text"), F.lit(2)) == k).write.parquet(path)
    out = shared_folder(spark, "lines")
    write_texts(read_texts(spark, shards), out)
    return read_corpus_texts(spark, out).groupBy("text").agg(F.count("*").alias("n"))


def vocabulary_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """(id, token) of a vocabulary written to its file and loaded."""
    path = _local(shared_folder(spark, "vocabulary"))
    path.parent.mkdir(parents=True, exist_ok=True)
    _vocabulary(spark, sf).save(path)
    return Vocabulary.load(path).frame(spark)


def first_encoded(spark: SparkSession, sf: str) -> DataFrame:
    rows = encode.first_documents(_documents(spark, sf), 100, position="doc_id")
    kept = encode.encode_documents(rows, _vocabulary(spark, sf), key="doc_id", add_special_tokens=True)
    return kept.select("doc_id", F.size("token_ids").alias("n_ids"))


def stored_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    ids = _store(spark, sf).select(F.explode("token_ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return encode.ids_to_tokens(ids, table(spark, sf, "vocabulary")).select("token", "n")


def word_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.tokens_to_ids(word_counts(spark, sf), table(spark, sf, "vocabulary"), token="word").select("word", "id")


def stored_checks(spark: SparkSession, sf: str) -> DataFrame:
    rows = _store(spark, sf).filter("token_ids is not null")
    placed = rows.select("store", "doc_index", F.col("start_offset").alias("start"), (F.col("end_offset") - F.col("start_offset")).alias("length"), "token_ids")
    per = placed.groupBy("store").agg(F.count("*").alias("documents"), F.sum("length").alias("tokens"), F.count_if(F.size("token_ids") != F.col("length")).alias("bad_lengths"), F.count_if(F.exists("token_ids", lambda i: (i < 0) | (i >= 2111))).alias("bad_ids"))
    return per


def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.training_sequences(_store(spark, sf), MAX_LENGTH, major="store")


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.padded_batches(_sequences(spark, sf), BATCH)


def training_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return _sequences(spark, sf).select("seq_index", "store", "doc_index", "chunk", _joined("input_ids").alias("ids"))


def padded_batches(spark: SparkSession, sf: str) -> DataFrame:
    return _batches(spark, sf).select("seq_index", "batch_id", _joined("input_ids").alias("ids"), _joined("attention_mask").alias("mask"))


def batch_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.batch_shapes(_batches(spark, sf))


def mlm_masks(spark: SparkSession, sf: str) -> DataFrame:
    rows = sequences.mlm_mask(_batches(spark, sf), TINY.vocab_size)
    return rows.select("seq_index", _joined("input_ids").alias("ids"), _joined("labels").alias("labels"))


def mlm_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.label_counts(sequences.mlm_mask(_batches(spark, sf), TINY.vocab_size))


def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    masked = sequences.mlm_mask(_batches(spark, sf), TINY.vocab_size)
    return training.epoch_metrics(training.evaluate_batches(masked, model.init(TINY, 42), TINY))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", V.doubles("embedding").alias("v"), "label")


def layer_norm(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select("vec_id", F.posexplode(V.layer_norm("v")).alias("place", "x")).select("vec_id", "place", (F.round("x", 4) + 0.0).alias("x"))


def gelu(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select("vec_id", F.posexplode("v").alias("place", "x")).select("vec_id", "place", F.round(V.gelu("x"), 6).alias("y"))


def linear(spark: SparkSession, sf: str) -> DataFrame:
    four = F.slice("v", 1, 4)
    return _vectors(spark, sf).select("vec_id", F.posexplode(V.linear(four, WEIGHT, BIAS)).alias("place", "y")).select("vec_id", "place", F.round("y", 6).alias("y"))


def softmax(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select("vec_id", F.posexplode(V.softmax("v")).alias("place", "y")).select("vec_id", "place", F.round("y", 6).alias("y"))


def position_add(spark: SparkSession, sf: str) -> DataFrame:
    """Two four-place vectors of every row plus the first two rows of the projection as positions."""
    parts = F.array(F.slice("v", 1, 4), F.slice("v", 5, 4))
    places = F.array(*[F.array(*[F.lit(x) for x in row]) for row in WEIGHT[:2]])
    rows = _vectors(spark, sf).select("vec_id", F.posexplode(V.position_add(parts, places)).alias("place", "w"))
    return rows.select("vec_id", "place", F.round(V.total("w"), 6).alias("y"))


def attention(spark: SparkSession, sf: str) -> DataFrame:
    """One head over four two-place vectors of every row, the last one masked."""
    parts = F.array(*[F.slice("v", 2 * i + 1, 2) for i in range(4)])
    out = V.attention(F.get(parts, F.lit(0)), parts, parts, F.array(*[F.lit(x) for x in (1, 1, 1, 0)]))
    return _vectors(spark, sf).select("vec_id", F.posexplode(out).alias("place", "y")).select("vec_id", "place", F.round("y", 6).alias("y"))


def _heads() -> Column:
    """All places of a vector as consecutive vectors of ``HEAD`` places."""
    return F.array(*[F.slice("v", HEAD * i + 1, HEAD) for i in range(PLACES // HEAD)])


def linear_whole(spark: SparkSession, sf: str) -> DataFrame:
    """``linear`` over all places; the SQL of ``linear`` writes out the first four."""
    return _vectors(spark, sf).select("vec_id", F.posexplode(V.linear("v", WHOLE_WEIGHT, WHOLE_BIAS)).alias("place", "y")).select("vec_id", "place", F.round("y", 6).alias("y"))


def position_add_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Every place of every row, taken as eight vectors, plus its position."""
    places = F.array(*[F.array(*[F.lit(x) for x in row]) for row in POSITIONS])
    rows = _vectors(spark, sf).select("vec_id", F.posexplode(F.flatten(V.position_add(_heads(), places))).alias("place", "y"))
    return rows.select("vec_id", "place", F.round("y", 6).alias("y"))


def attention_whole(spark: SparkSession, sf: str) -> DataFrame:
    """One head over all places as eight vectors, each of them a query, the last one masked as a key."""
    mask = F.array(*[F.lit(int(i < PLACES // HEAD - 1)) for i in range(PLACES // HEAD)])
    out = V.let(_heads(), lambda parts: F.flatten(F.transform(parts, lambda q: V.attention(q, parts, parts, mask))))
    return _vectors(spark, sf).select("vec_id", F.posexplode(out).alias("place", "y")).select("vec_id", "place", (F.round("y", 6) + 0.0).alias("y"))


def mlm_loss(spark: SparkSession, sf: str) -> DataFrame:
    label = F.pmod(F.col("label"), F.size("v"))
    return _vectors(spark, sf).select("vec_id", F.round(V.token_loss("v", label), 6).alias("loss"))


def loss_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of losses grouped by label as batches."""
    label = F.pmod(F.col("label"), F.size("v"))
    rows = _vectors(spark, sf).select(F.col("label").cast("bigint").alias("batch_id"), V.token_loss("v", label).alias("l"))
    per = rows.groupBy("batch_id").agg(F.avg("l").alias("loss"), F.count("l").alias("masked"))
    return training.epoch_metrics(per).select(F.round("loss", 6).alias("loss"), "batches", "masked_positions")


def store_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of a store built from the encoded documents; all but the first two are 0."""
    rows = encode.encode_documents(_documents(spark, sf), _vocabulary(spark, sf), key="doc_id")
    return store_checks(document_offsets(rows, order="doc_id"), TINY.vocab_size)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        word_counts, top_words, basic_token_counts, basic_token_lists, token_counts_by_lang, normalized_documents, document_ids,
        record_kinds, clean_documents, clean_statuses, clean_stats, split_dedup, split_dedup_stats, split_overlaps,
        article_titles, line_documents, alphabet, piece_counts, pair_counts, pair_words, best_pairs, vocabulary_training,
        vocabulary_checks, word_segments, encoded_documents, encoded_offsets, first_encoded, stored_token_counts, word_ids, stored_checks, store_summary,
        training_sequences, padded_batches, batch_shapes, mlm_masks, mlm_label_counts, evaluation,
        layer_norm, gelu, linear, softmax, position_add, attention, mlm_loss, loss_metrics,
        linear_whole, position_add_whole, attention_whole,
        store_round_trip, packed_round_trip, text_round_trip, vocabulary_round_trip,
    ]
    return {f.__name__: f for f in own}
