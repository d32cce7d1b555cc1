import datetime

import pytest

from corpusloom.operators.clean import clean_documents, parse_records
from corpusloom.plans import lineage
from corpusloom.sources import io
from corpusloom.streaming.ingest import settle, start_cleaning


def test_nothing_is_lost(spark, tmp_path):
    """Rows of null time and rows behind the watermark come back with ``settle``: the ids of a batch run."""
    day = lambda n: datetime.datetime(2024, 1, n)
    text = lambda s: '{"text": "' + s + ' is a document of some length."}'
    batches = [
        [(1, text("First"), day(20)), (2, text("Untimed"), None), (3, "broken", None)],
        [(4, text("Early"), day(1)), (5, text("First"), day(20)), (6, text("Second"), day(21)), (7, text("Untimed"), None)],
        [(8, text("Early"), day(2)), (9, text("Earlier"), day(3)), (10, text("Second"), day(22))],
    ]
    schema = "line_number bigint, value string, received_at timestamp"
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        start_cleaning(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), aside=str(tmp_path / "aside")).awaitTermination()
    got = settle(spark.read.parquet(str(tmp_path / "out")), spark.read.parquet(str(tmp_path / "aside")))
    whole = clean_documents(parse_records(spark.createDataFrame([r for b in batches for r in b], schema)))
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in whole.collect())


def test_files_of_all_paths_in_order(spark, tmp_path):
    spark.range(100).selectExpr("'b' || id as text").repartition(4).write.parquet(str(tmp_path / "b c"))
    spark.range(7).selectExpr("'a' || id as text", "id as other").coalesce(1).write.parquet(str(tmp_path / "a"))
    df = io.read_texts(spark, [str(tmp_path / "b c"), str(tmp_path / "a")])
    rows = df.orderBy("shard", "row_index").collect()
    assert [r.text for r in rows if r.shard == 1] == [f"a{i}" for i in range(7)] and len(rows) == 107
    assert len({(r.shard, r.row_index) for r in rows}) == 107 and {r.text[0] for r in rows if r.shard == 0} == {"b"}
    with pytest.raises(ValueError, match="twice"):
        io.read_texts(spark, [str(tmp_path / "a"), str(tmp_path / "a")])


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.ensure_checkpoint_dir(Session())
