"""Stored layouts: one folder read for a tenant, no stored row moved by joins, hot keys spread, tables attached again."""

import uuid

import pytest
from pyspark.sql import functions as F

from jobloom.operators.clustering import stale_rows
from jobloom.operators.gates import attach_known_hash
from jobloom.operators.layout import FOLDER, Layout, stale_stored
from tests.compare import shown


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(params=[(4, 8), (16, 8)])
def buckets(spark, request):
    """No broadcast, and both fewer and more shuffle partitions than buckets."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", request.param[0])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield request.param[1]
    for k, v in before.items():
        spark.conf.set(k, v)


def rows(spark, n):
    """A third of the rows are one user's, of one source; some have no user or identity, some come twice."""
    i = F.col("id")
    kept = spark.range(n).select(
        F.when(i % 29 == 0, None).when(i % 3 == 0, 1).otherwise(i % 50).alias("user_id"), F.when(i % 3 == 0, "hot").otherwise((i % 7).cast("string")).alias("source_id"),
        F.when(i % 31 != 0, (i - i % 5).cast("string")).alias("identity"), i.alias("n"),
    )
    return kept


def test_a_tenant_reads_one_folder(spark, tmp_path):
    layout = Layout(("source_id", "identity"), 8, "user_id", 16)
    source = rows(spark, 3000)
    stored = layout.write(source, str(tmp_path / "t"))
    for user in (1, 7, 49, 9999):
        own = layout.scoped(stored, user)
        text = plan(own)
        assert f"PartitionFilters: [isnotnull({FOLDER}" in text and "Exchange" not in text
        assert len({f.rsplit("/", 2)[1] for f in own.inputFiles()}) <= 1
        assert shown(own.toPandas()) == shown(source.filter(F.col("user_id") == user).toPandas())
    assert len({f.rsplit("/", 2)[1] for f in stored.inputFiles()}) > 10
    assert layout.scoped(stored, None).count() == 0
    assert shown(stored.drop(FOLDER).toPandas()) == shown(source.toPandas())
    # a file a folder and bucket at most
    files = [f.rsplit("/", 1) for f in stored.inputFiles()]
    assert len({(a, b.rsplit("_", 1)[1]) for a, b in files}) == len(files)


def test_a_hot_source_fills_all_buckets(spark, tmp_path):
    stored = Layout(("source_id", "identity"), 8).write(rows(spark, 6000).filter("identity IS NOT NULL"), str(tmp_path / "t"))
    sizes = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8


def test_batch_joins_stored_rows_in_place(spark, tmp_path, buckets):
    source = rows(spark, 2000).filter("identity IS NOT NULL").groupBy("source_id", "identity").agg(F.max("n").cast("string").alias("hash"))
    stored = Layout(("source_id", "identity"), buckets).write(source, str(tmp_path / "t"))
    batch = rows(spark, 900).select("source_id", "identity")
    got = attach_known_hash(batch, stored, ["source_id", "identity"])
    assert plan(got).count("Exchange") == 1  # the batch
    assert shown(got.toPandas()) == shown(attach_known_hash(batch, source, ["source_id", "identity"]).toPandas())


def test_stale_rows_meet_in_place(spark, tmp_path, buckets):
    layout, keys = Layout(("source_id", "identity"), buckets), ["source_id", "identity"]
    held, survivors = rows(spark, 2000), rows(spark, 1200).filter("n % 4 = 0")
    complete = spark.createDataFrame([("hot",), ("2",), ("hot",), (None,)], "source_id string")
    here, there = layout.write(held, str(tmp_path / "h")), layout.write(survivors, str(tmp_path / "s"))
    gone = here.join(there.select(*keys), keys, "left_anti")
    assert "Exchange" not in plan(gone) and "Exchange" not in plan(here.select(*keys).distinct().join(there.select(*keys), keys, "left_anti"))
    want = stale_rows(held, survivors, complete, keys, "source_id").select(*held.columns)
    assert shown(stale_stored(here, there, complete, keys, "source_id").select(*held.columns).toPandas()) == shown(want.toPandas())


def test_attached_again_in_another_session(spark, tmp_path, buckets):
    layout, source = Layout(("source_id", "identity"), buckets, "user_id", 4), rows(spark, 500)
    layout.write(source, str(tmp_path / "t"), f"a_{uuid.uuid4().hex}")
    again = layout.attach(spark, f"b_{uuid.uuid4().hex}", f"file://{tmp_path}/t", "user_id bigint, source_id string, identity string, n bigint")
    assert shown(again.drop(FOLDER).toPandas()) == shown(source.toPandas())
    assert "Exchange" not in plan(again.groupBy("source_id", "identity").count())
    assert layout.scoped(again, 7).count() == source.filter("user_id = 7").count()


def test_empty_and_clashing(spark, tmp_path):
    layout = Layout(("source_id", "identity"), 8, "user_id", 4)
    stored = layout.write(rows(spark, 0), str(tmp_path / "t"))
    assert stored.count() == 0 and layout.scoped(stored, 1).count() == 0
    with pytest.raises(ValueError, match=FOLDER):
        layout.write(rows(spark, 5).withColumn(FOLDER, F.lit(1)), str(tmp_path / "u"))
