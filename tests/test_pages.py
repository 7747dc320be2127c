"""Pages of metrics text: many tasks, one commit, order by metric, nothing left of what failed."""

import os
import random

import pytest
from pyspark.sql import functions as F

from viewloom.sinks.pages import KEPT, Pages, page_options, page_text, read_page, write_pages

METRICS = [("b_info", "B's\nhelp."), ("a_info", "A's."), ("empty", "Nothing.")]


@pytest.fixture(autouse=True)
def many_tasks(spark):
    """Small partitions stay apart, so that a page has files of several tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(spark, n, metrics=("a_info", "b_info")):
    made = [(m, f'{m}{{n="{k}"}} 1') for m in metrics for k in range(n)] * 2
    random.Random(n).shuffle(made)
    return spark.createDataFrame([*made, ("a_info", None)], "metric string, line string").repartition(5)


def want(n):
    lines = lambda m: sorted(f'{m}{{n="{k}"}} 1' for k in range(n))
    return ["# HELP b_info B's\\nhelp.", "# TYPE b_info gauge", *lines("b_info"), "# HELP a_info A's.", "# TYPE a_info gauge", *lines("a_info"), "# HELP empty Nothing.", "# TYPE empty gauge"]


def folders(path):
    return set(os.listdir(f"{path}/runs")) if os.path.isdir(f"{path}/runs") else set()


def used(path):
    return {f.split("/")[1] for n in Pages(path).numbers() for own in Pages(path).page(n) for f in own["files"]}


def test_pages_in_order_of_metrics(spark, tmp_path):
    path = str(tmp_path)
    assert list(page_text(path)) == [] and read_page(spark, path).count() == 0
    for n in (50, 0, 7, 200):
        write_pages(rows(spark, n), path, METRICS)
        assert list(page_text(path)) == want(n)
        assert {tuple(r) for r in read_page(spark, path).collect()} == {tuple(r) for r in rows(spark, n).where("line is not null").collect()}
        assert len(Pages(path).numbers()) <= KEPT and folders(path) == used(path)
    assert max(len(own["files"]) for own in Pages(path).page()) > 1  # many tasks
    assert list(page_text(path, Pages(path).numbers()[0])) == want(7)


@pytest.mark.parametrize("bad", [("other", "x 1"), ("a_info", "x\n1")])
def test_a_failed_run_leaves_nothing(spark, tmp_path, bad):
    path = str(tmp_path)
    write_pages(rows(spark, 9), path, METRICS)
    before = folders(path), Pages(path).numbers()
    with pytest.raises(Exception, match="not registered|line break"):
        write_pages(rows(spark, 300).unionByName(spark.createDataFrame([bad], "metric string, line string")), path, METRICS)
    assert (folders(path), Pages(path).numbers()) == before
    assert list(page_text(path)) == want(9)


def test_a_stream_of_pages(spark, tmp_path):
    """Each batch of a counted stream is a page; a restart goes on with the next."""
    path, source = str(tmp_path / "pages"), f"{tmp_path}/in"
    for n in (3, 5):
        spark.createDataFrame([(f"k{k}",) for k in range(n)], "k string").write.mode("append").parquet(source)
        counts = spark.readStream.schema("k string").parquet(source).groupBy("k").count()
        lines = counts.select(F.lit("a_info").alias("metric"), F.concat(F.lit('a_info{k="'), "k", F.lit('"} '), F.col("count").cast("string")).alias("line"))
        lines.writeStream.format("pages").options(**page_options(spark, path, METRICS)).option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        assert folders(path) == used(path)
    assert {r.line for r in read_page(spark, path).collect()} == {f'a_info{{k="k{k}"}} {2 if k < 3 else 1}' for k in range(5)}
    first = Pages(path).numbers()[0]
    assert {r.line for r in read_page(spark, path, first).collect()} == {f'a_info{{k="k{k}"}} 1' for k in range(3)}
