"""Families of metrics text: TYPE lines over lines, blocks and files; histograms and summaries from their samples."""

import math
import random

import pytest
from pyspark.sql import functions as F

from viewloom.operators import measures
from viewloom.plans import catalogue
from viewloom.sinks.series import header
from viewloom.sources.families import families, histogram_lines, histograms, summaries, text_lines

TEXT = """# HELP early no type yet
early_count 1
# TYPE h histogram
h_bucket{le="1",x="a\\"b"} 2 77
h_bucket{le="+Inf",x="a\\"b"} 3 77
h_sum{x="a\\"b"} 4.5 77
h_count{x="a\\"b"} 3 77
h_bucket{le="1",x="c"} 5
h_bucket{le="+Inf",x="c"} 4
h_count{x="c"} 4
h_max 9

# just a comment
#TYPE nothing gauge
# TYPE s summary
s{quantile="0.5"} 1
s{quantile="0.9"} NaN
s_sum 10
s_count 4
s_bucket{le="1"} 1
# TYPE g gauge
g{a="1"} -Inf
g_count 2
not a sample line at all
# TYPE empty histogram
"""


def test_families_of_a_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TEXT)
    (tmp_path / "b.txt").write_text("h_count 8\n")  # another file begins without a type
    (tmp_path / "c.txt").write_text("")
    rows = families(text_lines(spark, str(tmp_path))).cache()
    got = {(r.family, r.type, r.metric) for r in rows.collect()}
    assert got == {("early_count", "untyped", "early_count"), ("h", "histogram", "h_bucket"), ("h", "histogram", "h_sum"), ("h", "histogram", "h_count"), ("h_max", "untyped", "h_max"), ("s", "summary", "s"), ("s", "summary", "s_sum"), ("s", "summary", "s_count"), ("s_bucket", "untyped", "s_bucket"), ("g", "gauge", "g"), ("g_count", "untyped", "g_count"), ("h_count", "untyped", "h_count")}
    made = {r.labels["x"]: r for r in histograms(rows).collect()}
    assert [tuple(c) for c in made['a"b'].cells] == [(1.0, 2.0), (math.inf, 3.0)] and made['a"b'].whole
    assert (made['a"b']["sum"], made['a"b']["count"], made['a"b'].time) == (4.5, 3.0, 77)
    assert not made["c"].whole and made["c"].sum is None
    (s,) = summaries(rows).collect()
    assert s.labels == {} and s["sum"] == 10 and s["count"] == 4 and s.cells[0]["n"] == 1 and math.isnan(s.cells[1]["n"])


@pytest.mark.parametrize("size", [64, 300, 1 << 20])
def test_types_are_carried_over_blocks(spark, tmp_path, size):
    """Files of random families against a plain reading, line by line, whatever the size of blocks."""
    rng, want = random.Random(size), []
    for f in range(3):
        lines, now = [], None
        for k in range(rng.randrange(60, 150)):
            if rng.random() < 0.06:
                now = f"m{rng.randrange(4)}"
                lines.append(f"# TYPE {now} gauge")
            name = f"m{rng.randrange(4)}" if now is None or rng.random() < 0.3 else now
            lines.append(f'{name}{{f="{f}",k="{k}"}} {k}')
            want.append((str(f), str(k), "gauge" if name == now else "untyped"))
        (tmp_path / f"f{f}.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        lines = text_lines(spark, str(tmp_path))
        assert size > 300 or lines.select("file", "block").distinct().count() > 6
        got = [(r.labels["f"], r.labels["k"], r.type) for r in families(lines).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == sorted(want)


def test_a_histogram_comes_back(spark, tmp_path):
    events = spark.createDataFrame([(f"a\\{k % 3}\n", k / 8) for k in range(200)], "who string, v double")
    cells, sums = measures.histogram(events, ["who"], "v", (0.5, 3.0, 20.0)), measures.totals(events, ["who"], "v")
    lines = [r.line for r in histogram_lines(cells, sums, "d", ["who"]).collect()]
    (tmp_path / "p.txt").write_text("\n".join([*header("d", "x")[:1], "# TYPE d histogram", *lines]))
    got = histograms(families(text_lines(spark, str(tmp_path))))
    assert got.where("whole").count() == 3
    assert {(r.who, r.at, r.n) for r in got.select(F.col("labels")["who"].alias("who"), F.inline("cells")).collect()} == {(r.who, math.inf if r.le == "+Inf" else float(r.le), r.n) for r in cells.collect()}
    assert {(r.labels["who"], r["sum"], r["count"]) for r in got.collect()} == {(r.who, r.total, r.n) for r in sums.collect()}
    assert families(text_lines(spark, str(tmp_path)).limit(0)).count() == 0


def test_files_are_cut_into_blocks_once(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TEXT)
    assert "FileScan text" not in families(text_lines(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()


def test_pages_of_the_query_stay_whole(spark, tmp_path):
    """Parts without a key, and a session that cuts files after some rows: no histogram loses its TYPE line."""
    rows = [(None if k % 7 == 0 else k % 7, float(k % 30)) for k in range(200)]
    spark.createDataFrame(rows, "l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 5)
    try:
        got = catalogue.queries()["metric_families"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    own = {p: [q for part, q in rows if part == p] for p, _ in rows}
    want = [(None if p is None else str(p), b, float(sum(q <= b for q in qs)), sum(qs), float(len(qs))) for p, qs in own.items() for b in (5.0, 10.0, 25.0, math.inf)]
    assert sorted(((r.part, r.bound, r.n, r["sum"], r["count"]) for r in got), key=repr) == sorted(want, key=repr)
