"""The path language: what compiles, and what it finds."""

import pytest
from pyspark.sql import functions as F

from viewloom.functions.paths import Field, Index, Wildcard, compiled, item_matches, matches, parse_path, text_of
from viewloom.functions.text import number_text

OBJECT = '{"kind":"Pod","metadata":{"name":"p","annotations":{"a.b/c":"x","empty":"","it\'s":"q"}},"spec":{"containers":[{"name":"a","image":"i1"},{"name":"b","image":"i2"}],"n":3,"f":1.5,"on":true,"none":null,"list":[null,"",7]},"m":{"b":2,"a":1}}'


@pytest.mark.parametrize(
    ("path", "steps"),
    [
        ("metadata.name", [Field("metadata"), Field("name")]),
        (" {.a.b} ", [Field("a"), Field("b")]),
        ("$.a", [Field("a")]),
        ('a["x.y/z"]', [Field("a"), Field("x.y/z")]),
        ("a['k'][0][*].b", [Field("a"), Field("k"), Index(0), Wildcard(), Field("b")]),
        ("foo.", [Field("foo")]),
        ("foo[0]bar", [Field("foo"), Index(0), Field("bar")]),
        ("foo.[0]", [Field("foo"), Index(0)]),
        ("a[-1]", [Field("a"), Index(-1)]),
        ("a[0abc]", [Field("a"), Index(0)]),
        ("my-key", [Field("my-key")]),
        ("[*]", [Wildcard()]),
    ],
)
def test_paths_compile(path, steps):
    assert parse_path(path) == steps


@pytest.mark.parametrize("path", ["  ", "{}", ".", "spec..image", "spec..", "labels[", "items[x y]", "spec.7", "spec.-x", '["k]y"]', "list[?(@.n==2)]", "a/b", "a b"])
def test_paths_that_do_not_compile(path):
    with pytest.raises(ValueError):
        parse_path(path)


def _found(spark, path, text=OBJECT):
    row = spark.createDataFrame([(text,)], "t string").select(F.transform(matches(F.try_parse_json("t"), parse_path(path)), text_of).alias("x"))
    return row.first().x


def test_matches(spark):
    assert _found(spark, "spec.containers[*].image") == ["i1", "i2"]
    assert _found(spark, "spec.containers[1].name") == ["b"]
    assert _found(spark, "spec.containers[9].name") == []
    assert _found(spark, "spec.containers[-1]") == []
    assert _found(spark, "metadata.annotations['a.b/c']") == ["x"]
    assert _found(spark, 'metadata.annotations["it\'s"]') == ["q"]
    assert _found(spark, "m[*]") == ["1", "2"]
    assert _found(spark, "kind[0]") == []
    assert _found(spark, "kind.x.y") == []
    assert _found(spark, "spec.none") == []
    assert len(_found(spark, "spec.list[*]")) == 3
    assert _found(spark, "a", None) is None


def test_first_text_and_stringify(spark):
    v = F.try_parse_json("t")
    row = spark.createDataFrame([(OBJECT,)], "t string").select(*(compiled(p)(v).alias(n) for n, p in {"first": "spec.list[*]", "n": "spec.n", "f": "spec.f", "on": "spec.on", "e": "metadata.annotations.empty", "w": "spec.containers[*].name"}.items())).first()
    assert row.asDict() == {"first": "7", "n": "3", "f": "1.5", "on": "true", "e": "", "w": "a"}


def test_items_that_are_no_objects_stand_under_a_key(spark):
    df = spark.createDataFrame([('{"a":1}',), ('"s"',), ("[1,2]",)], "t string")
    got = df.select(*(F.transform(item_matches(F.try_parse_json("t"), parse_path(p)), text_of).alias(n) for n, p in {"own": "_", "a": "a", "second": "_[1]"}.items())).collect()
    assert [tuple(r) for r in got] == [([], ["1"], []), (["s"], [], []), (["[1,2]"], [], ["2"])]


def test_number_texts(spark):
    cases = {3.0: "3", 1.5: "1.5", 1e6: "1e+06", 1234567.0: "1.234567e+06", 123456789.0: "1.23456789e+08", 0.001: "0.001", 0.00015: "0.00015", 0.000015: "1.5e-05", -2.5: "-2.5", 0.0: "0", 1e100: "1e+100", 100000.0: "100000", -3000000.0: "-3e+06"}
    got = spark.createDataFrame([(x,) for x in cases], "x double").select("x", number_text(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in got} == cases
