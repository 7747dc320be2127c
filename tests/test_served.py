"""Lists and watches: what is read, what a gap does, and which files are opened."""

import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from viewloom.functions.selectors import field_selector, label_selector
from viewloom.model import parse
from viewloom.sources import served as source
from viewloom.sources.objects import current
from viewloom.sources.served import reach, served, since_lists, unreadable, watched, with_last_list
from viewloom.streaming.maintain import Maintainer

RULES = """
rules: [{name: info, anchor: Pod, labels: {pod: {path: metadata.name}, phase: {path: status.phase}}}]
watch: {resources: [{kind: Pod, scope: Namespaced, labelSelector: 'tier in (a,b),!old', fieldSelector: status.phase!=Gone}]}
"""


def pod(name, rv, tier="a", phase="Run", ns="s", **more):
    return {"metadata": {"name": name, "namespace": ns, "uid": f"u-{ns}-{name}", "resourceVersion": str(rv), "labels": {"tier": tier} | more}, "status": {"phase": phase}}


def put(root, what, kind, ns, lines, done=True):
    place = f"{root}/{what}/kind={kind}/namespace={ns or '__HIVE_DEFAULT_PARTITION__'}"
    os.makedirs(place, exist_ok=True)
    with open(f"{place}/part-0", "w") as f:
        f.writelines((x if isinstance(x, str) else json.dumps(x, separators=(",", ":"))) + "\n" for x in lines)
    if done:
        open(f"{root}/{what}/_SUCCESS", "w").close()


def event(op, body):
    return {"type": op, "object": body}


def names(df):
    return {(r.namespace, r.name) for r in df.collect()}


def test_reach():
    assert reach([], 4) == 4
    assert reach([(5, 7), (8, 9)], 4) == 9
    assert reach([(6, 7)], 4) == 4
    assert reach([(2, 9), (3, 5), (12, 13)], 4) == 9


def test_a_list_and_what_follows(spark, tmp_path):
    config = parse(RULES)
    assert served(spark, str(tmp_path), config).count() == 0
    put(tmp_path, "lists/5", "Pod", "s", [pod("a", 1), pod("b", 2, tier="z"), pod("c", 3, old="y"), pod("d", 4, phase="Gone"), "", pod("e", 5)])
    put(tmp_path, "lists/5", "Pod", "", [pod("none", 2, ns="")])
    put(tmp_path, "lists/5", "Node", "", [pod("n", 2, ns="")])
    put(tmp_path, "lists/9", "Pod", "s", [], done=False)
    put(tmp_path, "watches/4-6", "Pod", "s", [event("DELETED", pod("a", 5)), event("MODIFIED", pod("e", 6, tier="z")), {"type": "BOOKMARK", "object": {}}])
    put(tmp_path, "watches/7-8", "Pod", "s", [json.dumps(event("ADDED", pod("f", 8))), event("DELETED", pod("gone", 7))])
    rows = served(spark, str(tmp_path), config)
    assert names(current(since_lists(rows), config)) == {("s", "a"), ("s", "f"), ("", "none")}
    assert {r.last for r in source.marks(rows).collect()} == {5}
    assert names(current(since_lists(rows.where("namespace = 's'")), config)) == {("s", "a"), ("s", "f")}
    assert rows.where("namespace = 'other'").where("name is not null").count() == 0
    assert rows.where("kind = 'Node'").count() == 0  # nobody watches nodes here


def test_what_cannot_be_read_is_told(spark, tmp_path):
    bad = ["{", "[1]", {"metadata": {"name": "x"}}, {"metadata": {"resourceVersion": "1"}}, {"metadata": {"name": "x", "resourceVersion": "v"}}, {"metadata": {"name": 3, "resourceVersion": "1"}}]
    put(tmp_path, "lists/2", "Pod", "s", [*bad, pod("a", 1)])
    put(tmp_path, "watches/3-4", "Pod", "s", [event("ODD", pod("b", 3)), event("ADDED", pod("c", 4)), {"object": pod("d", 3)}])
    rows = served(spark, str(tmp_path), parse(RULES))
    assert names(since_lists(rows)) == {("s", "a"), ("s", "c")}
    assert unreadable(rows).count() == len(bad) + 2
    keeper = Maintainer(spark, parse(RULES), f"file://{tmp_path}/views", buckets=2)
    assert keeper.apply(rows) and not keeper.apply(rows)
    assert keeper.dead().count() == len(bad) + 2 and keeper.series("info").count() == 2


def test_other_files_are_not_opened(tmp_path):
    for ns in ("s", "t"):
        put(tmp_path, "lists/3", "Pod", ns, [pod("a", 1, ns=ns)])
        put(tmp_path, "watches/4-5", "Pod", ns, [])
    put(tmp_path, "lists/3", "Deployment", "s", [])
    put(tmp_path, "watches/1-3", "Pod", "s", [])
    from pyspark.sql.datasource import EqualTo, In

    def opened(*filters):
        reader = source.Served({"path": str(tmp_path)}).reader(None)
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return sorted("/".join(p.path.removeprefix(f"{tmp_path}/").split("/")[:4]) for p in reader.partitions() if p.path)

    assert opened(EqualTo(("kind",), "Pod"), EqualTo(("namespace",), "t")) == ["lists/3/kind=Pod/namespace=t", "watches/4-5/kind=Pod/namespace=t"]
    assert opened(In(("kind",), ("Deployment", "Node"))) == ["lists/3/kind=Deployment/namespace=s"]
    assert opened(EqualTo(("kind",), "Pod"), EqualTo(("kind",), "Node")) == []


@pytest.mark.parametrize("labels, fields", [("a", ""), ("!a", ""), ("a=1", ""), ("a!=1", ""), ("a in (1,2),b", ""), ("a notin (1, 2)", ""), ("a=", ""), ("", "status.phase=Run"), ("", "status.phase!=Run"), ("", "spec.hostNetwork=true"), ("", "spec.nodeName=")])
def test_selectors_where_files_are_read_are_those_of_plans(spark, labels, fields):
    bodies = [{"metadata": {"labels": own}, "status": status, "spec": spec} for own in ({}, {"a": "1"}, {"a": "3", "b": ""}, {"a": ""}) for status in ({}, {"phase": "Run"}) for spec in ({}, {"hostNetwork": True, "nodeName": "n"})]
    df = spark.createDataFrame([(k, json.dumps(b)) for k, b in enumerate(bodies)], "k int, o string").withColumn("o", F.parse_json("o"))
    from viewloom.functions.selectors import field_terms, label_terms, object_fields, object_labels

    fits = label_selector(labels, object_labels(F.col("o"))) & field_selector(fields, "Pod", object_fields(F.col("o")))
    want = {r.k for r in df.where(fits).collect()}
    assert {k for k, b in enumerate(bodies) if source._fits(b, label_terms(labels), field_terms(fields, "Pod"))} == want


@pytest.mark.parametrize("seed", [1])
def test_a_gap_makes_a_stream_list_anew(spark, tmp_path, seed):
    """Changes of random objects, some unseen: the views equal what the server holds after each run, restarts included."""
    rng, config, root = random.Random(seed), parse(RULES), f"{tmp_path}/root"
    keeper = Maintainer(spark, config, f"file://{tmp_path}/views", buckets=2)
    now, version = {}, 0

    def change():
        nonlocal version
        version += 1
        key = (rng.choice("st"), rng.choice("abcdef"))
        op = "DELETED" if key in now and rng.random() < 0.4 else "MODIFIED" if key in now else "ADDED"
        body = pod(key[1], version, tier=rng.choice("abz"), phase=rng.choice(["Run", "Gone"]), ns=key[0])
        now.pop(key, None)
        if op != "DELETED":
            now[key] = body
        return key[0], event(op, body)

    def serve(changes, relist):
        if relist:
            shutil.rmtree(f"{root}/watches", ignore_errors=True)
            shutil.rmtree(f"{root}/lists", ignore_errors=True)
            os.makedirs(f"{root}/lists/{version}")
            for ns in "st":
                if own := [b for (n, _), b in now.items() if n == ns]:
                    put(root, f"lists/{version}", "Pod", ns, own)
            open(f"{root}/lists/{version}/_SUCCESS", "w").close()
        else:
            first = version + 1
            told = [change() for _ in range(changes)]
            for ns in "st":
                put(root, f"watches/{first}-{version}", "Pod", ns, [e for n, e in told if n == ns])

    for gap in (True, False, True):
        if gap:
            for _ in range(8):
                change()
            serve(0, True)
        serve(5, False)
        keeper.follow(watched(spark, root, config), f"{tmp_path}/checkpoint").awaitTermination()
        want = {(b["metadata"]["name"], b["status"]["phase"]) for b in now.values() if b["metadata"]["labels"]["tier"] in "ab" and b["status"]["phase"] != "Gone"}
        assert {(r.pod, r.phase) for r in keeper.series("info").collect()} == want


def test_lists_are_joined_without_moving_rows(spark):
    """Scopes with and without a namespace, the last list of each; rows of one kind are not brought to one task."""
    lists = spark.createDataFrame([("Pod", None, 3), ("Pod", "s", 5), ("Node", "", 2)], "kind string, namespace string, last long")
    rows = spark.createDataFrame([("Pod", "s"), ("Pod", "t"), ("Pod", None), ("Node", ""), ("Node", None), ("Job", "s")], "kind string, namespace string")
    got = with_last_list(rows, lists)
    assert {tuple(r) for r in got.collect()} == {("Pod", "s", 5), ("Pod", "t", 3), ("Pod", None, 3), ("Node", "", 2), ("Node", None, None), ("Job", "s", None)}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a data source in Python has no statistics
    try:
        assert "SortMergeJoin" not in with_last_list(rows, lists)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
