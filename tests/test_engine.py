"""Rules over objects: ownership, labels, items; and incremental upkeep against full recomputation."""

import json
import random

import pytest
from pyspark.sql import functions as F

from viewloom.functions.selectors import field_selector, label_selector
from viewloom.model import parse
from viewloom.operators.resolve import bound, unresolved, walked
from viewloom.operators.rules import evaluated
from viewloom.plans.engine import publish, view_of_log, views, views_of_log
from viewloom.sinks.series import MemorySink, TableSink, exposition, header
from viewloom.sources.objects import LOG, current, dry_run, log_from_json, ready, samples
from viewloom.streaming.admission import _frames, admitted_stream
from viewloom.streaming.maintain import Maintainer, change_lines

RULES = """
rules:
  - name: info
    anchor: Pod
    relations: [{name: top, via: topController}]
    labels:
      pod: {path: metadata.name}
      phase: {path: status.phase, onMissing: n/a, fallbacks: [{path: status.reason}]}
      top: {source: top, path: metadata.name}
      note: {source: top, path: 'metadata.annotations["a/b"]'}
  - name: box
    anchor: Pod
    forEach: spec.containers[*]
    labels:
      pod: {path: metadata.name}
      box: {source: item, path: name}
watch:
  resources:
    - {kind: Pod, scope: Namespaced, fieldSelector: status.phase!=Gone}
    - {kind: ReplicaSet, scope: Namespaced}
    - {kind: Deployment, scope: Namespaced}
"""


def thing(kind, name, owner=None, ns="s", uid=None, **more):
    meta = {"name": name, "namespace": ns, "uid": uid or f"u-{kind}-{name}"}
    if owner:
        meta["ownerReferences"] = [{"kind": owner[0], "name": owner[1], **({} if len(owner) < 3 else {"controller": owner[2]})}]
    meta |= more.pop("meta", {})
    return {"kind": kind, "metadata": meta, **more}


def log_of(spark, rows):
    """rows: (object, op, seq) or (object, op, seq, rv)."""
    return spark.createDataFrame([(o["kind"], o["metadata"].get("namespace", ""), o["metadata"]["name"], o["metadata"]["uid"], str(r[3] if len(r) > 3 else r[2]), r[1], r[2], json.dumps(o)) for r in rows for o in [r[0]]], LOG)


def found(df):
    return {tuple(r) for r in df.drop("value").collect()}


def test_chain_shapes(spark):
    objects = [
        thing("Pod", "two", ("ReplicaSet", "rs", True)), thing("ReplicaSet", "rs", ("Deployment", "d")), thing("Deployment", "d"),
        thing("Pod", "none"), thing("Pod", "lost", ("ReplicaSet", "gone", True)), thing("Pod", "job", ("Job", "j", True)),
        thing("Pod", "set", ("StatefulSet", "st", True)), thing("StatefulSet", "st"), thing("Pod", "far", ("ReplicaSet", "rs", True), ns="other"),
        thing("Pod", "host", ("Node", "n", True)), thing("Node", "n", ns=""), thing("ReplicaSet", "loop", ("ReplicaSet", "loop", True)), thing("Pod", "cycle", ("ReplicaSet", "loop", True)),
    ]
    rows = walked(current(log_of(spark, [(o, "ADDED", 1) for o in objects])), "Pod", hops=4)
    at = bound(rows)
    name = lambda c: F.try_variant_get(c, "$.metadata.name", "string")
    got = {r.name: (r.o, r.t, r.n, r.w) for r in rows.select("name", name(at["ownerController"]).alias("o"), name(at["topController"]).alias("t"), name(at["Node"]).alias("n"), unresolved(rows)["name"].alias("w")).collect()}
    assert got == {"two": ("rs", "d", None, None), "none": (None, None, None, None), "lost": (None, None, None, "gone"), "job": (None, None, None, None), "set": ("st", "st", None, None), "far": (None, None, None, "rs"), "host": ("n", None, "n", None), "cycle": ("loop", None, None, None)}
    top = walked(current(log_of(spark, [(objects[2], "ADDED", 1)])), "Deployment", hops=1)
    assert top.select(name(bound(top)["topController"]).alias("t")).first().t == "d"


def test_labels_items_and_duplicates(spark):
    state = current(log_of(spark, [(thing("Pod", "a", spec={"containers": [{"name": "x"}, {"name": "x"}, None, "s", {"name": "y"}]}, status={"phase": "", "reason": "why"}), "ADDED", 1), (thing("Pod", "b", spec={"containers": []}), "ADDED", 1)]), parse(RULES))
    got = views(parse(RULES), state)
    assert found(got["info"].select("anchor_key", "phase", "top")) == {("s/a", "why", ""), ("s/b", "n/a", "")}
    assert found(got["box"].select("anchor_key", "box")) == {("s/a", "x"), ("s/a", ""), ("s/a", "y")}
    assert got["box"].where("anchor_key = 's/b'").isEmpty() and got["box"].count() == 3
    whole = parse("rules: [{name: r, anchor: Pod, forEach: spec.containers, labels: {x: {source: item, path: '_[0].name'}}}]")
    assert found(views(whole, state)["r"]) == {("s/a", "x"), ("s/b", "")}


def test_a_view_alone(spark, monkeypatch):
    """A rule without owners is a plan over objects of its kind, with nothing written, and finds the items of an anchor once."""
    pods = [thing("Pod", n, ("ReplicaSet", "rs", True), ns=ns, spec={"containers": c}) for n, ns, c in (("a", "s", [{"name": "x"}, {"name": "x"}, None, {"name": "y"}]), ("b", "s", []), ("c", "s", {"k": {"name": "z"}}), ("a", "", [{"name": 1.5}]))]
    log = log_of(spark, [(o, "ADDED", 1) for o in [*pods, thing("ReplicaSet", "rs")]])
    want = {m: found(views_of_log(parse(RULES), log)[m]) for m in ("info", "box")}
    assert found(view_of_log(parse(RULES), log, "info")) == want["info"]
    monkeypatch.setattr("viewloom.plans.engine.written", None)
    box = view_of_log(parse(RULES), log, "box")
    assert found(box) == want["box"] and len(want["box"]) == 5
    assert box._jdf.queryExecution().optimizedPlan().toString().count("ArrayType(VariantType") == 1


def test_latest_before_selector(spark):
    pod = lambda phase: thing("Pod", "a", status={"phase": phase})
    log = log_of(spark, [(pod("Running"), "ADDED", 1), (pod("Gone"), "MODIFIED", 2)])
    assert current(log, parse(RULES)).isEmpty()
    assert current(log_of(spark, [(pod("Gone"), "ADDED", 1), (pod("Running"), "MODIFIED", 2)]), parse(RULES)).count() == 1
    assert current(log_of(spark, [(pod("Running"), "ADDED", 1), (pod("Running"), "DELETED", 2)]), parse(RULES)).isEmpty()
    dry_run(current(log), parse(RULES))


@pytest.mark.parametrize("bad", ["a=b,,c", "a in b", "a=(b)", "in (a)x"])
def test_bad_label_selectors(bad):
    with pytest.raises(ValueError):
        label_selector(bad, F.lit)


def test_bad_field_selectors():
    for bad in ("spec.secret=1", "status.phase", "a in (b)"):
        with pytest.raises(ValueError):
            field_selector(bad, "Pod", F.lit)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s/a", 'x"\\\n', "1")], "anchor_key string, pod string, other string")
    for sink in (MemorySink(spark), TableSink(spark, f"file://{tmp_path}")):
        sink.register("m", ["pod", "gone"], "help")
        with pytest.raises(ValueError):
            sink.register("m", [])
        with pytest.raises(KeyError):
            sink.fixed("n", rows)
        sink.write("m", rows)
        assert found(sink.read("m")) == {("s/a", "", 'x"\\\n')}
        sink.replace("m", spark.createDataFrame([("s/a",), ("s/b",)], "anchor_key string"), spark.createDataFrame([("s/b", "y")], "anchor_key string, pod string"))
        assert found(sink.read("m")) == {("s/b", "", "y")}
        sink.upsert("m", spark.createDataFrame([("s/c", "z"), ("s/b", "y")], "anchor_key string, pod string"))
        assert found(sink.read("m")) == {("s/b", "", "y"), ("s/c", "", "z")}
        sink.delete("m", spark.createDataFrame([("s/b", "y")], "anchor_key string, pod string"))
        assert found(sink.read("m")) == {("s/c", "", "z")}
    lines = exposition(rows, "m", ["pod"])
    assert lines.first().line == 'm{pod="x\\"\\\\\\n"} 1'
    assert header("m", "a\nb") == ["# HELP m a\\nb", "# TYPE m gauge"]
    text = spark.createDataFrame([("# c",), ("",), ('m{a="1",b="x y"} 2.5',), ("n 3",)], "value string")
    assert {(r.metric, tuple(sorted(r.labels.items())), r.value) for r in samples(text).collect()} == {("m", (("a", "1"), ("b", "x y")), 2.5), ("n", (), 3.0)}
    odd = [r'm{a="\\n\"}\n",b="{x}"} 1 1700000000', "m 7 -5", "h_bucket{le=\"+Inf\"} +Inf", "bad{a=} 1", "x", "m{} NaN", 'm{a="1", a="2",} 4']
    got = [(r.metric, r.labels, str(r.value), r.time) for r in samples(spark.createDataFrame([(x,) for x in [*odd, None]], "value string")).collect()]
    assert got == [("m", {"a": '\\n"}\n', "b": "{x}"}, "1.0", 1700000000), ("m", {}, "7.0", -5), ("h_bucket", {"le": "+Inf"}, "inf", None), ("m", {}, "nan", None), ("m", {"a": "2"}, "4.0", None)]
    assert samples(lines, "line").first().labels["pod"] == 'x"\\\n'  # what exposition escapes comes back
    memory = MemorySink(spark)
    publish(parse(RULES), current(log_of(spark, [(thing("Pod", "a"), "ADDED", 1)]), parse(RULES)), memory)
    assert found(memory.read("info")) == {("s/a", "", "n/a", "a", "")}


def test_json_objects_and_readiness(spark):
    df = spark.createDataFrame([('{"metadata":{"name":"n"},"kind":"Node","status":{"conditions":[{"type":"Ready","status":"True"}]}}',), ("{broken",)], "value string")
    log = log_from_json(df)
    assert {(r.kind, r.name) for r in log.collect()} == {("Node", "n"), ("", "")}
    assert {r.r for r in df.select(ready(F.try_parse_json("value")).alias("r")).collect()} == {True, False}
    bare = spark.createDataFrame([("Deployment", "s", "d", "u", "1", "ADDED", 1, '{"metadata":{"name":"d"}}')], LOG)
    rule = parse("rules: [{name: r, anchor: Deployment, labels: {k: {path: kind}, v: {path: apiVersion}}}]").rules[0]
    assert found(evaluated(rule, current(bare))) == {("s/d", "Deployment", "apps/v1")}


def _random_log(rng, n):
    rows = []
    for seq in range(1, n + 1):
        kind = rng.choice(["Pod", "Pod", "ReplicaSet", "Deployment"])
        name = f"{kind[0].lower()}{rng.randint(0, 3)}"
        owner = {"Pod": ("ReplicaSet", f"r{rng.randint(0, 3)}", True), "ReplicaSet": ("Deployment", f"d{rng.randint(0, 3)}", True)}.get(kind)
        body = {"spec": {"containers": [{"name": f"c{k}"} for k in range(rng.randint(0, 2))]}, "status": {"phase": rng.choice(["Run", "Gone", ""])}} if kind == "Pod" else {"meta": {"annotations": {"a/b": f"v{seq}"}}}
        rows.append((thing(kind, name, owner if rng.random() < 0.8 else None, uid=f"{name}-{rng.randint(0, 1)}", **body), rng.choice(["ADDED", "MODIFIED", "DELETED"]), seq))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_incremental_equals_recomputation(spark, tmp_path, seed):
    config, rng = parse(RULES), random.Random(seed)
    rows = _random_log(rng, 24)
    keeper = Maintainer(spark, config, f"file://{tmp_path}/views", hops=2, buckets=4)
    done = 0
    for cut in (12, 24):
        batch = log_of(spark, rows[done:cut])
        keeper.apply(batch)
        if cut == 12:
            keeper.apply(batch)  # the same again changes nothing
        done = cut
        want = views(config, current(log_of(spark, rows[:cut]), config), hops=2)
        for metric, df in want.items():
            got = keeper.series(metric)
            assert found(got) == found(df), (metric, cut)
            assert got.count() == df.count()


@pytest.mark.parametrize("seed", [3, 4])
def test_batches_in_any_order(spark, tmp_path, seed):
    config, rng = parse(RULES), random.Random(seed)
    rows = _random_log(rng, 24)
    rng.shuffle(rows)
    keeper = Maintainer(spark, config, f"file://{tmp_path}/views", buckets=3)
    for k in (0, 12):
        keeper.apply(log_of(spark, rows[k : k + 12]))
        for metric, df in views(config, current(log_of(spark, rows[: k + 12]), config)).items():
            assert found(Maintainer(spark, config, f"file://{tmp_path}/views", buckets=3).series(metric)) == found(df), (metric, k)
    gone = thing("Pod", "late", status={"phase": "Run"})
    keeper.apply(log_of(spark, [(gone, "DELETED", 102)]))
    keeper.apply(log_of(spark, [(gone, "ADDED", 101)]))  # older than its deletion
    assert keeper.series("info").where("anchor_key = 's/late'").isEmpty()
    keeper.apply(log_of(spark, [(gone, "ADDED", 103, 101)]))
    keeper.apply(log_of(spark, [(thing("Pod", "late", status={"phase": "Go"}), "MODIFIED", 104, 101)]))  # another content of the same version
    assert keeper.series("info").where("anchor_key = 's/late'").first().phase == "Go"
    assert len(keeper.versions.numbers()) == 2 and keeper.metrics().count() == keeper.version()


def test_admission_of_a_stream(spark, tmp_path):
    """Rows of a micro-batch in any order, unknown versions, late and repeated rows, a restart."""
    schema = "name string, seq long, rv string, more int"
    batches = [[("a", 3, "x"), ("a", 1, "w"), ("a", 2, "w"), (None, 1, "n")], [("a", 4, "x"), ("a", 3, "x"), ("a", 2, "z"), ("b", 1, None), ("b", 2, None)], [("b", 3, "y"), ("a", 5, "w"), (None, 2, "n")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame([(*r, 0) for r in rows], schema).write.mode("append").parquet(f"{tmp_path}/log")
        found = admitted_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/log"), ["name"], "seq", "rv")
        found.writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(path=f"{tmp_path}/out", format="parquet").awaitTermination()
    got = sorted(map(repr, map(tuple, spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect())))
    assert got == sorted(map(repr, [("a", 1, "w", None), ("a", 3, "x", "w"), (None, 1, "n", None), ("b", 1, None, None), ("b", 2, None, None), ("b", 3, "y", None), ("a", 5, "w", "x")]))
    with pytest.raises(ValueError):
        admitted_stream(spark.createDataFrame([], schema), ["name"], "rv", "seq")


def test_frames_of_a_key():
    """A key without news has no frame; places stay whole numbers beside unknown ones, whatever their size."""
    assert not list(_frames([], ["k", "seq", "rv"]))
    (frame,) = _frames([("a", None, None), ("a", 2**53 + 1, "x")], ["k", "seq", "rv"])
    assert frame.values.tolist() == [["a", None, None], ["a", 2**53 + 1, "x"]]


def test_tables_outlive_their_sink(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "anchor_key string, x string")
    for k in range(4):
        sink = TableSink(spark, f"file://{tmp_path}")
        sink.register("m", ["x"])
        assert sink.read("m").count() == (2 if k else 0)
        sink.write("m", rows if not k else sink.read("m"))
    assert len(sink.versions.numbers()) == 2


def test_replacing_an_anchor_writes_its_rows(spark, tmp_path):
    sink = TableSink(spark, f"file://{tmp_path}", buckets=4)
    sink.register("m", ["x"])
    sink.write("m", spark.createDataFrame([(f"a{k}", str(k)) for k in range(100)], "anchor_key string, x string"))
    one = spark.createDataFrame([("a7", "new"), ("a7", "newer")], "anchor_key string, x string")
    for k in range(9):  # the bucket is written anew once it has too many layers
        sink.replace("m", one.select("anchor_key"), one.withColumn("x", F.concat("x", F.lit(str(k)))))
        version = sink.versions.now()
        depths = sorted(map(len, version.layers.values()))
        assert depths[:3] == [1, 1, 1] and depths[3] <= 6
        if depths[3] > 1:
            layer = next(own[-1] for own in version.layers.values() if len(own) > 1)
            assert spark.read.parquet(f"file://{tmp_path}/series-m/{layer}").count() == 2
        assert {r.x for r in sink.read("m").where("anchor_key = 'a7'").collect()} == {f"new{k}", f"newer{k}"} and sink.read("m").count() == 101
    opened = sink.table("m").at(sink.versions.now(), one).inputFiles()
    assert opened and len({f.split("bucket=")[1].split("/")[0] for f in opened}) == 1


def test_of_two_writers_none_is_lost(spark, tmp_path):
    first, second = (TableSink(spark, f"file://{tmp_path}", buckets=2) for _ in range(2))
    for sink in (first, second):
        sink.register("m", ["x"])
    rows = lambda *names: spark.createDataFrame([(n, n) for n in names], "anchor_key string, x string")
    first.write("m", rows("a", "b"))
    turns = []

    def slow(version):  # while the first one writes, the second one publishes
        if not turns:
            second.upsert("m", rows("c"))
        turns.append(version.number)
        first.table("m").put(version, first.fixed("m", rows("d")), rows("d"))
        return True

    assert first.versions.commit(slow) and turns == [2, 3]
    assert found(first.read("m")) == {("a", "a"), ("b", "b"), ("c", "c"), ("d", "d")}
    assert not first.versions.publish(first.versions.read(3))


def test_last_rows_of_a_log(spark):
    pod = lambda n: json.dumps(thing("Pod", "a", n=n))
    rows = [("Pod", "s", "a", "u", None, "ADDED", None, pod(0)), ("Pod", "s", "a", "u", "2", None, 5, pod(1)), ("Pod", "s", "a", "u", "1", "DELETED", 5, pod(2)), ("Pod", "s", "b", "u", None, "ADDED", None, pod(3))]
    for order in (rows, rows[::-1]):
        got = current(spark.createDataFrame(order, LOG)).select("name", F.try_variant_get("object", "$.n", "int").alias("n")).collect()
        assert sorted(map(tuple, got)) == [("a", 1), ("b", 3)]


def test_a_changed_owner_costs_its_own_anchors(spark, tmp_path):
    config = parse("rules: [{name: r, anchor: Pod, labels: {note: {source: ownerController, path: 'metadata.annotations.n'}}}]")
    owner = lambda k, note: thing("ReplicaSet", f"r{k}", meta={"annotations": {"n": note}})
    keeper = Maintainer(spark, config, f"file://{tmp_path}/views", buckets=8)
    keeper.apply(log_of(spark, [(owner(k, "old"), "ADDED", 1) for k in range(40)] + [(thing("Pod", f"p{k}", ("ReplicaSet", f"r{k}")), "ADDED", 1) for k in range(40)]))
    assert not keeper.apply(log_of(spark, [(owner(3, "old"), "ADDED", 1)])) and keeper.version() == 1
    keeper.apply(log_of(spark, [(owner(3, "new"), "MODIFIED", 2)]))
    version = keeper.versions.now()
    sizes = {what: sum(spark.read.parquet(f"file://{tmp_path}/views/{what}/{name}").count() for name in {n for (w, _), own in version.layers.items() if w == what for n in own if n.startswith("2-")}) for what in ("state", "deps", "parents", "series-r")}
    assert sizes == {"state": 1, "deps": 2, "parents": 0, "series-r": 1}
    assert {r.note for r in keeper.series("r").where("anchor_key = 's/p3'").collect()} == {"new"} and keeper.series("r").where("note = 'old'").count() == 39
    asked = spark.createDataFrame([("u:u-ReplicaSet-r3",)], "parent string")
    opened = keeper.parents.at(version, asked)
    assert len({f.split("bucket=")[1].split("/")[0] for f in opened.inputFiles()}) == 1 and opened.count() == 1
    assert [r.anchors for r in keeper.metrics().orderBy("version").collect()] == [40, 1]
    assert not [n for n in keeper.folder.names("") if n.startswith("batch")]


def test_stream(spark, tmp_path):
    config, rows = parse(RULES), _random_log(random.Random(5), 12)
    log_of(spark, rows).write.parquet(f"{tmp_path}/log")
    keeper = Maintainer(spark, config, f"file://{tmp_path}/views", hops=2, buckets=4)
    stream = spark.readStream.schema(LOG).parquet(f"{tmp_path}/log")
    keeper.follow(stream, f"{tmp_path}/checkpoint").awaitTermination()
    for metric, df in views(config, current(log_of(spark, rows), config), hops=2).items():
        assert found(keeper.series(metric)) == found(df)
    pod = lambda image, phase: thing("Pod", "p", spec={"containers": [{"name": "c", "image": image}]}, status={"phase": phase})
    lines = change_lines(log_of(spark, [(pod("x", "Run"), "ADDED", 1, 7), (pod("x", "Run"), "MODIFIED", 2, 7), (pod("y", "Run"), "MODIFIED", 3, 8)])).collect()
    assert {(r.seq, r.old, r.new) for r in lines} == {(1, None, "c:x Run 7"), (3, "c:x Run 7", "c:y Run 8")}


def test_a_first_batch_keeps_objects_once(spark, tmp_path, monkeypatch):
    """If no key is known yet, all rows are new, and they are not written once more to say so."""
    kept, plain = [], Maintainer._kept
    monkeypatch.setattr(Maintainer, "_kept", lambda self, rows, label="rows": kept.append(rows.columns) or plain(self, rows, label))
    keeper = Maintainer(spark, parse(RULES), str(tmp_path / "views"), buckets=1)
    assert keeper.apply(log_of(spark, [(thing("Pod", "a", status={"phase": "Go"}), "ADDED", 1)]))
    assert not any("same" in columns for columns in kept)
    assert keeper.series("info").first().phase == "Go"


def test_a_batch_writes_no_object_but_its_own(spark, tmp_path, monkeypatch):
    """A first batch keeps no table of whole objects beside the state; a later one those of its own rows, and texts of what it looks up."""
    config = parse("rules: [{name: r, anchor: Pod, labels: {note: {source: ownerController, path: 'metadata.annotations.n'}}}]")
    owner = lambda note: (thing("ReplicaSet", "o", meta={"annotations": {"n": note}}), "ADDED", len(note))
    kept, plain = [], Maintainer._kept
    monkeypatch.setattr(Maintainer, "_kept", lambda self, rows, label="rows": kept.append(rows.columns) or plain(self, rows, label))
    keeper = Maintainer(spark, config, f"file://{tmp_path}/views", buckets=1)
    assert not keeper.apply(log_of(spark, [owner("a")]).limit(0)) and not keeper.folder.names("state")
    assert keeper.apply(log_of(spark, [owner("a"), (thing("Pod", "p", ("ReplicaSet", "o")), "ADDED", 1)]))
    assert kept and not any("object" in columns for columns in kept)
    kept.clear()
    assert keeper.apply(log_of(spark, [owner("ab")]))
    assert all("op" in columns for columns in kept if "object" in columns) and any("texts" in columns for columns in kept)
    assert [(r.anchor_key, r.note) for r in keeper.series("r").collect()] == [("s/p", "ab")]
    assert [tuple(r) for r in keeper.metrics().collect()] == [(1, 2, 2, 0, 2, 1), (2, 1, 1, 1, 0, 1)]
