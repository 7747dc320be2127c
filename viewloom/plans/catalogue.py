"""The engine's operators on the given tables, each with equivalent SQL.

Objects: an order is a Pod with its line items as containers, a customer its ReplicaSet, a nation the Deployment on top,
a region a Node. ``events`` is a change log of users, in which an error deletes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.functions.paths import compiled, first_of, matches, parse_path, text_of
from viewloom.functions.selectors import field_selector, label_selector
from viewloom.functions.text import metric_line, number_text, object_key, series_key
from viewloom.model import KINDS, ConfigError, Watched, load, parse
from viewloom.operators import incremental, measures, state
from viewloom.operators.resolve import bound, controller, lookup_namespace, parent_uids, walked, with_parent
from viewloom.operators.rules import evaluated
from viewloom.operators.state import KEY
from viewloom.plans.engine import index, readers, state_of_log, view_of_log, views_of_log
from viewloom.sinks.pages import Pages, read_page, write_pages
from viewloom.sinks.series import MemorySink, TableSink, exposition, page, snapshot_lines
from viewloom.sources.families import families, histogram_lines, histograms, text_lines
from viewloom.sources.objects import LOG, current, dry_run, in_order, log_from_json, lookup, read_log, ready_pods, samples, selected, stream_log
from viewloom.sources.places import Folder, shared_folder, written
from viewloom.sources.served import serve_changes, serve_list, served, since_lists
from viewloom.sources.served import watched as watched_stream
from viewloom.streaming.admission import admitted_stream
from viewloom.streaming.maintain import Maintainer, change_lines

RULES = """
metricPrefix: "shop_"
watch:
  resources:
    - {kind: Pod, scope: Namespaced}
    - {kind: ReplicaSet, scope: Namespaced}
    - {kind: Deployment, scope: Namespaced}
    - {kind: Node, scope: Cluster}
rules:
  - name: pod_info
    help: One series for each order.
    anchor: Pod
    relations:
      - {name: top, via: topController}
      - {name: owner, via: ownerController}
    labels:
      namespace: {path: metadata.namespace}
      pod: {path: metadata.name}
      phase: {path: status.phase}
      owner_name: {source: owner, path: metadata.name}
      controller_kind: {source: top, path: kind}
      controller_name: {source: top, path: metadata.name}
      segment:
        source: top
        path: 'metadata.annotations["shop.example/segment"]'
        onMissing: none
        fallbacks:
          - {source: owner, path: 'metadata.annotations["shop.example/segment"]'}
  - name: container
    anchor: Pod
    forEach: spec.containers[*]
    labels:
      pod: {path: metadata.name}
      container: {source: item, path: name}
      image: {source: item, path: image}
      first_image: {path: "spec.containers[0].image"}
  - name: node_info
    anchor: Node
    labels:
      node: {path: metadata.name}
      system: {path: status.nodeInfo.systemUUID, onMissing: unknown}
  - name: node_address
    anchor: Node
    forEach: status.addresses[*]
    labels:
      node: {path: metadata.name}
      kind: {source: item, path: type}
      address: {source: item, path: address}
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _meta(name: Column, uid: Column, owner: Column | None = None, annotations: Column | None = None, namespace: str = "shop") -> Column:
    fields = [name.alias("name"), uid.alias("uid"), F.lit("1").alias("resourceVersion")]
    if namespace:
        fields.append(F.lit(namespace).alias("namespace"))
    if owner is not None:
        fields.append(F.array(owner).alias("ownerReferences"))
    if annotations is not None:
        fields.append(annotations.alias("annotations"))
    return F.struct(*fields).alias("metadata")


def _owner(kind: str, name: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.lit(True).alias("controller"))


def _named(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _rows(kind: str, rows: DataFrame, name: Column, namespace: str, *fields: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), F.lit(namespace).alias("namespace"), name.alias("name"), F.concat(F.lit("uid-"), name).alias("uid"), F.lit("1").alias("rv"), F.lit("ADDED").alias("op"), F.lit(1).cast("bigint").alias("seq"), F.to_json(F.struct(*fields)).alias("object"))


def shop_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log of all objects."""
    read = lambda name: _table(spark, sf_dir, name)
    order, customer, nation, region = _named("order-", "o_orderkey"), _named("customer-", "c_custkey"), F.col("n_name"), F.col("r_name")
    items = read("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("line-"), F.col("l_linenumber").cast("string")).alias("name"), F.concat("l_returnflag", "l_linestatus").alias("image")))).alias("containers"))
    orders = read("orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    pods = _rows("Pod", orders, order, "shop", F.lit("Pod").alias("kind"), _meta(order, F.concat(F.lit("uid-"), order), _owner("ReplicaSet", _named("customer-", "o_custkey"))), F.struct("containers").alias("spec"), F.struct(F.col("o_orderstatus").alias("phase")).alias("status"))
    segment = F.create_map(F.lit("shop.example/segment"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).otherwise(""))
    sets = _rows("ReplicaSet", read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")), customer, "shop", _meta(customer, F.concat(F.lit("uid-"), customer), _owner("Deployment", nation), segment))
    tops = _rows("Deployment", read("nation"), nation, "shop", _meta(nation, F.concat(F.lit("uid-"), nation)))
    addresses = F.array(F.struct(F.lit("Hostname").alias("type"), F.lower(region).alias("address")), F.struct(F.lit("Key").alias("type"), F.col("r_regionkey").cast("string").alias("address")))
    nodes = _rows("Node", read("region"), region, "", _meta(region, F.concat(F.lit("uid-"), region), namespace=""), F.struct(F.struct(F.when(F.col("r_regionkey") > 1, F.concat(F.lit("sys-"), F.col("r_regionkey").cast("string"))).alias("systemUUID")).alias("nodeInfo"), addresses.alias("addresses")).alias("status"))
    return pods.unionByName(sets).unionByName(tops).unionByName(nodes)


def _view(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: view_of_log(parse(RULES), shop_log(spark, sf_dir), metric)


def _walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walked(state_of_log(shop_log(spark, sf_dir)), "Pod")


def _named_of(value: Column) -> Column:
    return F.try_variant_get(value, "$.metadata.name", "string")


_CATALOGUE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _query(sql: str) -> Callable[[Callable], Callable]:
    def add(fn: Callable) -> Callable:
        _CATALOGUE[fn.__name__] = (fn, sql)
        return fn

    return add


_CATALOGUE["pod_info_rule"] = (
    _view("shop_pod_info"),
    """SELECT 'shop/order-' || o_orderkey AS anchor_key, 'Deployment' AS controller_kind, n_name AS controller_name, 'shop' AS namespace, 'customer-' || c_custkey AS owner_name,
    o_orderstatus AS phase, 'order-' || o_orderkey AS pod, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE 'none' END AS segment, CAST(1 AS DOUBLE) AS value
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
_CATALOGUE["container_rule"] = (
    _view("shop_container"),
    """WITH f AS (SELECT l_orderkey AS k, min('line-' || l_linenumber || '|' || l_returnflag || l_linestatus) AS first FROM lineitem GROUP BY 1)
    SELECT DISTINCT 'shop/order-' || o_orderkey AS anchor_key, 'line-' || l_linenumber AS container, split_part(first, '|', 2) AS first_image, l_returnflag || l_linestatus AS image, 'order-' || o_orderkey AS pod, CAST(1 AS DOUBLE) AS value
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN f ON f.k = o_orderkey""",
)
_CATALOGUE["node_info_rule"] = (_view("shop_node_info"), "SELECT r_name AS anchor_key, r_name AS node, CASE WHEN r_regionkey > 1 THEN 'sys-' || r_regionkey ELSE 'unknown' END AS system, CAST(1 AS DOUBLE) AS value FROM region")
_CATALOGUE["address_rule"] = (_view("shop_node_address"), "SELECT r_name AS anchor_key, lower(r_name) AS address, 'Hostname' AS kind, r_name AS node, CAST(1 AS DOUBLE) AS value FROM region UNION ALL SELECT r_name, CAST(r_regionkey AS VARCHAR), 'Key', r_name, CAST(1 AS DOUBLE) FROM region")


@_query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag IN ('A', 'N')")
def scan_scope(spark, d):
    rows = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.lit("Pod").alias("kind"), F.col("l_returnflag").alias("namespace"))
    return selected(rows, Watched("Pod", namespaces=("A", "N"))).select("l_orderkey", "l_linenumber", "l_quantity")


@_query("SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'Pod' AS kind FROM orders UNION ALL SELECT 'Node' FROM region) GROUP BY kind")
def scan_kind(spark, d):
    return shop_log(spark, d).where(F.col("kind").isin("Pod", "Node")).groupBy("kind").agg(F.count("*").alias("n"))


@_query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY'")
def union_scopes(spark, d):
    customer = _table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.lit("ReplicaSet").alias("kind"), F.col("c_mktsegment").alias("namespace"))
    return incremental.union([selected(customer, Watched("ReplicaSet", namespaces=(s,))) for s in ("BUILDING", "MACHINERY")]).select("c_custkey", "c_mktsegment")


@_query("SELECT kind, name FROM (SELECT 'Pod' AS kind, 'order-' || o_orderkey AS name FROM orders WHERE o_orderkey = 7 UNION ALL SELECT 'Node', r_name FROM region WHERE r_name = 'ASIA')")
def point_lookup(spark, d):
    keys = spark.createDataFrame([("Pod", "shop", "order-7"), ("Pod", "elsewhere", "order-7"), ("Node", "any", "ASIA"), ("Deployment", "shop", "none")], "kind string, namespace string, name string")
    return lookup(shop_log(spark, d), keys).select("kind", "name")


def _flags(name: str) -> Column:
    """Labels of line items: the flag is missing where it is N."""
    return {"flag": F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), "status": F.col("l_linestatus")}.get(name, F.lit(None).cast("string"))


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def selector_equals(spark, d):
    return _table(spark, d, "lineitem").where(label_selector("flag=R,status==F", _flags)).select("l_orderkey", "l_linenumber")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def selector_in(spark, d):
    return _table(spark, d, "lineitem").where(label_selector("flag in (A, R),status", _flags)).select("l_orderkey", "l_linenumber")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'A'")
def selector_notequals_missing_ok(spark, d):
    return _table(spark, d, "lineitem").where(label_selector("flag!=A,!other", _flags)).select("l_orderkey", "l_linenumber")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N'")
def selector_notin_notexists(spark, d):
    return _table(spark, d, "lineitem").where(label_selector("flag notin (A,R),!flag", _flags)).select("l_orderkey", "l_linenumber")


@_query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT'")
def selector_field(spark, d):
    fields = {"status.phase": "o_orderstatus", "spec.schedulerName": "o_orderpriority"}
    return _table(spark, d, "orders").where(field_selector("status.phase=O,spec.schedulerName!=1-URGENT", "Pod", lambda f: F.col(fields[f]))).select("o_orderkey")


@_query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'N/A') AS k FROM events")
def path_field(spark, d):
    return _table(spark, d, "events").select("event_id", first_of([compiled("k")(F.try_parse_json("props"))], "N/A").alias("k"))


@_query("SELECT event_id, 'N/A' AS x FROM events")
def path_missing_default(spark, d):
    return _table(spark, d, "events").select("event_id", first_of([compiled("no.such[0].path")(F.try_parse_json("props"))], "N/A").alias("x"))


@_query("SELECT vec_id, CAST(embedding[3] > 0 AS BOOLEAN) AS positive FROM embeddings")
def path_index(spark, d):
    v = F.parse_json(F.to_json(F.struct("embedding")))
    return _table(spark, d, "embeddings").select("vec_id", (F.try_variant_get(F.get(matches(v, parse_path("embedding[2]")), F.lit(0)), "$", "double") > 0).alias("positive"))


@_query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS first FROM customer")
def path_wildcard_first(spark, d):
    names = F.array(F.struct(F.lit("").alias("a")), F.struct(F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).alias("a")), F.struct(F.col("c_name").alias("a")))
    return _table(spark, d, "customer").select("c_custkey", compiled("list[*].a")(F.parse_json(F.to_json(F.struct(names.alias("list"))))).alias("first"))


@_query("SELECT r_regionkey, lower(r_name) || ',' || r_regionkey AS addresses FROM region")
def path_wildcard_all(spark, d):
    v = F.parse_json(F.to_json(F.struct(F.array(F.struct(F.lower("r_name").alias("a")), F.struct(F.col("r_regionkey").cast("string").alias("a"))).alias("list"))))
    return _table(spark, d, "region").select("r_regionkey", F.array_join(F.transform(matches(v, parse_path('{.list[*]["a"]}')), text_of), ",").alias("addresses"))


@_query("SELECT r_regionkey, r_name || ',' || r_regionkey AS vals FROM region")
def path_map_wildcard(spark, d):
    v = F.parse_json(F.to_json(F.struct(F.struct(F.col("r_name").alias("a"), F.col("r_regionkey").alias("b")).alias("m"))))
    return _table(spark, d, "region").select("r_regionkey", F.array_join(F.transform(matches(v, parse_path("m[*]")), text_of), ",").alias("vals"))


@_query("SELECT DISTINCT 'shop/' || n_name AS anchor_key, CAST(x AS VARCHAR) AS key FROM (SELECT n_name, unnest([n_nationkey, n_regionkey]) AS x FROM nation)")
def foreach_explode(spark, d):
    nation = _table(spark, d, "nation")
    keys = F.struct(F.array("n_nationkey", "n_regionkey").alias("keys")).alias("spec")
    log = _rows("Deployment", nation, F.col("n_name"), "shop", _meta(F.col("n_name"), F.col("n_name")), keys)
    return views_of_log(parse("rules: [{name: keys, anchor: Deployment, forEach: 'spec.keys[*]', labels: {key: {source: item, path: _}}}]"), log)["keys"].drop("value")


@_query("SELECT o_orderkey, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT o_orderkey, l_linenumber, l_returnflag, l_linestatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1")
def foreach_empty_dropped(spark, d):
    rows = view_of_log(parse(RULES), shop_log(spark, d), "shop_container")
    return rows.groupBy(F.replace("pod", F.lit("order-"), F.lit("")).cast("bigint").alias("o_orderkey")).agg(F.count("*").alias("n"))


@_query("SELECT o_orderkey, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE o_orderpriority END AS label FROM orders JOIN customer ON o_custkey = c_custkey")
def fallback_chain(spark, d):
    rows = _table(spark, d, "orders").join(_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", first_of([F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).otherwise(""), F.col("o_orderpriority")], "none").alias("label"))


@_query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS key_text, CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END AS open_text FROM orders")
def stringify_scalars(spark, d):
    v = F.parse_json(F.to_json(F.struct(F.col("o_custkey").alias("k"), (F.col("o_orderstatus") == "O").alias("open"))))
    return _table(spark, d, "orders").select("o_orderkey", compiled("k")(v).alias("key_text"), compiled("open")(v).alias("open_text"))


@_query("SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN '0' WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey // 2 AS VARCHAR) ELSE CAST(n_nationkey // 2 AS VARCHAR) || '.5' END AS half FROM nation")
def stringify_floats(spark, d):
    return _table(spark, d, "nation").select("n_nationkey", number_text(F.col("n_nationkey") / 2.0).alias("half"))


@_query("SELECT 'shop/' || 'customer-' || c_custkey AS anchor, 'shop/customer-' || c_custkey || '|name=' || c_name || '|segment=' || c_mktsegment AS series FROM customer")
def series_keys(spark, d):
    anchor = object_key(F.lit("shop"), _named("customer-", "c_custkey"))
    return _table(spark, d, "customer").select(anchor.alias("anchor"), series_key(anchor, {"segment": F.col("c_mktsegment"), "name": F.col("c_name")}).alias("series"))


@_query("""SELECT DISTINCT 'shop_nation{name="' || n_name || '",region="' || n_regionkey || '"} 1' AS line FROM nation""")
def exposition_line(spark, d):
    return exposition(_table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region")), "shop_nation", ["name", "region"])


@_query("SELECT 'shop_nation' AS metric, n_name AS name, CAST(1 AS DOUBLE) AS value FROM nation")
def exposition_scan(spark, d):
    lines = _table(spark, d, "nation").select(metric_line("shop_nation", {"name": F.col("n_name")}).alias("value"))
    return samples(lines).select("metric", F.try_element_at("labels", F.lit("name")).alias("name"), "value")


@_query("SELECT 'order-' || o_orderkey AS pod, 'customer-' || c_custkey AS owner FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def owner_one_hop(spark, d):
    rows = walked(state_of_log(shop_log(spark, d)), "Pod", hops=1)
    return rows.select(F.col("name").alias("pod"), _named_of(bound(rows)["ownerController"]).alias("owner"))


@_query("SELECT 'order-' || o_orderkey AS pod, n_name AS top FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def owner_top(spark, d):
    rows = _walk(spark, d)
    return rows.select(F.col("name").alias("pod"), _named_of(bound(rows)["topController"]).alias("top"))


@_query("SELECT 'order-' || o_orderkey AS pod, 'customer-' || o_custkey AS owner, 'customer-' || o_custkey AS replica_set, n_name AS deployment, CAST(NULL AS VARCHAR) AS daemon_set FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def owner_chain_full(spark, d):
    rows = _walk(spark, d)
    at = bound(rows)
    return rows.select(F.col("name").alias("pod"), *(_named_of(at[s]).alias(n) for s, n in (("ownerController", "owner"), ("ReplicaSet", "replica_set"), ("Deployment", "deployment"), ("DaemonSet", "daemon_set"))))


@_query("SELECT 'order-' || o_orderkey AS pod, CASE WHEN c_custkey % 3 > 0 THEN 'customer-' || c_custkey END AS owner, CASE WHEN c_custkey % 3 > 0 THEN n_name END AS top FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def owner_missing(spark, d):
    kept = state_of_log(shop_log(spark, d)).where("kind <> 'ReplicaSet' or cast(replace(name, 'customer-', '') as bigint) % 3 > 0")
    rows = walked(kept, "Pod")
    at = bound(rows)
    return rows.select(F.col("name").alias("pod"), _named_of(at["ownerController"]).alias("owner"), _named_of(at["topController"]).alias("top"))


@_query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN 'second' ELSE 'first' END AS chosen FROM nation")
def controller_ref_choice(spark, d):
    ref = lambda name, mark: F.struct(F.lit(name).alias("name"), mark.alias("controller"))
    k = F.col("n_nationkey") % 3
    refs = F.when(k > 0, F.array(ref("first", F.lit(False)), ref("second", k == 1)))
    return _table(spark, d, "nation").select("n_nationkey", controller(refs)["name"].alias("chosen"))


@_query("SELECT 'order-' || o_orderkey AS pod, 'uid-customer-' || o_custkey || ',uid-order-' || o_orderkey || ',uid-' || n_name AS uids FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def parent_uid_sets(spark, d):
    rows = walked(state_of_log(shop_log(spark, d)), "Pod", payload=F.lit(True))  # uids are all that is read
    uids = F.array_sort(parent_uids(rows), lambda a, b: F.when(a.startswith("uid-customer"), -1).when(b.startswith("uid-customer"), 1).when(a.startswith("uid-order"), -1).when(b.startswith("uid-order"), 1).otherwise(0))
    return rows.select(F.col("name").alias("pod"), F.array_join(uids, ",").alias("uids"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("anchor_key"), F.lit("Pod").alias("anchor_kind"), F.col("o_custkey").cast("string").alias("parent_uid"), F.lit(None).cast("struct<kind:string,namespace:string,name:string>").alias("wanted"))


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS anchor_key FROM orders WHERE o_custkey < 10")
def affected_anchors(spark, d):
    changed = _table(spark, d, "customer").where("c_custkey < 10").select(F.lit("ReplicaSet").alias("kind"), F.lit("shop").alias("namespace"), F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("uid"))
    return incremental.affected(_orders(spark, d), changed).select("anchor_key")


@_query("SELECT CAST((SELECT count(*) FROM orders) * 3 + (SELECT count(*) FROM region) AS BIGINT) AS n")
def reverse_index(spark, d):
    return index(parse(RULES), state_of_log(shop_log(spark, d))).where("parent_uid is not null").agg(F.count("*").alias("n"))


@_query("SELECT c_custkey, c_mktsegment AS namespace FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_custkey < 3)")
def cold_fallback(spark, d):
    anchors = _table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("namespace"))
    return incremental.in_scope_of(anchors, anchors.where("c_custkey < 3").select("namespace"))


@_query("SELECT c_custkey, c_mktsegment AS namespace FROM customer")
def cold_fallback_cluster(spark, d):
    anchors = _table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("namespace"))
    return incremental.in_scope_of(anchors, _table(spark, d, "region").select(F.lit("").alias("namespace")))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select("user_id", "event_id", "event_type", "value")


@_query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_state(spark, d):
    return state.latest(_events(spark, d).drop("value"), ["user_id"], "event_id")


@_query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type NOT IN ('error', 'view')")
def latest_then_filter(spark, d):
    return state.live(_events(spark, d).drop("value"), ["user_id"], "event_id", F.col("event_type") == "error", F.col("event_type") != "view")


@_query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'")
def cdc_live_set(spark, d):
    return state.live(_events(spark, d), ["user_id"], "event_id", F.col("event_type") == "error").select("user_id", "event_id")


@_query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events) WHERE old IS NULL OR old <> event_type")
def update_admission(spark, d):
    return state.admitted(_events(spark, d).select("event_id", "user_id", "event_type"), ["user_id"], "event_id", "event_type")


@_query("SELECT event_id, user_id, event_type, old AS old_event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events) WHERE old IS NULL OR old <> event_type")
def admission_stream(spark, d):
    """The same as a stream of three micro-batches, the last one after a restart."""
    events, place = _table(spark, d, "events").select("user_id", "event_id", "event_type"), f"{shared_folder(spark)}/viewloom/admission-{uuid.uuid4().hex}"
    ends = [r[0] for r in events.select(F.expr("explode(percentile_approx(event_id, array(0.3, 0.6)))")).collect()]
    parts = [events.where(F.col("event_id") <= ends[0]), events.where((F.col("event_id") > ends[0]) & (F.col("event_id") <= ends[1])), events.where(F.col("event_id") > ends[1])]
    for k, part in enumerate(parts):
        part.write.mode("append").parquet(f"{place}/log")
        if k:  # the first two parts come in one run, the third after a restart
            stream = spark.readStream.schema(events.schema).parquet(f"{place}/log")
            found = admitted_stream(stream, ["user_id"], "event_id", "event_type")
            found.writeStream.option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start(path=f"{place}/out", format="parquet").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{place}/out")


@_query("SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS old_event_type FROM events")
def old_new_pairs(spark, d):
    return state.versions(_events(spark, d).select("event_id", "user_id", "event_type"), ["user_id"], "event_id", ["event_type"])


@_query("SELECT DISTINCT 'shop/order-' || l_orderkey AS anchor_key, l_returnflag || l_linestatus AS image FROM lineitem")
def series_distinct(spark, d):
    return views_of_log(parse("rules: [{name: image, anchor: Pod, forEach: 'spec.containers[*]', labels: {image: {source: item, path: image}}}]"), shop_log(spark, d))["image"].drop("value")


@_query("SELECT DISTINCT user_id FROM events")
def queue_coalesce(spark, d):
    return state.coalesced(_events(spark, d), ["user_id"])


@_query("SELECT o_orderkey, CASE WHEN o_custkey < 10 THEN 'new' ELSE o_orderstatus END AS phase FROM orders WHERE NOT (o_custkey < 10 AND o_orderkey % 2 = 0)")
def replace_for_anchor(spark, d):
    orders = _table(spark, d, "orders")
    changed = orders.where("o_custkey < 10")
    return incremental.replaced(orders.select("o_orderkey", F.col("o_orderstatus").alias("phase")), changed.select("o_orderkey"), changed.where("o_orderkey % 2 <> 0").select("o_orderkey", F.lit("new").alias("phase")), "o_orderkey")


@_query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 7 = 0")
def series_stale(spark, d):
    rows = _table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return incremental.stale(rows, rows.where("c_custkey % 7 <> 0"), ["c_custkey", "c_mktsegment"])


@_query("SELECT c_custkey, CASE WHEN c_custkey < 20 THEN 'DELETED' ELSE 'ADDED' END AS op FROM customer WHERE c_custkey < 20 OR c_custkey BETWEEN 50 AND 99")
def series_delta(spark, d):
    keys = _table(spark, d, "customer").select("c_custkey")
    return incremental.delta(keys.where("c_custkey < 50"), keys.where("c_custkey between 20 and 99"), ["c_custkey"])


@_query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def counter_by_result(spark, d):
    return measures.counts(_events(spark, d), ["event_type"])


@_query("SELECT event_type, le, CAST(n AS BIGINT) AS n FROM (SELECT event_type, unnest(['1.0', '10.0', '100.0', '+Inf']) AS le, unnest([count(*) FILTER (value <= 1), count(*) FILTER (value <= 10), count(*) FILTER (value <= 100), count(*)]) AS n FROM events GROUP BY 1)")
def histogram_buckets(spark, d):
    return measures.histogram(_events(spark, d), ["event_type"], "value", (1.0, 10.0, 100.0))


@_query("SELECT CAST(count(DISTINCT o_custkey) AS BIGINT) AS by_parent, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS by_anchor FROM orders")
def index_size(spark, d):
    return measures.index_size(_orders(spark, d))


@_query("SELECT event_id, CASE WHEN event_type = 'view' THEN '200' WHEN event_type = 'error' THEN 'invalid' WHEN event_type = 'click' THEN '0' WHEN event_id % 2 = 0 THEN 'invalid' ELSE '-7' END AS code FROM events")
def code_normalise(spark, d):
    raw = F.when(F.col("event_type") == "view", "200").when(F.col("event_type") == "error", "5xx").when(F.col("event_type") == "click", "").when(F.col("event_id") % 2 == 0, "99999999999999999999").otherwise("-7")
    return _table(spark, d, "events").select("event_id", measures.status_code(raw).alias("code"))


@_query("SELECT CAST(count(*) AS BIGINT) AS total FROM events WHERE event_type IN ('click', 'view')")
def filtered_sum(spark, d):
    return measures.total(_events(spark, d).withColumn("one", F.lit(1).cast("bigint")), F.col("event_type").isin("click", "view"), "one")


@_query("SELECT max(a.n - coalesce(b.n, 0)) AS max_delta FROM (SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1) a LEFT JOIN (SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_id < 1000 GROUP BY 1) b USING (user_id)")
def max_rule_delta(spark, d):
    events = _events(spark, d)
    return measures.max_delta(measures.counts(events.where("event_id < 1000"), ["user_id"]), measures.counts(events, ["user_id"]), "user_id", "n")


@_query("SELECT user_id, bool_and(value > 0) AND count(*) >= 3 AS ok FROM events GROUP BY 1")
def all_match_and_min(spark, d):
    return measures.all_match(_events(spark, d), ["user_id"], F.col("value") > 0, 3)


@_query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def exists_match(spark, d):
    orders = _table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return measures.exists_in(_table(spark, d, "customer").select("c_custkey"), orders, ["c_custkey"], F.col("o_orderstatus") == "F")


@_query("SELECT 'shop/order-' || o_orderkey AS anchor_key, n_name AS top FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'")
def selected_rule(spark, d):
    config = parse("rules: [{name: r, anchor: Pod, labels: {top: {source: topController, path: metadata.name}}}]\nwatch: {resources: [{kind: Pod, scope: Namespaced, namespaces: [shop], fieldSelector: status.phase=F}, {kind: ReplicaSet, scope: Cluster}, {kind: Deployment, scope: Cluster}]}")
    return evaluated(config.rules[0], state_of_log(shop_log(spark, d), config)).select("anchor_key", "top")


def fleet_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as DaemonSets and parts as StatefulSets, with labels."""
    supplier, part = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "part")

    def meta(name: Column, **labels: Column) -> Column:
        return F.struct(name.alias("name"), F.lit("shop").alias("namespace"), F.struct(*(v.cast("string").alias(k) for k, v in labels.items())).alias("labels")).alias("metadata")

    daemon, stateful = _named("supplier-", "s_suppkey"), _named("part-", "p_partkey")
    sets = _rows("DaemonSet", supplier, daemon, "shop", meta(daemon, nation=F.col("s_nationkey"), even=F.when(F.col("s_suppkey") % 2 == 0, "yes")))
    return sets.unionByName(_rows("StatefulSet", part, stateful, "shop", meta(stateful, size=F.col("p_size"))))


_FLEET = "rules: [{{name: r, anchor: {0}, labels: {{n: {{path: metadata.name}}}}}}]\nwatch: {{resources: [{{kind: {0}, scope: Namespaced, labelSelector: '{1}'}}]}}"


@_query("SELECT 'shop/supplier-' || s_suppkey AS anchor_key, 'supplier-' || s_suppkey AS n FROM supplier WHERE s_nationkey IN (1, 2, 3) AND s_suppkey % 2 <> 0")
def scan_daemon_set(spark, d):
    return views_of_log(parse(_FLEET.format("DaemonSet", "nation in (1,2,3),!even")), fleet_log(spark, d))["r"].drop("value")


@_query("SELECT 'shop/part-' || p_partkey AS anchor_key, 'part-' || p_partkey AS n FROM part WHERE p_size <> 7")
def scan_stateful_set(spark, d):
    return views_of_log(parse(_FLEET.format("StatefulSet", "size!=7,size")), fleet_log(spark, d))["r"].drop("value")


def _log_folder(spark: SparkSession, log: DataFrame) -> str:
    path = f"{shared_folder(spark)}/viewloom/log-{uuid.uuid4().hex}"
    log.select(*(c.split()[0] for c in LOG.split(", "))).write.parquet(path)
    return path


@_query("SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'DaemonSet' AS kind FROM supplier UNION ALL SELECT 'StatefulSet' FROM part) GROUP BY 1")
def log_at_rest(spark, d):
    return current(read_log(spark, _log_folder(spark, fleet_log(spark, d)))).groupBy("kind").agg(F.count("*").alias("n"))


@_query("SELECT 'supplier-' || s_suppkey AS name FROM supplier WHERE s_suppkey % 2 = 0")
def log_stream_selected(spark, d):
    rows = stream_log(spark, _log_folder(spark, fleet_log(spark, d))).withColumn("object", F.try_parse_json("object"))
    out = f"{shared_folder(spark)}/viewloom/stream-{uuid.uuid4().hex}"
    found = selected(rows, Watched("DaemonSet", label_selector="even=yes")).select("name")
    found.writeStream.option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(path=out, format="parquet").awaitTermination()
    return spark.read.schema("name string").parquet(out)


@_query("SELECT 'DaemonSet' AS kind, 'supplier-' || s_suppkey AS name, '' AS namespace FROM supplier")
def json_objects(spark, d):
    objects = _table(spark, d, "supplier").select(F.to_json(F.struct(F.lit("DaemonSet").alias("kind"), F.struct(_named("supplier-", "s_suppkey").alias("name")).alias("metadata"))).alias("value"))
    return log_from_json(objects).select("kind", "name", "namespace")


@_query("SELECT kind, CASE WHEN kind = 'Node' THEN '' ELSE 'shop' END AS namespace FROM (VALUES ('Pod'), ('Deployment'), ('StatefulSet'), ('DaemonSet'), ('ReplicaSet'), ('Node')) t(kind)")
def namespace_key(spark, d):
    return spark.createDataFrame([(k,) for k in KINDS], "kind string").select("kind", lookup_namespace(F.col("kind"), F.lit("shop")).alias("namespace"))


@_query("SELECT * FROM (VALUES (0, 'Pod', true), (1, 'Deployment', false), (2, 'ReplicaSet', false), (3, 'Node', true)) t(place, kind, anchors)")
def watched_kinds(spark, d):
    config = parse(RULES)
    rows = [(i, w.kind, any(r.anchor == w.kind for r in config.rules)) for i, w in enumerate(config.watched())]
    return spark.createDataFrame(rows, "place int, kind string, anchors boolean")


@_query("SELECT * FROM (VALUES ('Deployment', 'shop_pod_info'), ('StatefulSet', 'shop_pod_info'), ('DaemonSet', 'shop_pod_info'), ('ReplicaSet', 'shop_pod_info')) t(kind, metric)")
def read_kinds(spark, d):
    return spark.createDataFrame([(k, m) for k, metrics in readers(parse(RULES)).items() for m in metrics], "kind string, metric string")


@_query("SELECT * FROM (VALUES ('shop_pod_info', 'One series for each order.', 'controller_kind,controller_name,namespace,owner_name,phase,pod,segment'), ('shop_container', 'Metadata of Pod objects by rule container.', 'container,first_image,image,pod'), ('shop_node_info', 'Metadata of Node objects by rule node_info.', 'node,system'), ('shop_node_address', 'Metadata of Node objects by rule node_address.', 'address,kind,node')) t(metric, help, labels)")
def metric_schemas(spark, d):
    with tempfile.NamedTemporaryFile("w", suffix=".yaml") as file:  # of the driver, which alone reads configurations
        file.write(RULES)
        file.flush()
        config = load(file.name)
    return spark.createDataFrame([(config.metric(r), r.help_text(), ",".join(r.label_names())) for r in config.rules], "metric string, help string, labels string")


_RULE = "{{name: {name}, anchor: {anchor}, labels: {{{label}: {{path: {path}, source: {source}{more}}}}}{rest}}}"


def _config(*rules: str, prefix: str = "", watch: str = "") -> str:
    return f"metricPrefix: '{prefix}'\nrules: [{', '.join(rules)}]\nwatch: {{resources: [{watch}]}}"


def _rule(name="r", anchor="Pod", label="a", path="metadata.name", source="anchor", more="", rest="") -> str:
    return _RULE.format(name=name, anchor=anchor, label=label, path=path, source=source, more=more, rest=rest)


#: Configurations and whether they pass; each case breaks one rule.
_CASES = {
    "good": (_config(_rule()), True), "no rules": ("rules: []", False), "not YAML": ("rules: [", False), "a list": ("[1]", False),
    "no name": (_config(_rule(name="''")), False), "unknown anchor": (_config(_rule(anchor="Job")), False), "no labels": ("rules: [{name: r, anchor: Pod}]", False),
    "label name": (_config(_rule(label="a-b")), False), "reserved label": (_config(_rule(label="__a")), False), "unknown source": (_config(_rule(source="boss")), False),
    "item without forEach": (_config(_rule(source="item")), False), "item with forEach": (_config(_rule(source="item", rest=", forEach: 'spec.containers[*]'")), True),
    "no path": (_config(_rule(path="''")), False), "bad path": (_config(_rule(path="'a.[x'")), False), "bad forEach": (_config(_rule(rest=", forEach: 'a]'")), False),
    "nested fallbacks": (_config(_rule(more=", fallbacks: [{path: a, fallbacks: [{path: b}]}]")), False), "fallback": (_config(_rule(more=", fallbacks: [{path: a, source: ownerController}]")), True),
    "relation": (_config(_rule(source="top", rest=", relations: [{name: top, via: topController}]")), True), "relation via item": (_config(_rule(rest=", relations: [{name: x, via: item}]")), False),
    "relation via unknown": (_config(_rule(rest=", relations: [{name: x, via: Job}]")), False), "relation named like a kind": (_config(_rule(rest=", relations: [{name: Pod, via: Node}]")), False),
    "relation without name": (_config(_rule(rest=", relations: [{name: '', via: Node}]")), False), "metric prefix": (_config(_rule(), prefix="9"), False), "metric name": (_config(_rule(name="a b")), False),
    "metric twice": (_config(_rule(), _rule()), False), "unknown kind watched": (_config(_rule(), watch="{kind: Job, scope: Cluster}"), False), "kind watched twice": (_config(_rule(), watch="{kind: Pod, scope: Cluster}, {kind: Pod, scope: Cluster}"), False),
    "scope": (_config(_rule(), watch="{kind: Pod, scope: Here}"), False), "namespaced Node": (_config(_rule(), watch="{kind: Pod, scope: Cluster}, {kind: Node, scope: Namespaced}"), False),
    "namespaces of a cluster": (_config(_rule(), watch="{kind: Pod, scope: Cluster, namespaces: [a]}"), False), "anchor not watched": (_config(_rule(), watch="{kind: Node, scope: Cluster}"), False),
    "source not watched": (_config(_rule(source="Node"), watch="{kind: Pod, scope: Cluster}"), False), "source watched": (_config(_rule(source="Node"), watch="{kind: Pod, scope: Cluster}, {kind: Node, scope: Cluster}"), True),
}


def _passes(run: Callable[[], object]) -> bool:
    try:
        run()
    except (ConfigError, ValueError):
        return False
    return True


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(ok).lower()})" for n, (_, ok) in _CASES.items()) + ") t(name, ok)")
def config_checks(spark, d):
    return spark.createDataFrame([(n, _passes(lambda text=text: parse(text))) for n, (text, _) in _CASES.items()], "name string, ok boolean")


@_query("SELECT * FROM (VALUES ('all kinds', 0), ('owners not watched', 1), ('selectors on Pods and owners', 1)) t(name, warnings)")
def config_warnings(spark, d):
    top = _rule(source="topController")
    owners = ", ".join(f"{{kind: {k}, scope: Cluster, fieldSelector: metadata.name=x}}" for k in ("Pod", "ReplicaSet", "Deployment", "StatefulSet", "DaemonSet"))
    found = {"all kinds": _config(top), "owners not watched": _config(top, watch="{kind: Pod, scope: Cluster}"), "selectors on Pods and owners": _config(top, watch=owners)}
    return spark.createDataFrame([(n, len(list(parse(text).warnings()))) for n, text in found.items()], "name string, warnings int")


@_query("SELECT * FROM (VALUES ('status.phase=F', true), ('spec.secret=x', false), ('status.phase', false)) t(selector, ok)")
def selector_dry_run(spark, d):
    state = current(shop_log(spark, d))

    def run(text: str) -> bool:
        return _passes(lambda: dry_run(state, parse(_config(_rule(), watch=f"{{kind: Pod, scope: Namespaced, fieldSelector: '{text}'}}"))))

    return spark.createDataFrame([(t, run(t)) for t in ("status.phase=F", "spec.secret=x", "status.phase")], "selector string, ok boolean")


def _tower(spark: SparkSession, d: str, height: int) -> DataFrame:
    """For each nation a Pod whose Deployment stands ``height`` hops up, above ReplicaSets."""
    nation = _table(spark, d, "nation").select("n_name", F.explode(F.sequence(F.lit(0), F.lit(height))).alias("h"))
    kind = lambda h: F.when(h == 0, "Pod").when(h == height, "Deployment").otherwise("ReplicaSet")
    name = lambda h: F.concat("n_name", F.lit("-"), h.cast("string"))
    h = F.col("h")
    owner = F.when(h < height, F.array(F.struct(kind(h + 1).alias("kind"), name(h + 1).alias("name"), F.lit(True).alias("controller"))))
    meta = F.struct(name(h).alias("name"), owner.alias("ownerReferences"))
    return nation.select(kind(h).alias("kind"), F.lit("shop").alias("namespace"), name(h).alias("name"), name(h).alias("uid"), F.lit("1").alias("rv"), F.lit("ADDED").alias("op"), F.lit(1).cast("bigint").alias("seq"), F.to_json(F.struct(meta.alias("metadata"))).alias("object"))


@_query("SELECT 'shop/' || n_name || '-0' AS anchor_key, n_name || '-6' AS top FROM nation")
def owner_chain_deep(spark, d):
    return views_of_log(parse("rules: [{name: r, anchor: Pod, labels: {top: {source: topController, path: metadata.name}}}]"), _tower(spark, d, 6))["r"].drop("value")


@_query("SELECT 'shop/' || n_name || '-0' AS anchor_key, n_name || '-8' AS deepest, 'none' AS top FROM nation")
def owner_chain_cut(spark, d):
    rule = "rules: [{name: r, anchor: Pod, labels: {top: {source: topController, path: metadata.name, onMissing: none}, deepest: {source: ReplicaSet, path: metadata.name}}}]"
    return views_of_log(parse(rule), _tower(spark, d, 10))["r"].drop("value")


@_query("SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'Deployment' END AS parent_kind FROM nation")
def owner_kind_supported(spark, d):
    nation = _table(spark, d, "nation")
    kind = F.when(F.col("n_nationkey") % 2 == 0, "Deployment").otherwise("Job")
    meta = F.struct(F.array(F.struct(kind.alias("kind"), F.lit("x").alias("name"))).alias("ownerReferences"))
    return with_parent(nation.select("n_name", F.lit("shop").alias("namespace"), F.to_json(F.struct(meta.alias("metadata"))).alias("object"))).select("n_name", "parent_kind")


def _people(spark: SparkSession, d: str) -> DataFrame:
    """A change log of users as Pods: an event is a new version, an error a delete that carries the last object."""
    events = _table(spark, d, "events")
    name = _named("user-", "user_id")
    meta = F.struct(name.alias("name"), F.concat(F.lit("uid-"), name).alias("uid"), F.lit("shop").alias("namespace"), F.col("event_id").cast("string").alias("resourceVersion"))
    body = F.struct(meta.alias("metadata"), F.struct(F.array(F.struct(F.lit("c").alias("name"), F.col("event_type").alias("image"))).alias("containers")).alias("spec"), F.struct(F.when(F.col("event_id") % 2 == 0, "Running").otherwise("Pending").alias("phase")).alias("status"))
    op = F.when(F.col("event_type") == "error", "DELETED").otherwise("MODIFIED")
    return events.select(F.lit("Pod").alias("kind"), F.lit("shop").alias("namespace"), name.alias("name"), F.concat(F.lit("uid-"), name).alias("uid"), F.col("event_id").cast("string").alias("rv"), op.alias("op"), F.col("event_id").cast("bigint").alias("seq"), F.to_json(body).alias("object"))


@_query("SELECT 'user-' || user_id AS name, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'")
def tombstones(spark, d):
    return current(_people(spark, d)).select("name", "seq")


@_query("SELECT 'Pod' AS kind, 'shop' AS namespace, 'user-' || user_id AS name, event_id AS seq, lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS old, s AS new FROM (SELECT *, 'c:' || event_type || ' ' || CASE WHEN event_id % 2 = 0 THEN 'Running' ELSE 'Pending' END || ' ' || event_id AS s FROM events)")
def change_log_lines(spark, d):
    return change_lines(_people(spark, d))


_STEPS = "rules: [{name: info, anchor: Pod, labels: {image: {path: 'spec.containers[0].image'}, phase: {path: status.phase}}}]\nwatch: {resources: [{kind: Pod, scope: Namespaced, fieldSelector: status.phase=Running}]}"
_STEPS_SQL = "SELECT 'shop/user-' || user_id AS anchor_key, event_type AS image, 'Running' AS phase, CAST(1 AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error' AND event_id % 2 = 0"


def _views_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/viewloom/views-{uuid.uuid4().hex}"


@_query(_STEPS_SQL)
def upkeep_series(spark, d):
    """Batches in an order that is not that of the log: the last third first, then the others mixed."""
    log = written(_people(spark, d), "log")
    keeper = Maintainer(spark, parse(_STEPS), _views_folder(spark), buckets=8)
    for batch in (F.col("seq") % 3 == 2, F.col("seq") % 3 == 0, F.col("seq") % 3 == 1):
        keeper.apply(log.where(batch))
    return keeper.series("info")


@_query("SELECT CAST(b.k + 1 AS INTEGER) AS version, CAST(count(DISTINCT user_id) AS BIGINT) AS changed FROM events JOIN (VALUES (0, 2), (1, 0)) b(k, r) ON event_id % 3 = b.r GROUP BY 1")
def upkeep_metrics(spark, d):
    log = written(_people(spark, d), "log")
    keeper = Maintainer(spark, parse(_STEPS), _views_folder(spark), buckets=8)
    for batch in (F.col("seq") % 3 == 2, F.col("seq") % 3 == 0):
        keeper.apply(log.where(batch))
    return keeper.metrics().select("version", "changed")


@_query(_STEPS_SQL)
def upkeep_stream(spark, d):
    """A snapshot first, then the rest of the log as a stream."""
    log = written(_people(spark, d), "log")
    folder = _views_folder(spark)
    keeper = Maintainer(spark, parse(_STEPS), folder, buckets=8)
    later = stream_log(spark, _log_folder(spark, log.where("seq % 2 = 1")))
    keeper.follow(later, f"{folder}-checkpoint", snapshot=log.where("seq % 2 = 0")).awaitTermination()
    return keeper.series("info")


def _listed(log: DataFrame, path: str, version: int) -> None:
    """Serves the objects that stand at a version."""
    serve_list(state.latest(log.where(F.col("seq") <= version), KEY, "seq").where("op <> 'DELETED'"), path, version)


def _ends(log: DataFrame, *shares: float) -> list[int]:
    """Versions that cut a log into parts, and its last one."""
    row = log.agg(F.percentile_approx("seq", F.array(*map(F.lit, shares))).alias("ends"), F.max("seq").alias("last")).first()
    return [*row.ends, row.last]


@_query("SELECT 'user-' || user_id AS name, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error' AND event_id % 2 = 0")
def list_then_watch(spark, d):
    """Users as a list and the watches after it; the kind, the namespace and a selector are applied where files are read."""
    log, path = written(_people(spark, d), "log"), _views_folder(spark)
    a, b, last = _ends(log, 0.3, 0.6)
    _listed(log.unionByName(log.withColumns({"kind": F.lit("Deployment")})), path, a)
    for low, high in ((a + 1, b), (b + 1, last)):
        serve_changes(log, path, low, high)
    return current(since_lists(served(spark, path, parse(_STEPS)).where("kind = 'Pod' and namespace = 'shop'"))).select("name", "seq")


@_query(_STEPS_SQL)
def upkeep_after_gap(spark, d):
    """A list and a watch, then changes that nobody saw: they have gone, and only a newer list and what follows it are served."""
    log, folder = written(_people(spark, d), "log"), _views_folder(spark)
    path = f"{folder}-served"
    a, b, c, last = _ends(log, 0.3, 0.5, 0.8)
    keeper = Maintainer(spark, parse(_STEPS), folder, buckets=8)
    _listed(log, path, a)
    serve_changes(log, path, a + 1, b)
    keeper.follow(watched_stream(spark, path, keeper.config), f"{folder}-checkpoint").awaitTermination()
    Folder(spark, path).delete("lists")
    Folder(spark, path).delete("watches")
    _listed(log, path, c)
    serve_changes(log, path, c + 1, last)
    keeper.follow(watched_stream(spark, path, keeper.config), f"{folder}-checkpoint").awaitTermination()
    return keeper.series("info")


_OWNED = """rules:
  - name: info
    anchor: Pod
    relations: [{name: owner, via: ownerController}, {name: top, via: topController}]
    labels: {pod: {path: metadata.name}, owner: {source: owner, path: metadata.name}, top: {source: top, path: metadata.name, onMissing: none}}
"""


@_query("""SELECT 'shop/order-' || o_orderkey AS anchor_key, 'order-' || o_orderkey AS pod, CASE WHEN o_custkey % 10 = 4 THEN '' ELSE 'customer-' || o_custkey END AS owner,
CASE o_custkey % 10 WHEN 4 THEN 'none' WHEN 5 THEN (SELECT n_name FROM nation WHERE n_nationkey = 0) ELSE n_name END AS top, CAST(1 AS DOUBLE) AS value
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def upkeep_owners(spark, d):
    """Owners that arrive late, go, or get another owner, after a snapshot of their anchors."""
    log = written(shop_log(spark, d), "log")
    which = F.when(F.col("kind") == "ReplicaSet", F.regexp_extract("name", "([0-9]+)$", 1).cast("bigint") % 10).otherwise(-1)
    first = _table(spark, d, "nation").where("n_nationkey = 0").first().n_name
    name = F.col("name")
    moved = F.to_json(F.struct(_meta(name, F.col("uid"), _owner("Deployment", F.lit(first)))))
    later = log.where(which.isin(3, 4, 5)).withColumns({"op": F.when(which == 4, "DELETED").otherwise("MODIFIED"), "rv": F.lit("2"), "seq": F.lit(2).cast("bigint"), "object": F.when(which == 5, moved).otherwise(F.col("object"))})
    keeper = Maintainer(spark, parse(_OWNED), _views_folder(spark), buckets=8)
    keeper.apply(log.where(which != 3))
    keeper.apply(later)
    return keeper.series("info")


@_query("SELECT 'k' || c_custkey AS anchor_key, c_name AS name, '' AS missing, CAST(1 AS DOUBLE) AS value FROM customer WHERE c_custkey BETWEEN 10 AND 60 AND c_custkey <> 33 UNION ALL SELECT 'k33', 'new', '', CAST(1 AS DOUBLE)")
def series_upsert_delete(spark, d):
    rows = _table(spark, d, "customer").select(_named("k", "c_custkey").alias("anchor_key"), F.col("c_name").alias("name"), F.lit("x").alias("extra"), "c_custkey")
    sink = MemorySink(spark)
    sink.register("m", ["name", "missing"])
    sink.write("m", rows.where("c_custkey < 50"))
    sink.upsert("m", rows.where("c_custkey between 40 and 60"))
    sink.delete("m", rows.where("c_custkey < 10"))
    sink.replace("m", rows.where("c_custkey = 33"), rows.where("c_custkey = 33").withColumn("name", F.lit("new")))
    return sink.read("m")


@_query("SELECT 'k' || c_custkey AS anchor_key, c_name AS name, CAST(1 AS DOUBLE) AS value FROM customer WHERE c_custkey >= 20")
def table_sink_restart(spark, d):
    rows, folder = _table(spark, d, "customer").select(_named("k", "c_custkey").alias("anchor_key"), F.col("c_name").alias("name"), "c_custkey"), _views_folder(spark)
    for step in range(4):  # each with a sink of its own, as after a restart
        sink = TableSink(spark, folder)
        sink.register("m", ["name"])
        if step == 0:
            sink.write("m", rows)
        else:
            sink.replace("m", rows.where(F.col("c_custkey") < 20).where(F.col("c_custkey") % 3 == step - 1), rows.limit(0))
    return sink.read("m")


@_query("""SELECT unnest(['# HELP shop_nation Nations.', '# TYPE shop_nation gauge']) AS line UNION ALL SELECT 'shop_nation{name="' || n_name || '"} 1' FROM nation""")
def exposition_page(spark, d):
    return page(_table(spark, d, "nation").select(F.col("n_name").alias("name")), "shop_nation", ["name"], "Nations.")


@_query("""SELECT 'orders' AS metric, 'orders{customer="' || o_custkey || '",status="' || o_orderstatus || '"} 1' AS line FROM orders GROUP BY o_custkey, o_orderstatus
UNION ALL SELECT 'customers', 'customers{name="' || c_name || '"} 1' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT '', '3 ' || ((SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)) + (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0))""")
def page_set(spark, d):
    """Pages that many tasks write, each published by one commit; the second takes the place of the first."""
    path, metrics = _views_folder(spark), [("orders", "Orders."), ("customers", "Customers."), ("none", "Nothing.")]
    orders = _table(spark, d, "orders").select(F.lit("orders").alias("metric"), metric_line("orders", {"customer": F.col("o_custkey").cast("string"), "status": F.col("o_orderstatus")}).alias("line"))
    customers = _table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.lit("customers").alias("metric"), metric_line("customers", {"name": F.col("c_name")}).alias("line"))
    write_pages(orders, path, metrics)
    write_pages(orders.unionByName(customers), path, metrics)
    last = Pages(path).page()
    told = spark.createDataFrame([("", f"{len(last)} {sum(own['lines'] for own in last)}")], "metric string, line string")
    return read_page(spark, path).unionByName(told)


@_query("""SELECT 'quantity' AS family, CAST(l_partkey AS VARCHAR) AS part, bound, CAST(count(*) FILTER (WHERE l_quantity <= bound) AS DOUBLE) AS n, CAST(sum(l_quantity) AS DOUBLE) AS sum, CAST(count(*) AS DOUBLE) AS count
FROM lineitem, (VALUES (5::DOUBLE), (10::DOUBLE), (25::DOUBLE), ('Infinity'::DOUBLE)) b(bound) GROUP BY l_partkey, bound""")
def metric_families(spark, d):
    """Quantities of each part as a histogram, written as pages of metrics text and read again."""
    items, path = _table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("double").alias("quantity")), _views_folder(spark)
    lines = histogram_lines(measures.histogram(items, ["part"], "quantity", (5, 10, 25)), measures.totals(items, ["part"], "quantity"), "quantity", ["part"])
    page = F.coalesce(F.pmod(F.col("part"), F.lit(5)), F.lit(0))  # a part without a key needs the TYPE line of some page, too
    top = spark.range(5).select(F.col("id").cast("int").alias("page"), F.explode(F.array(F.lit("# HELP quantity Of items."), F.lit("# TYPE quantity histogram"))).alias("line"), F.lit(0).alias("at"))
    pages = top.unionByName(lines.select(page.cast("int").alias("page"), "line", F.lit(1).alias("at")))
    pages.repartition("page").sortWithinPartitions("page", "at", "line").select(F.col("line").alias("value")).write.option("maxRecordsPerFile", 0).text(path)  # a page is in one file
    found = histograms(families(text_lines(spark, path))).where("whole")
    return found.select("family", F.col("labels")["part"].alias("part"), F.inline("cells"), "sum", "count").select("family", "part", F.col("at").alias("bound"), "n", "sum", "count")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Metrics text of nations and regions, with comments and blank lines."""
    nation = _table(spark, d, "nation").select(F.concat(metric_line("nations", {"name": F.col("n_name"), "region": F.col("n_regionkey").cast("string")}), F.col("n_nationkey").cast("string")).alias("value"))
    region = _table(spark, d, "region").select(metric_line("regions", {"name": F.col("r_name")}).alias("value"))
    return nation.unionByName(region).unionByName(spark.createDataFrame([("# HELP nations x",), ("",)], "value string"))


@_query("""SELECT 'regions' AS metric, 'regions{name="' || r_name || '"} 1' AS line FROM region""")
def snapshot_allowed(spark, d):
    return snapshot_lines(_lines(spark, d), ["regions", "others"])


@_query("SELECT CAST(count(*) AS BIGINT) AS n FROM nation WHERE n_regionkey IN (1, 3) AND n_name <> 'x'")
def matching_count(spark, d):
    return measures.matching(samples(_lines(spark, d)), "nations", measures.with_labels(F.col("labels"), region=["1", "3"]))


@_query("SELECT CAST('1' || n_nationkey AS DOUBLE) AS value FROM nation WHERE n_regionkey = 2 ORDER BY n_name LIMIT 1")
def first_gauge(spark, d):
    rows = samples(_lines(spark, d)).withColumn("name", F.try_element_at("labels", F.lit("name")))
    return measures.first_gauge(rows, "nations", measures.with_labels(F.col("labels"), region="2"), "name")


@_query("SELECT kind, namespace, name FROM (SELECT 'Deployment' AS kind, 'shop' AS namespace, n_name AS name FROM nation UNION ALL SELECT 'Node', '', r_name FROM region)")
def ordered_keys(spark, d):
    return in_order(shop_log(spark, d).where(F.col("kind").isin("Deployment", "Node")).select("kind", "namespace", "name"))


@_query("SELECT 'shop' AS namespace, 'user-' || min(CAST(user_id AS VARCHAR)) AS name FROM events")
def ready_pod(spark, d):
    conditions = F.array(F.struct(F.lit("Ready").alias("type"), F.when(F.col("event_type").isNull(), "False").otherwise("True").alias("status")))
    pods = _table(spark, d, "events").select(F.lit("Pod").alias("kind"), F.lit("shop").alias("namespace"), _named("user-", "user_id").alias("name"), F.parse_json(F.to_json(F.struct(F.struct(conditions.alias("conditions")).alias("status")))).alias("object"))
    return ready_pods(pods)


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests: the type is the host, the method and code go by the id, and the value counts as milliseconds."""
    k = F.col("event_id") % 4
    method = F.when(k == 0, "get").when(k == 1, "Post").when(k == 2, "DELETE").otherwise("PATCH")
    return _events(spark, d).select("event_id", method.alias("method"), F.when(k == 0, "").when(k == 1, "201").otherwise("x").alias("code"), F.col("event_type").alias("host"), (F.col("value") / 1000).alias("seconds"), F.lit(1).cast("bigint").alias("one"))


@_query("SELECT code, method, event_type AS host, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN '0' WHEN 1 THEN '201' ELSE 'invalid' END AS code, CASE event_id % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'Post' WHEN 2 THEN 'DELETE' ELSE 'PATCH' END AS method FROM events) GROUP BY 1, 2, 3")
def request_counter(spark, d):
    return measures.requests(_calls(spark, d), "code", "method", "host")


_LE = [str(0.001 * 2**k) for k in range(14)]


@_query(f"SELECT event_type AS host, le, CAST(n AS BIGINT) AS n FROM (SELECT event_type, unnest({[*_LE, '+Inf']}) AS le, unnest([{', '.join(f'count(*) FILTER (CAST(value AS DOUBLE) / 1000 <= CAST({b} AS DOUBLE))' for b in _LE)}, count(*)]) AS n FROM events GROUP BY 1)")
def request_latency(spark, d):
    return measures.latencies(_calls(spark, d), ["host"], "seconds")


@_query("SELECT CAST(count(*) AS BIGINT) AS total FROM events WHERE event_id % 4 <> 0")
def write_verbs(spark, d):
    return measures.writes(_calls(spark, d), "method", "one")


@_query("SELECT event_type, CAST(sum(user_id) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def histogram_totals(spark, d):
    return measures.totals(_events(spark, d).withColumn("user_id", F.col("user_id").cast("bigint")), ["event_type"], "user_id")


@_query("SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS depth FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click')")
def queue_depth(spark, d):
    events = _events(spark, d)
    return measures.queue_depth(events, events.where("event_type = 'click'"), ["user_id"])


@_query("SELECT CAST(count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS BIGINT) AS indexed, CAST(count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS BIGINT) AS fallback FROM customer")
def index_lookups(spark, d):
    return measures.index_lookups(_orders(spark, d), _table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("uid")))


@_query("SELECT a.user_id, CAST(a.n - coalesce(b.n, 0) AS BIGINT) AS delta FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) a LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_id < 500 GROUP BY 1) b USING (user_id)")
def resource_deltas(spark, d):
    events = _events(spark, d)
    return measures.deltas(measures.counts(events.where("event_id < 500"), ["user_id"]), measures.counts(events, ["user_id"]), ["user_id"], "n")


@_query("SELECT o_orderkey, CAST(86400.5 AS DOUBLE) AS seconds, strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' AS began FROM orders")
def elapsed_seconds(spark, d):
    began = F.col("o_orderdate").cast("timestamp")
    return _table(spark, d, "orders").select("o_orderkey", measures.elapsed(began, began + F.expr("interval '1 00:00:00.5' day to second")).alias("seconds"), measures.stamp(began).alias("began"))


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS anchor_key FROM orders WHERE o_custkey % 5 = 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE FALSE")
def late_parent(spark, d):
    """Anchors that missed their parent are found by its key, without a rescan."""
    orders = _table(spark, d, "orders")
    key = F.struct(F.lit("ReplicaSet").alias("kind"), F.lit("shop").alias("namespace"), _named("customer-", "o_custkey").alias("name"))
    deps = orders.select(F.col("o_orderkey").cast("string").alias("anchor_key"), F.lit("Pod").alias("anchor_kind"), F.lit(None).cast("string").alias("parent_uid"), key.alias("wanted"))
    added = _table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.lit("ReplicaSet").alias("kind"), F.lit("shop").alias("namespace"), _named("customer-", "c_custkey").alias("name"), F.lit("new").alias("uid"))
    return incremental.affected(deps, added).select("anchor_key")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in _CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _CATALOGUE.items()}
