"""Views kept current from a stream of changes.

State, dependencies, the index of parents and series are tables that change by layers (``sources.layers``). A batch costs
what it touches:

1. The changed keys' old rows are looked up in their buckets; a batch that brings nothing newer ends here, without a version.
   Before any version there is nothing to look up: the state is written and views are made from it.
2. The index of parents, posting lists by uid or by the key of a parent that was missed, gives the anchors that depend on
   what changed; only the buckets of these parents are opened.
3. The affected anchors are looked up, and then their owners, hop by hop; chains of other anchors are not followed again.
4. Rules are evaluated over what was found, which is all that they can read. The differences go to the index, and the
   rows of the affected anchors to the series.

A version is published at once, by compare-and-swap: a reader never sees half a batch, a batch that fails is done again from
the version before, and of two writers the slower one does its batch again on top of the other's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from viewloom.functions.text import object_key
from viewloom.model import KINDS, Config
from viewloom.operators.incremental import union
from viewloom.operators.resolve import DEFAULT_HOPS, PARENT, lookup_namespace, with_parent
from viewloom.operators.rules import hops_of, paths_of, texts_of
from viewloom.operators.state import KEY, TIE, latest, order_of
from viewloom.plans.engine import Views, index
from viewloom.sources.layers import Layers, Version, Versions
from viewloom.sources.objects import selected
from viewloom.sources.places import Folder
from viewloom.sources.served import LISTED, UNREADABLE, gone, since_lists, unreadable

_STATE = "kind string, namespace string, name string, uid string, rv string, op string, seq bigint, tie bigint, digest bigint, object variant, parent_kind string, parent_ns string, parent_name string"
#: What an anchor depends on, by anchor and by parent. A parent is ``u:`` and a uid, or ``k:`` and the key of one that was missed.
_DEPS = "anchor_kind string, anchor_ns string, anchor_name string, parent string"
_ANCHOR = ["anchor_kind", "anchor_ns", "anchor_name"]
_METRICS = "version int, changed bigint, admitted bigint, indexed bigint, fallback bigint, anchors bigint"
#: Versions whose numbers are kept.
NOTES = 1000


class Maintainer:
    """Applies change logs to the views of a configuration, in a folder that all executors share.

    The last row counts for each key (``order_of``), in whatever order rows arrive: deleted keys stay as tombstones, so an
    older row cannot bring them back. Dependencies hold, besides the uids along each anchor's chain, the key of a parent
    that was looked for and missed, so a parent that arrives late finds its anchors by the index and no rescan of its
    namespace is needed. Rows with a null name or namespace count as having an empty one; rows of kinds that are not
    watched are left out. ``buckets`` is how finely tables are cut: a look-up opens at most as many as it has keys.
    """

    def __init__(self, spark: SparkSession, config: Config, folder: str, *, hops: int = DEFAULT_HOPS, buckets: int = 64):
        self.spark, self.config, self.hops = spark, config, hops
        self.folder = Folder(spark, folder)
        self.versions = Versions(self.folder)
        place = {"k": F.col("kind"), "ns": lookup_namespace(F.col("kind"), F.col("namespace")), "n": F.col("name")}
        self.state = Layers(spark, self.folder, "state", _STATE, KEY, buckets, place)
        self.deps = Layers(spark, self.folder, "deps", _DEPS, _ANCHOR, buckets)
        self.parents = Layers(spark, self.folder, "parents", _DEPS, [*_ANCHOR, "parent"], buckets, {"parent": F.col("parent")})
        self.tables = {config.metric(r): Layers(spark, self.folder, f"series-{config.metric(r)}", self._schema(r.label_names()), ["anchor_key"], buckets) for r in config.rules}

    def _schema(self, labels: list[str]) -> str:
        return ", ".join(["anchor_key string", *(f"`{n}` string" for n in labels), "value double"])

    def version(self) -> int:
        """The last published version; 0 before any."""
        return max(self.versions.numbers(), default=0)

    def series(self, metric: str) -> DataFrame:
        """The current rows of a metric."""
        return self.tables[metric].read(self.versions.now())

    def metrics(self) -> DataFrame:
        """For each of the last ``NOTES`` versions: changed keys, those admitted, parents that the index knew and did not know, anchors done again."""
        return self.spark.createDataFrame([tuple(n) for n in self.versions.now().notes], _METRICS)

    def moving_kinds(self) -> list[str]:
        """Kinds whose changes can change a view: anchors, and any kind if a rule follows owners, since all can stand on a chain."""
        walks = any(hops_of(r, self.hops) for r in self.config.rules)
        return [k for k in KINDS if walks or any(r.anchor == k for r in self.config.rules)]

    def _kept(self, rows: DataFrame, label: str = "rows") -> DataFrame:
        """A table that only this batch reads, so that no plan grows over another."""
        path = self.folder.path(f"{self._place}/{uuid.uuid4().hex}-{label}")
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def apply(self, log: DataFrame) -> bool:
        """One batch of changes (columns of LOG, or what ``served`` or ``watched`` give); False if it brings nothing newer. Applied twice, it changes nothing.

        A list in the batch deletes what the state holds of its scope and the list lacks; this reads the whole state once.
        Lines that could not be read are set aside (``dead``), and hold nothing up.
        """
        self._place = f"batch-{uuid.uuid4().hex}"
        try:
            if "listed" not in log.columns:
                return self.versions.commit(lambda version: self._fill(version, log))
            rows = self._kept(log, "served")
            ops = {r.op for r in rows.where(F.col("op").isin(LISTED, UNREADABLE)).select("op").distinct().collect()}
            if UNREADABLE in ops:
                unreadable(rows).write.parquet(self.folder.path(f"dead/{uuid.uuid4().hex}"))
            changes = since_lists(rows)
            return self.versions.commit(lambda version: self._fill(version, changes.unionByName(self._gone(version, rows)) if LISTED in ops else changes))
        finally:
            self.folder.delete(self._place)

    def _gone(self, version: Version, rows: DataFrame) -> DataFrame:
        return gone(rows, self.state.read(version).where(~F.col("op").eqNullSafe("DELETED")).select(*KEY, "uid", "seq"))

    def dead(self) -> DataFrame:
        """(kind, namespace, line): lines that could not be read, each once."""
        names = self.folder.names("dead")
        schema = "kind string, namespace string, line string"
        return self.spark.read.schema(schema).parquet(*(self.folder.path(f"dead/{n}") for n in names)).distinct() if names else self.spark.createDataFrame([], schema)

    def _fill(self, version: Version, log: DataFrame) -> bool:
        plain = log.withColumns({c: F.coalesce(c, F.lit("")) for c in ("namespace", "name")}).where(F.col("kind").isin(*sorted(self.config.watched_kinds())))
        last = latest(with_parent(plain).withColumn("tie", F.xxhash64(*TIE)), KEY, "seq", "rv", TIE)
        last = last.withColumns({"digest": F.xxhash64("object"), "object": F.when(~F.col("op").eqNullSafe("DELETED"), F.try_parse_json("object"))})
        last = last.select(*(c.split()[0] for c in _STATE.split(", ")))
        if not version.layers:
            return self._first(version, last)
        last = self._kept(last)
        prior = self.state.at(version, last.select(*(v.alias(c) for c, v in self.state.by.items()))).join(last.select(*KEY), KEY, "left_semi")
        prior = self._kept(prior.drop("object", *PARENT))
        if prior.isEmpty():  # all keys are new: whole objects are neither joined nor written once more
            new = last.withColumn("same", F.lit(False))
        else:
            before = prior.select(*KEY, F.struct(order_of([], "seq", "rv", F.col("tie")).alias("at"), "op", "rv", "digest").alias("old"))
            newer = last.join(before, KEY, "left").where(F.col("old").isNull() | (order_of([], "seq", "rv", F.col("tie")) > F.col("old.at")))
            # a new version of the same content is taken into the state, but asks for no work
            same = F.col("old.rv").eqNullSafe(F.col("rv")) & (F.col("digest") == F.col("old.digest")) & ~F.col("op").eqNullSafe("DELETED") & ~F.col("old.op").eqNullSafe("DELETED")
            new = self._kept(newer.withColumn("same", F.coalesce(same, F.lit(False)) & F.col("old").isNotNull()).drop("old"))
        if new.isEmpty():
            return False
        work = new.where(~F.col("same") & F.col("kind").isin(*self.moving_kinds()))
        # old and new versions of what changed: an object may leave a selector, change its owner or its uid
        touched = self._kept(prior.join(work, KEY, "left_semi").select(*KEY, "uid").unionByName(work.select(*KEY, "uid")).distinct())
        self.state.put(version, new.drop("same"), new)
        hit, asked, known = self._affected(version, touched)
        near = self._near(version, hit)
        views = Views(self.config, near, hops=self.hops, keep=self._kept)
        self._reindex(version, hit, views)
        for metric, rule in views.rules.items():
            mine = hit.where(F.col("anchor_kind") == rule.anchor).select("anchor_key")
            self.tables[metric].put(version, self._kept(views.of(metric, mine)), mine)
        sizes = [rows.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, rows in enumerate((last, work, asked, known, hit))]
        changed, admitted, asked_n, indexed, anchors = (r.n for r in sorted(union(sizes).collect()))
        version.notes = [*version.notes, [version.number, changed, admitted, indexed, asked_n - indexed, anchors]][-NOTES:]
        return True

    def _first(self, version: Version, last: DataFrame) -> bool:
        """The first batch: all anchors are affected and no group is in any table, so nothing is looked up or compared, and whole objects are written once."""
        self.state.fill(version, last)
        if not version.layers:
            return False
        state, moves = self.state.read(version), F.col("kind").isin(*self.moving_kinds())
        anchor = F.col("kind").isin(*{r.anchor for r in self.config.rules})
        live = selected(state.where(moves & ~F.col("op").eqNullSafe("DELETED")), *self.config.watched())
        views = Views(self.config, self._kept(self._read(live)), hops=self.hops, keep=self._kept)
        self.deps.fill(version, self._parents(views))
        self.parents.fill(version, self.deps.read(version))
        for metric in views:
            self.tables[metric].fill(version, views[metric])
        numbers = (F.count("*"), F.count_if(moves), F.lit(0), F.countDistinct(F.when(moves, F.col("uid"))), F.count_if(anchor))
        version.notes = [*version.notes, [version.number, *state.agg(*(n.alias(f"n{k}") for k, n in enumerate(numbers))).first()]][-NOTES:]
        return True

    def _read(self, rows: DataFrame) -> DataFrame:
        """State rows with what rules read of their objects; whole objects stay if some rule expands an array."""
        whole = any(r.for_each for r in self.config.rules)
        return rows.withColumn("texts", texts_of(paths_of(*self.config.rules))).drop("op", "digest", "tie", *([] if whole else ["object"]))

    def _parents(self, views: Views) -> DataFrame:
        """What anchors depend on (_DEPS), each parent once."""
        parent = F.coalesce(F.concat(F.lit("u:"), "parent_uid"), F.concat(F.lit("k:"), F.to_json("wanted")))
        return index(self.config, views.state, hops=self.hops, found=views).select("anchor_kind", F.col("namespace").alias("anchor_ns"), F.col("name").alias("anchor_name"), parent.alias("parent"))

    def _affected(self, version: Version, touched: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Anchors that depend on what was touched, or are it; its uids; and those of them that the index knows."""
        uids = touched.where("uid is not null").select(F.concat(F.lit("u:"), "uid").alias("parent")).distinct()
        keys = touched.select(F.concat(F.lit("k:"), F.to_json(F.struct("kind", lookup_namespace(F.col("kind"), F.col("namespace")).alias("namespace"), "name"))).alias("parent"))
        found = self._kept(self.parents.at(version, uids.unionAll(keys)))
        anchors = touched.where(F.col("kind").isin(*{r.anchor for r in self.config.rules})).select(F.col("kind").alias("anchor_kind"), F.col("namespace").alias("anchor_ns"), F.col("name").alias("anchor_name"))
        hit = found.select(*_ANCHOR).unionByName(anchors).distinct().withColumn("anchor_key", object_key(F.col("anchor_ns"), F.col("anchor_name")))
        return self._kept(hit), uids, found.where("parent like 'u:%'").select("parent").distinct()

    def _near(self, version: Version, hit: DataFrame) -> DataFrame:
        """The live objects of anchors and of all that stands above them; each round opens the buckets of the owners that it looks for."""
        watched = self.config.watched()

        def live(keys: DataFrame, kinds: set[str]) -> DataFrame:
            return self.state.at(version, keys, lambda rows: self._read(selected(rows.where(F.col("kind").isin(*kinds) & ~F.col("op").eqNullSafe("DELETED")), *watched)))

        place = {"k": F.col("kind"), "ns": lookup_namespace(F.col("kind"), F.col("namespace")), "n": F.col("name")}
        wanted = hit.select(F.col("anchor_kind").alias("k"), lookup_namespace(F.col("anchor_kind"), F.col("anchor_ns")).alias("ns"), F.col("anchor_name").alias("n"))
        found = self._kept(live(wanted, {r.anchor for r in self.config.rules}))
        rows, seen = found, wanted
        for _ in range(self.hops if any(hops_of(r, self.hops) for r in self.config.rules) else 0):
            above = found.where(F.col("parent_name").isNotNull()).select(*(F.col(p).alias(c) for p, c in zip(PARENT, place, strict=True))).distinct()
            above = self._kept(above.join(seen, list(place), "left_anti"))
            kinds = {r.k for r in above.select("k").distinct().collect()}  # some of KINDS
            if not kinds:
                break
            found = self._kept(live(above, kinds))
            rows, seen = rows.unionByName(found), seen.unionByName(above)
        return rows

    def _reindex(self, version: Version, hit: DataFrame, views: Views) -> None:
        """Puts what affected anchors depend on now in place of what they did; the index takes just the differences."""
        fresh = self._kept(self._parents(views).join(hit.select(*_ANCHOR), _ANCHOR, "left_semi"))
        old = self._kept(self.deps.at(version, hit))
        both = [*_ANCHOR, "parent"]
        self.deps.put(version, fresh, hit)
        added, lost = fresh.join(old, both, "left_anti"), old.join(fresh, both, "left_anti")
        self.parents.put(version, self._kept(added), self._kept(added.unionByName(lost)))

    def follow(self, log: DataFrame, checkpoint: str, *, snapshot: DataFrame | None = None, **trigger) -> StreamingQuery:
        """Applies a stream of changes, batch by batch; ``trigger`` is that of the stream writer.

        ``snapshot`` is a change log at rest that comes first: the stream starts when its version is complete. A restart
        that has a version already leaves it out.
        """
        if snapshot is not None and not self.version():
            self.apply(snapshot)

        def batch(rows: DataFrame, _: int) -> None:
            self.apply(rows)

        return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def change_lines(log: DataFrame) -> DataFrame:
    """(kind, namespace, name, seq, old, new) of changes to an object's images, phase or version; for printing."""
    from viewloom.operators.state import versions

    v = F.try_parse_json("object")
    containers = F.coalesce(F.try_variant_get(v, "$.spec.containers", "array<variant>"), F.array().cast("array<variant>"))
    images = F.array_join(F.transform(containers, lambda c: F.concat_ws(":", F.try_variant_get(c, "$.name", "string"), F.try_variant_get(c, "$.image", "string"))), ",")
    shown = log.withColumn("new", F.concat_ws(" ", images, F.try_variant_get(v, "$.status.phase", "string"), F.col("rv")))
    return versions(shown, KEY, "seq", ["new"]).withColumnRenamed("old_new", "old").where("old is null or old <> new").select(*KEY, "seq", "old", "new")
