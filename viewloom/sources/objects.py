"""Objects from files and tables: scans by kind and scope, selectors, change logs, metrics text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.functions.selectors import field_selector, label_selector, object_fields, object_labels
from viewloom.model import Config, Watched
from viewloom.operators.resolve import lookup_namespace, with_parent
from viewloom.operators.state import KEY, TIE, latest

#: Columns of a change log.
LOG = "kind string, namespace string, name string, uid string, rv string, op string, seq bigint, object string"


def read_log(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A change log at rest; ``form`` is parquet, json or another format of the reader."""
    return spark.read.schema(LOG).format(form).load(path)


def stream_log(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A change log as a stream of files."""
    return spark.readStream.schema(LOG).format(form).load(path)


def log_from_json(objects: DataFrame, column: str = "value", seq: str | None = None) -> DataFrame:
    """A change log of ADDED rows from a column of JSON objects; ``seq`` names a column that orders them."""
    v = F.try_parse_json(column)

    def get(path: str) -> Column:
        return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))

    return objects.select(get("$.kind").alias("kind"), get("$.metadata.namespace").alias("namespace"), get("$.metadata.name").alias("name"), get("$.metadata.uid").alias("uid"), get("$.metadata.resourceVersion").alias("rv"), F.lit("ADDED").alias("op"), (F.col(seq) if seq else F.lit(0)).cast("bigint").alias("seq"), F.col(column).alias("object"))


def fits(watched: Watched) -> Column:
    """Whether an object of a state (``object`` is VARIANT) is of a watched kind and let through by its scope and selectors."""
    ok = F.col("kind") == watched.kind
    if watched.namespaces:
        ok &= F.col("namespace").isin(*watched.namespaces)
    if watched.label_selector:
        ok &= label_selector(watched.label_selector, object_labels(F.col("object")))
    if watched.field_selector:
        ok &= field_selector(watched.field_selector, watched.kind, object_fields(F.col("object")))
    return ok


def selected(state: DataFrame, *watched: Watched) -> DataFrame:
    """Objects that any of ``watched`` lets through, by one predicate over one pass."""
    return state.where(reduce(Column.__or__, map(fits, watched)))


def current(log: DataFrame, config: Config | None = None) -> DataFrame:
    """Current state of a change log: its columns but op, object as VARIANT, and the key of each object's controller.

    The last version of each key counts; deleted ones go, then those that are not watched. A row without ``seq`` is older
    than any with one, and rows of equal ``seq`` go by version and digest. A row without ``op`` is a change like any other.
    """
    kinds = sorted(config.watched_kinds()) if config else None
    rows = log.where(F.col("kind").isin(*kinds)) if kinds else log
    last = with_parent(latest(rows, KEY, "seq", "rv", TIE).where("op is null or op <> 'DELETED'")).withColumn("object", F.try_parse_json("object")).drop("op")
    return selected(last, *config.watched()) if config else last


def dry_run(state: DataFrame, config: Config) -> None:
    """Fails early on selectors that cannot run: each is compiled and analysed, and one row is asked for."""
    for w in config.watched():
        if w.label_selector or w.field_selector:
            selected(state, w).limit(1).count()


#: A sample line of metrics text: the metric, its labels in braces if there are any, the value, and perhaps a time in milliseconds.
_SAMPLE = r'^([A-Za-z_:][A-Za-z0-9_:]*)(?:\s*\{((?:\s*[A-Za-z_][A-Za-z0-9_]*\s*=\s*"(?:[^"\\]|\\.)*"\s*,?)*)\s*\}\s*|\s+)([^\s{]\S*)(?:\s+(-?[0-9]+))?$'
_LABEL = r'([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'


def samples(lines: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """(metric, labels, value, time) of the sample lines of metrics text, escapes in label values read; ``time`` is null where the line has none.

    Comments, blank lines and null ones are left out, and so is what is no sample. Of a label that stands twice the last one counts.
    Columns in ``keep`` stay.
    """
    line = F.trim(F.col(column), F.lit(" \t\r"))
    rows = lines.where((line != "") & ~line.startswith("#") & line.rlike(_SAMPLE))
    braces = F.regexp_extract(line, _SAMPLE, 2)

    def plain(value: Column) -> Column:  # a backslash pair is set aside first, so that what follows it is not taken for an escape
        aside = F.replace(value, F.lit("\\\\"), F.lit("\0"))
        return F.replace(F.replace(F.replace(aside, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\0"), F.lit("\\"))

    names, values = (F.regexp_extract_all(braces, F.lit(_LABEL), F.lit(k)) for k in (1, 2))
    pairs = F.arrays_zip(names.alias("name"), F.transform(values, plain).alias("text"))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["name"].alias("name"), p["text"].alias("text"), i.alias("i"))), lambda p: p["i"] == F.array_size(names) - F.array_position(F.reverse(names), p["name"]))
    value = F.regexp_extract(line, _SAMPLE, 3)
    number = F.when(F.lower(value).isin("+inf", "inf"), F.lit(float("inf"))).when(F.lower(value) == "-inf", F.lit(float("-inf"))).when(F.lower(value) == "nan", F.lit(float("nan"))).otherwise(value.try_cast("double"))
    labels = F.map_from_entries(F.transform(last, lambda p: F.struct(p["name"], p["text"])))
    return rows.select(*(keep or []), F.regexp_extract(line, _SAMPLE, 1).alias("metric"), labels.alias("labels"), number.alias("value"), F.regexp_extract(line, _SAMPLE, 4).try_cast("bigint").alias("time"))


def ready(value: Column) -> Column:
    """Whether an object has a condition Ready that is True."""
    conditions = F.try_variant_get(value, "$.status.conditions", "array<variant>")
    return F.coalesce(F.exists(conditions, lambda c: (F.try_variant_get(c, "$.type", "string") == "Ready") & (F.try_variant_get(c, "$.status", "string") == "True")), F.lit(False))


def lookup(state: DataFrame, keys: DataFrame) -> DataFrame:
    """The objects of ``keys`` (kind, namespace, name); what is found under no namespace may be asked for by any."""
    own = keys.select("kind", lookup_namespace(F.col("kind"), F.col("namespace")).alias("namespace"), "name").distinct()
    return state.join(own, KEY, "left_semi")


def in_order(rows: DataFrame) -> DataFrame:
    """Objects or keys by kind, namespace and name."""
    return rows.orderBy(*KEY)


def ready_pods(state: DataFrame, most: int = 1) -> DataFrame:
    """(namespace, name): the first ``most`` Pods by name whose condition Ready is True."""
    return state.where((F.col("kind") == "Pod") & ready(F.col("object"))).select("namespace", "name").orderBy("namespace", "name").limit(most)
