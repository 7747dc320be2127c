"""Which changes of a stream are news, with the version before: keyed state over micro-batches and restarts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType


def _frames(rows: list[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as one frame of plain objects, none if there are no rows: changing its types and masks would take most of a key's time."""
    if rows:
        yield pd.DataFrame(rows, columns=columns, dtype=object)


def admitted_stream(log: DataFrame, keys: list[str], seq: str, version: str) -> DataFrame:
    """(keys, seq, version, old_<version>): rows of a stream that change something, as ``operators.state.admitted`` has them.

    The first row of a key is admitted, and so are those of another version than the row before and those of no known
    version; versions are compared for equality only. A key's state is its last place and version, so it is small however
    long the key's history is. In a micro-batch rows go by ``seq``, unknown places first; a row that stands before or at the
    last place seen of its key is late or repeated, and left out. Other columns are left out. Keys may be null.
    """
    fields = {f.name: f for f in log.schema}
    if fields[seq].dataType.typeName() not in ("long", "integer", "short"):
        raise ValueError(f"{seq} is not a whole number")
    rows = log.select(*keys, F.col(seq).cast("bigint").alias(seq), F.col(version).cast("string").alias(version))
    out = StructType([*(fields[k] for k in keys), *rows.select(seq, version).schema.fields, StructField(f"old_{version}", rows.schema[version].dataType)])
    columns = out.names

    def news(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, old = state.get if state.exists else (None, None)
        first = not state.exists
        batch = [(s, v) for part in parts for s, v in zip(part[seq].tolist(), part[version].tolist(), strict=True)]
        batch = [(None if pd.isna(s) else int(s), None if v is None or v != v else v) for s, v in batch]
        found, own = [], tuple(None if k is None or k != k else k for k in key)
        for place, now in sorted(batch, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
            if last is not None and (place is None or place <= last):
                continue
            if first or now is None or old is None or now != old:
                found.append((*own, place, now, old))
            first, old = False, now
            last = place if place is not None else last
        state.update((last, old))
        yield from _frames(found, columns)

    return rows.groupBy(*keys).applyInPandasWithState(news, out, "last bigint, old string", "append", GroupStateTimeout.NoTimeout)
