"""Records to labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..config import DOCUMENT_FIELDS, METADATA_FIELDS
from ..functions.text import strip
from ..session import materialise
from .clean import computed_once


def _as_text(df: DataFrame, name: str, float_years: bool) -> Column:
    """A value as document text: booleans as words, null as empty."""
    c, dtype = F.col(name), df.schema[name].dataType
    if isinstance(dtype, T.BooleanType):
        c = F.initcap(c.cast("string"))
    elif float_years and name == "founded_year":
        c = c.cast("double").cast("string")
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def document_text(values: dict[str, Column], fields=DOCUMENT_FIELDS) -> Column:
    """``Label: value`` lines in fixed order, empty values skipped."""
    return F.concat_ws("\n", *[
        F.when(values[name] != "", F.concat(F.lit(f"{label}: "), values[name])) for name, label in fields
    ])


def document_metadata(values: dict[str, Column], fields=METADATA_FIELDS) -> Column:
    """Map of metadata values, all as text."""
    return F.create_map(*[x for name in dict.fromkeys(fields) for x in (F.lit(name), values[name])])


def build_documents(df: DataFrame, id_col: str = "startup_id", float_years: bool = False) -> DataFrame:
    """``doc_id, text, metadata`` plus the metadata as flat columns.

    Records without any document value are dropped.  The flat copies carry the
    filters: predicates on them reach the Parquet scan, predicates on map
    values do not.
    """
    names = list(dict.fromkeys([*[name for name, _ in DOCUMENT_FIELDS], *METADATA_FIELDS]))
    stripped = computed_once(
        df.select(F.col(id_col).alias("doc_id"), *names),
        {f"value_{name}": _as_text(df, name, float_years) for name in names},
    )
    values = {name: F.col(f"value_{name}") for name in names}
    filled = F.lit(False)
    for name, _ in DOCUMENT_FIELDS:
        filled = filled | (values[name] != "")
    return stripped.filter(filled).select(
        "doc_id", document_text(values).alias("text"), document_metadata(values).alias("metadata"),
        *[values[name].alias(f"meta_{name}") for name in dict.fromkeys(METADATA_FIELDS)],
    )


def dense_ids(df: DataFrame, order_by: str, out: str = "position") -> DataFrame:
    """Consecutive numbers from 0 in the order of a unique key.

    Rows are range partitioned and sorted, numbered inside each partition, and
    shifted by the row counts of the partitions before it.  Only the key and
    the number are written to the shared folder in between, so both passes see
    the same partition borders even if executors are lost.
    """
    numbered = materialise(
        df.select(order_by)
        .repartitionByRange(order_by)
        .sortWithinPartitions(order_by)
        .select(
            order_by,
            F.spark_partition_id().alias("__part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__row"),
        ),
        "positions",
    )
    # One row per partition from here on: small whatever the table holds.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbered.groupBy("__part").count().select(
        "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset")
    )
    ids = numbered.join(F.broadcast(offsets), "__part").select(
        order_by, (F.col("__offset") + F.col("__row")).alias(out)
    )
    return df.join(ids, order_by)


def where(df: DataFrame, conditions: dict[str, object] | None) -> DataFrame:
    """Equality filter on metadata, all conditions together.

    Keys are looked up as flat columns first (``meta_<key>`` or ``<key>``) and
    in the metadata map otherwise.
    """
    for key, value in (conditions or {}).items():
        if f"meta_{key}" in df.columns:
            df = df.filter(F.col(f"meta_{key}") == F.lit(value))
        elif key in df.columns:
            df = df.filter(F.col(key) == F.lit(value))
        elif "metadata" in df.columns:
            df = df.filter(F.col("metadata")[key] == F.lit(value))
        else:
            raise ValueError(f"no column for filter key {key!r}")
    return df
