"""Catalogue CSV files and cleaned-table sinks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..config import MISSING_TOKENS
from ..functions.text import drop_control_characters

# Row numbers restart in every scan task; the task part of the id is cut off.
_ROW_BITS = (1 << 33) - 1


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *, multi_line: bool = True) -> DataFrame:
    """One CSV path, every column as text, plus an ``ordinal`` in file order.

    Columns are taken from the header by name, so files may hold further ones.
    ``ordinal`` sorts by file name, then by position: the byte offset of the
    split plus the row number inside the scan task.  A task reads at most one
    split's worth of bytes and every row has at least one, so positions of one
    split stay below the offset of the next one, however Spark packs splits.

    ``multi_line`` allows line breaks inside quotes but makes a file one split;
    large catalogues without them should pass ``False`` to be read in parallel.
    """
    header = spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"').columns
    missing = [name for name in schema.fieldNames() if name not in header]
    required = [name for name in missing if name in _REQUIRED]
    if required:
        raise ValueError(f"{path}: missing columns {required}")
    file_schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    rows = (
        spark.read.schema(file_schema)
        .option("enforceSchema", True)
        .csv(path, header=True, multiLine=multi_line, quote='"', escape='"', encoding="UTF-8")
        .select(
            "*",
            F.struct(
                F.col("_metadata.file_name").alias("file"),
                (F.col("_metadata.file_block_start")
                 + F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))).alias("position"),
            ).alias("ordinal"),
        )
    )
    columns = [F.col(n) if n in header else F.lit(None).cast("string").alias(n) for n in schema.fieldNames()]
    return rows.select(*columns, "ordinal")


# Columns no later step can do without.
_REQUIRED = {
    "company_id", "company_name", "short_description", "long_description", "tags", "country", "year_founded",
    "id", "entity_type", "name", "description", "overview", "category_code", "tag_list", "country_code", "founded_at",
}


def read_snapshots(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType, *, multi_line: bool = True,
) -> DataFrame:
    """Several snapshots on top of each other; earlier paths come first in ``ordinal``."""
    parts = [
        read_csv(spark, path, schema, multi_line=multi_line).withColumn(
            "ordinal",
            F.struct(
                F.lit(n).alias("snapshot"), F.col("ordinal.file").alias("file"),
                F.col("ordinal.position").alias("position"),
            ),
        )
        for n, path in enumerate(paths)
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def normalise_missing(df: DataFrame, tokens: Iterable[str] = MISSING_TOKENS) -> DataFrame:
    """Turn missing-value tokens of all text columns into nulls."""
    tokens = list(tokens)
    changed = {
        f.name: F.when(~F.col(f.name).isin(tokens), F.col(f.name))
        for f in df.schema.fields if isinstance(f.dataType, T.StringType)
    }
    return df.withColumns(changed)


def rename_columns(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(renames)


def first_rows(df: DataFrame, order_by: str | Sequence[str], limit: int | None) -> DataFrame:
    """The first ``limit`` rows by a unique key; ``None`` keeps everything."""
    if limit is None:
        return df
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*keys).limit(limit)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Cleaned table as Parquet (default), CSV or JSON lines."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.csv(path, header=True, quote='"', escape='"')
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def sanitise_for_export(df: DataFrame) -> DataFrame:
    """Null to empty and control characters out of every text column."""
    return df.withColumns({
        f.name: drop_control_characters(f.name)
        for f in df.schema.fields if isinstance(f.dataType, T.StringType)
    })
