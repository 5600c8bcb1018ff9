"""Two raw catalogues to one cleaned, flagged table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import (
    ACCELERATOR_SOURCE, MISSING_TOKENS, REGISTRY_ENTITY_TYPE, REGISTRY_SOURCE, CleanConfig,
)
from ..operators.clean import clean_accelerator, clean_registry, cleaning_report, flag_suspicious, unify
from ..schemas import ACCELERATOR_RAW, REGISTRY_RAW
from ..sources.catalog import normalise_missing, read_csv, read_snapshots, write_table


@dataclass(frozen=True)
class Preprocessed:
    accelerator: DataFrame
    registry: DataFrame
    unified: DataFrame
    report: DataFrame


def raw_counts(raw: DataFrame, source: str, entity_type: str | None = None) -> DataFrame:
    kept = F.count(F.lit(1)) if entity_type is None else F.count_if(F.col("entity_type") == entity_type)
    return raw.agg(F.count(F.lit(1)).alias("raw_rows"), kept.alias("entity_rows")).withColumn("source", F.lit(source))


def preprocess(
    spark: SparkSession, accelerator_paths: Sequence[str], registry_path: str, *,
    cfg: CleanConfig = CleanConfig(), mode: str = "intended", as_of_year: int | None = None,
    missing: Iterable[str] = MISSING_TOKENS, multi_line: bool = True,
) -> Preprocessed:
    """Read, clean, deduplicate within each source, unify and flag.

    Everything is one lazy lineage; write the tables before using them often.
    """
    missing = list(missing)
    acc_raw = normalise_missing(read_snapshots(spark, accelerator_paths, ACCELERATOR_RAW, multi_line=multi_line), missing)
    reg_raw = normalise_missing(read_csv(spark, registry_path, REGISTRY_RAW, multi_line=multi_line), missing)
    # One ordinal shape for both, so that the union keeps a total order.
    reg_raw = reg_raw.withColumn("ordinal", F.struct(
        F.lit(len(accelerator_paths)).alias("snapshot"), F.col("ordinal.file"), F.col("ordinal.position"),
    ))
    accelerator = flag_suspicious(clean_accelerator(acc_raw, cfg), as_of_year, cfg)
    registry = flag_suspicious(clean_registry(reg_raw, cfg, mode=mode), as_of_year, cfg)
    unified = unify(accelerator, registry)
    counts = raw_counts(acc_raw, ACCELERATOR_SOURCE).unionByName(
        raw_counts(reg_raw, REGISTRY_SOURCE, REGISTRY_ENTITY_TYPE)
    )
    return Preprocessed(accelerator, registry, unified, cleaning_report(counts, unified))


def write_preprocessed(result: Preprocessed, path: str, fmt: str = "parquet") -> None:
    """Write the unified table, and the two source tables out of it."""
    root = path.rstrip("/")
    spark = result.unified.sparkSession
    ordered = result.unified if fmt == "parquet" else result.unified.drop("ordinal")
    write_table(ordered, f"{root}/startups_unified", fmt)
    if fmt == "parquet":
        stored = spark.read.parquet(f"{root}/startups_unified")
        write_table(stored.filter(F.col("source") == ACCELERATOR_SOURCE), f"{root}/accelerator_cleaned", fmt)
        write_table(stored.filter(F.col("source") == REGISTRY_SOURCE), f"{root}/registry_cleaned", fmt)
    else:
        write_table(result.accelerator.drop("ordinal"), f"{root}/accelerator_cleaned", fmt)
        write_table(result.registry.drop("ordinal"), f"{root}/registry_cleaned", fmt)
