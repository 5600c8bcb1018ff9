"""Replies of text models by content: every distinct prompt is asked for once.

A reply is stored under the hash of the model's version and the prompt.  A run
asks the model only for prompts that are not stored, each distinct one once, and
appends what came back; failed calls are reported and stay out, so they are
tried again by the next run.  Stored replies are met by a measured set of keys.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import SizeLimits
from ..session import materialise
from .inference import TextModel, batch_complete
from .sizing import broadcast_if_small


@dataclass(frozen=True)
class ReplyStore:
    """Location of stored replies, and the version of the model that they come from."""

    spark: SparkSession
    path: str
    version: str = "1"
    limits: SizeLimits = SizeLimits()

    def _table(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"

    def _exists(self) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._table("runs"))
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def runs(self) -> DataFrame:
        """``run, prompts``: how many distinct prompts each run has asked the model for, in order."""
        return self.spark.read.parquet(self._table("runs")).select("run", "prompts")

    def _known(self) -> DataFrame:
        labels = [r["label"] for r in self.spark.read.parquet(self._table("runs")).select("label").distinct().collect()]
        base = self._table("replies")
        return self.spark.read.option("basePath", base).parquet(*[f"{base}/label={x}" for x in labels]).select("key", "reply")

    def complete(self, df: DataFrame, prompt: Column, model: TextModel, out: str, error: str | None = None, batch_rows: int = 64) -> DataFrame:
        """Add the reply to ``prompt`` and, where a call failed, the error; a null prompt has neither."""
        error = error or f"{out}_error"
        keyed = materialise(df.withColumn("__prompt", prompt).withColumn("__key", F.when(
            F.col("__prompt").isNotNull(), F.sha2(F.concat(F.lit(f"{self.version}\n"), F.col("__prompt")), 256))), "prompts")
        asked = keyed.filter(F.col("__key").isNotNull()).groupBy(F.col("__key").alias("key")).agg(F.first("__prompt").alias("prompt"))
        first = not self._exists()
        # Stored replies of the asked keys, then the prompts that have none.
        keys = None if first else broadcast_if_small(keyed.filter(F.col("__key").isNotNull()).select(F.col("__key").alias("key")).distinct(), self.limits.broadcast_bytes)
        known = None if first else self._known().join(keys, "key", "left_semi").dropDuplicates(["key"])
        fresh = materialise(asked if known is None else asked.join(known.select("key"), "key", "left_anti"), "new-prompts")
        number, label = 1 if first else self.runs().agg(F.max("run")).first()[0] + 1, uuid4().hex
        replied = materialise(batch_complete(fresh, F.col("prompt"), model, "reply", "error", batch_rows).drop("prompt"), "replied")
        replied.filter(F.col("error").isNull()).select("key", "reply").write.mode("overwrite").parquet(f"{self._table('replies')}/label={label}")
        # The row of the run is written last: it makes the replies visible.
        row = fresh.agg(F.count(F.lit(1)).alias("prompts")).select(F.lit(label).alias("label"), F.lit(number).cast("long").alias("run"), "prompts")
        row.coalesce(1).write.mode("append").parquet(self._table("runs"))
        found = replied if known is None else replied.unionByName(known.withColumn("error", F.lit(None).cast("string")))
        found = found.select(F.col("key").alias("__key"), F.col("reply").alias(out), F.col("error").alias(error))
        return keyed.join(broadcast_if_small(found, self.limits.broadcast_bytes), "__key", "left").drop("__key", "__prompt")
