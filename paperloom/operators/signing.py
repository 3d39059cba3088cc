"""Signature audit: who is complete, who may sign now, and who signs next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def signer_status(fields: DataFrame) -> DataFrame:
    """fields(packet, signer, stage, field, required, filled, ts) -> one row for each signer: counts, complete (all required
    fields filled; true without any), signed_at (the last filled field, for complete signers), unlocked (all signers of
    lower stages are complete)."""
    s = fields.groupBy("packet", "signer", "stage").agg(
        F.count_if("required").alias("required"), F.count_if(F.col("required") & F.col("filled")).alias("filled"), F.max(F.when(F.col("filled"), F.col("ts"))).alias("last")
    )
    s = s.withColumn("complete", F.col("required") == F.col("filled")).withColumn("signed_at", F.when(F.col("complete"), F.col("last"))).drop("last")
    # All signers of a lower stage: a range frame ends before the current stage's peers.
    lower = Window.partitionBy("packet").orderBy("stage").rangeBetween(Window.unboundedPreceding, -1)
    return s.withColumn("unlocked", F.coalesce(F.min("complete").over(lower), F.lit(True)))


def next_signer(fields: DataFrame) -> DataFrame:
    """For each packet the first unlocked signer who isn't complete, by stage and signer; none if all are complete."""
    open_ = signer_status(fields).where("unlocked and not complete")
    return open_.groupBy("packet").agg(F.min(F.struct("stage", "signer")).alias("s")).select("packet", F.col("s.stage").alias("stage"), F.col("s.signer").alias("signer"))
