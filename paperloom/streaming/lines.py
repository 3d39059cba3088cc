"""Structured Streaming over dropped files: windows of events, and number checks by document as lines arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.functions.text import NUMBER, TOTAL, number


def read_files(spark: SparkSession, path: str, schema, per_trigger: int = 64) -> DataFrame:
    """Parquet files that appear under a path, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """events(ts, event_type, value), a stream or a table: counts and sums by window and type; later rows are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


TOTALS = "doc_id long, seq int, n long, actual double, claimed double"


#: Documents of one state. A call of Python for each document would cost more than its lines.
BUCKETS = 4096
WAITING = "doc_id array<long>, n array<long>, total array<double>"


def _totals(d: pd.DataFrame, waiting: dict[int, tuple[int, float]]) -> pd.DataFrame:
    """What new lines of documents, in order, claim wrongly. waiting(doc_id: count and sum of rows without a total) is brought up to date."""
    doc, is_total, figures, last = d["doc_id"].to_numpy(), d["total"].to_numpy(), d["n"].to_numpy(), d["last"].to_numpy(dtype=float)
    # Stretches of lines up to a total or to a document's end; the first of a document goes on from what waits.
    fresh = np.concatenate(([True], doc[1:] != doc[:-1]))
    begins = np.flatnonzero(fresh | np.concatenate(([True], is_total[:-1])))
    ends = np.concatenate((begins[1:], [len(doc)])) - 1
    counts = ~is_total & (figures >= 2)
    n, sums = np.add.reduceat(counts.astype(np.int64), begins), np.add.reduceat(np.where(counts, np.nan_to_num(last), 0.0), begins)
    for k in np.flatnonzero(fresh[begins]):
        before = waiting.pop(int(doc[begins[k]]), None)
        if before:
            n[k], sums[k] = n[k] + before[0], sums[k] + before[1]
    for k in np.flatnonzero(~is_total[ends] & (n > 0)):
        waiting[int(doc[ends[k]])] = int(n[k]), float(sums[k])
    wrong = is_total[ends] & (n >= 2) & (figures[ends] > 0) & (np.abs(sums - last[ends]) >= 0.005)
    at = ends[wrong]
    return pd.DataFrame({"doc_id": doc[at], "seq": d["seq"].to_numpy()[at], "n": n[wrong], "actual": sums[wrong], "claimed": last[at]})


def running_totals(lines: DataFrame) -> DataFrame:
    """lines(doc_id, seq, text), a stream in which a document's lines arrive in order: each total line that differs from the
    sum of the rows since the last one. What a document waits with is a count and a sum, and nothing while no row waits for its
    total. Documents are dealt into BUCKETS, whose states hold those that wait."""
    text = F.coalesce("text", F.lit(""))
    nums = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    # Lines without a document are a document of their own; pandas would make its neighbours' numbers floats.
    rows = lines.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "seq", text.rlike(TOTAL).alias("total"), F.size(nums).alias("n"), number(F.try_element_at(nums, F.lit(-1))).alias("last"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = {doc: (n, total) for doc, n, total in zip(*state.get)} if state.exists else {}
        out = _totals(pd.concat(list(batches)).sort_values(["doc_id", "seq"]), waiting)
        if waiting:
            state.update((list(waiting), [n for n, _ in waiting.values()], [total for _, total in waiting.values()]))
        elif state.exists:
            state.remove()
        yield out if key[1] else out.assign(doc_id=pd.array([None] * len(out), "Int64"))

    rows = rows.withColumn("bucket", F.pmod(F.hash("doc_id"), F.lit(BUCKETS)))
    return rows.groupBy("bucket", "known").applyInPandasWithState(step, TOTALS, WAITING, "append", GroupStateTimeout.NoTimeout)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything there is now, as Parquet files under a path, exactly once."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
