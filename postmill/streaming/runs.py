"""Structured Streaming in front of the store: every micro-batch is one run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postmill.operators.store import VersionedStore, fold_batch, upsert

OVERWRITE = ("title", "company", "location", "last_seen")
STICKY = ("description_text",)


def into_store(stream: DataFrame, store: VersionedStore, checkpoint: str, *, key: str = "dedupe_key", transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Merge a stream of postings (with batch order in ``ord``) into a versioned store, batch by batch.

    The store keeps which batch of which checkpoint it holds, in the same version as the postings; a
    batch that is replayed after a failure is passed over. Every batch writes a whole version, so
    batches should be few and large: one for each run of the scraper, as availableNow makes them.
    """

    def one(batch: DataFrame, run: int) -> None:
        spark = batch.sparkSession
        held = store.read(spark, "batches")
        held = spark.createDataFrame([], "checkpoint string, batch long") if held is None else held
        if not held.where((F.col("checkpoint") == checkpoint) & (F.col("batch") >= run)).isEmpty():
            return
        rows = transform(batch) if transform else batch
        new = fold_batch(rows, key=key, order="ord", overwrite=OVERWRITE, sticky=STICKY)
        stored = store.read(batch.sparkSession, "jobs")
        if stored is None:
            merged = new.select(key, *OVERWRITE, *STICKY, F.col("last_seen").alias("first_seen"), F.lit(0).alias("misses"))
        else:
            merged = upsert(stored, new, key=key, overwrite=OVERWRITE, sticky=STICKY, first={"first_seen": F.col("b.last_seen"), "misses": F.lit(0)}, keep=("first_seen", "misses"))
        batches = held.where(F.col("checkpoint") != checkpoint).union(spark.createDataFrame([(checkpoint, run)], "checkpoint string, batch long"))
        store.write({"jobs": merged, "batches": batches.coalesce(1)}, unique={"jobs": key})

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
