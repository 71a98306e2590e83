"""The row-local and per-query parts as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.color import enrich
from ..operators.relational import eligible
from ..plans import recommend
from ..sources.tables import RAW_ITEM, stored


def enrich_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Raw items arriving as JSON files in source, enriched and filtered, appended to sink as Parquet. No state."""
    rows = enrich(eligible(spark.readStream.schema(RAW_ITEM).json(source)))
    out = rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


class Recommender:
    """Recommendations for arriving wish texts (text_id, text) against a static catalogue, with the pools of anchors kept between micro-batches.

    A batch makes pools only for anchors that no earlier batch has, and adds them to the folder `state` under its number; its answers
    go to `sink` likewise. A repeated batch reads the pools of earlier batches alone and replaces its own files, so that it
    changes nothing.
    """

    def __init__(self, shades: DataFrame, anchors: DataFrame, calibration: DataFrame, state: str, sink: str, k: int = 20) -> None:
        self.catalogue, self.anchors, self.calibration = recommend.searched(shades), anchors, calibration
        self.state, self.sink, self.k = state, sink, k

    def pools(self, spark: SparkSession, before: int) -> DataFrame | None:
        """The pools that batches before this number have made."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.state)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return None
        names = [f.getPath().getName() for f in files.listStatus(folder) if f.isDirectory()]
        earlier = [f"{self.state}/{n}" for n in names if n.startswith("batch=") and int(n.removeprefix("batch=")) < before]
        return spark.read.parquet(*earlier) if earlier else None

    def batch(self, texts: DataFrame, number: int) -> None:
        spark = texts.sparkSession
        queries, cons = (stored(df, "asked") for df in recommend.wishes(texts, self.anchors))
        wishes, of = recommend.distinct_wishes(queries, cons)
        wishes = stored(wishes.withColumn("pool_id", recommend.pool_id()), "wishes")
        known = self.pools(spark, number)
        fresh = wishes if known is None else wishes.join(known.select(F.col("query_id").alias("pool_id")).distinct(), "pool_id", "left_anti")
        if not fresh.isEmpty():
            recommend.anchor_pools(self.catalogue, fresh)[1].write.mode("overwrite").parquet(f"{self.state}/batch={number}")
        pool = self.pools(spark, number + 1)
        if pool is not None:
            recommend.answers(pool, wishes, of, cons, self.calibration, self.k).write.mode("overwrite").parquet(f"{self.sink}/batch={number}")

    def start(self, texts: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        out = texts.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (out.trigger(availableNow=True) if once else out).start()
