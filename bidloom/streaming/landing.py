"""New price records as they land in a folder, added to the history once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

PAIR = ["catalog_item_id", "item_id"]


def follow_prices(spark: SparkSession, landing: str, schema: str, history: str, checkpoint: str, known: DataFrame | None = None) -> StreamingQuery:
    """Write the Parquet files that land to a table at a path, each pair of catalog item and item once.

    Pairs that came before are in the stream's state, one key each, dealt over the shuffle partitions, so no batch reads the history
    again. A batch that is repeated adds nothing, as the file sink commits each batch once; the table must be read by Spark, and only
    this stream writes it. known: pairs that were recorded elsewhere and are left out.
    """
    stream = spark.readStream.schema(schema).parquet(landing)
    if known is not None:
        stream = stream.join(known.select(*PAIR), PAIR, "left_anti")
    return stream.dropDuplicates(PAIR).writeStream.format("parquet").option("path", history).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
