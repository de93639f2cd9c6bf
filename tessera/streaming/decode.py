"""Streams of documents: decoding row by row in Structured Streaming. Rows flow through, order is a column, and failures are data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import CodecError
from ..kernels.envelope import Config
from ..operators.codec import decode_json, encode_json


def read_documents(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of documents as a stream; the rate limit is the backpressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def decode_stream(stream: DataFrame, data: str, config: Config = Config(), name: str = "decoded") -> DataFrame:
    return decode_json(stream, data, config, name)


def encode_stream(stream: DataFrame, json: str, config: Config = Config(), name: str = "encoded") -> DataFrame:
    return encode_json(stream, json, config, name)


def failures_by_window(decoded: DataFrame, event_time: str, width: str = "10 minutes", late: str = "30 minutes", name: str = "decoded") -> DataFrame:
    """Counts of outcomes by code in event-time windows; state of windows older than the watermark is dropped."""
    code = F.coalesce(F.col(f"{name}.failure.code"), F.lit("OK"))
    return decoded.withWatermark(event_time, late).groupBy(F.window(event_time, width), code.alias("code")).agg(F.count("*").alias("n"))


def write_guarded(stream: DataFrame, data: str, path: str, checkpoint: str, documents: int = 100_000, total_bytes: int = 256 << 20) -> StreamingQuery:
    """Writes each micro-batch to path after its limits are checked; a batch beyond them stops the query with ERR_BATCH_LIMIT.

    A batch is the partition batch_id of path, so one that is run again after a failure replaces what it wrote before."""

    def put(batch: DataFrame, batch_id: int) -> None:
        n, size = batch.agg(F.count("*"), F.sum(F.octet_length(data))).first()
        if n > documents or (size or 0) > total_bytes:
            raise CodecError("ERR_BATCH_LIMIT", f"{n} documents of {size} bytes are beyond the batch limits")
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
