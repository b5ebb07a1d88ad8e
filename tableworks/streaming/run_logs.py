"""Run logs that grow: new records are flattened as they arrive.

The log is written by appending records, so a directory of JSON lines is a stream. Flattening is
stateless and uses the batch function unchanged; each new record is processed once.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tableworks.plans import runs
from tableworks.session import scratch_path
from tableworks.sources import schemas


def follow(
    spark: SparkSession, log_dir: str, out_dir: str, progress_dir: str | None = None,
    schema: str = schemas.RECORD,
) -> StreamingQuery:
    """Append the runs of all new records in ``log_dir`` to Parquet in ``out_dir``, then stop.

    ``progress_dir`` remembers what was read; call again with the same folder to go on from there.
    """
    records = spark.readStream.schema(schema).json(log_dir)
    flat = runs.flatten(records).withColumn("label", runs.decision_label(F.col("decision")))
    return (
        flat.drop("steps").writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", progress_dir or scratch_path(spark, "run-log-progress"))
        .option("path", out_dir).trigger(availableNow=True).start()
    )
