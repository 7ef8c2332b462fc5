"""Resumable batch inference as a Structured Streaming job (B4 b).

Examples land as parquet files in a folder; the query reads them with an
explicit schema, predicts each micro-batch and appends to the predictions
table. The checkpoint location records which files are done, so a rerun
after a crash (or a plain rerun) only processes new files: exactly the
"restart after the last saved index" contract, with task retry in place of
signal handlers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.inference import THROUGHPUT_SCHEMA, TemplatePredictor, batch_predict, measured
from ..sources.files import write_predictions

EXAMPLE_SCHEMA = T.StructType([
    T.StructField("example_id", T.LongType()), T.StructField("db_id", T.StringType()),
    T.StructField("question", T.StringType()), T.StructField("schema_text", T.StringType())])


def predict_available(spark: SparkSession, examples_dir: str, predictions_path: str, checkpoint: str,
                      make_predictor=TemplatePredictor, schema: T.StructType = EXAMPLE_SCHEMA, metrics_path: str | None = None) -> int:
    """Process every example file not yet seen, then stop (``availableNow``).

    Returns the number of micro-batches run (0 when nothing was new). With
    ``metrics_path`` each batch also leaves its counts and time there, to be
    read by ``batch_throughput``.
    """
    src = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(examples_dir)
    batches = []

    def sink(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch overwrites its own folder
        predicted = batch_predict(batch, make_predictor)
        if metrics_path is None:
            write_predictions(predicted, predictions_path, batch=batch_id)
        else:
            figures = measured(predicted, lambda df: write_predictions(df, predictions_path, batch=batch_id))
            figures.coalesce(1).write.mode("overwrite").parquet(f"{metrics_path}/batch={batch_id}")
        batches.append(batch_id)

    q = (src.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return len(batches)


def batch_throughput(spark: SparkSession, metrics_path: str) -> DataFrame:
    """B5 per micro-batch: ``(batch, n_examples, n_failed, seconds, examples_per_sec)``, one row each.

    The figures are files beside the predictions, so those of earlier runs stay
    and a replayed batch replaces its own.
    """
    return spark.read.schema(f"batch long, {THROUGHPUT_SCHEMA}").parquet(metrics_path)
