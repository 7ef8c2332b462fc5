"""Batch inference with any user model.

The model is an opaque callable ``predict(questions, schemas) -> sqls`` over lists.
It is built once per task by ``make_predictor`` (weights load once per
partition, not per row) and fed Arrow batches through ``mapInPandas``;
rows are sorted by database inside each partition so per-database prompt
assets stay warm without a shuffle on a possibly skewed ``db_id``.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import ship_package

from ..sources.files import read_predictions, write_predictions

PREDICTION_COLS = "example_id long, sql string, error string"


class TemplatePredictor:
    """Deterministic stand-in model: ``SELECT * FROM <first table>;`` per prompt.

    Raises on a batch that holds a prompt without any table, as a model that
    cannot encode one of its inputs would, so failure capture is exercised.
    """

    def __call__(self, questions: list[str], schemas: list[str]) -> list[str]:
        import re
        found = [re.search(r"<SCHEMA> ([^(]+)\(", s or "") for s in schemas]
        if not all(found):
            raise ValueError("schema has no tables")
        return [f"SELECT * FROM {m.group(1)};" for m in found]


def batch_predict(examples: DataFrame, make_predictor: Callable[[], Callable[[list[str], list[str]], list[str]]] = TemplatePredictor,
                  question: str = "question", schema: str = "schema_text", batch: int = 64) -> DataFrame:
    """B1+B3: ``(example_id, sql, error)``.

    The predictor takes lists of up to ``batch`` questions and schemas. If it
    raises, the batch is repeated in halves, so that one bad prompt costs a few
    more calls and not one per prompt; a prompt that fails alone becomes an
    empty prediction with its message, and the run goes on.
    """
    ship_package(examples.sparkSession)
    cols = examples.select("example_id", "db_id", F.col(question).alias("q"), F.col(schema).alias("s"))

    def run(batches):
        import pandas as pd
        predict = make_predictor()

        def answers(qs, ss):
            try:
                return [(sql, None) for sql in predict(qs, ss)]
            except Exception as e:  # noqa: BLE001 -- whatever the model raises is the row's result
                if len(qs) == 1:
                    return [("", f"{type(e).__name__}: {e}")]
                half = len(qs) // 2
                return answers(qs[:half], ss[:half]) + answers(qs[half:], ss[half:])

        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at:at + batch]
                rows = answers(part["q"].tolist(), part["s"].tolist())
                yield pd.DataFrame({"example_id": part["example_id"], "sql": [r[0] for r in rows], "error": [r[1] for r in rows]})

    return cols.sortWithinPartitions("db_id").mapInPandas(run, PREDICTION_COLS)


def slice_examples(examples: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """B2: examples with ``start <= example_id < end``."""
    cond = F.col("example_id") >= start
    if end is not None:
        cond = cond & (F.col("example_id") < end)
    return examples.where(cond)


def resume(examples: DataFrame, predictions_path: str, make_predictor=TemplatePredictor, **kw) -> DataFrame:
    """B4(a): predict only examples without a saved prediction, add them as a
    batch of their own, and return the complete predictions table.

    Only a missing table means that nothing is saved yet; any other failure to
    read it is raised, rather than predicting everything once more.
    """
    spark = examples.sparkSession
    todo = examples
    try:
        done = read_predictions(spark, predictions_path)
        todo = examples.join(done.select("example_id"), "example_id", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    write_predictions(batch_predict(todo, make_predictor, **kw), predictions_path, batch=uuid.uuid4().hex)
    return read_predictions(spark, predictions_path)


THROUGHPUT_SCHEMA = "n_examples long, n_failed long, seconds double, examples_per_sec double"


def measured(predictions: DataFrame, write: Callable[[DataFrame], None]) -> DataFrame:
    """Examples, failures, seconds and examples/s of one ``write`` of ``predictions``.

    Counts are gathered with ``observe`` on the pass that writes, so measuring
    adds no job over the data.
    """
    obs = Observation()
    observed = predictions.observe(obs, F.count(F.lit(1)).alias("n"), F.count(F.col("error")).alias("n_failed"))
    t0 = time.time()
    write(observed)
    sec = max(time.time() - t0, 1e-9)
    m = obs.get
    return predictions.sparkSession.createDataFrame([(int(m["n"]), int(m["n_failed"]), round(sec, 3), round(m["n"] / sec, 1))], THROUGHPUT_SCHEMA)


def throughput(predictions: DataFrame) -> DataFrame:
    """B5 of one full run that keeps nothing (noop sink)."""
    return measured(predictions, lambda df: df.write.format("noop").mode("overwrite").save())
