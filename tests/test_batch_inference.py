"""Failing batches are halved; micro-batches leave their counts."""

import os

from pyspark.sql import functions as F

from sqlkiln.operators import inference as inf
from sqlkiln.sources import files as fs
from sqlkiln.streaming import resume as st


def counting_predictor(folder):
    """Makes a predictor that leaves an empty file per call and fails on a batch with the question ``bad``."""
    def make():
        def predict(questions, schemas):
            open(os.path.join(folder, f"{os.getpid()}-{len(os.listdir(folder))}"), "w").close()
            if "bad" in questions:
                raise ValueError("cannot encode")
            return [q.upper() for q in questions]
        return predict
    return make


def rows(spark, n, bad=()):
    df = spark.range(n).select(F.col("id").alias("example_id"), F.lit("db").alias("db_id"), F.concat(F.lit("q"), "id").alias("question"),
                               F.lit("<SCHEMA> t(a) </SCHEMA>").alias("schema_text"))
    return df.withColumn("question", F.when(F.col("example_id").isin(*bad), "bad").otherwise(F.col("question"))) if bad else df


def test_a_bad_prompt_costs_two_calls_per_halving(spark, scratch):
    out = {r.example_id: (r.sql, r.error) for r in inf.batch_predict(rows(spark, 64, [37]).coalesce(1), counting_predictor(scratch)).collect()}
    assert out.pop(37) == ("", "ValueError: cannot encode")
    assert out == {i: (f"Q{i}", None) for i in range(64) if i != 37}
    assert len(os.listdir(scratch)) == 1 + 2 * 6


def test_all_bad_prompts_are_found(spark, scratch):
    bad = [0, 1, 40, 63, 64]
    out = inf.batch_predict(rows(spark, 70, bad).coalesce(1), counting_predictor(scratch)).where("error is not null")
    assert sorted(r.example_id for r in out.collect()) == bad


def test_batches_leave_counts_across_runs(spark, scratch):
    paths = [f"{scratch}/{x}" for x in ("in/*", "predictions", "checkpoint")]
    no_schema = F.when(F.col("example_id") % 5 == 0, "").otherwise(F.col("schema_text"))
    for lot, n in enumerate((10, 25)):
        rows(spark, n).withColumn("schema_text", no_schema).write.parquet(f"{scratch}/in/lot{lot}")
        assert st.predict_available(spark, *paths, metrics_path=f"{scratch}/metrics") == 1
    assert st.predict_available(spark, *paths, metrics_path=f"{scratch}/metrics") == 0
    got = st.batch_throughput(spark, f"{scratch}/metrics").orderBy("batch").collect()
    assert [(r.batch, r.n_examples, r.n_failed) for r in got] == [(0, 10, 2), (1, 25, 5)]
    assert all(r.seconds > 0 and r.examples_per_sec > 0 for r in got)
    assert fs.read_predictions(spark, paths[1]).count() == 35


def test_throughput_of_one_run(spark):
    r = inf.throughput(inf.batch_predict(rows(spark, 12))).first()
    assert (r.n_examples, r.n_failed) == (12, 0)
