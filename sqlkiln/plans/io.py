"""S1-S8 (sources and sinks) and B1-B5 (batch inference) as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference as inf
from ..operators import retrieval as rt
from ..sources import files as fs
from ..sources.tables import Tables, register_tables
from ..streaming.resume import batch_throughput, EXAMPLE_SCHEMA, predict_available
from . import fixtures as fx
from . import retrieval as pr
from . import training as ptr
from .flagship import FLAGSHIP_SQL
from .registry import register


@register("s1_csv_scan", sql="SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, "
                             "c_mktsegment FROM customer")
def s1_csv_scan(spark, d):
    path = fs.scratch_path(spark, "csv") + "/customer.csv"
    Tables(spark, d).customer.write.option("header", True).csv(path)
    return fs.csv_scan(spark, path)


@register("s3_jsonl_scan", sql=f"WITH {ptr.D_PAIRS} SELECT instruction, input, output, split FROM pairs")
def s3_jsonl_scan(spark, d):
    p = ptr.pairs(spark, d)
    base = fs.scratch_path(spark, "jsonl")
    for split in ("train", "validation"):
        p.where(F.col("split") == split).select("instruction", "input", "output").write.json(f"{base}/{split}.jsonl")
    return fs.jsonl_scan(spark, {"train": f"{base}/train.jsonl", "validation": f"{base}/validation.jsonl"})


D_EXAMPLES = """, ex AS (SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS example_id, 'db_' || CAST(conv_id AS VARCHAR) AS db_id,
    text AS question, CASE WHEN turn % 7 = 2 THEN '<SCHEMA>  </SCHEMA>' ELSE coalesce(f.schema_text, '<SCHEMA>  </SCHEMA>') END AS schema_text
  FROM conversations q LEFT JOIN full_s f ON f.db_id = 'db_' || CAST(q.conv_id AS VARCHAR) WHERE role = 'user')"""
EX_SQL = pr.D_CAT + pr.D_TSTR_FULL + D_EXAMPLES


def examples(spark, d):
    """Benchmark-style examples: every user turn, its database and full schema text."""
    q = pr._questions(spark, d)
    _, cols, fks = (pr.asked(x, q) for x in pr._catalog(spark, d))
    full = rt.full_schema_text(cols, fks)
    return (q.join(full, "db_id", "left")
            .select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("example_id"), "db_id", "question",
                    F.when(F.col("turn") % 7 == 2, F.lit("<SCHEMA>  </SCHEMA>"))
                    .otherwise(F.coalesce("schema_text", F.lit("<SCHEMA>  </SCHEMA>"))).alias("schema_text")))


@register("s4_example_scan", sql=EX_SQL + " SELECT * FROM ex")
def s4_example_scan(spark, d):
    path = fs.scratch_path(spark, "examples")
    fs.write_json_arrays(examples(spark, d), path)
    return fs.example_scan(spark, path, EXAMPLE_SCHEMA)


D_GOLD = f"""WITH cc AS ({fx.corpus_sql()}),
g AS (SELECT query_id, CASE WHEN dialect = 'db2' THEN '' ELSE regexp_replace(raw_output, '\\s+', ' ', 'g') || chr(9) || db_id END AS line
      FROM cc)"""


@register("s5_query_file_scan", sql=D_GOLD + """, n AS (SELECT *, row_number() OVER (ORDER BY query_id) - 1 AS line_no FROM g)
SELECT CAST(line_no AS BIGINT) AS line_no, trim(split_part(line, chr(9), 1)) AS sql,
       trim(substr(line, length(split_part(line, chr(9), 1)) + 2)) AS db_id
FROM n WHERE trim(line) <> ''""")
def s5_query_file_scan(spark, d):
    c = fx.corpus(spark, d)
    line = F.when(F.col("dialect") == "db2", F.lit("")).otherwise(
        F.concat(F.regexp_replace("raw_output", r"\s+", " "), F.lit("\t"), F.col("db_id")))
    path = fs.scratch_path(spark, "gold")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (c.select("query_id", line.alias("line")).repartitionByRange(n, "query_id").sortWithinPartitions("query_id")
     .select("line").write.text(path))
    return fs.query_file_scan(spark, path)


@register("s6_sql_scan", sql=FLAGSHIP_SQL)
def s6_sql_scan(spark, d):
    register_tables(spark, d, ("customer", "nation", "region", "orders", "lineitem"))
    return fs.sql_scan(spark, FLAGSHIP_SQL)


EXPORT_SQL = ("SELECT o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total "
              "FROM orders GROUP BY o_orderpriority")


@register("s7_export", sql=EXPORT_SQL)
def s7_export(spark, d):
    register_tables(spark, d, ("orders",))
    path = fs.export(spark, "csv", EXPORT_SQL, fs.scratch_path(spark, "export"))
    return spark.read.option("header", True).schema("o_orderpriority string, n_orders long, total double").csv(path)


B_SQL = EX_SQL + """, pred AS (SELECT example_id,
    CASE WHEN regexp_matches(schema_text, '<SCHEMA> ([^(]+)\\(')
         THEN 'SELECT * FROM ' || regexp_extract(schema_text, '<SCHEMA> ([^(]+)\\(', 1) || ';' ELSE '' END AS sql,
    CASE WHEN NOT regexp_matches(schema_text, '<SCHEMA> ([^(]+)\\(') THEN 'ValueError: schema has no tables' END AS error
  FROM ex)"""


@register("b1_batch_predict", sql=B_SQL + " SELECT * FROM pred")
def b1_batch_predict(spark, d):
    return inf.batch_predict(examples(spark, d))


@register("s8_prediction_sink", sql=B_SQL + " SELECT * FROM pred")
def s8_prediction_sink(spark, d):
    path = fs.scratch_path(spark, "predictions")
    fs.write_predictions(inf.batch_predict(examples(spark, d)), path)
    return fs.read_predictions(spark, path)


@register("b2_slice", sql=B_SQL + " SELECT p.* FROM pred p WHERE example_id >= 20000 AND example_id < 120000")
def b2_slice(spark, d):
    return inf.batch_predict(inf.slice_examples(examples(spark, d), 20000, 120000))


@register("b3_capture_failures", sql=B_SQL + " SELECT * FROM pred WHERE error IS NOT NULL")
def b3_capture_failures(spark, d):
    return inf.batch_predict(examples(spark, d)).where(F.col("error").isNotNull())


@register("b4_resume", sql=B_SQL + " SELECT * FROM pred")
def b4_resume(spark, d):
    ex = examples(spark, d)
    path = fs.scratch_path(spark, "resume")
    # First run stops part-way (only the first slice is saved) ...
    fs.write_predictions(inf.batch_predict(inf.slice_examples(ex, 0, 60000)), path)
    # ... the resumed run predicts only what is missing.
    return inf.resume(ex, path)


@register("b4_resume_streaming", sql=B_SQL + " SELECT * FROM pred")
def b4_resume_streaming(spark, d):
    ex = examples(spark, d)
    base = fs.scratch_path(spark, "stream")
    ex.write.parquet(f"{base}/in/part1")
    out, ckpt = f"{base}/predictions", f"{base}/checkpoint"
    predict_available(spark, f"{base}/in/part1", out, ckpt)
    predict_available(spark, f"{base}/in/part1", out, ckpt)      # rerun: no new files, no new rows
    return fs.read_predictions(spark, out)


@register("b5_throughput")
def b5_throughput(spark, d):
    return inf.throughput(inf.batch_predict(examples(spark, d)))


# Examples arrive in four lots; each is a micro-batch of one resumed stream.
@register("b5_batch_throughput", sql=B_SQL + """
SELECT CAST(example_id % 4 AS BIGINT) AS batch, count(*) AS n_examples, count(error) AS n_failed FROM pred GROUP BY 1""")
def b5_batch_throughput(spark, d):
    base = fs.scratch_path(spark, "throughput")
    examples(spark, d).withColumn("lot", F.col("example_id") % 4).write.partitionBy("lot").parquet(f"{base}/lots")
    for lot in range(4):
        spark.read.parquet(f"{base}/lots").where(F.col("lot") == lot).drop("lot").write.parquet(f"{base}/in/lot{lot}")
        predict_available(spark, f"{base}/in/*", f"{base}/predictions", f"{base}/checkpoint", metrics_path=f"{base}/metrics")
    return batch_throughput(spark, f"{base}/metrics").select("batch", "n_examples", "n_failed")
