"""T1-T4 on ``conversations``: user turn -> next assistant turn pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import training as tr
from ..operators import retrieval as rt
from ..sources.tables import Tables
from . import retrieval as pr
from .registry import register

# Fixed value: instruction used when a conversation has no system turn.
DEFAULT_INSTRUCTION = "Translate the question to SQL."


def pairs(spark, d):
    """(conv_id, turn, instruction, input, output, split) -- one row per answered user turn."""
    c = Tables(spark, d).conversations
    user = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("input"))
    ans = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    system = (c.where(F.col("role") == "system").groupBy("conv_id")
              .agg(F.min_by("text", "turn").alias("instruction")))
    j = user.join(ans, ["conv_id", "turn"]).join(system, "conv_id", "left")
    return j.select("conv_id", "turn", F.coalesce("instruction", F.lit(DEFAULT_INSTRUCTION)).alias("instruction"),
                    "input", "output",
                    F.when(F.col("conv_id") % 10 == 0, "validation").otherwise("train").alias("split"))


D_PAIRS = f"""pairs AS (
  SELECT u.conv_id, u.turn, coalesce(s.instruction, '{DEFAULT_INSTRUCTION}') AS instruction,
         u.text AS input, a.text AS output,
         CASE WHEN u.conv_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS instruction FROM conversations WHERE role = 'system'
             GROUP BY conv_id) s ON s.conv_id = u.conv_id
  WHERE u.role = 'user')"""
D_TEXT = "txt AS (SELECT *, instruction || chr(10) || input || chr(10) || chr(10) || output AS text FROM pairs)"
D_LEN = f"tl AS (SELECT *, {pr.d_token_len('text')} AS n_tokens FROM txt)"


@register("t1_sft_format", sql=f"WITH {D_PAIRS}, {D_TEXT} SELECT conv_id, turn, split, text FROM txt")
def t1_sft_format(spark, d):
    p = pairs(spark, d)
    return p.select("conv_id", "turn", "split", tr.sft_text(F.col("instruction"), F.col("input"), F.col("output")).alias("text"))


D_T2 = """, ex AS (SELECT p.conv_id, p.turn,
    'Translate this question to SQL: <NL>' || p.input || '</NL>' || chr(10) || 'Schema:' || chr(10)
    || coalesce(f.schema_text, '<SCHEMA>  </SCHEMA>') || chr(10) || chr(10) || '<COT>' || p.output || '</COT> <SQL>'
    || 'SELECT * FROM ' || coalesce(regexp_extract(f.schema_text, '<SCHEMA> ([^(]+)\\(', 1), 'dual') || ';'
    || '</SQL> <EXT>' || p.split || '</EXT>' AS example
  FROM pairs p LEFT JOIN full_s f ON f.db_id = 'db_' || CAST(p.conv_id AS VARCHAR))"""


@register("t2_tagged_example", sql=pr.D_CAT + pr.D_TSTR_FULL + ", " + D_PAIRS + D_T2 + """
SELECT conv_id, turn, example, regexp_extract(example, '(?s)<NL>(.*?)</NL>', 1) AS nl,
       regexp_extract(example, '(?s)<SQL>(.*?)</SQL>', 1) AS sql FROM ex""")
def t2_tagged_example(spark, d):
    _, cols, fks = pr._catalog(spark, d)
    full = rt.full_schema_text(cols, fks)
    p = pairs(spark, d).withColumn("db_id", F.concat(F.lit("db_"), F.col("conv_id").cast("string")))
    j = p.join(full, "db_id", "left").withColumn("schema_text", F.coalesce("schema_text", F.lit("<SCHEMA>  </SCHEMA>")))
    first = F.regexp_extract("schema_text", r"<SCHEMA> ([^(]+)\(", 1)
    sql = F.concat(F.lit("SELECT * FROM "), F.when(first != "", first).otherwise(F.lit("dual")), F.lit(";"))
    ex = tr.tagged_example(F.col("input"), F.col("schema_text"), F.col("output"), sql, F.col("split"))
    out = j.select("conv_id", "turn", ex.alias("example"))
    return out.select("conv_id", "turn", "example", tr.tag_span(F.col("example"), "NL").alias("nl"),
                      tr.tag_span(F.col("example"), "SQL").alias("sql"))


@register("t3_length_budget", sql=f"WITH {D_PAIRS}, {D_TEXT}, {D_LEN}" + """
SELECT split, count(*) FILTER (WHERE n_tokens <= 2048) AS n_kept, count(*) FILTER (WHERE n_tokens > 2048) AS n_dropped,
       CAST(coalesce(sum(n_tokens) FILTER (WHERE n_tokens <= 2048), 0) AS BIGINT) AS tokens_kept
FROM tl GROUP BY split""")
def t3_length_budget(spark, d):
    p = pairs(spark, d)
    t = p.withColumn("text", tr.sft_text(F.col("instruction"), F.col("input"), F.col("output")))
    return tr.length_budget(t)[1]


@register("t4_pack_sequences", sql=f"WITH {D_PAIRS}, {D_TEXT}, {D_LEN}" + """,
kept AS (SELECT * FROM tl WHERE n_tokens <= 2048),
o AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY split ORDER BY conv_id, turn
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS token_offset FROM kept)
SELECT split, conv_id, turn, n_tokens, CAST(token_offset AS BIGINT) AS token_offset, CAST(token_offset // 2048 AS BIGINT) AS first_block,
       CAST((token_offset + greatest(n_tokens, 1) - 1) // 2048 AS BIGINT) AS last_block FROM o""")
def t4_pack_sequences(spark, d):
    p = pairs(spark, d)
    t = p.withColumn("text", tr.sft_text(F.col("instruction"), F.col("input"), F.col("output")))
    kept, _ = tr.length_budget(t)
    packed = tr.pack_sequences(kept.select("split", "conv_id", "turn", "n_tokens"), ["conv_id", "turn"], group="split")
    return packed.select("split", "conv_id", "turn", "n_tokens", "token_offset", "first_block", "last_block")
