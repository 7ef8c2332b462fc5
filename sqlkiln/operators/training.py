"""Training-set preparation (T1-T4): instruction pairs, tagged examples,
length budget and sequence packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .retrieval import token_len

MAX_SEQ_TOKENS = 2048
TAGS = ("NL", "SCHEMA", "COT", "SQL", "EXT")


def sft_text(instruction: Column, inp: Column, output: Column) -> Column:
    """``instruction \\n input \\n\\n output``."""
    return F.concat(instruction, F.lit("\n"), inp, F.lit("\n\n"), output)


def tagged_example(question: Column, schema_text: Column, cot: Column, sql: Column, ext: Column) -> Column:
    """The fine-tuning layout with <NL>, <SCHEMA>, <COT>, <SQL>, <EXT> spans."""
    return F.concat(F.lit("Translate this question to SQL: <NL>"), question, F.lit("</NL>\nSchema:\n"), schema_text,
                    F.lit("\n\n<COT>"), cot, F.lit("</COT> <SQL>"), sql, F.lit("</SQL> <EXT>"), ext, F.lit("</EXT>"))


def tag_span(text: Column, tag: str) -> Column:
    """Inverse of T2 for one tag: the text between ``<TAG>`` and ``</TAG>`` (NULL if absent)."""
    if tag == "SCHEMA":      # the schema span keeps its own markers
        v = F.regexp_extract(text, r"(?s)(<SCHEMA>.*?</SCHEMA>)", 1)
    else:
        v = F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    return F.when(text.contains(f"<{tag}>"), v)


def length_budget(df: DataFrame, text_col: str = "text", split_col: str = "split",
                  limit: int = MAX_SEQ_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(kept rows with ``n_tokens``, per-split report of kept and dropped)."""
    t = df.withColumn("n_tokens", token_len(F.col(text_col)))
    report = t.groupBy(split_col).agg(
        F.count(F.when(F.col("n_tokens") <= limit, 1)).alias("n_kept"),
        F.count(F.when(F.col("n_tokens") > limit, 1)).alias("n_dropped"),
        F.sum(F.when(F.col("n_tokens") <= limit, F.col("n_tokens")).otherwise(0)).cast("long").alias("tokens_kept"))
    return t.where(F.col("n_tokens") <= limit), report


def pack_sequences(df: DataFrame, order: list[str], tokens_col: str = "n_tokens", group: str | None = None,
                   block: int = MAX_SEQ_TOKENS) -> DataFrame:
    """T4: lay examples end to end in ``order`` and cut into ``block``-token blocks.

    Adds ``token_offset`` (tokens before the example, restarting per ``group``),
    ``first_block`` and ``last_block``. The running sum has two levels, so that
    no task sees more than a part of a group:

    1. rows are dealt by ranges of (group, order) and written with their part;
    2. totals per (part, group) -- one small row each -- give every part its
       start, by a running sum over parts that is joined back;
    3. within a part the running sum goes on from there.
    """
    keys = ([group] if group else []) + order
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n_parts, *keys).withColumn("_pid", F.spark_partition_id()))
    gcols = [group] if group else []
    tokens = F.coalesce(F.col(tokens_col).cast("long"), F.lit(0))
    totals = ranged.groupBy("_pid", *gcols).agg(F.sum(tokens).alias("_t"))
    before = (Window.partitionBy(*gcols) if gcols else Window.partitionBy()).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_pid", *[F.col(c).alias("_g") for c in gcols], F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_pid", *gcols).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(base.withColumnRenamed("_pid", "_bpid"), (F.col("_pid") == F.col("_bpid")) & (
        F.col(group).eqNullSafe(F.col("_g")) if group else F.lit(True)))
    out = out.withColumn("token_offset", F.col("_base") + F.coalesce(F.sum(tokens).over(inside), F.lit(0)))
    last = F.col("token_offset") + F.greatest(tokens, F.lit(1)) - 1
    return (out.withColumn("first_block", F.floor(F.col("token_offset") / block).cast("long"))
            .withColumn("last_block", F.floor(last / block).cast("long")).drop("_pid", "_bpid", "_base", "_g"))
