"""Table retrieval and prompt building.

Vector path: every ``embeddings`` row is a question embedding of database
``db_<label>``; its candidates are that database's catalog tables, embedded
from their R1 context with the R2 default encoder. Text path: every user
turn of ``conversations`` is a question to database ``db_<conv_id>``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..session import cut_lineage
from ..operators import retrieval as rt
from ..sources.tables import Tables
from . import catalog as pc
from .registry import register

DIM = 64
QV = ["vec_id"]
QT = ["conv_id", "turn"]
EMPTY_SCHEMA = "<SCHEMA>  </SCHEMA>"


# ---------------------------------------------------------------- Spark side
def _catalog(spark, d):
    _, inv, cols, fks = pc._lake(spark, d)
    return inv, cols, fks


def asked(rows, questions):
    """Catalog rows of the databases that have questions: no other database's tables are
    compared with one, so they are left out before, not after, texts and vectors are made."""
    return rows.join(questions.select("db_id").distinct(), "db_id", "left_semi")


def _table_vecs(spark, d, questions):
    inv, cols, fks = (asked(x, questions) for x in _catalog(spark, d))
    ctx = rt.table_context(cols)
    tv = (ctx.join(inv.select("db_id", "table_name", "table_pos"), ["db_id", "table_name"])
          .select("db_id", "table_name", "table_pos", rt.hash_embed(F.col("context"), DIM).alias("raw"))
          .select("db_id", "table_name", "table_pos", rt.l2_normalize(F.col("raw")).alias("vec")))
    return tv, inv, cols, fks


def _vec_questions(spark, d):
    e = Tables(spark, d).embeddings
    return e.select("vec_id", F.concat(F.lit("db_"), F.col("label").cast("string")).alias("db_id"),
                    rt.l2_normalize(F.col("embedding")).alias("vec"))


def _vec_retrieved(spark, d):
    tv, inv, cols, fks = _table_vecs(spark, d, _vec_questions(spark, d))
    return rt.retrieve_tables(_vec_questions(spark, d), tv, _neighbours(cols, inv, fks), QV)


def _neighbours(cols, inv, fks):
    return cat.fk_table_neighbours(fks, cols)


# ---------------------------------------------------------------- DuckDB side
D_CAT = pc.with_(pc.D_T, pc.D_C, pc.D_K, pc.D_KC, pc.D_INV, pc.D_COLS, pc.D_FKS, pc.D_NODES, pc.D_EDGES)


def d_tokens(x):
    return f"list_filter(string_split_regex(lower({x}), '[^a-z0-9_]+'), lambda t: t <> '')"


def d_hash_embed(x):
    b = f"list_transform({d_tokens(x)}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {DIM})"
    return f"list_transform(range({DIM}), lambda i: CAST(len(list_filter({b}, lambda b: b = i)) AS DOUBLE))"


def d_norm(v):
    n = f"sqrt(coalesce(list_sum(list_transform({v}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 0))"
    return f"list_transform({v}, lambda x: CASE WHEN {n} > 0 THEN CAST(x AS DOUBLE) / {n} ELSE 0.0 END)"


D_CTX = """, ctx AS (SELECT db_id, table_name,
    table_name || ' ' || string_agg(name || ':' || type, ' ' ORDER BY pos, name, type, pk) AS context
  FROM cols GROUP BY db_id, table_name)"""
D_TV = f""", tv0 AS (SELECT ctx.db_id, ctx.table_name, inv.table_pos, {d_hash_embed('ctx.context')} AS raw
  FROM ctx JOIN inv USING (db_id, table_name)),
tv AS (SELECT db_id, table_name, table_pos, {d_norm('raw')} AS vec FROM tv0)"""
D_QV = f", qv AS (SELECT vec_id, 'db_' || CAST(label AS VARCHAR) AS db_id, {d_norm('embedding')} AS vec FROM embeddings)"
D_SIMS = """, sims AS (SELECT vec_id, db_id, table_name, table_pos, round(list_dot_product(q.vec, t.vec), 9) AS sim
  FROM qv q JOIN tv t USING (db_id))"""


def d_select(sims: str, qid: str, out: str) -> str:
    return f""", {out}_s AS (SELECT *, greatest(0.2, 0.5 * max(sim) OVER (PARTITION BY {qid})) AS threshold FROM {sims}),
{out}_p AS (SELECT *, sim >= threshold AS passes FROM {out}_s),
{out}_n AS (SELECT *, sum(CASE WHEN passes THEN 1 ELSE 0 END) OVER (PARTITION BY {qid}) AS n_pass,
                row_number() OVER (PARTITION BY {qid} ORDER BY sim DESC, table_pos) AS best FROM {out}_p),
{out} AS (SELECT * FROM {out}_n WHERE passes OR (n_pass = 0 AND best = 1))"""


def d_expand(kept: str, sims: str, qcols: str, out: str) -> str:
    return f""", nb AS (SELECT DISTINCT * FROM (SELECT db_id, table_name, dst_table AS neighbour FROM edges WHERE rel = 'FK'
                         UNION ALL SELECT db_id, dst_table, table_name FROM edges WHERE rel = 'FK')),
{out}_a AS (SELECT DISTINCT * FROM (SELECT {qcols}, db_id, table_name FROM {kept}
           UNION ALL SELECT {', '.join('k.' + c.strip() for c in qcols.split(','))}, k.db_id, nb.neighbour
           FROM {kept} k JOIN nb ON nb.db_id = k.db_id AND nb.table_name = k.table_name)),
{out} AS (SELECT s.* FROM {out}_a a JOIN {sims} s USING ({qcols}, db_id, table_name))"""


# ------------------------------------------------------------- registrations
@register("r1_table_context", sql=D_CAT + D_CTX + " SELECT * FROM ctx")
def r1_table_context(spark, d):
    return rt.table_context(_catalog(spark, d)[1])


@register("r2_embed_text", sql=D_CAT + D_CTX + f" SELECT db_id, table_name, {d_hash_embed('context')} AS vec FROM ctx")
def r2_embed_text(spark, d):
    ctx = rt.table_context(_catalog(spark, d)[1])
    return ctx.select("db_id", "table_name", rt.hash_embed(F.col("context"), DIM).alias("vec"))


@register("r2_embed_model", sql=f"""SELECT doc_id, list_transform(range({DIM}), lambda i: CAST(len(list_filter(
    string_split(coalesce(text, ''), ''), lambda c: c <> '' AND ord(c) % {DIM} = i)) AS DOUBLE)) AS vec FROM documents""")
def r2_embed_model(spark, d):
    """R2 through the model hook: an encoder made once per Python worker."""
    docs = Tables(spark, d).documents.select("doc_id", "text")
    return rt.embed_with(docs, "text", factory=lambda: rt.LetterEncoder(DIM), dim=DIM).select("doc_id", "vec")


@register("r3_l2_normalize", sql=f"SELECT vec_id, list_transform({d_norm('embedding')}, lambda x: round(x, 6)) AS vec "
                                 "FROM embeddings")
def r3_l2_normalize(spark, d):
    e = Tables(spark, d).embeddings
    return e.select("vec_id", F.transform(rt.l2_normalize(F.col("embedding")), lambda x: F.round(x, 6)).alias("vec"))


@register("r4_cosine", sql=D_CAT + D_CTX + D_TV + D_QV + D_SIMS + " SELECT vec_id, table_name, sim FROM sims")
def r4_cosine(spark, d):
    questions = _vec_questions(spark, d)
    sims = rt.similarities(questions, _table_vecs(spark, d, questions)[0], QV)
    return sims.select("vec_id", "table_name", "sim")


@register("r5_dynamic_threshold", sql=D_CAT + D_CTX + D_TV + D_QV + D_SIMS + d_select("sims", "vec_id", "sel")
          + " SELECT vec_id, table_name, sim, threshold FROM sel WHERE passes")
def r5_dynamic_threshold(spark, d):
    return _vec_retrieved(spark, d).where("passes").select("vec_id", "table_name", "sim", "threshold")


@register("r6_top1_fallback", sql=D_CAT + D_CTX + D_TV + D_QV + D_SIMS + d_select("sims", "vec_id", "sel")
          + " SELECT vec_id, table_name, sim, passes FROM sel")
def r6_top1_fallback(spark, d):
    return _vec_retrieved(spark, d).where("chosen").select("vec_id", "table_name", "sim", "passes")


@register("r7_fk_expand", sql=D_CAT + D_CTX + D_TV + D_QV + D_SIMS + d_select("sims", "vec_id", "sel")
          + d_expand("sel", "sims", "vec_id", "ex") + " SELECT vec_id, table_name, sim FROM ex")
def r7_fk_expand(spark, d):
    return _vec_retrieved(spark, d).where("table_name is not null").select("vec_id", "table_name", "sim")


@register("r8_rank", sql=D_CAT + D_CTX + D_TV + D_QV + D_SIMS + d_select("sims", "vec_id", "sel")
          + d_expand("sel", "sims", "vec_id", "ex")
          + " SELECT vec_id, table_name, sim, "
            "CAST(row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, table_name) AS INTEGER) AS rank FROM ex"
            " UNION ALL SELECT vec_id, NULL, NULL, NULL FROM qv WHERE db_id NOT IN (SELECT db_id FROM tv)")
def r8_rank(spark, d):
    """A question of a database without tables is there with an empty choice."""
    return _vec_retrieved(spark, d).select("vec_id", "table_name", "sim", "rank")


D_WS = "'[ \\t\\n\\r\\f\\x0B]+'"


def d_token_len(x):
    return f"CAST(2 * len(list_filter(string_split_regex({x}, {D_WS}), lambda w: w <> '')) AS INTEGER)"


@register("r9_token_len", sql=f"SELECT doc_id, {d_token_len('text')} AS n_tokens FROM documents")
def r9_token_len(spark, d):
    docs = Tables(spark, d).documents
    return docs.select("doc_id", rt.token_len(F.col("text")).alias("n_tokens"))


@register("r9_token_len_model")
def r9_token_len_model(spark, d):
    """R9 through the tokenizer hook, with a public tokenizer's file; byte-pair tokens are beyond SQL."""
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = Tables(spark, d).documents.select("doc_id", "text")
    return rt.token_len_with(docs, "text", factory=lambda: rt.FileTokenizer(path)).select("doc_id", "n_tokens")


# -- text path -----------------------------------------------------------------
def _questions(spark, d):
    c = Tables(spark, d).conversations
    return c.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question"),
        F.concat(F.lit("db_"), F.col("conv_id").cast("string")).alias("db_id"))


def _gated(spark, d):
    """Questions with their full schema text, token counts and the gate."""
    questions = _questions(spark, d)
    _, cols, fks = (asked(x, questions) for x in _catalog(spark, d))
    return (questions.join(rt.full_schema_text(cols, fks), "db_id", "left")
            .withColumn("schema_text", F.coalesce("schema_text", F.lit(EMPTY_SCHEMA)))
            .withColumn("schema_tokens", rt.token_len(F.col("schema_text")))
            .withColumn("question_tokens", rt.token_len(F.col("question")))
            .withColumn("use_rag", rt.rag_gate(F.col("schema_tokens"), F.col("question_tokens"))))


def _prompts(spark, d):
    tv, inv, cols, fks = _table_vecs(spark, d, _questions(spark, d))
    qg = cut_lineage(_gated(spark, d))
    # Retrieval only for gated questions: the filter runs before the join.
    gated = (qg.where("use_rag").select(*QT, "db_id", rt.hash_embed(F.col("question"), DIM).alias("raw"))
             .select(*QT, "db_id", rt.l2_normalize(F.col("raw")).alias("vec")))
    # The choice is used three times below: written once.
    kept = cut_lineage(rt.retrieve_tables(gated, tv, _neighbours(cols, inv, fks), QT).where("table_name is not null"))
    pruned = rt.pruned_schema_text(kept, cols, fks, QT).withColumnRenamed("schema_text", "pruned_text")
    out = qg.join(pruned.drop("db_id"), QT, "left")
    rag = F.col("use_rag") & F.col("pruned_text").isNotNull()
    schema = F.when(rag, F.col("pruned_text")).otherwise(F.col("schema_text"))
    prompt = rt.assemble_prompt(F.col("question"), schema)
    return out.select(*QT, "db_id", "question", "schema_tokens", "question_tokens", "use_rag",
                      rag.alias("rag_used"), schema.alias("prompt_schema"), prompt.alias("prompt"))


D_QT = """, qt AS (SELECT conv_id, turn, text AS question, 'db_' || CAST(conv_id AS VARCHAR) AS db_id
                FROM conversations WHERE role = 'user')"""
D_TSTR_FULL = """, fkc AS (SELECT DISTINCT db_id, from_table AS table_name, from_column AS name FROM fks),
tstr AS (SELECT c.db_id, c.table_name, c.table_pos, c.table_name || '(' || string_agg(
    CASE WHEN c.pk THEN '<PK> ' || c.name || ':' || c.type || ' </PK>'
         WHEN f.name IS NOT NULL THEN '<FK> ' || c.name || ':' || c.type || ' </FK>'
         ELSE c.name || ':' || c.type END, ', '
    ORDER BY NOT c.pk, c.pos, c.name, c.type,
      CASE WHEN c.pk THEN '<PK> ' || c.name || ':' || c.type || ' </PK>'
           WHEN f.name IS NOT NULL THEN '<FK> ' || c.name || ':' || c.type || ' </FK>'
           ELSE c.name || ':' || c.type END) || ')' AS tstr
  FROM cols c LEFT JOIN fkc f USING (db_id, table_name, name) GROUP BY c.db_id, c.table_name, c.table_pos),
full_s AS (SELECT db_id, '<SCHEMA> ' || string_agg(tstr, ' ' ORDER BY table_pos, table_name, tstr) || ' </SCHEMA>' AS schema_text
  FROM tstr GROUP BY db_id)"""


@register("r12_linearize_schema", sql=D_CAT + D_TSTR_FULL + " SELECT * FROM full_s")
def r12_linearize_schema(spark, d):
    _, cols, fks = _catalog(spark, d)
    return rt.full_schema_text(cols, fks)


D_GATE = f""", qg AS (SELECT q.*, coalesce(f.schema_text, '{EMPTY_SCHEMA}') AS schema_text FROM qt q LEFT JOIN full_s f USING (db_id)),
qg2 AS (SELECT *, {d_token_len('schema_text')} AS schema_tokens, {d_token_len('question')} AS question_tokens FROM qg),
qg3 AS (SELECT *, schema_tokens > 1528 OR question_tokens > 64 AS use_rag FROM qg2)"""


@register("r10_rag_gate", sql=D_CAT + D_TSTR_FULL + D_QT + D_GATE
          + " SELECT conv_id, turn, schema_tokens, question_tokens, use_rag FROM qg3")
def r10_rag_gate(spark, d):
    return _gated(spark, d).select(*QT, "schema_tokens", "question_tokens", "use_rag")


D_TEXT_SEL = (D_CTX + D_TV + f""", gq AS (SELECT conv_id, turn, db_id, {d_norm(d_hash_embed('question'))} AS vec FROM qg3 WHERE use_rag),
tsims AS (SELECT conv_id, turn, db_id, table_name, table_pos, round(list_dot_product(q.vec, t.vec), 9) AS sim
  FROM gq q JOIN tv t USING (db_id))""" + d_select("tsims", "conv_id, turn", "tsel")
              + d_expand("tsel", "tsims", "conv_id, turn", "tex") + """,
pfk AS (SELECT DISTINCT k.conv_id, k.turn, f.db_id, f.from_table AS table_name, f.from_column AS name
        FROM tex k JOIN fks f ON f.db_id = k.db_id AND f.from_table = k.table_name
        JOIN tex k2 ON k2.conv_id = k.conv_id AND k2.turn = k.turn AND k2.db_id = f.db_id AND k2.table_name = f.to_table),
ptstr AS (SELECT k.conv_id, k.turn, c.db_id, c.table_name, c.table_pos, c.table_name || '(' || string_agg(
    CASE WHEN c.pk THEN '<PK> ' || c.name || ':' || c.type || ' </PK>'
         WHEN f.name IS NOT NULL THEN '<FK> ' || c.name || ':' || c.type || ' </FK>'
         ELSE c.name || ':' || c.type END, ', '
    ORDER BY NOT c.pk, c.pos, c.name, c.type,
      CASE WHEN c.pk THEN '<PK> ' || c.name || ':' || c.type || ' </PK>'
           WHEN f.name IS NOT NULL THEN '<FK> ' || c.name || ':' || c.type || ' </FK>'
           ELSE c.name || ':' || c.type END) || ')' AS tstr
  FROM (SELECT DISTINCT conv_id, turn, db_id, table_name FROM tex) k
  JOIN cols c ON c.db_id = k.db_id AND c.table_name = k.table_name
  LEFT JOIN pfk f ON f.conv_id = k.conv_id AND f.turn = k.turn AND f.db_id = c.db_id AND f.table_name = c.table_name
                  AND f.name = c.name
  GROUP BY k.conv_id, k.turn, c.db_id, c.table_name, c.table_pos),
pruned AS (SELECT conv_id, turn, '<SCHEMA> ' || string_agg(tstr, ' ' ORDER BY table_pos, table_name, tstr) || ' </SCHEMA>' AS pruned_text
  FROM ptstr GROUP BY conv_id, turn),
pr AS (SELECT qg3.*, use_rag AND pruned_text IS NOT NULL AS rag_used,
              CASE WHEN use_rag AND pruned_text IS NOT NULL THEN pruned_text ELSE schema_text END AS prompt_schema
       FROM qg3 LEFT JOIN pruned USING (conv_id, turn)),
pp AS (SELECT *, '<NL> ' || question || ' </NL> ' || prompt_schema AS prompt FROM pr)""")

D_TEXT = D_CAT + D_TSTR_FULL + D_QT + D_GATE + D_TEXT_SEL


@register("r11_prune_schema", sql=D_TEXT + " SELECT conv_id, turn, pruned_text FROM pruned")
def r11_prune_schema(spark, d):
    p = _prompts(spark, d).where("rag_used")
    return p.select(*QT, F.col("prompt_schema").alias("pruned_text"))


@register("r13_assemble_prompt", sql=D_TEXT + """ SELECT conv_id, turn, prompt,
    'Translate this question to SQL: ' || question || chr(10) || 'Schema:' || chr(10) || prompt_schema || chr(10) || chr(10)
    AS generation_prompt FROM pp""")
def r13_assemble_prompt(spark, d):
    p = _prompts(spark, d)
    return p.select(*QT, "prompt", rt.generation_prompt(F.col("question"), F.col("prompt_schema")).alias("generation_prompt"))


@register("r14_schema_span", sql=D_TEXT + """ SELECT conv_id, turn,
    CASE WHEN instr(prompt, '<SCHEMA>') > 0 AND instr(prompt, '</SCHEMA>') > 0 THEN
      CASE WHEN instr(prompt, '</SCHEMA>') + 9 > instr(prompt, '<SCHEMA>')
           THEN substr(prompt, instr(prompt, '<SCHEMA>'), instr(prompt, '</SCHEMA>') + 9 - instr(prompt, '<SCHEMA>'))
           ELSE '' END END AS span,
    CASE WHEN NOT (instr(prompt, '<SCHEMA>') > 0 AND instr(prompt, '</SCHEMA>') > 0)
         THEN 'missing <SCHEMA> or </SCHEMA>' END AS error
  FROM pp""")
def r14_schema_span(spark, d):
    p = _prompts(spark, d)
    span, err = rt.schema_span(F.col("prompt"))
    return p.select(*QT, span.alias("span"), err.alias("error"))


@register("r15_retrieve", sql=D_TEXT + f" SELECT conv_id, turn, rag_used, {d_token_len('prompt')} AS prompt_tokens, prompt FROM pp")
def r15_retrieve(spark, d):
    p = _prompts(spark, d)
    return p.select(*QT, "rag_used", rt.token_len(F.col("prompt")).alias("prompt_tokens"), "prompt")
