"""Retrieval and prompt building for many questions at once.

Questions carry ``db_id``; candidate tables are the catalog rows of the same
database. Similarity is computed for question x (tables of its database):
with a catalog whose per-database size is bounded, that is linear in the
number of questions. The product is taken block by block, a database's questions dealt
over many groups, and selection happens on the block.
"""


from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package

# Fixed values of the selection and prompt rules.
BASE_THRESHOLD = 0.20
MAX_SCHEMA_TOKENS = 1528
MAX_QUESTION_TOKENS = 64
PROMPT_TEMPLATE = "Translate this question to SQL: {question}\nSchema:\n{schema}\n\n"


# -- R1 ----------------------------------------------------------------------
def table_context(cols: DataFrame) -> DataFrame:
    """``"<table> c1:t1 c2:t2 ..."`` with columns in catalog order."""
    g = cols.groupBy("db_id", "table_name").agg(
        F.array_sort(F.collect_list(F.struct("pos", "name", "type", "pk"))).alias("_c"))
    return g.select("db_id", "table_name", F.concat(
        F.col("table_name"), F.lit(" "),
        F.array_join(F.transform("_c", lambda x: F.concat(x["name"], F.lit(":"), x["type"])), " ")).alias("context"))


# -- R2 / R3 / R4 ------------------------------------------------------------
def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda t: t != "")


def token_bucket(tok: Column, dim: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("long"), F.lit(dim))


def hash_embed(text: Column, dim: int = 64) -> Column:
    """R2 default encoder: feature-hashed bag of words (md5 bucket per token).

    Pure JVM expression; a learned encoder can replace it through
    ``embed_with`` below without touching the rest of the job. The bucket
    list is an argument of ``aggregate`` (evaluated once per row), never
    referenced inside a lambda, so nothing is recomputed per dimension.
    """
    buckets = F.transform(tokens(text), lambda t: token_bucket(t, dim))
    zero = F.array_repeat(F.lit(0.0).cast("double"), dim)
    return F.aggregate(buckets, zero, lambda acc, b: F.transform(
        acc, lambda v, i: F.when(i == b, v + 1.0).otherwise(v)))


_LOADED: dict = {}       # models of this Python worker, by the name of the call that wants them


def per_worker(name: str, factory):
    """What ``factory()`` makes, made once per Python worker and call; the worker keeps the last one."""
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = factory()
    return _LOADED[name]


SLICE_ROWS, SLICE_CHARS = 256, 1_000_000        # what a model is given at a time, one text at least


def _slices(batch):
    """A batch of texts in short runs, so that a model's own memory does not grow with the batch."""
    start = chars = 0
    for i, text in enumerate(batch):
        n = len(text or "")
        if i > start and (i - start >= SLICE_ROWS or chars + n > SLICE_CHARS):
            yield batch.iloc[start:i]
            start, chars = i, 0
        chars += n
    yield batch.iloc[start:]


def embed_with(df: DataFrame, text_col: str, encoder=None, out_col: str = "vec", dim: int | None = None, factory=None) -> DataFrame:
    """R2 with a user model, in an Arrow-batched iterator UDF.

    ``factory()`` runs once per Python worker and returns the encoder, a
    callable ``list[str] -> list of vectors``; a light encoder can be given as
    ``encoder`` itself. Null texts are empty. ``dim``, if given, is checked: a
    vector of another length stops the job.
    """
    import uuid

    import numpy as np
    import pandas as pd

    ship_package(df.sparkSession)
    name, make = uuid.uuid4().hex, factory or (lambda: encoder)

    @F.pandas_udf("array<double>")
    def _enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = per_worker(name, make)
        for batch in batches:
            for part in _slices(batch.fillna("")):
                vectors = [np.asarray(v, dtype=float) for v in model(part.tolist())]
                if dim is not None and any(len(v) != dim for v in vectors):
                    raise ValueError(f"the encoder's vectors do not have {dim} numbers")
                yield pd.Series(vectors)

    return df.withColumn(out_col, _enc(F.col(text_col)))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero.

    The norm is passed into ``zip_with`` as an array argument so it is
    computed once per row, not once per element.
    """
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.zip_with(v, F.array_repeat(norm, F.size(v)),
                      lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


CHUNKS = 64             # parts that the questions of one database are dealt over
BLOCK_ROWS = 512        # questions multiplied with a database's tables at a time


def _block_product(questions: DataFrame, table_vecs: DataFrame, qid: list[str], per_block, schema: str) -> DataFrame:
    """Questions against the tables of their database as a block matrix product.

    Questions are dealt by ``(db_id, chunk)``, so a hot database is spread over
    ``CHUNKS`` groups; its tables go once to each chunk that has questions.
    ``per_block(ids, products, tables)`` gets up to ``BLOCK_ROWS`` questions and
    the matrix of their cosines (rounded to 9 digits so that ties and thresholds
    are stable) and returns the rows to keep, so nothing of the size questions x
    tables is written or shuffled unless asked for. A task holds one database's
    table vectors and one chunk of questions.
    """
    import numpy as np
    import pandas as pd

    ship_package(questions.sparkSession)
    q = questions.select(*qid, "db_id", "vec").withColumn("chunk", F.pmod(F.xxhash64(*qid), F.lit(CHUNKS)).cast("int"))
    places = q.select(F.col("db_id").alias("t_db"), F.col("chunk").alias("t_chunk")).distinct()
    t = places.join(table_vecs.withColumnRenamed("db_id", "t_db"), "t_db")
    n = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q, t = q.repartition(n, "db_id", "chunk"), t.repartition(n, "t_db", "t_chunk")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return per_block(left[[*qid, "db_id"]], np.empty((0, len(right))), right)
        right = right.sort_values(["table_pos", "table_name"], ignore_index=True)
        matrix = np.stack(right["vec"].to_numpy()).astype(float) if len(right) else None
        parts = []
        for a in range(0, len(left), BLOCK_ROWS):
            rows = left.iloc[a:a + BLOCK_ROWS].reset_index(drop=True)
            made = np.round(np.stack(rows["vec"].to_numpy()).astype(float) @ matrix.T, 9) if len(right) else np.empty((len(rows), 0))
            parts.append(per_block(rows[[*qid, "db_id"]], made, right))
        return pd.concat(parts, ignore_index=True)

    return q.groupBy("db_id", "chunk").cogroup(t.groupBy("t_db", "t_chunk")).applyInPandas(run, schema)


def _id_schema(questions: DataFrame, qid: list[str]) -> str:
    return ", ".join(f"{c} {dict(questions.dtypes)[c]}" for c in [*qid, "db_id"])


def similarities(questions: DataFrame, table_vecs: DataFrame, qid: list[str]) -> DataFrame:
    """Cosine of every question with every table of its own database (both
    L2-normalised, so the dot product); questions of a database without tables have none."""
    import numpy as np

    def all_pairs(ids, sims, tables):
        at, of = np.divmod(np.arange(sims.size), max(1, sims.shape[1]))
        return ids.iloc[at].reset_index(drop=True).assign(
            table_name=tables["table_name"].to_numpy(object)[of], table_pos=tables["table_pos"].to_numpy()[of], sim=sims.ravel())

    t = table_vecs.select("db_id", "table_name", "table_pos", "vec")
    pos = dict(t.dtypes)["table_pos"]
    return _block_product(questions, t, qid, all_pairs, f"{_id_schema(questions, qid)}, table_name string, table_pos {pos}, sim double")


def retrieve_tables(questions: DataFrame, table_vecs: DataFrame, neighbours: DataFrame, qid: list[str],
                    base: float = BASE_THRESHOLD) -> DataFrame:
    """R4-R8 in one pass: the tables chosen for each question.

    Per question the tables with ``sim >= max(base, 0.5 * best)``, or the single
    best (ties: table order) when none passes, and the one-hop FK neighbours of
    these. Columns: ``passes``, ``chosen`` (R6), ``rank`` (R8: by similarity,
    then name); a question of a database without tables has one row of nulls.
    The rules are applied to a block of products where it arises; a database's
    tables carry their neighbours' names.
    """
    import numpy as np
    import pandas as pd

    near = neighbours.groupBy("db_id", "table_name").agg(F.collect_set("neighbour").alias("near"))
    t = table_vecs.select("db_id", "table_name", "table_pos", "vec").join(near, ["db_id", "table_name"], "left")

    def choose(ids, sims, tables):
        n, m = sims.shape
        if not m:
            return ids.assign(table_name=None, table_pos=None, sim=np.nan, threshold=np.nan, passes=False, chosen=False, rank=None)
        names = tables["table_name"].to_numpy(object)
        number = {x: i for i, x in enumerate(names)}
        link_from, link_to = [], []
        for i, xs in enumerate(tables["near"]):
            for x in xs if xs is not None else ():
                if x in number:
                    link_from.append(i)
                    link_to.append(number[x])
        threshold = np.maximum(base, 0.5 * sims.max(1)) if n else np.empty(0)
        passes = sims >= threshold[:, None]
        chosen = passes.copy()
        none = np.flatnonzero(~passes.any(1))
        chosen[none, sims[none].argmax(1)] = True                # tables are in order: the first of equals
        taken = chosen.copy()
        for a, b in zip(link_from, link_to):
            taken[:, b] |= chosen[:, a]
        at, of = np.nonzero(taken)
        by_name = np.empty(m, int)
        by_name[np.argsort(names.astype(str), kind="stable")] = np.arange(m)
        order = np.lexsort((by_name[of], -sims[at, of], at))
        at, of = at[order], of[order]
        first = np.searchsorted(at, at)
        return ids.iloc[at].reset_index(drop=True).assign(
            table_name=names[of], table_pos=tables["table_pos"].to_numpy()[of], sim=sims[at, of], threshold=threshold[at],
            passes=passes[at, of], chosen=chosen[at, of], rank=np.arange(len(at)) - first + 1)

    pos = dict(t.dtypes)["table_pos"]
    schema = f"{_id_schema(questions, qid)}, table_name string, table_pos {pos}, sim double, threshold double, passes boolean, chosen boolean, rank int"
    return _block_product(questions, t, qid, lambda *a: choose(*a).astype({"table_pos": "Int64", "rank": "Int64"}), schema)


# -- R5 .. R8 ----------------------------------------------------------------
def select_tables(sims: DataFrame, qid: list[str], base: float = BASE_THRESHOLD) -> DataFrame:
    """R5+R6: keep ``sim >= max(base, 0.5 * best)``; when nothing passes keep
    the single best table (first in table order on ties).

    Every window is partitioned by question, so a group is one question's
    candidate tables (bounded by its database's catalog)."""
    w = Window.partitionBy(*qid)
    w_rank = Window.partitionBy(*qid).orderBy(F.desc("sim"), "table_pos")
    s = (sims.withColumn("threshold", F.greatest(F.lit(base), 0.5 * F.max("sim").over(w)))
         .withColumn("passes", F.col("sim") >= F.col("threshold")))
    s = (s.withColumn("n_pass", F.sum(F.col("passes").cast("int")).over(w))
         .withColumn("_best", F.row_number().over(w_rank)))
    return (s.where(F.col("passes") | ((F.col("n_pass") == 0) & (F.col("_best") == 1)))
            .drop("_best"))


def fk_expand(kept: DataFrame, neighbours: DataFrame, sims: DataFrame, qid: list[str]) -> DataFrame:
    """Add the one-hop FK neighbours of the kept tables (not transitive)."""
    nb = (kept.select(*qid, "db_id", "table_name")
          .join(neighbours, ["db_id", "table_name"])
          .select(*qid, "db_id", F.col("neighbour").alias("table_name")))
    allt = kept.select(*qid, "db_id", "table_name").unionByName(nb).distinct()
    return allt.join(sims.select(*qid, "db_id", "table_name", "table_pos", "sim"), qid + ["db_id", "table_name"])


def rank_tables(df: DataFrame, qid: list[str]) -> DataFrame:
    """Order by similarity desc, then name asc."""
    w = Window.partitionBy(*qid).orderBy(F.desc("sim"), "table_name")
    return df.withColumn("rank", F.row_number().over(w))


# -- R9 / R10 ----------------------------------------------------------------
WS = r"[ \t\n\r\f\x0B]+"


def token_len(text: Column) -> Column:
    """R9 fallback rule: twice the number of whitespace-separated words."""
    return 2 * F.size(F.filter(F.split(text, WS), lambda w: w != ""))


def token_len_with(df: DataFrame, text_col: str, tokenizer=None, out_col: str = "n_tokens", factory=None) -> DataFrame:
    """R9 with a real tokenizer (``list[str] -> list[int]`` lengths), vectorised over
    Arrow batches; ``factory()`` makes it, once per Python worker. If a batch
    fails, its texts are tried one by one, and only a text that fails alone gets
    the rule."""
    import uuid

    import pandas as pd

    ship_package(df.sparkSession)
    name, make = uuid.uuid4().hex, factory or (lambda: tokenizer)

    @F.pandas_udf("int")
    def _len(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = per_worker(name, make)

        def one(text):
            try:
                return count([text])[0]
            except Exception:  # noqa: BLE001 -- whatever the tokenizer raises, the rule answers
                return 2 * len((text or "").split())

        for batch in batches:
            for part in _slices(batch):
                try:
                    yield pd.Series(count(part.tolist()), dtype="int32")
                except Exception:  # noqa: BLE001 -- find out which text it was
                    yield pd.Series([one(t) for t in part], dtype="int32")

    return df.withColumn(out_col, _len(F.col(text_col)))


class LetterEncoder:
    """A small fixed encoder: counts of a text's characters by code point modulo ``dim``."""

    def __init__(self, dim: int):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list:
        import numpy as np
        return [np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") % self.dim, minlength=self.dim) for t in texts]


class FileTokenizer:
    """Token counts by a tokenizer file of the ``tokenizers`` library, used where it lies."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)

    def __call__(self, texts: list) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def rag_gate(schema_tokens: Column, question_tokens: Column) -> Column:
    """Retrieve when the schema or the question is over budget (strict)."""
    return (schema_tokens > MAX_SCHEMA_TOKENS) | (question_tokens > MAX_QUESTION_TOKENS)


# -- R11 / R12 ---------------------------------------------------------------
def table_strings(cols: DataFrame, fk_cols: DataFrame, keys: list[str]) -> DataFrame:
    """One ``t(<PK> c:t </PK>, <FK> c:t </FK>, c:t)`` string per (keys.., table).

    ``fk_cols`` holds (keys.., table_name, column_name) marked as FK sources.
    PK columns come first in column order; PK wins over FK.
    """
    fk = fk_cols.select(*keys, "table_name", F.col("column_name").alias("name"), F.lit(True).alias("is_fk")).distinct()
    c = cols.join(fk, keys + ["table_name", "name"], "left")
    item = F.when(F.col("pk"), F.concat(F.lit("<PK> "), "name", F.lit(":"), "type", F.lit(" </PK>"))) \
        .when(F.col("is_fk"), F.concat(F.lit("<FK> "), "name", F.lit(":"), "type", F.lit(" </FK>"))) \
        .otherwise(F.concat("name", F.lit(":"), "type"))
    g = c.groupBy(*keys, "table_name", "table_pos").agg(
        F.array_sort(F.collect_list(F.struct((~F.col("pk")).alias("npk"), "pos", "name", "type",
                                             item.alias("txt")))).alias("_c"))
    return g.select(*keys, "table_name", "table_pos", F.concat(
        "table_name", F.lit("("), F.array_join(F.transform("_c", lambda x: x["txt"]), ", "), F.lit(")")).alias("tstr"))


def linearize(tstrings: DataFrame, keys: list[str]) -> DataFrame:
    """``<SCHEMA> t1(...) t2(...) </SCHEMA>`` with tables in schema order."""
    g = tstrings.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("table_pos", "table_name", "tstr"))).alias("_t"))
    return g.select(*keys, F.concat(F.lit("<SCHEMA> "), F.array_join(F.transform("_t", lambda x: x["tstr"]), " "),
                                    F.lit(" </SCHEMA>")).alias("schema_text"))


def full_schema_text(cols: DataFrame, fks: DataFrame) -> DataFrame:
    """R12 over whole databases: every FK marks its source column."""
    fk_cols = fks.select("db_id", F.col("from_table").alias("table_name"), F.col("from_column").alias("column_name"))
    return linearize(table_strings(cols, fk_cols, ["db_id"]), ["db_id"])


def pruned_schema_text(kept: DataFrame, cols: DataFrame, fks: DataFrame, qid: list[str]) -> DataFrame:
    """R11+R12: keep the chosen tables in schema order and only FKs with both
    ends kept; the pruned text is not re-checked against the budget."""
    k = kept.select(*qid, "db_id", "table_name").distinct()
    f = (fks.join(k, (fks.db_id == k.db_id) & (fks.from_table == k.table_name))
         .select(*qid, fks.db_id.alias("db_id"), "from_table", "from_column", "to_table"))
    k2 = k.select(*qid, "db_id", F.col("table_name").alias("to_table"))
    f = f.join(k2, qid + ["db_id", "to_table"], "left_semi").select(
        *qid, "db_id", F.col("from_table").alias("table_name"), F.col("from_column").alias("column_name"))
    kc = k.join(cols, ["db_id", "table_name"])
    return linearize(table_strings(kc, f, qid + ["db_id"]), qid + ["db_id"])


# -- R13 / R14 ---------------------------------------------------------------
def assemble_prompt(question: Column, schema_text: Column) -> Column:
    """``<NL> q </NL> <schema>``."""
    return F.concat(F.lit("<NL> "), question, F.lit(" </NL> "), schema_text)


def generation_prompt(question: Column, schema_text: Column) -> Column:
    """R13 generation template."""
    return F.concat(F.lit("Translate this question to SQL: "), question, F.lit("\nSchema:\n"),
                    schema_text, F.lit("\n\n"))


def schema_span(prompt: Column) -> tuple[Column, Column]:
    """Text from the first ``<SCHEMA>`` through the first ``</SCHEMA>``.

    Returns (span, error): a missing marker gives a NULL span and a reason
    instead of failing the job.
    """
    s = F.instr(prompt, "<SCHEMA>")
    e = F.instr(prompt, "</SCHEMA>")
    ok = (s > 0) & (e > 0)
    span = F.when(ok, F.when(e + 9 > s, F.substring(prompt, s, e + 9 - s)).otherwise(F.lit("")))
    err = F.when(~ok, F.lit("missing <SCHEMA> or </SCHEMA>"))
    return span, err
