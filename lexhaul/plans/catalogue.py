"""The registered queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexhaul.functions import text as T
from lexhaul.operators import answering, blocks, chunking, engines, evaluation, index, ivf, ranking, resolve, vectors
from lexhaul.session import shared_folder
from lexhaul.sources import files

QUERIES: dict = {}
ORACLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# SQL fragments shared by several oracles.
WS = T.WS
STRIP = "regexp_replace({0}, '^[WS]+|[WS]+$', '', 'g')"


def stripped(x: str) -> str:
    return STRIP.replace("{0}", x).replace("WS", WS)


TOKENS = "greatest(1, CAST(floor(length({0}) / 3.2::DOUBLE) AS INTEGER))"
V = "CAST({0} AS DOUBLE[])"
ABBR = ", ".join(f"'{a}'" for a in T.ABBREVIATIONS)
SENTENCES = f"""
rough AS (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?:])[{WS}]+([A-ZÄÖÜ“„"(\\p{{Nd}}])', '\\1' || chr(30) || '\\2', 'g'), chr(30)) AS p
  FROM documents WHERE text IS NOT NULL AND {stripped("text")} <> ''
), piece AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS p FROM rough),
tagged AS (SELECT *, lower(regexp_extract(p, '([^{WS}]+)[{WS}]*$', 1)) AS w FROM piece),
flagged AS (SELECT *, CASE WHEN coalesce(lag(w IN ({ABBR}) OR regexp_full_match(w, '[\\p{{Nd}}.]+\\.|[a-zäöü]\\.')) OVER (PARTITION BY doc_id ORDER BY i), FALSE) THEN 0 ELSE 1 END AS starts FROM tagged),
grouped AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM flagged),
sentence AS (SELECT doc_id, CAST(g - 1 AS INTEGER) AS pos, string_agg(p, ' ' ORDER BY i) AS sentence FROM grouped GROUP BY doc_id, g)
"""


# Vector search

KNN = f"SELECT v.vec_id, q.vec_id AS query_id, round(list_cosine_distance({V.format('v.embedding')}, {V.format('q.embedding')}), 9) AS d FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q"


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50, as queries against all rows."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"WITH k AS ({KNN}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS n FROM k WHERE query_id = 0) SELECT CAST(n AS INTEGER) AS rank, vec_id, round(d, 6) AS distance, label FROM r JOIN embeddings USING (vec_id) WHERE n <= 10")
def knn_single(spark, sf_dir):
    """[V2] Nearest ten of the first vector, with their labels."""
    e = table(spark, sf_dir, "embeddings")
    hits = vectors.knn_batch(e, probes(spark, sf_dir).filter("query_id = 0"), 10)
    return hits.join(e.select("vec_id", "label"), "vec_id").select("rank", "vec_id", r6(F.col("distance")).alias("distance"), "label")


@query(f"WITH k AS ({KNN}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS n FROM k) SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, round(d, 6) AS distance FROM r WHERE n <= 10")
def knn_batch(spark, sf_dir):
    """[V8, J7] Nearest ten of every fiftieth vector."""
    hits = vectors.knn_batch(table(spark, sf_dir, "embeddings"), probes(spark, sf_dir), 10)
    return hits.select("query_id", "rank", "vec_id", r6(F.col("distance")).alias("distance"))


@query()
def ivf_search(spark, sf_dir):
    """[V3] Approximate nearest ten of every fiftieth vector by inverted lists, with as many lists as a measured recall needs."""
    e = table(spark, sf_dir, "embeddings")
    found = ivf.IvfIndex(spark, f"{shared_folder(spark)}/ivf-{uuid.uuid4().hex}")
    found.build(e)
    return found.search(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10).select("query_id", "rank", F.col("id").alias("vec_id"), r6(F.col("distance")).alias("distance"))


@query(f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(v[i] / sqrt(list_inner_product(v, v)), 6) AS x FROM (SELECT vec_id, {V.format('embedding')} AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def l2_normalise(spark, sf_dir):
    """[V9]"""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(T.l2_normalise(F.col("embedding"))).alias("pos", "x")).select("vec_id", "pos", r6(F.col("x")).alias("x"))


@query(f"WITH k AS ({KNN}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS n FROM k) SELECT query_id, CAST(n AS INTEGER) AS rank, doc_id, round(d, 6) AS distance, sha256(text) AS text_sha256 FROM r JOIN documents ON doc_id = vec_id WHERE n <= 10")
def search_with_text(spark, sf_dir):
    """[V4, V5, J1, J2] Top-k first, then the text of those rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = vectors.search(table(spark, sf_dir, "embeddings"), docs, probes(spark, sf_dir), 10, "vec_id", "doc_id")
    return hits.select("query_id", "rank", "doc_id", r6(F.col("distance")).alias("distance"), F.sha2("text", 256).alias("text_sha256"))


@query("SELECT vec_id AS id, 'vector_without_text' AS problem FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'text_without_vector' FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def vector_reconcile(spark, sf_dir):
    """[J9]"""
    return vectors.reconcile(table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents"), "vec_id", "doc_id")


# Scalar functions


@query(f"SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    """[F1]"""
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, sf_dir):
    """[F8]"""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query(
    f"""WITH s AS (SELECT doc_id, {stripped("text")} AS s, (doc_id * 7919) % 200000 AS px FROM documents),
r AS (SELECT *, CASE WHEN length(s) = 0 THEN 0 ELSE (length(s) - length(regexp_replace(s, '[\\x{{FFFD}}\\x{{00}}-\\x{{08}}\\x{{0B}}\\x{{0C}}\\x{{0E}}-\\x{{1F}}\\x{{7F}}-\\x{{9F}}]', '', 'g'))) / length(s)::DOUBLE END AS ratio FROM s)
SELECT doc_id, CASE WHEN length(s) < 100 THEN CASE WHEN px >= 100000 THEN 'scan' ELSE 'sparse' END WHEN ratio > 0.15 THEN CASE WHEN px >= 100000 THEN 'scan' ELSE 'error' END ELSE 'text' END AS status, round(ratio, 6) AS ratio FROM r"""
)
def page_status(spark, sf_dir):
    """[P1, F9, F10] Image sizes are made from the id."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.page_status(t, (F.col("doc_id") * 7919) % 200000).alias("status"), r6(T.replacement_ratio(t)).alias("ratio"))


@query(
    "SELECT doc_id, source || ' > ' || lang || chr(10) || chr(10) || text AS embed_text, source || ' > ' || lang AS heading, doc_id || '.v1.txt — ' || source || ' > ' || lang AS citation, doc_id || '.v1' AS key FROM documents"
)
def embed_text(spark, sf_dir):
    """Source and language as headings."""
    path = F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".v1.txt"))
    headings = F.array("source", "lang")
    return table(spark, sf_dir, "documents").select("doc_id", T.embed_text(F.col("text"), headings).alias("embed_text"), T.heading(headings).alias("heading"), T.citation(path, headings).alias("citation"), T.document_key(path).alias("key"))


HASH = "list_transform(range(0, 8), lambda i: CAST(('0x' || substr(sha256({0}), CAST(2 * i + 1 AS BIGINT), 2)) AS INTEGER) / 255.0::DOUBLE + 0.01::DOUBLE)"


@query(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, round(v[i] / sqrt(list_inner_product(v, v)), 6) AS x FROM (SELECT doc_id, v, unnest(range(1, 9)) AS i FROM (SELECT doc_id, {HASH.format('text')} AS v FROM documents))")
def hash_embed(spark, sf_dir):
    """[F28]"""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.hash_embed(F.col("text"))).alias("pos", "x")).select("doc_id", "pos", r6(F.col("x")).alias("x"))


@query(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, round(v[i] / sqrt(list_inner_product(v, v)), 6) AS x FROM (SELECT doc_id, v, unnest(range(1, 9)) AS i FROM (SELECT doc_id, {HASH.format(chr(39) + 'passage: ' + chr(39) + ' || text')} AS v FROM documents))")
def prefix_embed(spark, sf_dir):
    """Passages get a prefix before they are embedded."""
    v = T.hash_embed(F.concat(F.lit("passage: "), F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(v).alias("pos", "x")).select("doc_id", "pos", r6(F.col("x")).alias("x"))


def load_hashing():
    """The stand-in embedder as a model that a worker loads."""
    return lambda texts: np.array([[b / 255 + 0.01 for b in hashlib.sha256(t.encode()).digest()[:8]] for t in texts])


@query(ORACLES["prefix_embed"])
def engine_embed(spark, sf_dir):
    """[M8] The same passages through a batched engine: loaded once a worker, windows sorted by length, batches cut by tokens."""
    v = engines.embedder(engines.Engine("hashing", load_hashing), 8).encode(F.concat(F.lit("passage: "), F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(v).alias("pos", "x")).select("doc_id", "pos", r6(F.col("x")).alias("x"))


@query(f"SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents WHERE {TOKENS.format('text')} > CAST(floor(least(512, 8192) * 0.95::DOUBLE) AS INTEGER)")
def overlong(spark, sf_dir):
    """[P6] Texts over 95 % of the smaller of the configured and the engine's limit."""
    n = T.estimate_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("tokens")).filter(F.col("tokens") > int(min(512, 8192) * 0.95))


# Sentences and prose


@query(f"WITH {SENTENCES} SELECT doc_id, pos, sentence FROM sentence")
def sentences(spark, sf_dir):
    """[C2, C3]"""
    return chunking.sentence_rows(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    f"""WITH RECURSIVE {SENTENCES}, cost AS (SELECT *, {TOKENS.format('sentence')} AS c FROM sentence),
fold AS (
  SELECT doc_id, pos, c AS total, 0 AS unit FROM cost WHERE pos = 0
  UNION ALL
  SELECT n.doc_id, n.pos, CASE WHEN f.total + n.c > 448 THEN n.c ELSE f.total + n.c END, CASE WHEN f.total + n.c > 448 THEN f.unit + 1 ELSE f.unit END
  FROM fold f JOIN cost n ON n.doc_id = f.doc_id AND n.pos = f.pos + 1
)
SELECT doc_id, unit, count(*) AS n_sentences, CAST(sum(c) AS BIGINT) AS cost, string_agg(sentence, ' ' ORDER BY pos) AS text FROM fold JOIN cost USING (doc_id, pos) GROUP BY doc_id, unit"""
)
def prose_units(spark, sf_dir):
    """[C6] Units of at most 448 estimated tokens."""
    return chunking.prose_units(table(spark, sf_dir, "documents"), "doc_id", "text", 448)


@query(
    f"""WITH {SENTENCES}, r AS (SELECT *, row_number() OVER w AS rk, sum({TOKENS.format('sentence')}) OVER w AS cum FROM sentence WINDOW w AS (PARTITION BY doc_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING))
SELECT doc_id, count(*) AS n_sentences, string_agg(sentence, ' ' ORDER BY pos) AS tail FROM r WHERE rk = 1 OR cum <= 64 GROUP BY doc_id"""
)
def overlap_tail(spark, sf_dir):
    """[C7]"""
    return chunking.overlap_tail(table(spark, sf_dir, "documents"), "doc_id", "text", 64)


@query()
def chunk_markdown(spark, sf_dir):
    """[C1, C4, C5, C8] Whole documents in chunks; a fold with look-back has no SQL form, so tests hold it against worked cases."""
    return chunking.chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


#: Sentences as a list, tokens and last words of SQL expressions.
EST = lambda x: TOKENS.format(x)
LAST_WORD = lambda x: f"lower(regexp_extract({x}, '([^{WS}]+)[{WS}]*$', 1))"
MID = lambda x: f"({LAST_WORD(x)} IN ({ABBR}) OR regexp_full_match({LAST_WORD(x)}, '[\\p{{Nd}}.]+\\.|[a-zäöü]\\.'))"


def sentence_list(x: str) -> str:
    rough = f"string_split(regexp_replace({x}, '([.!?:])[{WS}]+([A-ZÄÖÜ“„\"(\\p{{Nd}}])', '\\1' || chr(30) || '\\2', 'g'), chr(30))"
    glued = f"array_to_string(list_transform({rough}, lambda p: p || CASE WHEN {MID('p')} THEN ' ' ELSE chr(31) END), '')"
    return f"list_filter(string_split({glued}, chr(31)), lambda m: {stripped('m')} <> '')"


PROSE_CHUNKS = f"""
WITH RECURSIVE par AS (
  SELECT doc_id, unnest(range(len(p))) AS p_no, unnest(p) AS text FROM (
    SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\\r\\n|[\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), '\\n[{WS}]*\\n'), lambda x: {stripped("x")}), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL
  )
), sent AS (
  SELECT doc_id, p_no, unnest(range(1, len(s) + 1)) AS i, rtrim(unnest(s), ' ') AS s FROM (SELECT doc_id, p_no, {sentence_list("text")} AS s FROM par WHERE {EST("text")} > 448)
), walk AS (
  SELECT doc_id, p_no, i, s, {EST("s")} AS cost, 0 AS unit FROM sent WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.p_no, n.i, n.s, CASE WHEN w.cost + {EST("n.s")} > 448 THEN 0 ELSE w.cost END + {EST("n.s")}, CASE WHEN w.cost + {EST("n.s")} > 448 THEN w.unit + 1 ELSE w.unit END
  FROM walk w JOIN sent n ON n.doc_id = w.doc_id AND n.p_no = w.p_no AND n.i = w.i + 1
), unit AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p_no, unit) AS n, text FROM (
    SELECT doc_id, p_no, 0 AS unit, text FROM par WHERE {EST("text")} <= 448 UNION ALL
    SELECT doc_id, p_no, unit, string_agg(s, ' ' ORDER BY i) FROM walk GROUP BY doc_id, p_no, unit
  )
), pack AS (
  SELECT doc_id, n, text AS open, {EST("text")} AS cost, CAST([] AS VARCHAR[]) AS done FROM unit WHERE n = 1
  UNION ALL
  SELECT doc_id, n, CASE WHEN NOT over THEN open || chr(10) || chr(10) || text WHEN tail = '' THEN text ELSE tail || chr(10) || chr(10) || text END,
    CASE WHEN NOT over THEN cost WHEN tail = '' THEN 0 ELSE {EST("tail")} END + {EST("text")}, CASE WHEN over THEN list_append(done, open) ELSE done END
  FROM (
    SELECT doc_id, n, text, open, cost, done, over, CASE WHEN over THEN array_to_string(list_slice(s, len(s) - list_max(list_filter(range(1, len(s) + 1), lambda k: k = 1 OR list_sum(list_transform(list_slice(s, len(s) - k + 1, len(s)), lambda x: {EST("x")})) <= 64)) + 1, len(s)), ' ') END AS tail FROM (
      SELECT u.doc_id, u.n, u.text, p.open, p.cost, p.done, p.cost + {EST("u.text")} > 512 AS over, list_transform({sentence_list("p.open")}, lambda x: rtrim(x, ' ')) AS s FROM pack p JOIN unit u ON u.doc_id = p.doc_id AND u.n = p.n + 1
    )
  )
), full_ AS (
  SELECT doc_id, CASE WHEN len(done) > 0 AND {EST("open")} < 32 THEN list_append(list_slice(done, 1, len(done) - 1), done[len(done)] || chr(10) || chr(10) || open) ELSE list_append(done, open) END AS c
  FROM pack QUALIFY n = max(n) OVER (PARTITION BY doc_id)
)
SELECT doc_id, CAST(k AS INTEGER) AS ordinal, text, {EST("text")} AS token_count FROM (SELECT doc_id, unnest(range(len(c))) AS k, unnest(c) AS text FROM full_)
"""


@query(PROSE_CHUNKS)
def chunk_prose(spark, sf_dir):
    """[C6, C7, C8] Whole documents, which hold paragraphs only, in chunks: one fold of built-in functions."""
    return chunking.chunk_prose(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(PROSE_CHUNKS)
def chunk_udtf(spark, sf_dir):
    """[C8] The same by the table function that takes any Markdown, in SQL with LATERAL."""
    chunking.register(spark)
    return spark.sql("SELECT d.doc_id, c.ordinal, c.text, c.token_count FROM {docs} d, LATERAL markdown_chunks(d.text, 512, 64) c", docs=table(spark, sf_dir, "documents"))


#: Documents as Markdown: a line for each sentence end, and by its place headings, fences of both kinds, table rows and blank lines.
MARKDOWN = f"SELECT doc_id, list_transform(string_split(replace(text, '. ', '.' || chr(10)), chr(10)), lambda x, i: CASE i % 19 WHEN 3 THEN '# ' || x WHEN 5 THEN '```' WHEN 8 THEN ' ~~~ x' WHEN 9 THEN '```' WHEN 12 THEN '| ' || x || ' |' WHEN 13 THEN '|-|' WHEN 16 THEN '' WHEN 17 THEN '~~~' WHEN 0 THEN '### ' || x || ' ##' ELSE x END) AS l FROM documents WHERE text IS NOT NULL"


def as_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = {3: lambda x: F.concat(F.lit("# "), x), 5: lambda x: F.lit("```"), 8: lambda x: F.lit(" ~~~ x"), 9: lambda x: F.lit("```"), 12: lambda x: F.concat(F.lit("| "), x, F.lit(" |")), 13: lambda x: F.lit("|-|"), 16: lambda x: F.lit(""), 17: lambda x: F.lit("~~~"), 0: lambda x: F.concat(F.lit("### "), x, F.lit(" ##"))}

    def line(x, i):
        out = x
        for k, f in place.items():
            out = F.when((i + 1) % 19 == k, f(x)).otherwise(out)
        return out

    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return rows.select("doc_id", F.array_join(F.transform(F.split(F.replace("text", F.lit(". "), F.lit(".\n")), "\n"), line), "\n").alias("text"))


@query(
    f"""WITH RECURSIVE l AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(regexp_replace(array_to_string(l, chr(10)), '\\n$', ''), chr(10)) AS l FROM ({MARKDOWN}))
), typed AS (SELECT *, CASE WHEN regexp_matches(line, '^[{WS}]*```') THEN 1 WHEN regexp_matches(line, '^[{WS}]*~~~') THEN 2 END AS mark FROM l),
m AS (SELECT doc_id, pos, mark, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM typed WHERE mark IS NOT NULL),
st AS (
  SELECT doc_id, pos, n, mark AS after FROM m WHERE n = 1 UNION ALL
  SELECT m.doc_id, m.pos, m.n, CASE WHEN st.after = 0 THEN m.mark WHEN st.after = m.mark THEN 0 ELSE st.after END FROM st JOIN m ON m.doc_id = st.doc_id AND m.n = st.n + 1
), b AS (SELECT typed.*, coalesce(last_value(st.after IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM typed LEFT JOIN st USING (doc_id, pos)),
k AS (SELECT *, CASE WHEN before <> 0 OR mark IS NOT NULL THEN 'code' WHEN regexp_matches(line, '^#{{1,6}}[{WS}]+.+?[{WS}]*#*$') THEN 'heading' WHEN regexp_matches(line, '^[{WS}]*\\|.*\\|[{WS}]*$') THEN 'tabelle' WHEN {stripped("line")} <> '' THEN 'prosa' ELSE '' END AS kind FROM b),
n AS (SELECT *, CASE WHEN kind = '' THEN 0 WHEN kind = 'code' THEN CAST(before = 0 AS INTEGER) WHEN kind = 'heading' THEN 1 ELSE CAST(kind <> coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY pos), '') AS INTEGER) END AS new FROM k),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS block FROM n),
t AS (SELECT *, CASE kind WHEN 'tabelle' THEN regexp_replace(line, '[{WS}]+$', '') WHEN 'heading' THEN {stripped(f"regexp_extract(line, '^(#{{1,6}})[{WS}]+(.+?)[{WS}]*#*$', 2)")} ELSE line END AS shown FROM g WHERE kind <> '')
SELECT doc_id, CAST(block AS INTEGER) AS block, first(kind) AS kind, CAST(max(CASE WHEN kind = 'heading' THEN length(regexp_extract(line, '^(#+)', 1)) ELSE 0 END) AS INTEGER) AS level,
       CASE WHEN first(kind) = 'prosa' THEN {stripped("string_agg(shown, chr(10) ORDER BY pos)")} ELSE string_agg(shown, chr(10) ORDER BY pos) END AS text FROM t GROUP BY doc_id, block"""
)
def markdown_blocks(spark, sf_dir):
    """[C1] Blocks of all documents as Markdown, by a scan over lines."""
    return blocks.blocks(as_markdown(spark, sf_dir), "doc_id", "text")


# Index life cycle: documents with an id divisible by 5 are new, by 7 changed, by 11 gone.

STORED = "SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 7 = 0 THEN sha256('old') ELSE sha256(text) END AS sha256, CAST(doc_id % 9 AS INTEGER) AS chunk_count FROM documents WHERE doc_id % 5 <> 0"
LISTED = "SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha256, CAST(length(text) % 4 AS INTEGER) AS n_chunks FROM documents WHERE doc_id % 11 <> 0"
STATUS = f"SELECT l.path, CASE WHEN d.path IS NOT NULL AND d.sha256 = l.sha256 THEN 'unverändert' WHEN n_chunks = 0 THEN 'leer' WHEN d.path IS NOT NULL THEN 'aktualisiert' ELSE 'neu' END AS status, CASE WHEN d.path IS NOT NULL AND d.sha256 = l.sha256 THEN chunk_count ELSE n_chunks END AS chunk_count FROM ({LISTED}) l LEFT JOIN ({STORED}) d ON d.path = l.path"


def stored_and_listed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumns({"path": F.col("doc_id").cast("string"), "new": F.sha2("text", 256)})
    old = docs.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), "path", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.col("new")).alias("sha256"), (F.col("doc_id") % 9).cast("int").alias("chunk_count"))
    return old, docs.filter("doc_id % 11 <> 0").select("path", F.col("new").alias("sha256"), (F.char_length("text") % 4).alias("n_chunks"))


@query(STATUS)
def ingest_status(spark, sf_dir):
    """[D1, J3, P3]"""
    old, listed = stored_and_listed(spark, sf_dir)
    return index.ingest_status(listed, old)


@query(f"SELECT status, count(*) AS files, CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS chunks FROM ({STATUS}) GROUP BY status")
def ingest_report(spark, sf_dir):
    """[D10, A2]"""
    old, listed = stored_and_listed(spark, sf_dir)
    return index.report(index.ingest_status(listed, old))


@query(f"WITH s AS ({STATUS}), c AS (SELECT l.path, l.sha256, s.chunk_count FROM ({LISTED}) l JOIN s USING (path) WHERE status IN ('neu', 'aktualisiert')) SELECT path, sha256, chunk_count FROM ({STORED}) WHERE path NOT IN (SELECT path FROM c) UNION ALL SELECT * FROM c")
def replace_snapshot(spark, sf_dir):
    """[D2, D3, D4]"""
    old, listed = stored_and_listed(spark, sf_dir)
    changed = index.ingest_status(listed, old).filter(F.col("status").isin(index.NEW, index.UPDATED)).join(listed.select("path", "sha256"), "path")
    return index.replace_rows(old.select("path", "sha256", "chunk_count"), changed, "path")


@query(f"SELECT path FROM ({STORED}) WHERE path NOT IN (SELECT path FROM ({LISTED}))")
def prune(spark, sf_dir):
    """[D5, J4, P9]"""
    old, listed = stored_and_listed(spark, sf_dir)
    return index.missing(old, listed).select("path")


@query(
    f"""WITH v AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || chr(10) || 'neu' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 5 = 0),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ordinal FROM v),
c AS (SELECT * FROM l WHERE {stripped("line")} <> '')
SELECT 'doc-' || doc_id AS path, CAST(ordinal AS INTEGER) AS ordinal, sha256(line) AS text_sha256, {TOKENS.format("line")} AS token_count, length(line) AS embedded FROM c"""
)
def merged_index(spark, sf_dir):
    """[D3, D5, S15] Four runs over all documents, merged on read and compacted in between: all stored, every third changed, some pruned and a part of those added again.

    The lines of a document are its chunks; a chunk's vector has its length.
    """
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("path"), "doc_id", "text").withColumn("error", F.lit(None).cast("string"))
    listed = lambda df: df.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256)).select("path", "sha256", "text", "error")

    def lines(d: DataFrame) -> DataFrame:
        rows = d.select("path", F.posexplode(F.split("text", "\n")).alias("ordinal", "text")).filter(T.strip(F.col("text")) != "")
        return rows.withColumns({"heading_path": F.array().cast("array<string>"), "kind": F.lit("prosa"), "token_count": T.estimate_tokens(F.col("text"))})

    store = index.IndexStore(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", "length", 1)
    changed = docs.filter("doc_id % 3 = 0").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\nneu")))
    put = lambda df, **how: store.ingest(listed(df), lambda c: F.array(F.char_length(c).cast("float")), chunker=lines, **how)
    put(docs)
    put(changed)
    put(docs.limit(0), prune_against=docs.filter("doc_id % 7 <> 0"))
    store.compact(2)
    put(docs.filter("doc_id % 35 = 0 AND doc_id % 3 <> 0").unionByName(changed.filter("doc_id % 35 = 0")))
    chunks = store.read("chunks").select(F.col("id").alias("chunk_id"), "document_id", "ordinal", F.unhex(F.sha2("text", 256)).alias("_sha"), "token_count")  # no text moves
    vectors = store.read("vectors").select("chunk_id", F.get("embedding", F.lit(0)).cast("long").alias("embedded"))
    found = chunks.join(vectors, "chunk_id").join(store.read("documents").select(F.col("id").alias("document_id"), "path"), "document_id")
    return found.select("path", "ordinal", F.lower(F.hex("_sha")).alias("text_sha256"), "token_count", "embedded")


@query(f"WITH n AS (SELECT l.path, l.n_chunks FROM ({LISTED}) l WHERE l.path NOT IN (SELECT path FROM ({STORED}))) SELECT path, 1000000 + row_number() OVER (ORDER BY substr(sha256(path), 1, 2), path) AS id FROM n")
def assign_ids(spark, sf_dir):
    """[D6] Above a high-water mark of one million."""
    old, listed = stored_and_listed(spark, sf_dir)
    return index.assign_ids(listed.join(old, "path", "left_anti").select("path"), ["path"], 1_000_000)


@query(f"SELECT count(*) AS documents, (SELECT count(*) FROM conversations) AS chunks, (SELECT CAST(coalesce(sum({TOKENS.format('text')}), 0) AS BIGINT) FROM conversations) AS tokens, (SELECT count(*) FROM embeddings) AS vectors FROM documents")
def index_stats(spark, sf_dir):
    """[D9, A1]"""
    chunks = table(spark, sf_dir, "conversations").select(T.estimate_tokens(F.col("text")).alias("token_count"))
    return index.stats(table(spark, sf_dir, "documents"), chunks, table(spark, sf_dir, "embeddings"))


@query(
    "SELECT doc_id, round(1 - d, 6) AS similarity, round(coalesce(rr, 1 - d), 6) AS score, round(CASE WHEN n = 0 OR s = 0 THEN 0 ELSE n / s END, 6) AS tokens_per_second "
    "FROM (SELECT doc_id, (doc_id % 100) / 100.0::DOUBLE AS d, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 10) / 10.0::DOUBLE END AS rr, doc_id % 7 AS n, (doc_id % 5) / 2.0::DOUBLE AS s FROM documents)"
)
def hit_scores(spark, sf_dir):
    """Distances, scores and rates made from the id."""
    i = F.col("doc_id")
    d, score = (i % 100).cast("double") / 100, F.when(i % 3 > 0, (i % 10).cast("double") / 10)
    return table(spark, sf_dir, "documents").select("doc_id", r6(T.similarity(d)).alias("similarity"), r6(T.hit_score(score, d)).alias("score"), r6(T.tokens_per_second(i % 7, (i % 5).cast("double") / 2)).alias("tokens_per_second"))


PAGE = f"""p AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS number, unnest(l) AS page FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
s AS (SELECT doc_id, number, page, {stripped("page")} AS s, (doc_id * 7919 + number * 40009) % 200000 AS px FROM p),
t AS (SELECT *, CASE WHEN length(s) = 0 THEN 0 ELSE (length(s) - length(regexp_replace(s, '[\\x{{FFFD}}\\x{{00}}-\\x{{08}}\\x{{0B}}\\x{{0C}}\\x{{0E}}-\\x{{1F}}\\x{{7F}}-\\x{{9F}}]', '', 'g'))) / length(s)::DOUBLE END AS ratio FROM s),
st AS (SELECT *, CASE WHEN length(s) < 100 THEN CASE WHEN px >= 100000 THEN 'scan' ELSE 'sparse' END WHEN ratio > 0.15 THEN CASE WHEN px >= 100000 THEN 'scan' ELSE 'error' END ELSE 'text' END AS status FROM t)"""


def lines_as_pages(spark, sf_dir):
    """Every line of a document as a page, with image sizes made from its number."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("number", "text")).withColumn("number", F.col("number") + 1)
    return lines.withColumn("image_pixels", (F.col("doc_id") * 7919 + F.col("number") * 40009) % 200000)


@query(f"WITH {PAGE} SELECT doc_id, count(*) AS pages, count(*) FILTER (status = 'scan') AS scans, CAST(sum(length(s)) AS BIGINT) AS chars, round(count(*) FILTER (status = 'scan') / count(*)::DOUBLE, 6) AS ocr_ratio FROM st GROUP BY doc_id")
def inspect_pages(spark, sf_dir):
    """[A3] Totals of each document's pages."""
    found = files.inspect(lines_as_pages(spark, sf_dir).withColumnRenamed("doc_id", "path"))
    return found.select(F.col("path").alias("doc_id"), "pages", "scans", "chars", r6(F.col("ocr_ratio")).alias("ocr_ratio"))


@query(f"WITH {PAGE} SELECT doc_id, number, status = 'scan' AND number % 2 = 1 AS needs_ocr FROM st")
def ocr_needed(spark, sf_dir):
    """[P2] Of scans, every second page has been read already."""
    status = T.page_status(F.col("text"), F.col("image_pixels"))
    return lines_as_pages(spark, sf_dir).select("doc_id", F.col("number").cast("long").alias("number"), T.needs_ocr(status, F.col("number") % 2 == 0).alias("needs_ocr"))


@query(
    f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, sha256(array_to_string(list_filter(l, lambda x: {stripped("x")} <> ''), chr(10) || chr(10))) AS text_sha256, CAST(coalesce(list_sum(list_transform(l, lambda x: length({stripped("x")}))), 0) AS BIGINT) AS chars,
round(len(list_filter(l, lambda x: length(x) % 3 = 0)) / len(l)::DOUBLE, 6) AS ocr_ratio FROM d"""
)
def document_pages(spark, sf_dir):
    """Joined text, characters, and the share of scans, which are here the lines of a length divisible by three."""
    pages = F.split("text", "\n")
    scans = F.transform(pages, lambda p: F.when(F.char_length(p) % 3 == 0, "scan").otherwise("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.document_text(pages), 256).alias("text_sha256"), T.char_count(pages).cast("long").alias("chars"), r6(T.ocr_ratio(scans)).alias("ocr_ratio"))


READ = "'gelesen ' || number || chr(10) || CASE WHEN number % 4 = 0 THEN '' ELSE left(page, 20) END"


@query(
    f"""WITH {PAGE}, r AS (SELECT *, CASE WHEN status = 'scan' THEN {READ} ELSE page END AS seen FROM st),
d AS (SELECT doc_id, count(*) AS page_count, count(*) FILTER (status = 'scan') AS pages_read, CAST(sum(length(s)) AS BIGINT) AS char_count, count(*) FILTER (status = 'sparse') AS sparse, coalesce(string_agg(seen, chr(10) || chr(10) ORDER BY number) FILTER ({stripped("seen")} <> ''), '') AS text FROM r GROUP BY doc_id)
SELECT doc_id, page_count, pages_read, pages_read > 0 AS ocr_used, char_count, sha256(text) AS text_sha256, CAST((sparse > 0) AS INTEGER) + CAST((char_count > 500 AND length(text) < char_count * 0.5) AS INTEGER) AS n_warnings FROM d"""
)
def page_routing(spark, sf_dir):
    """[S9, P2] Lines of all documents as pages; only scans reach the reader, a stand-in that sees the number and a part of the text."""

    def read(frames):
        for f in frames:
            f["text"] = ["gelesen " + str(n) + "\n" + ("" if n % 4 == 0 else t[:20]) for n, t in zip(f["number"], f["text"], strict=True)]
            yield f

    out = files.convert_pages(lines_as_pages(spark, sf_dir), read, key="doc_id")
    return out.select("doc_id", "page_count", "pages_read", "ocr_used", "char_count", F.sha2("text", 256).alias("text_sha256"), F.size("warnings").alias("n_warnings"))


# Ranking

SCORE = "round(1 / (1 + exp(-(8 * (1 - d) - (vec_id % 5)))), 9)"
RERANK = f"""WITH k AS ({KNN}), near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS n FROM k) WHERE n <= 30),
s AS (SELECT *, {SCORE} AS score FROM near),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d, vec_id) AS pos FROM s)
SELECT query_id, CAST(pos AS INTEGER) AS pos, vec_id, round(score, 6) AS score FROM r WHERE pos <= 5 AND (pos = 1 OR score >= 0.7)"""


@query(RERANK)
def rerank_topk(spark, sf_dir):
    """[R1, R2, R3, P5] Thirty nearest, scored by a logistic function of similarity and id, best five from 0.7 on."""
    hits = vectors.knn_batch(table(spark, sf_dir, "embeddings"), probes(spark, sf_dir), ranking.CANDIDATES)
    score = F.round(1 / (1 + F.exp(-(8 * (1 - F.col("distance")) - F.col("vec_id") % 5))), 9)
    return ranking.rerank(hits.drop("rank"), score, 5, 0.7, tie="vec_id").select("query_id", "pos", "vec_id", r6(F.col("score")).alias("score"))


@query(
    f"""WITH h AS (SELECT source AS query_id, doc_id, text, doc_id || '.txt' AS cite, row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id) AS number FROM documents),
c AS (SELECT *, {TOKENS.format("('[' || number || '] ' || cite || chr(10) || text)")} AS cost FROM h),
u AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY number ROWS UNBOUNDED PRECEDING) AS used FROM c),
k AS (SELECT *, number = 1 OR used <= 2457 AS kept FROM u)
SELECT query_id, CAST(number AS INTEGER) AS number, doc_id, cost, CAST(used AS BIGINT) AS used, dropped FROM (SELECT *, count(*) FILTER (NOT kept) OVER (PARTITION BY query_id) AS dropped FROM k) WHERE kept"""
)
def build_sources(spark, sf_dir):
    """[R5, F17] Documents of each source, shortest first, in a context of 4096 tokens."""
    docs = table(spark, sf_dir, "documents")
    hits = docs.select(F.col("source").alias("query_id"), "doc_id", "text", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("citation"), F.struct(F.char_length("text"), "doc_id").alias("pos"))
    return ranking.build_sources(hits, 4096).select("query_id", "number", "doc_id", "cost", "used", "dropped")


@query("WITH n AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, text AS question, answer FROM n WHERE role = 'user' AND nr = 'assistant'")
def turn_pairs(spark, sf_dir):
    """Completed question and answer turns."""
    return ranking.turn_pairs(table(spark, sf_dir, "conversations"))


SAID = "CASE length(text) % 4 WHEN 0 THEN 'QUELLEN_REICHEN' WHEN 1 THEN ' ' WHEN 2 THEN 'nach Fristen suchen' END"


@query(
    f"""WITH s AS (SELECT conv_id, turn, text, turn > 2 AS has_sources, CASE WHEN turn > 0 THEN {SAID} END AS said FROM conversations), t AS (SELECT *, {stripped("said")} AS c FROM s)
SELECT conv_id, turn, coalesce(starts_with(upper(c), 'QUELLEN_REICHEN') AND has_sources, FALSE) AS reuse, CASE WHEN c IS NULL OR starts_with(upper(c), 'QUELLEN_REICHEN') OR c = '' THEN text ELSE c END AS query FROM t"""
)
def plan_retrieval(spark, sf_dir):
    """[R7] A router that answers by the length of the question, sometimes not at all."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"), (F.col("turn") > 0).alias("has_history"), (F.col("turn") > 2).alias("has_sources"))
    said = lambda q: F.when(F.char_length(q) % 4 == 0, "QUELLEN_REICHEN").when(F.char_length(q) % 4 == 1, " ").when(F.char_length(q) % 4 == 2, "nach Fristen suchen")
    return ranking.plan_retrieval(rows, said).select("conv_id", "turn", "reuse", "query")


@query(
    f"""WITH k AS ({KNN}), near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS n FROM k JOIN documents ON doc_id = vec_id) WHERE n <= 30),
s AS (SELECT *, round(1 / (1 + exp(-(length(text) % 50) / 10.0::DOUBLE)), 9) AS score FROM near),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d, vec_id) AS pos FROM s) WHERE pos <= 5),
c AS (SELECT *, {TOKENS.format("('[' || pos || '] ' || vec_id || '.txt' || chr(10) || text)")} AS cost FROM r),
u AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM c),
g AS (SELECT query_id, list(vec_id ORDER BY pos) FILTER (pos = 1 OR used <= 2457) AS ids, count(*) FILTER (NOT (pos = 1 OR used <= 2457)) AS dropped FROM u GROUP BY query_id)
SELECT query_id, CAST(len(ids) AS INTEGER) AS n_sources, dropped, array_to_string(ids, ',') AS chunk_ids, '1' AS cited FROM g"""
)
def ask(spark, sf_dir):
    """Questions asked in one call: thirty nearest, scored by the length of their text, five in a context of 4096 tokens, answered from the first."""
    e, docs = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    held = e.join(docs, e["vec_id"] == docs["doc_id"]).select(F.col("vec_id").alias("chunk_id"), "text", F.concat(F.col("vec_id").cast("string"), F.lit(".txt")).alias("citation"), "embedding")
    scorer = answering.CrossEncoder("length", lambda q, t: F.round(1 / (1 + F.exp(-(F.char_length(t) % 50) / 10)), 9))
    found = answering.ask(held, probes(spark, sf_dir).withColumn("question", F.concat(F.lit("Frage "), F.col("query_id"))), reranker=scorer)
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return found.select("query_id", "n_sources", "dropped", join("chunk_ids").alias("chunk_ids"), join("cited").alias("cited"))


def load_pair_lengths():
    """A stand-in cross-encoder: one number for each pair, from the lengths of both texts."""
    return lambda questions, passages: np.array([[(len(q) * 7 + len(p)) % 50 / 10 - 2] for q, p in zip(questions, passages)])


@query(
    f"""WITH k AS ({KNN}), near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS n FROM k JOIN documents ON doc_id = vec_id) WHERE n <= 30),
s AS (SELECT *, 1 / (1 + exp(-((length('Frage ' || query_id) * 7 + length(text)) % 50 / 10.0::DOUBLE - 2))) AS score FROM near),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, d, vec_id) AS pos FROM s)
SELECT query_id, CAST(pos AS INTEGER) AS pos, vec_id AS chunk_id, round(score, 6) AS score FROM r WHERE pos <= 5 AND (pos = 1 OR score >= 0.7)"""
)
def engine_rerank(spark, sf_dir):
    """[R8] Two stages with a batched cross-encoder: thirty nearest, best five from 0.7 on."""
    e, docs = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    held = e.join(docs, e["vec_id"] == docs["doc_id"]).select(F.col("vec_id").alias("chunk_id"), "text", F.concat(F.col("vec_id").cast("string"), F.lit(".txt")).alias("citation"), "embedding")
    asked = probes(spark, sf_dir).withColumn("question", F.concat(F.lit("Frage "), F.col("query_id").cast("string")))
    model = engines.cross_encoder(engines.Engine("pair lengths", load_pair_lengths))
    rounded = answering.CrossEncoder(model.name, lambda q, p: F.round(model.predict(q, p), 9))
    return answering.retrieve(held, asked, 5, rounded, 0.7).select("query_id", "pos", "chunk_id", r6(F.col("score")).alias("score"))


REPLY = "CASE turn % 4 WHEN 0 THEN '  quellen_reichen' || chr(10) WHEN 1 THEN '   ' WHEN 2 THEN 'Suche ' || role || ' ' ELSE 'QUELLEN_REICHEN.' END"


@query(f"WITH r AS (SELECT conv_id, turn, text, {stripped(f'({REPLY})')} AS s, conv_id % 2 = 0 AS ok FROM conversations) SELECT conv_id, turn, starts_with(upper(s), 'QUELLEN_REICHEN') AND ok AS reuse, CASE WHEN starts_with(upper(s), 'QUELLEN_REICHEN') OR s = '' THEN text ELSE s END AS query FROM r")
def route_parse(spark, sf_dir):
    """Four kinds of router replies."""
    t = F.col("turn") % 4
    reply = F.when(t == 0, "  quellen_reichen\n").when(t == 1, "   ").when(t == 2, F.concat(F.lit("Suche "), F.col("role"), F.lit(" "))).otherwise("QUELLEN_REICHEN.")
    route = T.parse_route(reply, F.col("text"), F.col("conv_id") % 2 == 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", route.alias("r")).select("conv_id", "turn", "r.reuse", "r.query")


@query(
    """WITH s AS (SELECT conv_id, turn, p AS pos, (turn * 3 + p * 5) % 7 AS chunk_id FROM conversations, (SELECT unnest(range(0, 3)) AS p) WHERE role = 'assistant'),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, chunk_id ORDER BY turn DESC, pos) AS n FROM s) WHERE n = 1)
SELECT conv_id, chunk_id, turn, pos, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, pos, chunk_id) AS INTEGER) AS reuse_rank FROM o"""
)
def reusable_hits(spark, sf_dir):
    """[R4] Three sources for each answer, made from its turn."""
    answers = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    s = answers.select("conv_id", "turn", F.explode(F.array(*[F.lit(p).cast("long") for p in range(3)])).alias("pos")).withColumn("chunk_id", (F.col("turn") * 3 + F.col("pos") * 5) % 7)
    return ranking.reusable_hits(s).select("conv_id", "chunk_id", "turn", "pos", "reuse_rank")


@query(
    "WITH a AS (SELECT conv_id, turn, text || ' [' || turn || '] [oben] [' || (conv_id % 3 + 1) || ']' AS t FROM conversations), c AS (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(t, '\\[(\\d{1,9})\\]', 1), lambda x: CAST(x AS INTEGER)))) AS n FROM a) "
    "SELECT conv_id, turn, array_to_string(n, ',') AS cited, array_to_string(list_filter([1, 2, 3], lambda x: NOT list_contains(n, x)), ',') AS uncited FROM c"
)
def citations(spark, sf_dir):
    """[F11, F12, A9] Numbers cited, and those of three sources that are not."""
    t = F.concat(F.col("text"), F.lit(" ["), F.col("turn").cast("string"), F.lit("] [oben] ["), (F.col("conv_id") % 3 + 1).cast("string"), F.lit("]"))
    join = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", join(T.cited_numbers(t)).alias("cited"), join(T.uncited(F.array(F.lit(1), F.lit(2), F.lit(3)), t)).alias("uncited"))


LIKE = " OR ".join(f"contains(lower(t), '{m}')" for m in T.IGNORANCE)
ANSWER = "text || CASE turn % 3 WHEN 0 THEN ' Das steht NICHT in den Quellen.' WHEN 1 THEN ' Es sind 14 Tage.' ELSE '' END"


@query(f"WITH a AS (SELECT conv_id, turn, {ANSWER} AS t FROM conversations) SELECT conv_id, turn, ({LIKE}) AS ignorance, contains(t, '14 Tage') AND contains(t, 'Es') AS has_all, contains(t, '14 Tage') AND contains(t, 'Es') AND NOT ({LIKE}) AS correct FROM a")
def answer_check(spark, sf_dir):
    """[F14, F15, F16, E9]"""
    m = F.col("turn") % 3
    t = F.concat(F.col("text"), F.when(m == 0, " Das steht NICHT in den Quellen.").when(m == 1, " Es sind 14 Tage.").otherwise(""))
    needles = F.array(F.lit("14 Tage"), F.lit("Es"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.admitted_ignorance(t).alias("ignorance"), T.contains_all(t, needles).alias("has_all"), T.answered_correctly(t, needles).alias("correct"))


@query(f"WITH a AS (SELECT conv_id, turn, {ANSWER} || ' [' || (turn % 4) || '][' || (conv_id % 3) || ']' AS t FROM conversations) SELECT conv_id, CAST(count(*) FILTER (contains(t, '14 Tage') AND NOT ({LIKE})) AS BIGINT) AS correct, CAST(sum(len(list_distinct(regexp_extract_all(t, '\\[(\\d{{1,9}})\\]', 1)))) AS BIGINT) AS cited_sources FROM a GROUP BY conv_id")
def answer_report(spark, sf_dir):
    """[E9] Correct answers and cited sources of each conversation."""
    m = F.col("turn") % 3
    t = F.concat(F.col("text"), F.when(m == 0, " Das steht NICHT in den Quellen.").when(m == 1, " Es sind 14 Tage.").otherwise(""), F.lit(" ["), (F.col("turn") % 4).cast("string"), F.lit("]["), (F.col("conv_id") % 3).cast("string"), F.lit("]"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", T.answered_correctly(t, F.array(F.lit("14 Tage"))).alias("ok"), T.cited_sources(t).alias("n"))
    return rows.groupBy("conv_id").agg(F.count_if("ok").alias("correct"), F.sum("n").alias("cited_sources"))


# Evaluation

GOLD = "SELECT b.item_id AS question_id, coalesce(list_sort(list(DISTINCT d.doc_id) FILTER (d.doc_id IS NOT NULL)), []) AS docs FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id"
TYPED = f"SELECT question_id, docs, CASE len(docs) WHEN 0 THEN 'ohne_antwort' WHEN 1 THEN 'eindeutig' ELSE 'mehrdeutig' END AS typ FROM ({GOLD})"
HITS = f"""gold AS ({TYPED}), dv AS (SELECT doc_id, {HASH.format('text')} AS v FROM documents WHERE text IS NOT NULL), qv AS (SELECT item_id, {HASH.format('text')} AS v FROM benchmark),
dist AS (SELECT item_id AS question_id, doc_id, round(list_cosine_distance(dv.v, qv.v), 9) AS d FROM dv, qv),
hits AS (SELECT h.question_id, h.doc_id, CAST(pos AS INTEGER) AS pos, 1 - d AS score, coalesce(list_contains(docs, doc_id), FALSE) AS correct, typ FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY d, doc_id) AS pos FROM dist) h JOIN gold USING (question_id) WHERE pos <= 10)"""
PER = "per AS (SELECT g.question_id, g.typ, min(CASE WHEN correct THEN pos END) AS first_rank, coalesce(bool_or(correct AND pos <= 5), FALSE) AS hit_at_k, coalesce(arg_min(score, pos), 0) AS top_score FROM gold g LEFT JOIN hits USING (question_id) GROUP BY ALL)"
OK = "typ IN ('eindeutig', 'mehrdeutig')"


@query(f"SELECT question_id, typ, array_to_string(docs, ',') AS dokumente FROM ({TYPED})")
def gold_standard(spark, sf_dir):
    """[S12, P8] Benchmark items as questions, the documents that hold them as expected answers."""
    g = evaluation.gold_from_passages(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
    return g.select("question_id", "typ", F.array_join(F.transform("dokumente", lambda d: d.cast("string")), ",").alias("dokumente"))


def evaluated(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    gold = evaluation.gold_from_passages(items, docs).persist()  # a row for each question, used three times; lost blocks are computed again
    v = docs.filter("text IS NOT NULL").select("doc_id", T.hash_embed(F.col("text")).alias("embedding"))
    q = items.select(F.col("item_id").alias("question_id"), T.hash_embed(F.col("text")).alias("query"))
    hits = vectors.knn_batch(v, q, 10, "doc_id", query_id="question_id").select("question_id", F.col("doc_id").alias("document"), F.col("rank").alias("pos"), (1 - F.col("distance")).alias("score"))
    return gold, evaluation.judge(hits, gold)


@query(f"WITH {HITS}, {PER} SELECT question_id, typ, first_rank, hit_at_k, round(top_score, 6) AS top_score FROM per")
def eval_rank(spark, sf_dir):
    """[E1, E2, E3, J5]"""
    gold, hits = evaluated(spark, sf_dir)
    return evaluation.question_results(gold, hits, 5).select("question_id", "typ", "first_rank", "hit_at_k", r6(F.col("top_score")).alias("top_score"))


@query(
    f"""WITH {HITS}, {PER}, m AS (SELECT coalesce(avg(CASE WHEN hit_at_k THEN 1.0 ELSE 0 END) FILTER ({OK}), 0) AS recall, coalesce(avg(coalesce(1.0 / first_rank, 0)) FILTER ({OK}), 0) AS mrr FROM per),
s AS (SELECT coalesce(min(score) FILTER ({OK} AND correct), 0) AS a, coalesce(max(score) FILTER ({OK} AND correct), 0) AS b, coalesce(min(score) FILTER (NOT {OK} AND pos = 1), 0) AS c, coalesce(max(score) FILTER (NOT {OK} AND pos = 1), 0) AS d FROM hits)
SELECT round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(a, 6) AS correct_low, round(b, 6) AS correct_high, round(c, 6) AS noise_low, round(d, 6) AS noise_high, a < d AS overlap FROM m, s"""
)
def eval_metrics(spark, sf_dir):
    """[A4, A5, A6, E4, E6, E10]"""
    gold, hits = evaluated(spark, sf_dir)
    m = evaluation.metrics(gold, hits, 5)
    return m.select(*[r6(F.col(c)).alias(c) for c in m.columns if c != "overlap"], "overlap")


SHIFTED = "(score - 0.6) * 1.25"


@query(
    f"""WITH {HITS}, grid AS (SELECT unnest([{', '.join(map(str, evaluation.GRID))}]::DOUBLE[]) AS threshold),
x AS (SELECT h.*, {SHIFTED} AS s, threshold FROM hits h, grid), r AS (SELECT *, max(CASE WHEN s >= threshold THEN 1 ELSE 0 END) OVER (PARTITION BY question_id, threshold) AS reach FROM x),
k AS (SELECT *, CASE WHEN reach = 1 THEN s >= threshold ELSE pos = 1 END AS kept FROM r),
p AS (SELECT threshold, question_id, typ, count(*) FILTER (kept) AS n, count(*) FILTER (kept AND correct) AS ok, bool_or(correct) AS found FROM k GROUP BY ALL)
SELECT threshold, round(count(*) FILTER ({OK} AND ok > 0) / nullif((SELECT count(*) FROM gold WHERE {OK}), 0)::DOUBLE, 6) AS recall, round(coalesce(sum(ok) FILTER ({OK}) / nullif(sum(n) FILTER ({OK}), 0)::DOUBLE, 0), 6) AS precision,
  CAST(coalesce(sum(n) FILTER (NOT {OK}), 0) AS BIGINT) AS noise_kept, coalesce(array_to_string(list_sort(list(question_id) FILTER ({OK} AND found AND ok = 0)), ','), '') AS lost FROM p GROUP BY threshold"""
)
def eval_thresholds(spark, sf_dir):
    """[E7, E8, A7, J6] Scores are stretched, so that the grid cuts between them."""
    gold, hits = evaluated(spark, sf_dir)
    t = evaluation.thresholds(gold, hits.withColumn("score", (F.col("score") - 0.6) * 1.25))
    return t.select("threshold", r6(F.col("recall")).alias("recall"), r6(F.col("precision")).alias("precision"), "noise_kept", F.array_join(F.transform("lost", lambda x: x.cast("string")), ",").alias("lost"))


@query(f"WITH {HITS}, {PER} SELECT question_id, typ FROM per WHERE {OK} AND first_rank IS NULL")
def answer_misses(spark, sf_dir):
    """[E5]"""
    gold, hits = evaluated(spark, sf_dir)
    return evaluation.misses(gold, hits, 5)


# Model resolution: candidates are made from the part table, machines from suppliers.

QUANTS = list(resolve.QUANT_PENALTY)
CANDIDATES_SQL = f"""SELECT p_brand AS platform, p_partkey AS rank, lower(replace(p_name, ' ', '-')) || CASE p_partkey % 7 WHEN 0 THEN '-pt' WHEN 1 THEN '-coder' ELSE '' END AS model_id,
p_size % 9 <> 0 AS can_run, p_size::BIGINT * 1000000000 AS parameter_count, [{', '.join(f"'{q}'" for q in QUANTS)}][p_partkey % {len(QUANTS) + 2} + 1] AS quant_type,
CASE WHEN p_size % 8 = 0 THEN ['slow', 'Max Context is 8k'] ELSE ['slow'] END AS warnings, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ['EN', 'Multilingual'] WHEN 2 THEN ['de'] ELSE ['en', 'zh'] END AS languages,
CASE WHEN p_partkey % 3 = 0 THEN 'full_gpu' ELSE 'partial' END AS fit_type FROM part"""
ACCEPTED = ", ".join(f"'{q}'" for q, p in resolve.QUANT_PENALTY.items() if p <= resolve.QUANT_PENALTY["Q4_K_S"])
RESOLVED = f"""WITH c AS ({CANDIDATES_SQL}), r AS (SELECT *, CASE WHEN NOT can_run THEN 'cannot_run' WHEN contains(model_id, 'coder') THEN 'name_pattern' WHEN suffix(model_id, '-pt') THEN 'name_suffix'
WHEN parameter_count / 1e9 < 10 THEN 'too_small' WHEN coalesce(quant_type NOT IN ({ACCEPTED}), TRUE) THEN 'quantisation' WHEN len(list_filter(warnings, lambda w: contains(lower(w), 'max context'))) > 0 THEN 'context'
WHEN languages IS NOT NULL AND NOT list_contains(list_transform(languages, lambda l: lower(l)), 'de') AND NOT list_contains(list_transform(languages, lambda l: lower(l)), 'multilingual') THEN 'language' WHEN fit_type <> 'full_gpu' THEN 'partial_fit' END AS reason FROM c)
SELECT platform, coalesce(arg_min(model_id, rank) FILTER (reason IS NULL), arg_min(model_id, rank) FILTER (reason = 'partial_fit')) AS model_id, count(*) FILTER (reason IS NULL) = 0 AND count(*) FILTER (reason = 'partial_fit') > 0 AS fallback,
array_to_string(list_sort(list({{'rank': rank, 'why': model_id || ': ' || reason}}) FILTER (reason IS NOT NULL))[1:10].list_transform(lambda x: x.why), '; ') AS rejected FROM r GROUP BY platform"""


@query(RESOLVED)
def resolve_generator(spark, sf_dir):
    """[P7, F24, F25, F26, M4] The first candidate of each platform that passes every test, or the best partial fit."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    quants = F.array(*[F.lit(q) for q in QUANTS])
    c = p.select(
        F.col("p_brand").alias("platform"),
        k.alias("rank"),
        F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.when(k % 7 == 0, "-pt").when(k % 7 == 1, "-coder").otherwise("")).alias("model_id"),
        (F.col("p_size") % 9 != 0).alias("can_run"),
        (F.col("p_size").cast("long") * 1_000_000_000).alias("parameter_count"),
        F.get(quants, (k % (len(QUANTS) + 2)).cast("int")).alias("quant_type"),
        F.when(F.col("p_size") % 8 == 0, F.array(F.lit("slow"), F.lit("Max Context is 8k"))).otherwise(F.array(F.lit("slow"))).alias("warnings"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.array(F.lit("EN"), F.lit("Multilingual"))).when(k % 5 == 2, F.array(F.lit("de"))).otherwise(F.array(F.lit("en"), F.lit("zh"))).alias("languages"),
        F.when(k % 3 == 0, "full_gpu").otherwise("partial").alias("fit_type"),
    )
    rules = resolve.Criteria(exclude_patterns=["coder"], exclude_suffixes=["-pt"], min_params_b=10, language="de")
    return resolve.resolve_generator(c, rules).withColumn("rejected", F.array_join("rejected", "; "))


MACHINES = "SELECT s_nationkey AS machine, count(*) AS gpu_count, CAST(sum(s_suppkey % 30 * 1073741824) AS BIGINT) AS usable, bool_or(s_suppkey % 10 = 0) AS shared FROM supplier GROUP BY 1"
HEADROOM = "CASE WHEN usable <= 0 THEN 0 ELSE CAST(floor(greatest(536870912.0::DOUBLE, least(usable * 0.05::DOUBLE, 2147483648.0::DOUBLE))) AS BIGINT) END"


def machines(spark, sf_dir):
    gpus = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("machine"), (F.col("s_suppkey") % 30 * resolve.GIB).alias("usable_vram_bytes"), (F.col("s_suppkey") % 10 == 0).alias("shared_memory"))
    return resolve.platforms(gpus)


@query(f"WITH m AS ({MACHINES}) SELECT machine, gpu_count, usable AS usable_vram_bytes, shared AS shared_memory, CASE WHEN usable / 1073741824.0 < 1 THEN 'cpu_only' WHEN shared OR usable / 1073741824.0 <= 10 THEN 'igpu_shared' WHEN usable / 1073741824.0 <= 20 THEN 'dgpu_small' ELSE 'dgpu_large' END AS platform_class, {HEADROOM} AS headroom FROM m")
def platform_class(spark, sf_dir):
    """[F22, F23, M2, A8]"""
    return machines(spark, sf_dir).withColumn("headroom", resolve.vram_headroom(F.col("usable_vram_bytes")))


@query(f"WITH m AS ({MACHINES}), r AS (SELECT c_nationkey AS machine, CAST(sum(c_custkey % 5 * 26843545) AS BIGINT) AS reserved FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1) SELECT machine, usable AS usable_vram_bytes, coalesce(reserved, 0) AS reserved, usable - coalesce(reserved, 0) AS budget, usable - coalesce(reserved, 0) > 0 AS ok FROM m LEFT JOIN r USING (machine)")
def vram_budget(spark, sf_dir):
    """[M3, M5, A8] Side roles are made from all customers; each takes up to a tenth of a GiB."""
    roles = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("machine"), F.when(F.col("c_custkey") % 3 == 0, "gpu").otherwise("cpu").alias("device"), (F.col("c_custkey") % 5 * 26843545).alias("vram_bytes"))
    return resolve.generator_budget(machines(spark, sf_dir), roles)


LENGTH = "CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 64 + 1) || 'k' WHEN 1 THEN ' ' || (o_orderkey % 9 + 0.5) || 'K ' ELSE CAST(o_orderkey AS VARCHAR) END"


@query(f"WITH v AS (SELECT o_orderkey, lower(trim({LENGTH})) AS v FROM orders) SELECT o_orderkey, CAST(CASE WHEN suffix(v, 'k') THEN floor(CAST(string_split(v, 'k')[1] AS DOUBLE) * 1024) ELSE TRY_CAST(v AS BIGINT) END AS BIGINT) AS tokens FROM v")
def context_length(spark, sf_dir):
    """Notations made from the order keys."""
    k = F.col("o_orderkey")
    v = F.when(k % 3 == 0, F.concat((k % 64 + 1).cast("string"), F.lit("k"))).when(k % 3 == 1, F.concat(F.lit(" "), (k % 9 + 0.5).cast("string"), F.lit("K "))).otherwise(k.cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.context_length(v).alias("tokens"))
