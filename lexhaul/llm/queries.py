"""The opN_ queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexhaul.llm import align, decontam, exact_dedup, jaccard, kmeans, langid, lm, packing, pii, topk, toxicity, urls, windows
from lexhaul.llm.common import remainder, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon and calibration see only labelled rows that are not held out; a fourth of those by id calibrates."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = toxicity.sample_labels(labels.filter(remainder(labels["doc_id"], 5) != 0).select("doc_id", "toxic"))
    known = docs.select("doc_id", "text").join(F.broadcast(learn), "doc_id").select("text", "toxic", (remainder(F.col("doc_id"), 5) == 4).alias("fold"))
    grammar = toxicity.fit(known, fold_col="fold")
    return toxicity.score(docs, grammar).withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 4096, 1)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN g USING (norm)
"""

def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.repeated_passages(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), span AS (
  SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS p
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d), (SELECT DISTINCT k FROM win) WHERE s + k - 1 <= len(w)
), m AS (SELECT DISTINCT span.doc_id, span.s, span.k, win.item_id FROM span JOIN win USING (p, k)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM m GROUP BY doc_id),
bag AS (SELECT DISTINCT p, k, list_sort(list_distinct(string_split(p, ' '))) AS t FROM win WHERE len(list_distinct(string_split(p, ' '))) > 1),
dw AS (SELECT DISTINCT doc_id, unnest(w) AS word FROM d),
df AS (SELECT word, count(*) AS n FROM dw GROUP BY word),
rare AS (SELECT p, arg_min(word, n) AS word FROM (SELECT p, unnest(t) AS word FROM bag) JOIN df USING (word) GROUP BY p),
near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (
    SELECT d.doc_id, bag.p FROM dw JOIN rare USING (word) JOIN bag USING (p) JOIN d ON d.doc_id = dw.doc_id
    WHERE list_has_all(d.w, bag.t) AND len(list_filter(range(1, len(d.w) + 1), lambda s: list_has_all(d.w[s:s + bag.k + 4], bag.t))) > 0
  ) JOIN win USING (p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, CAST(coalesce(len(i.ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(i.ids, ','), '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated,
       coalesce(near.n_near, 0) AS n_near_items
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN near USING (doc_id)
"""


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), 75, 100)


#: Fixed values of the query's contract.
URL_RULES = [urls.Rule("net/", "block"), urls.Rule("example.net/en/", "allow"), urls.Rule("example.com/de/", "block"), urls.Rule("org/fr/", "allow")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled urls are those that a rule decides."""
    pages = table(spark, sf_dir, "pages")
    label = urls.rule_match(urls.host_of(pages["url"]), urls.path_of(pages["url"]), URL_RULES, "verdict")
    return urls.judge(pages, URL_RULES, urls.fit(pages.select("url", label.alias("label"))))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(docs["doc_id"], 4) == 2
    model = langid.fit(docs.filter(langid.learnable(held_out)))
    return langid.identify(docs, model).withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A production key comes from a secret store; this one only makes the query repeatable."""
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key="lexhaul-surrogates")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).documents


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_products(vectors, vectors["vec_id"] % 20 == 0, 20, 64)


#: SQL for a vector as whole numbers, null if it holds a null, NaN or infinite component.
WHOLE = "CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) END"
OP12_SQL = f"""
WITH k AS (SELECT * FROM (SELECT vec_id, {WHOLE.format(scale=64)} AS v FROM embeddings) WHERE v IS NOT NULL),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM k q JOIN k c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dimensions=64, scale=1024, seed="3")


def _op13_sql(rounds: int = 10) -> str:
    """The rounds written out: plain assignment of all rows to all centroids, no bounds."""
    near = lambda r: f"a{r} AS MATERIALIZED (SELECT k.vec_id, k.v, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM k, c{r} c QUALIFY row_number() OVER (PARTITION BY k.vec_id ORDER BY d, c.c) = 1)"
    sums = lambda r: f"SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY c, i"
    move = lambda r: f"c{r + 1} AS MATERIALIZED (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM ({sums(r)}) GROUP BY c UNION ALL SELECT c, v FROM c{r} WHERE c NOT IN (SELECT c FROM a{r}))"
    steps = ", ".join(f"{near(r)}, {move(r)}" for r in range(rounds))
    return f"""
WITH k AS MATERIALIZED (SELECT * FROM (SELECT vec_id, {WHOLE.format(scale=1024)} AS v FROM embeddings WHERE len(embedding) = 64) WHERE v IS NOT NULL),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) - 1 AS c, v FROM k QUALIFY c < 8),
{steps}, {near(rounds)},
h AS (SELECT c, sha256(array_to_string(list_transform(v, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256 FROM c{rounds})
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN h USING (c)
"""


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_best_fit_packing, op3_exact_dedup, op4_substring_dedup, op5_decontamination, op6_lm_scoring, op7_jaccard_join, op8_url_filter, op9_language_id, op10_pii_surrogates, op11_tokenizer_alignment, op12_exact_topk, op13_centroid_clustering)}
ORACLES = {"op3_exact_dedup": OP3_SQL, "op5_decontamination": OP5_SQL, "op12_exact_topk": OP12_SQL, "op13_centroid_clustering": _op13_sql()}
