"""Retrieval in one call, and answers with citations from pluggable models."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexhaul.functions import text as T
from lexhaul.operators import ranking, vectors
from lexhaul.session import shared_folder


@dataclass(frozen=True)
class Embedder:
    """A model that turns texts into vectors. encode and count are columns to columns, so a Pandas UDF gets whole batches."""

    name: str
    dimensions: int
    encode: Callable[[Column], Column]
    count: Callable[[Column], Column] = T.estimate_tokens
    max_tokens: int = 512

    def fits(self, text: Column) -> Column:
        return self.count(text) <= self.max_tokens


@dataclass(frozen=True)
class CrossEncoder:
    """[R8] A model that scores pairs of question and passage, as a column of both; higher is better."""

    name: str
    predict: Callable[[Column, Column], Column]


def extract(question: Column, sources: Column) -> Column:
    """A generator that needs no model: the first sentence of the first source, with its number; null without sources."""
    first = F.get(sources, 0)
    body = F.substr(first, F.instr(first, "\n") + 1, F.char_length(first))
    return F.when(F.size(sources) > 0, F.concat(F.get(T.sentences(body), 0), F.lit(" [1]")))


def retrieve(index: DataFrame, questions: DataFrame, k: int = ranking.TOP_K, reranker: CrossEncoder | None = None, min_score: float = 0.0, width: int = ranking.CANDIDATES) -> DataFrame:
    """Two stages in one call: query_id, question, pos, chunk_id, text, citation, distance, score.

    index: chunk_id, text, citation, embedding. questions: query_id, question, query (a vector). Without a re-ranker
    the nearest `k` come, score null; with one the nearest `width` are scored and ranking.rerank picks. Texts are joined
    to the hits only.
    """
    hits = vectors.knn_batch(index, questions, width if reranker else k, "chunk_id").join(questions.select("query_id", "question"), "query_id")
    hits = hits.join(index.select("chunk_id", "text", "citation"), "chunk_id")
    if reranker:
        hits = ranking.rerank(hits.drop("rank"), reranker.predict(F.col("question"), F.col("text")), k, min_score)
    else:
        hits = hits.withColumnRenamed("rank", "pos").withColumn("score", F.lit(None).cast("double"))
    return hits.select("query_id", "question", "pos", "chunk_id", "text", "citation", "distance", "score")


def ask(index: DataFrame, questions: DataFrame, generate: Callable[[Column, Column], Column] = extract, context_tokens: int = 4096, **how) -> DataFrame:
    """Retrieves, fits the hits into the context as numbered sources, answers, and reads the citations.

    One row for each question: query_id, question, answer, n_sources, dropped, chunk_ids, cited, uncited. A question
    without a hit keeps its row, without an answer. generate: question and rendered sources to an answer; the longest text a
    task gathers is that of one context. The few hits are written once to the shared folder, as what follows reads them three times.
    """
    spark, hits = index.sparkSession, retrieve(index, questions, **how)
    at = f"{shared_folder(spark)}/hits-{uuid.uuid4().hex}"
    hits.write.parquet(at)
    kept = ranking.build_sources(spark.read.schema(hits.schema).parquet(at), context_tokens)
    rendered = F.struct("number", T.render_source(F.col("number"), F.col("citation"), F.col("text")).alias("source"), "chunk_id")
    found = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(rendered)).alias("s"), F.first("dropped").alias("dropped"))
    rows = questions.select("query_id", "question").join(found, "query_id", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<number:int,source:string,chunk_id:bigint>>")))
    rows = rows.withColumn("answer", generate(F.col("question"), F.transform("s", lambda x: x["source"])))
    numbers, said = F.transform("s", lambda x: x["number"]), F.coalesce("answer", F.lit(""))
    return rows.select("query_id", "question", "answer", F.size("s").alias("n_sources"), F.coalesce("dropped", F.lit(0)).cast("long").alias("dropped"), F.transform("s", lambda x: x["chunk_id"]).alias("chunk_ids"), F.array_intersect(numbers, T.cited_numbers(said)).alias("cited"), T.uncited(numbers, said).alias("uncited"))
