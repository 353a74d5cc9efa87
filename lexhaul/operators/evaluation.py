"""Retrieval quality: ranks, recall, reciprocal rank, score ranges, threshold curves.

hits: question_id, pos, score, correct. questions: question_id, typ.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The threshold grid and the answerable question types.
GRID = (0.0, 0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5)
ANSWERABLE = ("eindeutig", "mehrdeutig")


def answerable(typ: Column) -> Column:
    """[P8]"""
    return F.coalesce(typ.isin(*ANSWERABLE), F.lit(False))


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """[S12] id, frage, typ, dokumente, abschnitt, antwort_enthaelt, notiz of a {"fragen": [...]} file; empty or incomplete files are errors."""
    schema = "fragen array<struct<id:string,frage:string,typ:string,dokumente:array<string>,abschnitt:string,antwort_enthaelt:array<string>,notiz:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("fragen").alias("q")).select("q.*")
    rows = rows.withColumns({"dokumente": F.coalesce("dokumente", F.array().cast("array<string>")), "antwort_enthaelt": F.coalesce("antwort_enthaelt", F.array().cast("array<string>"))})
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id").isNull() | F.col("frage").isNull() | F.col("typ").isNull()).alias("bad")).first()
    if not found["n"] or found["bad"]:
        raise ValueError(f"gold standard {path}: {found['n']} questions, {found['bad']} without id, frage or typ")
    return rows


def passages_in(docs: DataFrame, passages: dict[int, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, passage: each document with the number of each passage that it contains, by one walk over its text.

    All passages form one automaton, which each task builds once from a broadcast; what a task holds beside it is one batch of texts.
    """
    held = docs.sparkSession.sparkContext.broadcast(passages)
    kind = docs.schema[id_col].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ahocorasick import Automaton

        machine = Automaton()
        for number, text in held.value.items():
            machine.add_word(text, number)
        machine.make_automaton()
        for b in batches:
            rows, found = [], []
            for k, text in enumerate(b.column(1)):
                own = {n for _, n in machine.iter(text.as_py() or "")}
                rows += [k] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.int64())], [id_col, "passage"])

    return docs.select(id_col, text_col).mapInArrow(walk, f"{id_col} {kind}, passage long")


def gold_from_passages(items: DataFrame, docs: DataFrame, most_chars: int = 20_000_000) -> DataFrame:
    """Questions whose expected documents are those that contain the item's text: question_id, dokumente, typ.

    Distinct passages are numbered and sent to the tasks in automata of at most `most_chars` characters, or of one passage that is
    longer; each automaton is one scan of the documents, whatever its passages look like. Items with null or empty text have no document.
    """
    kept = items.filter("text IS NOT NULL AND text <> ''").select("text").distinct()
    total = kept.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-2 * total // most_chars))  # twice as many as needed on average, so that hardly any is too large
    found = None
    for g in range(groups):
        share = kept if groups == 1 else kept.filter(F.pmod(F.xxhash64("text"), F.lit(groups)) == g)
        texts = sorted(r["text"] for r in share.collect())
        while texts:
            size, n = 0, 0
            while n < len(texts) and (not n or size + len(texts[n]) <= most_chars):
                size, n = size + len(texts[n]), n + 1
            part, texts = dict(enumerate(texts[:n])), texts[n:]
            names = docs.sparkSession.createDataFrame([(k, t) for k, t in part.items()], "passage long, text string")
            met = passages_in(docs, part).join(names, "passage").select("text", "doc_id")
            found = met if found is None else found.unionByName(met)
    if found is None:
        found = docs.select(F.lit("").alias("text"), "doc_id").limit(0)
    # numbers of documents for each text, then once for each item
    lists = found.groupBy("text").agg(F.sort_array(F.collect_set("doc_id")).alias("dokumente"))
    out = items.select("item_id", "text").join(lists, "text", "left")
    typ = F.when(F.col("dokumente").isNull(), "ohne_antwort").when(F.size("dokumente") == 1, "eindeutig").otherwise("mehrdeutig")
    return out.select(F.col("item_id").alias("question_id"), F.coalesce("dokumente", F.array().cast("array<bigint>")).alias("dokumente"), typ.alias("typ"))


def judge(hits: DataFrame, gold: DataFrame, document: str = "document") -> DataFrame:
    """[E1, J5] Adds correct: the hit's document is expected."""
    return hits.join(gold.select("question_id", "dokumente"), "question_id").withColumn("correct", F.array_contains("dokumente", F.col(document))).drop("dokumente")


def question_results(questions: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """[E2, E3, E4] question_id, typ, first_rank, hit_at_k, top_score (0 without hits)."""
    per = hits.groupBy("question_id").agg(F.min(F.when(F.col("correct"), F.col("pos"))).alias("first_rank"), F.bool_or(F.col("correct") & (F.col("pos") <= k)).alias("hit_at_k"), F.min_by("score", "pos").alias("top_score"))
    return questions.select("question_id", "typ").join(per, "question_id", "left").withColumns({"hit_at_k": F.coalesce("hit_at_k", F.lit(False)), "top_score": F.coalesce("top_score", F.lit(0.0))})


def metrics(questions: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """[A4, A5, A6, E4, E6, E10] One row: recall, mrr, ranges of correct and noise scores, and whether no threshold separates them."""
    per, ok = question_results(questions, hits, k), answerable(F.col("typ"))
    found = per.agg(
        F.coalesce(F.avg(F.when(ok, F.col("hit_at_k").cast("double"))), F.lit(0.0)).alias("recall"),
        F.coalesce(F.avg(F.when(ok, F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))), F.lit(0.0)).alias("mrr"),
    )
    scored = hits.join(questions.select("question_id", "typ"), "question_id").agg(
        *[F.coalesce(f(F.when(ok & F.col("correct"), F.col("score"))), F.lit(0.0)).alias(f"correct_{n}") for n, f in (("low", F.min), ("high", F.max))],
        *[F.coalesce(f(F.when(~ok & (F.col("pos") == 1), F.col("score"))), F.lit(0.0)).alias(f"noise_{n}") for n, f in (("low", F.min), ("high", F.max))],
    )
    return found.crossJoin(scored).withColumn("overlap", F.col("correct_low") < F.col("noise_high"))


def misses(questions: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """[E5] Answerable questions without a correct hit."""
    return question_results(questions, hits, k).filter(answerable(F.col("typ")) & F.col("first_rank").isNull()).select("question_id", "typ")


def thresholds(questions: DataFrame, hits: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """[E7, E8, A7, J6] threshold, recall, precision, noise_kept, lost: each threshold keeps scores from it on, the first hit if none reaches it.

    A hit is exploded over the grid (13 values), then everything is two aggregations.
    """
    ok = answerable(F.col("typ"))
    n = questions.agg(F.count_if(ok).alias("_n"))
    rows = hits.join(questions.select("question_id", "typ"), "question_id").withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in grid])))
    reach = F.max((F.col("score") >= F.col("threshold")).cast("int")).over(Window.partitionBy("question_id", "threshold")) == 1
    kept = F.when(reach, F.col("score") >= F.col("threshold")).otherwise(F.col("pos") == 1)
    per = rows.withColumn("kept", kept).groupBy("threshold", "question_id", "typ").agg(
        F.count_if("kept").alias("kept"), F.count_if(F.col("kept") & F.col("correct")).alias("right"), F.bool_or("correct").alias("found")
    )
    out = per.groupBy("threshold").agg(
        F.count_if(ok & (F.col("right") > 0)).alias("_ok"),
        F.coalesce(F.sum(F.when(ok, F.col("kept"))), F.lit(0)).alias("_kept"),
        F.coalesce(F.sum(F.when(ok, F.col("right"))), F.lit(0)).alias("_right"),
        F.coalesce(F.sum(F.when(~ok, F.col("kept"))), F.lit(0)).cast("long").alias("noise_kept"),
        F.sort_array(F.collect_list(F.when(ok & F.col("found") & (F.col("right") == 0), F.col("question_id")))).alias("lost"),
    )
    return out.crossJoin(F.broadcast(n)).select("threshold", F.when(F.col("_n") > 0, F.col("_ok") / F.col("_n")).otherwise(0.0).alias("recall"), F.when(F.col("_kept") > 0, F.col("_right") / F.col("_kept")).otherwise(0.0).alias("precision"), "noise_kept", "lost")
