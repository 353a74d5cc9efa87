"""Re-ranking, thresholds, source budgets, source reuse and prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexhaul.functions.text import render_source, tokens_of_length

#: Share of a context that sources may fill, and the width of the first retrieval stage.
BUDGET_SHARE, CANDIDATES, TOP_K = 0.6, 30, 5


def rerank(hits: DataFrame, score: Column, top_k: int = TOP_K, min_score: float = 0.0, width: int = CANDIDATES, query: str = "query_id", distance: str = "distance", tie: str = "chunk_id") -> DataFrame:
    """[R1, R2, R3, P5] For each query: the nearest `width` hits, scored, best `top_k`, those under `min_score` dropped but for the first.

    A query with a single hit keeps it unscored. Equal scores keep distance order. Adds score, pos.
    """
    near = Window.partitionBy(query).orderBy(distance, tie)
    first = hits.withColumn("_near", F.row_number().over(near)).filter(F.col("_near") <= width)
    alone = F.count(F.lit(1)).over(Window.partitionBy(query)) == 1
    scored = first.withColumn("_alone", alone).withColumn("score", F.when(F.col("_alone"), F.lit(None).cast("double")).otherwise(score))
    ranked = scored.withColumn("pos", F.row_number().over(Window.partitionBy(query).orderBy(F.desc_nulls_first("score"), distance, tie))).filter(F.col("pos") <= top_k)
    keep = (F.col("pos") == 1) | F.col("_alone") | F.lit(min_score <= 0) | (F.col("score") >= min_score)
    return ranked.filter(keep).drop("_near", "_alone")


def build_sources(hits: DataFrame, context_tokens: int, query: str = "query_id", pos: str = "pos", cite: str = "citation", text: str = "text") -> DataFrame:
    """[R5, F17] Hits in order as numbered sources until the first that does not fit; the first always does. Adds number, cost, used, dropped.

    Every cost is at least 1, so no hit after the first `budget` ones can fit, and the stop is a running sum over
    those; the number is part of the cost it causes. Only lengths are ranked; texts are joined to what stays.
    """
    budget = int(context_tokens * BUDGET_SHARE)
    own = Window.partitionBy(query).orderBy(pos)
    rows = hits.select(query, pos, F.col(cite).alias("_cite"), F.char_length(text).alias("_n")).withColumn("number", F.row_number().over(own)).filter(F.col("number") <= max(1, budget))
    chars = F.char_length(render_source(F.col("number"), F.col("_cite"), F.lit(""))) + F.coalesce("_n", F.lit(0))
    rows = rows.withColumn("cost", tokens_of_length(chars)).withColumn("used", F.sum("cost").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.filter((F.col("number") == 1) | (F.col("used") <= budget)).drop("_cite", "_n")
    counts = hits.groupBy(query).agg(F.count(F.lit(1)).alias("_all")).join(rows.groupBy(query).agg(F.count(F.lit(1)).alias("_kept")), query).select(query, (F.col("_all") - F.col("_kept")).alias("dropped"))
    return hits.join(rows, [query, pos]).join(counts, query)


def reusable_hits(sources: DataFrame, conversation: str = "conv_id", turn: str = "turn", pos: str = "pos", chunk: str = "chunk_id") -> DataFrame:
    """[R4] Each chunk once, at its newest turn; newest turns first, source order inside a turn. Adds reuse_rank."""
    newest = F.row_number().over(Window.partitionBy(conversation, chunk).orderBy(F.desc(turn), pos))
    once = sources.withColumn("_n", newest).filter("_n = 1").drop("_n")
    return once.withColumn("reuse_rank", F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(turn), pos, chunk)))


def turn_pairs(messages: DataFrame) -> DataFrame:
    """Question and answer of each user message directly followed by an assistant's: conv_id, turn, question, answer."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.withColumn("next_role", F.lead("role").over(own)).withColumn("answer", F.lead("text").over(own))
    return rows.filter("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def prompt(system: Column, history: Column, sources: Column, question: Column, instruction: str = "") -> Column:
    """array<struct<role, content>>: system, past turns without their sources, then the sources and the question; null without sources.

    history: array<struct<question, answer>>; sources: array of rendered sources; instruction ends the last message.
    """
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    past = F.flatten(F.transform(history, lambda t: F.array(message("user", t["question"]), message("assistant", t["answer"]))))
    last = F.concat(F.array_join(sources, "\n\n"), F.lit("\n\n"), question, F.lit(f"\n\n{instruction}" if instruction else ""))
    return F.when(F.size(sources) > 0, F.concat(F.array(message("system", system)), past, F.array(message("user", last))))


def route_prompt(system: Column, history: Column, available: Column, question: Column, marker: str = "QUELLEN_REICHEN") -> Column:
    """The routing question: past turns, citations at hand, the follow-up, and the two kinds of reply that parse_route reads."""
    past = F.array_join(F.flatten(F.transform(history, lambda t: F.array(F.concat(F.lit("F: "), t["question"]), F.concat(F.lit("A: "), t["answer"])))), "\n")
    held = F.array_join(F.transform(available, lambda a: F.concat(F.lit("* "), a)), "\n")
    user = F.concat_ws("\n\n", F.when(F.size(history) > 0, past), F.when(F.size(available) > 0, F.concat(F.lit("Schon gefunden:\n"), held)), F.concat(F.lit("F: "), question), F.lit(f"Genügt das Gefundene, schreibe {marker}, sonst nur einen Suchtext."))
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def plan_retrieval(turns: DataFrame, reply: Callable[[Column], Column] | None) -> DataFrame:
    """[R7] Adds reuse and query to rows of question, has_history, has_sources; without history no routing call, and a null reply searches with the question."""
    from lexhaul.functions.text import parse_route

    if reply is None:
        return turns.withColumns({"reuse": F.lit(False), "query": F.col("question")})
    said = F.when(F.col("has_history"), reply(F.col("question")))
    route = parse_route(said, F.col("question"), F.col("has_sources"))
    return turns.withColumns({"reuse": F.coalesce(F.when(said.isNotNull(), route["reuse"]), F.lit(False)), "query": F.coalesce(F.when(said.isNotNull(), route["query"]), F.col("question"))})
