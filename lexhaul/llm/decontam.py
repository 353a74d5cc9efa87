"""Benchmark decontamination over a positional inverted index, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexhaul.llm.common import Scratch, broadcast_if

#: What separates words, before A-Z are lower-cased.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A document row in the index: its id and the hash of its text, so that rows with a repeated id stay apart.
DOC = ["_doc", "_text"]


def lowered(word: Column) -> Column:
    """A-Z lower-cased and nothing else; translate() is slow, and only words with other letters need it."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def doc_key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    return [docs[id_col].alias("_doc"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("_text")]


@dataclass
class Index:
    """postings: _doc, _text, pos, term; terms: word, term, freq; windows: wid, off, term, freq, len; owners: wid, item."""

    postings: DataFrame
    windows: DataFrame
    owners: DataFrame
    n_windows: int
    scratch: Scratch


def build(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> Index:
    """Stores the position of every training token that some benchmark item contains, and the items' windows.

    Tokens of no item are in no phrase that is ever asked for, so their lists are not stored. Windows are
    the `window` consecutive words from every start in an item, or all words of a shorter item that has
    any; equal windows are one. A window with a word that the corpus lacks is dropped: it cannot occur.
    """
    scratch = Scratch(docs.sparkSession)
    words = lambda t: F.filter(F.split(F.coalesce(t, F.lit("")), SEPARATOR), lambda w: w != "")
    asked = items.select(items[item_id].alias("item"), F.transform(words(items[item_text]), lowered).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = asked.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s") + 1, window).alias("w"))
    cut = scratch.write(cut, "cut")
    distinct = scratch.write(cut.select("w").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    vocabulary = scratch.write(distinct.select(F.explode("w").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id()), "terms")
    few = vocabulary.count()
    tokens = docs.select(*doc_key(docs, id_col, text_col), F.split(docs[text_col], SEPARATOR).alias("w")).select(*DOC, F.posexplode("w").alias("pos", "raw"))
    tokens = tokens.select(*DOC, "pos", lowered(F.col("raw")).alias("word"))
    postings = scratch.write(tokens.join(broadcast_if(vocabulary, few), "word").select(*DOC, "pos", "term"), "postings")
    freq = scratch.write(postings.groupBy("term").agg(F.count(F.lit(1)).alias("freq")), "freq")
    places = distinct.select("wid", F.size("w").alias("len"), F.posexplode("w").alias("off", "word")).join(vocabulary, "word").join(freq, "term")
    own = Window.partitionBy("wid")
    places = places.withColumn("found", F.count(F.lit(1)).over(own)).filter("found = len").withColumn("rank", F.row_number().over(own.orderBy("freq", "off")))
    places = scratch.write(places.select("wid", "len", "off", "term", "freq", "rank"), "places")
    owners = scratch.write(cut.join(distinct, "w").select("wid", "item").distinct(), "owners")
    return Index(postings, places, owners, distinct.count(), scratch)


def phrases(index: Index) -> DataFrame:
    """Exact matches: _doc, _text, wid, start, len.

    The list of each window's rarest term, shifted by the term's offset, gives the possible starts; the
    second rarest term's shifted list is intersected with them, which leaves little more than true
    matches; then every remaining term's list. Every step is an equi-join on document and position, so no
    step can make more rows than the rarest term has occurrences, and no document is gathered anywhere.
    """
    w, post, scratch = index.windows, index.postings, index.scratch
    place = lambda k: w.filter(F.col("rank") == k).select("wid", "len", "off", "term")
    few = index.n_windows
    first = post.join(broadcast_if(place(1), few), "term").select(*DOC, "wid", "len", (F.col("pos") - F.col("off")).alias("start"))
    second = place(2).select("wid", F.col("off").alias("off2"), F.col("term").alias("term2"))
    lists = post.join(broadcast_if(second.select(F.col("term2").alias("term")).distinct(), few), "term", "left_semi").select(*(F.col(c).alias(f"{c}2") for c in DOC), F.col("pos").alias("at"), F.col("term").alias("t2"))
    ahead = first.filter("len > 1").join(broadcast_if(second, few), "wid")
    on = [F.col("_doc").eqNullSafe(F.col("_doc2")), F.col("_text") == F.col("_text2"), F.col("at") == F.col("start") + F.col("off2"), F.col("t2") == F.col("term2")]
    both = scratch.write(ahead.join(lists, on, "left_semi").select(*DOC, "wid", "len", "start").distinct(), "both")  # rows that repeat id and text post every word again
    rest = w.filter("rank > 2").select("wid", "off", "term")
    probes = both.filter("len > 2").join(broadcast_if(rest, few * 10), "wid").select(*DOC, "wid", "len", "start", (F.col("start") + F.col("off")).alias("pos"), "term")
    where = scratch.write(both.select(*DOC).distinct(), "where")
    near = post.join(broadcast_if(where.select(*(F.col(c).alias(f"{c}2") for c in DOC)), where.count()), [F.col("_doc").eqNullSafe(F.col("_doc2")), F.col("_text") == F.col("_text2")], "left_semi")
    near = near.select(*(F.col(c).alias(f"{c}2") for c in DOC), F.col("pos").alias("at"), F.col("term").alias("t2"))
    on = [F.col("_doc").eqNullSafe(F.col("_doc2")), F.col("_text") == F.col("_text2"), F.col("at") == F.col("pos"), F.col("t2") == F.col("term")]
    whole = probes.join(near, on, "left_semi").groupBy(*DOC, "wid", "len", "start").count().filter("count = len - 2").drop("count")
    single = first.filter("len = 1").select(*DOC, "wid", "len", "start")
    return whole.unionByName(both.filter("len = 2")).unionByName(single)


def proximity(index: Index, slop: int = 5) -> DataFrame:
    """Places where some stretch of len + slop words holds all distinct terms of a window, in any order: _doc, _text, wid, at.

    `at` is the place of the window's rarest term in that stretch. A window of one distinct term has only exact matches
    and none here. As for phrases, the lists of the two rarest terms are joined first; what they leave is
    little, and asks for the other terms. Positions are dealt to cells of twice the longest reach, and each
    place asks the cells of the two ends of its reach, so every join is an equi-join.
    """
    w, post, scratch = index.windows, index.postings, index.scratch
    longest = w.agg(F.max("len").alias("m")).first()["m"]
    if longest is None:
        return post.select(*DOC, F.lit(0).cast("long").alias("wid"), F.lit(0).alias("at")).limit(0)
    cell = lambda c: F.floor(c / (2 * (longest + slop))).cast("long")
    reach = (F.col("len") + slop).alias("reach")
    terms = w.select("wid", "term", "freq", reach).distinct()
    own = Window.partitionBy("wid")
    terms = scratch.write(terms.withColumns({"need": F.count(F.lit(1)).over(own), "rank": F.row_number().over(own.orderBy("freq", "term"))}).filter("need > 1").drop("freq"), "near-terms")
    few = index.n_windows
    rare = terms.filter("rank = 1").select("wid", "term", "reach").join(terms.filter("rank = 2").select("wid", F.col("term").alias("term2")), "wid")
    asked = lambda df: df.withColumn("cell", F.explode(F.array_distinct(F.array(cell(F.col("at") - F.col("reach")), cell(F.col("at") + F.col("reach"))))))
    on = [F.col("_doc").eqNullSafe(F.col("_doc2")), F.col("_text") == F.col("_text2"), F.col("cell") == F.col("cell2"), F.col("term2") == F.col("t2")]
    second = post.join(broadcast_if(terms.filter("rank = 2").select("term").distinct(), few), "term", "left_semi")
    placed = lambda df: df.select(*(F.col(c).alias(f"{c}2") for c in DOC), F.col("pos").alias("pos2"), F.col("term").alias("t2"), cell(F.col("pos")).alias("cell2"))
    within = F.abs(F.col("pos2") - F.col("at")) < F.col("reach")
    anchors = asked(post.join(broadcast_if(rare, few), "term").select(*DOC, "wid", "reach", "term2", F.col("pos").alias("at")))
    close = scratch.write(anchors.join(placed(second), on).filter(within).select(*DOC, "wid", "reach", "at").distinct(), "near-both")
    where = scratch.write(close.select(*DOC).distinct(), "near-where")
    near = post.join(broadcast_if(where.select(*(F.col(c).alias(f"{c}2") for c in DOC)), where.count()), [F.col("_doc").eqNullSafe(F.col("_doc2")), F.col("_text") == F.col("_text2")], "left_semi")
    asks = asked(close.join(broadcast_if(terms.select("wid", "need", F.col("term").alias("term2")), few * 10), "wid"))
    met = asks.join(placed(near), on).filter(within).groupBy(*DOC, "wid", "at", "reach", "need").agg(F.collect_set(F.struct("pos2", "t2")).alias("p"))
    held = lambda first: F.size(F.array_distinct(F.transform(F.filter("p", lambda x: x["pos2"].between(first, first + F.col("reach") - 1)), lambda x: x["t2"])))
    return met.filter(F.exists(F.sequence(F.col("at") - F.col("reach") + 1, F.col("at")), lambda first: held(first) == F.col("need"))).select(*DOC, "wid", "at")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", slop: int = 5) -> DataFrame:
    """One row for each row of `docs`: id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items.

    A word inside any occurrence of a window is hit. items_sha256 is of the sorted, comma-joined ids of
    the items with occurring windows, of the empty string without any. n_near_items counts the items of which a window's
    words all lie within `slop` words more than its length, in any order (see proximity). Null and empty texts have no
    words; items without words have no window; no items, no hits. Rows with a repeated id each get the
    hits of their own text, a null id included; items with a repeated id count once. Only the named
    columns are read.
    """
    index = build(docs, items, window, id_col, text_col, item_id, item_text)
    found = index.scratch.write(phrases(index), "found")
    hit = found.select(*DOC, F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("pos")).distinct().groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_hit"))
    who = found.select(*DOC, "wid").distinct().join(index.owners, "wid").groupBy(*DOC).agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("who"))
    marks = index.scratch.write(hit.join(who, [hit[c].eqNullSafe(who[c]) for c in DOC]).select(hit["_doc"].alias("_doc2"), hit["_text"].alias("_text2"), "n_hit", "who"), "marks")
    near = proximity(index, slop).select(*DOC, "wid").distinct().join(index.owners, "wid").groupBy(*DOC).agg(F.countDistinct("item").alias("n_near"))
    near = index.scratch.write(near.select(F.col("_doc").alias("_doc3"), F.col("_text").alias("_text3"), "n_near"), "near")
    rows = docs.select(*doc_key(docs, id_col, text_col), F.split(F.coalesce(docs[text_col], F.lit("")), SEPARATOR).alias("_w"))
    n_words = F.size("_w") - (F.element_at("_w", 1) == "").cast("int") - ((F.size("_w") > 1) & (F.element_at("_w", -1) == "")).cast("int")
    rows = rows.select(*DOC, n_words.cast("long").alias("n_words"))
    out = rows.join(marks, [F.col("_doc").eqNullSafe(F.col("_doc2")), F.col("_text") == F.col("_text2")], "left").join(near, [F.col("_doc").eqNullSafe(F.col("_doc3")), F.col("_text") == F.col("_text3")], "left")
    who = F.coalesce("who", F.array().cast("array<string>"))
    return out.select(
        F.col("_doc").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(who).cast("long").alias("n_items"), F.sha2(F.array_join(who, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near_items")
    )


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`docs` without the contaminated rows, all columns as they were."""
    index = build(docs, items, id_col=id_col, text_col=text_col, **how)
    bad = index.scratch.write(phrases(index).select(*(F.col(c).alias(f"{c}2") for c in DOC)).distinct(), "bad")
    text = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_doc2"]) & (text == bad["_text2"]), "left_anti")
