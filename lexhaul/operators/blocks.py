"""Markdown blocks as rows, by a scan over lines that splits over tasks.

What a line is depends on all lines before it, but only through a state of three values: outside of code, inside ``` or
inside ~~~. A line is a function on states, functions compose, and so a segment of lines is one small function
too. Segments are composed apart, their few functions are folded for each document, and each segment then runs
again with the state that it begins with. A single huge document is dealt over tasks like many small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexhaul.functions import text as T

#: Lines of a segment: what a task sees together.
SEGMENT = 2048
# Where lines end, and the forms of a fence, a heading and a table row.
BREAK = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
FENCE = rf"^[{T.WS}]*(```|~~~)"
TITLE = rf"^(#{{1,6}})[{T.WS}]+(.+?)[{T.WS}]*#*$"
ROW = rf"^[{T.WS}]*\|.*\|[{T.WS}]*$"
#: States: outside of code, inside of either fence.
OUT, TICKS, TILDES = 0, 1, 2


def segments(docs: DataFrame, id_col: str, text_col: str, segment: int = SEGMENT) -> DataFrame:
    """_id, n (how many segments the text has), seg, lines of each segment; a break at the very end opens no further line, null text has none."""
    rows = docs.select(F.col(id_col).alias("_id"), F.split(F.col(text_col), BREAK).alias("whole")).filter("whole IS NOT NULL")
    rows = rows.withColumn("size", F.size("whole") - (F.element_at("whole", -1) == "").cast("int"))
    rows = rows.withColumn("n", F.ceil(F.col("size") / segment).cast("int")).filter("n > 0")
    return rows.select("_id", "n", "whole", "size", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("seg")).select("_id", "n", "seg", F.slice("whole", F.col("seg") * segment + 1, F.least(F.lit(segment), F.col("size") - F.col("seg") * segment)).alias("lines"))


def fence(line: Column) -> Column:
    """TICKS or TILDES for a line that opens or closes code, else null."""
    found = F.regexp_extract(line, FENCE, 1)
    return F.when(found == "```", TICKS).when(found == "~~~", TILDES)


def follow(state: Column, mark: Column) -> Column:
    """The state after a fence line: its own kind closes, any closes nothing but its own, outside it opens."""
    return F.when(state == OUT, mark).when(state == mark, OUT).otherwise(state)


def marked(rows: DataFrame) -> DataFrame:
    """Adds marks, the fence lines of a segment (pos, mark), and plain, the kind that each line has outside of code."""
    kind = lambda x: (
        F.when(F.regexp_like(x, F.lit(TITLE)), "heading")
        .when(F.regexp_like(x, F.lit(ROW)), "tabelle")
        .when(F.regexp_like(x, F.lit(f"[^{T.WS}]")), "prosa")
        .otherwise("")
    )
    marks = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("pos"), fence(x).alias("mark"))), lambda m: m["mark"].isNotNull())
    return rows.withColumns({"marks": marks, "plain": F.transform("lines", kind)})


def walked(rows: DataFrame, start: Column) -> DataFrame:
    """Adds, for segments of marked() that begin in the state `start`: end (the state after them), before (the state that each line begins with) and kinds.

    The state changes at fences only, so states stand in stretches between them.
    """
    after = F.aggregate("marks", F.struct(start.alias("s"), F.array().cast("array<int>").alias("all")), lambda a, m: T.let(follow(a["s"], m["mark"]), lambda t: F.struct(t.alias("s"), F.concat(a["all"], F.array(t)).alias("all"))))["all"]
    rows = rows.withColumn("states", F.concat(F.array(start), after))
    rows = rows.withColumn("cuts", F.concat(F.array(F.lit(-1)), F.transform("marks", lambda m: m["pos"]), F.array(F.size("lines") - 1)))
    rows = rows.withColumn("before", F.flatten(F.transform("states", lambda s, i: F.array_repeat(s, F.get("cuts", i + 1) - F.get("cuts", i)))))
    # a fence line is code in any state
    fences = F.flatten(F.transform("states", lambda s, i: T.let(F.get("cuts", i + 1) - F.get("cuts", i), lambda n: F.when(n > 0, F.concat(F.array_repeat(F.lit(False), n - 1), F.array(i < F.size("marks")))).otherwise(F.array().cast("array<boolean>")))))
    rows = rows.withColumn("fences", fences)
    kinds = F.transform(F.arrays_zip("before", "fences", "plain"), lambda x: F.when((x["before"] != OUT) | x["fences"], "code").otherwise(x["plain"]))
    return rows.withColumn("end", F.element_at("states", -1)).withColumn("kinds", kinds)


def opened(rows: DataFrame, left: Column) -> DataFrame:
    """Adds starts, the places in a segment where a block begins, if the line before the segment is of kind `left`."""
    new = lambda k, i: F.when(k == "", False).when(k == "code", F.get("before", i) == OUT).when(k == "heading", True).otherwise(k != F.when(i == 0, left).otherwise(F.get("kinds", i - 1)))
    return rows.withColumn("starts", F.filter(F.transform("kinds", lambda k, i: F.when(new(k, i), i)), lambda i: i.isNotNull()))


def entered(rows: DataFrame) -> DataFrame:
    """_id, seg, start, left, offset of the segments of texts that have several: state, kind of the last line and number of blocks before them.

    Each segment is summed up for every state that it may begin with; a text's few sums are folded in order.
    """
    sums = rows
    for s in (OUT, TICKS, TILDES):
        sums = opened(walked(sums, F.lit(s)), F.lit("")).withColumn(f"s{s}", F.struct("end", F.element_at("kinds", -1).alias("final"), F.get("kinds", F.lit(0)).alias("first"), F.get("before", F.lit(0)).alias("before"), F.size("starts").alias("n"))).select("_id", "n", "seg", "lines", "marks", "plain", *[f"s{k}" for k in range(s + 1)])
    own = sums.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("seg", F.array("s0", "s1", "s2").alias("of")))).alias("all"))
    zero = F.struct(F.lit(OUT).alias("start"), F.lit("").alias("left"), F.lit(0).alias("offset"), F.array().cast("array<struct<seg:int,start:int,left:string,offset:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        def with_sum(s: Column) -> Column:
            # of the first line counted as if nothing stood before it: table rows and prose may go on with a block
            goes_on = s["first"].isin("tabelle", "prosa") & (s["first"] == a["left"])
            out = F.concat(a["out"], F.array(F.struct(x["seg"].alias("seg"), a["start"].alias("start"), a["left"].alias("left"), a["offset"].alias("offset"))))
            return F.struct(s["end"].alias("start"), s["final"].alias("left"), (a["offset"] + s["n"] - goes_on.cast("int")).alias("offset"), out.alias("out"))

        return T.let(F.get(x["of"], a["start"]), with_sum)

    return own.select("_id", F.explode(F.aggregate("all", zero, step)["out"]).alias("x")).select("_id", "x.*")


def blocks(docs: DataFrame, id_col: str, text_col: str, segment: int = SEGMENT) -> DataFrame:
    """[C1] id, block (from 0), kind (code, heading, tabelle, prosa), level, text of each Markdown block.

    Fenced code runs to its closing fence or the end; table rows and other lines that follow each other are one block; a
    heading is one, without its marks; blank lines end what is open. Null and blank texts have no block. Ids have to
    be unique and not null: rows of one id would be read as one text. A text of one segment never leaves its task; of the others
    segments meet what they begin with, and pieces of blocks that cross segments meet each other.
    """
    rows = segments(docs, id_col, text_col, segment)
    names = ["_id", "n", "seg", "lines", "marks", "plain"]
    single = marked(rows.filter("n = 1")).select(*names, F.lit(OUT).alias("start"), F.lit("").alias("left"), F.lit(0).alias("offset"))
    several = marked(rows.filter("n > 1"))
    several = several.join(entered(several), ["_id", "seg"]).select(*names, "start", "left", "offset")

    def pieces(found: DataFrame) -> DataFrame:
        """_id, block, seg, kind, level, text of what each segment has of a block."""
        found = opened(walked(found, F.col("start")), F.col("left"))
        found = found.withColumn("bounds", F.concat(F.when(F.coalesce(F.get("starts", F.lit(0)) > 0, F.lit(True)), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), "starts", F.array(F.size("lines"))))
        # lines before the first start go on with the last block of the segment before
        found = found.withColumn("offset", F.col("offset") - F.coalesce(F.get("starts", F.lit(0)) > 0, F.lit(True)).cast("int"))
        shown = F.transform(F.arrays_zip("lines", "kinds"), lambda x: F.when(x["kinds"] == "tabelle", F.regexp_replace(x["lines"], f"[{T.WS}]+$", "")).when(x["kinds"] == "heading", T.strip(F.regexp_extract(x["lines"], TITLE, 2))).when(x["kinds"] != "", x["lines"]))
        found = found.withColumn("shown", shown)
        found = found.select("_id", "seg", "offset", "lines", "kinds", "shown", "bounds", F.posexplode(F.slice("bounds", F.lit(1), F.size("bounds") - 1)).alias("k", "at"))
        kept = F.filter(F.slice("shown", F.col("at") + 1, F.get("bounds", F.col("k") + 1) - F.col("at")), lambda x: x.isNotNull())
        found = found.select("_id", (F.col("offset") + F.col("k")).alias("block"), "seg", F.get("kinds", F.col("at")).alias("kind"), F.get("lines", F.col("at")).alias("line"), kept.alias("kept")).filter(F.size("kept") > 0)
        return found.select("_id", "block", "seg", "kind", F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", TITLE, 1))).otherwise(0).alias("level"), F.array_join("kept", "\n").alias("text"))

    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "text"))), lambda x: x["text"]), "\n")
    met = pieces(several).groupBy("_id", "block").agg(F.max("kind").alias("kind"), F.max("level").alias("level"), whole.alias("text"))
    out = pieces(single).drop("seg").unionByName(met)
    return out.select(F.col("_id").alias(id_col), "block", "kind", "level", F.when(F.col("kind") == "prosa", T.strip(F.col("text"))).otherwise(F.col("text")).alias("text"))
