"""Structure-aware chunking of Markdown and plain text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lexhaul.functions import text as T
from lexhaul.operators.blocks import BREAK

TARGET, OVERLAP, SMALLEST = 512, 64, 32
# The forms of fences, headings, table rows, sentence ends and numbered items.
FENCE = re.compile(r"\s*(```|~~~)")
TITLE = re.compile(r"(#{1,6})\s+(.+?)\s*#*$")
ROW = re.compile(r"\s*\|.*\|\s*$")
BOUNDARY = re.compile(r'(?<=[.!?:])\s+(?=[A-ZÄÖÜ“„"(\d])')
NUMBERED = re.compile(r"[\d.]+\.|[a-zäöü]\.")

Counter = Callable[[str], int]


def estimate(text: str) -> int:
    """[F1]"""
    return max(1, int(len(text) / T.CHARS_PER_TOKEN))


@dataclass
class Part:
    """A block or a piece of one; rows are kept for whole tables."""

    kind: str
    text: str
    level: int = 0
    rows: list[str] = field(default_factory=list)


@dataclass
class Piece:
    """A finished chunk."""

    text: str
    path: list[str]
    kind: str
    tokens: int


def blocks(markdown: str) -> list[Part]:
    """[C1] Fenced code, headings, tables and paragraphs, by a scan over the lines."""
    found: list[Part] = []
    fence, mode = "", ""

    def add(kind: str, line: str) -> None:
        """Continues the open block of this kind or opens one."""
        nonlocal mode
        if mode != kind:
            found.append(Part(kind, "", rows=[]))
            mode = kind
        found[-1].rows.append(line)

    for line in markdown.splitlines():
        if fence:
            add("code", line)
            if line.strip().startswith(fence):
                fence = mode = ""
        elif m := FENCE.match(line):
            fence, mode = m[1], ""
            add("code", line)
        elif m := TITLE.match(line):
            found.append(Part("heading", m[2].strip(), len(m[1])))
            mode = ""
        elif ROW.match(line):
            add("tabelle", line.rstrip())
        elif line.strip():
            add("prosa", line)
        else:
            mode = ""
    for p in found:
        if p.kind != "heading":
            p.text = "\n".join(p.rows)
        if p.kind == "prosa":
            p.text = p.text.strip()
        if p.kind != "tabelle":
            p.rows = []
    return [p for p in found if p.text or p.kind in ("code", "tabelle")]


def unfinished(piece: str) -> bool:
    """[C3]"""
    words = piece.split()
    return bool(words) and (words[-1].lower() in T.ABBREVIATIONS or bool(NUMBERED.fullmatch(words[-1].lower())))


def sentences(text: str) -> list[str]:
    """[C2] As functions.text.sentences, for use inside a task."""
    rough, out = BOUNDARY.split(text), []
    for k, piece in enumerate(rough):
        if k and unfinished(rough[k - 1]):
            out[-1] = f"{out[-1]} {piece}"
        else:
            out.append(piece)
    return [s for s in out if s.strip()]


def greedy(items: list[str], limit: int, count: Counter, base: int = 0) -> list[list[str]]:
    """Consecutive items in groups whose counts add up to `limit` at most, `base` included; a larger item is alone."""
    groups: list[list[str]] = []
    room = -1
    for item in items:
        cost = count(item)
        if not groups or cost > room:
            groups.append([])
            room = limit - base
        groups[-1].append(item)
        room -= cost
    return groups


def divided(part: Part, limit: int, count: Counter) -> list[Part]:
    """[C4, C5, C6] A part over the limit in parts: tables repeat their two head rows, code is cut at lines, prose at sentences."""
    if count(part.text) <= limit:
        return [part]
    if part.kind == "prosa":
        return [Part("prosa", " ".join(g)) for g in greedy(sentences(part.text), limit, count)] or [part]
    if part.kind == "tabelle":
        head, body = part.rows[:2], part.rows[2:]
        if len(body) <= 1:
            return [part]
        base = count("\n".join(head))
        if base < limit:
            return [Part("tabelle", "\n".join(head + g), rows=head + g) for g in greedy(body, limit, count, base)]
    return [Part(part.kind, "\n".join(g)) for g in greedy(part.text.splitlines(), limit, count)]


def tail(text: str, budget: int, count: Counter) -> str:
    """[C7] The last sentences within the budget, the very last one in any case."""
    own, room, k = sentences(text), budget, 0
    while k < len(own) and (not k or count(own[-k - 1]) <= room):
        room -= count(own[-k - 1])
        k += 1
    return " ".join(own[len(own) - k :]) if budget > 0 else ""


class Section:
    """[C8] Packs the parts under one heading path into pieces appended to `out`."""

    def __init__(self, path: list[str], target: int, overlap: int, count: Counter) -> None:
        self.path, self.count, self.parts = path, count, []
        self.prefix = count(" > ".join(path)) if path else 0
        self.limit = max(SMALLEST, target - self.prefix)
        self.overlap = min(overlap, self.limit // 4)
        self.unit = max(SMALLEST, self.limit - self.overlap)

    def finish(self, parts: list[Part], out: list[Piece]) -> None:
        text = "\n\n".join(p.text for p in parts).strip()
        if text:
            kinds = {p.kind for p in parts}
            out.append(Piece(text, self.path, kinds.pop() if len(kinds) == 1 else "prosa", self.count(text) + self.prefix))

    def pack(self, out: list[Piece]) -> None:
        held: list[Part] = []
        cost = 0
        for unit in (u for p in self.parts for u in divided(p, self.unit, self.count)):
            size = self.count(unit.text)
            if held and cost + size > self.limit:
                self.finish(held, out)
                again = tail("\n\n".join(p.text for p in held), self.overlap, self.count) if unit.kind == "prosa" else ""
                held, cost = ([Part("prosa", again)], self.count(again)) if again else ([], 0)
            held.append(unit)
            cost += size
        rest = "\n\n".join(p.text for p in held).strip()
        last = out[-1] if out else None
        if rest and last and last.path == self.path and self.count(rest) < SMALLEST:
            last.text = f"{last.text}\n\n{rest}"
            last.tokens = self.count(last.text) + self.prefix
        else:
            self.finish(held, out)


def chunk(markdown: str, target: int = TARGET, overlap: int = OVERLAP, count: Counter = estimate) -> list[Piece]:
    """[C8] All pieces of a document in order; blank levels of a heading path hold their place until the end."""
    out: list[Piece] = []
    section = Section([], target, overlap, count)
    for part in blocks(markdown):
        if part.kind != "heading":
            section.parts.append(part)
            continue
        section.pack(out)
        above = (section.path + [""] * part.level)[: part.level - 1]
        section = Section([*above, part.text], target, overlap, count)
    section.pack(out)
    return [Piece(p.text, [h for h in p.path if h], p.kind, p.tokens) for p in out]


CHUNK_SCHEMA = "ordinal int, text string, heading_path array<string>, kind string, token_count int"


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, target: int = TARGET, overlap: int = OVERLAP, count: Counter = estimate) -> DataFrame:
    """One row for each chunk of each document; documents are independent, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, c) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, c in enumerate(chunk(t or "", target, overlap, count))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].text for r in rows], pa.string()),
                    pa.array([r[2].path for r in rows], pa.list_(pa.string())), pa.array([r[2].kind for r in rows], pa.string()), pa.array([r[2].tokens for r in rows], pa.int32()),
                ],
                [id_col, "ordinal", "text", "heading_path", "kind", "token_count"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, docs[text_col].alias("_t")).mapInArrow(run, f"{id_col} {kind}, {CHUNK_SCHEMA}")


def sentence_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """[C2] id, pos, sentence, by built-in functions only."""
    return docs.select(id_col, F.posexplode(T.sentences(F.coalesce(F.col(text_col), F.lit("")))).alias("pos", "sentence"))


def prose_units(docs: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """[C6] id, unit, n_sentences, cost, text: consecutive sentences in units of `limit` estimated tokens at most.

    The greedy fold carries two numbers and the list of unit numbers, no text.
    """
    costs = F.transform("s", T.estimate_tokens)
    start = F.struct(F.lit(0).alias("cost"), F.lit(-1).alias("unit"), F.array().cast("array<int>").alias("units"))

    def step(acc, c):
        new = (acc["unit"] < 0) | (acc["cost"] + c > limit)
        unit = F.when(new, acc["unit"] + 1).otherwise(acc["unit"])
        return F.struct(F.when(new, c).otherwise(acc["cost"] + c).alias("cost"), unit.alias("unit"), F.concat(acc["units"], F.array(unit)).alias("units"))

    rows = docs.select(id_col, T.sentences(F.coalesce(F.col(text_col), F.lit(""))).alias("s")).withColumn("u", F.aggregate(costs, start, step)["units"])
    rows = rows.select(id_col, F.posexplode(F.arrays_zip("s", "u")).alias("pos", "x")).select(id_col, "pos", F.col("x.s").alias("s"), F.col("x.u").alias("unit"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), " ")
    return rows.groupBy(id_col, "unit").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(T.estimate_tokens(F.col("s"))).alias("cost"), text.alias("text"))


def overlap_tail(docs: DataFrame, id_col: str, text_col: str, budget: int) -> DataFrame:
    """[C7] id, n_sentences, tail. Costs are at least 1, so stopping at the first that does not fit is a running-sum filter."""
    back = Window.partitionBy(id_col).orderBy(F.desc("pos"))
    rows = sentence_rows(docs, id_col, text_col).withColumn("cum", F.sum(T.estimate_tokens(F.col("sentence"))).over(back.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rk", F.row_number().over(back))
    kept = rows.filter((F.col("rk") == 1) | (F.col("cum") <= budget))
    return kept.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_sentences"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("tail"))


def paragraphs(text: Column) -> Column:
    """Runs of lines that are not blank, stripped; of texts without headings, tables and code."""
    plain = F.regexp_replace(text, BREAK, "\n")
    return F.filter(F.transform(F.split(plain, rf"\n[{T.WS}]*\n"), T.strip), lambda p: p != "")


def joined_sentences(text: Column, limit: int) -> Column:
    """[C6] Sentences of a paragraph in units of `limit` estimated tokens at most; a longer sentence is alone."""
    start = F.struct(F.array().cast("array<string>").alias("units"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("cost"))

    def step(acc: Column, s: Column) -> Column:
        over = acc["open"].isNotNull() & (acc["cost"] + T.estimate_tokens(s) > limit)
        return F.struct(
            F.when(over, F.concat(acc["units"], F.array(acc["open"]))).otherwise(acc["units"]).alias("units"),
            F.when(over | acc["open"].isNull(), s).otherwise(F.concat(acc["open"], F.lit(" "), s)).alias("open"),
            (F.when(over, 0).otherwise(acc["cost"]) + T.estimate_tokens(s)).alias("cost"),
        )

    return F.aggregate(T.sentences(text), start, step, lambda acc: F.when(acc["open"].isNull(), acc["units"]).otherwise(F.concat(acc["units"], F.array(acc["open"]))))


def tail_of(text: Column, budget: int) -> Column:
    """[C7] The last sentences within the budget, the very last one in any case."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("cost"), F.lit(True).alias("open"))

    def step(acc: Column, s: Column) -> Column:
        fits = acc["open"] & ((acc["n"] == 0) | (acc["cost"] + T.estimate_tokens(s) <= budget))
        return F.struct((acc["n"] + fits.cast("int")).alias("n"), F.when(fits, acc["cost"] + T.estimate_tokens(s)).otherwise(acc["cost"]).alias("cost"), fits.alias("open"))

    last = lambda own: T.let(F.aggregate(F.reverse(own), start, step)["n"], lambda n: F.array_join(F.slice(own, F.size(own) - n + 1, n), " "))
    return T.let(T.sentences(text), last) if budget > 0 else F.lit("")


def chunk_prose(docs: DataFrame, id_col: str, text_col: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """[C8] id, ordinal, text, token_count: chunk() of texts without headings, tables and code, as one fold of built-in functions.

    Paragraphs, or sentences of too long ones, are packed in turn; the next chunk begins with the last sentences of
    the one before; a short rest joins the last chunk. Nothing is shuffled and no Python runs. Null and blank
    texts have no chunk; ids may repeat, each row is chunked on its own.
    """
    limit = max(SMALLEST, target)
    again = min(overlap, limit // 4)
    unit = max(SMALLEST, limit - again)
    units = F.flatten(F.transform(paragraphs(F.col("_t")), lambda p: F.when(T.estimate_tokens(p) <= unit, F.array(p)).otherwise(joined_sentences(p, unit))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("cost"))

    def step(acc: Column, u: Column) -> Column:
        size = T.estimate_tokens(u)
        over = acc["open"].isNotNull() & (acc["cost"] + size > limit)

        def begun(t: Column) -> Column:
            return F.struct(F.concat(acc["done"], F.array(T.strip(acc["open"]))).alias("done"), F.when(t == "", u).otherwise(F.concat(t, F.lit("\n\n"), u)).alias("open"), (F.when(t == "", 0).otherwise(T.estimate_tokens(t)) + size).alias("cost"))

        more = F.struct(acc["done"].alias("done"), F.when(acc["open"].isNull(), u).otherwise(F.concat(acc["open"], F.lit("\n\n"), u)).alias("open"), (acc["cost"] + size).alias("cost"))
        return F.when(over, T.let(tail_of(acc["open"], again), begun)).otherwise(more)

    def finish(acc: Column) -> Column:
        rest, done = T.strip(acc["open"]), acc["done"]
        short = (F.size(done) > 0) & (T.estimate_tokens(rest) < SMALLEST)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit("\n\n"), rest)))
        return F.when(acc["open"].isNull(), done).when(short, joined).otherwise(F.concat(done, F.array(rest)))

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    return rows.select(id_col, F.posexplode(F.aggregate(units, start, step, finish)).alias("ordinal", "text")).withColumn("token_count", T.estimate_tokens(F.col("text")))


class MarkdownChunks:
    """[C8] Table function markdown_chunks(text, target, overlap): ordinal, text, heading_path, kind, token_count, for use with LATERAL.

    target and overlap are constants and may be left out; what they are is checked when the query is analysed.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, target: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if text.isTable or text.dataType.simpleString() not in ("string", "void"):
            raise ValueError("markdown_chunks: the first argument is a text")
        for name, given, least in (("target", target, 1), ("overlap", overlap, 0)):
            if given is not None and (not given.isConstantExpression or not isinstance(given.value, int) or given.value < least):
                raise ValueError(f"markdown_chunks: {name} is a constant whole number from {least} on")
        return AnalyzeResult(StructType([StructField("ordinal", IntegerType()), StructField("text", StringType()), StructField("heading_path", ArrayType(StringType())), StructField("kind", StringType()), StructField("token_count", IntegerType())]))

    def eval(self, text: str | None, target: int = TARGET, overlap: int = OVERLAP) -> Iterator[tuple]:
        for k, c in enumerate(chunk(text or "", target, overlap)):
            yield k, c.text, c.path, c.kind, c.tokens


def register(spark: SparkSession) -> None:
    """Makes markdown_chunks known to SQL in this session."""
    spark.udtf.register("markdown_chunks", F.udtf(MarkdownChunks))
