"""Toxicity by a weighted finite-state pattern grammar over the clauses of a text."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexhaul.llm.common import Scratch, map_arrow

# Seed words of the grammar's classes in the languages served.
SEEDS = {
    "insult": "idiot idiots moron morons stupid dumb loser losers pathetic worthless scum trash clown disgusting imbecile jerk dumm dumme dummkopf trottel abschaum wertlos imbécile stupide minable crétin ordure estúpido estúpida imbécil basura asqueroso inútil",
    "threat": "kill murder destroy hurt beat smash burn töten umbringen zerstören schlagen tuer détruire frapper matar destruir golpear",
    "target": "you your they them he she him her people du dich ihr euch sie er tu toi vous ils elle elles tú usted ustedes ellos ellas él",
    "negation": "not no never nobody without n't isn't aren't don't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ni sin",
    "report": "said says wrote told reported claims claimed quoted sagte schrieb behauptet dit écrit déclare dijo escribió afirma",
}
TOKEN = re.compile(r"[^\W\d_]+(?:['’]t)?|[.!?;\n]|[\"“”«»]")
#: Bias and gains of the calibration before it has seen a row.
PRIOR = [-4.0, 2.0, 1.0, 2.0]
BREAKS = set(".!?;\n")
STEMS = range(3, 9)


class Transducer:
    """Reads class symbols; each step gives a factor for the symbol's weight. Unlisted symbols keep the state, factor 1."""

    def __init__(self, start, arcs: dict) -> None:
        self.start, self.arcs = start, arcs

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol), (state, 1.0))

    def compose(self, other: Transducer) -> Transducer:
        """The product machine, built from the states that can be reached; factors multiply."""
        symbols = {s for _, s in [*self.arcs, *other.arcs]}
        start, arcs = (self.start, other.start), {}
        todo, seen = [start], {start}
        while todo:
            state = todo.pop()
            for s in symbols:
                (a, fa), (b, fb) = self.step(state[0], s), other.step(state[1], s)
                arcs[state, s] = (a, b), fa * fb
                if (a, b) not in seen:
                    seen.add((a, b))
                    todo.append((a, b))
        return Transducer(start, arcs)


def negation(reach: int = 3, factor: float = 0.4) -> Transducer:
    """An insult or threat within `reach` words after a negation counts `factor`."""
    arcs: dict = {}
    for k in range(reach + 1):
        for s in ("insult", "threat"):
            arcs[k, s] = max(k - 1, 0), factor if k else 1.0
        for s in ("word", "target", "report", "quote"):
            arcs[k, s] = max(k - 1, 0), 1.0
        arcs[k, "negation"] = reach, 1.0
        arcs[k, "break"] = 0, 1.0
    return Transducer(0, arcs)


def reported(factor: float = 0.6) -> Transducer:
    """After a verb of saying, or inside quotation marks that it opened, insults count `factor` to the clause's end."""
    arcs: dict = {}
    for s in ("insult", "threat"):
        arcs["said", s] = "said", factor
        arcs["quoted", s] = "quoted", factor
    arcs |= {("plain", "report"): ("said", 1.0), ("said", "quote"): ("quoted", 1.0), ("quoted", "quote"): ("plain", 1.0), ("said", "break"): ("plain", 1.0)}
    return Transducer("plain", arcs)


def targeted(before: float = 1.25, after: float = 1.0) -> Transducer:
    """A target earlier in the clause strengthens an insult or threat; the first target after one adds its own weight."""
    arcs: dict = {("none", "target"): ("aimed", 0.0), ("aimed", "target"): ("aimed", 0.0), ("hurt", "target"): ("aimed", after)}
    for s in ("insult", "threat"):
        arcs |= {("none", s): ("hurt", 1.0), ("aimed", s): ("aimed", before), ("hurt", s): ("hurt", 1.0)}
    arcs |= {(k, "break"): ("none", 1.0) for k in ("none", "aimed", "hurt")}
    return Transducer("none", arcs)


@dataclass
class Grammar:
    """Lexicon transducer (word or stem to class and weight), composed clause machine, calibration of the clause scores."""

    words: dict[str, tuple[str, float]]
    stems: dict[str, tuple[str, float]] = field(default_factory=dict)
    bias: float = PRIOR[0]
    gain: np.ndarray = field(default_factory=lambda: np.array(PRIOR[1:]))

    def __post_init__(self) -> None:
        self.machine = negation().compose(reported()).compose(targeted())
        self.cache: dict[str, tuple[str, float] | None] = {}

    def classify(self, word: str) -> tuple[str, float] | None:
        if word in BREAKS:
            return "break", 0.0
        if word in "\"“”«»":
            return "quote", 0.0
        found = self.words.get(word)
        for n in STEMS if found is None or found[1] < 1 else ():
            stem = self.stems.get(word[:n]) if len(word) >= n else None
            if stem and (found is None or stem[1] > found[1]):
                found = stem
        return found

    def clauses(self, text: str) -> list[float]:
        """The scores of matched clauses: those with an insult or a threat."""
        tokens, cache = TOKEN.findall(text.lower()), self.cache
        for w in set(tokens).difference(cache):
            if len(cache) > 400_000:
                cache.clear()
            cache[w] = self.classify(w)
        kinds = [cache[w] if w in cache else self.classify(w) for w in tokens]
        if not any(k and k[1] > 0 and k[0] in ("insult", "threat") for k in kinds):
            return []
        arcs, state, score, hit, out = self.machine.arcs, self.machine.start, 0.0, False, []
        for k in [*kinds, ("break", 0.0)]:
            symbol, weight = k or ("word", 0.0)
            state, factor = arcs.get((state, symbol), (state, 1.0))
            score += weight * factor
            hit |= symbol in ("insult", "threat")
            if symbol == "break":
                if hit:
                    out.append(score)
                score, hit = 0.0, False
        return out

    @staticmethod
    def features(found: list[float]) -> np.ndarray:
        """The strongest clause, their sum on a log scale, and how many there are."""
        return np.array([max(found, default=0.0) / 4, np.log1p(max(0.0, sum(found))), np.log1p(len(found))])

    def score(self, found: list[float]) -> float:
        """Probability from the scores of a text's matched clauses."""
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.features(found) @ self.gain, -30, 30))))


def seeded(weight: float = 2.0) -> dict[str, tuple[str, float]]:
    weights = {"insult": weight, "threat": weight / 2, "target": 0.25, "negation": 0.0, "report": 0.0}
    return {w: (k, weights[k]) for k, ws in SEEDS.items() for w in ws.split()}


def marks(text: str) -> set[str]:
    """What the lexicon can learn: words, and stems with a mark."""
    words = set(re.findall(r"[^\W\d_]+", text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}


def sample_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", bound: int = 6000) -> DataFrame:
    """At most about `bound` ids of each label, chosen by a hash of the id: so few rows that texts can be looked up by a broadcast."""
    rows = labels.filter(labels[label_col].isNotNull() & labels[id_col].isNotNull()).withColumn("_y", labels[label_col].cast("int") == 1)
    sizes = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    rate = {y: min(1_000_000, 1_000_000 * bound // max(1, sizes.get(y, 0))) for y in (True, False)}
    chance = F.pmod(F.xxhash64(labels[id_col]), F.lit(1_000_000))
    return rows.filter(chance < F.when(F.col("_y"), rate[True]).otherwise(rate[False])).drop("_y").limit(4 * bound)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", fold_col: str | None = None, bound: int = 6000, least: int = 4, cover: int = 4) -> Grammar:
    """Learns lexicon and calibration on at most about `bound` labelled rows of each label, chosen by a hash of the text (a documented bound).

    A word or stem is a candidate if it marks toxic documents at odds of at least 20 to 1. Of the candidates the
    lexicon takes, one by one, the one that marks most toxic documents not yet marked `cover` times, while
    it adds `least`; so the other words of a copied text do not enter. What enters is a threat or an insult by
    its place beside targets (see classes). Rows whose fold is true (a
    fourth by hash of the text if none is named) are kept from the lexicon and calibrate the scores.

    Equal texts count once, with the label that most of them have, and not at all if as many say the other. Null
    texts and labels are left out; without any row the grammar has its seed words and prior calibration. Only the
    named columns are read, so other names cannot clash; texts are read whole, however long.
    """
    spark = labelled.sparkSession
    scratch = Scratch(spark)
    fold = labelled[fold_col] if fold_col else F.pmod(F.xxhash64(labelled[text_col], F.lit(1)), F.lit(4)) == 0
    rows = labelled.select(labelled[text_col].alias("text"), labelled[label_col].cast("int").alias("toxic"), fold.alias("fold")).filter("text IS NOT NULL AND toxic IS NOT NULL")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    chance = F.pmod(F.xxhash64("text"), F.lit(1_000_000))
    limit = F.when(F.col("toxic") == 1, min(1_000_000, 1_000_000 * bound // max(1, sizes.get(1, 0)))).otherwise(min(1_000_000, 1_000_000 * bound // max(1, sizes.get(0, 0))))
    once = rows.filter(chance < limit).groupBy("text").agg(F.avg("toxic").alias("y"), F.min("fold").alias("fold"))
    rows = scratch.write(once.filter("y <> 0.5").select("text", (F.col("y") > 0.5).cast("int").alias("toxic"), "fold"), "sample")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic, text = b.column(0).to_pylist(), b.column(1).to_pylist()
            found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for y, t in zip(toxic, text, strict=True):
                for m in marks(t):
                    found[m][y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([v[1] for v in found.values()], pa.int64()), pa.array([v[0] for v in found.values()], pa.int64())], ["mark", "t", "c"])

    learn, rest = rows.filter("NOT fold"), rows.filter("fold")
    n = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}

    t_all, c_all = n.get(1, 0), n.get(0, 0)
    counts = map_arrow(learn.select("toxic", "text"), listed, "mark string, t long, c long").groupBy("mark").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (t_all + 1)) - F.log((F.col("c") + 0.5) / (c_all + 1))
    best = counts.filter(F.col("t") >= least).withColumn("odds", odds).filter("odds >= 3").select("mark", "odds").collect()  # marks of the bounded sample
    weight = {r["mark"]: float(r["odds"]) for r in best}

    def which(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(marks(t).intersection(weight)) for t in b.column(0).to_pylist()], pa.list_(pa.string()))], ["marks"])

    holders: dict[str, list[int]] = defaultdict(list)
    for k, r in enumerate(map_arrow(learn.filter("toxic = 1").select("text"), which, "marks array<string>").toLocalIterator()):
        for m in r["marks"]:
            holders[m].append(k)
    missing, chosen = np.full(t_all + 1, cover), []
    gains = {m: len(h) for m, h in holders.items()}
    while gains:
        # gains only fall, so re-check the best until it stays the best
        m = max(gains, key=lambda m: (gains[m], weight[m], len(m), m))
        now = int((missing[holders[m]] > 0).sum())
        if now < gains[m]:
            gains[m] = now
            continue
        if now < least:
            break
        chosen.append(m)
        missing[holders[m]] = np.maximum(missing[holders[m]] - 1, 0)
        del gains[m]
    words, stems = seeded(), {}
    kinds = classes(learn.filter("toxic = 1").select("text"), chosen)
    for m in chosen:
        if m.endswith("*"):
            stems[m[:-1]] = kinds.get(m, "insult"), weight[m]
        else:
            words[m] = words.get(m, (kinds.get(m, "insult"), 0))[0], weight[m]
    grammar = Grammar(words, stems)
    return calibrated(grammar, rest)


def classes(toxic: DataFrame, chosen: list[str], reach: int = 2) -> dict[str, str]:
    """Of learned words and stems: `threat` if a target follows within `reach` words more often than one stands before, as of what is done to somebody; else `insult`."""
    targets, known = set(SEEDS["target"].split()), set(chosen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for b in batches:
            for t in b.column(0).to_pylist():
                words = TOKEN.findall(t.lower())
                for k, w in enumerate(words):
                    own = known.intersection([w, *(w[:n] + "*" for n in STEMS if len(w) >= n)])
                    for m in own:
                        found[m][0] += not targets.isdisjoint(words[k + 1 : k + 1 + reach])
                        found[m][1] += not targets.isdisjoint(words[max(k - reach, 0) : k])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([v[j] for v in found.values()], pa.int64()) for j in (0, 1))], ["mark", "after", "before"])

    rows = map_arrow(toxic, count, "mark string, after long, before long").groupBy("mark").agg(F.sum("after").alias("after"), F.sum("before").alias("before")).collect()
    return {r["mark"]: "threat" if r["after"] > r["before"] else "insult" for r in rows}


def calibrated(grammar: Grammar, rest: DataFrame) -> Grammar:
    """Logistic regression of the label on the clause features, drawn to PRIOR by a ridge."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [grammar.features(grammar.clauses(t)).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    got = map_arrow(rest.select("toxic", "text"), measure, "toxic int, x array<double>").collect()
    y = np.array([r["toxic"] for r in got], float)
    x = np.array([[1, *r["x"]] for r in got], float).reshape(-1, len(PRIOR))
    w, prior, strength = np.array(PRIOR), np.array(PRIOR), 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), x.T @ (p - y) + strength * (w - prior))
        w = w - np.clip(step, -2, 2)
    grammar.bias, grammar.gain = float(w[0]), w[1:]
    grammar.cache.clear()
    return grammar


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, score, predicted (1 from 0.5), n_clauses (matched ones).

    Null, empty and matchless texts get the score of no matched clause. Whole texts are read; rows are
    independent, so repeats and null ids give a row each and an empty table an empty result. Only the two named
    columns are read, so other names cannot clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [grammar.clauses(t) for t in texts]
            s = [grammar.score(c) for c in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32()), pa.array([len(c) for c in found], pa.int32())], [id_col, "score", "predicted", "n_clauses"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(docs[id_col].alias(id_col), docs[text_col].alias("text")), run, f"`{id_col}` {kind}, score double, predicted int, n_clauses int")
