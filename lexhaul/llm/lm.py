"""Masked pseudo-likelihood: a bidirectional window network predicts each token from both sides."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexhaul.llm.common import Scratch, map_arrow
from lexhaul.llm.jaccard import LOWER

TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]")
BLANK = b" \t\n\r\f\v"
#: What TOKEN sees in a byte, A-Z as a-z: 0 blank, 1 of a word, 2 a token of its own.
KIND = bytes(0 if bytes([k]) in [BLANK[i : i + 1] for i in range(6)] else 1 if k >= 128 or chr(k).isalnum() else 2 for k in range(256))
#: Classes of frequent words of their own, classes of other words by hash of their ending, and the class of a text's edge.
OWN, SHARED = 63, 64
EDGE, CLASSES = OWN + SHARED, OWN + SHARED + 1
SIDE, HIDDEN = 3, 32
OFFSETS = [k for k in range(2 * SIDE + 1) if k != SIDE]


def tokens_of(text: str) -> list[bytes]:
    return TOKEN.findall(text.encode("utf-8", "surrogatepass").translate(LOWER))


def portions(texts: pa.Array, most: int = 1 << 22) -> Iterator[pa.Array]:
    """Neighbouring texts (or other values with bytes) of about `most` bytes together; a longer one alone."""
    sizes, at = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64), 0
    ends = np.cumsum(sizes)
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at] - sizes[at]) + most, side="right")))
        yield texts.slice(at, end - at)
        at = end


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different tokens of all texts, each token's place among them, and where each text's tokens begin and end.

    The tokens of a text are those of tokens_of(), null counts as empty; bytes are looked at all at once, not text by text.
    """
    texts = texts.cast(pa.binary()) if texts.null_count == 0 else texts.cast(pa.binary()).fill_null(b"")
    buffers, n = texts.buffers(), len(texts)
    edges = np.frombuffer(buffers[1], np.int32)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int32)
    raw = buffers[2][int(edges[0]) : int(edges[-1])].to_pybytes() if buffers[2] is not None else b""
    edges = edges - edges[0]
    kind = np.frombuffer(raw.translate(KIND), np.uint8)
    word, begins = kind == 1, kind == 2
    begins[1:] |= word[1:] & ~word[:-1]
    opening = edges[edges < len(kind)]
    begins[opening] |= word[opening]
    ink = np.frombuffer(raw.translate(LOWER, BLANK), np.uint8)  # without blanks a token ends where the next one begins
    at = np.append(np.flatnonzero(begins[kind > 0]), len(ink)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(ink)]).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(np.flatnonzero(begins), edges)


def shared_class(word: bytes) -> int:
    return OWN + zlib.crc32(word[-3:]) % SHARED


@dataclass
class Vocabulary:
    """Word to class and log P(word | class) of the words in `counts`; the counts of all others stay in a table that score() joins.

    Which words are held here decides how fast scoring is, never a score. `least` and `share` tell which: those
    whose frequency level (eighths of a doubling) is above, and `share` thousandths of that level by hash.
    """

    own: dict[bytes, int]
    counts: dict[bytes, int]
    totals: np.ndarray
    byte_logs: np.ndarray
    least: int = 0
    share: int = 0

    def class_of(self, word: bytes) -> int:
        k = self.own.get(word)
        return shared_class(word) if k is None else k

    @cached_property
    def laid_out(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words of `counts`, their classes and log P(word | class)."""
        kinds, n = np.array([self.class_of(w) for w in self.counts], np.uint8), np.array(list(self.counts.values()), np.float64)
        return pa.array(list(self.counts), pa.binary()), kinds, np.log(np.maximum(n, 1)) - np.log(self.totals[kinds] + 1)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of different words: the class, log P(word | class) (of a word that is not held: without its count), whether it is held."""
        names, all_kinds, all_logs = self.laid_out
        place = pc.fill_null(pc.index_in(words, value_set=names), -1).to_numpy(zero_copy_only=False)
        known, kinds, logs = place >= 0, np.zeros(len(words), np.uint8), np.zeros(len(words))
        kinds[known], logs[known] = all_kinds[place[known]], all_logs[place[known]]
        others = words.filter(pa.array(~known)).to_numpy(zero_copy_only=False)
        kinds[~known] = of = np.array([self.class_of(w) for w in others], np.uint8)
        logs[~known] = -np.log(self.totals[of] + 1)
        return kinds, logs, known

    def spelled(self, word: Column) -> Column:
        """Log of the byte model's share of one count, for a word that no document of the counts has."""
        logs = F.array(*[F.lit(float(x)) for x in self.byte_logs[:256]])
        byte = lambda i: F.conv(F.hex(F.substring(word, i, F.lit(1))), 16, 10).cast("int")
        return F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), F.lit(float(self.byte_logs[256])), lambda a, i: a + F.element_at(logs, byte(i) + 1))


@dataclass
class Network:
    """Hidden layer by one table for each place of the window, then scores of the classes."""

    tables: np.ndarray  # places, CLASSES, HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        return Network(r.normal(0, 0.2, (2 * SIDE, CLASSES, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), r.normal(0, 0.05, (HIDDEN, CLASSES)).astype(np.float32), np.zeros(CLASSES, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.tables, self.hidden_bias, self.out, self.out_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @staticmethod
    def of(flat: np.ndarray) -> Network:
        net, at = Network.fresh(), 0
        for p in net.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return net

    def hidden(self, padded: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Hidden values of the tokens at `where`, indexes into classes padded by SIDE edges on both sides."""
        h = self.tables[0].take(padded[where], axis=0)
        for t, k in enumerate(OFFSETS[1:], 1):
            h += self.tables[t].take(padded[where + k], axis=0)
        h += self.hidden_bias
        return np.tanh(h, out=h)

    def logs(self, padded: np.ndarray, where: np.ndarray) -> np.ndarray:
        """log P(class of the token | both sides)."""
        return Scorer(self).logs(padded, where)

    def train(self, padded: np.ndarray, where: np.ndarray, memory: list[np.ndarray], rate: float = 0.05) -> None:
        """One Adagrad step on the tokens at `where`.

        A class gets the same neighbours' gradients at all places of the window, so positions are sorted by class
        once, with the gradients of all places in a row, and the rows of a class are added by a product with ones.
        """
        n, at, scores = len(where), where + SIDE, np.concatenate([self.out, self.out_bias[None]])
        h = self.hidden(padded, where)
        p = np.concatenate([h, np.ones((n, 1), np.float32)], axis=1) @ scores
        if np.abs(self.out).sum(axis=0).max() + np.abs(self.out_bias).max() >= 80:  # as in Scorer
            p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        ones = np.ones(max(CLASSES, len(padded)), np.float32)
        total = p @ ones[:CLASSES]
        p.ravel()[np.arange(0, n * CLASSES, CLASSES) + padded[at]] -= total  # the gradient, times n and the total of its row
        scale = 1 / (n * total)
        back = p @ self.out.T
        back *= scale[:, None]
        out, out_bias = (h * scale[:, None]).T @ p, scale @ p
        h *= h
        back *= np.subtract(1, h, out=h)
        wide = np.zeros((len(padded) + 2 * SIDE, HIDDEN), np.float32)
        wide[at + SIDE] = back
        kinds = padded.astype(np.uint8)
        order, ends = kinds.argsort(kind="stable"), [0, *np.cumsum(np.bincount(kinds, minlength=CLASSES)).tolist()]
        near = np.lib.stride_tricks.as_strided(wide, (len(padded), (2 * SIDE + 1) * HIDDEN), wide.strides)
        sums = np.zeros((CLASSES, near.shape[1]), np.float32)
        for some in range(0, CLASSES, 16):  # rows of 16 classes fit the processor's cache
            rows = near[order[ends[some] : ends[some + 16]]]
            for k in range(some, some + 16):
                first, last = ends[k] - ends[some], ends[k + 1] - ends[some]
                if last > first:
                    np.dot(ones[first:last], rows[first:last], out=sums[k])
        tables = sums.reshape(CLASSES, -1, HIDDEN)[:, [2 * SIDE - k for k in OFFSETS]].transpose(1, 0, 2)
        for part, grad, squares in zip(self.parts(), [tables, back.sum(axis=0), out, out_bias], memory, strict=True):
            step = grad * grad
            squares += step
            np.sqrt(np.add(squares, 1e-8, out=step), out=step)
            np.divide(grad, step, out=step)
            step *= rate
            part -= step


class Scorer:
    """A network laid out for scoring: biases as weights, scores shifted and no maximum to take before exp while the weights are moderate."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.out = np.concatenate([net.out, net.out_bias[None]]).astype(np.float32)
        self.safe = bool(np.abs(net.out).sum(axis=0).max() + np.abs(net.out_bias).max() < 80)  # the largest score there can be; exp of a float32 holds 88
        self.ones = np.ones(CLASSES, np.float32)

    def logs(self, padded: np.ndarray, where: np.ndarray) -> np.ndarray:
        h = np.ones((len(where), HIDDEN + 1), np.float32)
        h[:, :HIDDEN] = self.net.hidden(padded, where)
        s = h @ self.out
        if not self.safe:
            s -= s.max(axis=1, keepdims=True)
        own = s.ravel()[np.arange(0, len(where) * CLASSES, CLASSES) + padded[where + SIDE]]
        return own - np.log(np.exp(s, out=s) @ self.ones)


def word_counts(docs: DataFrame, text_col: str, scratch: Scratch) -> DataFrame:
    """word, n over every token of every document, repeated rows each time; each task adds up first and sends its counts on when it holds many words. Null and empty texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        for b in batches:
            for texts in portions(b.column(0)):
                words, at, _ = cut(texts)
                held.append(pa.table({"word": words, "n": np.bincount(at, minlength=len(words))}))
                rows += len(words)
                if rows > 600_000:
                    held, rows = [added()], 0
                    if held[0].num_rows > 300_000:
                        yield from held[0].to_batches()
                        held = []
        if held:
            yield from added().to_batches()

    return scratch.write(map_arrow(docs.select(docs[text_col].alias("text")), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def held(words: Vocabulary):
    """Of a table (word, n): whether `words` holds the word itself."""
    level = F.floor(8 * F.log2("n")).cast("int")
    return (level > words.least) | (level == words.least) & (F.pmod(F.xxhash64("word"), F.lit(1000)) < words.share)


def vocabulary(counts: DataFrame, most: int = 150_000) -> Vocabulary:
    """Classes by the exact counts of all words. About the `most` most frequent words travel to every task; the other counts are joined, so `most` changes no score.

    The OWN most frequent words, ties by their bytes, are classes of their own.
    """
    level = F.floor(8 * F.log2("n")).cast("int")
    levels = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    found, room = Vocabulary({}, {}, np.zeros(CLASSES), np.zeros(257), -1, 0), most
    for lv, n in levels:
        if n > room:
            found.least, found.share = lv, 1000 * room // n
            break
        room -= n
    above, last = 0, None  # the level in which the OWN most frequent words end, and how many words are above it
    for lv, n in levels:
        last = lv, n
        if above + n >= OWN:
            break
        above += n
    top = []
    if last:
        part = counts.filter(level >= last[0])
        if last[1] > 20 * OWN:  # of that level only the words of its highest counts
            rest = counts.filter(level == last[0])
            least = [r["n"] for r in rest.groupBy("n").count().orderBy(F.desc("n")).limit(OWN).collect()][-1]
            part = counts.filter(level > last[0]).unionByName(rest.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(OWN))
        top = [(r["n"], bytes(r["word"])) for r in part.collect()]
    found.own = own = {w: k for k, (_, w) in enumerate(sorted(top, key=lambda x: (-x[0], x[1]))[:OWN])}
    found.counts = {bytes(r["word"]): r["n"] for r in counts.filter(held(found)).collect()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, letters = np.zeros(CLASSES), np.zeros(257)
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = own.get(w)
                totals[shared_class(w) if k is None else k] += n
                np.add.at(letters, np.frombuffer(w, np.uint8), n)
                letters[256] += n
        yield pa.RecordBatch.from_arrays([pa.array([totals.tolist()], pa.list_(pa.float64())), pa.array([letters.tolist()], pa.list_(pa.float64()))], ["totals", "letters"])

    letters = np.ones(257)
    for r in counts.mapInArrow(add, "totals array<double>, letters array<double>").toLocalIterator():
        found.totals += r["totals"]
        letters += r["letters"]
    found.byte_logs = np.log(letters / letters.sum())
    return found


def encode(docs: DataFrame, words: Vocabulary, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`, written once: row (its number), id, kinds (a byte for each token, its class), sum (of the tokens' log shares of their classes), rare (words that `words` does not hold, with how often they occur).

    Training and scoring read the tokens from here, so a text is cut into tokens once for both.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for b in batches:
            done = 0
            for texts in portions(b.column(1)):
                words, at, ends = cut(texts)
                n, text = len(texts), np.repeat(np.arange(len(texts)), np.diff(ends))
                kinds, logs, known = (x[at] for x in vocabulary.look_up(words))
                sums = np.bincount(text, weights=logs, minlength=n)
                rare, times = np.unique((text * len(words) + at)[~known], return_counts=True)
                of, word = np.divmod(rare, max(1, len(words)))
                flat = pa.StructArray.from_arrays([words.take(pa.array(word)), pa.array(times, pa.int64())], ["word", "times"])
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(kinds)])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, n), packed, pa.array(sums, pa.float64()), lists], ["id", "kinds", "sum", "rare"])
                done += n

    kind = docs.schema[id_col].dataType.simpleString()
    found = map_arrow(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"id {kind}, kinds binary, sum double, rare array<struct<word:binary,times:long>>")
    return scratch.write(found.withColumn("row", F.monotonically_increasing_id()), "encoded")  # written once, so a row keeps its number


def pieces(kinds: np.ndarray, rounds: int, number: int, stretch: int) -> Iterator[np.ndarray]:
    """The stretches of a text that round `number` trains on, each with SIDE classes on both sides; over all rounds every token is in one stretch.

    A text's stretches are dealt in turn, beginning with a round that its first tokens choose.
    """
    padded = np.full(len(kinds) + 2 * SIDE, EDGE, np.uint8)
    padded[SIDE : SIDE + len(kinds)] = kinds
    begin = (number - zlib.crc32(kinds[:stretch].tobytes())) % rounds
    for at in range(begin * stretch, len(kinds), rounds * stretch):
        yield padded[at : min(at + stretch, len(kinds)) + 2 * SIDE]


def train(docs: DataFrame, words: Vocabulary, text_col: str = "text", rounds: int = 2, **how) -> Network:
    """The network of all tokens of `docs`; see train_encoded()."""
    rows = docs.select(F.lit(0).alias("id"), docs[text_col].alias("text"))
    return train_encoded(encode(rows, words, Scratch(docs.sparkSession), "id", "text"), words, rounds, **how)


def train_encoded(encoded: DataFrame, words: Vocabulary, rounds: int = 2, stretch: int = 64, parts: int = 16, rate: float = 0.2, batch: int = 1024, mixed: int = 32_768) -> Network:
    """Data-parallel training: each task trains on its own rows, the results are averaged by their numbers of tokens.

    Every token of every row of encode() is a target in exactly one of the rounds (see pieces), so nothing of the corpus is left
    out. Stretches of about `mixed` tokens are shuffled into steps of about `batch`. A task's steps depend on its rows alone, so a task that runs again
    gives the same network. Averages are formed in `parts` sums, so the driver gets as many at any size. Null, empty
    and blank texts train nothing; without any token the network stays as it began, classes by their shares.
    """
    spark, net = encoded.sparkSession, Network.fresh()
    net.out_bias[...] = unigram(words).out_bias  # so what is learned is what context adds
    size = net.flat().size

    for number in range(rounds):
        start = spark.sparkContext.broadcast(net.flat())

        def run(batches: Iterator[pa.RecordBatch], start=start, number=number) -> Iterator[pa.RecordBatch]:
            own = Network.of(start.value)
            memory, held, waiting, seen = [np.full_like(p, 1e-3) for p in own.parts()], [], 0, 0

            def step() -> None:
                own_order = np.random.default_rng(seen).permutation(len(held))
                for some in np.array_split(own_order, max(1, round(waiting / batch))):
                    if len(some):
                        chosen = [held[k] for k in some.tolist()]
                        sizes = np.array([len(x) for x in chosen]) - 2 * SIDE
                        where = np.arange(sizes.sum()) + np.repeat(np.arange(0, 2 * SIDE * len(sizes), 2 * SIDE), sizes)
                        own.train(np.concatenate(chosen).astype(np.int64), where, memory, rate)

            for b in batches:
                for kinds in b.column(0):
                    for piece in pieces(np.frombuffer(kinds.as_buffer(), np.uint8), rounds, number, stretch):
                        held.append(piece)
                        waiting += len(piece) - 2 * SIDE
                        seen += len(piece) - 2 * SIDE
                    if waiting > mixed:
                        step()
                        held, waiting = [], 0
            if held:
                step()
            yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(own.flat().tobytes()) % parts], pa.int32()), pa.array([seen], pa.int64()), pa.array([(own.flat() * np.float64(seen)).tobytes()], pa.binary())], ["part", "n", "params"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros(size)
            for b in batches:
                for k, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    n, total = n + k, total + np.frombuffer(p)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "n", "params"])

        shape = "part int, n long, params binary"
        n, total = 0, np.zeros(size)
        for r in map_arrow(encoded.select("kinds"), run, shape).repartition(parts, "part").mapInArrow(add, shape).toLocalIterator():
            n, total = n + r["n"], total + np.frombuffer(r["params"])
        if n:
            net = Network.of((total / n).astype(np.float32))
    return net


def score(docs: DataFrame, words: Vocabulary, net: Network, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, n_tokens, log_prob (summed over all tokens), per_token.

    A token's log P is that of its class given SIDE tokens on both sides, plus that of the word in its class by its
    exact count: those of frequent words are at hand, the others are joined from `counts` (word, n), where no word
    is frequent, so no key is hot. A word that `counts` lacks gets the byte model's share of one count.
    Null, empty and blank texts have no tokens, log_prob 0 and null per_token. Whole texts are read, however long.
    Rows are independent, so repeats and null ids give a row each and an empty table an empty result; only the
    two named columns are read, so other names cannot clash.
    """
    return score_encoded(encode(docs, words, Scratch(docs.sparkSession), id_col, text_col), words, net, counts, id_col)


def score_encoded(encoded: DataFrame, words: Vocabulary, net: Network, counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """score() of the rows of encode()."""
    sent = encoded.sparkSession.sparkContext.broadcast(net.flat())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(Network.of(sent.value))
        for b in batches:
            done = 0
            for texts in portions(b.column(2)):
                n, joined = len(texts), [np.frombuffer(x.as_buffer(), np.uint8) for x in texts]
                sizes = np.array([len(x) for x in joined])
                edge = np.full(SIDE, EDGE, np.uint8)
                padded = np.concatenate([edge, *(x for kinds in joined for x in (kinds, edge))]).astype(np.int64)  # neighbours share their edge
                text = np.repeat(np.arange(n), sizes)
                where = np.arange(len(text)) + SIDE * text
                logs = [own.logs(padded, where[first : first + 2048]) for first in range(0, len(where), 2048)]
                sums = b.column(3).slice(done, n).to_numpy() + np.bincount(text, weights=np.concatenate([np.zeros(0, np.float32), *logs]), minlength=n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, n), b.column(1).slice(done, n), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())], ["row", "id", "n_tokens", "sum"])
                done += n

    kind = encoded.schema["id"].dataType.simpleString()
    part = map_arrow(encoded.select("row", "id", "kinds", "sum"), run, f"row long, id {kind}, n_tokens long, sum double")
    asked = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    rest = counts.filter(~held(words)).select(F.col("word").alias("w"), "n")
    more = asked.join(rest, F.col("word") == F.col("w"), "left").groupBy("row").agg(F.sum(F.col("times") * F.coalesce(F.log("n"), words.spelled(F.col("word")))).alias("more"))
    total = F.col("sum") + F.coalesce("more", F.lit(0.0))
    out = part.join(more, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_tokens", total.alias("log_prob"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("per_token"))


def perplexity(scored: DataFrame) -> float:
    """exp of minus the mean log P of all tokens of score()'s rows; infinite without tokens."""
    r = scored.agg(F.sum("log_prob").alias("s"), F.sum("n_tokens").alias("n")).first()
    return float(np.exp(-r["s"] / r["n"])) if r["n"] else float("inf")


def unigram(words: Vocabulary) -> Network:
    """A network that sees no context: every class by its share of all tokens."""
    net = Network.of(np.zeros(Network.fresh().flat().size))
    net.out_bias[...] = np.log(words.totals + 1e-3) - np.log((words.totals + 1e-3).sum())
    return net


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """Fits vocabulary and network on all tokens of `docs` and scores the same rows; see train_encoded() for the training and score() for what rows give."""
    scratch = Scratch(docs.sparkSession)
    counts = word_counts(docs, text_col, scratch)
    words = vocabulary(counts)
    encoded = encode(docs, words, scratch, id_col, text_col)
    return score_encoded(encoded, words, train_encoded(encoded, words, rounds), counts, id_col)
