"""Exact Jaccard self-join of word shingle sets by set-relation skipping, and its connected classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexhaul.llm.common import Scratch, beside_leader, broadcast_if, components, map_arrow, tasks_for

#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Odd multipliers of the shingle hash, one for each place.
PLACES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: Counters of the frequency sketch that orders shingles, and the parts it is summed in.
WIDTH, PARTS = 1 << 20, 64
#: Lists of up to this many sets give all their pairs at once; longer ones go through leaders first.
SHORT = 8
#: Entries of a list that are skipped or read together.
BLOCK = 64
POSTING = np.dtype([("token", "<u8"), ("set", "<u8"), ("doc", "<i8"), ("n", "<i4"), ("pos", "<i4")])


class Shingler:
    """Distinct 5-word shingles of a text as sorted 64-bit hashes; words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z.

    Words are hashed where they lie: a word's hash is the sum of its bytes' values, each times a weight of its place
    in the word, a difference of two running sums. So no word becomes an object. The weights follow no pattern, so no
    two words but by chance have equal sums.
    """

    SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

    def __init__(self, width: int = 5) -> None:
        self.width = width
        self.values = np.random.default_rng(11).integers(1, 1 << 63, 256).astype(np.uint64)
        self.weights = np.zeros(0, np.uint64)

    def weighted(self, n: int) -> np.ndarray:
        """Weights of the first `n` places: mixed place numbers, the same whatever the length asked for."""
        if n > len(self.weights):
            w = np.arange(1, 2 * n + 1, dtype=np.uint64) * PLACES[0]
            for shift, factor in ((30, 1), (27, 4)):
                w = (w ^ (w >> np.uint64(shift))) * PLACES[factor]
            self.weights = w ^ (w >> np.uint64(31))
        return self.weights

    def words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of every word."""
        buf = np.frombuffer(raw.translate(LOWER), np.uint8)
        solid = np.zeros(len(buf) + 2, np.int8)
        solid[1:-1] = ~self.SPACE[buf]
        turn = np.diff(solid)
        first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        if not len(first):
            return np.zeros(0, np.uint64), first
        reach = np.diff(np.r_[first, len(buf)])
        place = np.arange(first[0], len(buf)) - np.repeat(first, reach)
        sums = np.zeros(len(buf) - first[0] + 1, np.uint64)
        np.cumsum(self.values[buf[first[0] :]] * self.weighted(int(reach.max()))[place], out=sums[1:])
        h = (sums[last - first[0]] - sums[first - first[0]]) ^ (last - first).astype(np.uint64) * PLACES[3]
        h = (h ^ (h >> np.uint64(31))) * PLACES[4]
        return h ^ (h >> np.uint64(29)), first

    @staticmethod
    def rolled(w: np.ndarray, k: int) -> np.ndarray:
        """Hash of the k words from each place on."""
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = (h ^ w[i : len(w) - k + 1 + i]) * PLACES[i % 5]
            h ^= h >> np.uint64(29)
        return h

    def sequence(self, text: str) -> np.ndarray:
        """The hash of the shingle at each word; of the whole sequence if it is shorter; empty without words."""
        w, _ = self.words(text.encode("utf-8", "surrogatepass"))
        return self.rolled(w, min(self.width, len(w))) if len(w) else w

    def __call__(self, text: str) -> np.ndarray:
        return np.unique(self.sequence(text))

    def batches(self, texts: list[str | None], order: np.ndarray | None = None, size: int = 400_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The same sets for many texts at little cost for each: number of the first text, sets end to end, and where each starts and ends.

        With `order` (a class for each counter of the sketch) the hashes become sort keys: the class, then the
        hash's upper 56 bits, ascending.
        """
        first, held, waiting = 0, [], 0
        for k, t in enumerate(texts):
            held.append((t or "").encode("utf-8", "surrogatepass"))
            waiting += len(held[-1])
            if waiting >= size or k + 1 == len(texts):
                yield first, *self.joined(held, order)
                first, held, waiting = k + 1, [], 0

    def joined(self, texts: list[bytes], order: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        w, at = self.words(b"\n".join(texts))
        starts = np.searchsorted(at, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
        n = np.diff(starts)
        sizes = np.where(n >= self.width, n - self.width + 1, np.minimum(n, 1))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(ends[-1], np.uint64)
        if len(w) >= self.width:
            h = self.rolled(w, self.width)
            inside = np.arange(len(w)) - np.repeat(starts[:-1], n) < np.repeat(n - self.width + 1, n)
            out[np.repeat(n >= self.width, sizes)] = h[inside[: len(h)]]
        for i in np.flatnonzero((n > 0) & (n < self.width)):
            out[ends[i]] = self.rolled(w[starts[i] : starts[i + 1]], int(n[i]))[0]
        if order is not None:
            out = order[(out >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | out >> np.uint64(8)
        for i in range(len(n)):
            out[ends[i] : ends[i + 1]].sort()
        new = np.ones(len(out), bool)
        new[1:] = out[1:] != out[:-1]
        new[ends[:-1][sizes > 0]] = True
        return out[new], np.concatenate([[0], np.cumsum(new)])[ends]


def fingerprints(tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, as signed integers; 0 for empty sets."""
    mixed = (tokens ^ (tokens >> np.uint64(31))) * PLACES[2]
    mixed ^= mixed >> np.uint64(30)
    zero = np.zeros(1, np.uint64)
    sums = [np.concatenate([zero, np.cumsum(x, dtype=np.uint64)]) for x in (tokens, mixed)]
    return tuple((x[ends[1:]] - x[ends[:-1]]).view(np.int64) for x in sums)


def shingle_set(text: str, width: int = 5) -> set[tuple[bytes, ...]]:
    """The shingles themselves, not hashed."""
    w = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    return set(zip(*(w[k:] for k in range(width)), strict=False)) or {tuple(w)}


def similar(n1, n2, both, num: int, den: int):
    """den * both >= num * union."""
    return den * both >= num * (n1 + n2 - both)


def summarise(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """part -1: a row for each document with its set's size and fingerprint; others: each task's counters of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = Shingler(), np.zeros(WIDTH, np.uint32)
        names = ["part", "doc", "n", "f1", "f2", "counts"]
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for first, tokens, ends in shingles.batches(texts):
                np.add.at(counts, (tokens >> np.uint64(44)).astype(np.int64), 1)
                m = len(ends) - 1
                f1, f2 = fingerprints(tokens, ends)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, -1, np.int32)), ids.slice(first, m), pa.array(np.diff(ends)), pa.array(f1), pa.array(f2), pa.nulls(m, pa.binary())], names)
        if counts.any():
            held = [c.tobytes() for c in np.split(counts, PARTS)]
            none = pa.nulls(PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), none, none, none, none, pa.array(held, pa.binary())], names)

    source = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text"))
    return scratch.write(map_arrow(source, run, "part int, doc long, n long, f1 long, f2 long, counts binary"), "sets")


def frequency_classes(summary: DataFrame) -> np.ndarray:
    """For each counter its frequency class, about eight to a doubling: the sums over all documents, WIDTH bytes at any input size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(c.as_py(), np.uint32).astype(np.int64)
        for k, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([c.astype("<i8").tobytes()], pa.binary())], ["part", "counts"])

    parts = summary.filter("part >= 0").select("part", "counts").repartition(PARTS, "part").mapInArrow(add, "part int, counts binary")
    out = np.zeros((PARTS, WIDTH // PARTS), np.uint8)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.minimum(255, 8 * np.log2(1 + np.frombuffer(c.as_py(), "<i8"))).astype(np.uint8).tobytes() for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.binary())], ["part", "counts"])

    for r in parts.mapInArrow(shrink, "part int, counts binary").toLocalIterator():
        out[r["part"]] = np.frombuffer(r["counts"], np.uint8)
    return out.ravel()


def prefixes(docs: DataFrame, order: np.ndarray, buckets: int, num: int, den: int, id_col: str, text_col: str, flush: int = 400_000) -> DataFrame:
    """Packed postings (POSTING) of each set's prefix, rarest shingles first, dealt by shingle to buckets.

    Within a task each distinct set is indexed once, so a group of exact copies sends one set for each task.
    """
    ordering = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen, held, size = Shingler(), set(), [], 0

        def flushed() -> pa.RecordBatch:
            rec = np.concatenate(held)
            bucket = (rec["token"] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            rec, bucket = rec[by], bucket[by]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            parts = np.split(rec, cuts[1:])
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["bucket", "postings"])

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for first, keys, ends in shingles.batches(texts, ordering.value):
                n = np.diff(ends)
                f1, f2 = fingerprints(keys, ends)
                own = ids[first : first + len(n)]
                fresh = np.zeros(len(n), bool)
                for k, f in enumerate(zip(f1.tolist(), f2.tolist(), strict=True)):
                    fresh[k] = n[k] > 0 and own[k] is not None and f not in seen
                    if fresh[k] and len(seen) < 1_000_000:
                        seen.add(f)
                p = np.where(fresh, n - -(-num * n // den) + 1, 0)
                pos = np.arange(len(keys)) - np.repeat(ends[:-1], n)
                take = pos < np.repeat(p, n)
                rec = np.empty(int(take.sum()), POSTING)
                rec["token"], rec["pos"] = keys[take], pos[take]
                rec["set"], rec["doc"], rec["n"] = np.repeat(f1.view(np.uint64), p), np.repeat(np.array([i or 0 for i in own], np.int64), p), np.repeat(n, p)
                held.append(rec)
                size += len(rec)
                if size > flush:
                    yield flushed()
                    held, size = [], 0
        if size:
            yield flushed()

    return map_arrow(docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text")), run, "bucket long, postings binary")


def may_link(n1, rest1, n2, rest2, num: int, den: int):
    """Size and position filter: rest is what a set has from this shingle on, the most the two can share if it is their first."""
    low, high = np.minimum(n1, n2), np.maximum(n1, n2)
    return (den * low >= num * high) & ((num + den) * np.minimum(rest1, rest2) >= num * (n1 + n2))


PAIR_SCHEMA = "long boolean, a long, b long, token long, n int, pos int"


def first_round(postings: DataFrame, buckets: int, num: int, den: int) -> DataFrame:
    """Reads the lists of each bucket. Pairs to verify (long false), and the members of long lists with their leader (long true: a member, b leader).

    Lists of one set vanish. Sets of a long list, sorted by size in blocks within the size filter, are
    only paired with three leaders of the block, chosen by hash, so the pairs stay linear in the list.
    """
    names = ["long", "a", "b", "token", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[np.ndarray] = []
        for b in batches:
            got += [np.frombuffer(x.as_py(), POSTING) for x in b.column(1)]
        if not got:
            return
        rec = np.concatenate(got)
        got.clear()
        by = np.argsort(rec["token"], kind="stable")
        token = rec["token"][by]
        twice = np.r_[False, token[1:] == token[:-1]]
        twice[:-1] |= twice[1:]
        rec = rec[by[twice]]
        rec = rec[np.lexsort((rec["doc"], rec["set"], rec["n"], rec["token"]))]
        if len(rec):
            same = (rec["token"][1:] == rec["token"][:-1]) & (rec["set"][1:] == rec["set"][:-1]) & (rec["n"][1:] == rec["n"][:-1])
            rec = rec[np.r_[True, ~same]]
        start = np.flatnonzero(np.r_[True, rec["token"][1:] != rec["token"][:-1]]) if len(rec) else np.zeros(0, int)
        length = np.diff(np.r_[start, len(rec)])
        short = np.repeat(length <= SHORT, length)
        n, rest, pairs = rec["n"].astype(np.int64), (rec["n"] - rec["pos"]).astype(np.int64), []
        for s in range(1, SHORT):
            i = np.flatnonzero(short[:-s] & (rec["token"][s:] == rec["token"][:-s])) if len(rec) > s else np.zeros(0, int)
            i = i[may_link(n[i], rest[i], n[i + s], rest[i + s], num, den)]
            pairs.append(np.stack([rec["doc"][i], rec["doc"][i + s]], 1))
        for at, m in zip(start[length > SHORT].tolist(), length[length > SHORT].tolist(), strict=True):
            lead = np.empty(m, np.int64)
            block = at
            while block < at + m:  # a block: sizes within the size filter of its smallest
                stop = at + int(np.searchsorted(n[at : at + m], n[block] * den // num, "right"))
                own = np.arange(block, stop)
                for k, salt in enumerate(PLACES[:3]):
                    h = own[((rec["set"][own] ^ salt) * PLACES[3]).argmin()]
                    if not k:
                        lead[block - at : stop - at] = rec["doc"][h]
                    ok = own[may_link(n[own], rest[own], n[h], rest[h], num, den) & (own != h)]
                    pairs.append(np.stack([np.full(len(ok), rec["doc"][h]), rec["doc"][ok]], 1))
                block = stop
            own = slice(at, at + m)
            yield pa.RecordBatch.from_arrays([pa.array([True] * m, pa.bool_()), pa.array(rec["doc"][own]), pa.array(lead), pa.array(rec["token"][own].view(np.int64)), pa.array(rec["n"][own]), pa.array(rec["pos"][own])], names)
        found = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        found = np.unique(found[found[:, 0] != found[:, 1]], axis=0)
        none = pa.nulls(len(found), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([False] * len(found), pa.bool_()), pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy()), none.cast(pa.int64()), none, none], names)

    return postings.repartition(buckets, "bucket").mapInArrow(run, PAIR_SCHEMA)


MEMBERS = "token", "doc", "n", "pos", "leader", "class", "d"


def lists_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The lists of rows (MEMBERS) that arrive sorted by token, one at a time."""
    token, held = None, []
    for b in batches:
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(len(MEMBERS))]
        cuts = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
        for part in np.split(np.arange(b.num_rows), cuts) if b.num_rows else []:
            own = [c[part] for c in cols]
            if held and own[0][0] != token:
                yield dict(zip(MEMBERS, map(np.concatenate, zip(*held, strict=True)), strict=True))
                held = []
            token = own[0][0]
            held.append(own)
    if held:
        yield dict(zip(MEMBERS, map(np.concatenate, zip(*held, strict=True)), strict=True))


def star_round(members: DataFrame, num: int, den: int, number: int = 0, leaders: int = 32) -> DataFrame:
    """For each list, pairs of an eighth of its largest class, `leaders` at most, with the rest (PAIR_SCHEMA, as first_round).

    The first leader meets every row of the list, so that all have a distance to it; the others meet the rows
    outside the class that may link. They are others in each round. The pairs stay linear in the list.
    """
    salt = np.uint64(2 * number + 1)

    names = ["long", "a", "b", "token", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in lists_of(batches):
            doc, n, m = x["doc"].astype(np.int64), x["n"].astype(np.int64), len(x["doc"])
            rest = n - x["pos"]
            kinds, size = np.unique(x["class"], return_counts=True)
            inside = x["class"] == kinds[size.argmax()]
            own = np.flatnonzero(inside)
            mixed = (doc[own].astype(np.uint64) ^ salt << np.uint64(40)) * PLACES[0]
            own = own[np.argsort((mixed ^ (mixed >> np.uint64(31))) * PLACES[1], kind="stable")[: min(leaders, 1 + len(own) // 8)]]
            pairs = [np.stack([np.full(m, doc[own[0]]), doc], 1)]
            for k in own[1:]:
                ok = np.flatnonzero(~inside & may_link(n, rest, n[k], rest[k], num, den))
                pairs.append(np.stack([np.full(len(ok), doc[k]), doc[ok]], 1))
            found = np.concatenate(pairs)
            found = found[found[:, 0] != found[:, 1]]
            none = pa.nulls(len(found), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(found), bool)), pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy()), none.cast(pa.int64()), none, none], names)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, bool)), pa.array(doc), pa.array(np.full(m, doc[own[0]])), pa.array(x["token"]), pa.array(n.astype(np.int32)), pa.array(x["pos"].astype(np.int32))], names)

    return members.select(*MEMBERS).repartition("token").sortWithinPartitions("token", "n", "doc").mapInArrow(run, PAIR_SCHEMA)


class Blocks:
    """A list sorted by size and position in blocks of BLOCK entries, each with its smallest size and longest rest."""

    def __init__(self, n: np.ndarray, rest: np.ndarray, num: int, den: int) -> None:
        self.n, self.rest, self.num, self.den = n, rest, num, den
        self.starts = np.arange(0, len(n), BLOCK)
        self.least, self.most = n[self.starts], np.maximum.reduceat(rest, self.starts)

    def after(self, i: int) -> np.ndarray:
        """Entries after i, without the blocks in which none can link to it."""
        k, n, rest = i // BLOCK, self.n[i], self.rest[i]
        least, most = self.least[k:], np.minimum(self.most[k:], rest)
        near = self.starts[k:][(self.num * least <= self.den * n) & ((self.num + self.den) * most >= self.num * (n + np.maximum(least, n)))]
        j = (near[:, None] + np.arange(BLOCK)).ravel()
        return j[(j > i) & (j < len(self.n))]


def second_round(members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of a list that neither a class nor their leader's answers settle.

    members: token, doc, n, pos, leader, d (the distance to the leader, if known), class. Two sets of one
    class need no check. Jaccard distance is a metric: if the distances of two sets to their common leader
    differ by more than the join's bound, the two cannot link. Both answers come from what was computed for
    the leader. Lists are sorted by size and position, so that whole blocks of them are skipped.
    """
    bound = 1 - num / den + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in lists_of(batches):
            doc, n, leader, cls = (x[k].astype(np.int64) for k in ("doc", "n", "leader", "class"))
            d, rest, out, size = x["d"].astype(float), n - x["pos"], [], 0
            blocks = Blocks(n, rest, num, den)
            for i in range(len(doc)):
                j = blocks.after(i)
                j = j[(cls[j] != cls[i]) & may_link(n[j], rest[j], n[i], rest[i], num, den)]
                j = j[~((leader[j] == leader[i]) & (np.abs(d[j] - d[i]) > bound))]
                if len(j):
                    out.append(np.stack([np.full(len(j), doc[i]), doc[j]], 1))
                    size += len(j)
                if out and (size > 200_000 or i + 1 == len(doc)):
                    found = np.sort(np.concatenate(out), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])
                    out, size = [], 0

    return members.select(*MEMBERS).repartition("token").sortWithinPartitions("token", "n", "pos", "doc").mapInArrow(run, "a long, b long")


def jaccard_classes(docs: DataFrame, num: int = 75, den: int = 100, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, n_shingles, component_id.

    Two documents link when den * intersection >= num * union of their sets of distinct 5-word shingles
    (the whole sequence if it is shorter); component_id is the smallest id reachable over links. Pairs
    come from prefix lists under one global order, rarest first by a frequency sketch over all documents;
    any order is exact, this one keeps common passages out of the prefixes. Every candidate is compared by
    whole sets of 64-bit shingle hashes, and a link that they show by the shingles' words; no link between different sets is lost: members of long
    lists that leaders leave unsettled are compared in a second round. Equal sets are one class from the
    start, by a 128-bit fingerprint. Before the second round, `rounds` times a few members of each list's largest
    class meet the rest of the list, so that large groups of near copies close without all their pairs.

    Null, empty and wordless texts have no shingles and are their own class. Rows with a repeated id are
    one node with several sets; rows with a null id link with nothing and have a null component_id. An
    empty table gives an empty result. Only the two named columns are read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    summary = summarise(docs, scratch, id_col, text_col)
    sets = summary.filter("part < 0").select("doc", "n", "f1", "f2")
    equal = scratch.write(sets.filter("n > 0 AND doc IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("doc").alias("rep")), "equal")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("c")).first()
    buckets = max(16, tasks_for(spark, total["t"] * (den - num) // den + total["c"], 1_000_000))
    read = scratch.write(first_round(prefixes(docs, frequency_classes(summary), buckets, num, den, id_col, text_col), buckets, num, den), "lists")
    shingles = Shingler()

    def prepare(text: str) -> tuple[str, np.ndarray]:
        return text, shingles(text)

    def compare(one: tuple[str, np.ndarray], other: tuple[str, np.ndarray]) -> list[tuple]:
        x, y = one[1], other[1]
        both = len(np.intersect1d(x, y, assume_unique=True))
        linked = bool(len(x) and len(y) and similar(len(x), len(y), both, num, den))
        if linked:  # hashes only propose a link, words decide
            u, v = shingle_set(one[0]), shingle_set(other[0])
            linked = similar(len(u), len(v), len(u & v), num, den)
        return [(1 - both / max(1, len(x) + len(y) - both), linked)]

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        return scratch.write(beside_leader(docs, scratch.write(pairs.distinct(), f"{name}-pairs"), prepare, compare, "d double, linked boolean", id_col, text_col), name)

    nodes = sets.join(equal, ["n", "f1", "f2"]).select("doc", "rep", "n")
    rep = scratch.write(nodes.select("doc", "rep").filter("doc <> rep"), "copies")
    copies = rep.select(F.col("doc").alias("u"), F.col("rep").alias("v"))
    near = verified(read.filter("NOT long").select("a", "b"), "first")

    def classes() -> DataFrame:
        return components(near.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(copies), scratch)

    def unsettled(found: DataFrame, label: DataFrame) -> DataFrame:
        """Members of the lists that hold more than one class, with class and distance to their leader."""
        rows = found.filter("long").select("token", F.col("a").alias("doc"), "n", "pos", F.col("b").alias("leader"))
        rows = rows.join(label, F.col("doc") == F.col("node"), "left").withColumn("class", F.coalesce("component", "doc")).drop("node", "component")
        mixed = rows.groupBy("token").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("token")
        known = near.select(F.col("a").alias("leader"), F.col("b").alias("doc"), "d").unionByName(near.select(F.col("b").alias("leader"), F.col("a").alias("doc"), "d")).groupBy("leader", "doc").agg(F.when(F.min("d") == F.max("d"), F.min("d")).alias("d"))  # unknown if an id has several sets
        rows = rows.join(mixed, "token", "left_semi").join(known, ["leader", "doc"], "left")
        return scratch.write(rows.withColumn("d", F.when(F.col("leader") == F.col("doc"), 0.0).otherwise(F.col("d"))), "members")

    label = classes()
    members = unsettled(read, label)
    for number in range(rounds):
        if members.isEmpty():
            break
        read = scratch.write(star_round(members, num, den, number), "stars")
        asked = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = near.unionByName(verified(read.filter("NOT long").select("a", "b").join(asked, ["a", "b"], "left_anti"), "star"))
        label = classes()
        members = unsettled(read, label)
    if not members.isEmpty():
        asked = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        more = verified(second_round(members, num, den).join(asked, ["a", "b"], "left_anti"), "second")
        if not more.filter("linked").isEmpty():
            near = near.unionByName(more)
            label = classes()
    out = sets.join(label, sets["doc"] == label["node"], "left")
    return out.select(sets["doc"].alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def keep_first_of_class(docs: DataFrame, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with only the smallest id of each class, all columns as they were; rows with a null id stay."""
    scratch = Scratch(docs.sparkSession)
    found = jaccard_classes(docs, num, den, id_col=id_col, text_col=text_col)
    gone = scratch.write(found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct(), "gone")
    return docs.join(broadcast_if(gone, gone.count()), docs[id_col] == gone["_gone"], "left_anti")
