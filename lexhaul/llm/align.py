"""Alignment of two tokenizers over a corpus through a dictionary of token groups."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexhaul.llm.common import Scratch, map_arrow

#: Groups of a document in one row; a longer document has several.
RUN = 20_000
# Fixed value: where a byte-level vocabulary of this kind cuts a text into words before it merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def ranks(path: str) -> dict[bytes, int]:
    """Bytes and id of each token of a byte-level file, special ones apart."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    special = {t["content"] for t in found["added_tokens"]}
    return {bytes(letters[c] for c in t): i for t, i in found["model"]["vocab"].items() if t not in special}


def merges_by_rank(path: str) -> bool:
    """Whether merging the pair whose joint token has the smallest id, again and again, gives the file's own tokens for every text.

    So it is if ids follow the order of the merges, and the bytes of each merged token, merged as far as smaller ids
    go, come to the two parts that its merge names: by induction no text then has a step at which the ways differ. A file with other settings than
    plain byte-level merges is not judged.
    """
    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model, plain = found["model"], {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if found["normalizer"] or {k: v for k, v in (found["pre_tokenizer"] or {}).items() if k in plain} != plain or model.get("ignore_merges") or model.get("dropout"):
        return False
    ids = ranks(path)
    for k, merge in enumerate(model["merges"]):
        left, right = (bytes(letters[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
        own = ids.get(left + right)
        if own != 256 + k:
            return False
        parts = [bytes([x]) for x in left + right]
        while len(parts) > 2:
            small, i = min((ids.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
            if small >= own:
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if parts != [left, right]:
            return False
    return True


class Encoders:
    """Both tokenizers, with the bytes of each of their tokens. by_rank: what merges_by_rank() says of the first."""

    def __init__(self, bytes_path: str, pieces_path: str, by_rank: bool) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor

        tokens = ranks(bytes_path)
        if by_rank:  # several times faster, and the same
            from tiktoken import Encoding

            words = Encoding("words", pat_str=WORDS, mergeable_ranks=tokens, special_tokens={})
            self.a: Callable[[str], list[int]] = words.encode_ordinary
        else:
            from tokenizers import Tokenizer

            words = Tokenizer.from_file(bytes_path)
            words.encode_special_tokens = True  # their strings in a text are plain text
            self.a = lambda text: words.encode(text, add_special_tokens=False).ids
        self.b = SentencePieceProcessor(model_file=pieces_path)
        self.a_bytes = [b""] * (max(tokens.values()) + 1)
        for t, i in tokens.items():
            self.a_bytes[i] = t
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.a_size, self.b_size = (np.array([len(t) for t in x]) for x in (self.a_bytes, self.b_bytes))

    def __call__(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of space + text by both (the second adds the space itself); none if their bytes are not those."""
        a, b, raw = self.a(f" {text}"), self.b.encode(text, num_threads=1), b" " + text.encode()
        good = b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw
        return (a, b) if good else ([], [])


class Interner:
    """Groups of texts as numbers into `names`; emptied by forget()."""

    def __init__(self, encoders: Encoders) -> None:
        self.encoders = encoders
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.names: list[str] = []

    def number(self, a: np.ndarray, b: np.ndarray) -> int:
        name = f"{','.join(map(str, a.tolist()))}|{','.join(map(str, b.tolist()))}"
        if (n := self.numbers.get(name)) is None:
            n = self.numbers[name] = len(self.names)
            self.names.append(name)
        return n

    def __call__(self, texts: list[str]) -> list[tuple[int, int, np.ndarray]]:
        """n_a, n_b and the groups in turn of each text. All texts stand in one row of bytes, so offsets are compared at once."""
        if not texts:
            return []
        both = [self.encoders(t) if t else ([], []) for t in texts]
        a, b = (np.array([i for x in both for i in x[side]], np.int64) for side in range(2))
        end_a, end_b = self.encoders.a_size[a].cumsum(), self.encoders.b_size[b].cumsum()
        ends = [np.zeros(int(end_a[-1]) + 1 if len(a) else 1, bool) for _ in range(2)]
        ends[0][end_a], ends[1][end_b] = True, True
        stop_a, stop_b = (np.flatnonzero(o[e]) + 1 for o, e in ((ends[1], end_a), (ends[0], end_b)))  # tokens of either side up to the end of each group
        start_a, start_b = np.r_[0, stop_a[:-1]], np.r_[0, stop_b[:-1]]
        groups = np.empty(len(stop_a), np.int64)
        n_a, n_b = stop_a - start_a, stop_b - start_b
        shape = n_a << 32 | n_b
        order = np.argsort(shape, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(shape[order])) + 1):  # groups of equally many tokens at once, column by column
            if not len(rows):
                continue
            code = np.zeros(len(rows), np.int64)
            if len(rows) > 3:
                for side, start, n in ((a, start_a, n_a), (b, start_b, n_b)):
                    for k in range(n[rows[0]]):
                        first, code = np.unique(code << 31 | side[start[rows] + k], return_index=True, return_inverse=True)[1:]
            else:
                first = code = np.arange(len(rows))
            numbers = [self.number(a[start_a[r] : stop_a[r]], b[start_b[r] : stop_b[r]]) for r in rows[first].tolist()]
            groups[rows] = np.array(numbers, np.int64)[code]
        cuts = np.searchsorted(stop_a, np.cumsum([len(x[0]) for x in both]), "right")
        return [(len(x[0]), len(x[1]), g) for x, g in zip(both, np.split(groups, cuts[:-1]), strict=True)]


def links(key: str, a_bytes: list[bytes], b_bytes: list[bytes]) -> Counter:
    """How often each pair of ids overlaps in a group. Both sides cover the same bytes, so there are fewer links than tokens."""
    a, b = ([int(i) for i in side.split(",")] for side in key.split("|"))
    found: Counter = Counter()
    i = j = 0
    end_a, end_b = len(a_bytes[a[0]]), len(b_bytes[b[0]])
    while True:
        found[a[i], b[j]] += 1
        step_a, step_b = end_a <= end_b, end_b <= end_a
        if step_a:
            i += 1
        if step_b:
            j += 1
        if i == len(a) or j == len(b):
            return found
        if step_a:
            end_a += len(a_bytes[a[i]])
        if step_b:
            end_b += len(b_bytes[b[j]])


@dataclass(frozen=True)
class Alignment:
    """documents: one row for each document. dictionary: group, n (occurrences), docs (documents with it), links, best, count_sum. pairs: a, b, links, best (whether no other a has more links with b)."""

    documents: DataFrame
    dictionary: DataFrame
    pairs: DataFrame


DOCUMENT = "_row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, held array<struct<g:string,n:int>>"


def align(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", hot: int = 100_000) -> Alignment:
    """Aligns the tokens of a byte-level BPE file (A) with those of a sentence-piece model (B) by byte offsets of space + text.

    Offsets where tokens of both end cut a text into groups. Distinct groups are interned in a dictionary with
    their numbers; links (overlapping tokens) are expanded once for each distinct group and multiplied by how
    often it occurs, which gives the count of each pair of ids; what a group's links add up to comes back to the
    documents by the group. As few groups make most of the occurrences, at most `hot` of the most frequent ones are
    broadcast, chosen by a count of groups for each power of two of their documents; all others are joined by a shuffle.
    So no task gets all rows of a frequent group.

    `documents` has one row for each row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair count is the
    highest of their B id, ties included), count_sum (of pair counts over links), groups_sha256 of the groups as written
    in order. Texts that are null or empty, or whose tokens have other bytes, have zeros and ''. Repeated ids and texts
    count each row on its own; ids have to be whole numbers, a null id stays null; an empty table gives empty
    results. Long texts are taken whole. Only the two named columns are read, so other names cannot clash.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)

    by_rank = merges_by_rank(bytes_path)

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (b.slice(k, 128) for b in batches for k in range(0, b.num_rows, 128))

    def intern(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        groups_of, row = Interner(Encoders(bytes_path, pieces_path, by_rank)), TaskContext.get().partitionId() << 40
        for batch in parts_of(batches):
            cols: list[list] = [[] for _ in range(6)]
            lengths, ids, counts = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for doc, (n_a, n_b, own) in zip(batch.column(0).to_pylist(), groups_of([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                digest = hashlib.sha256(";".join([groups_of.names[k] for k in own.tolist()]).encode()).hexdigest() if n_a else ""
                different, n = np.unique(own, return_counts=True)
                row += 1
                for at in range(0, max(len(different), 1), RUN):
                    for c, v in zip(cols, (row, doc, n_a, n_b, len(own), digest) if at == 0 else (row, None, None, None, None, None), strict=True):
                        c.append(v)
                    lengths.append(min(RUN, len(different) - at))
                ids.append(different)
                counts.append(n)
            used, ids = np.unique(np.concatenate(ids), return_inverse=True)
            groups, counts = pa.array([groups_of.names[k] for k in used.tolist()], pa.string()).take(pa.array(ids)), np.concatenate(counts)
            if len(groups_of.names) > 200_000:
                groups_of.forget()
            held = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths, dtype=np.int32)].astype(np.int32)), pa.StructArray.from_arrays([groups, pa.array(counts, pa.int32())], ["g", "n"]))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 5, pa.string()), strict=True)), held], [f.split()[0] for f in DOCUMENT.split(", ")])

    found = scratch.write(map_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), intern, DOCUMENT), "groups")
    occurs = found.select("_row", F.explode("held").alias("h")).select("_row", F.col("h.g").alias("group"), F.col("h.n").alias("n"))
    dictionary = scratch.write(occurs.groupBy("group").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")), "dictionary")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Encoders(bytes_path, pieces_path, by_rank)
        for batch in batches:
            rows = [(g, a, b, m, m * n) for g, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for (a, b), m in links(g, both.a_bytes, both.b_bytes).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["group", "a", "b", "m", "links"])

    expanded = scratch.write(map_arrow(dictionary.select("group", "n"), expand, "group string, a int, b int, m long, links long"), "links")
    counts = expanded.groupBy("a", "b").agg(F.sum("links").alias("links"))
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    pairs = scratch.write(counts.join(most, "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best")), "pairs")
    valued = expanded.drop("links").join(pairs, ["a", "b"]).groupBy("group").agg(F.sum("m").alias("links"), F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("best"), F.sum(F.col("m") * F.col("links")).alias("count_sum"))
    dictionary = scratch.write(dictionary.join(valued, "group"), "valued")

    power = F.floor(F.log2("docs")).cast("int")
    room, least = hot, 64
    for r in dictionary.groupBy(power.alias("p")).count().orderBy(F.desc("p")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["p"]
    worth = ["group", "links", "best", "count_sum"]
    often = dictionary.filter(power >= least).select(*worth)
    joined = occurs.join(F.broadcast(often), "group", "left")
    add = lambda df: df.groupBy("_row").agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in worth[1:]])
    parts = add(joined.filter("links IS NOT NULL")).unionByName(add(occurs.join(F.broadcast(often.select("group")), "group", "left_anti").join(dictionary.filter(power < least).select(*worth), "group")))
    sums = parts.groupBy("_row").agg(*[F.sum(c).alias(c) for c in worth[1:]])
    rows = found.filter("n_groups IS NOT NULL").drop("held").join(sums, "_row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    documents = rows.select("doc_id", "n_a", "n_b", "n_groups", zero("links").alias("n_links"), zero("best").alias("n_best"), zero("count_sum").alias("count_sum"), "groups_sha256")
    return Alignment(documents, dictionary, pairs)
