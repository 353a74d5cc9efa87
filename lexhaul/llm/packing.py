"""Best-fit packing of token sequences by hierarchical residual packing."""

from __future__ import annotations

import itertools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexhaul.llm.common import Scratch, map_arrow, tasks_for

#: A stored piece inside a bin: what the result needs of it.
PIECE = np.dtype([("doc", "<i8"), ("null", "?"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i8"), ("crc", "<i8")])
PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Characters for which the word cache below is known to agree with the tokenizer's own normaliser.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-ɀ–—‘-„…€]*")
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class WordEncoder:
    """Ids of whole texts as little-endian uint32 bytes, by a cache from chunks without white space to ids.

    The tokenizer splits at white space and between words before it merges, so a text's ids are those of its
    chunks in turn.
    Texts with characters outside PLAIN or with the strings of special tokens go to the tokenizer whole.
    The cache is emptied at `limit` words, so memory stays bounded.
    """

    def __init__(self, path: str, limit: int = 400_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.cache = limit, {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or "<|" in text:
            return self.whole(text)
        chunks = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split()
        if len(self.cache) > self.limit:
            self.cache.clear()
        cache = self.cache
        if new := list(set(chunks).difference(cache)):
            self.learn(new)
        return b"".join([cache[w] for w in chunks])

    def learn(self, new: list[str]) -> None:
        """The words of all new chunks that are new themselves go to the tokenizer in one call; each word's last id is marked as a word end."""
        cache, mixed = self.cache, [(w, WORDS.findall(w)) for w in new if not w.isalpha()]
        words = list({w for w in new if w.isalpha()}.union(*(p for _, p in mixed)).difference(cache))
        raw = self.whole(" ".join(words))
        stops = (4 * (np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1)).tolist()
        for w, a, b in zip(words, [0, *stops], stops, strict=False):
            cache[w] = raw[a:b]
        for w, parts in mixed:
            cache[w] = b"".join([cache[p] for p in parts])


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids, the end id last, cut into pieces of `capacity`; one row for each piece (PIECES_SCHEMA)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = WordEncoder(tokenizer_path), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    for c, v in zip(cols, (i, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), run, PIECES_SCHEMA)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indexes of the items of each bin. Free spaces are bits of one integer, so the tightest fit is its lowest fitting bit."""
    bins: list[list[int]] = []
    by_space: dict[int, list[int]] = {}
    spaces = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = spaces >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                spaces ^= 1 << space
            bins[b].append(i)
        else:
            space, b = capacity, len(bins)
            bins.append([i])
        left = space - size
        if left:
            if not by_space.get(left):
                by_space[left] = []
                spaces |= 1 << left
            by_space[left].append(b)
    return bins


def roomy(sizes: list[tuple[int, int]], capacity: int, most: int) -> tuple[int, int, int, int]:
    """Of bins by size (size, number): how many there are, how many at most half full, and which fuller ones can still be needed.

    Two bins more than half full never fit together, so of those only as many are needed as there are others, and
    the emptiest serve best. They are the ones below a size, and a share in 1,000 of that size.
    """
    n, small = sum(c for _, c in sizes), sum(c for s, c in sizes if 2 * s <= capacity)
    room = max(small, most - small)
    for size, c in sorted(x for x in sizes if 2 * x[0] > capacity):
        if c > room:
            return n, small, size, 1000 * room // c
        room -= c
    return n, small, capacity + 1, 0


def pack(found: DataFrame, capacity: int = 4096, slack: int = 8, per_task: int = 20_000) -> DataFrame:
    """Places pieces (PIECES_SCHEMA) into bins of `capacity`; adds sequence_id and offset.

    Hierarchical residual packing: the pieces are dealt to groups of about `per_task`; each group is
    packed best-fit, and its bins with at most `slack` free tokens are emitted. The underfull bins go up
    as single items, dealt anew in each round. After a round a group has one bin at most that is at most half full,
    and only with such a one can another bin still merge; so of the fuller bins only as many of the emptiest go up
    as can find one (see roomy), the others are emitted as they are. Each round divides the number of bins that go
    up by about `per_task` / 2, until one group holds all that is left. Every piece leaves in some round: a bin either goes up or out.
    A bin carries its pieces along, at most `capacity` of them, so no later join is needed.
    """
    spark, n = found.sparkSession, found.count()
    scratch = Scratch(spark)
    schema = f"{PIECES_SCHEMA}, sequence_id long, offset long, size int, bin binary"
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "size", "bin"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def round_of(number: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            groups: dict[int, list[tuple[int, bytes, bool]]] = {}
            for batch in batches:
                for g, size, held, out in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    groups.setdefault(g, []).append((size, held, out))
            for g, items in groups.items():
                items.sort(key=lambda x: (x[2], -x[0], x[1]))  # any order of arrival gives the same bins
                up = sum(not x[2] for x in items)
                done, held = [], []
                for k, members in enumerate([*best_fit([s for s, _, _ in items[:up]], capacity), *([i] for i in range(up, len(items)))]):
                    total, raw = sum(items[i][0] for i in members), b"".join(items[i][1] for i in members)
                    if last or total >= capacity - slack or items[members[0]][2]:
                        rec = np.frombuffer(raw, PIECE)
                        done.append((rec, np.full(len(rec), number << 56 | g << 24 | k, np.int64), np.concatenate([[0], np.cumsum(rec["length"])[:-1]]).astype(np.int64)))
                    else:
                        held.append((total, raw))
                if done:
                    rec = np.concatenate([d[0] for d in done])
                    cols = [pa.array(rec["doc"], mask=rec["null"]), *(pa.array(rec[c]) for c in ("piece", "start", "length", "crc")), pa.array(np.concatenate([d[1] for d in done])), pa.array(np.concatenate([d[2] for d in done])), pa.nulls(len(rec), pa.int32()), pa.nulls(len(rec), pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names)
                if held:
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(held), t) for t in types[:7]), pa.array([h[0] for h in held], pa.int32()), pa.array([h[1] for h in held], pa.binary())], names)

        return run

    def as_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rec = np.zeros(b.num_rows, PIECE)
            rec["null"] = b.column(0).is_null().to_numpy(zero_copy_only=False)
            for k, c in enumerate(("doc", "piece", "start", "length", "crc")):
                rec[c] = b.column(k).fill_null(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(3).cast(pa.int32()), pa.array([r.tobytes() for r in rec], pa.binary())], ["size", "bin"])

    per_task = max(per_task, 8)  # fewer would not make the bins fewer round by round
    left, done, going, out = found.mapInArrow(as_items, "size int, bin binary"), [], n, F.lit(False)
    for number in itertools.count():
        last, groups = going <= per_task, tasks_for(spark, n, per_task)
        group = F.pmod(F.xxhash64("bin", F.lit(number)), F.lit(groups))
        group = F.when(out, group).otherwise(0 if last else F.pmod(F.xxhash64("bin", F.lit(number)), F.lit(tasks_for(spark, going, per_task)))).alias("g")
        whole = scratch.write(left.select(group, "size", "bin", out.alias("out")).repartition(groups, "g").mapInArrow(round_of(number, last), schema), f"round{number}")
        done.append(whole.filter("bin IS NULL").drop("size", "bin"))
        left = whole.filter("bin IS NOT NULL").select("size", "bin")
        sizes = [(r["size"], r["count"]) for r in left.groupBy("size").count().collect()]
        if not sizes:
            break
        n, small, bound, share = roomy(sizes, capacity, per_task)
        full = (F.col("size") > bound) | (F.col("size") == bound) & (F.pmod(F.xxhash64("bin", F.lit(-1)), F.lit(1000)) >= share)
        out = full & (F.col("size") * 2 > capacity)
        going = left.filter(~out).count()
    packed = done[0]
    for d in done[1:]:
        packed = packed.unionByName(d)
    return packed


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises and packs: one row for each piece of each row of `docs`.

    Null or empty text has the end id alone. Only documents longer than `capacity` are cut, however long. Rows with a
    repeated id are packed each on its own; a null id stays null, and ids have to be whole numbers. An empty table gives
    an empty result. Only the two named columns are read, so other names cannot clash.
    Tokens are made once and only their lengths and checksums travel on.
    """
    scratch = Scratch(docs.sparkSession)
    return pack(scratch.write(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces"), capacity)
