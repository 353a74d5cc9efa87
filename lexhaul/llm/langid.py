"""Language identification by nearest centroid over TF-IDF character n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexhaul.llm.common import map_arrow

#: Dimensions of the hashed n-gram space.
DIM = 4096
#: Characters of a text are counted in stretches of this many, so temporary arrays stay small.
STRETCH = 1 << 18
#: Letters of the stretches for which rejection bounds are measured, and the letters of scripts that no corpus language need have.
LENGTHS = [8 << k for k in range(10)]
FOREIGN = [(0x430, 0x44F), (0x3B1, 0x3C9), (0x627, 0x64A), (0x5D0, 0x5EA), (0x905, 0x939), (0x10D0, 0x10F0), (0xAC00, 0xB000), (0x4E00, 0x5E00)]


def ngram_counts(text: str) -> np.ndarray:
    """Counts of 1-, 2- and 3-grams of the lower-cased letters (other characters count as one blank), hashed to DIM."""
    counts = np.zeros(DIM, np.int64)
    for at in range(0, len(text), STRETCH):
        u = np.frombuffer(text[max(0, at - 2) : at + STRETCH].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = (u - 97 < 26) | (u >= 0xC0) & (u != 0xD7) & (u != 0xF7)
        c = np.where(letter, u, np.uint32(32))
        blank = c == 32
        keep = np.ones(len(c), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        c = c[keep]
        solid = c[c != 32]
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0xC2B2AE3D)
        for h in (solid * np.uint32(0x165667B1), two, three):
            h = h ^ (h >> np.uint32(15))
            counts += np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(20), minlength=DIM)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(ch.isalpha() for ch in text)


@dataclass
class Centroids:
    """A fitted model: idf, unit centroids, the language of each, and the least cosine accepted at each of LENGTHS."""

    idf: np.ndarray
    vectors: np.ndarray
    languages: list[str]
    least: np.ndarray

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts).astype(np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)

    def cosines(self, counts: np.ndarray) -> np.ndarray:
        return np.clip(self.weigh(counts) @ self.vectors.T, 0, 1)

    def bound(self, counts: np.ndarray) -> np.ndarray:
        """The least cosine accepted for texts of these n-gram counts: a text has about three n-grams for each letter."""
        return np.interp(np.log2(np.maximum(counts.sum(axis=1) / 3, 1)), np.log2(LENGTHS), self.least)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Nearest language of each text, its cosine, and whether that is too low."""
        counts = np.stack([ngram_counts(t) for t in texts])
        sims = self.cosines(counts)
        best = sims.argmax(axis=1)
        top = sims[np.arange(len(texts)), best]
        return [self.languages[k] for k in best], top, top < self.bound(counts)


def noise(letters: int, seed: int) -> list[str]:
    """Texts of about `letters` letters in words of no language: of each foreign script, and of Latin letters drawn evenly."""
    r = np.random.default_rng(seed)
    out = []
    for low, high in [*FOREIGN, (0x61, 0x7A)]:
        u = r.integers(low, high + 1, letters)
        cuts = np.cumsum(r.integers(2, 10, letters))
        out.append(" ".join("".join(map(chr, w)) for w in np.split(u, cuts[cuts < letters])))
    return out


def rejection_bounds(model: Centroids, stretches: list[tuple[int, str]]) -> np.ndarray:
    """For each of LENGTHS the cosine a fourth of the way from the highest of noise to the lowest of stretches of known language (length, text).

    Known languages come first: the bound is a fourth below their lowest at least. A length
    without stretches takes that of the length before it.
    """
    out, last = [], 0.0
    for n in LENGTHS:
        own = [t for k, t in stretches if k == n]
        if own:
            low = float(model.cosines(np.stack([ngram_counts(t) for t in own])).max(axis=1).min())
            high = float(model.cosines(np.stack([ngram_counts(t) for seed in range(4) for t in noise(n, seed)])).max())
            last = min(0.75 * low, (low + 3 * high) / 4)
        out.append(last)
    return np.array(out)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, clusters: int = 4) -> Centroids:
    """Fits on at most about `per_language` labelled rows of each language, chosen by a hash of the id (a documented bound).

    Each language's vectors are grouped by spherical k-means into at most `clusters` centroids. A fourth of the
    rows, by the same hash, forms no centroid but gives stretches of LENGTHS letters for rejection_bounds, so
    short texts have to be less alike than long ones.

    Null texts and languages are left out; without any row the model knows no language and rejects nothing. Rows with a
    repeated id are all in or all out. Copies of a text count each time. Ties in k-means go to the first centroid.
    Languages with very few rows have fewer centroids, and one that the hash leaves without a row has none. Only the three
    named columns are read, so other names cannot clash; texts are read whole, however long.
    """
    rows = labelled.select(labelled[id_col].alias("id"), labelled[text_col].alias("text"), labelled[lang_col].alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return Centroids(np.ones(DIM, np.float32), np.zeros((1, DIM), np.float32), ["und"], np.zeros(len(LENGTHS)))
    spread = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000))
    bound = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1_000_000, 1_000_000 * per_language // n))]), F.col("lang")), F.lit(0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, text, aside = b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()
            found = [(g, None if z else ngram_counts(t.as_py()), stretches_of(t.as_py()) if z else None) for g, t, z in zip(lang, text, aside, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _, _ in found], pa.string()), pa.array([None if c is None else np.minimum(c, 65535).astype("<u2").tobytes() for _, c, _ in found], pa.binary()), pa.array([x for _, _, x in found], pa.list_(pa.string()))], ["lang", "counts", "stretches"])

    aside = F.pmod(F.xxhash64(F.lit(1), F.col("id").cast("string")), F.lit(4)) == 0
    chosen = map_arrow(rows.filter(spread < bound).select("lang", "text", aside.alias("aside")).limit(2 * per_language * len(sizes)), count, "lang string, counts binary, stretches array<string>").collect()
    stretches = sorted((n, t) for r in chosen if r["stretches"] for n, t in zip(LENGTHS, r["stretches"], strict=False))
    chosen = sorted((r["lang"], bytes(r["counts"])) for r in chosen if r["counts"] is not None)
    counts = np.stack([np.frombuffer(c, "<u2") for _, c in chosen]).astype(np.int64) if chosen else np.zeros((0, DIM), np.int64)
    langs = np.array([g for g, _ in chosen])
    model = Centroids((np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32), np.zeros((0, DIM), np.float32), [], np.zeros(len(LENGTHS)))
    vectors = model.weigh(counts)
    for lang in sorted(sizes):
        own = vectors[langs == lang]
        if not len(own):
            continue
        centres = own[np.linspace(0, len(own) - 1, min(clusters, len(own))).astype(int)]
        for _ in range(8):
            member = (own @ centres.T).argmax(axis=1)
            centres = np.stack([own[member == k].mean(axis=0) if (member == k).any() else centres[k] for k in range(len(centres))])
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        model.vectors = np.concatenate([model.vectors, centres])
        model.languages += [lang] * len(centres)
    if not model.languages:
        return Centroids(model.idf, np.zeros((1, DIM), np.float32), ["und"], np.zeros(len(LENGTHS)))
    model.least = rejection_bounds(model, stretches)
    return model


def stretches_of(text: str) -> list[str]:
    """From the middle of a text a stretch with each of LENGTHS letters, as long as it has so many: whole words as far as they go."""
    words, out = text.split(), []
    sizes = np.array([sum(ch.isalpha() for ch in w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    for n in LENGTHS:
        if not len(ends) or ends[-1] < n:
            break
        first = int(np.searchsorted(ends - sizes, (ends[-1] - n) // 2, "right")) - 1
        last = int(np.searchsorted(ends, ends[first] - sizes[first] + n, "left")) + 1
        out.append(" ".join(words[first:last]))
    return out


def identify(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, lang_pred, score (cosine to the nearest centroid), rejected.

    Null, empty and letterless texts are `und`, score 0, rejected. A text whose best cosine is under the
    model's bound is rejected but keeps its nearest language. Ties go to the first centroid, which is
    that of the alphabetically first language. Whole texts are counted; rows are independent, so repeats
    and null ids give a row each. An empty table gives an empty result. Only the two named columns are read, so
    other names cannot clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                texts = part.column(1).to_pylist()
                real = [k for k, t in enumerate(texts) if has_letter(t)]
                lang, score, out = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                if real:
                    names, sims, far = model.predict([texts[k] for k in real])
                    for k, g in zip(real, names, strict=True):
                        lang[k] = g
                    score[real], out[real] = sims, far
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score), pa.array(out)], [id_col, "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(docs[id_col].alias(id_col), docs[text_col].alias("text")), run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Centroids, text_col: str = "text") -> DataFrame:
    """`docs` without the rows that identify() rejects, all columns as they were.

    Null, empty and letterless texts go. Rows are independent: repeats stay or go together, a null id does not
    matter, whole texts are read, an empty table stays empty, and columns keep their names whatever they are.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = names.index(text_col)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                texts = part.column(where).to_pylist()
                real = [k for k, t in enumerate(texts) if has_letter(t)]
                good = np.zeros(len(texts), bool)
                if real:
                    good[real] = ~model.predict([texts[k] for k in real])[2]
                yield part.filter(pa.array(good))

    return map_arrow(docs, run, docs.schema)


def learnable(held_out: Column) -> Column:
    return ~F.coalesce(held_out, F.lit(False))
