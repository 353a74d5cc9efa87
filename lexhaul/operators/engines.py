"""Models as stages: loaded once for each worker, rows sorted by length in windows, batches cut by tokens."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexhaul.operators.answering import CrossEncoder, Embedder

#: What a loaded model is: columns of texts to one row of numbers for each.
Model = Callable[..., np.ndarray]


def estimate(text: str) -> int:
    """functions.text.estimate_tokens for a text in Python."""
    return max(1, int(len(text) / 3.2))


@dataclass(frozen=True)
class Engine:
    """[M8, R8] A model and its limits.

    `load` runs in a worker and returns the model; workers keep it under `name`, so one name stands for one model.
    A batch has at most `batch_rows` rows and, unless it is a single one, `batch_tokens` tokens with padding. Rows are sorted
    inside windows of at most `window_rows` rows that end at the first text to reach `window_chars`, the bound of what a task holds.
    """

    name: str
    load: Callable[[], Model]
    count: Callable[[str], int] = estimate
    max_tokens: int = 512
    batch_tokens: int = 16_384
    batch_rows: int = 64
    window_rows: int = 4_096
    window_chars: int = 16_000_000


def held(name: str, load: Callable[[], Model], most: int = 2) -> Model:
    """The model of this worker process; loaded at its first use, the oldest of more than `most` is let go."""
    shelf = sys.modules.setdefault("_lexhaul_models", types.ModuleType("_lexhaul_models")).__dict__.setdefault("shelf", {})
    if name not in shelf:
        while len(shelf) >= most:
            del shelf[next(iter(shelf))]
        shelf[name] = load()
    return shelf[name]


def batches(lengths: Sequence[int], batch_tokens: int, batch_rows: int) -> Iterator[np.ndarray]:
    """Places of rows, shortest first; a batch ends before rows times its longest row would exceed `batch_tokens`."""
    order = np.argsort(lengths, kind="stable")
    start = 0
    for end in range(1, len(order) + 1):
        full = end == len(order) or end - start == batch_rows or (end + 1 - start) * lengths[order[end]] > batch_tokens
        if full:
            yield order[start:end]
            start = end


def padding_share(lengths: Sequence[int], cut: Iterable[np.ndarray]) -> float:
    """Of all tokens that a model sees with rows padded to the longest of their batch, the share that is padding."""
    n = np.asarray(lengths)
    seen = sum(len(rows) * int(n[rows].max()) for rows in cut)
    return 1 - int(n.sum()) / seen if seen else 0.0


def windows(parts: Iterable[tuple[pd.Series, ...]], rows: int, chars: int) -> Iterator[list[tuple]]:
    """Arrow batches as lists of rows, each as long as `rows` and `chars` allow, in order."""
    out, size = [], 0
    for part in parts:
        for row in zip(*part):
            out.append(row)
            size += sum(len(x) for x in row if x is not None)
            if len(out) >= rows or size >= chars:
                yield out
                out, size = [], 0
    if out:
        yield out


def run(engine: Engine, parts: Iterable[tuple[pd.Series, ...]], finish: Callable[[np.ndarray], Iterable]) -> Iterator[pd.Series]:
    """One value for each row, in the rows' order. A row with a null never reaches the model and gets null."""
    for rows in windows(parts, engine.window_rows, engine.window_chars):
        out: list = [None] * len(rows)
        whole = [i for i, row in enumerate(rows) if all(x is not None for x in row)]
        lengths = [min(sum(engine.count(x) for x in rows[i]), engine.max_tokens) for i in whole]
        for cut in batches(lengths, engine.batch_tokens, engine.batch_rows):
            places = [whole[j] for j in cut]
            made = held(engine.name, engine.load)(*[[rows[i][c] for i in places] for c in range(len(rows[0]))])
            for i, value in zip(places, finish(np.asarray(made, dtype=float))):
                out[i] = value
        yield pd.Series(out, dtype=object)


def unit_rows(m: np.ndarray) -> list:
    """Rows of length 1; None for a zero row."""
    norm = np.sqrt((m * m).sum(axis=1))
    return [row / n if n > 0 else None for row, n in zip(m, norm)]


def sigmoid(logits: np.ndarray) -> list[float]:
    """1 / (1 + e^-x) without overflow for any finite x."""
    x = logits.reshape(-1)
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e)).tolist()


def encoder(engine: Engine) -> Callable[[Column], Column]:
    """A text column to unit vectors; null for null and for zero vectors."""

    @F.pandas_udf("array<double>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(engine, ((p,) for p in parts), unit_rows)

    return encode


def pair_scorer(engine: Engine) -> Callable[[Column, Column], Column]:
    """Columns of question and passage to the logistic function of the model's one number; null if either is null."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for out in run(engine, parts, sigmoid):
            yield out.astype(float)

    return score


def embedder(engine: Engine, dimensions: int) -> Embedder:
    return Embedder(engine.name, dimensions, encoder(engine), max_tokens=engine.max_tokens)


def cross_encoder(engine: Engine) -> CrossEncoder:
    return CrossEncoder(engine.name, pair_scorer(engine))


def onnx(model_path: str, tokenizer_path: str, max_tokens: int = 512, threads: int = 1, first_token: bool = True) -> Callable[[], Model]:
    """A loader of an ONNX file and a tokenizer's JSON, both at paths that every executor can read.

    Texts (or pairs) are cut to `max_tokens` and padded. The first output is the last hidden state, of which the first token's
    row counts, or with `first_token` off one row of logits for each text. Threads are those of one task.
    """

    def load() -> Model:
        import onnxruntime
        from tokenizers import Tokenizer

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = threads
        model = onnxruntime.InferenceSession(model_path, options, providers=onnxruntime.get_available_providers())
        wanted = {i.name for i in model.get_inputs()}
        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.enable_truncation(max_tokens)
        tokenizer.enable_padding()

        def call(*columns: list[str]) -> np.ndarray:
            read = tokenizer.encode_batch(list(zip(*columns)) if len(columns) > 1 else columns[0])
            feed = {"input_ids": [r.ids for r in read], "attention_mask": [r.attention_mask for r in read], "token_type_ids": [r.type_ids for r in read]}
            made = model.run(None, {k: np.array(v, dtype=np.int64) for k, v in feed.items() if k in wanted})[0]
            return made[:, 0] if first_token else made

        return call

    return load
