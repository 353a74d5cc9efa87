"""Tokens are cut, looked up and trained on for many texts at once, with the results of one at a time."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from lexhaul.llm import lm
from lexhaul.llm.common import Scratch


def odd_texts():
    r = random.Random(1)
    signs = ["a", "Z", "9", " ", "\n", "\x0b", "\x1c", "\x85", "\xa0", "é", "ß", "-", ".", "_", "\x00", "語", "  ", "😀"]
    return ["".join(r.choices(signs, k=r.randint(0, 40))) for _ in range(500)] + [None, "", None, " ", "\n\n", "a", "b"]


def test_texts_cut_together_give_the_tokens_of_each():
    for texts in (odd_texts(), [], [None], ["", ""], ["a", "b"], ["a", None, "b"]):
        for kind in (pa.string(), pa.binary()):
            rows = pa.array(["x y", *texts, "z"], pa.string()).cast(kind).slice(1, len(texts))
            for most in (1, 30, 1 << 22):
                got = []
                for part in lm.portions(rows, most):
                    words, at, ends = lm.cut(part)
                    words = words.to_pylist()
                    assert len(set(words)) == len(words)
                    got += [[words[k] for k in at[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                assert got == [lm.tokens_of(t or "") for t in texts]


def run_here(df, run, shape):
    """What a task yields for all rows of `df`, as a frame."""
    found = pa.Table.from_batches(run(iter(df.toArrow().to_batches())))
    return df.sparkSession.createDataFrame(found.to_pylist(), shape)


def test_no_text_is_cut_on_its_own(frame, monkeypatch):
    """Counting and encoding took most of their time text by text and token by token."""
    texts = odd_texts()[-60:]
    want = [lm.tokens_of(t or "") for t in texts]
    monkeypatch.setattr(lm, "map_arrow", run_here)
    monkeypatch.setattr(lm, "tokens_of", None)
    docs = frame(list(enumerate(texts)))
    counts = lm.word_counts(docs, "text", Scratch(docs.sparkSession))
    n = {bytes(r.word): r.n for r in counts.collect()}
    assert n == Counter(w for ws in want for w in ws)
    words = lm.vocabulary(counts, 20)
    got = {r.id: r for r in lm.encode(docs, words, Scratch(docs.sparkSession)).collect()}
    for k, ws in enumerate(want):
        assert list(got[k].kinds) == [words.class_of(w) for w in ws]
        assert {bytes(r.word): r.times for r in got[k].rare} == Counter(w for w in ws if w not in words.counts)
        logs = [np.log(words.counts.get(w, 1)) - np.log(words.totals[words.class_of(w)] + 1) for w in ws]
        assert np.isclose(got[k].sum, sum(logs))


def test_a_training_step_equals_the_gradient_token_by_token():
    r = np.random.default_rng(2)
    net, pieces = lm.Network.fresh(), [r.integers(0, lm.CLASSES, n) for n in (7, 70, 8, 40)]
    padded, ends = np.concatenate(pieces), np.cumsum([0, *(len(p) for p in pieces)])
    where = np.concatenate([np.arange(a, b - 2 * lm.SIDE) for a, b in zip(ends[:-1], ends[1:], strict=True)])
    tables, bias, out, out_bias = (p.astype(float) for p in net.parts())
    grads = [np.zeros(p.shape) for p in net.parts()]
    for at in where:
        near, own = [padded[at + k] for k in lm.OFFSETS], padded[at + lm.SIDE]
        h = np.tanh(bias + sum(tables[t][c] for t, c in enumerate(near)))
        p = np.exp(h @ out + out_bias)
        p /= p.sum()
        p[own] -= 1
        p /= len(where)
        back = (out @ p) * (1 - h * h)
        for t, c in enumerate(near):
            grads[0][t][c] += back
        for g, x in zip(grads[1:], (back, np.outer(h, p), p), strict=True):
            g += x
    memory = [np.full_like(p, 1e-3) for p in net.parts()]
    net.train(padded, where, memory, 0.2)
    for part, before, g, m in zip(net.parts(), (tables, bias, out, out_bias), grads, memory, strict=True):
        assert np.allclose(m, 1e-3 + g * g, atol=1e-6)
        assert np.allclose(part, before - 0.2 * g / np.sqrt(1e-3 + g * g + 1e-8), atol=1e-4)
