"""Models as batched stages: order, nulls, padding, loads, limits, and a real ONNX file made here by hand."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexhaul.functions import text as T
from lexhaul.operators import answering, engines


def hashed():
    return lambda texts: np.array([[b / 255 + 0.01 for b in hashlib.sha256(t.encode()).digest()[:8]] for t in texts])


def test_batches_hold_every_row_once_and_keep_the_limits():
    r = np.random.default_rng(3)
    for lengths in ([], [5], [900, 1, 1], r.integers(1, 512, 1000).tolist()):
        cut = list(engines.batches(lengths, 800, 16))
        assert sorted(i for rows in cut for i in rows) == list(range(len(lengths)))
        for rows in cut:
            assert len(rows) == 1 or (len(rows) <= 16 and len(rows) * max(lengths[i] for i in rows) <= 800)


def test_sorting_leaves_little_padding():
    lengths = np.random.default_rng(4).geometric(0.01, 4096).clip(1, 512).tolist()
    as_they_come = [np.arange(i, i + 32) for i in range(0, 4096, 32)]
    assert engines.padding_share(lengths, engines.batches(lengths, 16_384, 64)) < 0.05 < 0.5 < engines.padding_share(lengths, as_they_come)
    assert engines.padding_share([], []) == 0


@pytest.mark.parametrize("rows,chars", [(4096, 10**7), (7, 10**7), (4096, 300), (1, 1)])
def test_order_and_nulls_through_any_window(spark, rows, chars):
    engine = engines.Engine(f"hashed-{rows}-{chars}", hashed, window_rows=rows, window_chars=chars, batch_tokens=64, batch_rows=5)
    df = spark.range(0, 300, 1, 3).withColumn("t", F.when(F.col("id") % 11 != 3, F.repeat(F.lit("wört "), (F.col("id") * 37 % 23).cast("int"))))
    off = df.select("id", T.hash_embed(F.col("t")).alias("a"), engines.encoder(engine)("t").alias("b")).collect()
    assert len(off) == 300
    for r in off:
        assert (r.a is None and r.b is None) if r.id % 11 == 3 else np.allclose(r.a, r.b, atol=1e-12)


def test_empty_tables_only_nulls_and_zero_vectors(spark):
    engine = engines.Engine("zero", lambda: lambda texts: np.zeros((len(texts), 3)))
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    assert [r.v for r in df.select(engines.encoder(engine)("t").alias("v")).collect()] == [None, None]
    assert df.filter("id > 9").select(engines.encoder(engine)("t").alias("v")).collect() == []
    assert df.filter("t IS NULL").select(engines.encoder(engine)("t").alias("v")).first().v is None


def test_one_load_for_each_worker(spark, tmp_path):
    def load():
        open(f"{tmp_path}/{os.getpid()}-{os.urandom(4).hex()}", "w").close()
        return lambda texts: np.array([[os.getpid()] for _ in texts], float)

    engine = engines.Engine(f"counted-{tmp_path}", load, batch_rows=2)
    for _ in range(3):
        spark.range(0, 200, 1, 8).select(F.col("id").cast("string").alias("t")).select(engines.encoder(engine)("t")).write.format("noop").mode("overwrite").save()
    loads = [n.split("-")[0] for n in os.listdir(tmp_path)]
    assert loads and len(loads) == len(set(loads))


def test_a_shelf_is_bounded():
    for n in range(5):
        assert engines.held(f"shelf-{n}", lambda n=n: n) == n
    import sys

    assert len(sys.modules["_lexhaul_models"].shelf) == 2


def test_pairs_are_squashed_without_overflow(spark):
    engine = engines.Engine("pairs", lambda: lambda q, p: np.array([[len(a) * 1000.0 - len(b)] for a, b in zip(q, p)]))
    df = spark.createDataFrame([("", "aa"), ("q", ""), ("", ""), (None, "x"), ("x", None), ("", "a" * 900)], "q string, p string")
    got = [r.s for r in df.select(engines.pair_scorer(engine)("q", "p").alias("s")).collect()]
    assert np.allclose(got[:3], [1 / (1 + np.exp(2)), 1.0, 0.5]) and got[3] is None and got[4] is None and got[5] == 0.0


def test_engines_serve_retrieval(spark):
    rows = [(k, f"text {k} " + "x" * k, f"{k}.txt", [float(k == j) + 0.01 for j in range(4)]) for k in range(4)]
    index = spark.createDataFrame(rows, "chunk_id long, text string, citation string, embedding array<double>")
    asked = spark.createDataFrame([(9, "which", [1.0, 0.5, 0.25, 0.1])], "query_id long, question string, query array<double>")
    engine = engines.Engine("longest", lambda: lambda q, p: np.array([[len(b) / 10] for b in p]))
    got = answering.retrieve(index, asked, 2, engines.cross_encoder(engine)).orderBy("pos").collect()
    assert [r.chunk_id for r in got] == [3, 2] and np.isclose(got[0].score, 1 / (1 + np.exp(-1.0)))
    e = engines.embedder(engines.Engine("e", hashed, max_tokens=4), 8)
    made = index.select(e.encode(F.col("text")).alias("v"), e.fits(F.col("text")).alias("ok")).collect()
    assert all(len(r.v) == 8 for r in made) and [r.ok for r in made] == [True] * 4


def field(number, value):
    """One field of a protocol buffer: whole numbers as varints, all else with a length."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def gather_model(weights):
    """An ONNX file whose one node looks token ids up in a table: the last hidden state of a model without layers."""
    shape = lambda *dims: field(2, b"".join(field(1, field(2, d)) for d in dims))
    value = lambda name, kind, *dims: field(1, name) + field(2, field(1, field(1, kind) + shape(*dims)))
    table = field(1, weights.shape[0]) + field(1, weights.shape[1]) + field(2, 1) + field(8, "w") + field(9, weights.astype("<f4").tobytes())
    node = field(1, "w") + field(1, "input_ids") + field(2, "hidden") + field(4, "Gather")
    graph = field(1, node) + field(2, "g") + field(5, table) + field(11, value("input_ids", 7, "b", "t")) + field(12, value("hidden", 1, "b", "t", "d"))
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 17))


def test_an_onnx_file_with_its_tokenizer(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = {"[UNK]": 0, "alpha": 1, "beta": 2, "gamma": 3}
    tokenizer = Tokenizer(models.WordLevel(words, "[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(f"{tmp_path}/t.json")
    w = np.random.default_rng(0).normal(size=(4, 5))
    (tmp_path / "m.onnx").write_bytes(gather_model(w))
    engine = engines.Engine(f"onnx-{tmp_path}", engines.onnx(f"{tmp_path}/m.onnx", f"{tmp_path}/t.json", max_tokens=3))
    texts = ["alpha beta", "beta", "gamma alpha alpha alpha alpha", "delta"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string")
    got = df.select("id", engines.encoder(engine)("t").alias("v")).orderBy("id").collect()
    for r, k in zip(got, (1, 2, 3, 0)):
        assert np.allclose(r.v, w[k] / np.linalg.norm(w[k]), atol=1e-6)
