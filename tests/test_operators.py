import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexhaul.functions import text as T
from lexhaul.operators import evaluation, index, ranking, resolve, vectors
from lexhaul.operators.index import CompatibilityError, IndexStore
from lexhaul.sources import files
from lexhaul.streaming.ingest import watch


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_knn_orders_by_distance_then_id(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0, 0.0]), (9, [0.0] * 4), (8, None)], "vec_id long, embedding array<float>")
    got = [(r.vec_id, round(r.distance, 6)) for r in vectors.knn(v, [1, 0, 0, 0], 10).orderBy("rank").collect()]
    assert got == [(0, 0.0), (3, 0.0), (2, 0.292893), (1, 1.0)]
    assert vectors.knn(v.limit(0), [1, 0, 0, 0], 3).count() == 0


def test_knn_batch_agrees_with_brute_force(spark):
    r = np.random.default_rng(3)
    x, q = r.normal(size=(200, 8)), r.normal(size=(7, 8))
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    qs = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(q)], "query_id long, query array<double>")
    d = 1 - (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    want = sorted((i, n + 1, int(j)) for i in range(7) for n, j in enumerate(np.argsort(d[i], kind="stable")[:4]))
    assert rows(vectors.knn_batch(v, qs, 4, block=3), "query_id", "rank", "vec_id") == want


def test_vector_table_never_mixes_dimensions(spark, tmp_path):
    t = vectors.VectorTable(spark, f"{tmp_path}/v", 2, "chroma")
    t.add(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id long, embedding array<double>"))
    t.delete(spark.createDataFrame([(1,)], "chunk_id long"))
    assert t.count() == 1 and t.search([0, 1], 5).first()["chunk_id"] == 2
    with pytest.raises(ValueError):
        t.add(spark.createDataFrame([(3, [1.0])], "chunk_id long, embedding array<double>"))
    with pytest.raises(ValueError):
        vectors.VectorTable(spark, "x", 2, "other")
    t.drop()
    assert t.count() == 0


def listing(spark, texts):
    return spark.createDataFrame([(p, t, None) for p, t in texts.items()], "path string, text string, error string").withColumn("sha256", F.sha2("text", 256))


def test_ingest_is_idempotent_and_ids_are_never_reused(spark, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/i", "stub/embedder", 8)
    first = listing(spark, {"/a.md": "# A\n\nEin Text.", "/b.md": "Noch ein Text.", "/leer.md": " "})
    status = lambda df: {r.path: r.status for r in df.collect()}
    assert status(store.ingest(first, T.hash_embed)) == {"/a.md": "neu", "/b.md": "neu", "/leer.md": "leer"}
    snapshot, ids = store.current()["snapshot"], {r.id for r in store.read("chunks").collect()}
    assert status(store.ingest(first, T.hash_embed)) == {"/a.md": "unverändert", "/b.md": "unverändert", "/leer.md": "leer"}
    assert store.current()["snapshot"] == snapshot
    second = listing(spark, {"/a.md": "# A\n\nEin neuer Text."})
    assert status(store.ingest(second, T.hash_embed, prune_against=second)) == {"/a.md": "aktualisiert"}
    left = store.read("chunks").collect()
    assert [r.text for r in left] == ["Ein neuer Text."] and not {r.id for r in left} & ids
    assert tuple(store.stats().first())[:2] == (1, 1) and store.read("vectors").count() == 1
    with pytest.raises(CompatibilityError):
        IndexStore(spark, f"{tmp_path}/i", "other", 8).check()


def test_failed_files_keep_the_run_alive(spark):
    l = spark.createDataFrame([("a", "1", None, 3), ("b", "2", "unreadable", None), ("c", "3", None, 0)], "path string, sha256 string, error string, n_chunks int")
    d = spark.createDataFrame([("a", "1", 7)], "path string, sha256 string, chunk_count int")
    assert rows(index.ingest_status(l, d)) == [("a", "unverändert", 7), ("b", "fehler", None), ("c", "leer", 0)]
    assert ("a", "aktualisiert", 3) in rows(index.ingest_status(l, d, force=True))
    assert rows(index.report(index.ingest_status(l, d))) == [("fehler", 1, 0), ("leer", 1, 0), ("unverändert", 1, 7)]


def test_rerank_keeps_a_first_hit_and_leaves_a_single_one_unscored(spark):
    h = spark.createDataFrame([(1, 10, 0.1, 0.2), (1, 11, 0.2, 0.9), (1, 12, 0.3, 0.9), (2, 13, 0.4, 0.01), (3, 14, 0.1, 0.1), (3, 15, 0.2, 0.2)], "query_id int, chunk_id int, distance double, s double")
    got = rows(ranking.rerank(h, F.col("s"), 2, 0.5), "query_id", "pos", "chunk_id")
    assert got == [(1, 1, 11), (1, 2, 12), (2, 1, 13), (3, 1, 15)]
    assert ranking.rerank(h, F.col("s"), 2, 0.5).filter("query_id = 2").first()["score"] is None


def test_sources_stop_at_the_first_that_does_not_fit(spark):
    h = spark.createDataFrame([(1, k, "d.md", "x" * n) for k, n in enumerate((300, 300, 3000, 10))] + [(2, 0, "d.md", "y" * 9999), (2, 1, "d.md", "z")], "query_id int, pos int, citation string, text string")
    got = rows(ranking.build_sources(h, 500), "query_id", "number", "dropped")
    assert got == [(1, 1, 2), (1, 2, 2), (2, 1, 1)]


def test_reuse_order(spark):
    s = spark.createDataFrame([(1, 1, 0, 1), (1, 1, 1, 2), (1, 2, 0, 2), (1, 2, 1, 3)], "conv_id int, turn int, pos int, chunk_id int")
    assert [r.chunk_id for r in ranking.reusable_hits(s).orderBy("reuse_rank").collect()] == [2, 3, 1]


def test_prompts(spark):
    history = F.array(F.struct(F.lit("f").alias("question"), F.lit("a").alias("answer")))
    p = spark.range(1).select(ranking.prompt(F.lit("sys"), history, F.array(F.lit("[1] q\nt")), F.lit("neu?")).alias("p")).first()["p"]
    assert [m.role for m in p] == ["system", "user", "assistant", "user"] and p[-1].content.index("[1] q") < p[-1].content.index("neu?")
    none = F.array().cast("array<string>")
    assert spark.range(1).select(ranking.prompt(F.lit("s"), history, none, F.lit("q")).alias("p")).first()["p"] is None
    r = spark.range(1).select(ranking.route_prompt(F.lit("s"), history, none, F.lit("q")).alias("p")).first()["p"]
    assert "gefunden:" not in r[1].content and "F: f\nA: a" in r[1].content and r[1].content.index("A: a") < r[1].content.index("F: q")
    t = spark.createDataFrame([("q1", False, True), ("q2", True, True), ("q3", True, False)], "question string, has_history boolean, has_sources boolean")
    assert rows(ranking.plan_retrieval(t, lambda q: F.lit("QUELLEN_REICHEN")), "question", "reuse", "query") == [("q1", False, "q1"), ("q2", True, "q2"), ("q3", False, "q3")]


@pytest.fixture(scope="module")
def judged(spark):
    q = spark.createDataFrame([("a", "eindeutig"), ("b", "mehrdeutig"), ("c", "eindeutig"), ("n", "ohne_antwort")], "question_id string, typ string")
    h = spark.createDataFrame([("a", 1, 0.3, True), ("a", 2, 0.2, False), ("b", 1, 0.25, False), ("b", 2, 0.1, True), ("n", 1, 0.03, False), ("n", 2, 0.01, False)], "question_id string, pos int, score double, correct boolean")
    return q, h


def test_metrics(judged):
    m = evaluation.metrics(*judged, 1).first()
    assert (round(m.recall, 6), round(m.mrr, 6)) == (round(1 / 3, 6), 0.5)
    assert (m.correct_low, m.correct_high, m.noise_low, m.noise_high, m.overlap) == (0.1, 0.3, 0.03, 0.03, False)
    assert rows(evaluation.misses(*judged, 5)) == [("c", "eindeutig")]


def test_thresholds_keep_the_first_and_name_the_lost(judged):
    got = {r.threshold: r for r in evaluation.thresholds(*judged).collect()}
    assert got[0.0].noise_kept == 2 and got[0.02].noise_kept == 1 and got[0.5].noise_kept == 1
    assert got[0.12].lost == ["b"] and round(got[0.12].recall, 6) == round(1 / 3, 6)
    assert round(got[0.0].precision, 6) == 0.5 and round(got[0.3].precision, 6) == 0.5


def test_metrics_of_nothing(spark, judged):
    q, h = judged[0].limit(0), judged[1].limit(0)
    m = evaluation.metrics(q, h, 5).first()
    assert (m.recall, m.mrr, m.noise_high) == (0.0, 0.0, 0.0)


def test_gold_file(spark, tmp_path):
    good = tmp_path / "g.json"
    good.write_text(json.dumps({"hinweis": "x", "fragen": [{"id": "1", "frage": "f", "typ": "eindeutig", "dokumente": ["d"]}, {"id": "2", "frage": "g", "typ": "ohne_antwort"}]}))
    assert rows(evaluation.load_gold(spark, str(good)), "id", F.size("dokumente").alias("n")) == [("1", 1), ("2", 0)]
    bad = tmp_path / "b.json"
    bad.write_text(json.dumps({"fragen": [{"id": "1", "frage": "f"}]}))
    with pytest.raises(ValueError):
        evaluation.load_gold(spark, str(bad))


@pytest.mark.parametrize(("quant", "want"), [("Q5_K_M", True), ("q8_0", True), ("Q4_K_S", True), ("Q3_K_M", False), ("Q2_K", False), ("other", False), (None, False)])
def test_quant_tiers(spark, quant, want):
    assert spark.range(1).select(resolve.quant_acceptable(F.lit(quant).cast("string"), "Q4_K_S").alias("x")).first()["x"] is want


def test_unknown_tier_is_an_error():
    with pytest.raises(ValueError):
        resolve.quant_acceptable(F.lit("Q8_0"), "Q9")


def test_generator_cascade(spark):
    c = spark.createDataFrame(
        [("p", 1, "big-coder", True, 9 * 10**9, "Q8_0", ["x"], None, "full_gpu"), ("p", 2, "part", True, 9 * 10**9, "Q8_0", None, None, "partial"), ("p", 3, "good", True, 9 * 10**9, "Q8_0", None, ["Multilingual"], "full_gpu"), ("s", 1, "part", True, 9 * 10**9, "Q8_0", None, None, "partial"), ("n", 1, "zh", True, 9 * 10**9, "Q8_0", None, ["zh"], "full_gpu"), ("n", 2, "ctx", True, 9 * 10**9, "Q8_0", ["max context 8k"], None, "full_gpu")],
        "platform string, rank int, model_id string, can_run boolean, parameter_count long, quant_type string, warnings array<string>, languages array<string>, fit_type string",
    )
    got = {r.platform: r for r in resolve.resolve_generator(c, resolve.Criteria(exclude_patterns=["coder"], language="de")).collect()}
    assert (got["p"].model_id, got["p"].fallback) == ("good", False)
    assert (got["s"].model_id, got["s"].fallback) == ("part", True)
    assert got["n"].model_id is None and got["n"].rejected == ["zh: language", "ctx: context"]


def test_platforms(spark):
    g = 1 << 30
    df = spark.createDataFrame([(0, False), (8 * g, False), (16 * g, False), (24 * g, False), (24 * g, True)], "v long, s boolean")
    assert [r.c for r in df.select(resolve.platform_class(F.col("v"), F.col("s")).alias("c")).collect()] == ["cpu_only", "igpu_shared", "dgpu_small", "dgpu_large", "igpu_shared"]
    assert [r.h for r in df.select(resolve.vram_headroom(F.col("v")).alias("h")).collect()][:4] == [0, 512 * 2**20, int(0.05 * 16 * g), int(0.05 * 24 * g)]


def tree(tmp_path):
    d = tmp_path / "in" / "sub"
    d.mkdir(parents=True)
    (d / "a.md").write_text("# A\n\nText ä.", encoding="utf-8")
    (d / "B.TXT").write_bytes("Grüße".encode("latin-1"))
    (d / "c.png").write_bytes(b"x")
    (d / "old.doc").write_bytes(b"x")
    return tmp_path / "in"


def test_file_listing_and_reading(spark, tmp_path):
    d = tree(tmp_path)
    found = files.list_files(spark, [str(d)], [f"{d}/sub/old.doc", f"{d}/sub/a.md"])
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["B.TXT", "a.md", "old.doc"]
    got = {r.path.rsplit("/", 1)[1]: r for r in files.convert(files.probe(found)).collect()}
    assert got["B.TXT"].text == "Grüße" and "latin-1" in got["B.TXT"].warning and got["a.md"].warning is None
    assert ".docx" in got["old.doc"].error
    cache = files.cache_rows(files.convert(files.probe(found)))
    assert cache.count() == 2 and all(r.cached for r in files.convert(files.probe(found), cache).filter("error IS NULL").collect())
    assert files.cache_size(cache).first()["entries"] == 2


def test_cache_key_changes_with_every_part(spark):
    def key(h="h", ocr=False, langs=("de",), v="1", c="x"):
        return spark.range(1).select(files.cache_key(F.lit(h), F.lit(ocr), F.array(*map(F.lit, langs)), v, c).alias("k")).first()["k"]

    keys = [key(), key("g"), key(ocr=True), key(langs=("de", "en")), key(v="2"), key(c="y")]
    assert len(set(keys)) == 6 and len(keys[0]) == 32 and key() == keys[0]


def test_upload_names(spark):
    df = spark.createDataFrame([("../../x.md",), ("c:\\t\\y.PDF",), ("z.exe",), ("d/",)], "n string")
    assert [r.x for r in df.select(files.safe_name(F.col("n")).alias("x")).collect()] == ["x.md", "y.PDF", None, None]


def test_inspect(spark):
    p = spark.createDataFrame([("f", 1, "x" * 200, 0), ("f", 2, "", 200_000)], "path string, number int, text string, image_pixels int")
    assert tuple(files.inspect(p).select("pages", "scans", "ocr_ratio").first()) == (2, 1, 0.5)


def test_streaming_ingest_twice_writes_once(spark, tmp_path):
    d, store = tree(tmp_path), IndexStore(spark, f"{tmp_path}/s", "stub", 8)
    watch(spark, str(d), store, T.hash_embed, f"{tmp_path}/cp").awaitTermination()
    assert store.read("documents").count() == 2
    snapshot = store.current()["snapshot"]
    watch(spark, str(d), store, T.hash_embed, f"{tmp_path}/cp2").awaitTermination()
    assert store.current()["snapshot"] == snapshot
