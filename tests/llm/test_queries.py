"""Every opN_ query on the smallest tables: columns and types of its contract, rows, and the contract recomputed plainly."""

import os
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexhaul.llm import toxicity
from lexhaul.llm.queries import ORACLES, QUERIES

from .test_decontam import brute as brute_hits
from .test_dedup import brute_classes, brute_exact

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TYPES = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op3_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op4_substring_dedup": {"doc_id": "bigint"},
    "op5_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op6_lm_scoring": {"doc_id": "bigint", "n_tokens": "bigint", "log_prob": "double"},
    "op7_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op8_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op9_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_pii_surrogates": {"doc_id": "bigint", "text": "string"},
}


@pytest.fixture(scope="module")
def result(spark):
    held = {}

    def of(name):
        if name not in held:
            df = QUERIES[name](spark, SF)
            held[name] = dict(df.dtypes), df.collect()
        return held[name]

    return of


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(TYPES))
def test_columns_and_rows(spark, result, docs, name):
    types, rows = result(name)
    assert TYPES[name].items() <= types.items()
    if name == "op8_url_filter":
        assert Counter(r.page_id for r in rows) == Counter(r.page_id for r in spark.read.parquet(f"{SF}/pages.parquet").collect())
    elif name == "op4_substring_dedup":
        assert {r.doc_id for r in rows} <= {i for i, _ in docs} and len({r.doc_id for r in rows}) == len(rows)
    elif name == "op2_best_fit_packing":
        assert {r.doc_id for r in rows} == {i for i, _ in docs}
    else:
        assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in docs)


def test_all_queries_are_covered():
    assert set(TYPES) == set(QUERIES) and set(ORACLES) <= set(QUERIES)


def test_scores_and_held_out_rows(result):
    for name, modulus, rest in (("op1_toxicity", 5, 0), ("op9_language_id", 4, 2)):
        for r in result(name)[1]:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) and 0 <= r.score <= 1
    assert all(r.predicted == (r.score >= 0.5) for r in result("op1_toxicity")[1])


def test_held_out_quality(spark, result):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = [(r.lang_pred, lang[r.doc_id]) for r in result("op9_language_id")[1] if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert sum(a == b for a, b in found) >= 0.95 * len(found) > 0


def test_exact_dedup_jaccard_and_decontamination_by_brute_force(spark, result, docs):
    take = lambda name, cols: Counter(tuple(r[c] for c in cols) for r in result(name)[1])
    assert take("op3_exact_dedup", list(TYPES["op3_exact_dedup"])) == brute_exact(docs)
    assert take("op7_jaccard_join", list(TYPES["op7_jaccard_join"])) == brute_classes(docs)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert take("op5_decontamination", list(TYPES["op5_decontamination"])) == brute_hits(docs, bench)


def test_packing_is_gapless(result):
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in result("op2_best_fit_packing")[1]:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:], strict=False)) and sum(b[-1]) <= 4096
    for p in pieces.values():
        p.sort()
        assert [x[0] for x in p] == list(range(len(p))) and all(x[1] == 4096 * x[0] for x in p) and all(x[2] == 4096 for x in p[:-1])
    total = sum(n for b in bins.values() for _, n in b)
    assert len(bins) <= 1.05 * total / 4096 + 2


def test_every_passage_of_fifty_words_is_found(result, docs):
    grams = defaultdict(set)
    for i, t in docs:
        w = (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
        for k in range(len(w) - 49):
            grams[tuple(w[k : k + 50])].add(i)
    exact = {i for s in grams.values() if len(s) > 1 for i in s}
    assert exact <= {r.doc_id for r in result("op4_substring_dedup")[1]}


def test_url_rules(result, spark):
    url = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    for r in result("op8_url_filter")[1]:
        rest = (url[r.page_id] or "").partition("://")[2]
        host = rest
        for c in "/?#":
            host = host.partition(c)[0]
        path = rest[len(host) :].partition("?")[0].partition("#")[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fit = [t for t in rules if (host == t.partition("/")[0] or host.endswith("." + t.partition("/")[0])) and path.startswith("/" + t.partition("/")[2])]
        rule = max(fit, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("block", "allow") and (rule is None or r.verdict == rules[rule])


def test_toxic_scores_equal_a_plain_walk_of_the_machines(frame):
    """The composed machine scores a clause as its three parts do side by side."""
    grammar = toxicity.Grammar(toxicity.seeded())
    texts = ["You idiot! He said you are scum.", "not stupid. never kill them, moron you", 'she wrote "trash clown" and you are worthless\nfine', "", "no match here", "kill you kill"]
    for t in texts:
        parts, found, score, hit = [toxicity.negation(), toxicity.reported(), toxicity.targeted()], [], 0.0, False
        states = [m.start for m in parts]
        for w in [*toxicity.TOKEN.findall(t.lower()), "."]:
            symbol, weight = grammar.classify(w) or ("word", 0.0)
            factor = 1.0
            for k, m in enumerate(parts):
                states[k], f = m.step(states[k], symbol)
                factor *= f
            score, hit = score + weight * factor, hit or symbol in ("insult", "threat")
            if symbol == "break":
                found += [score] if hit else []
                score, hit = 0.0, False
        assert grammar.clauses(t) == pytest.approx(found)


def test_labels_that_disagree_and_learned_threats(frame, spark):
    rows = [(f"word{k} zork you fine{k}", 1) for k in range(40)] + [(f"word{k} good fine{k}", 0) for k in range(400)]
    rows += [(f"you are blarg x{k}", 1) for k in range(40)] + [("same text", 1), ("same text", 0), (None, 1), ("x", None)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    kind = lambda w: (model.classify(w) or ("none",))[0]
    assert kind("zork") == "threat" and kind("blarg") == "insult"
    scored = {r.doc_id: r.predicted for r in toxicity.score(frame([(1, "a zork you b"), (2, "good words here"), (3, "blarg you are")]), model).collect()}
    assert scored == {1: 1, 2: 0, 3: 1}
