import hashlib
import re
from collections import Counter

import pytest

from lexhaul.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, items, size=10):
    words = lambda t: WORD.findall((t or "").translate(UPPER))
    wins = set()
    for i, t in items:
        w = words(t)
        wins |= {(i, tuple(w[k : k + size])) for k in range(max(1, len(w) - size + 1))} if w else set()
    out = []
    for i, t in rows:
        w, hit, who = words(t), set(), set()
        for item, x in wins:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    who.add(str(item))
        out.append((i, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


COLS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.fixture
def items(spark, corpus):
    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, word string, term long")

    return make


def test_decontaminate(frame, corpus, items):
    text = dict(corpus)
    bench = [(1, text[3]), (2, text[3]), (10, " ".join(text[7].split()[:5])), (3, "ba, do! RI"), (4, None), (5, ""), (6, "..."), (7, "unknown words that occur nowhere at all in these texts"), (8, "ÄX ba"), (9, "KA"), (9, "lu ka"), (11, text[300][100:700])]
    rows = [*((i, t) for i, t in corpus if i != 507), (950, f"-{text[3].upper()}-"), (951, "äx ba"), (952, "ÄX BA x"), (953, ".ba do ri."), (953, "ka"), (954, "kalu ka-ka")]
    got = decontam.decontaminate(frame(rows), items(bench)).select(*COLS).collect()
    assert Counter(map(tuple, got)) == brute(rows, bench)


@pytest.mark.parametrize(("rows", "bench"), [([], []), ([(1, "a b")], []), ([], [(1, "a b")]), ([(1, None), (None, "a b")], [(1, "a")])])
def test_small_tables(frame, items, rows, bench):
    got = decontam.decontaminate(frame(rows), items(bench)).select(*COLS).collect()
    assert Counter(map(tuple, got)) == brute(rows, bench)


def test_shuffled_joins_give_the_same(frame, corpus, items, monkeypatch):
    monkeypatch.setattr(decontam, "broadcast_if", lambda df, *a: df)
    rows, bench = corpus[:80], [(1, dict(corpus)[3]), (2, "ba do")]
    assert Counter(map(tuple, decontam.decontaminate(frame(rows), items(bench)).select(*COLS).collect())) == brute(rows, bench)


def test_keep_clean(frame, corpus, items):
    bench = [(1, dict(corpus)[3]), (2, dict(corpus)[301])]
    want = Counter(k[0] for k in brute(corpus, bench).elements() if not k[5])
    kept = decontam.keep_clean(frame(corpus), items(bench))
    assert kept.columns == frame([]).columns and Counter(r.doc_id for r in kept.collect()) == want


def test_proximity_takes_any_order_within_the_slop(frame, items):
    rows = [(1, "x gamma alpha x beta x"), (2, "alpha beta gamma"), (3, "alpha x x x x x x x x x beta gamma"), (4, "alpha beta")]
    found = decontam.proximity(decontam.build(frame(rows), items([(1, "alpha beta gamma")])), slop=3)
    assert {r._doc for r in found.collect()} == {1, 2}


def near(rows, items, size=10, slop=5):
    """Items of which all words of a window, two at least, lie within its length and `slop` words, by trying every stretch."""
    words, out = lambda t: WORD.findall((t or "").translate(UPPER)), []
    wins = {(i, tuple(w[k : k + size])) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - size + 1))}
    for i, t in rows:
        w = words(t)
        out.append((i, len({item for item, x in wins if len(set(x)) > 1 and any(set(x) <= set(w[k : k + len(x) + slop]) for k in range(len(w)))})))
    return Counter(out)


@pytest.mark.parametrize("broadcast", [True, False])
def test_proximity_against_brute_force(frame, corpus, items, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontam, "broadcast_if", lambda df, *a: df)
    text = dict(corpus)
    w = text[300].split()
    bench = [(1, " ".join(w[30:55])), (2, "ba do ri"), (3, "ka"), (4, "ka ka"), (5, " ".join(reversed(w[40:48]))), (6, "lu sen ka do")]
    rows = [*((i, t) for i, t in corpus if i != 507 and i != 505), (950, " ".join([*w[44:48], "x", "y", "z", "u", *w[40:44]])), (951, " ".join([*w[44:48], *"abcdef", *w[40:44]])), (952, "ba x x x x x do ri"), (953, "ri x x x x x do"), (953, "RI,do.BA")]
    got = decontam.decontaminate(frame(rows), items(bench)).select("doc_id", "n_near_items").collect()
    assert Counter(map(tuple, got)) == near(rows, bench)


def test_rows_that_repeat_id_and_text_keep_their_hits(frame, items):
    long, bench = "x one two three four five six seven eight nine ten y", [(1, "one two three four five six seven eight nine ten"), (2, "p q r"), (3, "s t")]
    rows = [(1, long), (1, long), (2, "p q r"), (2, "p q r"), (2, "p q r"), (3, "s t"), (3, "s t"), (4, "clean")]
    got = decontam.decontaminate(frame(rows), items(bench)).select(*COLS).collect()
    assert Counter(map(tuple, got)) == brute(rows, bench) and sum(r.contaminated for r in got) == 7
    assert [r.doc_id for r in decontam.keep_clean(frame(rows), items(bench)).collect()] == [4]
