import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexhaul.llm import exact_dedup, jaccard, windows

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def norm(t):
    return (t or "").translate({ord(c): None for c in " \t\n\r\x0b\x0c"})


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return Counter(out)


EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_dedup(frame, corpus):
    rows = [*corpus, (900, "ba  do"), (901, "ba do"), (902, "bado"), (903, "a b"), (904, "a b")]
    assert Counter(map(tuple, exact_dedup.exact_dedup(frame(rows)).select(*EXACT).collect())) == brute_exact(rows)


def test_exact_dedup_survives_hash_collisions(frame, corpus):
    got = exact_dedup.exact_dedup(frame(corpus), content_hash=lambda t: F.substring(F.md5(t), 1, 1))
    assert Counter(map(tuple, got.select(*EXACT).collect())) == brute_exact(corpus)


def test_exact_keep_first(frame, corpus):
    want = brute_exact(corpus)
    kept = exact_dedup.keep_first(frame(corpus))
    assert kept.columns == frame([]).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i: n for i, n in Counter(k[0] for k in want.elements() if k[3]).items()})


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, None)], [(1, "x"), (1, "x")]])
def test_small_tables(frame, rows):
    n = len(rows)
    assert exact_dedup.exact_dedup(frame(rows)).count() == n
    assert jaccard.jaccard_classes(frame(rows)).count() == n
    assert windows.repeated_passages(frame(rows)).count() == 0


def brute_classes(rows):
    sets, parent = [], {}
    for i, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return Counter((i, len(s), root(i) if i is not None else None) for i, s in sets)


@pytest.mark.parametrize("short", [8, 2])
def test_jaccard_classes(frame, corpus, short, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT", short)  # 2: nearly all lists take the path of long ones
    got = jaccard.jaccard_classes(frame(corpus)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute_classes(corpus)


def test_jaccard_links_at_the_bound_and_chains(frame):
    words = [f"w{k}" for k in range(40)]
    rows = [(9, " ".join(words[:16])), (3, " ".join(words[1:18])), (5, " ".join(words[2:19])), (7, " ".join(words[4:21]))]
    assert Counter(map(tuple, jaccard.jaccard_classes(frame(rows)).select("doc_id", "n_shingles", "component_id").collect())) == brute_classes(rows)


def test_skipped_blocks_hold_no_candidate():
    r = np.random.default_rng(0)
    for _ in range(20):
        n = np.sort(r.integers(5, 60, int(r.integers(1, 300))))
        rest = n - np.minimum(r.integers(0, 10, len(n)), n - 1)
        blocks = jaccard.Blocks(n, rest, 75, 100)
        for i in range(len(n)):
            ok = lambda j, i=i: set(j[jaccard.may_link(n[j], rest[j], n[i], rest[i], 75, 100)].tolist())
            assert ok(blocks.after(i)) == ok(np.arange(i + 1, len(n)))


def test_one_id_with_several_sets(frame, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT", 1)
    w = [f"w{k}" for k in range(60)]
    near = [(10 + k, " ".join([*w[:20], f"z{k}", *w[21:]])) for k in range(6)]
    rows = [*near, (5, " ".join(f"q{k}" for k in range(30))), (5, " ".join([*w[:40], "y", *w[41:]])), (4, " ".join(f"q{k}" for k in range(29)))]
    assert Counter(map(tuple, jaccard.jaccard_classes(frame(rows)).select("doc_id", "n_shingles", "component_id").collect())) == brute_classes(rows)


def test_keep_first_of_class(frame, corpus):
    want = brute_classes(corpus)
    kept = jaccard.keep_first_of_class(frame(corpus))
    assert kept.columns == frame([]).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k[0] for k in want.elements() if k[0] == k[2])


def naive_windows(h, width):
    out = set()
    for c in np.flatnonzero(h):
        left = right = int(c)
        while left and h[left - 1] > h[c]:
            left -= 1
        while right + 1 < len(h) and h[right + 1] >= h[c]:
            right += 1
        if right - left + 1 >= width:
            out.add((int(c), left, right))
    return out


def test_compact_windows_are_the_wide_nodes_of_the_tree():
    r = np.random.default_rng(1)
    for _ in range(200):
        h = r.integers(1, 30, r.integers(0, 60)).astype(np.uint64)
        h[r.random(len(h)) < 0.05] = 0
        width = int(r.integers(1, 9))
        assert set(zip(*(x.tolist() for x in windows.compact_windows(h, width)), strict=True)) == naive_windows(h, width)


def test_every_passage_lies_in_one_window_of_its_minimum():
    h = np.random.default_rng(2).permutation(300).astype(np.uint64) + np.uint64(1)
    found = list(zip(*(x.tolist() for x in windows.compact_windows(h, 20)), strict=True))
    for i in range(0, 280, 7):
        for j in range(i + 19, 300, 31):
            c = i + int(h[i : j + 1].argmin())
            assert sum(a == c and left <= i and j <= right for a, left, right in found) == 1


def test_repeated_passages(frame, corpus):
    grams = defaultdict(set)
    for i, t in corpus:
        w = (t or "").encode().translate(LOWER).split()
        for k in range(len(w) - 49):
            grams[tuple(w[k : k + 50])].add(i)
    exact = {i for s in grams.values() if len(s) > 1 for i in s}
    got = {r.doc_id: r for r in windows.repeated_passages(frame(corpus)).collect()}
    assert exact <= set(got)
    assert set(range(300, 306)) <= set(got) and got[303].first_doc_id == 300
    assert any(s.f <= 30 and s.l >= 89 for s in got[303].spans)
    unrelated = {i for i in range(13, 60) if i != 20}
    assert not unrelated & set(got)
    assert all(r.repeated_words == sum(s.l - s.f + 1 for s in r.spans) and r.n_spans == len(r.spans) for r in got.values())


def test_near_passage_is_found_and_a_short_one_is_not(frame):
    w = [f"v{k}" for k in range(400)]
    near = [*w[100:130], "anders", *w[131:170]]
    rows = [(1, " ".join(w[:200])), (2, " ".join([f"y{k}" for k in range(50)] + near + [f"z{k}" for k in range(50)])), (3, " ".join(w[0:45] + [f"q{k}" for k in range(80)]))]
    got = {r.doc_id: r for r in windows.repeated_passages(frame(rows)).collect()}
    assert set(got) == {1, 2} and got[2].spans[0].f == 50


def test_a_part_held_by_smaller_ids_does_not_hide_a_repeat(frame):
    """Documents 1 to 40 hold 45 of the 60 words and take every signature's lead; only 50 and 51 hold all."""
    w = [f"v{k}" for k in range(60)]
    around = lambda part, i: " ".join([f"a{i}x{k}" for k in range(60)] + part + [f"b{i}x{k}" for k in range(60)])
    rows = [(i, around(w[:45] if i % 2 else w[15:], i)) for i in range(1, 41)] + [(50, around(w, 50)), (51, around(w, 51))]
    got = {r.doc_id: r for r in windows.repeated_passages(frame(rows)).collect()}
    assert got[50].first_doc_id == got[51].first_doc_id == 50
    assert all((r.spans[0].f, r.spans[0].l) == (60, 119) for r in (got[50], got[51]))


def test_windows_beyond_the_lead_stay():
    """Extents before and after the minimum: 2 does not fit 1, 3 fits 2 only, and a second window of 1 fits 4 only."""
    rec = np.array([(5, d, min(c - l, 45), min(r - c, 45)) for d, c, l, r in [(1, 100, 100, 145), (1, 300, 270, 315), (2, 100, 55, 100), (3, 100, 57, 102), (4, 100, 72, 115)]], windows.ENTRY)
    kept, links = windows.joined(rec, 46)
    assert {(int(x["a"]), int(x["b"])) for x in links} >= {(2, 3), (1, 4)} and len(kept) > 1


def test_different_long_words_do_not_link(frame):
    """The Thue-Morse word and its complement have equal sums under any polynomial hash modulo a power of two."""
    rows = []
    for k, n in enumerate((1024, 2048, 4096)):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        rows += [(2 * k, word), (2 * k + 1, word.translate({97: "b", 98: "a"}))]
    assert Counter(map(tuple, jaccard.jaccard_classes(frame(rows)).select("doc_id", "n_shingles", "component_id").collect())) == Counter((i, 1, i) for i in range(6))


def test_shingles_by_words():
    a = [f"w{k:03d}" for k in range(40)]
    one, other = jaccard.shingle_set(" ".join(a)), jaccard.shingle_set(" ".join([*a[:20], "X000", *a[21:]]))
    assert len(one) == len(other) == 36 and len(one & other) == 31
    assert jaccard.shingle_set("A b") == {(b"a", b"b")}
