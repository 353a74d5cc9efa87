"""Recall of repeated passages against what was planted: a smaller document that shares a fragment must not hide a repeat."""

import random

import pytest

from lexhaul.llm import windows


def planted(n, change, fragment, seed):
    """n times: A holds `fragment` words of a passage of 50 that B holds, and C with `change` words of it replaced."""
    r = random.Random(seed)
    fresh = iter(range(10**9))
    words = lambda k: [f"q{next(fresh)}" for _ in range(k)]
    rows, want = [], []
    for t in range(n):
        passage, at = words(50), r.randrange(51 - fragment) if fragment else 0
        other = list(passage)
        for k in r.sample(range(5, 45), change):  # a passage begins and ends with shingles that both have
            other[k] = f"z{next(fresh)}"
        if fragment:
            rows.append((3 * t, " ".join([*words(60), *passage[at : at + fragment], *words(60)])))
        rows += [(3 * t + 1, " ".join([*words(60), *passage, *words(60)])), (3 * t + 2, " ".join([*words(60), *other, *words(60)]))]
        want += [3 * t + 1, 3 * t + 2]
    return rows, set(want)


@pytest.mark.parametrize(("change", "fragment", "least"), [(0, 0, 1.0), (0, 30, 1.0), (0, 49, 1.0), (1, 0, 0.9), (1, 30, 0.9)])
def test_recall_of_planted_passages(frame, change, fragment, least):
    rows, want = planted(300, change, fragment, 3)
    got = {r.doc_id for r in windows.repeated_passages(frame(rows)).select("doc_id").collect()}
    assert got <= want
    assert len(got) >= least * len(want)


@pytest.mark.parametrize("crowd", [0, 500, 4000])
def test_a_line_that_many_hold_hides_no_pair(frame, crowd):
    """Each pair shares a line of 28 words, the same in all pairs and in a crowd of others, and 26 words of its own, one of them changed."""
    r, fresh = random.Random(9), iter(range(10**9))
    words = lambda k: [f"q{next(fresh)}" for _ in range(k)]
    line, rows = words(28), []
    for t in range(150):
        own = words(26)
        other = list(own)
        other[r.randrange(5, 21)] = f"z{t}"
        rows += [(10_000 + 2 * t + k, " ".join([*words(40), *line, *x, *words(40)])) for k, x in enumerate((own, other))]
    rows += [(20_000 + k, " ".join([*words(30), *line, *words(30)])) for k in range(crowd)]
    got = {x.doc_id for x in windows.repeated_passages(frame(rows)).select("doc_id").collect()}
    assert got <= set(range(10_000, 10_300)) and len(got) >= (300 if crowd == 0 else 285)
