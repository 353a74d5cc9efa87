import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, _h long, a long, b long, word string, bucket long, keep_id string, _gone long, _doc long, _doc2 long, _text long, kept boolean"


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of (id, text) or (id, text, lang) as documents with null and clashing extra columns."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, "x", 1, 2, None, "w", 3, "k", 4, 5, 6, 7, True) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Invented prose with exact and near copies, shared passages, empty, null, blank and very long texts, repeated ids and rows."""
    r = random.Random(5)
    words = ["".join(r.choices(["ba", "do", "ri", "sen", "lu", "ka"], k=r.randint(1, 3))) for _ in range(160)]
    text = lambda n: " ".join(r.choices(words, k=n))
    base = [text(r.randint(3, 160)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(12):  # near copies: a few words change
        w = base[k].split()
        for _ in range(max(1, len(w) // r.choice([60, 40, 20]))):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, base[20]) for k in range(15)]  # many exact copies
    passage = text(60)
    rows += [(300 + k, f"{text(30)} {passage} {text(40)}") for k in range(6)]
    many = text(90).split()
    for k in range(14):  # a large group of near copies
        w = list(many)
        w[3 + 6 * k % 80] = f"anders{k}"
        rows.append((400 + k, " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "ba"), (504, "BA"), (505, text(20_000)), (None, "ba do ri sen lu ka"), (None, None), (0, base[0]), (506, "Ä É ba do"), (507, "x" * 50_000)]
    return rows
