import inspect

import numpy as np

from lexhaul.llm import lm
from lexhaul.llm.common import Scratch


def test_training_takes_two_rounds_by_default(frame, corpus):
    """The second round sees other places of the texts, so it changes the network."""
    docs = frame([r for r in corpus if r[0] == 505])
    words = lm.vocabulary(lm.word_counts(docs, "text", Scratch(docs.sparkSession)))
    once, twice, default = (lm.train(docs, words, "text", *r).flat() for r in ((1,), (2,), ()))
    assert np.array_equal(default, twice) and not np.array_equal(default, once)
    assert inspect.signature(lm.pseudo_likelihood).parameters["rounds"].default == 2


def fitted(docs):
    counts = lm.word_counts(docs, "text", Scratch(docs.sparkSession))
    words = lm.vocabulary(counts)
    return counts, words, lm.train(docs, words)


def naive(text, n, net, own, totals):
    """Sum of log P(class | three tokens on both sides) + log P(word | class), token by token."""
    found = lm.tokens_of(text or "")
    kinds = [own.get(w, lm.shared_class(w)) for w in found]
    out = 0.0
    for k, w in enumerate(found):
        h = net.hidden_bias.astype(float)
        for t, d in enumerate(x for x in range(-lm.SIDE, lm.SIDE + 1) if x):
            h = h + net.tables[t][kinds[k + d] if 0 <= k + d < len(found) else lm.EDGE]
        s = np.tanh(h) @ net.out.astype(float) + net.out_bias
        out += s[kinds[k]] - s.max() - np.log(np.exp(s - s.max()).sum()) + np.log(n[w]) - np.log(totals[kinds[k]] + 1)
    return len(found), out


def test_scores_equal_a_naive_computation_whatever_words_are_held(frame, corpus):
    rows = [(i, (t or "")[:3000] or t) for i, t in corpus]
    docs = frame(rows)
    counts, words, net = fitted(docs)
    n = {bytes(r.word): r.n for r in counts.collect()}
    ranked = sorted(n, key=lambda w: (-n[w], w))
    assert words.own == {w: k for k, w in enumerate(ranked[: lm.OWN])}
    want = sorted((str(i), *naive(t, n, net, words.own, words.totals)) for i, t in rows)
    for most in (0, 10, 50_000):
        held = lm.vocabulary(counts, most)
        assert len(held.counts) <= most + 5 and np.array_equal(held.totals, words.totals)
        got = sorted((str(r.doc_id), r.n_tokens, r.log_prob) for r in lm.score(docs, held, net, counts).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-4, atol=1e-2)


def test_many_words_of_one_count_have_no_cliff(frame, spark):
    """49 words of one count or 51 with room for 50: all count by their own counts in both."""
    for k in (49, 51):
        docs = frame([(0, " ".join(f"w{j:02d}" for j in range(k)))])
        counts, _, net = fitted(docs)
        scores = [lm.score(docs, lm.vocabulary(counts, most), net, counts).first()["log_prob"] for most in (50, 10**6)]
        assert np.isclose(*scores, rtol=1e-5)


def test_words_that_no_document_holds_and_odd_rows(frame):
    docs = frame([(1, "a b c d e f g a b"), (1, "a b c d e f g a b"), (None, None), (2, " \n")])
    counts, words, net = fitted(docs)
    got = sorted((str(r.doc_id), r.n_tokens, r.log_prob, r.per_token) for r in lm.score(frame([(1, "a b unseen"), (None, ""), (1, "a b unseen")]), words, net, counts).collect())
    assert got[0] == got[1] and got[0][1] == 3 and np.isfinite(got[0][2]) and got[2] == ("None", 0, 0.0, None)
    empty = frame([])
    assert lm.pseudo_likelihood(empty).count() == 0 and lm.perplexity(lm.pseudo_likelihood(empty)) == float("inf")


def test_context_lowers_the_perplexity_of_unseen_documents(frame):
    """Documents of two languages; those held out are told apart by what stands around a word."""
    r = np.random.default_rng(3)
    lists = [[f"{a}{k}{a}" for k in range(40)] for a in "xy"]
    rows = [(i, " ".join(r.choice(lists[i % 2], 200))) for i in range(2400)]
    counts, words, net = fitted(frame(rows[:2000]))
    seen, flat = (lm.perplexity(lm.score(frame(rows[2000:]), words, n, counts)) for n in (net, lm.unigram(words)))
    assert seen < 0.8 * flat


def test_every_token_is_a_target_in_exactly_one_round():
    """Of texts of any length, also those shorter than a stretch, with the classes around each."""
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 63, 64, 65, 300, 5000):
        kinds = r.integers(0, lm.EDGE, n).astype(np.uint8)
        padded = np.concatenate([[lm.EDGE] * lm.SIDE, kinds, [lm.EDGE] * lm.SIDE])
        for rounds in (1, 2, 3):
            windows = [tuple(p[k : k + 2 * lm.SIDE + 1]) for number in range(rounds) for p in lm.pieces(kinds, rounds, number, 64) for k in range(len(p) - 2 * lm.SIDE)]
            assert sorted(windows) == sorted(tuple(padded[k : k + 2 * lm.SIDE + 1]) for k in range(n))


def test_training_sees_every_token_of_short_and_long_texts(frame, monkeypatch):
    """Tokens that train() gets in all rounds together, against the tokens of the texts."""
    seen = []
    real = lm.Network.train
    monkeypatch.setattr(lm.Network, "train", lambda self, padded, where, *how: (seen.append(len(where)), real(self, padded, where, *how))[1])
    texts = ["a b c", "one more short text", "w " * 1000, "", None, "x" * 5000]
    docs = frame(list(enumerate(texts)))
    words = lm.vocabulary(lm.word_counts(docs, "text", Scratch(docs.sparkSession)))

    def run_here(df, run, shape):
        list(run(iter(df.toArrow().to_batches())))
        return df.sparkSession.createDataFrame([], shape)

    encoded = lm.encode(docs, words, Scratch(docs.sparkSession))
    monkeypatch.setattr(lm, "map_arrow", run_here)
    lm.train_encoded(encoded, words)
    assert sum(seen) == sum(len(lm.tokens_of(t or "")) for t in texts)
