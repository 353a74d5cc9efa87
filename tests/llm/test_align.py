"""The alignment of two tokenizers against a plain walk over byte offsets."""

import hashlib
import json
from collections import Counter

import pytest

from lexhaul.llm import align
from lexhaul.llm.queries import tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [
    "plain words, and  two  spaces", " leading", "trailing ", "  ", " ", "\n", "a\n b\t c\r\n  d", "don't you'll 12345 3.14159", "Größe naïve façade ﬁ Ａ", "日本語のテキスト", "emoji 😀😃 👩‍👩‍👧 x", "▁ marks ▁▁ of its own",
    "<|endoftext|> and <s> and </s> <unk> <0x0A>", "nul\0 byte", "é ́x", " nbsp  em  line", "x" * 5000, "ab " * 3000, "=" * 700, "\x1c \x1d a", "http://example.com/a?b=c&d=%20#e", None, "",
]


def naive(rows):
    """All of the contract's columns, by whole texts and every pair of tokens."""
    both = align.Encoders(tokenizer_path(A), tokenizer_path(B), False)
    docs, pairs = [], Counter()
    for i, text in rows:
        groups, found = [], []
        if text:
            a, b = both.a(" " + text), both.b.encode(text)
            x, y = [both.a_bytes[t] for t in a], [both.b_bytes[t] for t in b]
            if b"".join(x) == b"".join(y) == (" " + text).encode():
                spans = []
                for ids, parts in ((a, x), (b, y)):
                    at, own = 0, []
                    for t, p in zip(ids, parts, strict=True):
                        own.append((t, at, at + len(p)))
                        at += len(p)
                    spans.append(own)
                ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
                begin, at = 0, [0, 0]
                for end in ends:
                    sides = []
                    for s in range(2):
                        own = []
                        while at[s] < len(spans[s]) and spans[s][at[s]][2] <= end:
                            own.append(spans[s][at[s]])
                            at[s] += 1
                        sides.append(own)
                    groups.append(f"{','.join(str(t) for t, _, _ in sides[0])}|{','.join(str(t) for t, _, _ in sides[1])}")
                    found += [(t, u) for t, f, g in sides[0] for u, h, k in sides[1] if f < k and h < g]
                    begin = end
                assert begin == len((" " + text).encode())
        n = (len(a), len(b)) if groups else (0, 0)
        docs.append((i, *n, groups, found))
        pairs.update(found)
    most = Counter()
    for (_, u), n in pairs.items():
        most[u] = max(most[u], n)
    out = [(i, a, b, len(g), len(f), sum(pairs[p] == most[p[1]] for p in f), sum(pairs[p] for p in f), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, a, b, g, f in docs]
    return sorted(out, key=str), pairs, Counter(g for *_, gs, _ in docs for g in gs)


def got(found):
    return sorted((tuple(r) for r in found.documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


@pytest.mark.parametrize("hot", [100_000, 40, 0])
def test_documents_equal_a_plain_walk(frame, corpus, hot, monkeypatch):
    """Also where frequent groups are not broadcast, and where a document's groups need several rows."""
    monkeypatch.setattr(align, "RUN", 50)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(1000 + (i or 0), t) for i, t in corpus if t is None or len(t) < 30_000] + [(None, "a b"), (3, "a b")]
    want, pairs, groups = naive(rows)
    found = align.align(frame(rows), tokenizer_path(A), tokenizer_path(B), hot=hot)
    assert got(found) == want
    assert {(r.a, r.b): r.links for r in found.pairs.collect()} == pairs
    assert {r.group: r.n for r in found.dictionary.collect()} == groups


def test_empty_table_and_texts_without_tokens(frame):
    assert got(align.align(frame([]), tokenizer_path(A), tokenizer_path(B))) == []
    rows = [(1, None), (2, ""), (3, "▁x")]
    assert got(align.align(frame(rows), tokenizer_path(A), tokenizer_path(B))) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_both_ways_of_merging_give_the_same_ids(corpus, tmp_path):
    slow, fast = (align.Encoders(tokenizer_path(A), tokenizer_path(B), x) for x in (False, True))
    assert align.merges_by_rank(tokenizer_path(A))
    for t in [*ODD, *(t for _, t in corpus), *(f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}\n{chr(c)} " for c in range(1, 0x3100))]:
        assert slow.a(t or "") == fast.a(t or "")
    found = json.loads(open(tokenizer_path(A)).read())
    found["model"]["merges"][300:302] = found["model"]["merges"][301:299:-1]
    (tmp_path / "other.json").write_text(json.dumps(found))
    assert not align.merges_by_rank(str(tmp_path / "other.json"))


def test_texts_of_a_batch_do_not_meet(corpus):
    one = align.Interner(align.Encoders(tokenizer_path(A), tokenizer_path(B), True))
    texts = [t or "" for t in [*ODD, *(t for _, t in corpus)]]
    together = one(texts)
    for t, (n_a, n_b, groups) in zip(texts, together, strict=True):
        (x, y, alone), = one([t])
        assert (n_a, n_b, groups.tolist()) == (x, y, alone.tolist())
    assert one([]) == [] and len(set(one.names)) == len(one.names)
