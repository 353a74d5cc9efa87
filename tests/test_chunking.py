import pytest

import random

import pytest
from pyspark.sql import functions as F

from lexhaul.operators import chunking as C


def words(text):
    return max(1, len(text.split()))


def kinds(md):
    return [(b.kind, b.text, b.level) for b in C.blocks(md)]


def test_block_kinds():
    md = "# Titel #\nErste Zeile\nzweite\n\n| a | b |\n|---|---|\n| 1 | 2 |  \n```py\n# kein Titel\n\nx\n```\nEnde"
    assert kinds(md) == [("heading", "Titel", 1), ("prosa", "Erste Zeile\nzweite", 0), ("tabelle", "| a | b |\n|---|---|\n| 1 | 2 |", 0), ("code", "```py\n# kein Titel\n\nx\n```", 0), ("prosa", "Ende", 0)]


def test_unclosed_fence_runs_to_the_end_and_fences_stay_apart():
    assert kinds("~~~\na\n```\n") == [("code", "~~~\na\n```", 0)]
    assert [k for k, _, _ in kinds("```\na\n```\n```\nb\n```")] == ["code", "code"]


def test_blank_and_heading_only_documents_have_no_chunks():
    assert C.chunk("") == [] and C.chunk(" \n \n") == [] and C.chunk("# Nur Titel\n## Noch einer") == []


def test_heading_paths_drop_deeper_levels_and_gaps():
    got = C.chunk("# A\n\nx\n\n### C\n\ny\n\n## B\n\nz", count=words)
    assert [(p.path, p.text) for p in got] == [(["A"], "x"), (["A", "C"], "y"), (["A", "B"], "z")]


def test_prose_splits_at_sentences_and_overlaps():
    s = "Der Vertrag endet nach einer Frist von vierzehn Tagen immer."
    got = C.chunk(" ".join([s] * 20), target=40, overlap=10, count=words)
    assert all(p.text.endswith("immer.") and p.text.startswith("Der") for p in got) and len(got) > 4
    assert all(p.tokens <= 40 for p in got[:-1])  # a short rest joins the last
    assert got[1].text.split("\n\n")[0] == s


def test_one_sentence_over_the_limit_stays_whole():
    long = " ".join(["wort"] * 100) + "."
    assert [p.text for p in C.chunk(long, target=50, count=words)] == [long]


def test_table_parts_repeat_the_head():
    md = "| k | v |\n|---|---|\n" + "\n".join(f"| {i} | w |" for i in range(40))
    got = C.chunk(md, target=60, count=words)
    assert len(got) > 1 and all(p.kind == "tabelle" and p.text.startswith("| k | v |\n|---|---|\n") for p in got)
    assert sum(p.text.count("| w |") for p in got) == 40


def test_short_rest_joins_the_previous_chunk():
    s = " ".join(["wort"] * 39) + "."
    got = C.chunk(f"# T\n\n{s}\n\n{s}\n\nKurz.", target=41, overlap=0, count=words)
    assert [p.text.count("Kurz") for p in got] == [0, 1] and got[1].tokens == 41


def test_mixed_kinds_count_as_prose():
    assert C.chunk("Text.\n\n| a |\n|---|\n| 1 |", count=words)[0].kind == "prosa"


@pytest.mark.parametrize(("text", "budget", "want"), [("Eins zwei. Drei vier. Fünf sechs.", 4, "Drei vier. Fünf sechs."), ("Eins zwei drei vier fünf.", 2, "Eins zwei drei vier fünf."), ("A b.", 0, "")])
def test_overlap_tail(text, budget, want):
    assert C.tail(text, budget, words) == want


def test_documents_and_built_in_sentences_agree(spark):
    rows = [(1, "Eins. Zwei z.B. Drei: Vier."), (2, None), (3, ""), (4, "# A\n\nText hier.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.ordinal, r.heading_path) for r in C.chunk_documents(df, "doc_id", "text").collect()) == [(1, 0, []), (4, 0, ["A"])]
    got = {}
    for r in C.sentence_rows(df, "doc_id", "text").orderBy("pos").collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    assert got == {i: C.sentences(t) for i, t in rows if t}


def test_prose_chunks_equal_the_walk(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choices("abdeilmnorst", k=r.randint(1, 9)))
    sentence = lambda: " ".join(word() for _ in range(r.randint(1, 40))).capitalize() + r.choice([".", "!", " z.B.", " 3.", ":"])
    para = lambda: r.choice([" ", "\n", "  "]).join(sentence() for _ in range(r.randint(1, 12)))
    texts = [r.choice(["", "\n\n", " \r\n"]) + r.choice(["\n\n", "\n \t\n", "\r\n\r\n", "\x0b\n"]).join(para() for _ in range(r.randint(1, 9))) for _ in range(80)] + ["", " ", "\n", None, "x" * 9000, "A. B. C.", "Kurz.\n\n" + "Wort " * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for target, overlap in ((512, 64), (60, 10), (40, 0), (100, 90)):
        got = {}
        for x in C.chunk_prose(df, "doc_id", "text", target, overlap).orderBy("doc_id", "ordinal").collect():
            got.setdefault(x.doc_id, []).append((x.ordinal, x.text, x.token_count))
        for i, t in enumerate(texts):
            assert got.get(i, []) == [(k, p.text, p.tokens) for k, p in enumerate(C.chunk(t or "", target, overlap))], (i, target)


def test_the_table_function_equals_the_operator_and_checks_its_arguments(spark):
    df = spark.createDataFrame([(1, "# A\n\nText."), (2, None), (3, "| a |\n|-|\n| 1 |\n\n```\nx\n```")], "doc_id long, text string")
    C.register(spark)
    got = spark.sql("SELECT doc_id, c.* FROM {d} d, LATERAL markdown_chunks(d.text) c", d=df)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, C.chunk_documents(df, "doc_id", "text").select(got.columns).collect()), key=str)
    for bad in ("1", "text, 0", "text, 64, -1", "text, 'a'"):
        with pytest.raises(Exception, match="markdown_chunks"):
            spark.sql(f"SELECT c.* FROM {{d}} d, LATERAL markdown_chunks({bad}) c", d=df.withColumn("text", F.col("text"))).collect()
