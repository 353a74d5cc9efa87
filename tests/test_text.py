import pytest
from pyspark.sql import functions as F

from lexhaul.functions import text as T


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()] or ["id"]).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []), ("   ", []), ("Ein Satz ohne Ende", ["Ein Satz ohne Ende"]), ("Erster Satz. Zweiter Satz.", ["Erster Satz.", "Zweiter Satz."]),
        ("Siehe Abs. 3 und Nr. 4.", ["Siehe Abs. 3 und Nr. 4."]), ("Fällig am 1. Januar. Danach nicht.", ["Fällig am 1. Januar.", "Danach nicht."]),
        ("Von J. Öztürk. Ende!", ["Von J. Öztürk.", "Ende!"]), ("Nach Satz 1. Danach weiter.", ["Nach Satz 1. Danach weiter."]), ("klein. weiter. Groß", ["klein. weiter.", "Groß"]),
    ],
)
def test_sentences(spark, text, want):
    assert one(spark, T.sentences(F.col("t")), t=text) == want


def test_token_estimate_has_a_floor_of_one(spark):
    assert [one(spark, T.estimate_tokens(F.col("t")), t=t) for t in ("", "abc", "x" * 32, "ä" * 33)] == [1, 1, 10, 10]


@pytest.mark.parametrize(("chars", "image", "want"), [(99, 100_000, "scan"), (99, 5_000, "sparse"), (100, 100_000, "text"), (100, 0, "text")])
def test_page_status_bounds(spark, chars, image, want):
    assert one(spark, T.page_status(F.col("t"), F.col("p")), t=f"  {'x' * chars}\n", p=image) == want


def test_page_of_replacement_characters(spark):
    assert [one(spark, T.page_status(F.col("t"), F.col("p")), t="�" * 200, p=p) for p in (0, 200_000)] == ["error", "scan"]


def test_headings_and_citations(spark):
    path, none = F.array(F.lit("A"), F.lit("B")), F.array().cast("array<string>")
    assert one(spark, T.embed_text(F.lit("t"), path)) == "A > B\n\nt"
    assert one(spark, T.embed_text(F.lit("t"), none)) == "t"
    assert one(spark, T.citation(F.lit("/x/y.tar.gz"), none)) == "y.tar.gz"
    assert one(spark, T.citation(F.lit("/x/y.md"), path)) == "y.md — A > B"
    assert [one(spark, T.document_key(F.lit(p))) for p in ("/x/y.tar.gz", "/x/.hidden", "plain")] == ["y.tar", ".hidden", "plain"]


def test_citations_of_answers(spark):
    assert one(spark, T.cited_numbers(F.lit("[3] x [1] [oben] [3]"))) == [1, 3]
    assert one(spark, T.uncited(F.array(F.lit(1), F.lit(2)), F.lit("nur [2]"))) == [1]


@pytest.mark.parametrize(("reply", "allow", "want"), [("QUELLEN_REICHEN", True, (True, "q")), (" quellen_reichen\n", True, (True, "q")), ("QUELLEN_REICHEN", False, (False, "q")), (" neue Suche ", True, (False, "neue Suche")), (" \n ", True, (False, "q"))])
def test_routes(spark, reply, allow, want):
    assert tuple(one(spark, T.parse_route(F.lit(reply), F.lit("q"), F.lit(allow)))) == want


@pytest.mark.parametrize(("value", "want"), [("32k", 32768), ("8K", 8192), ("4096", 4096), ("1.5k", 1536), (65536, 65536)])
def test_context_length(spark, value, want):
    assert one(spark, T.context_length(F.lit(value))) == want


def test_answers(spark):
    needles = F.array(F.lit("14 Tage"))
    assert one(spark, T.answered_correctly(F.lit("Es sind 14 Tage [1]."), needles))
    assert not one(spark, T.answered_correctly(F.lit("14 Tage? Das steht nicht darin."), needles))
    assert not one(spark, T.contains_all(F.lit("14 Tage"), F.array().cast("array<string>")))


def test_pages(spark):
    pages = F.array(F.lit(" a "), F.lit(" "), F.lit("bc"))
    assert one(spark, T.document_text(pages)) == " a \n\nbc" and one(spark, T.char_count(pages)) == 3
    assert one(spark, T.ocr_ratio(F.array(F.lit("scan"), F.lit("text")))) == 0.5
    assert one(spark, T.tokens_per_second(F.lit(10), F.lit(0.0))) == 0.0


def test_zero_vector_has_no_direction(spark):
    assert one(spark, T.l2_normalise(F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, T.l2_normalise(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
