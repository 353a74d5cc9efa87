"""Scalar text functions as column expressions. Ids in brackets name the operator of the survey."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a regex class, spelled out because engines disagree on \s.
WS = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same characters as a string.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: A code point that never occurs in text, to join and split on.
MARK = "﷐"
CHARS_PER_TOKEN = 3.2
#: Replacement and control characters, line breaks and tabs apart.
ODD = r"[\x{FFFD}\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]"

# Words that end in a full stop without ending a sentence, and phrases that admit ignorance.
ABBREVIATIONS = (
    "z.b. d.h. u.a. u.ä. o.ä. bzw. ca. ggf. evtl. inkl. exkl. zzgl. abzgl. vgl. bspw. insb. sog. abs. art. nr. bd. kap. abb. tab. ziff. lit. "
    "buchst. az. bzgl. gem. dr. prof. hr. fr. dipl. ing. st. mio. mrd. tsd. mind. max. zzt. usw. etc. "
    "jan. feb. mär. apr. jun. jul. aug. sep. okt. nov. dez."
).split()
IGNORANCE = ("nicht angegeben", "nicht enthalten", "keine angabe", "nicht hervor", "nicht genannt", "steht nicht", "liegen keine", "nicht ersichtlich", "keine information", "lässt sich nicht", "nicht beantwort")


def let(value: Column, use) -> Column:
    """use(value) with `value` computed once: inside a lambda an outer expression would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends; looks at the ends only, where a regex would try every character of the text."""
    return F.btrim(text, F.lit(SPACES))


def tokens_of_length(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars / F.lit(CHARS_PER_TOKEN)).cast("int"))


def estimate_tokens(text: Column) -> Column:
    """At least 1."""
    return tokens_of_length(F.char_length(text))


def heading(path: Column) -> Column:
    """[F2]"""
    return F.array_join(path, " > ")


def embed_text(text: Column, path: Column) -> Column:
    """Text under its heading path."""
    return F.when(F.size(path) > 0, F.concat(heading(path), F.lit("\n\n"), text)).otherwise(text)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def citation(path: Column, headings: Column) -> Column:
    """File name, and the heading path if there is one."""
    return F.when(F.size(headings) > 0, F.concat(basename(path), F.lit(" — "), heading(headings))).otherwise(basename(path))


def document_key(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def similarity(distance: Column) -> Column:
    """[F6]"""
    return 1 - distance


def hit_score(rerank_score: Column, distance: Column) -> Column:
    """[F7]"""
    return F.coalesce(rerank_score, similarity(distance))


def replacement_ratio(text: Column) -> Column:
    """Share of replacement and control characters (line breaks and tabs apart) in the stripped text."""
    s = strip(text)
    n = F.char_length(s)
    return F.when(n == 0, F.lit(0.0)).otherwise((n - F.char_length(F.regexp_replace(s, ODD, ""))) / n)


def page_status(text: Column, image_pixels: Column, min_chars: int = 100, min_pixels: int = 100_000, max_ratio: float = 0.15) -> Column:
    """[P1, F10] text, scan, sparse or error."""
    image = image_pixels >= min_pixels
    return (
        F.when(F.char_length(strip(text)) < min_chars, F.when(image, "scan").otherwise("sparse"))
        .when(replacement_ratio(text) > max_ratio, F.when(image, "scan").otherwise("error"))
        .otherwise("text")
    )


def needs_ocr(status: Column, ocr_applied: Column) -> Column:
    """[P2]"""
    return (status == "scan") & ~ocr_applied


def cited_numbers(answer: Column) -> Column:
    """[F11, A9] Distinct n of [n], ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), 1), lambda x: x.cast("int"))))


def cited_sources(answer: Column) -> Column:
    """[E9] How many different sources an answer cites."""
    return F.size(cited_numbers(answer))


def uncited(numbers: Column, answer: Column) -> Column:
    """Source numbers that an answer does not cite."""
    return let(cited_numbers(answer), lambda c: F.filter(numbers, lambda n: ~F.array_contains(c, n)))


def tokens_per_second(tokens: Column, seconds: Column) -> Column:
    """[F13]"""
    return F.when((tokens == 0) | (seconds == 0), F.lit(0.0)).otherwise(tokens / seconds)


def admitted_ignorance(answer: Column) -> Column:
    """[F14]"""
    return let(F.lower(answer), lambda low: F.exists(F.array(*[F.lit(m) for m in IGNORANCE]), lambda m: F.contains(low, m)))


def contains_all(answer: Column, needles: Column) -> Column:
    """False without needles."""
    return (F.size(needles) > 0) & F.forall(needles, lambda n: F.contains(answer, n))


def answered_correctly(answer: Column, needles: Column) -> Column:
    """[F16]"""
    return contains_all(answer, needles) & ~admitted_ignorance(answer)


def render_source(number: Column, cite: Column, text: Column) -> Column:
    """[F17]"""
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), cite, F.lit("\n"), text)


def context_length(value: Column) -> Column:
    """"32k" is 32768."""
    v = F.lower(strip(value.cast("string")))
    return F.when(v.endswith("k"), F.floor(F.substring_index(v, "k", 1).cast("double") * 1024)).otherwise(v.try_cast("bigint")).cast("long")


def parse_route(reply: Column, question: Column, allow_reuse: Column, marker: str = "QUELLEN_REICHEN") -> Column:
    """struct<reuse, query>."""
    clean = strip(reply)
    marked = F.startswith(F.upper(clean), F.lit(marker))
    return F.struct((marked & allow_reuse).alias("reuse"), F.when(marked | (clean == ""), question).otherwise(clean).alias("query"))


def ocr_ratio(statuses: Column) -> Column:
    """[F20]"""
    return F.when(F.size(statuses) == 0, F.lit(0.0)).otherwise(F.size(F.filter(statuses, lambda s: s == "scan")) / F.size(statuses))


def document_text(pages: Column) -> Column:
    """[F21]"""
    return F.array_join(F.filter(pages, lambda p: strip(p) != ""), "\n\n")


def char_count(pages: Column) -> Column:
    """[F21]"""
    return F.aggregate(pages, F.lit(0), lambda a, p: a + F.char_length(strip(p)))


def hash_embed(text: Column, dim: int = 8) -> Column:
    """A deterministic stand-in embedder: bytes of the SHA-256, shifted off zero, L2-normalised."""
    raw = lambda digest: F.array(*[F.conv(F.substr(digest, F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("double") / 255 + 0.01 for i in range(dim)])
    return l2_normalise(let(F.sha2(text, 256), raw))


def l2_normalise(v: Column) -> Column:
    """[V9] Null for a zero vector."""
    norm = lambda d: F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    scaled = lambda d: let(norm(d), lambda n: F.when(n > 0, F.transform(d, lambda x: x / n)))
    return let(F.transform(v, lambda x: x.cast("double")), scaled)


def ends_mid_sentence(piece: Column) -> Column:
    """[C3] The last word is an abbreviation, an ordinal or an initial."""
    tail = lambda back: let(F.regexp_extract(back, f"^[{WS}]*([^{WS}]+)", 1), lambda w: w.isin(*[a[::-1] for a in ABBREVIATIONS]) | F.regexp_like(w, F.lit(r"^\.(?:[\p{Nd}.]+|[a-zäöü])$")))
    return let(F.reverse(F.lower(piece)), tail)  # read from its end, so that only the last word is looked at


def sentences(text: Column) -> Column:
    """[C2] Rough split after closing punctuation; pieces that end mid-sentence are joined to the next by one space."""
    rough = F.split(text, rf'(?<=[.!?:])[{WS}]+(?=[A-ZÄÖÜ“„"(\p{{Nd}}])')
    joint = lambda r: F.transform(r, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.when(ends_mid_sentence(F.get(r, i - 1)), " ").otherwise(MARK), p)))
    glued = F.array_join(let(rough, joint), "")
    return F.when(F.regexp_like(text, F.lit(f"[^{WS}]")), F.split(glued, MARK)).otherwise(F.array().cast("array<string>"))
