"""Surrogates for personal data: keyed, type-consistent replacements, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexhaul.functions.text import let
from lexhaul.llm.common import Scratch, broadcast_if

# What counts as a title and a given name, and their genders. m male, f female, by script.
TITLES = {"m": ["Mr", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "Sir", "г-н"], "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "г-жа"], "n": ["Dr", "Prof"]}
GIVEN = {
    ("latin", "m"): ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Daniel", "Peter", "Hans", "Klaus", "Stefan", "Pierre", "Jean", "Carlos", "Juan"],
    ("latin", "f"): ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Anna", "Julia", "Petra", "Sabine", "Marie", "Claire", "Maria", "Carmen", "Lucia"],
    ("cyrillic", "m"): ["Иван", "Дмитрий", "Сергей", "Алексей", "Николай", "Пётр", "Михаил", "Андрей"],
    ("cyrillic", "f"): ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана"],
    ("greek", "m"): ["Γιώργος", "Νίκος", "Κώστας", "Δημήτρης", "Γιάννης", "Παναγιώτης", "Μιχάλης", "Στέλιος"],
    ("greek", "f"): ["Μαρία", "Ελένη", "Κατερίνα", "Αγγελική", "Σοφία", "Γεωργία", "Ειρήνη", "Βασιλική"],
}
#: What stands before a surname and belongs to it.
PARTICLES = ["von", "van", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "ter", "ten", "bin", "ibn"]
#: What a person's name follows when it is introduced, whatever the name.
CUES = ["my name is", "My name is", "Name is", "ich heiße", "Ich heiße", "ein Name ist", "m'appelle", "me llamo", "Me llamo", "i nombre es", "еня зовут", "Name:", "Nom:", "Nombre:", "Имя:", "Contact:", "Kontakt:", "Signed,", "Regards,"]
SYLLABLES = {
    "latin": ["ba", "den", "fo", "gar", "hel", "ka", "lin", "mor", "ne", "ros", "sal", "ter", "ul", "ven", "wi", "zan"],
    "cyrillic": ["ба", "ден", "во", "гор", "ле", "ка", "лин", "мор", "не", "рос", "сал", "тер", "ул", "вен", "ви", "зан"],
    "greek": ["βα", "δεν", "φο", "γαρ", "ελ", "κα", "λιν", "μορ", "νε", "ρο", "σαλ", "τερ", "ου", "βεν", "πι", "ζαν"],
}
#: Letters of surrogates by script, one for each hexadecimal digit.
ALPHABETS = {"latin": "abdefgiklmnoprst", "cyrillic": "абвгдежзиклмнопр", "greek": "αβγδεζηθικλμνξοπ"}

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: A capitalised word with inner capitals, hyphens and apostrophes, without a genitive's `'s`; with particles before it; given names.
WORD = r"\p{Lu}(?:(?!['’]s(?!\p{L}))['’-]?[\p{L}\p{M}])++(?![\p{N}_])"
SURNAME = rf"(?:(?i:{'|'.join(PARTICLES)}) ){{0,3}}{WORD}"
KNOWN = "|".join(n for g in GIVEN.values() for n in [*g, *(x.upper() for x in g)])
FIRST = rf"(?:\p{{Lu}}[\p{{L}}\p{{M}}]*+-)?(?:{KNOWN})(?:-[\p{{L}}\p{{M}}]++)*+"
TITLED = rf"(?:(?:{'|'.join(t for g in TITLES.values() for t in g)})\.? )++"
MAIL = r"[\p{L}\p{M}\p{N}_.%+-]"
SECRET_NAME = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)"
PATTERNS = {
    "email": rf"(?<!{MAIL}){MAIL}++@(?:[\p{{L}}\p{{M}}\p{{N}}-]{{1,63}}\.){{1,126}}\p{{L}}{{2,}}",
    "secret": rf"(?<!\w){SECRET_NAME}\s{{0,3}}[=:]\s{{0,3}}[\"']?[A-Za-z0-9+/_.~-]{{8,}}+",
    "cloud_key": r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w+])\d(?:[ -]?\d){12,18}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d){7,12}(?!\w)",
    "name": rf"(?<![\p{{L}}\p{{N}}_]){TITLED}(?:{FIRST} (?:\p{{Lu}}\. )?{SURNAME}|{SURNAME}(?: {SURNAME})?)|(?<![\p{{L}}\p{{N}}_]){FIRST} (?:\p{{Lu}}\. )?{SURNAME}|(?=\p{{Lu}})(?<=(?:{'|'.join(CUES)}) ){SURNAME} {SURNAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without one of these characters or words holds no entity; a cheaper search for most texts.
HINT = rf"[@=:]|\d{{3}}|\d\.\d|\d[ -]\d|[A-Z]{{2}}\d\d|AKIA|ASIA|(?:{'|'.join(t for g in TITLES.values() for t in g)})\.? \p{{L}}|(?:{KNOWN})[ -]|(?:{'|'.join(CUES)}) \p{{L}}"
#: Put around entities to cut a text into them and what is between; texts that hold it are cut in another way.
MARK = "\ue0f5"


def pieces(text: Column, pattern: Column) -> Column:
    """A text in pieces, every second of which matches. One pass of the pattern, unless the text holds MARK."""
    marked = F.split(F.regexp_replace(text, pattern, F.lit(f"{MARK}$0{MARK}")), MARK)
    apart = F.flatten(F.zip_with(F.split(text, pattern), F.regexp_extract_all(text, pattern, 0), lambda p, e: F.array(p, e)))
    return F.when(F.contains(text, F.lit(MARK)), F.filter(apart, lambda x: x.isNotNull())).otherwise(marked)


def cut(text: Column) -> Column:
    """A text in pieces, every second of which is an entity; null if there is none."""
    return F.when(F.regexp_like(text, F.lit(HINT)), pieces(text, F.lit(f"(?:{ANY})")))


def with_surnames(p: Column) -> Column:
    """Pieces of `cut`, in which the names without titles and the surnames of the people found are entities wherever they stand."""
    named = F.filter(p, lambda x, i: (i % 2 == 1) & F.regexp_like(x, F.lit(f"^(?:{PATTERNS['name']})$|^{FIRST} |^{SURNAME} {SURNAME}$")))
    ends = F.array_distinct(F.flatten(F.transform(named, lambda x: F.array(F.replace(F.regexp_replace(x, TITLE, ""), F.lit("."), F.lit("[.]")), F.regexp_extract(x, f"({SURNAME})$", 1), F.substring_index(x, " ", -1)))))
    longest = F.array_sort(F.filter(ends, lambda x: F.char_length(x) > 2), lambda a, b: F.char_length(b) - F.char_length(a))
    alone = lambda names: F.concat(F.lit(r"(?<![\p{L}\p{N}_'’-])(?:"), names, F.lit(r")(?!(?!['’]s(?!\p{L}))['’-]?[\p{L}\p{N}_])"))
    apart = lambda names: F.flatten(F.transform(p, lambda x, i: F.when(i % 2 == 1, F.array(x)).otherwise(pieces(x, alone(names)))))
    return let(F.array_join(longest, "|"), lambda names: F.when(names == "", p).otherwise(apart(names)))


def kind_of(e: Column) -> Column:
    out = F.lit("name")
    for k in ("phone", "card", "ssn", "iban", "ip", "cloud_key", "secret", "email"):
        out = F.when(F.regexp_like(e, F.lit(f"^(?:{PATTERNS[k]})$")), F.lit(k)).otherwise(out)
    return out


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


#: From this salt on surrogates may be longer than what they stand for.
WIDE = 4
TITLE = f"^{TITLED}"
#: Ends the form of a man's name that a woman has too.
MALE = "\x1em"
SECRET_HEAD = rf"^{SECRET_NAME}\s{{0,3}}[=:]\s{{0,3}}[\"']?"


def canonical(kind: Column, e: Column) -> Column:
    """The same for every way of writing one entity: case, separators, country code and title do not count."""
    return (
        F.when(kind == "email", F.lower(e))
        .when(kind == "phone", F.substring(digits(e), -10, 10))
        .when(kind.isin("card", "ssn"), digits(e))
        .when(kind == "iban", F.replace(e, F.lit(" "), F.lit("")))
        .when(kind == "secret", F.regexp_replace(e, SECRET_HEAD, ""))
        .when(kind == "name", F.regexp_replace(F.lower(F.regexp_replace(e, TITLE, "")), rf"(?<![^ ~])({'|'.join(PARTICLES)}) (?=[^ ])", "$1~"))
        .otherwise(e)
    )


def stream(key: str, what: str, value: Column, salt: Column) -> Column:
    """128 hex characters that only the key's holder can compute again."""
    base = F.concat(F.lit(f"{key}\x1f{what}\x1f"), value, F.lit("\x1f"), salt.cast("string"))
    return F.concat(F.sha2(base, 256), F.sha2(F.concat(F.lit("+"), base), 256))


def stretched(hexes: Column, n: Column) -> Column:
    """`hexes`, for more than its 128 characters continued by further hashes until there are `n`."""
    more = F.transform(F.sequence(F.lit(1), F.ceil(n / 64).cast("int")), lambda i: F.sha2(F.concat(i.cast("string"), F.lit("+"), hexes), 256))
    return F.when(n > 128, F.concat(hexes, F.array_join(more, ""))).otherwise(hexes)


def at(hexes: Column, i: Column | int, n: int = 1) -> Column:
    return F.substr(hexes, i + F.lit(1) if isinstance(i, Column) else F.lit(i + 1), F.lit(n))


def number(hexes: Column, i: int, n: int) -> Column:
    return F.conv(at(hexes, i, n), 16, 10).cast("long")


def letters(s: Column, alphabet: str) -> Column:
    return F.translate(s, "0123456789abcdef", alphabet)


def as_digit(s: Column) -> Column:
    return F.translate(s, "abcdef", "038165")


def reshaped(e: Column, hexes: Column) -> Column:
    """`e` with each digit, lower and upper letter replaced by one of the same class and script; scripts without letters of their own here get Latin ones; the rest stays."""
    def other(c: Column, h: Column) -> Column:
        low = letters(h, ALPHABETS["latin"])
        for script in ("cyrillic", "greek"):
            low = F.when(F.regexp_like(c, F.lit(rf"\p{{Is{script.capitalize()}}}")), letters(h, ALPHABETS[script])).otherwise(low)
        low = F.when(F.regexp_like(c, F.lit(r"\p{N}")), as_digit(h)).when(F.regexp_like(c, F.lit(r"\p{L}")), low).otherwise(c)
        return let(low, lambda x: F.when(F.regexp_like(c, F.lit(r"\p{Lu}")), F.upper(x)).otherwise(x))

    one = lambda c, h: (
        F.when(F.regexp_like(c, F.lit("[0-9]")), as_digit(h))
        .when(F.regexp_like(c, F.lit("[a-z]")), letters(h, ALPHABETS["latin"]))
        .when(F.regexp_like(c, F.lit("[A-Z]")), letters(h, ALPHABETS["latin"].upper()))
        .when(F.ascii(c) < 128, c)
        .otherwise(other(c, h))
    )
    return F.array_join(F.zip_with(F.split(e, ""), F.slice(F.split(stretched(hexes, F.length(e)), ""), F.lit(1), F.length(e)), one), "")


def hexadecimal(e: Column, hexes: Column) -> Column:
    return F.substr(stretched(hexes, F.length(e)), F.lit(1), F.length(e))


def into_digits(e: Column, new: Column, place: str = "[0-9]") -> Column:
    """`e` with its digits (or other characters that match `place`), in order, replaced by those of `new`."""
    return F.array_join(F.flatten(F.zip_with(F.split(e, place), F.split(new, ""), lambda p, d: F.array(p, F.coalesce(d, F.lit(""))))), "")


def luhn_sum(d: Column) -> Column:
    """Of digits whose last is the check digit's place."""
    one = lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.filter(F.split(F.reverse(d), ""), lambda c: c != ""), one), F.lit(0), lambda a, x: a + x)


def card_digits(old: Column, hexes: Column) -> Column:
    """The first digit, which names the network, stays; a valid check digit is made valid again."""
    body = F.concat(F.substr(old, F.lit(1), F.lit(1)), F.substr(as_digit(hexes), F.lit(1), F.length(old) - 2))
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return F.concat(body, F.when(luhn_sum(old) % 10 == 0, check.cast("string")).otherwise(as_digit(at(hexes, 40))))


def pick(names: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))


def gender(e: Column) -> Column:
    """Of a title, else of the given name; `n` if neither tells."""
    out = F.lit("n")
    for g in ("m", "f"):
        named = rf"(?iu:^(?:\p{{L}}+-)?(?:{'|'.join(n for (s, k), v in GIVEN.items() if k == g for n in v)})(?:-\p{{L}}+)*(?= ))"
        out = F.when(F.regexp_like(F.regexp_replace(e, TITLE, ""), F.lit(named)), F.lit(g)).otherwise(out)
    for g in ("m", "f"):
        out = F.when(F.regexp_like(e, F.lit(rf"^(?:{'|'.join(TITLES[g])})\.? ")), F.lit(g)).otherwise(out)
    return out


def widened(hexes: Column, salt: Column) -> Column:
    """Letters that are added to values whose own places gave no free surrogate under the first salts; more for larger salts."""
    n = F.when(salt < WIDE, 0).when(salt < 256, 3).when(salt < 65536, 5).otherwise(9)
    return letters(F.substr(hexes, F.lit(101), n.cast("int")), "abdefgiklmnoprst")


def surname(canon: Column) -> Column:
    """The last word, particles included, as canonical forms tie them to it."""
    return F.replace(F.substring_index(canon, " ", -1), F.lit(MALE), F.lit(""))


def person(kind: Column, e: Column, canon: Column, key: str, salt: Column, g: Column, f: Column) -> Column:
    """Title kept; a given name of gender `g` and the same script, longer for larger salts; a surname made of syllables.

    The surname depends on the old one and its own salt `f` alone, so it is the same for every person of that name
    and every mention; who shares a surname is told apart by given names.
    """
    title = F.regexp_extract(e, f"({TITLE})", 1)
    given, family = stream(key, "given", canon, salt), stream(key, "family", surname(canon), f)
    female = F.when(g == "n", number(given, 20, 2) % 2 == 0).otherwise(g == "f")
    size = F.when(salt < WIDE, 0).when(salt < 256, 3).when(salt < 65536, 5).otherwise(8)

    def written(script: str) -> Column:
        of = lambda hexes, first, n: F.concat(*[pick(SYLLABLES[script], number(hexes, k, 1)) for k in range(first, first + n)])
        first = F.when(female, pick(GIVEN[(script, "f")], number(given, 0, 6))).otherwise(pick(GIVEN[(script, "m")], number(given, 0, 6)))
        more = F.when(size == 3, of(given, 30, 3)).when(size == 5, of(given, 30, 5)).when(size == 8, of(given, 30, 8))
        first = F.when(size == 0, first).otherwise(F.concat(first, F.lit("-"), F.initcap(more)))
        last = F.initcap(F.concat(of(family, 0, 5), F.when(f < WIDE, F.lit("")).otherwise(of(family, 5, 5))))
        return F.concat(F.when(kind == "name", F.concat(first, F.lit(" "))).otherwise(F.lit("")), last)

    new = F.when(F.regexp_like(canon, F.lit(r"\p{IsCyrillic}")), written("cyrillic")).when(F.regexp_like(canon, F.lit(r"\p{IsGreek}")), written("greek")).otherwise(written("latin"))
    capitals = ~F.regexp_like(F.regexp_replace(e, TITLE, ""), F.lit(r"\p{Ll}"))
    return F.concat(title, let(new, lambda x: F.when(capitals, F.upper(x)).otherwise(x)))


def surrogate(kind: Column, e: Column, canon: Column, key: str, salt: Column, g: Column, f: Column) -> Column:
    """The replacement of a mention; depends on the key, kind, canonical form, salt and, of names, gender and the surname's salt, and takes the mention's format."""
    hexes = stream(key, "value", canon, salt)
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    tld = F.regexp_extract(domain, r"(\.[^.]*)$", 1)
    host = F.lower(F.substr(domain, F.lit(1), F.length(domain) - F.length(tld)))
    head = F.regexp_extract(e, f"({SECRET_HEAD})", 1)
    value = F.substr(e, F.length(head) + 1, F.length(e))
    d = digits(e)
    ten = as_digit(hexes)
    octets = F.concat(F.when(salt < WIDE, F.lit("10")).otherwise((240 + number(hexes, 6, 2) % 15).cast("string")), F.lit("."), number(hexes, 0, 2).cast("string"), F.lit("."), number(hexes, 2, 2).cast("string"), F.lit("."), number(hexes, 4, 2).cast("string"))
    return (
        F.when(kind == "email", F.concat(reshaped(local, hexes), widened(hexes, salt), F.lit("@"), reshaped(host, stream(key, "host", host, F.lit(0))), tld))
        .when(kind == "phone", into_digits(e, F.concat(F.substr(d, F.lit(1), F.greatest(F.length(d) - 10, F.lit(0))), F.substr(ten, F.lit(1), F.least(F.length(d), F.lit(10))))))
        .when(kind == "card", into_digits(e, card_digits(d, hexes)))
        .when(kind == "ssn", into_digits(e, F.substr(ten, F.lit(1), F.lit(9))))
        .when(kind == "ip", octets)
        .when(kind == "iban", into_digits(e, F.concat(F.substr(canon, F.lit(1), F.lit(2)), reshaped(F.substr(canon, F.lit(3), F.length(canon)), hexes)), "[^ ]"))
        .when(kind == "cloud_key", F.concat(F.substr(e, F.lit(1), F.lit(4)), reshaped(F.substr(e, F.lit(5), F.lit(16)), hexes)))
        .when(kind == "secret", F.concat(head, F.when(F.regexp_like(value, F.lit("^[0-9a-f]+$")), hexadecimal(value, hexes)).otherwise(reshaped(value, hexes)), widened(hexes, salt)))
        .otherwise(person(kind, e, canon, key, salt, g, f))
    )


def typed(e: Column) -> tuple[Column, Column]:
    """Kind and canonical form; a surname alone is of the kind family."""
    kind = kind_of(e)
    canon = canonical(kind, e)
    return F.when((kind == "name") & ~F.contains(canon, F.lit(" ")), "family").otherwise(kind), canon


def settled(found: DataFrame, key: str, scratch: Scratch, most: int = 60) -> DataFrame:
    """kind, canon, salt, g (gender), f (the surname's salt) of every distinct entity of `found` (kind, canon, g, f), such that no two of a kind share a surrogate and none has another's original.

    The gender of a name is the one that its mentions show, the first in order if they differ, so that the form
    compared here is the one written. Each round, of the entities that share a surrogate the first in order
    keeps it; the others and those whose surrogate is an original go on by steps drawn from a range that grows
    with the round, so few meet again, until no clash is left. Larger salts reach longer surrogates. Clashes that
    stay for `most` rounds are an error.
    """
    shown = F.coalesce(F.min(F.when(F.col("g") != "n", F.col("g"))), F.lit("n")).alias("g")
    book = scratch.write(found.groupBy("kind", "canon").agg(shown, F.max("f").alias("f")).withColumn("salt", F.lit(0).cast("long")), "entities")
    for number in range(most):
        step = 1 + F.pmod(F.xxhash64("canon", "salt"), F.lit(min(64 << 4 * number, 1 << 40)))
        own = F.when(F.col("kind") == "family", F.col("salt")).otherwise(F.col("f"))
        kind = F.when(F.col("kind") == "family", "name").otherwise(F.col("kind"))
        made = book.withColumn("s", let(surrogate(F.col("kind"), F.col("canon"), F.col("canon"), key, F.col("salt"), F.col("g"), own), lambda x: canonical(kind, x)))
        made = scratch.write(made, "made")
        many = made.groupBy("kind", "s").count().filter("count > 1").drop("count")
        rank = F.row_number().over(Window.partitionBy("kind", "s").orderBy("salt", "canon")) - 1
        shared = made.join(many, ["kind", "s"]).withColumn("rank", rank).filter("rank > 0").select("kind", "canon", step.alias("more"))
        taken = made.join(book.select("kind", F.col("canon").alias("s")), ["kind", "s"], "left_semi").select("kind", "canon", step.alias("more"))
        clash = scratch.write(shared.union(taken).groupBy("kind", "canon").agg(F.max("more").alias("more")), "clashes")
        if clash.isEmpty():
            return book
        book = scratch.write(book.join(clash, ["kind", "canon"], "left").select("kind", "canon", "g", "f", (F.col("salt") + F.coalesce("more", F.lit(0))).alias("salt")), "entities")
    raise ValueError(f"surrogates of {clash.count()} entities still clash after {most} rounds")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, text with surrogates, n_entities, n_distinct, kinds.

    Entities: e-mail addresses, phone and card numbers, IPv4 addresses, IBANs, social security numbers,
    cloud keys, assigned secrets, and names after a title, with a known given name, or introduced by a cue such as
    "my name is". Equal entities, however written, get surrogates of equal value in every document; different ones never
    share one. Names are told apart by given and family name. Surnames are settled first, so all who share one, and
    its mentions without a given name, share the surrogate surname. A name without its title and a surname that stands alone, written as
    in a name that its own text holds, are entities. A name borne by a man and a woman, as their titles show, is two persons; without a title it is the
    woman's. Particles belong to the surname. Latin, Cyrillic and Greek names keep their script; those of other scripts with capitals
    become Latin. Names in small letters are not found.

    Null text stays null, empty stays empty, text without entities comes back unchanged, however long. Rows are
    independent apart from the shared surrogates, so repeats and null ids give a row each; an empty table
    gives an empty result. Only the two named columns are read, so other names cannot clash. Each text is searched
    once; its pieces are written and put together again.
    """
    scratch = Scratch(docs.sparkSession)
    text = docs[text_col]
    base = docs.select(docs[id_col].alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h"), text.alias("_t"), cut(text).alias("_p")).withColumn("_p", with_surnames(F.col("_p")))
    base = base.withColumn("_t", F.when(F.coalesce(F.size("_p"), F.lit(0)) <= 1, F.col("_t"))).withColumn("_p", F.when(F.size("_p") > 1, F.col("_p")))
    base = scratch.write(base, "pieces")
    kind, canon = typed(F.col("e"))
    odd = F.filter("_p", lambda x, i: i % 2 == 1)
    seen = base.filter("_p IS NOT NULL").select("_id", "_h", F.explode(odd).alias("e")).withColumns({"kind": kind, "canon": canon})
    seen = scratch.write(seen.select("_id", "_h", "kind", "canon", F.when(F.col("kind") == "name", gender(F.col("e"))).otherwise("n").alias("g")), "mentions")
    both = seen.filter("kind = 'name' AND g <> 'n'").groupBy("canon").agg(F.count_distinct("g").alias("n")).filter("n > 1").select(F.col("canon").alias("_both"))
    both = scratch.write(both, "both")
    seen = seen.join(broadcast_if(both, both.count()), (F.col("kind") == "name") & (F.col("canon") == F.col("_both")), "left")
    seen = scratch.write(seen.withColumn("canon", F.when(F.col("_both").isNotNull() & (F.col("g") == "m"), F.concat("canon", F.lit(MALE))).otherwise(F.col("canon"))).drop("_both"), "seen")
    names = seen.filter("kind in ('name', 'family')").select("_id", "_h", F.lit("family").alias("kind"), surname(F.col("canon")).alias("canon"), F.lit("n").alias("g"))
    families = settled(names.withColumn("f", F.lit(0).cast("long")), key, scratch)
    own = families.filter("salt > 0").select(F.col("canon").alias("_last"), F.col("salt").alias("f"))
    rest = seen.filter("kind <> 'family'").select("kind", "canon", "g").distinct().withColumn("_last", F.when(F.col("kind") == "name", surname(F.col("canon"))))
    rest = rest.join(broadcast_if(own, own.count()), "_last", "left").withColumn("f", F.coalesce("f", F.lit(0).cast("long")))
    again = settled(rest, key, scratch).filter((F.col("salt") > 0) | ((F.col("kind") == "name") & ((F.col("g") != gender(F.col("canon"))) | F.col("canon").endswith(MALE)))).unionByName(families.filter("salt > 0"))
    again = scratch.write(again.select("kind", "canon", "salt", "g"), "again")
    tag = lambda kind, canon: F.concat(kind, F.lit("\x1f"), canon)
    needed = seen.drop("g").unionByName(names.drop("g"))
    salted = needed.join(broadcast_if(again, again.count()), ["kind", "canon"]).groupBy("_id", "_h").agg(F.map_from_entries(F.collect_set(F.struct(tag(F.col("kind"), F.col("canon")), F.struct("salt", "g")))).alias("_salts"))
    salted = scratch.write(salted.withColumnsRenamed({"_id": "_id2", "_h": "_h2"}), "salted")
    rows = base.join(broadcast_if(salted, salted.count()), [F.col("_id").eqNullSafe(F.col("_id2")), F.col("_h") == F.col("_h2")], "left")

    def entry(x: Column) -> Column:
        kind, canon = typed(x)
        return F.struct(x.alias("e"), kind.alias("kind"), canon.alias("canon"))

    def salts(x: Column) -> Column:
        man = F.concat(x["canon"], F.lit(MALE))
        own = F.when((gender(x["e"]) == "m") & F.element_at(F.col("_salts"), tag(x["kind"], man)).isNotNull(), man).otherwise(x["canon"])
        mine = F.element_at(F.col("_salts"), tag(x["kind"], own))
        last = F.element_at(F.col("_salts"), tag(F.lit("family"), surname(x["canon"])))
        zero = F.lit(0).cast("long")
        g = F.coalesce(mine["g"], F.when(x["kind"] == "name", gender(x["canon"])).otherwise("n"))
        return F.struct(x["e"].alias("e"), x["kind"].alias("kind"), own.alias("canon"), F.coalesce(mine["salt"], zero).alias("salt"), g.alias("g"), F.when(x["kind"].isin("name", "family"), F.coalesce(last["salt"], zero)).otherwise(zero).alias("f"))

    rows = rows.withColumn("_k", F.transform(F.transform(odd, entry), salts)).withColumn("_new", F.transform("_k", lambda x: surrogate(x["kind"], x["e"], x["canon"], key, x["salt"], x["g"], x["f"])))
    between = F.filter("_p", lambda x, i: i % 2 == 0)
    joined = F.array_join(F.flatten(F.zip_with(between, F.col("_new"), lambda p, new: F.array(p, F.coalesce(new, F.lit(""))))), "")
    shown = lambda x: F.when(x["kind"] == "family", "name").otherwise(x["kind"])
    return rows.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_p").isNotNull(), joined).otherwise(F.col("_t")).alias("text"),
        F.coalesce(F.size("_k"), F.lit(0)).cast("long").alias("n_entities"),
        F.coalesce(F.size(F.array_distinct(F.transform("_k", lambda x: tag(x["kind"], x["canon"])))), F.lit(0)).cast("long").alias("n_distinct"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform("_k", shown))), F.array().cast("array<string>")).alias("kinds"),
    )
