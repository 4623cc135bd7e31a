"""PII surrogates: detected entities get keyed, type-consistent replacements.

Detection.  One pattern finds e-mail addresses, IPv4 and IPv6 addresses, phone numbers,
IBANs, social security numbers, payment cards, access tokens, and persons (a title or a
known given name, then up to ``MORE_NAMES`` more capitalised names, of which the last is
the surname; a name with neither isn't found, nor are initials or names all in capitals).
What each match is follows from which single pattern it fits.  Lengths are bounded, so no
text can exhaust a stack or take more than linear time: an e-mail address has at most 256
characters before the @ and 255 of a host after it, a name 61 letters, a token 255.  A card number must satisfy its check
digit (Luhn); other runs of digits are left alone.

Surrogates.  Every entity has a canonical form (an e-mail or a hexadecimal token in lower
case, the digits of a number, a person's names without title), and its surrogate is a
function of an HMAC under a secret key, the type, that form and a try: digits become digits
and letters letters of their case.  All punctuation stays, so the format does, and each way
of writing an entity is rendered from the same canonical surrogate (coreference).  Types
stay what they are: cards keep a valid check digit and IBANs valid check numbers, North
American phone numbers have area and exchange codes that exist, private and loopback IPv4
addresses stay in their ranges and others go to 240.0.0.0/4, which nobody routes, and
addresses of one mail domain share one domain.

Persons.  Surnames are settled first, each with one surrogate wherever it stands; a person
then gets a given name of the same gender and script before that surname.

Collisions.  Over the whole corpus no two canonical forms of a type may share a surrogate
(distinctness), nor may a surrogate be a form that occurs itself; the offenders, but for
the smallest, try again.  A form that finds none in ``TRIES`` tries, as its format is nearly
full, becomes its type and 24 hexadecimal digits in brackets.

All of it is DataFrame operations.  A document travels only if it has an entity.

Defined cases: null texts stay null and texts without entities stay as they are; an empty
table gives none; very long texts are searched whole; rows that repeat in id and text get
equal results; null ids are ids like any other; extra columns pass through, but columns
named as results (``n_entities``, ``kinds``) are replaced.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.llm.shared import forget, spread_join, written

#: Tries of a surrogate before its format counts as full.
TRIES = 60
#: Tries from which a person gets two, three and four given names.
NAMES = (3, 8, 16)

# Given names by gender and script, and the titles that tell the gender.
GIVEN = {
    ("f", "latin"): ["Alice", "Anna", "Carla", "Claire", "Elena", "Emma", "Eva", "Helen", "Ines", "Julia", "Laura", "Lucia", "Maria", "Marie", "Nora", "Paula", "Rosa", "Sara", "Sofia", "Vera"],
    ("m", "latin"): ["Adam", "Anton", "Carlos", "David", "Diego", "Erik", "Felix", "George", "Hugo", "Ivan", "James", "John", "Louis", "Marco", "Martin", "Oscar", "Paul", "Peter", "Robert", "Thomas"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Татьяна"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Дмитрий", "Иван", "Максим", "Олег", "Павел", "Сергей", "Юрий"],
}
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "госпожа", "г-жа"],
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "господин", "г-н"],
    "": ["Dr", "Prof"],
}
SYLLABLES = {
    "latin": ["ba", "bel", "cor", "dan", "der", "fal", "gar", "hol", "ken", "lin", "mar", "nor", "pel", "ros", "sen", "tor"],
    "cyrillic": ["ба", "бел", "вор", "гал", "дан", "жар", "зим", "кор", "лин", "мар", "нов", "пел", "рос", "сен", "тол", "чер"],
}
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
#: Names after a title's first one or a given name, and letters after a name's first, at most.
MORE_NAMES, LETTERS = 3, 60
_NAME = rf"\p{{Lu}}[\p{{L}}'’-]{{1,{LETTERS}}}+"
_GIVEN = "|".join(n for ns in GIVEN.values() for n in ns)
# No pattern repeats a group without bound: Java would go down a level for each repetition.
PATTERNS = {
    # Also where the last match ended, as its end is all that stands before an adjacent one.
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,256}@[A-Za-z0-9-][A-Za-z0-9.-]{0,254}\.[A-Za-z]{2,63}",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]\d|\d)",
    "ipv6": r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,5}::[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:.])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
    # Before IBANs: 32 to 35 hex digits in upper case may look like one.
    "token": r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{32,64}|AKIA[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{30,255}|sk-[A-Za-z0-9]{20,255})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d)",
    "person": rf"(?<![\p{{L}}\d])(?:(?:{_TITLE})\.?[ ]{_NAME}(?:[ ]{_NAME}){{0,{MORE_NAMES}}}|(?:{_GIVEN})(?:[ ]{_NAME}){{1,{MORE_NAMES}}})(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: How a title, a given name or a token's prefix begins, so that most places are left at once.
FIRST = "[A-ZgsгА-Я]"
#: What each match has: cheap to look for before the patterns are tried.
HINT = rf"[@\d]|[a-fA-F]{{32}}|(?={FIRST})(?<![\p{{L}}\d])(?:AKIA|gh[opsu]_|sk-|(?:{_TITLE})\.?[ ]\p{{Lu}}|(?:{_GIVEN})[ ]\p{{Lu}})"


def _kind(raw: Column) -> Column:
    out = F
    for kind, p in PATTERNS.items():
        # Look-arounds see the ends of the match, which allow it.
        out = out.when(raw.rlike(f"^(?:{p})$"), kind)
    return out


def _is(script: str, col: Column) -> Column:
    return col.rlike(r"\p{IsCyrillic}") if script == "cyrillic" else ~col.rlike(r"\p{IsCyrillic}")


def canonical(kind: Column, raw: Column) -> Column:
    names = F.regexp_replace(raw, rf"^(?:{_TITLE})\.?[ ]", "")
    return (
        F.when(kind.isin("email", "ipv6") | (kind == "token") & raw.rlike("^[0-9a-fA-F]+$"), F.lower(raw))
        .when(kind.isin("ssn", "card"), F.regexp_replace(raw, r"\D", ""))
        .when(kind == "phone", F.regexp_replace(raw, r"[^\d+]", ""))
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when(kind == "person", names)
        .otherwise(raw)
    )


def gender(raw: Column) -> Column:
    out = F
    for g in ("f", "m"):
        names = "|".join(n for (x, _), ns in GIVEN.items() if x == g for n in ns)
        out = out.when(raw.rlike(rf"^(?:{'|'.join(TITLES[g])})\.?[ ]|^(?:(?:Dr|Prof)\.?[ ])?(?:{names})[ ]"), g)
    return out.otherwise("")


def _noise(key: str, *parts: Column) -> Column:
    """HMAC-SHA-256 in hex: 64 digits that only the key's owner can repeat."""
    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(c ^ x for c in block))
    message = F.concat_ws("\x1f", *[p.cast("string") for p in parts]).cast("binary")
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message), 256))), 256)


def _nibbles(noise: Column, at: Column) -> Column:
    """A number from 0 to 65535 out of the hex digits at a place; a place beyond 16 wraps."""
    return F.conv(F.substring(noise, F.pmod(at, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _letters(key: str, kind: Column, form: Column, attempt: Column, head: Column, tail: Column, hexed: Column, least: Column) -> Column:
    """Each digit and letter of ``form`` but for its head and tail replaced by one of its
    class; digits at the places ``least`` (counted from 0) are 2 or more."""

    def one(i: Column) -> Column:
        c = F.substring(form, i + 1, F.lit(1))
        # A block of 16 characters has noise of its own, so the whole surrogate varies.
        v = _nibbles(_noise(key, kind, form, attempt, F.floor(i / 16)), i)
        pick = lambda letters, n: F.substring(F.lit(letters), F.pmod(v, F.lit(n)) + 1, F.lit(1))
        return (
            F.when((i < head) | (i >= F.length(form) - tail), c)
            .when(hexed, F.when(c == ":", c).otherwise(pick("0123456789abcdef", 16)))
            .when(F.array_contains(least, i), pick("23456789", 8))
            .when(c.rlike("[0-9]"), pick("0123456789", 10))
            .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", 26))
            .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26))
            .otherwise(c)
        )

    places = F.sequence(F.lit(0), F.length(form) - 1)
    return F.when(F.length(form) > 0, F.array_join(F.transform(places, one), "")).otherwise("")


def _digits(number: Column) -> Column:
    """Digits of a string from the last to the first."""
    back = F.reverse(number)
    return F.transform(F.sequence(F.lit(1), F.length(number)), lambda k: F.substring(back, k, F.lit(1)).cast("int"))


def _luhn_sum(number: Column, doubled: int) -> Column:
    """Luhn's sum of a number's digits; ``doubled``: which of two, from the last, counts twice."""
    weigh = lambda d, i: F.when(i % 2 == doubled, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    return F.aggregate(F.transform(_digits(number), weigh), F.lit(0), lambda x, y: x + y)


def luhn(raw: Column) -> Column:
    return _luhn_sum(F.regexp_replace(raw, r"\D", ""), 1) % 10 == 0


def _iban_checked(form: Column) -> Column:
    """The IBAN with its check numbers: 98 less the rest by 97 of country and account."""
    moved = F.concat(F.substring(form, F.lit(5), F.length(form)), F.substring(form, F.lit(1), F.lit(2)), F.lit("00"))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda r, k: (lambda v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97)(value(F.substring(moved, k, F.lit(1))))
    rest = F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step)
    return F.concat(F.substring(form, F.lit(1), F.lit(2)), F.lpad((98 - rest).cast("string"), 2, "0"), F.substring(form, F.lit(5), F.length(form)))


def _scrambled(key: str, kind: Column, form: Column, attempt: Column) -> Column:
    """A country code, a card's network digit, an e-mail's top domain and a token's prefix
    stay; check digits are made anew."""
    country = F.when(form.rlike(r"^\+[17]"), 2).when(form.rlike(r"^\+"), 3)
    head = F.when(kind == "iban", 2).when(kind == "phone", F.coalesce(country, F.lit(0))).when(kind == "card", 1).when(form.rlike("^AKIA|^gh[opsu]_"), 4).when(form.rlike("^sk-"), 3).otherwise(0)
    hexed = (kind == "ipv6") | (kind == "token") & form.rlike("^[0-9a-f]+$")
    # Area and exchange codes of North America begin with 2 or more.
    american = (kind == "phone") & form.rlike(r"^(\+1)?\d{10}$")
    least = F.when(american & form.startswith("+"), F.array(F.lit(2), F.lit(5))).when(american, F.array(F.lit(0), F.lit(3))).otherwise(F.array().cast("array<int>"))
    new = _letters(key, kind, form, attempt, head, F.lit(0), hexed, least)
    bare = F.substring(new, F.lit(1), F.length(new) - 1)
    check = F.pmod(-_luhn_sum(bare, 0), F.lit(10)).cast("string")
    return F.when(kind == "card", F.concat(bare, check)).when(kind == "iban", _iban_checked(new)).otherwise(new)


def _email(key: str, form: Column, attempt: Column) -> Column:
    """The local part varies by address and try, the domain by domain only."""
    none, no = F.array().cast("array<int>"), F.lit(False)
    local, domain = F.substring_index(form, "@", 1), F.substring_index(form, "@", -1)
    top = F.length(F.regexp_extract(domain, r"\.[a-z]+$", 0))
    host = _letters(key, F.lit("domain"), domain, F.lit(0), F.lit(0), top, no, none)
    mine = _letters(key, F.lit("email"), F.concat(local, F.lit("@"), domain), attempt, F.lit(0), F.length(domain) + 1, no, none)
    # Short addresses could run out: later tries put letters before them.
    spare = F.translate(F.substring(_noise(key, F.lit("email"), form, attempt), F.lit(1), attempt), "0123456789abcdef", "ghijklmnopabcdef")
    return F.concat(F.when(attempt > 1, spare).otherwise(""), F.substring(mine, F.lit(1), F.length(local)), F.lit("@"), host)


def _surname(key: str, form: Column, attempt: Column) -> Column:
    """Four syllables of the script, more at later tries."""
    noise = _noise(key, F.lit("surname"), form, attempt)

    def of(script: str) -> Column:
        parts = SYLLABLES[script]
        bits = [F.element_at(F.array(*map(F.lit, parts)), F.pmod(_nibbles(noise, F.lit(k)), F.lit(len(parts))) + 1) for k in range(8)]
        more = [F.when(attempt > k, bits[4 + k]).otherwise("") for k in range(4)]
        return F.initcap(F.concat(*bits[:4], *more))

    return F.when(_is("cyrillic", form), of("cyrillic")).otherwise(of("latin"))


def _person(key: str, form: Column, sex: Column, surname: Column, attempt: Column) -> Column:
    """Given names by gender and script, then the surname's surrogate.  The same given name
    has the same surrogate but where that would make two persons one: then names are drawn
    for that person at each try, from the tries in ``NAMES`` on two, three and four of them."""
    first = F.substring_index(form, " ", 1)
    keyed = _noise(key, F.lit("given"), F.lower(first), sex)
    drawn = _noise(key, F.lit("person"), form, sex, attempt)
    pool = F
    for (g, script), names in GIVEN.items():
        mine = (sex == g) | ((sex == "") & (F.pmod(_nibbles(keyed, F.lit(1)), F.lit(2)) == int(g == "m")))
        pool = pool.when(_is(script, form) & mine, F.array(*map(F.lit, names)))
    n = F.size(pool)
    at = _nibbles(F.when(attempt > 0, drawn).otherwise(keyed), F.lit(0))
    # The others are not the first one again.
    more = [F.when(attempt >= least, F.element_at(pool, F.pmod(at + 1 + F.pmod(_nibbles(drawn, F.lit(k)), n - 1), n) + 1)) for k, least in enumerate(NAMES, 1)]
    given = F.concat_ws("-", F.element_at(pool, F.pmod(at, n) + 1), *more)
    # Each name between has a given name of its own.
    names = F.split(form, " ")
    between = F.transform(F.slice(names, F.lit(2), F.greatest(F.size(names) - 2, F.lit(0))), lambda w: F.element_at(pool, F.pmod(_nibbles(_noise(key, F.lit("given"), F.lower(w), sex), F.lit(0)), n) + 1))
    return F.when(form.contains(" "), F.concat_ws(" ", given, F.array_join(F.when(F.size(between) > 0, between), " "), surname)).otherwise(surname)


def _ipv4(key: str, form: Column, attempt: Column) -> Column:
    """Private and loopback addresses in their range, others where nothing is routed."""
    noise = _noise(key, F.lit("ipv4"), form, attempt)
    byte = lambda k, lo, n: (F.pmod(_nibbles(noise, F.lit(k)), F.lit(n)) + lo).cast("string")
    rest = [byte(2, 0, 256), byte(3, 1, 254)]
    return F.concat_ws(
        ".",
        F.when(form.rlike(r"^10\."), "10").when(form.rlike(r"^127\."), "127").when(form.rlike(r"^192\.168\."), "192").when(form.rlike(r"^172\.(1[6-9]|2\d|3[01])\."), "172").otherwise(byte(0, 240, 15)),
        F.when(form.rlike(r"^192\.168\."), "168").when(form.rlike(r"^172\.(1[6-9]|2\d|3[01])\."), byte(1, 16, 16)).otherwise(byte(1, 0, 256)),
        *rest,
    )


def surrogate(key: str, kind: Column, form: Column, sex: Column, surname: Column, attempt: Column) -> Column:
    made = (
        F.when(kind == "surname", _surname(key, form, attempt))
        .when(kind == "person", _person(key, form, sex, surname, attempt))
        .when(kind == "ipv4", _ipv4(key, form, attempt))
        .when(kind == "email", _email(key, form, attempt))
        .otherwise(_scrambled(key, kind, form, attempt))
    )
    full = F.concat(F.lit("["), kind, F.lit(" "), F.substring(_noise(key, kind, form, F.lit("full")), 1, 24), F.lit("]"))
    return F.when(attempt >= TRIES, full).otherwise(made)


def render(kind: Column, raw: Column, new: Column) -> Column:
    """The canonical surrogate in the format of one way of writing the entity."""
    digits = F.split(raw, "")
    plain = F.regexp_replace(new, r"^\+", "")
    # The n-th digit (or IBAN character) of the surrogate stands where that of the text stood.
    step = lambda what: F.aggregate(
        digits,
        F.struct(F.lit("").alias("s"), F.lit(1).alias("k")),
        lambda a, c: F.when(c.rlike(what), F.struct(F.concat(a["s"], F.substring(plain, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(
            F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k"))
        ),
        lambda a: a["s"],
    )
    title = F.regexp_extract(raw, rf"^(?:(?:{_TITLE})\.?[ ])?", 0)
    return (
        F.when(new.startswith("["), new)
        .when(kind.isin("phone", "ssn", "card"), step(r"\d"))
        .when(kind == "iban", step(r"[A-Z0-9]"))
        .when(kind == "person", F.concat(title, new))
        .when((kind.isin("email", "ipv6") | (kind == "token") & raw.rlike("^[0-9A-F]+$")) & (raw == F.upper(raw)) & (raw != F.lower(raw)), F.upper(new))
        .otherwise(new)
    )


def _settled(forms: DataFrame, key: str) -> DataFrame:
    """(kind, form, new) of (kind, form, sex, surname), with no collision left."""
    make = lambda df: df.withColumn("new", surrogate(key, *map(F.col, ("kind", "form", "sex", "surname", "attempt"))))
    named = written(make(forms.withColumn("attempt", F.lit(0))), "surrogates")
    for _ in range(TRIES + 1):
        clash = named.groupBy("kind", F.lower("new").alias("lower")).agg(F.min("form").alias("first"), F.count(F.lit(1)).alias("n"))
        taken = named.select("kind", F.lower("form").alias("lower")).distinct().withColumn("taken", F.lit(True))
        told = named.withColumn("lower", F.lower("new")).join(clash, ["kind", "lower"]).join(taken, ["kind", "lower"], "left")
        # A surname alone is settled with the surnames.
        bad = (F.col("taken").isNotNull() | ((F.col("n") > 1) & (F.col("form") != F.col("first")))) & ~((F.col("kind") == "person") & ~F.col("form").contains(" "))
        told = told.select("kind", "form", "sex", "surname", (F.col("attempt") + bad.cast("int")).alias("attempt"), bad.alias("bad"))
        new = written(make(told), "surrogates")
        forget(named)
        named = new.drop("bad")
        if not new.filter("bad").limit(1).count():
            break
    return named.select("kind", "form", "new")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, raw, new) for the distinct (kind, raw) of ``entities``, with no collision left."""
    forms = entities.select("kind", "raw").distinct().withColumns({"form": canonical(F.col("kind"), F.col("raw")), "sex": F.when(F.col("kind") == "person", gender(F.col("raw"))).otherwise("")})
    # One entity may be written with and without a title; the known gender wins.
    one = forms.groupBy("kind", "form").agg(F.max("sex").alias("sex")).withColumn("last", F.when(F.col("kind") == "person", F.lower(F.substring_index("form", " ", -1))))
    last = one.filter("last is not null").select(F.lit("surname").alias("kind"), F.col("last").alias("form")).distinct()
    names = _settled(last.withColumns({"sex": F.lit(""), "surname": F.lit(None).cast("string")}), key)
    one = one.join(names.select(F.col("form").alias("last"), F.col("new").alias("surname")), "last", "left").drop("last")
    named = _settled(one.select("kind", "form", "sex", "surname"), key)
    return forms.drop("sex").join(named, ["kind", "form"]).select("kind", "raw", render(F.col("kind"), F.col("raw"), F.col("new")).alias("new"))


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text_col``, n_entities, and kinds (the sorted types found)."""
    rest = [c for c in docs.columns if c not in (text_col, "n_entities", "kinds")]
    text = F.col(text_col)
    may = text.rlike(HINT)
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    rows = docs.select(*rest, text_col).withColumn("__found", F.when(may, found))
    real = F.filter("__found", lambda m: ~m.rlike(f"^(?:{PATTERNS['card']})$") | luhn(m))
    rows = rows.withColumn("__real", F.when(F.size("__found") > 0, real))
    with_any = F.coalesce(F.size("__real") > 0, F.lit(False))
    row_key = {"__id": F.col(id_col), "__row": F.xxhash64(text_col)}
    some = rows.filter(with_any).withColumns(row_key)
    each = some.select("__id", "__row", F.explode(F.array_distinct("__real")).alias("raw")).withColumn("kind", _kind(F.col("raw")))
    each = written(each, "entities")
    # One entity may be in a third of all documents.
    new = written(surrogates(each, key).join(each.groupBy("kind", "raw").agg(F.count(F.lit(1)).alias("n")), ["kind", "raw"]), "new")
    per_doc = spread_join(each, new, ["kind", "raw"], "n", ["__id", "__row", "raw"]).distinct().groupBy("__id", "__row").agg(F.map_from_entries(F.collect_list(F.struct("raw", "new"))).alias("__map"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    per_doc = per_doc.withColumnsRenamed({"__id": "__id2", "__row": "__row2"})
    joined = some.join(per_doc, some["__id"].eqNullSafe(per_doc["__id2"]) & (some["__row"] == per_doc["__row2"]))
    gaps = F.split(text, ANY, -1)
    whole = F.zip_with(gaps, F.col("__found"), lambda g, m: F.concat(g, F.coalesce(F.element_at(F.col("__map"), m), m, F.lit(""))))
    changed = joined.select(*rest, F.array_join(whole, "").alias(text_col), F.size("__real").cast("long").alias("n_entities"), "kinds")
    same = rows.filter(~with_any).select(*rest, text_col, F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    return reduce(DataFrame.unionByName, [changed, same])
