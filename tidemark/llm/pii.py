"""Personal data: every detected entity is replaced by a keyed surrogate of its own kind and shape.

DataFrame operations only. One pattern finds entities, and only texts with a
digit, an @, a title or six pairs of letters are searched by it; their form tells the kind. A title
is followed by a run of capitalised words, also hyphenated or after initials,
which are the names; the pattern of a text with titles holds its names, so they
are found wherever else they stand in it, with a capital or all in capitals. A
text is rebuilt from the pieces between entities. A surrogate depends on the
key, the kind and the entity's canonical form alone, so an entity gets the same
replacement wherever it appears and however it is written, without a lookup.
A name after a neutral title, or without one, is a woman's if its text uses it
after women's titles only, else a man's. Initials and particles (van, de) stay,
and a run ends at a particle.
Only where two entities would share a surrogate, or a surrogate equals an
original of the corpus, do the later ones move on to their next draw; these
exceptions are found on distinct entities, and joined to the documents if
there are any. An entity still without a free surrogate after ``NARROW`` draws
gets wider ones, a letter, digit or group more every ``STEP`` draws, so every
entity is settled however few surrogates its shape leaves.

Shapes (while free surrogates of them are found): digits, punctuation, spaces, letter case and script stay as written;
phones keep their country code and valid leading digits, cards their check
digit, IBANs country and check digits, e-mail domains map alike and end in a
reserved name, addresses go to a reserved range, and titled names keep gender
(ending), script and capitals.

Defined results: rows without doc_id are left out; null texts stay null and
have no entities; rows that share a doc_id are treated row by row; further
columns pass through ``pseudonymised``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import materialize

KEY = "surrogates of this corpus"
#: Draws in an entity's own shape, and at each width beyond it.
NARROW, STEP = 8, 3

# Titles that tell a name's gender.
MALE = "Mr|Sir|Lord|Herr|Herrn|Monsieur|Señor|Don|Sr|господин"
FEMALE = "Mrs|Ms|Miss|Lady|Madam|Frau|Madame|Mme|Mlle|Señora|Señorita|Doña|Sra|госпожа"
OTHER = "Dr|Prof|Professor"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{L}+"
RUN = rf"(?:\p{{Lu}}\.\x20?)*{NAME}(?:(?:-|\x20(?:\p{{Lu}}\.\x20?)*){NAME})*"


def _titled(titles: str) -> str:
    """A run of names after one of ``titles``, which other titles may follow."""
    return rf"(?<=(?<![\p{{L}}\d])(?:{titles})\.?\x20)(?:(?:{MALE}|{FEMALE}|{OTHER})\.?\x20)*{RUN}"


def _addressed(titles: str) -> str:
    """A place that such a title stands before, with up to four names between."""
    name = r"\p{Lu}?['’]?\p{Lu}(?:\p{L}{1,20}|\.)[\x20-]"
    return rf"(?<=(?<![\p{{L}}\d])(?:{titles})\.?\x20(?:{'|'.join(name * k for k in range(5))})\p{{Lu}}?['’]?)"


KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "mac": r"(?<![\w:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\w:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "address": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d+-])\d(?:[\x20-]?\d){12,18}(?!\d)",
    "phone": r"(?<![\w+])(?:\+1[\x20.-]?\(?\d{3}\)?[\x20.-]?\d{3}[\x20.-]?\d{4}|\+\d{1,3}[\x20.-]?\(?\d{1,4}\)?[\x20.-]?\d{2,4}(?:[\x20.-]?\d{2,4}){1,3}|\(\d{3}\)\x20?\d{3}[\x20.-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
}
NAMES = ("man", "woman", "other")
#: The pattern for texts without titles; with them, groups of the text's names follow.
PLAIN = "(?=[0-9A-Za-z._%+(-])(?:" + "|".join(KINDS.values()) + ")"
#: Titles that are no names themselves.
NO_NAMES = tuple(t for t in f"{MALE}|{FEMALE}|{OTHER}".split("|") if t not in ("Don", "Lord"))
MARKS = r"[0-9@]|(?:[A-Fa-f]{2}[:-]){5}[A-Fa-f]{2}"
TITLES = rf"(?<![\p{{L}}\d])(?=[\p{{Lu}}гп])(?:{MALE}|{FEMALE}|{OTHER})\.?\x20\p{{Lu}}"
#: (vowels, consonants, endings of men, of women) of each script that names are made in.
SCRIPTS = {
    "latin": ("aeiou", "bcdfghklmnprstvz", "nrsk", "aea"),
    "cyrillic": ("аеиоу", "бвгдклмнпрст", "нрвк", "ая"),
    "greek": ("αεηιο", "βγδκλμνπρτ", "ςν", "αη"),
}


def _let(value: Column, fn) -> Column:
    """fn(value), with ``value`` worked out once however often fn names it."""
    return F.transform(F.array(value), fn)[0]


def _titled_names(text: Column, titles: str) -> Column:
    """The words of the runs after such titles, each once."""
    runs = F.regexp_extract_all(text, F.lit(_titled(titles)), F.lit(0))
    return F.array_except(F.flatten(F.transform(runs, lambda run: F.regexp_extract_all(run, F.lit(r"\p{L}{2,}"), F.lit(0)))), F.array(*map(F.lit, NO_NAMES)))


def titled_names(text: Column) -> Column:
    """(men, women, pattern) of a text with titles: its men's and women's names in lower case, and what finds its entities; else null."""
    men, women, other = (_titled_names(text, t) for t in (MALE, FEMALE, OTHER))

    def pattern(names: Column) -> Column:
        whole = F.concat(F.lit(r"(?:"), F.array_join(F.array_union(names, F.transform(names, lambda n: F.upper(n))), "|"), F.lit(r")(?![\p{L}\p{M}\d])"))
        start = rf"(?<![\p{{L}}\p{{M}}\d])(?=\p{{Lu}})"
        groups = [F.concat(F.lit(f"|({start}{_addressed(t) if t else ''}"), whole, F.lit(")")) for t in (MALE, FEMALE, "")]
        return F.when(F.size(names) > 0, F.concat(F.lit(PLAIN), *groups)).otherwise(F.lit(PLAIN + "|(?!)()()()"))

    lower = lambda names: F.transform(names, lambda n: F.lower(n))
    return F.when(text.rlike(TITLES), F.struct(lower(men).alias("men"), lower(women).alias("women"), _let(F.array_union(F.array_union(men, women), other), pattern).alias("pattern")))


def _searched(text: Column, names: Column, found, none: Column) -> Column:
    """found(pattern) with the pattern that the text needs, or ``none``."""
    return F.when(names.isNotNull(), found(names.pattern)).when(text.rlike(MARKS), found(None)).otherwise(none)


def _form(value: Column) -> Column:
    """The kind of an entity that is no name."""
    return (
        F.when(value.contains("@"), "email").when(value.rlike("^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"), "mac").when(value.rlike("^[A-Z]{2}"), "iban")
        .when(value.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "address").when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(value.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone").otherwise("card")
    )


def entities(text: Column, names: Column) -> Column:
    """Array of (kind, value) in text order. ``names``: of titled_names."""

    def found(pattern: Column | None) -> Column:
        if pattern is None:
            return F.transform(F.regexp_extract_all(text, F.lit(PLAIN), F.lit(0)), lambda v: F.struct(_form(v).alias("kind"), v.alias("value")))
        every = F.regexp_extract_all(text, pattern, F.lit(0))
        groups = [F.regexp_extract_all(text, pattern, F.lit(i + 1)).alias(k) for i, k in enumerate(NAMES)]

        def told(m: Column) -> Column:
            canon = F.lower(m.value)
            told_by_text = F.when(F.array_contains(names.women, canon) & ~F.array_contains(names.men, canon), "woman").otherwise("man")
            kind = F.when(m.man != "", "man").when(m.woman != "", "woman").when(m.other != "", told_by_text).otherwise(_form(m.value))
            return F.struct(kind.alias("kind"), m.value.alias("value"))

        return F.transform(F.arrays_zip(every.alias("value"), *groups), told)

    return _searched(text, names, found, F.array().cast("array<struct<kind:string,value:string>>"))


def _country(value: Column) -> Column:
    """The country code of a phone number as written; empty if it has none."""
    return F.regexp_extract(value, r"^\+(?:\d{1,3}(?=\D)|1(?=\d{10}$)|\d{2})", 0)


def _national(value: Column) -> Column:
    return F.substring(value, F.length(_country(value)) + 1, F.length(value))


def canonical(kind: Column, value: Column) -> Column:
    """The form in which equal entities are equal."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind == "phone", F.substring(F.regexp_replace(_national(value), "[^0-9]", ""), -10, 10)).when(kind.isin("ssn", "card"), digits)
        .when(kind == "iban", F.regexp_replace(value, " ", "")).when(kind == "mac", F.lower(F.translate(value, "-", ":"))).otherwise(F.lower(value))
    )


def _draw(seed: Column, i: Column, n: int | Column) -> Column:
    """A keyed number below n for place i."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", seed, i), 256), 1, 12), 16, 10).cast("long") % n


def _seed(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt), 256)


def _pick(symbols: str, nth: Column) -> Column:
    return F.substring(F.lit(symbols), (nth + 1).cast("int"), F.lit(1))


def _each(value: Column, fn) -> Column:
    """``value`` with every character c at place i replaced by fn(c, i)."""
    places = F.when(F.length(value) > 0, F.sequence(F.lit(1), F.length(value))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: fn(F.substring(value, i, F.lit(1)), i)), "")


def _same_class(c: Column, seed: Column, i: Column) -> Column:
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    return (
        F.when(c.rlike("[0-9]"), _pick(digits, _draw(seed, i, 10))).when(c.rlike("[a-z]"), _pick(lower, _draw(seed, i, 26)))
        .when(c.rlike("[A-Z]"), _pick(lower.upper(), _draw(seed, i, 26))).otherwise(c)
    )


def _place_from_end(value: Column, i: Column) -> Column:
    """How many digits follow place i."""
    return F.length(F.regexp_replace(F.substring(value, i + 1, F.length(value)), "[^0-9]", ""))


def _extra(attempt: Column) -> Column:
    """How many places wider than the entity its surrogate is on this draw."""
    return F.when(attempt < NARROW, 0).otherwise(F.floor((attempt - NARROW) / STEP) + 1).cast("int")


def _widened(kind: Column, value: Column, extra: Column) -> Column:
    """``value`` with so many more places of its kind to draw; addresses get theirs when drawn."""
    last = F.substring(value, -1, 1)
    wide = (
        F.when(kind == "email", F.concat(F.substring_index(value, "@", 1), F.repeat(F.lit("a"), extra), F.lit("@"), F.substring_index(value, "@", -1)))
        .when(kind == "mac", F.concat(value, F.repeat(F.concat(F.substring(value, 3, 1), F.lit("00")), extra)))
        .when(kind.isin("iban", "ssn", "card", "phone"), F.concat(value, F.repeat(F.lit("0"), extra)))
        .when(kind == "address", value).otherwise(F.concat(value, F.repeat(last, extra)))
    )
    return F.when(extra > 0, wide).otherwise(value)


def _phone(value: Column, seed: Column, extra: Column) -> Column:
    def digit(c, i):
        j = _place_from_end(_national(value), i)
        return F.when(~c.rlike("[0-9]") | (j >= 10 + extra), c).when(j.isin(6, 9) & (extra == 0), _pick("23456789", _draw(seed, j, 8))).otherwise(_pick("0123456789", _draw(seed, j, 10)))

    return F.concat(_country(value), _each(_national(value), digit))


def luhn(value: Column) -> Column:
    """Luhn sum of the digits modulo 10; 0 is valid."""
    digits = F.filter(F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), ""), lambda c: c != "")
    doubled = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10


def _card(value: Column, seed: Column, valid: Column) -> Column:
    """Same grouping; the check digit holds if it held. Leading 9 belongs to no card network."""
    first = F.length(F.regexp_replace(value, "[^0-9]", "")) - 1

    def digit(c, i):
        j = _place_from_end(value, i)
        return F.when(~c.rlike("[0-9]"), c).when(j == first, F.lit("9")).when(j == 0, F.lit("0")).otherwise(_pick("0123456789", _draw(seed, j, 10)))

    def checked(made: Column) -> Column:
        check = F.when(valid, _pick("0123456789", (10 - luhn(made)) % 10)).otherwise(_pick("0123456789", _draw(seed, F.lit(0), 10)))
        return F.concat(F.substring(made, F.lit(1), F.length(made) - 1), check)

    return _let(_each(value, digit), checked)


def _email(value: Column, seed: Column, key: str) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    own = _seed(key, F.lit("domain"), F.lower(domain), F.lit(0))
    labels = F.regexp_replace(domain, r"\.[A-Za-z]+$", "")
    return F.concat(_each(local, lambda c, i: _same_class(c, seed, i)), F.lit("@"), _each(labels, lambda c, i: _same_class(c, own, i)), F.lit(".example"))


def _address(seed: Column, extra: Column) -> Column:
    own = F.concat_ws(".", 240 + _draw(seed, F.lit(0), 15), _draw(seed, F.lit(1), 256), _draw(seed, F.lit(2), 256), 1 + _draw(seed, F.lit(3), 254))
    more = F.transform(F.sequence(F.lit(1), F.greatest(extra, F.lit(1))), lambda i: _draw(seed, 3 + i, 256).cast("string"))
    return F.when(extra > 0, F.concat_ws(".", own, F.array_join(more, "."))).otherwise(own)


def _iban(value: Column, seed: Column) -> Column:
    number = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    written = F.substring(value, F.lit(5), F.length(value))
    place = lambda i: F.length(F.regexp_replace(F.substring(written, F.lit(1), i), " ", ""))
    body = _each(written, lambda c, i: _same_class(c, seed, place(i)))

    def checked(body: Column) -> Column:
        turned = F.split(F.concat(F.regexp_replace(body, " ", ""), F.substring(value, 1, 2), F.lit("00")), "")
        rest = F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda a, c: ((a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + number(c)) % 97).cast("int"))
        return F.concat(F.substring(value, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), body)

    return _let(body, checked)


def _hex(value: Column, seed: Column) -> Column:
    put = lambda c, i: F.when(c.rlike("[0-9a-f]"), _pick("0123456789abcdef", _draw(seed, i, 16))).when(c.rlike("[A-F]"), _pick("0123456789ABCDEF", _draw(seed, i, 16))).otherwise(c)
    return _each(value, put)


def _name(kind: Column, value: Column, seed: Column) -> Column:
    """A pronounceable name in the script, length and capitals of ``value``, ending as its gender does."""

    def in_script(script: str) -> Column:
        return F.struct(*[F.lit(x).alias(n) for x, n in zip(SCRIPTS[script], ("vowels", "consonants", "men", "women"))])

    def spelled(own: Column) -> Column:
        def letter(c, i):
            last = i == F.length(value)
            ending = F.when(kind == "man", own.men).otherwise(own.women)
            inner = F.when((i + _draw(seed, F.lit("phase"), 2)) % 2 == 0, own.vowels).otherwise(own.consonants)
            made = _let(F.when(last, ending).otherwise(inner), lambda symbols: F.substring(symbols, (_draw(seed, i, F.length(symbols)) + 1).cast("int"), F.lit(1)))
            return F.when(c == F.lower(c), made).otherwise(F.upper(made))

        return _each(value, letter)

    script = F.when(value.rlike(r"\p{IsCyrillic}"), in_script("cyrillic")).when(value.rlike(r"\p{IsGreek}"), in_script("greek")).otherwise(in_script("latin"))
    return _let(script, spelled)


def surrogate(kind: Column, value: Column, attempt: Column, key: str = KEY) -> Column:
    """The replacement of one entity, on its given draw."""
    extra = _extra(attempt)

    def drawn(seed: Column) -> Column:
        def of(wide: Column) -> Column:
            return (
                F.when(kind == "email", _email(wide, seed, key)).when(kind == "mac", _hex(wide, seed)).when(kind == "iban", _iban(wide, seed))
                .when(kind == "address", _address(seed, extra)).when(kind == "ssn", _each(wide, lambda c, i: _same_class(c, seed, _place_from_end(wide, i))))
                .when(kind == "card", _card(wide, seed, luhn(value) == 0)).when(kind == "phone", _phone(wide, seed, extra)).otherwise(_name(kind, wide, seed))
            )

        return _let(_widened(kind, value, extra), of)

    return _let(_seed(key, kind, canonical(kind, value), attempt), drawn)


def _told_apart(kind: Column, made: Column) -> Column:
    """The form by which surrogates of canonical forms are compared: all digits of a phone, also of a wider one."""
    return F.when(kind == "phone", made).otherwise(canonical(kind, made))


def _shared_kind(kind: Column) -> Column:
    """Kinds whose surrogates must differ from one another: a man's from a woman's too."""
    return F.when(kind.isin(*NAMES), "name").otherwise(kind)


def collision_exceptions(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first draw was taken; stored. ``found``: distinct (kind, canon).

    Draws are settled per kind, those of all names together: of the entities that
    want one surrogate the earliest attempt, then the smallest canonical form and
    kind, keeps it; no surrogate may equal an original. Widths grow with the
    draws, so the rounds end.
    """
    state = found.withColumn("attempt", F.lit(0))
    among = _shared_kind(F.col("kind")).alias("among")
    originals = found.select(among, F.col("canon").alias("made"), F.lit(1).alias("original")).distinct()
    while True:
        drawn = state.select("*", among, _let(surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key), lambda made: _told_apart(F.col("kind"), made)).alias("made"))
        first = drawn.groupBy("among", "made").agg(F.min(F.struct("attempt", "canon", "kind")).alias("first"), F.count("*").alias("wanted"))
        clash = first.join(originals, ["among", "made"], "left").where("wanted > 1 or original = 1")
        lost = drawn.join(clash, ["among", "made"]).where("original = 1 or canon != first.canon or kind != first.kind").select("kind", "canon", F.lit(1).alias("again"))
        lost = materialize(lost, "collisions")
        if lost.isEmpty():
            return state.where("attempt > 0")
        state = materialize(state.join(lost, ["kind", "canon"], "left").select("kind", "canon", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")), "draws")


def pseudonymised(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten, and n_entities."""
    whole = F.coalesce(F.col(text), F.lit(""))
    held = docs.where("doc_id is not null").withColumn("_names", titled_names(whole))
    listed = held.select("doc_id", F.explode(entities(whole, F.col("_names"))).alias("e")).select("doc_id", "e.kind", canonical(F.col("e.kind"), F.col("e.value")).alias("canon"))
    listed = materialize(listed.distinct(), "entities")
    exceptions = collision_exceptions(listed.select("kind", "canon").distinct(), key)
    attempts = listed.join(exceptions, ["kind", "canon"])
    if attempts.isEmpty():
        held = held.withColumn("_draws", F.lit(None).cast("map<string,int>"))
    else:
        per_doc = attempts.groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("_draws"))
        held = held.join(per_doc, "doc_id", "left")
    held = held.withColumn("_found", entities(whole, F.col("_names")))

    def replaced(e: Column) -> Column:
        taken = F.coalesce(F.element_at("_draws", F.concat_ws("|", e.kind, canonical(e.kind, e.value))), F.lit(0))
        return surrogate(e.kind, e.value, taken, key)

    held = held.withColumn("_made", F.transform("_found", replaced))
    pieces = _searched(whole, F.col("_names"), lambda pattern: F.split(whole, PLAIN if pattern is None else pattern, -1), F.array(whole))
    rebuilt = F.array_join(F.flatten(F.zip_with(pieces, "_made", lambda gap, new: F.array(gap, F.coalesce(new, F.lit(""))))), "")
    out = held.withColumn("n_entities", F.size("_found").cast("long"))
    return out.withColumn(text, F.when(F.size("_found") > 0, rebuilt).otherwise(F.col(text))).drop("_draws", "_found", "_made", "_names")


def surrogate_texts(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(doc_id, n_entities, text) of every document."""
    return pseudonymised(docs.select("doc_id", "text"), key).select("doc_id", "n_entities", "text")
