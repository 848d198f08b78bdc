"""PII surrogates: every detected entity gets a keyed replacement of its own type, gender, script and format.

Entities are found by patterns: e-mail and IP addresses, phone, card and social-security numbers, IBANs, long
hexadecimal secrets, and persons after a form of address (which tells the gender). A replacement is drawn from SHA-256 of
the key, the type, the entity in lower case and a try number: digits stand for digits, letters for letters of the same
case and script, a phone keeps its country code, a card its check digit's validity, a person its form of address and
gender. So an entity has one replacement in the whole corpus (coreference). Different entities that draw the same replacement, or
a replacement that is itself an entity of the corpus, draw again, all but the least of them, until all are distinct. Family
names are entities of their own and settled first, so that "Mr X" and "Ms Y X" keep one family name whatever is drawn again.
No format is ever exhausted: from the second draw on family names have more syllables and persons more given names, and from
draw ``LONGER`` on the other types (but for IP addresses, of which there are four billion) grow by a character a draw.

The table of entities is built by distributed aggregation and joined by entity, salted, as one may stand in a third of the texts;
only texts that hold entities are written and rejoined, by their digest, salted alike. Null and empty texts stay as they are, as does every
text without entities; repeated rows and equal texts get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

KEY = "kvarn-surrogates-1"
LONGER, ROUNDS, SALTS = 8, 1000, 8
_NAME = r"(?:\p{Lu}[\p{L}\p{M}'’-]+)"
#: Forms of address by the gender they tell (m, f, or n for none).
TITLES = {
    "m": ["Mr", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "Господин", "господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "Госпожа", "госпожа"],
    "n": ["Dr", "Prof", "Доктор"],
}
#: Given names by script and gender.
GIVEN = {
    "latin": {
        "m": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noel", "Oscar", "Paul"],
        "f": ["Anna", "Bella", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Katrin", "Laura", "Maria", "Nora", "Olga", "Paula"],
        "n": ["Alex", "Chris", "Dana", "Eden", "Jamie", "Jules", "Kim", "Lee", "Lou", "Morgan", "Noa", "Quinn", "Robin", "Sam", "Sascha", "Toni"],
    },
    "cyrillic": {
        "m": ["Антон", "Борис", "Виктор", "Григорий", "Денис", "Егор", "Захар", "Игорь"],
        "f": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина"],
        "n": ["Саша", "Женя", "Валя", "Слава"],
    },
}
#: Syllables of made-up family names.
SYLLABLES = {
    "latin": ["ba", "be", "da", "del", "fa", "fen", "ga", "hol", "ka", "ken", "la", "lin", "mar", "mo", "na", "nel", "o", "par", "ra", "ren", "sa", "sten", "ta", "tor", "va", "vin", "wa", "wel", "ya", "za", "zel", "zo"],
    "cyrillic": ["ба", "ве", "го", "да", "жу", "за", "ко", "ла", "ми", "но", "ра", "си", "та", "фе", "ше", "ви"],
}
#: Type, and the pattern that finds it. The first that fits at a place counts.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2}(?: ?[0-9]{4}){1,5}(?: ?[0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}]|[.-][0-9])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}]|-[0-9])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\p{L}\p{N}]|[.-][0-9])",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(t for ts in TITLES.values() for t in ts)})\.? {_NAME}(?: {_NAME})?",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these has no entity; it is quicker to look for.
HINT = r"@|[0-9][0-9 ().+-]{5}|[0-9A-Fa-f]{32}|AKIA|gh[pousr]_|sk-|" + rf"(?:{'|'.join(t for ts in TITLES.values() for t in ts)})\.? \p{{Lu}}"


def entities(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(entity: Column) -> Column:
    """The type whose whole pattern fits."""
    out = F.lit("person")
    for name, pattern in reversed([*PATTERNS.items()][:-1]):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def _digest(kind: Column, entity: Column, turn: Column) -> Column:
    """128 hexadecimal digits."""
    part = lambda k: F.sha2(F.concat_ws("\x1f", F.lit(KEY), kind, F.lower(entity), turn.cast("string"), F.lit(k)), 256)
    return F.concat(*[part(k) for k in "0123"])


def _number(digest: Column, place: Column | int, width: int = 4) -> Column:
    """A number below 16 ** width from a place of the digest."""
    at = F.pmod((place if isinstance(place, Column) else F.lit(place)) * 2, F.lit(256 - width)) + 1
    return F.conv(F.substring(digest, at, F.lit(width)), 16, 10).cast("int")


def _letter(c: Column, n: Column) -> Column:
    """A letter of the case and script of ``c``; other characters stay."""
    code = F.ascii(c)
    alike = lambda first, count: F.decode(F.encode(F.substring(F.lit(first), F.pmod(n, F.lit(count)) + 1, F.lit(1)), "UTF-8"), "UTF-8")
    return (
        F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string"))
        .when(c.rlike("[a-z]"), F.char(97 + F.pmod(n, F.lit(26))))
        .when(c.rlike("[A-Z]"), F.char(65 + F.pmod(n, F.lit(26))))
        .when(c.rlike(r"[а-я]"), alike("абвгдежзиклмнопрстуфхцчшыэюя", 28))
        .when(c.rlike(r"[А-Я]"), alike("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", 27))
        .when(c.rlike(r"[α-ω]"), alike("αβγδεζηθικλμνξοπρστυφχψω", 24))
        .when(c.rlike(r"\p{Ll}") & (code > 127), alike("àáâäèéêëìíîïòóôöùúûü", 20))
        .when(c.rlike(r"\p{Lu}") & (code > 127), alike("ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ", 20))
        .otherwise(c)
    )


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _redrawn(text: Column, digest: Column) -> Column:
    return F.array_join(F.transform(_chars(text), lambda c, i: _letter(c, _number(digest, i))), "")


def _luhn(digits: Column) -> Column:
    """The check sum of a string of digits, from its end."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _card(entity: Column, digest: Column) -> Column:
    """Other digits in the same groups; the last makes the check sum right if it was."""
    drawn = F.concat(F.substring(entity, 1, 1), F.substring(_redrawn(entity, digest), 2, 40))
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    off = _luhn(F.concat(F.regexp_replace(body, "[^0-9]", ""), F.lit("0")))
    right = F.concat(body, F.pmod(10 - off, F.lit(10)).cast("string"))
    return F.when(_luhn(F.regexp_replace(entity, "[^0-9]", "")) == 0, right).otherwise(drawn)


def _phone(entity: Column, digest: Column) -> Column:
    code = F.regexp_extract(entity, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    return F.concat(code, _redrawn(F.substring(entity, F.length(code) + 1, F.length(entity)), digest))


def _ip(entity: Column, digest: Column) -> Column:
    return F.array_join(F.transform(F.split(entity, r"\."), lambda o, i: (F.pmod(_number(digest, i * 7), F.lit(254)) + 1).cast("string")), ".")


def _email(entity: Column, digest: Column) -> Column:
    """The last part of the domain stays."""
    top = F.regexp_extract(entity, r"\.\p{L}{2,}$", 0)
    return F.concat(_redrawn(F.substring(entity, F.lit(1), F.length(entity) - F.length(top)), digest), top)


def _iban(entity: Column, digest: Column) -> Column:
    return F.concat(F.substring(entity, 1, 2), _redrawn(F.substring(entity, F.lit(3), F.length(entity)), digest))


def _secret(entity: Column, digest: Column) -> Column:
    hexed = lambda c, i: F.lower(F.conv(F.pmod(_number(digest, i), F.lit(16)).cast("string"), 10, 16))
    low = F.array_join(F.transform(_chars(entity), hexed), "")
    mark = F.regexp_extract(entity, r"^(?:AKIA|gh[pousr]_|sk-)", 0)
    other = F.concat(mark, _redrawn(F.substring(entity, F.length(mark) + 1, F.length(entity)), digest))
    return F.when(entity.rlike("^[0-9a-f]+$"), low).when(entity.rlike("^[0-9A-F]+$"), F.upper(low)).otherwise(other)


def _pick(values: list[str], n: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(n, F.lit(len(values))))


_TITLE = rf"^(?:{'|'.join(t for ts in TITLES.values() for t in ts)})\.?"


def _names(entity: Column) -> Column:
    """The names after the form of address."""
    return F.split(F.substring(entity, F.length(F.regexp_extract(entity, _TITLE, 0)) + 2, F.length(entity)), " ")


def _is_cyrillic(name: Column) -> Column:
    return name.rlike(r"^[\p{IsCyrillic}'’-]+$")


def _family(name: Column, digest: Column, turn: Column) -> Column:
    """A made-up family name of three or four syllables, and one more for each draw after the first."""

    def made(script: str) -> Column:
        count = 3 + F.pmod(_number(digest, 31), F.lit(2)) + turn
        return F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda k: _pick(SYLLABLES[script], _number(digest, 3 * k))), ""))

    return F.when(_is_cyrillic(name), made("cyrillic")).otherwise(made("latin"))


def _person(entity: Column, family: Column, turn: Column) -> Column:
    """The form of address stays; the given names (one, and one more for each draw after the first) have its gender; ``family`` is the family name's replacement."""
    title, names = F.regexp_extract(entity, _TITLE, 0), _names(entity)
    bare = F.regexp_replace(title, r"\.$", "")
    gender = F.when(bare.isin(TITLES["m"]), "m").when(bare.isin(TITLES["f"]), "f").otherwise("n")
    digest = _digest(F.concat(F.lit("given-"), gender), F.get(names, 0), F.lit(0))

    def given(script: str) -> Column:
        first = F.coalesce(*[F.when(gender == g, _pick(GIVEN[script][g], _number(digest, 1))) for g in "mfn"])
        redrawn = _digest(F.lit("more"), entity, turn)
        more = F.transform(F.sequence(F.lit(1), turn), lambda k: F.coalesce(*[F.when(gender == g, _pick(GIVEN[script][g], _number(redrawn, 5 * k))) for g in "mfn"]))
        return F.when(turn == 0, first).otherwise(F.concat_ws("-", first, F.array_join(more, "-")))

    made = F.when(_is_cyrillic(F.get(names, F.size(names) - 1)), given("cyrillic")).otherwise(given("latin"))
    return F.concat_ws(" ", title, F.when(F.size(names) > 1, made), family)


def _longer(kind: Column, value: Column, digest: Column, turn: Column) -> Column:
    """From draw LONGER on, one more character a draw: a letter before an e-mail address, a digit after all else."""
    more = F.transform(F.sequence(F.lit(LONGER), F.greatest(turn, F.lit(LONGER))), lambda k: F.pmod(_number(digest, 3 * k), F.lit(10)).cast("string"))
    digits = F.array_join(more, "")
    grown = F.when(kind == "email", F.concat(F.translate(digits, "0123456789", "abcdefghij"), value)).otherwise(F.concat(value, digits))
    return F.when((turn < LONGER) | (kind == "ip"), value).otherwise(grown)


def drawn(table: DataFrame) -> DataFrame:
    """``table`` (entity, kind, turn) with ``surrogate``, for all kinds but persons."""
    e, turn = F.col("entity"), F.col("turn")
    out = table.withColumn("_digest", _digest(F.col("kind"), e, turn))
    d = F.col("_digest")
    by_kind = {"email": _email(e, d), "secret": _secret(e, d), "iban": _iban(e, d), "card": _card(e, d), "phone": _phone(e, d), "ip": _ip(e, d), "ssn": _redrawn(e, d)}
    value = _longer(F.col("kind"), F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in by_kind.items()]), d, turn)
    return out.withColumn("surrogate", F.when(F.col("kind") == "family", _family(e, d, turn)).otherwise(value)).drop("_digest")


def persons(table: DataFrame) -> DataFrame:
    """``table`` (entity, family, turn) of persons with ``surrogate``."""
    return table.withColumn("surrogate", _person(F.col("entity"), F.col("family"), F.col("turn")))


def _settled(table: DataFrame, draw, known: DataFrame) -> DataFrame:
    """``table`` (entity, turn and more) with surrogates that are all distinct and not among ``known`` (taken)."""
    for _ in range(ROUNDS):
        table = materialise(draw(table), "drawn")
        own = table.select(F.lower("entity").alias("e"), F.lower("surrogate").alias("s")).distinct()
        first = own.groupBy("s").agg(F.min("e").alias("keeper"), F.count("*").alias("n"))
        clash = first.join(known, first["s"] == known["taken"], "left").filter("n > 1 or taken is not null")
        clash = clash.select("s", F.when(F.col("taken").isNull(), F.col("keeper")).alias("keeper"))
        if not clash.limit(1).count():
            return table
        again = (F.col("s").isNotNull()) & (F.col("keeper").isNull() | (F.lower("entity") != F.col("keeper")))
        rest = [c for c in table.columns if c not in ("turn", "surrogate")]
        table = table.join(clash, F.lower("surrogate") == clash["s"], "left").select(*rest, (F.col("turn") + again.cast("int")).alias("turn"))
    raise RuntimeError(f"surrogates still clash after {ROUNDS} draws")


def assigned(found: DataFrame) -> DataFrame:
    """entity, kind, surrogate for each distinct entity of ``found``, all surrogates distinct and none an entity itself. Entities that differ in case only share one."""
    table = materialise(found.select("entity").distinct().withColumn("kind", kind_of(F.col("entity"))).withColumn("turn", F.lit(0)), "entities")
    named = table.filter("kind = 'person'").withColumn("_last", F.lower(F.element_at(_names(F.col("entity")), -1)))
    families = named.select(F.col("_last").alias("entity"), F.lit("family").alias("kind"), F.lit(0).alias("turn")).distinct()
    plain = table.filter("kind <> 'person'").unionByName(families)
    known = plain.select(F.lower("entity").alias("taken")).distinct()
    settled = _settled(plain, drawn, known).select("entity", "kind", "surrogate")
    family = settled.filter("kind = 'family'").select(F.col("entity").alias("_last"), F.col("surrogate").alias("family"))
    known = named.select(F.lower("entity").alias("taken")).distinct()
    people = _settled(named.join(family, "_last").select("entity", "kind", "family", "turn"), persons, known)
    return settled.filter("kind <> 'family'").unionByName(people.select("entity", "kind", "surrogate"))


def _in_row(docs: DataFrame) -> DataFrame:
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    return docs.select(row, docs["text"].alias("_text")).withColumn("_entities", entities(F.col("_text")))


def replaced(docs: DataFrame) -> DataFrame:
    """The row as ``_row``, its new text as ``_text``, and ``_entities`` found in it."""
    held = F.col("_text").rlike(HINT) & F.col("_text").rlike(PATTERN)
    every = _in_row(docs)
    plain = every.filter(~F.coalesce(held, F.lit(False))).select("_row", "_text", F.array().cast("array<string>").alias("_entities"))
    with_some = materialise(every.filter(held).withColumn("_h", F.md5(F.encode("_text", "UTF-8"))), "held")
    pairs = with_some.select("_h", F.explode(F.array_distinct("_entities")).alias("entity")).distinct()
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    table = assigned(pairs).select("entity", "surrogate", salts)
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(SALTS)).cast("int"))
    maps = salted.join(table, ["entity", "_salt"]).groupBy("_h").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("_map"))
    dealt = with_some.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    joined = dealt.join(maps.select("_h", "_map", salts), ["_h", "_salt"]).withColumn("_parts", F.split("_text", PATTERN, -1))
    new = F.array_join(F.transform("_parts", lambda p, i: F.concat(p, F.coalesce(F.col("_map")[F.get("_entities", i)], F.lit("")))), "")
    return joined.select("_row", new.alias("_text"), "_entities").unionByName(plain)
