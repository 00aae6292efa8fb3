"""Personal data replaced by keyed surrogates of the same kind and form (built-in expressions only).

Entities (mail addresses, network addresses, card and phone numbers, access keys, hexadecimal
tokens, titled person names) are found by one pattern; the text is cut at its matches, which are
replaced and joined again. An entity's canonical form (lower case, digits only, ...) is replaced by
a form drawn from a keyed hash: digits by digits, letters by letters of the same script and case
(Latin, with marks or without, Cyrillic, Greek, Armenian; letters of other scripts by Latin ones),
network addresses by addresses, card numbers by numbers with a valid check digit, names by names
of the gender of the title and of the same script. So equal entities get equal surrogates, in
whatever notation they stand.

Surrogates are checked over the whole table: one that two entities of a kind share, or that is itself an
entity of the table, is drawn anew for all but the smallest, until all are distinct. Forms with too few
different surrogates, or with no character to replace, get one more letter at every eighth attempt.

Defined cases: null texts stay null and have no entities; repeated rows get equal results; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointsman.llm.common import attach
from pointsman.session import written

#: Titles by gender, and surrogate names by gender and script.
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "госпожа")}
GIVEN = {
    ("m", "latin"): "Adam Alan Carl Daniel David Edward Felix George Henry Ivan Jacob Karl Leon Martin Nils Oscar Paul Robert Simon Thomas Victor Walter".split(),
    ("f", "latin"): "Alice Anna Bella Clara Diana Elena Emma Flora Grace Helen Irene Julia Karen Laura Maria Nora Olivia Paula Rosa Sarah Teresa Vera".split(),
    ("m", "cyrillic"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман Степан".split(),
    ("m", "greek"): "Αλέξανδρος Ανδρέας Γιώργος Δημήτρης Θωμάς Κώστας Μάρκος Νίκος Πέτρος Σπύρος Χρήστος".split(),
    ("f", "greek"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα".split(),
    ("m", "armenian"): "Արամ Արմեն Գագիկ Դավիթ Կարեն Հայկ Սարգիս Տիգրան".split(),
    ("f", "armenian"): "Աննա Արփի Գայանե Լիլիթ Մարիամ Նարե Սոնա Շուշան".split(),
    ("f", "cyrillic"): "Алина Вера Галина Дарья Елена Жанна Зоя Ирина Лидия Мария Нина Ольга Полина Софья".split(),
}
PATTERNS = {
    "mail": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "address": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "card": r"(?<!\w)\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?!\w)",
    "phone": r"(?<![\w+])(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)",
    "key": r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)",
    "token": r"(?<!\w)[0-9a-f]{32,64}(?!\w)",
    "name": r"(?<!\p{L})(?:" + "|".join(t for g in TITLES.values() for t in g) + r")\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())


def kind_of(value: Column) -> Column:
    """The first kind whose pattern fits the whole match."""
    out = F.lit(None).cast("string")
    for kind, p in reversed(PATTERNS.items()):
        out = F.when(value.rlike(f"^(?:{p})$"), kind).otherwise(out)
    return out


def canonical(kind: Column, value: Column) -> Column:
    """What stays the same in all notations of an entity."""
    return (
        F.when(kind == "mail", F.lower(value))
        .when(kind.isin("card", "phone"), F.regexp_replace(value, r"\D", ""))
        .otherwise(value)
    )


def _pick(names: list[str], draw: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(draw, F.lit(len(names))) + 1).cast("int"))


#: Lower-case letters of scripts beside a-z and the Russian letters, by the script's class in regular expressions.
LETTERS = {
    "Latin": "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "Cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "Armenian": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ",
}


def _alphabet(c: Column, draw: Column) -> Column:
    """A character of the same class: digit, or letter of the same script and case; letters of other scripts become Latin, other characters stay."""
    at = lambda first, n: F.char(F.lit(first) + F.pmod(draw, F.lit(n)))
    out = F.when(c.rlike("[0-9]"), at(48, 10)).when(c.rlike("[a-z]"), at(97, 26)).when(c.rlike("[A-Z]"), at(65, 26))
    for script, letters in LETTERS.items():
        one = F.substring(F.lit(letters), (F.pmod(draw, F.lit(len(letters))) + 1).cast("int"), F.lit(1))
        mine = c.rlike(rf"\p{{Is{script}}}")
        out = out.when(mine & c.rlike(r"\p{Lu}"), F.upper(one)).when(mine & c.rlike(r"\p{L}"), one)
    return out.when(c.rlike(r"\p{Lu}"), at(65, 26)).when(c.rlike(r"\p{L}"), at(97, 26)).otherwise(c)


def _letters(value: Column, seed: Column, keep: Column) -> Column:
    """`value` with every character drawn anew but those at places below 0 of `keep` (a regexp of fixed parts is cut off before)."""
    chars = F.split(value, "")
    drawn = F.transform(chars, lambda c, i: _alphabet(c, F.xxhash64(seed, i)))
    return F.concat(F.array_join(drawn, ""), keep)


def _luhn(digits: Column) -> Column:
    """`digits` with its last digit replaced by the check digit of the others."""
    body = F.reverse(F.split(F.substring(digits, F.lit(1), F.length(digits) - 1), ""))
    total = F.aggregate(
        F.transform(body, lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))),
        F.lit(0), lambda a, x: a + x,
    )
    return F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string"))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical form of the surrogate drawn at this attempt."""
    seed = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, canon, attempt.cast("string")), 256)
    none = F.lit("")
    draw = lambda i: F.xxhash64(seed, F.lit(i))
    fresh = _letters(canon, seed, none)
    tail = F.regexp_extract(canon, r"(\.[^.@]+)$", 1)
    mail = _letters(F.substring(canon, F.lit(1), F.length(canon) - F.length(tail)), seed, tail)
    octet = lambda i: (F.pmod(draw(i), F.lit(254)) + 1).cast("string")
    address = F.concat_ws(".", octet(0), octet(1), octet(2), octet(3))
    # The first digit of a number stays: it tells the kind of card, or the country of a number.
    number = F.concat(F.substring(canon, 1, 1), F.substring(fresh, F.lit(2), F.length(canon)))
    title = F.regexp_extract(canon, r"^(\S+) ", 1)
    words = F.split(F.regexp_extract(canon, r"^\S+ (.*)$", 1), " ")
    script = F.lit("latin")
    for other in ("Cyrillic", "Greek", "Armenian"):
        script = F.when(F.element_at(words, -1).rlike(rf"\p{{Is{other}}}"), other.lower()).otherwise(script)
    woman = F.regexp_replace(title, r"\.$", "").isin(*TITLES["f"])
    given = F.lit(None).cast("string")
    for (g, s), names in GIVEN.items():
        given = F.when((woman == F.lit(g == "f")) & (script == s), _pick(names, draw(9))).otherwise(given)
    last = F.element_at(words, -1)
    # The family name depends on the name itself and the attempt only, so that "Mr A B" and "Mr B" agree while neither clashes.
    drawn = F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit("family"), last, attempt.cast("string")), 256)
    # Every eighth attempt adds a letter, so that there are enough forms in the end.
    more = F.floor(attempt / 8).cast("int")
    family = F.concat(_letters(last, drawn, none), _letters(F.repeat(F.substring(last, -1, 1), more), F.sha2(drawn, 256), none))
    added = _letters(F.repeat(F.lit("x"), more), F.sha2(seed, 256), none)
    name = F.when(F.size(words) > 1, F.concat_ws(" ", title, given, family)).otherwise(F.concat_ws(" ", title, family))
    akia = F.concat(F.lit("AKIA"), _letters(F.substring(canon, F.lit(5), F.length(canon)), seed, none))
    # Hexadecimal digits stay hexadecimal, so that a token's surrogate is a token.
    hexed = F.substring(F.concat(F.sha2(F.concat(seed, F.lit("0")), 256), seed), F.lit(1), F.length(canon))
    return (
        F.when(kind == "mail", F.concat(added, mail)).when(kind == "address", address).when(kind == "card", _luhn(number)).when(kind == "phone", number)
        .when(kind == "name", name).when(kind == "key", akia).when(kind == "token", hexed).otherwise(F.concat(fresh, added))
    )


def _again(value: Column, canon: Column) -> Column:
    """`canon`'s digits in the notation of `value`."""
    chars = F.split(value, "")
    nth = lambda i: F.size(F.filter(F.slice(chars, 1, i + 1), lambda c: c.rlike("[0-9]")))
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(canon, nth(i), F.lit(1))).otherwise(c)), "")


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entity, kind, canon, n and a surrogate that no other entity of the kind has and that is no entity itself."""
    drawn = entities.withColumn("attempt", F.lit(0))
    while True:
        drawn = drawn.withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        drawn = written(drawn, "surrogates")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("first"))
        real = entities.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
        checked = drawn.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        clash = (F.col("canon") != F.col("first")) | F.coalesce("real", F.lit(False))
        if checked.where(clash).isEmpty():
            return drawn
        drawn = checked.select("entity", "kind", "canon", "n", (F.col("attempt") + clash.cast("int")).alias("attempt"))


def pseudonymized(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, and its entities (kind, start in the old text, length, surrogate) of every row."""
    has = F.coalesce(F.col("text"), F.lit("")).rlike(PATTERN)
    hit = docs.select("doc_id", "text").where(has)
    hit = hit.select("doc_id", F.monotonically_increasing_id().alias("row"), F.split("text", PATTERN, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("found"))
    hit = written(hit, "private-texts")
    found = hit.select("row", F.posexplode("found").alias("i", "value"))
    found = found.withColumn("kind", kind_of(F.col("value"))).withColumn("kind", F.coalesce("kind", F.lit("other")))
    found = found.withColumn("canon", canonical(F.col("kind"), F.col("value")))
    found = written(found.withColumn("entity", F.concat_ws("|", "kind", "canon")), "private-entities")
    entities = found.groupBy("entity", "kind", "canon").agg(F.count("*").alias("n"))
    named = distinct_surrogates(entities, key).select("entity", "n", "surrogate")
    total = found.count()
    placed = attach(found, named, "entity", "n", total, F.xxhash64("row", "i"))
    placed = placed.withColumn("new", F.when(F.col("kind").isin("card", "phone"), _again(F.col("value"), F.col("surrogate"))).otherwise(F.col("surrogate")))
    per_row = placed.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", "kind", "new"))).alias("new"))
    joined = hit.join(per_row, "row")
    pieces = F.transform("gaps", lambda g, i: F.concat(g, F.when(i < F.size("new"), F.element_at("new", F.least(i + 1, F.size("new")))["new"]).otherwise("")))
    before = lambda i: F.aggregate(F.slice("gaps", 1, i + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice("found", 1, i), F.lit(0), lambda a, g: a + F.length(g))
    spans = F.transform("new", lambda x, i: F.struct(x["kind"].alias("kind"), before(i).alias("start"), F.length(F.element_at("found", i + 1)).alias("length"), x["new"].alias("surrogate")))
    changed = joined.select("doc_id", F.array_join(pieces, "").alias("text"), spans.alias("entities"))
    kind = "array<struct<kind:string,start:int,length:int,surrogate:string>>"
    clean = docs.where(~has).select("doc_id", "text", F.array().cast(kind).alias("entities"))
    return changed.withColumn("entities", F.col("entities").cast(kind)).unionByName(clean)
