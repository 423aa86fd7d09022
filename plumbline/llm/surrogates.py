"""Personal data: keyed surrogates of the same type and format.

Detected are e-mail addresses, telephone numbers, IPv4 addresses, card numbers, US social
security numbers, access keys, passwords and tokens, and names after a title.  A surrogate
depends on a secret key, the type and the value, so one value gets one surrogate wherever
it stands (coreference).  It keeps the format: digits stay digits, small letters small,
punctuation stays; hexadecimal strings stay hexadecimal; addresses keep their top-level
label, telephone numbers their country code, access keys their mark, octets stay octets,
card numbers keep a valid check digit if they had one.  Names keep the title, and so the
gender, and are drawn from names of that gender in the script of the original.

Distinctness is checked over all documents: where different values of a type would get the
same surrogate, or one that is itself a value in the texts, all but the smallest value are
drawn anew, until there is none.

Scale: surrogates are computed in place from the match alone; only distinct values are
shuffled for the check, and only redrawn values (few) are joined back.  Texts are never
shuffled.  Rows without a digit, @ or title are passed on by one test.  All expressions
run in the JVM.

Null texts stay null and have no entities; empty tables give no rows; repeated rows are
treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, join_checked

MALE_TITLES, FEMALE_TITLES = ("Mr", "Herr", "Herrn", "Sr", "Señor", "Monsieur", "господин"), ("Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Mme", "Madame", "госпожа")
OTHER_TITLES = ("Dr", "Prof")
GIVEN = {
    "m": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Jonas", "Karl", "Leon", "Max", "Oscar", "Paul", "Simon", "Tom", "Victor"),
    "f": ("Alma", "Berta", "Clara", "Dora", "Emma", "Fiona", "Greta", "Hanna", "Ida", "Julia", "Laura", "Marta", "Nora", "Olga", "Rosa", "Vera"),
    "n": ("Alex", "Andrea", "Chris", "Dominique", "Eden", "Jamie", "Jordan", "Kim", "Luca", "Mika", "Noa", "Quinn", "Robin", "Sascha", "Sam", "Toni"),
}
GIVEN_CYRILLIC = {
    "m": ("Антон", "Борис", "Виктор", "Глеб", "Иван", "Максим", "Олег", "Павел"),
    "f": ("Алла", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"),
    "n": ("Саша", "Женя", "Валя", "Шура", "Паша", "Слава", "Сима", "Лёка"),
}
SYLLABLES = ("bar", "cor", "dal", "fen", "gar", "hol", "jen", "kel", "lan", "mor", "nes", "par", "ros", "sel", "tor", "wen")
SYLLABLES_CYRILLIC = ("бар", "вор", "дал", "зан", "кар", "лан", "мор", "нес", "пал", "рос", "сав", "тор", "фен", "ход", "цар", "шам")

_TITLE = "|".join(sorted((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES), key=len, reverse=True))
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}+"
PHONE = r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w])|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![\w])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.[0-9])"
CARD = r"(?<![\w])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![\w])"
SSN = r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
ACCESS_KEY = r"(?<![\w])AKIA[A-Z0-9]{16}(?![\w])"
SECRET = r"(?<=(?i:token|key|secret|password|passwd|pwd)[ ]{0,2}[=:][ ]{0,2}[\"']{0,1})[A-Za-z0-9_/+-]{8,}+"
NAME = rf"(?<![\p{{L}}])(?:{_TITLE})\.? \p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+)?"
#: In the order in which they are tried at a place.
PATTERNS = {"email": EMAIL, "key": ACCESS_KEY, "secret": SECRET, "ssn": SSN, "ip": IPV4, "card": CARD, "phone": PHONE, "name": NAME}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
WORTH_A_LOOK = rf"[0-9@]|(?:{_TITLE})\.? \p{{Lu}}|(?:[=:][ ]{{0,2}}[\"']?[A-Za-z_/+-]{{8}})"


def entities(text: Column) -> Column:
    """The entities of a text, in order, as written."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(WORTH_A_LOOK), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)


def kind_of(value: Column) -> Column:
    out = F.lit("secret")
    for kind in ("phone", "card", "ip", "ssn", "key", "email", "name"):
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def same_value(kind: Column, value: Column) -> Column:
    """What two spellings of one value share."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(kind == "email", F.lower(value)).when(kind.isin("phone", "card", "ssn"), digits).otherwise(value)


def _stream(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    seed = F.concat_ws("\x1f", F.lit(key), kind, same_value(kind, value), attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{k}")), 256) for k in range(4)])


def _byte(stream: Column, place: Column) -> Column:
    return F.conv(F.substr(stream, F.pmod(place, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(options: tuple[str, ...], draw: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), F.pmod(draw, F.lit(len(options))) + 1)


def _letters(value: Column, stream: Column, hexadecimal: Column, fixed: Column) -> Column:
    """Characters by class, from the ``fixed``-th on; the stream runs over digits and letters only.

    The place in the stream counts letters and digits, so spellings of one number that
    differ in punctuation get the same digits.
    """
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(acc: Column, c: Column) -> Column:
        draw = _byte(stream, acc["n"])
        within = lambda chars: F.substr(F.lit(chars), F.pmod(draw, F.lit(len(chars))) + 1, F.lit(1))
        new = F.when(acc["n"] < fixed, c).when(hexadecimal & c.rlike("[0-9a-f]"), within("0123456789abcdef")).when(
            c.rlike("[0-9]"), within(digits)
        ).when(c.rlike("[a-z]"), within(lower)).when(c.rlike("[A-Z]"), within(upper)).otherwise(c)
        return F.struct(F.concat(acc["out"], new).alias("out"), (acc["n"] + c.rlike("[0-9A-Za-z]").cast("int")).alias("n"))

    return F.aggregate(F.split(value, ""), start, step, lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    """The check sum of a string of digits, modulo 10; 0 is valid."""
    parts = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
    ))
    return F.pmod(F.aggregate(F.filter(parts, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x), F.lit(10))


def surrogate(value: Column, attempt: Column, key: str) -> Column:
    """The replacement of a value; ``attempt`` draws anew."""
    kind = kind_of(value)
    stream = _stream(key, kind, value, attempt)
    never = F.lit(False)
    top = F.regexp_extract(value, r"\.[A-Za-z]+$", 0)
    email = F.concat(_letters(F.regexp_replace(value, r"\.[A-Za-z]+$", ""), stream, never, F.lit(0)), top)
    ip = F.concat_ws(".", *[
        F.when(F.lit(k == 0), F.pmod(_byte(stream, F.lit(k)), F.lit(223)) + 1).otherwise(_byte(stream, F.lit(k))).cast("string") for k in range(4)
    ])
    country = F.length(F.regexp_extract(value, r"^\+([0-9]{1,3})(?![0-9])", 1))
    phone = _letters(value, stream, never, country)
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    drawn = _letters(value, stream, never, F.lit(1))
    zero = F.concat(F.substr(drawn, F.lit(1), F.length(drawn) - 1), F.lit("0"))
    valid = F.concat(F.substr(drawn, F.lit(1), F.length(drawn) - 1), F.pmod(10 - _luhn(digits(zero)), F.lit(10)).cast("string"))
    card = F.when(_luhn(digits(value)) == 0, valid).otherwise(drawn)
    secret = _letters(value, stream, value.rlike("^[0-9a-f]+$"), F.lit(0))
    title = F.regexp_extract(value, rf"^(?:{_TITLE})\.?", 0)
    bare = F.regexp_replace(title, r"\.$", "")
    cyrillic = F.substr(value, F.length(title) + 2).rlike(r"\p{IsCyrillic}")
    gender = F.when(bare.isin(*MALE_TITLES), "m").when(bare.isin(*FEMALE_TITLES), "f").otherwise("n")
    given, family = F.lit(""), F.lit("")
    for script, names, parts in ((False, GIVEN, SYLLABLES), (True, GIVEN_CYRILLIC, SYLLABLES_CYRILLIC)):
        own = cyrillic if script else ~cyrillic
        for g, pool in names.items():
            given = F.when(own & (gender == g), _pick(pool, _byte(stream, F.lit(0)))).otherwise(given)
        made = F.concat(*[_pick(parts, _byte(stream, F.lit(k))) for k in range(1, 4)], F.repeat(_pick(parts, _byte(stream, F.lit(5))), attempt))
        family = F.when(own, F.initcap(made)).otherwise(family)
    two = F.substr(value, F.length(title) + 2).rlike("[ -]")
    name = F.concat(title, F.lit(" "), F.when(two, F.concat(given, F.lit(" "))).otherwise(F.lit("")), family)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "key", _letters(value, stream, never, F.lit(4)))
        .when(kind == "phone", phone).when(kind == "name", name).otherwise(secret)
    )


def redrawn(texts: DataFrame, key: str, scratch: Scratch, text: str = "text") -> DataFrame:
    """(value, attempt) of the values whose first surrogate was taken."""
    kind = kind_of(F.col("value"))
    values = texts.select(F.explode(entities(F.col(text))).alias("value")).distinct()
    values = values.select(kind.alias("kind"), same_value(kind, F.col("value")).alias("same"), "value")
    drawn = scratch.keep(values.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("value"), F.col("attempt"), key)))
    while True:
        claims = drawn.select("kind", same_value(F.col("kind"), F.col("surrogate")).alias("claim"), "same").distinct()
        taken = claims.groupBy("kind", "claim").agg(F.min("same").alias("first"), F.count("*").alias("n")).filter("n > 1")
        originals = drawn.select("kind", F.col("same").alias("claim")).distinct()
        real = claims.join(originals, ["kind", "claim"]).select("kind", "same")
        losers = claims.join(taken, ["kind", "claim"]).filter("same <> first").select("kind", "same")
        again = scratch.keep(losers.unionByName(real).distinct())
        if not again.count():
            return drawn.filter("attempt > 0").select("value", "attempt")
        step = F.when(F.col("hit"), F.col("attempt") + 1).otherwise(F.col("attempt"))
        next_ = drawn.join(again.withColumn("hit", F.lit(True)), ["kind", "same"], "left").select("kind", "same", "value", step.alias("attempt"), "hit", "surrogate")
        next_ = next_.withColumn("surrogate", F.when(F.col("hit"), surrogate(F.col("value"), F.col("attempt"), key)).otherwise(F.col("surrogate")))
        drawn = scratch.keep(next_.drop("hit"))


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All columns, the text with surrogates, and ``entities``: their number in the text."""
    scratch = Scratch(docs.sparkSession)
    again = scratch.keep(redrawn(docs, key, scratch, text))
    count = again.count()
    rows = docs.withColumn("__found", entities(F.col(text)))
    if count:
        named = docs.select(F.xxhash64(text).alias("__row"), F.explode(F.array_distinct(entities(F.col(text)))).alias("value"))
        fixes = join_checked(named, again, "value", "inner", count).groupBy("__row").agg(
            F.map_from_entries(F.collect_set(F.struct("value", "attempt"))).alias("__fix")
        )
        fixes = scratch.keep(fixes)
        rows = join_checked(rows.withColumn("__row", F.xxhash64(text)), fixes, "__row", "left", 8 * fixes.count()).drop("__row")
    else:
        rows = rows.withColumn("__fix", F.lit(None).cast("map<string,int>"))
    attempt = lambda v: F.coalesce(F.col("__fix")[v], F.lit(0))
    new = F.transform("__found", lambda v: surrogate(v, attempt(v), key))
    gaps = F.split(F.col(text), ANY, -1)
    joined = F.array_join(F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda g, s: F.concat(g, s)), "")
    return rows.select(
        *[F.when(F.size("__found") > 0, joined).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in docs.columns if c != "entities"],
        F.greatest(F.size("__found"), F.lit(0)).alias("entities"),
    )
