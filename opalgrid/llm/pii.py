"""Personal data: detection and keyed surrogates.  DataFrame functions only.

Entities are found by one pattern.  Each distinct entity (type and normal form, so that spellings of
one number, address or name agree) gets a surrogate from SHA-512 of a key, its type, its normal form
and a round number: letters for letters and digits for digits in the same format, valid check digits
for cards and bank accounts, valid octets for addresses, and for names the gender of the title, the
script, and the capitals and joints of the name.

Coreference: one normal form has one surrogate in all documents.  Distinctness: surrogates of one
type must differ from each other and from every entity found; entities that break this move to
their next round until none does (entity with the lowest round and normal form stays).  Only an
initial shows no more than the first letter of its surrogate.

Each text is searched once, and its entities are stored beside it.  Texts without entities are never
shuffled.  Entities are collected by distinct text, so copies of a text are handled once;
occurrence counts meet in partial aggregates only.

Defined results: null texts stay null and empty texts empty; repeated rows give repeated rows; an
empty table gives an empty one; an entity is replaced whole, however long it or its text is; text
outside entities is unchanged; other columns, whatever their names, are kept by ``mask`` and not
looked at, but for n_chars.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalgrid.llm._store import drop, stored

KEY, ROUNDS = "opalgrid", 32
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Г-жа")
NEUTRAL = ("Dr", "Prof", "Mx")
TITLES = tuple(sorted({v for t in MALE + FEMALE + NEUTRAL for v in (t, t.upper())}, key=lambda t: (-len(t), t)))
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
GROUP = r"[0-9A-Fa-f]{1,4}"
VALUE = r"[^\s\"',;]{4,}(?<![.!?:)])"  # a sentence's end is no part of it
# What names a secret, up to the value.  After "secret" and "token" and a blank, prose is left alone:
# there the value must hold a digit.
LABEL = r"(?i:(?:passw(?:or)?d|pwd|passphrase|api[_-]?key|access[_-]?key|client[_-]?secret)[\"']?\s*+[=:]\s*+[\"']?|(?:secret|token)[\"']?\s*+(?:[=:](?=[^\s\"',;])|[=:]\s*+[\"']?(?=[^\s\"',;\d]*+\d)))"
LETTERS = r"[\p{L}\p{M}]"
NAME = rf"(?:\p{{Lu}}\.|\p{{Lu}}{LETTERS}*+(?:['’]\p{{Lu}}{LETTERS}*+|-{LETTERS}++)*+|\p{{IsHan}}++)"
# Kinds with a length of their own have an upper limit; the others take a whole token, possessively,
# so that long ones need no backtracking.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
AWS = r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
HEX = r"(?=[a-f]*+\d)[0-9a-f]{32,}+(?![A-Za-z0-9])"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IP6 = rf"(?<![:.\w])(?:(?:{GROUP}:){{7}}{GROUP}|(?=[a-fA-F:]*+\d)(?:(?:{GROUP}:){{1,6}}(?::{GROUP}){{1,6}}|(?:{GROUP}:){{2,7}}:))(?![:\w])"
TITLED = rf"(?<!{LETTERS})(?:{'|'.join(TITLES)})\.? {NAME}(?: {NAME}){{0,3}}"
IP = rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)"
CARD = r"(?<![\d+])(?:\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3}(?![\d-]))?|\d(?:[ -]?\d){12,18})(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"
# In this order; the first that fits at a place wins.  What comes first in a group only saves time.
PATTERN = rf"(?=[pPaAcCsStT]){LABEL}{VALUE}|(?<![A-Za-z0-9])(?:{EMAIL}|{AWS}|{HEX}|{IBAN}|{IP6}|{TITLED})|(?=[+(\d])(?:{IP}|{CARD}|{SSN}|{PHONE})"
# Syllables of the surrogate names, by script; single characters for Chinese ones.
SYLLABLES = {
    "latin": "bal ber cor dan del fen gar hol jor kel lan mar nor ol per quin ros sal tor val wes yor zan mil ned rud".split(),
    "cyrillic": "бал бер вор дан дел ген гор жан кел лан мар нор ол пер рос сал тор вал зан мил нед руд лев тим".split(),
    "greek": "βαλ γερ δαν δελ ζαν θορ καλ κορ λαν λευ μαρ μιλ νορ νεδ παν περ ροσ σαλ ταν τορ φεν χαλ".split(),
}
ENDINGS = {
    "latin": {"m": "on", "f": "a", "x": "is", "family": "er"},
    "cyrillic": {"m": "ан", "f": "а", "x": "ис", "family": "ко"},
    "greek": {"m": "ος", "f": "α", "x": "ις", "family": "ου"},
}
HAN = {"m": "伟强军勇杰涛明刚平辉鹏华", "f": "芳娜敏静丽娟霞玲梅燕莉雪", "x": "文安宁晨青佳思远新悦林云", "family": "赵钱孙周吴郑冯陈褚卫蒋沈"}
DIGIT_TYPES = ("card", "ssn", "phone")


def _maybe(text: Column) -> Column:
    """Cheap test that every text with an entity passes."""
    return text.rlike(r"[0-9@=:]|AKIA|ASIA") | reduce(lambda a, b: a | b, (text.contains(t + s) for t in TITLES for s in (" ", ". ")))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is taken once, however often ``use`` names it.

    Without this each mention is a copy of the value's whole expression.  Copies within copies would make
    plans of many thousand expressions, which the driver holds several times over while it plans and logs."""
    return F.element_at(F.transform(F.array(value), lambda bound: use(bound)), 1)


def _label(token: Column) -> Column:
    """The part of a token that names a secret; empty in other tokens."""
    return F.regexp_extract(token, "^" + LABEL, 0)


def _value_of(token: Column, label: Column | None = None) -> Column:
    return F.substring(token, F.length(_label(token) if label is None else label) + 1, F.length(token))


def _type(token: Column) -> Column:
    """The kind of a token that PATTERN has found, from its own form; a secret's value has its own."""
    return _bound(_label(token), lambda label: _type_after(token, label))


def _type_after(token: Column, label: Column) -> Column:
    digits = F.length(F.regexp_replace(token, r"\D", ""))
    only = token.rlike(r"^[\d ()+.-]+$")
    titled = token.rlike(rf"^(?:{'|'.join(TITLES)})\.? [\p{{Lu}}\p{{IsHan}}]")
    value = _value_of(token, label)
    return (
        F.when(titled, "name")
        .when(value.rlike(rf"^{AWS}$"), "aws")
        .when(value.rlike(rf"^{HEX}$"), "hex")
        .when(label != "", "secret")
        .when(token.contains("@"), "email")
        .when(only & token.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), "ip")
        .when(token.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "ip6")
        .when(only & token.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(only & ~token.rlike(r"[+(.]") & digits.between(13, 19), "card")
        .when(only & (digits >= 7) & token.rlike(r"^[+(\d]"), "phone")
        .when(token.rlike(rf"^{IBAN}$"), "iban")
        .otherwise("secret")
    )


def _names(token: Column) -> Column:
    """What follows the title."""
    return F.substring(token, F.instr(token, " ") + 1, F.length(token))


def _pieces(token: Column) -> Column:
    """The runs of letters of a name."""
    return F.regexp_extract_all(_names(token), F.lit(f"({LETTERS}+)"), F.lit(1))


def _titled_as(token: Column, titles) -> Column:
    title = F.upper(F.regexp_replace(F.substring_index(token, " ", 1), r"\.$", ""))
    return title.isin(*[t.upper() for t in titles])


def _parts(token: Column) -> Column:
    """A token's entities: array<struct<kind, form>>.  A name gives those before its last and its last."""
    return _bound(_type(token), lambda kind: _parts_of(token, kind))


def _parts_of(token: Column, kind: Column) -> Column:
    """The entities of a token of a kind."""
    gender = F.when(_titled_as(token, MALE), "m").when(_titled_as(token, FEMALE), "f").otherwise("x")

    def piece(p, i, n):
        script = F.when(p.rlike(r"\p{IsHan}"), "han").when(p.rlike(r"\p{IsCyrillic}"), "cyrillic").when(p.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
        role = F.when(i == n - 1, "family").otherwise(gender)
        return F.struct(F.concat(role, F.lit(":"), script).alias("kind"), F.lower(p).alias("form"))

    digits = F.regexp_replace(token, r"\D", "")
    # a leading 1 before ten digits is the country code of the same number
    number = F.when((kind == "phone") & digits.rlike(r"^1\d{10}$"), F.substring(digits, F.lit(2), F.lit(10))).otherwise(digits)
    form = F.when(kind.isin(*DIGIT_TYPES), number).when(kind == "iban", F.replace(token, F.lit(" "), F.lit(""))).when(kind.isin("email", "ip6"), F.lower(token)).otherwise(_value_of(token))
    named = _bound(_pieces(token), lambda pieces: F.transform(pieces, lambda p, i: piece(p, i, F.size(pieces))))
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), form.alias("form"))))


def _stream(key: str, kind: Column, form: Column, turn: Column) -> Column:
    """256 hex digits that the key, the entity and the round determine."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, form, turn.cast("string"))
    return F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("\x1f+")), 512))


def _value(stream: Column, at: Column) -> Column:
    """A number from 0 to 255 for place ``at`` (from 1)."""
    return F.conv(F.substring(stream, (F.pmod(at - 1, F.lit(128)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, number: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(number, F.lit(len(alphabet))) + 1, F.lit(1))


def _reshape(form: Column, stream: Column, keep: Column, hexadecimal: bool = False) -> Column:
    """Each letter or digit after the first ``keep`` characters becomes another of its class."""
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def one(c, i):
        p = i + 1
        v = _value(stream, p)
        if hexadecimal:
            return F.when((p <= keep) | (c == ":"), c).otherwise(_pick("0123456789abcdef", v))
        return F.when(p <= keep, c).when(c.rlike("[a-z]"), _pick(lower, v)).when(c.rlike("[A-Z]"), _pick(upper, v)).when(c.rlike("[0-9]"), _pick(digit, v)).otherwise(c)

    # characters as an array: to look each up by its place takes the square of the length
    return F.array_join(F.transform(F.regexp_extract_all(form, F.lit("(?s)."), F.lit(0)), one), "")


def _luhn(digits: Column) -> Column:
    """Digits with the last replaced by the check digit."""
    n = F.length(digits)

    def weight(p):
        d = F.substring(digits, p, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(F.pmod(n - p, F.lit(2)) == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n - 1), weight), F.lit(0), lambda a, x: a + x)
    return F.concat(F.substring(digits, F.lit(1), n - 1), F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))


def _iban(form: Column) -> Column:
    """An account number with its check digits set (98 less the rest by 97, letters count from 10)."""
    moved = F.concat(F.substring(form, F.lit(5), F.length(form)), F.substring(form, F.lit(1), F.lit(2)), F.lit("00"))

    def step(rest, c):
        code = F.ascii(c)
        return F.pmod(F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48), F.lit(97))

    rest = F.aggregate(F.regexp_extract_all(moved, F.lit("."), F.lit(0)), F.lit(0), step)
    return F.concat(F.substring(form, F.lit(1), F.lit(2)), F.lpad((F.lit(98) - rest).cast("string"), 2, "0"), F.substring(form, F.lit(5), F.length(form)))


def _name(kind: Column, form: Column, stream: Column, turn: Column) -> Column:
    """A name in lower case; longer for later rounds."""

    def run(choices, first, n):
        """n of the choices, picked by the stream from place ``first`` on."""
        table = F.array(*[F.lit(c) for c in choices])
        picked = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.element_at(table, F.pmod(_value(stream, k * 2 + first) * 256 + _value(stream, k * 2 + first + 1), F.lit(len(choices))) + 1))
        return F.when(n > 0, F.array_join(picked, "")).otherwise("")

    out = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        own = F.concat(run(syllables, -1, F.lit(4)), run(syllables, 8, F.least(F.lit(4), turn - 3)))
        for role, ending in ENDINGS[script].items():
            out = F.when(kind == f"{role}:{script}", F.concat(own, F.lit(ending))).otherwise(out)
    for role, alphabet in HAN.items():
        out = F.when(kind == f"{role}:han", run(alphabet, -1, F.length(form) + F.greatest(F.lit(0), turn - 1))).otherwise(out)
    return out


def surrogate(kind: Column, form: Column, turn: Column, key: str = KEY) -> Column:
    """The surrogate of a normal form in a round."""
    # bound, or the digests would be taken again for each character
    return _bound(_stream(key, kind, form, turn), lambda s: _from_stream(kind, form, turn, s))


def _from_stream(kind: Column, form: Column, turn: Column, s: Column) -> Column:
    country = F.greatest(F.lit(0), F.length(form) - 10)
    octets = F.concat_ws(".", *[(F.pmod(_value(s, F.lit(2 * k + 1)) * 256 + _value(s, F.lit(2 * k + 2)), F.lit(222 if k == 0 else 254)) + 1).cast("string") for k in range(4)])
    address = (kind == "email") & (F.instr(form, "@") > 0)
    dots = F.when(address, F.substring_index(form, ".", -1)).otherwise("")
    keep = F.when(kind == "card", F.lit(1)).when(kind == "phone", country).when(kind.isin("aws", "iban"), F.lit(4)).otherwise(F.lit(0))
    # one expression for all kinds that only differ in what is kept
    shape = _bound(keep, lambda kept: _reshape(F.substring(form, F.lit(1), F.length(form) - F.length(dots)), s, kept))

    def shaped(new):
        return (
            F.when(kind == "card", _luhn(new))
            .when(kind == "phone", F.overlay(new, _pick("23456789", _value(s, F.lit(120))), country + 1))
            .when(kind.isin("ssn", "aws"), new)
            .when(address, F.concat(new, dots))
            .when(kind == "iban", _iban(new))
            # a secret grows in later rounds, as short ones can run out
            .otherwise(F.concat(new, F.substring(s, F.lit(1), F.greatest(F.lit(0), turn - 7))))
        )

    return (
        F.when(kind == "ip", octets)
        .when(kind.isin("hex", "ip6"), _reshape(form, s, F.lit(0), True))
        .when(kind.contains(":"), _name(kind, form, s, turn))
        .otherwise(_bound(shape, shaped))
    )


def assign(entities: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """(kind, form, surrogate) of distinct entities (kind, form); surrogates of a kind differ from
    each other and from all forms.  Raises RuntimeError if ``rounds`` do not settle it."""
    spark = entities.sparkSession
    # a number of its own, or few short rows would be read, and their costly surrogates made, in one task
    entities = entities.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "kind", "form")
    named = stored(entities.select("kind", "form", F.lit(0).alias("turn"), surrogate(F.col("kind"), F.col("form"), F.lit(0), key).alias("surrogate")), "surrogates")
    for turn in range(1, rounds + 1):
        first = named.groupBy("kind", "surrogate").agg(F.min(F.struct("turn", "form")).alias("first"), F.count("*").alias("n")).where("n > 1").select("kind", "surrogate", "first")
        taken = named.select("kind", F.col("form").alias("surrogate"), F.lit(True).alias("taken"))
        # both sides hold one row per entity
        bad = named.join(first, ["kind", "surrogate"], "left").join(taken, ["kind", "surrogate"], "left")
        bad = bad.withColumn("bad", F.col("taken").isNotNull() | (F.col("first").isNotNull() & (F.struct("turn", "form") != F.col("first"))))
        if bad.where("bad").isEmpty():
            return named.select("kind", "form", "surrogate")
        again = surrogate(F.col("kind"), F.col("form"), F.lit(turn), key)
        old = named
        named = stored(bad.select("kind", "form", F.when(F.col("bad"), F.lit(turn)).otherwise(F.col("turn")).alias("turn"), F.when(F.col("bad"), again).otherwise(F.col("surrogate")).alias("surrogate")), "surrogates")
        drop(old)
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")


def _render(token: Column, names: Column) -> Column:
    """A token with its entities replaced, in its own format."""

    def of(part):
        return F.element_at(names, F.concat(part["kind"], F.lit("\x1f"), part["form"]))

    def render(kind):
        return _bound(_parts_of(token, kind), lambda parts: F.when(kind == "name", _render_name(token, parts, of)).otherwise(_bound(of(parts[0]), lambda plain: _render_plain(token, kind, plain))))

    return _bound(_type(token), render)


def _render_plain(token: Column, kind: Column, plain: Column) -> Column:
    """A token other than a name with its entity's surrogate, in its own format."""
    plain = F.when((kind == "phone") & token.rlike(r"^\D*1(?:\D*\d){10}\D*$"), F.concat(F.lit("1"), plain)).otherwise(plain)
    filled = F.aggregate(
        F.sequence(F.lit(1), F.length(token)),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("next")),
        lambda a, p: F.when(
            F.substring(token, p, F.lit(1)).rlike("[A-Z0-9]"),
            F.struct(F.concat(a["out"], F.substring(plain, a["next"], F.lit(1))).alias("out"), (a["next"] + 1).alias("next")),
        ).otherwise(F.struct(F.concat(a["out"], F.substring(token, p, F.lit(1))).alias("out"), a["next"].alias("next"))),
        lambda a: a["out"],
    )
    plain6 = F.when(token.rlike("[A-F]"), F.upper(plain)).otherwise(plain)
    return F.when(kind.isin(*DIGIT_TYPES, "iban"), filled).when(kind == "ip6", plain6).otherwise(F.concat(_label(token), plain))


def _render_name(token: Column, parts: Column, of: Callable[[Column], Column]) -> Column:
    """A name with the surrogates of its parts, in its own capitals and joints."""

    def in_form(new, old):
        capitals = (F.length(old) > 1) & (F.upper(old) == old) & ~old.rlike(r"\p{IsHan}")
        one = (F.length(old) == 1) & ~old.rlike(r"\p{IsHan}")
        return F.when(one, F.upper(F.substring(new, F.lit(1), F.lit(1)))).when(capitals, F.upper(new)).otherwise(F.initcap(new))

    def written(part, old):
        return _bound(of(part), lambda new: in_form(new, old))

    between = F.split(_names(token), f"{LETTERS}+", -1)
    names_ = F.array_join(F.zip_with(between, F.zip_with(parts, _pieces(token), written), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.concat(F.substring_index(token, " ", 1), F.lit(" "), names_)


def mask(documents: DataFrame, key: str = KEY, count: str | None = None) -> DataFrame:
    """documents with the entities in text replaced; ``count`` names a column for their number.

    A column n_chars, where there is one, is set to the new length."""
    text = F.col("text").cast("string")
    tokens = F.when(_maybe(text), F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1)))
    # written, so that the pattern is matched once
    rows = stored(documents.withColumn("text", text).select("*", F.when(F.size(tokens) > 0, tokens).alias("__pii_tokens")), "tokens")
    some = rows.where("__pii_tokens is not null").withColumn("__pii_a", F.xxhash64("text")).withColumn("__pii_b", F.xxhash64(F.lit(1), "text", F.length("text")))
    found = some.select("__pii_a", "__pii_b", F.explode(F.flatten(F.transform("__pii_tokens", _parts))).alias("e")).select("__pii_a", "__pii_b", "e.kind", "e.form").distinct()
    found = stored(found, "entities")
    names = assign(found.select("kind", "form").distinct(), key)
    entry = F.struct(F.concat("kind", F.lit("\x1f"), "form"), "surrogate")
    maps = found.join(names, ["kind", "form"]).groupBy("__pii_a", "__pii_b").agg(F.map_from_entries(F.collect_list(entry)).alias("__pii_names"))
    joined = some.join(maps, ["__pii_a", "__pii_b"])
    between = F.split("text", PATTERN, -1)
    masked = F.array_join(F.zip_with(between, F.transform("__pii_tokens", lambda t: _render(t, F.col("__pii_names"))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    def out(df: DataFrame, new: Column, number: Column) -> DataFrame:
        df = df.withColumn("__pii_new", new).withColumn("__pii_number", number)
        columns = [F.col("__pii_new").alias("text") if c == "text" else F.length("__pii_new").cast(documents.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in documents.columns]
        return df.select(*columns, *([F.col("__pii_number").alias(count)] if count else []))

    plain = out(rows.where("__pii_tokens is null"), F.col("text"), F.lit(0).cast("long"))
    return out(joined, masked, F.size("__pii_tokens").cast("long")).unionByName(plain)
