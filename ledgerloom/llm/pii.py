"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Found and validated are card numbers (13 to 19 digits, plain or in groups; Luhn), North American
phone numbers (those with +1 and brackets whatever their area code and exchange), phone numbers of other countries (+, 9 to 15
digits), bank accounts (IBAN: country, length, check digits), social security numbers, IPv4 addresses (octets up to 255), dates
(year-month-day, month/day/year or with an English month, existing days from 1900-01-01, ``DAYS`` of them) and e-mail addresses. What
looks like one and is not valid stays as it is. IPv6 addresses and dates without a year are not looked for.

Each value is permuted by a keyed Feistel network inside its own format. For numbers the state is
a pair (l, r) of Z_a x Z_b with a * b valid values; rounds add a keyed hash of one half to the
other, modulo its size, so every key gives a permutation of the valid values: a card stays a valid
card with its first digit, a date an existing day, an address four octets, a number abroad keeps its first two digits. For e-mail
addresses and bank accounts the halves are strings and a round shifts digits among digits and letters among letters of their case;
the domain and the country stay, check digits are made anew. Signs between digits stay where they are. Equal values get equal pseudonyms
in all documents, whatever signs a card, an account or phone number is written with, and with the key the
permutation can be undone: the caller gives the key, and there is none by default.

Null texts stay null with no finds. Ids do not matter: any, repeated or none, and other columns stay,
whatever they are called; only one called ``pii_found`` gives way to the counts. Texts are whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table, unused

#: The query's key where the session does not set KEY_CONF: for tests, as everybody can read it.
KEY = "a key of the caller's"
KEY_CONF = "spark.ledgerloom.pii.key"
ROUNDS = 8
#: 250 * 292 days from 1900-01-01.
DAYS = (250, 292)

_EMAIL = r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_DAY = r"(?:[12]\d|3[01]|[1-9])"
_DATE = rf"(?<![\d/.-])(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{2}}/\d{{2}}/\d{{4}})(?![\d/-])|(?<![A-Za-z]){_MONTH} {_DAY}, \d{{4}}(?!\d)|(?<![\d/.-]){_DAY} {_MONTH} \d{{4}}(?!\d)"
# fixed values: lengths of bank accounts by country
_IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
    "HR21 HU28 IE22 IL23 IS26 IT27 JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 "
    "SA24 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VG24 XK20"
).split()
_BY_LENGTH = {n: "|".join(x[:2] for x in _IBAN_LENGTHS if x[2:] == n) for n in sorted({x[2:] for x in _IBAN_LENGTHS})}
_IBAN_BODIES = "|".join(rf"(?:{codes})\d\d(?: ?[A-Z0-9]{{4}}){{{int(n) // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{int(n) % 4}}}" if int(n) % 4 else "") for n, codes in _BY_LENGTH.items())
_IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z][A-Z]\d\d)(?:{_IBAN_BODIES})(?![A-Za-z0-9])"
_IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_PHONE = r"\+1[ .-]?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?:\+1[ .-]?|(?<![\d.+-]))(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?!\d)|\+1[2-9]\d{2}[2-9]\d{6}(?!\d)"
_ABROAD = r"(?<![\w+.-])\+[2-9]\d{0,2}(?:[ -]?\(?\d{1,4}\)?){2,5}(?!\d)"
_CARD = r"(?<![\d.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
PATTERN = "|".join((_EMAIL, _IBAN, _DATE, _IP, _SSN, _PHONE, _ABROAD, _CARD))
KINDS = ("email", "date", "ip", "ssn", "phone", "card", "iban")


def _hash(key: str, kind: str, turn: Column, x: Column) -> Column:
    """A keyed 60-bit number."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), x.cast("string"), F.lit(key)), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _permuted(left: Column, right: Column, a: Column, b: Column, key: str, kind: str, rounds: int) -> Column:
    """struct(l, r) of a Feistel network on Z_a x Z_b."""
    state = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    odd = lambda i: i % 2 == 1
    turn = lambda s, i: F.struct(
        F.when(odd(i), F.pmod(s["l"] + _hash(key, kind, i, s["r"]), a)).otherwise(s["l"]).cast("long").alias("l"),
        F.when(odd(i), s["r"]).otherwise(F.pmod(s["r"] + _hash(key, kind, i, s["l"]), b)).cast("long").alias("r"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, turn)


def _named(value: Column, use) -> Column:
    """``use`` of ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _pad(x: Column, width) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def _into(shape: Column, digits: Column, slot: str = "^[0-9]$") -> Column:
    """``shape`` with its digits (what matches ``slot``) replaced, in order, and everything else where it was."""
    step = lambda s, c: F.when(c.rlike(slot), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    """Sum of the digits before the check digit, every second one from the right doubled."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 0, 2 * F.substring(digits, i, F.lit(1)).cast("int")).otherwise(F.substring(digits, i, F.lit(1)).cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))


def _check(digits: Column) -> Column:
    return ((10 - _luhn(digits) % 10) % 10).cast("string")


def _card(x: Column, key: str, rounds: int) -> Column:
    def of(d: Column) -> Column:
        n = F.length(d)
        body = F.substring(d, F.lit(1), n - 1)
        valid = F.substring(d, n, F.lit(1)) == _check(body)
        low = F.floor((n - 2) / 2).cast("int")
        high = n - 2 - low
        halves = _permuted(F.substring(d, F.lit(2), low), F.substring(d, low + 2, high), F.pow(F.lit(10), low).cast("long"), F.pow(F.lit(10), high).cast("long"), key, "card", rounds)
        made = _named(halves, lambda s: F.concat(F.substring(d, 1, 1), _pad(s["l"], low), _pad(s["r"], high)))
        return F.when(valid, _into(x, _named(made, lambda m: F.concat(m, _check(m)))))

    return _named(_digits(x), of)


def _phone(x: Column, key: str, rounds: int) -> Column:
    def of(d: Column) -> Column:
        ten = F.substring(d, F.length(d) - 9, F.lit(10))
        n = lambda a, b: F.substring(ten, a, b).cast("long")
        # numbers outside the numbering plan are permuted among themselves: by low area code, or else by low exchange
        low_area, low_exchange = n(1, 3) < 200, n(4, 3) < 200
        area = F.when(low_area, 0).otherwise(200)
        rest = F.when(low_area | low_exchange, 0).otherwise(2_000_000)
        size = F.when(low_area, 10_000_000).when(low_exchange, 2_000_000).otherwise(8_000_000)
        halves = _permuted(n(1, 3) - area, n(4, 7) - rest, F.when(low_area, 200).otherwise(800), size, key, "phone", rounds)
        made = _named(halves, lambda s: F.concat(F.substring(d, F.lit(1), F.length(d) - 10), _pad(s["l"] + area, 3), _pad(s["r"] + rest, 7)))
        return _into(x, made)

    return _named(_digits(x), of)


def _abroad(x: Column, key: str, rounds: int) -> Column:
    def of(d: Column) -> Column:
        n = F.length(d)
        low = F.floor((n - 2) / 2).cast("int")
        high = n - 2 - low
        halves = _permuted(F.substring(d, F.lit(3), low), F.substring(d, low + 3, high), F.pow(F.lit(10), low).cast("long"), F.pow(F.lit(10), high).cast("long"), key, "abroad", rounds)
        made = _named(halves, lambda s: F.concat(F.substring(d, 1, 2), _pad(s["l"], low), _pad(s["r"], high)))
        return F.when(n.between(9, 15), _into(x, made))

    return _named(_digits(x), of)


def _ssn(x: Column, key: str, rounds: int) -> Column:
    n = lambda a, b: F.substring(x, a, b).cast("long")
    area, group, serial = n(1, 3), n(5, 2), n(8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    halves = _permuted(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn", rounds)
    made = _named(halves, lambda s: F.concat_ws("-", _pad(s["l"] + F.when(s["l"] >= 665, 2).otherwise(1), 3), _pad(F.floor(s["r"] / 9999) + 1, 2), _pad(s["r"] % 9999 + 1, 4)))
    return F.when(valid, made)


def _ip(x: Column, key: str, rounds: int) -> Column:
    octets = F.split(x, r"\.")
    o = lambda k: octets[k].cast("int")
    valid = (o(0) < 256) & (o(1) < 256) & (o(2) < 256) & (o(3) < 256)
    halves = _permuted(o(0) * 256 + o(1), o(2) * 256 + o(3), F.lit(65536), F.lit(65536), key, "ip", rounds)
    parts = lambda v: [F.floor(v / 256).cast("string"), (v % 256).cast("string")]
    return F.when(valid, _named(halves, lambda s: F.concat_ws(".", *parts(s["l"]), *parts(s["r"]))))


def _date(x: Column, key: str, rounds: int) -> Column:
    def of(day: Column) -> Column:
        a, b = DAYS
        n = F.datediff(day, F.lit("1900-01-01").cast("date")).cast("long")
        halves = _permuted(F.floor(n / b), n % b, F.lit(a), F.lit(b), key, "date", rounds)
        to = _named(halves, lambda s: F.date_add(F.lit("1900-01-01").cast("date"), (s["l"] * b + s["r"]).cast("int")))
        shown = F.when(x.contains("/"), F.date_format(to, "MM/dd/yyyy")).when(x.contains(","), F.date_format(to, "MMMM d, yyyy"))
        shown = shown.when(x.contains(" "), F.date_format(to, "d MMMM yyyy")).otherwise(F.date_format(to, "yyyy-MM-dd"))
        return F.when((n >= 0) & (n < a * b), shown)

    iso = F.when(x.contains("/"), F.concat_ws("-", F.substring(x, 7, 4), F.substring(x, 1, 2), F.substring(x, 4, 2))).otherwise(x)
    written = F.try_to_timestamp(F.regexp_replace(x, r"^(\w+) (\d+),", "$2 $1"), F.lit("d MMMM yyyy")).cast("date")
    return _named(F.when(x.contains(" "), written).otherwise(iso.try_cast("date")), of)


def _shifted(text: Column, digest: Column) -> Column:
    """Characters moved inside their class by the bytes of a hexadecimal digest."""

    def one(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        by = F.conv(F.substring(digest, 2 * i - 1, F.lit(2)), 16, 10).cast("int")
        move = lambda base, n: F.chr(F.lit(base) + (F.ascii(c) - base + by) % n)
        return F.when(c.rlike("^[0-9]$"), move(48, 10)).when(c.rlike("^[a-z]$"), move(97, 26)).when(c.rlike("^[A-Z]$"), move(65, 26)).otherwise(c)

    return F.when(F.length(text) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), one), ""))


def _strings(text: Column, key: str, kind: str, rounds: int) -> Column:
    """A Feistel network on the halves of a text, which keeps the class of every character."""
    half = F.floor(F.length(text) / 2).cast("int")
    state = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))
    digest = lambda i, other: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other, F.lit(key)), 256)
    odd = lambda i: i % 2 == 1
    turn = lambda s, i: F.struct(
        F.when(odd(i), _shifted(s["l"], digest(i, s["r"]))).otherwise(s["l"]).alias("l"),
        F.when(odd(i), s["r"]).otherwise(_shifted(s["r"], digest(i, s["l"]))).alias("r"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, turn, lambda s: F.concat(s["l"], s["r"]))


def _email(x: Column, key: str, rounds: int) -> Column:
    return _named(F.substring_index(x, "@", 1), lambda local: F.concat(_strings(local, key, "email", rounds), F.substring(x, F.length(local) + 1, F.length(x))))


def _account_check(country: Column, account: Column) -> Column:
    """The two check digits of a bank account: letters count as 10 to 35, and the whole is 1 modulo 97."""
    code = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda s, c: F.when(c == "", s).otherwise((s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + code(c)) % 97)
    return _pad(98 - F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), step), 2)


def _iban(x: Column, key: str, rounds: int) -> Column:
    def of(whole: Column) -> Column:
        country, account = F.substring(whole, 1, 2), F.substring(whole, F.lit(5), F.length(whole))
        valid = F.substring(whole, 3, 2) == _account_check(country, account)
        made = _named(_strings(account, key, "iban", rounds), lambda m: F.concat(country, _account_check(country, m), m))
        return F.when(valid, _into(x, made, "^[0-9A-Z]$"))

    return _named(F.regexp_replace(x, " ", ""), of)


def _value(x: Column, key: str, rounds: int) -> Column:
    """struct(kind, new): the kind of a valid find and its pseudonym; nulls for others."""
    d = F.length(_digits(x))
    kind = (
        F.when(x.contains("@"), "email").when(x.rlike("^[A-Z][A-Z]"), "iban").when(x.rlike(r"^\d+-\d\d-\d\d$|/|[a-z]"), "date").when(x.rlike(r"^[0-9]+(\.[0-9]+){3}$"), "ip")
        .when(x.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(x.rlike(r"^\+[2-9]"), "abroad").when(d.between(10, 11), "phone").otherwise("card")
    )
    made = {"email": _email, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "abroad": _abroad, "card": _card, "iban": _iban}
    new = lambda k: F.coalesce(*(F.when(k == name, f(x, key, rounds)) for name, f in made.items()))
    return _named(kind, lambda k: F.struct(F.when(k == "abroad", "phone").otherwise(k).alias("kind"), new(k).alias("new")))


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with ``text_col`` replaced, and a map ``pii_found`` of kind to number of valid finds.

    Whoever has ``key`` can undo it; without one it is a ValueError.
    """
    if not key:
        raise ValueError("pseudonyms need a key of the caller's")
    text = F.col(text_col).cast("string")
    some = text.rlike("[0-9@]")
    finds = F.when(some, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    listed = unused(docs, "__pii_finds")
    out = docs.withColumn(listed, F.transform(finds, lambda x: F.struct(x.alias("was"), _value(x, key, rounds).alias("to"))))
    parts = F.split(text, PATTERN, -1)
    news = F.transform(listed, lambda f: F.coalesce(f["to"]["new"], f["was"]))
    rebuilt = F.array_join(F.flatten(F.zip_with(parts, news, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    number = lambda kind: F.size(F.filter(listed, lambda f: (f["to"]["kind"] == kind) & f["to"]["new"].isNotNull()))
    found = F.create_map(*(x for kind in KINDS for x in (F.lit(kind), number(kind))))
    return out.withColumns({text_col: F.when(F.size(listed) > 0, rebuilt).otherwise(text), "pii_found": found}).drop(listed)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(KEY_CONF, KEY))
    return made.select("doc_id", "text", *(F.col("pii_found")[k].cast("long").alias(f"n_{k}") for k in KINDS))
