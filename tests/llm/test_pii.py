import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import pii


def h(kind, i, x):
    return hashlib.sha256(f"{pii.KEY}|{kind}|{i}|{x}|{pii.KEY}".encode()).hexdigest()


def numeric(l, r, a, b, kind, back=False):
    for i in range(pii.ROUNDS, 0, -1) if back else range(1, pii.ROUNDS + 1):
        sign = -1 if back else 1
        if i % 2:
            l = (l + sign * int(h(kind, i, r)[:15], 16)) % a
        else:
            r = (r + sign * int(h(kind, i, l)[:15], 16)) % b
    return l, r


def luhn(body):
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str((10 - total % 10) % 10)


def into(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def card(x):
    d = re.sub(r"\D", "", x)
    low = (len(d) - 2) // 2
    l, r = numeric(int(d[1 : 1 + low]), int(d[1 + low : -1]), 10**low, 10 ** (len(d) - 2 - low), "card")
    body = d[0] + str(l).zfill(low) + str(r).zfill(len(d) - 2 - low)
    return into(x, body + luhn(body))


def ip(x):
    a, b, c, d = map(int, x.split("."))
    l, r = numeric(a * 256 + b, c * 256 + d, 65536, 65536, "ip")
    return f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"


def phone(x):
    d = re.sub(r"\D", "", x)
    t = d[-10:]
    l, r = numeric(int(t[:3]) - 200, (int(t[3:6]) - 200) * 10000 + int(t[6:]), 800, 8_000_000, "phone")
    return into(x, d[:-10] + str(l + 200) + str(r + 2_000_000))


def ssn(x):
    a, g, s = map(int, x.split("-"))
    l, r = numeric(a - (2 if a > 666 else 1), (g - 1) * 9999 + s - 1, 898, 99 * 9999, "ssn")
    return f"{l + (2 if l >= 665 else 1):03d}-{r // 9999 + 1:02d}-{r % 9999 + 1:04d}"


def date(x):
    day = datetime.date.fromisoformat(x) if "-" in x else datetime.datetime.strptime(x, "%m/%d/%Y").date()
    n = (day - datetime.date(1900, 1, 1)).days
    l, r = numeric(n // 292, n % 292, 250, 292, "date")
    to = datetime.date(1900, 1, 1) + datetime.timedelta(l * 292 + r)
    return to.isoformat() if "-" in x else to.strftime("%m/%d/%Y")


def email(x, back=False):
    local, at = x.split("@")
    m = len(local) // 2
    l, r = local[:m], local[m:]

    def shift(text, digest):
        out = ""
        for k, c in enumerate(text):
            by = int(digest[2 * k : 2 * k + 2], 16) * (-1 if back else 1)
            for base, n in (("0", 10), ("a", 26), ("A", 26)):
                if ord(base) <= ord(c) < ord(base) + n:
                    c = chr(ord(base) + (ord(c) - ord(base) + by) % n)
                    break
            out += c
        return out

    for i in range(pii.ROUNDS, 0, -1) if back else range(1, pii.ROUNDS + 1):
        if i % 2:
            l = shift(l, h("email", i, r))
        else:
            r = shift(r, h("email", i, l))
    return l + r + "@" + at


VALID = {
    "4169534335493844" if luhn("416953433549384") == "4" else "41695343354938" + "4" + luhn("416953433549384"): card,
    "4111 1111 1111 1111": card, "3782-822463-10005": card, "378282246310005": card,
    "+1 (832) 555-8455": phone, "415-555-2671": phone, "(212) 555 0187": phone, "+14155552671": phone,
    "69.81.217.52": ip, "255.255.0.1": ip, "123-45-6789": ssn, "899-01-0001": ssn,
    "2024-02-29": date, "1900-01-01": date, "12/31/1999": date,
    "mmp.98@mail2.example.com": email, "A@b.co": email, "First.Last+tag_9@x-y.example.org": email,
}
INVALID = ["4169534335493845", "300.1.1.1", "1.2.3.4.5", "2023-02-29", "13/41/2020", "000-12-3456", "666-12-3456", "1899-12-31", "12345", "a@b", "12 34", "999", "2024-1-1", "x4111111111111111111111111"]


def test_pseudonyms_equal_a_plain_version_and_stay_valid(spark):
    text = " und ".join(["é"] + list(VALID) + INVALID + list(VALID)) + "."
    want = " und ".join(["é"] + [f(v) for v, f in VALID.items()] + INVALID + [f(v) for v, f in VALID.items()]) + "."
    rows = [(1, text, "x"), (1, text, "x"), (None, "call 415-555-2671", "y"), (2, None, "y"), (3, "", "y"), (4, "no finds", "y"), (5, "12 " * 50_000 + "69.81.217.52", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii_found string").drop("pii_found").withColumn("_kind", F.lit(1))
    got = pii.pseudonymised(docs, pii.KEY).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[1].text == want
    assert by[1].pii_found == {"email": 6, "date": 6, "ip": 4, "ssn": 4, "phone": 8, "card": 8, "iban": 0}
    assert by[None].text == "call " + phone("415-555-2671") and by[2].text is None and by[3].text == "" and by[4].text == "no finds"
    assert by[5].text == "12 " * 50_000 + ip("69.81.217.52")
    assert sum(by[2].pii_found.values()) == 0
    for v, f in VALID.items():
        assert f(v) != v and re.sub(r"\w", "w", f(v)).replace("ww", "w") == re.sub(r"\w", "w", v).replace("ww", "w") or f is ip
    assert email(email("mmp.98@mail2.example.com"), back=True) == "mmp.98@mail2.example.com"
    assert pii.pseudonymised(docs.limit(0), pii.KEY).count() == 0


@pytest.mark.parametrize("a, b", [(3, 5), (10, 7)])
def test_the_network_permutes_the_whole_domain(spark, a, b):
    rows = spark.range(a * b).select(pii._permuted(F.floor(F.col("id") / b), F.col("id") % b, F.lit(a), F.lit(b), "k", "t", pii.ROUNDS).alias("s"))
    got = {(r.s.l, r.s.r) for r in rows.collect()}
    assert got == {(i, j) for i in range(a) for j in range(b)}


def test_bracketed_numbers_outside_the_numbering_plan(spark):
    numbers = ["+1 (017) 555-7713", "+1 (117) 055-7713", "+1(917) 155-0001", "+1 (000) 000-0000", "+1 (212) 555-7713"]
    docs = spark.createDataFrame([(i, f"a {x} b") for i, x in enumerate(numbers)] + [(9, "(017) 555-7713 017-555-7713")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(docs, pii.KEY).collect()}
    for i, was in enumerate(numbers):
        now = got[i].text[2:-2]
        assert got[i].pii_found["phone"] == 1 and now != was and re.sub(r"\d", "0", now) == re.sub(r"\d", "0", was)
        a, b = (re.sub(r"\D", "", x) for x in (was, now))
        kind = lambda d: "area" if d[1] < "2" else "exchange" if d[4] < "2" else "valid"
        assert kind(a) == kind(b) and b[0] == "1"
    assert got[9].pii_found["phone"] == 0
    many = spark.createDataFrame([(i, f"+1 (017) 555-{i:04d}") for i in range(300)] + [(300 + i, f"+1 (517) 055-{i:04d}") for i in range(300)], "doc_id long, text string")
    assert len({r.text for r in pii.pseudonymised(many, pii.KEY).collect()}) == 600


def shifted_halves(text, kind):
    """The network on strings, with the plain version of e-mail addresses."""
    l, r = text[: len(text) // 2], text[len(text) // 2 :]
    bases = lambda c: next(((ord(b), n) for b, n in (("0", 10), ("a", 26), ("A", 26)) if ord(b) <= ord(c) < ord(b) + n), None)
    shift = lambda t, d: "".join(chr(b[0] + (ord(c) - b[0] + int(d[2 * k : 2 * k + 2], 16)) % b[1]) if (b := bases(c)) else c for k, c in enumerate(t))
    for i in range(1, pii.ROUNDS + 1):
        l, r = (shift(l, h(kind, i, r)), r) if i % 2 else (l, shift(r, h(kind, i, l)))
    return l + r


def iban(x):
    d = x.replace(" ", "")
    account = shifted_halves(d[4:], "iban")
    rest = int("".join(str(int(c, 36)) for c in account + d[:2] + "00")) % 97
    letters = iter(d[:2] + f"{98 - rest:02d}" + account)
    return "".join(c if c == " " else next(letters) for c in x)


def abroad(x):
    d = re.sub(r"\D", "", x)
    low = (len(d) - 2) // 2
    high = len(d) - 2 - low
    l, r = numeric(int(d[2 : 2 + low]), int(d[2 + low :]), 10**low, 10**high, "abroad")
    return into(x, d[:2] + str(l).zfill(low) + str(r).zfill(high))


def written(x):
    day = datetime.datetime.strptime(x, "%B %d, %Y" if "," in x else "%d %B %Y").date()
    to = datetime.date.fromisoformat(date(day.isoformat()))
    return f"{to:%B} {to.day}, {to.year}" if "," in x else f"{to.day} {to:%B} {to.year}"


ACCOUNTS = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606"]
ABROAD = ["+44 20 7946 0958", "+442079460958", "+49 30 123456", "+33 (0)1-2345-6789"]
WRITTEN = ["February 29, 2024", "1 May 1999", "31 December 2020"]
LEFT = ["DE88 3704 0044 0532 0130 00", "GB82WEST1234569876543", "XX89 3704 0044", "+250 12 34", "February 30, 2024", "31 June 1999", "May 5", "a+44 20 7946 0958"]


def test_accounts_numbers_abroad_and_written_dates(spark):
    text = " | ".join(ACCOUNTS + ABROAD + WRITTEN + LEFT)
    want = " | ".join([iban(x) for x in ACCOUNTS] + [abroad(x) for x in ABROAD] + [written(x) for x in WRITTEN] + LEFT)
    row = pii.pseudonymised(spark.createDataFrame([(1, text)], "doc_id long, text string"), pii.KEY).first()
    assert row.text == want
    assert row.pii_found == {"email": 0, "date": 3, "ip": 0, "ssn": 0, "phone": 4, "card": 0, "iban": 4}
    for x in ACCOUNTS:
        d = iban(x).replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in d[4:] + d[:4])) % 97 == 1 and d[:2] == x[:2] and d != x.replace(" ", "")


def test_columns_of_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, "from 69.81.217.52", "a", "b")], "doc_id long, text string, __pii_finds string, __PII_found string")
    row = pii.pseudonymised(docs, pii.KEY).first().asDict()
    assert row.pop("pii_found")["ip"] == 1
    assert row == {"doc_id": 1, "text": "from " + ip("69.81.217.52"), "__pii_finds": "a", "__PII_found": "b"}


def test_a_key_is_needed(spark):
    with pytest.raises(ValueError):
        pii.pseudonymised(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "")
