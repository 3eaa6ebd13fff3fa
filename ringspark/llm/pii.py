"""PII: format-preserving Feistel pseudonyms.

Validated numbers and dates (cards by their check digit, phone numbers, social
security numbers, IPv4 addresses, calendar dates) and e-mail names are replaced by a
keyed permutation of their own format: a card stays a card with a right check digit, a
date stays a date written the same way.  The permutation depends on the kind and the
key alone, so equal values get equal pseudonyms in all documents, and different values
different ones.

Numbers: the value's index in its format's domain, whose size is exactly a * b, goes
through alternating Feistel rounds, L := (L + F(R)) mod a, then R := (R + F(L)) mod b, F being
SHA-256 of key, kind, round and half; so every valid value is replaced and no two values
meet.  Domains: cards by number of digits, 10^(n-2) behind a fixed first digit; phone numbers of
ten digits whose area and exchange begin with 2 to 9 (80000 * 80000) and all others
(60000 * 60000); international numbers by number of digits behind the world zone; SSNs
898 * 99 * 9999; addresses 2^16 * 2^16; the 73049 days of 1900 to 2099 (17 * 4297).
E-mail names: the same on strings, each letter or digit being shifted within its class.

Phones: ten digits in groups, with or without 1 before them, and numbers of 8 to 15 digits in any
grouping behind a plus sign.  Ten digits in one run, without a plus sign, are no phone number here.

Built-in functions only: a text is split at its findings, the findings are mapped and
the pieces joined again.  Texts without a digit next to a separator or an ``@`` pass
through one regular expression and nothing else.  Defined results: null stays null, empty
stays empty, what fails its validation stays as it is; repeated rows get equal texts, and an empty
table gives an empty result.  A caller's column with the result's name is kept under the
next free name (``pii_1``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, make_room

ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}"  # a name has 127 labels at most; an open repeat would recurse
DATE = r"(?<![0-9./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![0-9]|[./-]\d)"
SSN = r"(?<![0-9-])\d{3}-\d{2}-\d{4}(?![0-9]|-\d)"
IP = r"(?<![0-9.])\d{1,3}(?:\.\d{1,3}){3}(?![0-9]|\.\d)"
PHONE = r"(?<![0-9A-Za-z+-])(?:\+1\d{10}|(?:\+?1[ .-]|\+1)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})(?![0-9]|-\d)"
ABROAD = r"(?<![0-9A-Za-z+])\+[2-9](?:[ .-]?\(?\d\)?){7,14}(?![0-9])"
CARD = r"(?<![0-9A-Za-z.-])(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![0-9A-Za-z]|[.-]\d)"
KINDS = {"email": EMAIL, "date": DATE, "ssn": SSN, "ip": IP, "phone": PHONE, "abroad": ABROAD, "card": CARD}
ANY = "|".join(KINDS.values())
DAYS = (17, 4297)  # 1900-01-01 to 2099-12-31 has 17 * 4297 days


def let(value: Column, f) -> Column:
    """f(value), the value being computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _number(key: str, kind: str, turn: Column, half: Column) -> Column:
    """48 bits of SHA-256."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def feistel(value: Column, a: int, b: int, key: str, kind: str, back: bool = False, rounds: int = ROUNDS) -> Column:
    """A permutation of the longs from 0 to a * b - 1; ``back`` undoes it."""
    sign = -1 if back else 1
    start = F.struct(F.call_function("div", value, F.lit(b)).cast("long").alias("l"), (value % b).cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + _number(key, kind, i, s["r"]) % a * sign, F.lit(a))
        right = F.pmod(s["r"] + _number(key, kind, i, s["l"]) % b * sign, F.lit(b))
        return F.struct(F.when(i % 2 == 0, left).otherwise(s["l"]).cast("long").alias("l"), F.when(i % 2 == 1, right).otherwise(s["r"]).cast("long").alias("r"))

    turns = range(rounds - 1, -1, -1) if back else range(rounds)
    return F.aggregate(F.array(*map(F.lit, turns)), start, turn, lambda s: s["l"] * b + s["r"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _fill(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced, one after the other."""
    put = lambda s, c: F.when(
        c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(digits, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))
    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), put, lambda s: s["out"])


def _pad(number: Column, n: int) -> Column:
    return F.lpad(number.cast("string"), n, "0")


def luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10; 0 for a right card number."""
    n = F.length(digits)

    def one(i: Column) -> Column:
        v = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, v).otherwise(F.when(v > 4, v * 2 - 9).otherwise(v * 2))

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), one), F.lit(0), lambda s, x: s + x) % 10


def _card(m: Column, key: str) -> Column:
    """The first digit stays; the rest but the check digit is permuted, by number of digits."""

    def of(d: Column) -> Column:
        out = m
        for n in range(13, 20):
            free = n - 2
            a, b = 10 ** (free // 2), 10 ** (free - free // 2)
            value = F.substring(d, 2, free).cast("long")
            body = F.concat(F.substring(d, 1, 1), _pad(feistel(value, a, b, key, f"card{n}"), free))
            whole = let(body, lambda p: F.concat(p, ((10 - luhn(F.concat(p, F.lit("0")))) % 10).cast("string")))
            out = F.when(F.length(d) == n, _fill(m, whole)).otherwise(out)
        return F.when(luhn(d) == 0, out).otherwise(m)

    return let(_digits(m), of)


def _phone(m: Column, key: str) -> Column:
    """The area, exchange and line; where area and exchange begin with 2 to 9 they still do, and else they still don't."""

    def of(d: Column) -> Column:
        area, office, line = (F.substring(d, a, n).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
        value = ((area - 200) * 800 + office - 200) * 10000 + line
        numbered = let(
            feistel(value, 80000, 80000, key, "phone"),
            lambda x: F.concat(
                (F.call_function("div", x, F.lit(8000000)) + 200).cast("string"), (F.call_function("div", x, F.lit(10000)) % 800 + 200).cast("string"), _pad(x % 10000, 4)
            ),
        )
        # The others: 200 areas with all exchanges, then 800 areas with 200 exchanges each.
        low = 200 * 1000 * 10000
        other = F.when(area < 200, (area * 1000 + office) * 10000 + line).otherwise(low + ((area - 200) * 200 + office) * 10000 + line)
        loose = let(
            feistel(other, 60000, 60000, key, "phone0"),
            lambda x: F.when(x < low, _pad(x, 10)).otherwise(
                F.concat(
                    (F.call_function("div", x - low, F.lit(2000000)) + 200).cast("string"), _pad(F.call_function("div", x - low, F.lit(10000)) % 200, 3), _pad((x - low) % 10000, 4)
                )
            ),
        )
        return F.when((area >= 200) & (office >= 200), numbered).otherwise(loose)

    code = F.regexp_extract(m, r"^(?:\+?1[ .-]|\+1)", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.concat(code, _fill(rest, let(_digits(rest), of)))


def _abroad(m: Column, key: str) -> Column:
    """The digits behind the first, which is the world zone, by their number."""

    def of(d: Column) -> Column:
        out = d
        for n in range(8, 16):
            free = n - 1
            body = F.substring(d, 2, free).cast("long")
            out = F.when(F.length(d) == n, F.concat(F.substring(d, 1, 1), _pad(feistel(body, 10 ** (free // 2), 10 ** (free - free // 2), key, f"abroad{n}"), free))).otherwise(out)
        return out

    return _fill(m, let(_digits(m), of))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    index = area - 1 - (area > 666).cast("long")  # of 898 areas: 1 to 899 without 666
    value = (index * 99 + group - 1) * 9999 + serial - 1

    def of(x: Column) -> Column:
        i = F.call_function("div", x, F.lit(99 * 9999))
        return F.concat_ws("-", _pad(i + 1 + (i >= 665).cast("long"), 3), _pad(F.call_function("div", x, F.lit(9999)) % 99 + 1, 2), _pad(x % 9999 + 1, 4))

    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, let(feistel(value, 898 * 99, 9999, key, "ssn"), of)).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    out = let(feistel(value, 1 << 16, 1 << 16, key, "ip"), lambda x: F.concat_ws(".", *[(F.call_function("shiftright", x, F.lit(s)) % 256).cast("string") for s in (24, 16, 8, 0)]))
    return F.when(F.forall(parts, lambda x: x <= 255), out).otherwise(m)


def FIRST() -> Column:
    return F.lit("1900-01-01").cast("date")


def _day(shape: str, key: str):
    """From a day's number to its pseudonym, written in the given shape."""

    def of(x: Column) -> Column:
        return F.date_format(F.date_add(FIRST(), feistel(x, *DAYS, key, "date", rounds=2 * ROUNDS).cast("int")), shape)

    return of


def _date(m: Column, key: str) -> Column:
    """Year first, or day before month where that is a date, else month before day."""
    out = m
    for shape, pattern in (("MM/dd/yyyy", r"^\d{2}/"), ("dd/MM/yyyy", r"^\d{2}/"), ("dd.MM.yyyy", r"^\d{2}\."), ("yyyy/MM/dd", r"^\d{4}/"), ("yyyy-MM-dd", r"^\d{4}-")):
        n = {p: shape.index(p) + 1 for p in ("yyyy", "MM", "dd")}
        y, mo, d = (F.substring(m, n[p], len(p)).cast("int") for p in ("yyyy", "MM", "dd"))
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        last = F.when(mo.isin(4, 6, 9, 11), 30).when(mo == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
        valid = m.rlike(pattern) & y.between(1900, 2099) & mo.between(1, 12) & (d >= 1) & (d <= last)
        date = F.when(valid, F.make_date(F.when(valid, y).otherwise(2000), F.when(valid, mo).otherwise(1), F.when(valid, d).otherwise(1)))
        mapped = let(F.datediff(date, FIRST()).cast("long"), _day(shape, key))
        out = F.when(valid, F.coalesce(mapped, m)).otherwise(out)
    return out


def _email(m: Column, key: str) -> Column:
    """Halves of the name shift each other's letters and digits within their classes."""
    name, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    half = F.floor((F.length(name) + 1) / 2).cast("int")

    def shifted(text: Column, other: Column, i: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), other)

        def one(c: Column, k: Column) -> Column:
            by = F.conv(F.substring(F.sha2(F.concat_ws("|", seed, k.cast("string")), 256), 1, 8), 16, 10).cast("long")
            code = F.ascii(c)
            base = F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65)
            size = F.when(c.rlike("[0-9]"), 10).otherwise(26)
            return F.when(base.isNull(), c).otherwise(F.char(base + (code - base + by) % size))

        return F.when(text == "", text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))

    start = F.struct(F.substring(name, F.lit(1), half).alias("l"), F.substring(name, half + 1, F.length(name)).alias("r"))
    turn = lambda s, i: F.struct(
        F.when(i % 2 == 0, shifted(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(i % 2 == 1, shifted(s["r"], s["l"], i)).otherwise(s["r"]).alias("r")
    )
    return F.concat(F.aggregate(F.array(*map(F.lit, range(4))), start, turn, lambda s: F.concat(s["l"], s["r"])), F.lit("@"), domain)


OF = {"email": _email, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "abroad": _abroad, "card": _card}


def pseudonym(m: Column, key: str) -> Column:
    """Of one finding."""
    out = m
    for kind in reversed(KINDS):
        out = F.when(m.rlike(f"^(?:{KINDS[kind]})$"), OF[kind](m, key)).otherwise(out)
    return out


def _changed(kind: str | None):
    def of(m: Column) -> Column:
        return (m["old"] != m["new"]) & (m["old"].rlike(f"^(?:{KINDS[kind]})$") if kind else F.lit(True))

    return of


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", out: str = "pii") -> DataFrame:
    """docs with the text replaced and a struct column: n_found (values replaced) and found (by kind)."""
    docs, text = make_room(docs, out), F.col(text_col)
    likely = F.coalesce(text.rlike(r"@|\d[\d.() /-]*\d"), F.lit(False))
    found = F.when(likely, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    own = "__" + out
    rows = docs.withColumn(own, found)
    rows = rows.withColumn(own, F.transform(own, lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new"))))
    gaps = F.split(text, ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(gaps, F.col(own), lambda g, m: F.array(g, F.coalesce(m["new"], F.lit(""))))), "")
    changed = F.filter(own, _changed(None))
    kinds = F.struct(*[F.size(F.filter(own, _changed(k))).alias(k) for k in KINDS])
    return rows.withColumns({text_col: F.when(F.size(own) > 0, joined).otherwise(text), out: F.struct(F.size(changed).alias("n_found"), kinds.alias("found"))}).drop(own)


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = pseudonymise(docs, "a key of the operator's own")
    return out.select("doc_id", "text", F.col("pii.n_found").cast("long").alias("n_found"), *[F.col(f"pii.found.{k}").cast("long").alias(f"n_{k}") for k in KINDS])
