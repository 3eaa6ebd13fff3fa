"""The permutations against plain Python, and that no two values meet."""

import datetime
import hashlib
import itertools
import re

from pyspark.sql import functions as F

from ringspark.llm import pii

KEY = "key"


def feistel(value, a, b, kind, rounds=8):
    left, right = divmod(value, b)
    of = lambda turn, half: int(hashlib.sha256(f"{KEY}|{kind}|{turn}|{half}".encode()).hexdigest()[:12], 16)
    for turn in range(rounds):
        if turn % 2 == 0:
            left = (left + of(turn, right)) % a
        else:
            right = (right + of(turn, left)) % b
    return left * b + right


def phone(digits):
    area, office, line = int(digits[:3]), int(digits[3:6]), int(digits[6:])
    if area >= 200 and office >= 200:
        x = feistel(((area - 200) * 800 + office - 200) * 10000 + line, 80000, 80000, "phone")
        return f"{x // 8000000 + 200}{x // 10000 % 800 + 200}{x % 10000:04}"
    low = 200 * 1000 * 10000
    x = feistel(int(digits) if area < 200 else low + ((area - 200) * 200 + office) * 10000 + line, 60000, 60000, "phone0")
    return f"{x:010}" if x < low else f"{(x - low) // 2000000 + 200}{(x - low) // 10000 % 200:03}{(x - low) % 10000:04}"


def refilled(text, digits):
    at = iter(digits)
    return re.sub("[0-9]", lambda _: next(at), text)


def plain(text):
    """Of texts that hold phone numbers, dates, addresses and social security numbers alone."""

    def one(m):
        m = m[0]
        d = re.sub("[^0-9]", "", m)
        if m.startswith("+") and not m.startswith("+1"):
            free = len(d) - 1
            return refilled(m, d[0] + f"{feistel(int(d[1:]), 10 ** (free // 2), 10 ** (free - free // 2), f'abroad{len(d)}'):0{free}}")
        if re.fullmatch(r"\d{4}-\d\d-\d\d", m):
            day = (datetime.date.fromisoformat(m) - datetime.date(1900, 1, 1)).days
            return str(datetime.date(1900, 1, 1) + datetime.timedelta(feistel(day, 17, 4297, "date", 16)))
        if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
            area, group, serial = map(int, m.split("-"))
            x = feistel(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn")
            i = x // (99 * 9999)
            return f"{i + 1 + (i >= 665):03}-{x // 9999 % 99 + 1:02}-{x % 9999 + 1:04}"
        if m.count(".") == 3:
            x = feistel(int.from_bytes(bytes(map(int, m.split("."))), "big"), 1 << 16, 1 << 16, "ip")
            return ".".join(map(str, x.to_bytes(4, "big")))
        head, tail = d[:-10], phone(d[-10:])
        return refilled(m, head + tail)

    return re.sub(r"\+?[0-9(][0-9() .+-]*[0-9]", one, text)


def test_against_plain_python(spark):
    values = ["100-100-0000", "690-833-9042", "(212) 555-0187", "1-800-555-1234", "+1 212 555 0187", "+12125550187", "199.999.9999", "200 199 0000", "000-000-0000", "999 199 9999"]
    values += ["+44 20 7946 0958", "+442079460958", "+49 (30) 1234567", "+99999999", "1.2.3.4", "255.255.255.255", "0.0.0.0", "899-99-9999", "665-01-0001", "667-50-1234"]
    values += ["1900-01-01", "2099-12-31", "2099-09-01", "2000-02-29", "1999-12-31"]
    rows = [(k, f"say {v}, please") for k, v in enumerate(values)]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id int, text string"), KEY).collect()}
    assert got == {k: plain(v) for k, v in rows}
    digits = [re.sub("[^0-9]", "", got[k]) for k in (4, 5)]
    assert digits[0] == digits[1] and got[10].replace(" ", "") == got[11].replace(" ", "")
    assert len(set(got.values())) == len(values)


def test_every_date_is_replaced_by_another(spark):
    days = spark.range(17 * 4297).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "dd.MM.yyyy").alias("text"))
    out = pii.pseudonymise(days, KEY).select("text").distinct()
    assert days.agg(F.max("text")).first()[0] == "31.12.2099" and out.count() == 17 * 4297 and out.exceptAll(days).count() == 0


def test_phones_of_the_two_kinds_never_meet(spark):
    areas = [0, 1, 100, 199, 200, 201, 690, 999]
    ids = [f"{a:03}-{o:03}-{n:04}" for a, o, n in itertools.product(areas, areas, range(0, 10000, 499))]
    out = [r.text for r in pii.pseudonymise(spark.createDataFrame([(x,) for x in ids], "text string"), KEY).collect()]
    kind = lambda s: s[0] >= "2" and s[4] >= "2"
    assert len(set(out)) == len(ids) and [kind(x) for x in out] == [kind(x) for x in ids]


def test_a_callers_column_is_kept(spark):
    out = pii.pseudonymise(spark.createDataFrame([("1.2.3.4", 7, 8)], "text string, PII int, pii_1 int"), KEY)
    assert out.columns == ["text", "PII_2", "pii_1", "pii"] and out.first().PII_2 == 7
