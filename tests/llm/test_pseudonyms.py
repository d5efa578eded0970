"""Format-preserving pseudonyms against a plain Python version."""

import datetime
import hashlib
import re

from pulsejobs.llm import pseudonyms as P

KEY = "test key"


def permute(left, right, a, b, tag, key=KEY):
    for i in range(P.ROUNDS):
        half, m = (right, a) if i % 2 == 0 else (left, b)
        n = int(hashlib.sha256(f"{key}|{tag}|{a}|{b}|{i}|{half}".encode()).hexdigest()[:14], 16) % m
        if i % 2 == 0:
            left = (left + n) % a
        else:
            right = (right + n) % b
    return left, right


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def refill(value, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


def new_value(v):
    d = re.sub("[^0-9]", "", v)
    if re.fullmatch(P.FORMATS["phone"], v):
        x, y = permute(int(d[1:6]), int(d[6:]), 10**5, 10**5, "phone")
        return refill(v, f"1{x:05}{y:05}")
    if re.fullmatch(P.FORMATS["ip"].removesuffix(r"(?!\.\d)"), v):
        o = [int(x) for x in v.split(".")]
        if max(o) > 255:
            return v
        x, y = permute(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", v) or re.fullmatch(r"(?P<d>\d\d)([./])(?P<m>\d\d)[./](?P<y>\d{4})", v)
    if m:
        iso = "-" in v
        y, mo, da = (m[1], m[2], m[3]) if iso else (m["y"], m["m"], m["d"])
        try:
            n = (datetime.date(int(y), int(mo), int(da)) - datetime.date(1900, 1, 1)).days
        except ValueError:
            return v
        if not 0 <= n < 365 * 200:
            return v
        x, z = permute(n // 200, n % 200, 365, 200, "date")
        t = datetime.date(1900, 1, 1) + datetime.timedelta(x * 200 + z)
        return t.isoformat() if iso else f"{t.day:02}{v[2]}{t.month:02}{v[5]}{t.year}"
    if re.fullmatch(P.FORMATS["ssn"], v):
        a, g, s = map(int, v.split("-"))
        if not (0 < a < 900 and a != 666 and g and s):
            return v
        x, y = permute(a - 1 - (a > 666), (g - 1) * 9999 + s - 1, 898, 99 * 9999, "ssn")
        x += 1 + (x + 1 >= 666)
        return f"{x:03}-{y // 9999 + 1:02}-{y % 9999 + 1:04}"
    if not luhn(d):
        return v
    u = (len(d) - 1) // 2
    w = len(d) - 1 - u
    x, y = permute(int(d[:u]), int(d[u:-1]), 10**u, 10**w, "card")
    body = f"{x:0{u}}{y:0{w}}"
    return refill(v, next(body + c for c in "0123456789" if luhn(body + c)))


TEXTS = [
    "card 4539 1488 0343 6467 and 4539148803436467, phone +1 (162) 555-6820.",
    "4539-1488-0343-6467",
    "not valid: 4539148803436468, 256.1.1.1, 2023-02-29, 666-12-1234, 000-12-1234",
    "born 2000-02-29 or 29.02.2000 or 29/02/2000, from 10.0.0.1 to 255.255.255.255; 1899-12-31",
    "ssn 123-45-6789 +1 (000) 000-0000",
    'token = "7702344ead31d5951" 1.2.3.4.5 x4539148803436467',
    "",
    None,
    "no digits; ünï 1.1.1.1 ü 1.1.1.1",
    "1.1.1.1",
    "é" * 30000 + " 4539148803436467 " + "z" * 50000,
]


def test_against_plain_python(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, found string")
    out = P.pseudonymise(df, KEY).collect()
    assert len(out) == len(rows)
    for r in out:
        old = TEXTS[r.doc_id]
        want = None if old is None else re.sub(P.VALUE, lambda m: new_value(m[0]), old)
        assert r.text == want
        for m in r.found:
            raw = m.value.encode()
            assert want.encode()[m.start : m.start + len(raw)] == raw
    by = {r.doc_id: r for r in out}
    digits = [re.sub("[^0-9]", "", m.value) for m in (*by[0].found[:2], by[1].found[0])]
    assert len(set(digits)) == 1 and luhn(digits[0])  # one number in three notations stays one number
    assert [m.kind for m in by[3].found] == ["iso_date", "day_first", "day_first", "ip", "ip"]
    assert by[2].found == [] and by[7].found == [] and by[5].text == TEXTS[5]


def test_one_to_one(spark):
    df = spark.range(73000).selectExpr("id", "cast(date_add(date'1900-01-01', cast(id as int)) as string) as text")
    out = P.pseudonymise(df, KEY)
    assert out.select("text").distinct().count() == 73000
    assert out.where("text < '1900-01-01' or text > '2099-11-12'").count() == 0


def test_empty_table_and_other_column(spark):
    df = spark.createDataFrame([], "doc_id long, body string, text string")
    assert P.pseudonymise(df, KEY, "body").columns == ["doc_id", "body", "text", "found"]
    assert P.pseudonymise(df, KEY, "body").count() == 0


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    plan = P.pseudonymise(df, KEY)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def changed(spark, texts):
    rows = P.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), KEY).orderBy("doc_id").collect()
    return [(r.text, [(m.kind, m.value) for m in r.found]) for r in rows]


def test_telephone_layouts(spark):
    texts = ["+1 (555) 123-4567", "(555) 123-4567", "555-123-4567", "555.123.4567", "1-555-123-4567", "+15551234567", "+49 30 1234567", "+49301234567", "+353 (1) 234-5678", "12-123-4567", "+1234"]
    out = changed(spark, texts)
    for old, (text, found) in zip(texts[:9], out, strict=False):
        assert found == [("phone", text)] and text != old
        assert re.sub("[0-9]", "0", text) == re.sub("[0-9]", "0", old)
    d = [re.sub("[^0-9]", "", text) for text, _ in out]
    assert {x[-10:] for x in d[:6]} == {d[0][1:]}  # one number in six layouts stays one number
    x, y = permute(55512, 34567, 10**5, 10**5, "phone")
    assert d[1] == f"{x:05}{y:05}"
    x, y = permute(3012, 34567, 10**4, 10**5, "phone")
    assert d[6] == d[7] == f"49{x:04}{y:05}"
    assert d[8].startswith("353")
    assert [out[i] for i in (9, 10)] == [(texts[i], []) for i in (9, 10)]


def test_cards_beside_other_digits(spark):
    card, new = "4539 1488 0343 6467", new_value("4539 1488 0343 6467")
    around = [("", " 124"), ("", " 1"), ("12 ", ""), ("123 ", " 45"), ("9999 ", ""), ("", " 12/25"), ("", " 123-45-6789"), ("card ", " 12ab"), ("7 7 7 7 7 7 ", " 8888 8888 1"), (card + " ", ""), ("", " 2024-01-15")]
    out = changed(spark, [a + card + b for a, b in around])
    for (a, b), (text, found) in zip(around, out, strict=True):
        assert ("card", new) in found and card not in text
        assert re.sub("[0-9]", "0", text) == re.sub("[0-9]", "0", a + card + b)
    assert [text for text, _ in out[:6]] == [a + new + b for a, b in around[:6]]
    assert [k for k, _ in out[6][1]] == ["card", "ssn"] and [k for k, _ in out[10][1]] == ["card", "iso_date"]
    assert out[9][0] == f"{new} {new}"
    figures = " ".join(str(i % 90 + 10) for i in range(20000))  # long, and no card after its first group
    assert changed(spark, ["7 " + figures])[0][0][60:] == ("7 " + figures)[60:]


def test_dates_in_timestamps_and_month_first(spark):
    texts = ["2024-01-15T10:00", "2024-01-15T10:00:00Z", "2024-01-15", "01/15/2024", "15/01/2024", "13/13/2024", "02/30/2024", "2024-01-15Tx"]
    out = changed(spark, texts)
    iso = new_value("2024-01-15")
    y, m, d = iso.split("-")
    assert [text for text, _ in out] == [iso + "T10:00", iso + "T10:00:00Z", iso, f"{m}/{d}/{y}", f"{d}/{m}/{y}", *texts[5:]]
    assert [[k for k, _ in found] for _, found in out] == [["iso_date"]] * 3 + [["month_first"], ["day_first"], [], [], []]
