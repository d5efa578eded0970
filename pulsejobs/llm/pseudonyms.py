"""Format-preserving pseudonyms for validated numbers and dates. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

ROUNDS = 10
#: Days from 1900-01-01 in which dates are permuted: 365 * 200, to 2099-11-12.
FIRST_DAY, DAYS = "1900-01-01", (365, 200)

#: Fixed formats, tried in this order at each place; no letter or digit may touch a value, save the T and time after an ISO date.
FIXED = {
    "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}",
    "phone_nanp": r"(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|(?:1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4})",
    "phone_e164": r"\+[1-9](?:[ .()/-]{0,2}\d){7,14}",
    "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.\d)",
    "iso_date": r"\d{4}-\d{2}-\d{2}",
    "day_first": r"\d{2}[./]\d{2}[./]\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
}
_FIXED = rf"(?:{FIXED['iso_date']}(?=[Tt]\d{{2}})|(?:{'|'.join(FIXED.values())})(?![0-9A-Za-z]))"
#: Groups of digits, up to the next fixed format; the cards are looked for inside. Possessive, so that Java does not recurse.
_GROUP = rf"(?!{_FIXED})\d++(?![A-Za-z])"
FORMATS = FIXED | {"card": rf"(?=\d(?:[ -]?\d){{12}}){_GROUP}(?:[ -]{_GROUP})*+"}
VALUE = rf"(?<![0-9A-Za-z.])(?:{_FIXED}|{FORMATS['card']})"
#: Country codes of one and of two digits; all others have three.
SHORT_CODES = "^[17]", "^(2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


def feistel(left: Column, right: Column, a: Column, b: Column, tag: str, key: str) -> Column:
    """A keyed permutation of the pairs (left < a, right < b), as struct(l, r).

    Each even round adds to the left a digest of the right, modulo ``a``; each
    odd round the other way, modulo ``b``. Every round can be undone, so the
    whole is one to one. The digest is SHA-256 over key, tag, sizes, round and half.
    """

    def digest(i: Column, half: Column) -> Column:
        said = F.concat_ws("|", F.lit(key), F.lit(tag), a.cast("string"), b.cast("string"), i.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.sha2(said.cast("binary"), 256), 1, 14), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        l_new = F.when(even, F.pmod(s["l"] + F.pmod(digest(i, s["r"]), a), a)).otherwise(s["l"])
        r_new = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(digest(i, s["l"]), b), b))
        return F.struct(l_new.alias("l"), r_new.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is worked out once."""
    return F.transform(F.array(x), f)[0]


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn_sum(digits: Column, odd_doubled: bool) -> Column:
    """Sum from the right; the places 2, 4, ... are doubled, or the places 1, 3, ... with ``odd_doubled``."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when((i % 2 == (0 if odd_doubled else 1)), F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(places, F.lit(0), lambda s, d: s + d)


def _refill(v: Column, digits: Column) -> Column:
    """The value with its digits replaced in order; all other characters stay."""
    def place(digits: Column) -> Column:
        return F.aggregate(
            F.split(v, ""),
            F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
            lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
        )

    return _let(digits, place)["out"]


def _pad(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _card(v: Column, key: str) -> Column:
    digits = _digits(v)
    u = F.floor((F.length(digits) - 1) / 2).cast("int")
    w = F.length(digits) - 1 - u
    a, b = F.pow(F.lit(10), u).cast("long"), F.pow(F.lit(10), w).cast("long")
    mixed = feistel(F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, w), a, b, "card", key)
    body = _let(mixed, lambda s: F.concat(_pad(s["l"], u), _pad(s["r"], w)))
    return F.when(_luhn_sum(digits, False) % 10 == 0, _refill(v, _let(body, lambda d: F.concat(d, ((F.lit(10) - _luhn_sum(d, True) % 10) % 10).cast("string")))))


def _cards(v: Column, key: str) -> Column:
    """The items of a run of digit groups: the valid cards in it, and the rest.

    A card is 13 to 19 digits of whole groups with a right Luhn sum. At each
    group the longest one counts, and it gives way to a longer one that starts
    inside it. After the first group of the run, only the last group of a card
    may have under three digits, so that rows of small figures are not read as cards.
    """

    def longest(t: Column, i: Column) -> Column:
        said = lambda n: _digits(F.concat_ws("", F.slice(t, i + 1, n)))
        large = lambda n: (i == 0) | ~F.exists(F.slice(t, i + 1, n - 1), lambda g: F.length(_digits(g)) < 3)
        fits = F.filter(F.sequence(F.lit(1), F.least(F.lit(19), F.size(t) - i)), lambda n: F.length(said(n)).between(13, 19) & large(n) & (_luhn_sum(said(n), False) % 10 == 0))
        return _let(F.coalesce(F.array_max(fits), F.lit(0)), lambda n: F.struct(n.alias("n"), F.when(n > 0, F.length(said(n))).otherwise(0).alias("digits")))

    def cut(t: Column, best: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            here = F.get(best, i)
            taken = (here["n"] > 0) & ~F.exists(F.slice(best, i + 2, F.greatest(F.lit(0), here["n"] - 1)), lambda later: later["digits"] > here["digits"])
            whole = F.concat_ws("", F.slice(t, i + 1, here["n"]))
            old = F.regexp_replace(whole, "[ -]$", "")
            return (
                F.when(s["skip"] > 0, F.struct((s["skip"] - 1).alias("skip"), s["pre"].alias("pre"), s["items"].alias("items")))
                .when(taken, F.struct((here["n"] - 1).alias("skip"), F.regexp_extract(whole, "[ -]?$", 0).alias("pre"), F.concat(s["items"], F.array(_item(s["pre"], F.lit("card"), old, _card(old, key)))).alias("items")))
                .otherwise(F.struct(F.lit(0).alias("skip"), F.concat(s["pre"], F.get(t, i)).alias("pre"), s["items"].alias("items")))
            )

        none = F.struct(F.lit(0).alias("skip"), F.lit("").alias("pre"), F.array().cast(f"array<{ITEM}>").alias("items"))
        found = F.aggregate(F.sequence(F.lit(0), F.size(t) - 1), none, step, lambda s: F.concat(s["items"], F.array(_rest(s["pre"]))))
        return F.when(F.exists(best, lambda x: x["n"] > 0), found).otherwise(F.array(_rest(v)))

    tokens = F.regexp_extract_all(v, F.lit("[0-9]+[ -]?"), F.lit(0))
    return _let(tokens, lambda t: _let(F.transform(F.sequence(F.lit(0), F.size(t) - 1), lambda i: longest(t, i)), lambda best: cut(t, best)))


#: A value, valid or not, and the text before it.
ITEM = "struct<pre:string,kind:string,old:string,new:string>"


def _item(pre: Column, kind: Column, old: Column, new: Column) -> Column:
    return F.struct(pre.alias("pre"), kind.alias("kind"), old.alias("old"), new.alias("new"))


def _rest(text: Column) -> Column:
    return _item(text, F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("string"))


def _phone(v: Column, key: str) -> Column:
    """The national number is permuted, the country code (1 where none is written) stays."""
    digits = _digits(v)
    code = F.when(v.startswith("+"), F.when(digits.rlike(SHORT_CODES[0]), 1).when(digits.rlike(SHORT_CODES[1]), 2).otherwise(3)).otherwise(F.length(digits) - 10)
    n = F.length(digits) - code
    u = F.floor(n / 2).cast("int")
    w = n - u
    mixed = feistel(F.substring(digits, code + 1, u), F.substring(digits, code + u + 1, w), F.pow(F.lit(10), u).cast("long"), F.pow(F.lit(10), w).cast("long"), "phone", key)
    return _refill(v, _let(mixed, lambda s: F.concat(F.substring(digits, F.lit(1), code), _pad(s["l"], u), _pad(s["r"], w))))


def _ip(v: Column, key: str) -> Column:
    o = F.transform(F.split(v, r"\."), lambda x: x.cast("int"))
    mixed = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), "ip", key)
    parts = lambda s: [F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256]
    return F.when(~F.exists(o, lambda x: x > 255), _let(mixed, lambda s: F.concat_ws(".", *[p.cast("string") for p in parts(s)])))


def _ssn(v: Column, key: str) -> Column:
    area, group, serial = (F.split(v, "-")[i].cast("int") for i in range(3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    mixed = feistel(area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), "ssn", key)
    new_area = lambda s: s["l"] + 1 + (s["l"] + 1 >= 666).cast("int")
    return F.when(valid, _let(mixed, lambda s: F.concat_ws("-", _pad(new_area(s), 3), _pad(F.floor(s["r"] / 9999) + 1, 2), _pad(s["r"] % 9999 + 1, 4))))


#: Places of year, month and day.
DATES = {"iso_date": ((1, 4), (6, 2), (9, 2)), "day_first": ((7, 4), (4, 2), (1, 2)), "month_first": ((7, 4), (1, 2), (4, 2))}


def _date(v: Column, key: str, notation: str) -> Column:
    year, month, day = (F.substring(v, *x).cast("int") for x in DATES[notation])
    # days of the month, so that no cast can fail
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    month_days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    real = (year > 0) & month.between(1, 12) & (day >= 1) & (day <= month_days)
    number = F.datediff(F.make_date(F.when(real, year), F.when(real, month), F.when(real, day)), F.lit(FIRST_DAY).cast("date"))
    a, b = DAYS
    mixed = _let(number, lambda n: feistel(F.floor(n / b), n % b, F.lit(a), F.lit(b), "date", key))
    moved = _let(mixed, lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * b + s["r"]).cast("int")))
    first, second = ("dd", "MM") if notation == "day_first" else ("MM", "dd")
    said = lambda d: F.date_format(d, "yyyy-MM-dd") if notation == "iso_date" else F.concat(F.date_format(d, first), F.substring(v, 3, 1), F.date_format(d, second), F.substring(v, 6, 1), F.date_format(d, "yyyy"))
    return F.when(real & number.between(0, a * b - 1), _let(moved, said))


def pseudonym(v: Column, key: str) -> Column:
    """Items (pre, kind, old, new) of a value found with ``VALUE``; new is null where the value is not valid in its format."""
    of = {"phone": _phone, "phone_nanp": _phone, "phone_e164": _phone, "ip": _ip, "ssn": _ssn} | {k: lambda c, key, k=k: _date(c, key, k) for k in DATES}
    one = lambda name, new: F.array(_item(F.lit(""), F.lit("phone" if name.startswith("phone") else name), v, new))
    # a date that the calendar does not have with the day first may have its month first
    turned = F.substring(v, 4, 2).cast("int") > 12
    out = _cards(v, key)
    for name in reversed(FIXED):
        made = one(name, of[name](v, key))
        if name == "day_first":
            made = F.when(turned, one("month_first", of["month_first"](v, key))).otherwise(made)
        out = F.when(v.rlike(f"^{FIXED[name]}$"), made).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """All columns of ``docs``, with valid numbers and dates of ``column`` replaced, and ``found``.

    Card numbers (Luhn sum, also beside other groups of digits), telephone
    numbers (NANP with and without +1, others with + and country code), IPv4
    addresses, social security numbers and dates (of the calendar, 1900-01-01
    to 2099-11-12; day first, or month first where the day can only be second)
    are permuted with ``key`` inside their format: the new value is valid
    again, separators stay, equal values become equal values in every document
    and, for dates, cards and telephone numbers, in every notation. What is not
    valid stays as it is. ``found`` lists kind, start (UTF-8 bytes before the
    value in the new text) and the new value; the old values are not in the result.

    The text is cut at the values and put together again inside its row: no
    shuffle, no state. A null text stays null and finds nothing; repeated rows
    give equal rows. An older ``found`` is replaced, other columns stay. A
    value of the result must not be used to guess the key: keep it secret.
    """
    mark = "_pii"
    while any(c.startswith(mark) for c in docs.columns):  # no column of the input is touched
        mark += "_"
    text = F.col(column)
    some = F.when(text.rlike("[0-9]"), F.regexp_extract_all(text, F.lit(VALUE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = docs.withColumn(f"{mark}_values", F.coalesce(some, F.array().cast("array<string>"))).withColumn(f"{mark}_made", F.transform(f"{mark}_values", lambda v: pseudonym(v, key)))
    # the text before a match goes to its first item
    led = F.zip_with(
        F.split(text, VALUE, -1),
        F.col(f"{mark}_made"),
        lambda p, m: F.transform(F.coalesce(m, F.array(_rest(F.lit("")))), lambda x, i: _item(F.when(i == 0, F.concat(p, x["pre"])).otherwise(x["pre"]), x["kind"], x["old"], x["new"])),
    )
    rows = rows.withColumn(f"{mark}_items", F.when(F.size(f"{mark}_values") > 0, F.flatten(led)).otherwise(F.array().cast(f"array<{ITEM}>")))
    rows = rows.withColumn(f"{mark}_mixed", F.transform(f"{mark}_items", lambda m: F.concat(m["pre"], F.coalesce(m["new"], m["old"]))))
    start = F.transform(
        f"{mark}_items",
        lambda m, i: F.when(m["new"].isNotNull(), F.struct(m["kind"].alias("kind"), F.aggregate(F.slice(f"{mark}_mixed", F.lit(1), i + 1), F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s)).alias("end"), m["new"].alias("value"))),
    )
    found = F.transform(F.filter(start, lambda m: m.isNotNull()), lambda m: F.struct(m["kind"].alias("kind"), (m["end"] - F.octet_length(m["value"])).alias("start"), m["value"].alias("value")))
    some = F.size(f"{mark}_values") > 0
    none = F.array().cast("array<struct<kind:string,start:bigint,value:string>>")
    return rows.withColumns({"found": F.when(some, found).otherwise(none), column: F.when(some, F.array_join(f"{mark}_mixed", "")).otherwise(text)}).drop(f"{mark}_values", f"{mark}_made", f"{mark}_items", f"{mark}_mixed")


#: A fixed key, so that the query gives the same rows in each run; a real job takes its own from a secret store.
QUERY_KEY = "a key for tests only"


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
    count = lambda *kinds: F.size(F.filter("found", lambda m: m["kind"].isin(*kinds))).cast("long")
    return found.select("doc_id", count("phone", "ip", "ssn", "card").alias("n_numbers"), count("iso_date", "day_first", "month_first").alias("n_dates"), "found", "text")
