"""Personal data by format-preserving Feistel pseudonyms, with DataFrame functions only.

Mail addresses, IP addresses, dates, card numbers, account numbers, identity numbers and
phone numbers are found, validated (octets, calendar, Luhn and mod-97 checks, digit counts)
and permuted by a keyed Feistel network within their own format: separators, lengths,
check digits and calendar validity stay. Equal values have equal pseudonyms in every
document under one key, whatever their separators, and different values different ones.
The local part of a mail address becomes a keyed token at a reserved domain. The key comes from
the session's configuration (KEY_OPTION); without one, each session draws its own.

Card and account numbers have no fixed end, so every end at a group border is tried from every
start, and only the numbers that validate are cut out of a text: what stands before or after
them cannot hide them, and what fails is open to the other kinds. Phone numbers without a plus
sign are looked for in what is left between the other kinds.

Defined results: a null text stays null with zero counts; an empty text stays empty; what
fails its validation is left as it is; repeated rows are treated alike.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
#: The option of the session that holds the key.
KEY_OPTION = "spark.millrace.pseudonym.key"

#: Fixed patterns, in the order in which they are tried at a place.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
ISO = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DAY = r"(?<![0-9./-])[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}(?![0-9])"
IDENTITY = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|\+[0-9]{8,15}(?![0-9])"
KINDS = {"mail": MAIL, "iban": IBAN, "ip": IP, "iso": ISO, "identity": IDENTITY, "card": CARD, "day": DAY, "phone": PHONE}
#: The longest run that can be a card or account number, and one place more, at each start.
CARD_RUN = r"(?<![0-9])(?=([0-9](?:[ -]?[0-9]){12,19}))"
IBAN_RUN = r"\b(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){8,32}))"
PLUS = rf"(?=\+)(?:{PHONE})"

#: 400 years have 146,097 = 189 * 773 days, so a date within them is a pair of numbers that a Feistel network permutes.
CYCLE, HIGH, LOW, SINCE_1800 = 146_097, 189, 773, 62_091


def _noise(key: str, kind: str, i: Column, x: Column, modulus: Column) -> Column:
    text = F.concat(F.lit(f"{key}|{kind}|"), i.cast("string"), F.lit("|"), x.cast("string"), F.lit("|"), modulus.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), modulus)


def feistel(left: Column, right: Column, high: Column, low: Column, key: str, kind: str) -> Column:
    """struct(l, r): a keyed permutation of pairs below (high, low), each half in turn moved by the other."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(s, i):
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["l"] + _noise(key, kind, i, s["r"], high), high)).otherwise(s["l"]).cast("long").alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + _noise(key, kind, i, s["l"], low), low)).cast("long").alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def permuted(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 36 digits as another of the same length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    ten = lambda k: F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("long")
    left, right = digits.substr(F.lit(1), u).cast("long"), digits.substr(u + 1, n - u).cast("long")
    return _let(feistel(left, right, ten(u), ten(n - u), key, kind), lambda s: F.concat(F.lpad(s["l"].cast("string"), u, F.lit("0")), F.lpad(s["r"].cast("string"), n - u, F.lit("0"))))


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def refilled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced by those of digits, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(s, c):
        digit = (c >= "0") & (c < ":")
        return F.struct(
            F.concat(s["out"], F.when(digit, digits.substr(s["k"] + 1, F.lit(1))).otherwise(c)).alias("out"),
            (s["k"] + F.when(digit, 1).otherwise(0)).alias("k"),
        )

    return F.aggregate(_chars(shape), start, step, lambda s: s["out"])


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum from the right; doubled: 1 if the second digit from the right is the first to be doubled, 0 if the last is."""

    def add(s, c):
        d = c.cast("int") * F.when(s["i"] % 2 == doubled, 2).otherwise(1)
        return F.struct((s["sum"] + F.when(d > 9, d - 9).otherwise(d)).alias("sum"), (s["i"] + 1).alias("i"))

    return F.aggregate(_chars(F.reverse(digits)), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")), add, lambda s: s["sum"])


def mod97(text: Column) -> Column:
    """The remainder of an account number (country and check digits moved to its end) by 97."""
    moved = F.concat(text.substr(F.lit(5), F.length(text)), text.substr(F.lit(1), F.lit(4)))
    return F.aggregate(
        _chars(moved), F.lit(0),
        lambda s, c: F.when((c >= "0") & (c < ":"), (s * 10 + c.try_cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97).cast("int"),
    )


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _card(m: Column, key: str) -> Column:
    def valid(d):
        body = permuted(d.substr(F.lit(1), F.length(d) - 1), key, "card")
        new = _let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(b, 0), F.lit(10)).cast("string")))
        return F.when(luhn_sum(d, 1) % 10 == 0, _let(new, lambda n: refilled(m, n)))

    return _let(_digits(m), valid)


def _iban(m: Column, key: str) -> Column:
    def valid(x):
        country, body = x.substr(F.lit(1), F.lit(2)), x.substr(F.lit(5), F.length(x))

        def checked(b):
            check = F.lit(98) - mod97(F.concat(country, F.lit("00"), refilled(body, b)))
            return refilled(m, F.concat(F.lpad(check.cast("string"), 2, F.lit("0")), b))

        return F.when((mod97(x) == 1) & (F.length(_digits(body)) > 1), _let(permuted(_digits(body), key, "iban"), checked))

    return _let(F.replace(m, F.lit(" "), F.lit("")), valid)


def _ip(m: Column, key: str) -> Column:
    def valid(o):
        low = lambda i: F.element_at(o, i).cast("long")
        new = feistel(low(1) * 256 + low(2), low(3) * 256 + low(4), F.lit(65536), F.lit(65536), key, "ip")
        shown = _let(new, lambda s: F.concat_ws(".", F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256))
        return F.when(F.forall(o, lambda x: x.cast("int") < 256), shown)

    return _let(F.split(m, r"\."), valid)


def _new_date(date: Column, key: str) -> Column:
    def move(e):
        at = F.pmod(e, F.lit(CYCLE))
        new = _let(feistel(F.floor(at / LOW), at % LOW, F.lit(HIGH), F.lit(LOW), key, "date"), lambda s: s["l"] * LOW + s["r"])
        return F.date_add(F.lit("1970-01-01").cast("date"), (new + e - at - SINCE_1800).cast("int"))

    return _let(F.date_diff(date, F.lit("1970-01-01").cast("date")) + SINCE_1800, move)


def _iso(m: Column, key: str) -> Column:
    return _let(m.try_cast("date"), lambda d: F.when(d.isNotNull(), F.date_format(_new_date(d, key), "yyyy-MM-dd")))


def _day(m: Column, key: str) -> Column:
    """Day first where that is a date, else month first; the order and separator stay."""
    sign = F.regexp_extract(m, "[./-]", 0)

    def valid(p):
        two = lambda i: F.lpad(F.element_at(p, i), 2, F.lit("0"))
        by_day = F.concat_ws("-", F.element_at(p, 3), two(2), two(1)).try_cast("date")
        by_month = F.concat_ws("-", F.element_at(p, 3), two(1), two(2)).try_cast("date")
        shown = lambda d, first, second: _let(_new_date(d, key), lambda n: F.concat_ws("", F.date_format(n, first), sign, F.date_format(n, second), sign, F.date_format(n, "yyyy")))
        return F.when(by_day.isNotNull(), shown(by_day, "dd", "MM")).when(by_month.isNotNull(), shown(by_month, "MM", "dd"))

    return _let(F.split(m, "[./-]"), valid)


def _identity(m: Column, key: str) -> Column:
    """Areas 001-899 but 666, groups 01-99 and serials 0001-9999 are permuted among themselves."""

    def valid(p):
        area, group, serial = (F.element_at(p, i).cast("long") for i in (1, 2, 3))
        index = F.when(area > 666, area - 2).otherwise(area - 1)
        new = feistel(index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "identity")

        def shown(s):
            i = F.floor(s["l"] / 99)
            return F.concat_ws("-", F.lpad(F.when(i >= 665, i + 2).otherwise(i + 1).cast("string"), 3, F.lit("0")), F.lpad((s["l"] % 99 + 1).cast("string"), 2, F.lit("0")), F.lpad((s["r"] + 1).cast("string"), 4, F.lit("0")))

        return F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), _let(new, shown))

    return _let(F.split(m, "-"), valid)


def _phone(m: Column, key: str) -> Column:
    """The country code stays where one is written; the other digits are permuted."""
    code = F.length(_digits(F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)))

    def valid(d):
        rest = F.concat(d.substr(F.lit(1), code), permuted(d.substr(code + 1, F.length(d)), key, "phone"))
        return F.when(F.length(d).between(8, 15), _let(rest, lambda n: refilled(m, n)))

    return _let(_digits(m), valid)


def _mail(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}|mail|"), F.lower(m)), 256), 1, 16), F.lit("@example.invalid"))


MAKERS = {"mail": _mail, "iban": _iban, "ip": _ip, "iso": _iso, "identity": _identity, "card": _card, "day": _day, "phone": _phone}


def secret_key(spark: SparkSession) -> str:
    """The key that the session is configured with; where none is, one drawn for this session, so nobody can reverse its pseudonyms."""
    key = spark.conf.get(KEY_OPTION, None) or getattr(spark, "_millrace_key", None)
    if not key:
        key = spark._millrace_key = secrets.token_hex(32)
    return key


def pseudonymised(docs: DataFrame, key: str, text: str = "text", out: str = "_text", kinds: str = "_kinds") -> DataFrame:
    """docs with ``out``, the text with pseudonyms, and ``kinds``, the kind of each value that was replaced; other columns may carry any other name."""
    columns = docs.columns
    docs, t = docs.select(F.struct(*columns).alias("_doc"), F.col(text).alias("_t")), F.col("_t")
    cut = docs.withColumn("_pattern", F.when(t.rlike("[0-9@]"), _pattern(t)))
    cut = cut.withColumn("_cut", F.when(F.col("_pattern").isNotNull(), F.struct(F.split(t, F.col("_pattern"), -1).alias("pieces"), F.regexp_extract_all(t, F.col("_pattern"), F.lit(0)).alias("found"))))
    made = cut.withColumn("_between", F.transform("_cut.pieces", lambda p: _phones(p, key)))
    made = made.withColumn("_made", F.transform("_cut.found", lambda m: _let(_first(m, key), lambda p: F.struct(F.coalesce(p["new"], m).alias("new"), F.filter(F.array(p["kind"]), lambda k: k.isNotNull()).alias("kinds")))))
    end = F.array(F.struct(F.lit("").alias("new"), F.array().cast("array<string>").alias("kinds")))
    all_ = F.flatten(F.zip_with("_between", F.concat("_made", end), lambda a, b: F.array(a, b)))
    made = made.withColumn("_all", all_)
    return (
        made.select(
            *(F.col("_doc")[c].alias(c) for c in columns), F.when(F.col("_cut").isNull(), t).otherwise(F.concat_ws("", F.transform("_all", lambda p: p["new"]))).alias(out),
            F.coalesce(F.flatten(F.transform("_all", lambda p: p["kinds"])), F.array().cast("array<string>")).alias(kinds),
        )
    )


def _numbers(text: Column, run: str, pattern: str, valid) -> Column:
    """The numbers of a text that validate, whatever start or end they have, as alternatives of a pattern; the longest first."""
    ends = lambda r: F.filter(
        F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.struct(r.substr(F.lit(1), i).alias("m"), r.substr(i + 1, F.lit(1)).alias("next"))),
        lambda e: e["next"].isin("", " ", "-") & e["m"].rlike(f"^(?:{pattern})$") & valid(e["m"]),
    )
    found = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(run), F.lit(1)), lambda r: F.transform(ends(r), lambda e: e["m"]))))
    by_length = F.reverse(F.array_sort(F.transform(found, lambda m: F.struct(F.length(m).alias("n"), m.alias("m")))))
    return F.when(text.rlike(run), F.nullif(F.array_join(F.transform(by_length, lambda e: e["m"]), "|"), F.lit("")))


def _pattern(text: Column) -> Column:
    """The pattern of all values in a text but phone numbers without a plus sign."""
    iban = _numbers(text, IBAN_RUN, IBAN, lambda m: _let(F.replace(m, F.lit(" "), F.lit("")), lambda x: (mod97(x) == 1) & (F.length(_digits(x.substr(F.lit(5), F.length(x)))) > 1)))
    card = _numbers(text, CARD_RUN, CARD, lambda m: luhn_sum(_digits(m), 1) % 10 == 0)
    return F.concat(
        F.lit(f"(?:{MAIL})"), F.coalesce(F.concat(F.lit(r"|\b(?:"), iban, F.lit(r")\b")), F.lit("")),
        F.lit(f"|(?:{IP})|(?:{ISO})|(?:{IDENTITY})"), F.coalesce(F.concat(F.lit("|(?<![0-9])(?:"), card, F.lit(")(?![0-9])")), F.lit("")),
        F.lit(f"|(?:{DAY})|(?:{PLUS})"),
    )


def _phones(piece: Column, key: str) -> Column:
    """struct(new, kinds) of a piece of text that holds no value but phone numbers."""
    found = F.transform(F.regexp_extract_all(piece, F.lit(PHONE), F.lit(0)), lambda m: F.struct(_phone(m, key).alias("new"), m.alias("old")))
    joined = _let(found, lambda f: F.struct(
        F.concat_ws("", F.flatten(F.zip_with(F.split(piece, PHONE, -1), F.concat(F.transform(f, lambda p: F.coalesce(p["new"], p["old"])), F.array(F.lit(""))), lambda a, b: F.array(a, b)))).alias("new"),
        F.transform(F.filter(f, lambda p: p["new"].isNotNull()), lambda p: F.lit("phone")).alias("kinds"),
    ))
    return F.when(piece.rlike(PHONE), joined).otherwise(F.struct(piece.alias("new"), F.array().cast("array<string>").alias("kinds")))


def _first(m: Column, key: str) -> Column:
    """The first kind in order whose pattern and validation hold; struct(kind, new), null fields if none."""
    tried = F.array(*(
        F.struct(F.lit(kind).alias("kind"), F.when(m.rlike(f"^(?:{pattern})$"), MAKERS[kind](m, key)).alias("new"))
        for kind, pattern in KINDS.items()
    ))
    return F.get(F.filter(tried, lambda t: t["new"].isNotNull()), F.lit(0))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), secret_key(spark))
    count = lambda kind: F.size(F.filter("_kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return done.select("doc_id", F.col("_text").alias("text"), *counts)


QUERIES = {"op3_pseudonyms": op3_pseudonyms}
SQL: dict[str, str] = {}
