"""Format-preserving pseudonyms for personal data, with DataFrame functions alone.

Values are found by one pattern, validated by kind (Luhn sums of cards, mod-97 of IBANs, octets of
addresses, the calendar of dates), and replaced by a keyed Feistel permutation of their own format: a card
stays a valid card, a date a valid date, and separators, case, lengths and an e-mail's domain stay. The
permutation depends on key, kind and value only, so equal values stay linked across documents, and
whoever holds the key can undo it. Texts without a digit or an @ are passed through unread.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
#: The session setting that holds the key, and the key where it is unset: no secret, so that anyone can undo it.
KEY_SETTING, KEY = "spark.paperloom.pii.key", "change-me"
#: Days from 1900-01-01 through 2099-12-31, and two factors of that number.
FIRST_DAY, DAYS, DAYS_A, DAYS_B = "1900-01-01", 73049, 17, 4297

_EDGE, _NEXT = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,24})"
IBAN = _EDGE + r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + _NEXT
SECRET = _EDGE + r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})" + _NEXT
IPV4 = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d|\p{L})"
DATE = r"(?<![\p{L}\p{N}./-])(?:(?:19|20)\d\d([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2(?:19|20)\d\d)(?![\p{L}\p{N}]|[-/]\d)"
SSN = _EDGE + r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\p{L}\p{N}-])"
PHONE = r"(?<![\p{L}\p{N}+])(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}|\d{3}[-. ]\d{3}[-. ]\d{4})" + _NEXT
NUMBER = _EDGE + r"(?:\d{12,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})" + _NEXT
#: Kinds in order of precedence.
KINDS = {"email": EMAIL, "iban": IBAN, "secret": SECRET, "ip": IPV4, "date": DATE, "ssn": SSN, "phone": PHONE, "number": NUMBER}


def _hash(key: str, kind: str, r: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), other.cast("string")), 512)


def _bind(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def feistel_number(value: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. a * b - 1 by a Feistel network over two residues."""
    word = lambda r, x: F.conv(F.substring(_hash(key, kind, r, x), 1, 14), 16, 10).cast("long")
    start = F.struct(F.floor(value / F.lit(b)).cast("long").alias("l"), F.pmod(value, F.lit(b)).cast("long").alias("r"))

    def step(acc, i):
        left = lambda: F.pmod(acc["l"] + word(i, acc["r"]), F.lit(a))
        right = lambda: F.pmod(acc["r"] + word(i, acc["l"]), F.lit(b))
        even = i % 2 == 0
        return F.struct(F.when(even, left()).otherwise(acc["l"]).cast("long").alias("l"), F.when(even, acc["r"]).otherwise(right()).cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: acc["l"] * b + acc["r"])


def _shifted(half: Column, stream: Column, hexa: bool) -> Column:
    """Each character moved within its alphabet by the next byte of the stream; one beyond ASCII within its sixteen neighbours, which are of
    its script but for few."""
    stream = F.concat(*[stream] * 4)

    def move(c, i):
        alphabet = F.lit("0123456789abcdef") if hexa else F.when(c.between("0", "9"), "0123456789").when(c.between("a", "z"), "abcdefghijklmnopqrstuvwxyz").otherwise("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        by = F.conv(F.substr(stream, (i % 256) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        moved = F.substr(alphabet, F.pmod(F.instr(alphabet, c) - 1 + by, F.length(alphabet)) + 1, F.lit(1))
        point = F.ascii(c)  # of any letter, not only of ASCII
        near = point - point % 16 + (point % 16 + by) % 16
        return moved if hexa else F.when(point > 127, F.decode(F.unhex(F.lpad(F.hex(near), 8, "0")), "UTF-32")).otherwise(moved)

    return F.when(half == "", F.lit("")).otherwise(F.array_join(F.transform(F.split(half, ""), move), ""))


def feistel_text(value: Column, key: str, kind: str, hexa: bool = False) -> Column:
    """A keyed permutation of strings of letters and digits that keeps each place's alphabet."""
    n = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), n).alias("l"), F.substr(value, n + 1, F.length(value)).alias("r"))

    def step(acc, i):
        even = i % 2 == 0
        return F.struct(
            F.when(even, _shifted(acc["l"], _hash(key, kind, i, acc["r"]), hexa)).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(_shifted(acc["r"], _hash(key, kind, i, acc["l"]), hexa)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def _in_place(value: Column, fresh, letters: str = "A-Za-z0-9") -> Column:
    """value with its letters and digits replaced, in order, by fresh(all of them as one string)."""
    only = lambda x: F.regexp_replace(x, f"[^{letters}]", "")
    put = lambda new: F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike(f"[{letters}]"), F.substr(new, F.length(only(F.substr(value, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")
    return _bind(fresh(only(value)), put)


def _luhn(digits: Column) -> Column:
    """Sum by Luhn's rule; a multiple of ten if the last digit checks."""
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _mod97(iban: Column) -> Column:
    turned = F.concat(F.substr(iban, F.lit(5), F.length(iban)), F.substr(iban, F.lit(1), F.lit(4)))
    number = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.pmod(a * F.when(c.between("0", "9"), 10).otherwise(100) + number(c), F.lit(97)))


def _card(digits: Column, key: str) -> Column:
    def close(body):
        return F.concat(body, F.pmod(10 - _luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string"))

    body = feistel_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    return F.when(_luhn(digits) % 10 == 0, _bind(body, close)).otherwise(feistel_text(digits, key, "number"))


def _iban(plain: Column, key: str) -> Column:
    def close(body):
        country = F.substr(plain, F.lit(1), F.lit(2))
        return F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0"), body)

    return F.when(_mod97(plain) == 1, _bind(feistel_text(F.substr(plain, F.lit(5), F.length(plain)), key, "iban"), close)).otherwise(plain)


def _secret(value: Column, key: str) -> Column:
    """A secret in the case of its letters; one secret in either case has one pseudonym."""
    return _bind(feistel_text(F.lower(value), key, "secret", True), lambda new: F.when(value.rlike("[A-F]"), F.upper(new)).otherwise(new))


def _date(value: Column, key: str) -> Column:
    """A date of the same written form. What is no date of the calendar stays."""
    cut = F.regexp_extract(value, "[-/.]", 0)
    p = F.split(value, "[-/.]")
    ymd = F.length(p[0]) == 4
    month_first = ~ymd & (p[1].cast("int") > 12)
    day = F.when(ymd, p[2]).when(month_first, p[1]).otherwise(p[0])
    month = F.when(month_first, p[0]).otherwise(p[1])
    date = F.try_to_date(F.concat_ws("-", F.when(ymd, p[0]).otherwise(p[2]), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")

    def written(new):
        # the width of the original's parts: two digits stay two, one digit grows only where it must
        part = lambda x, old: F.when(F.length(old) == 2, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
        y, m, d = F.year(new).cast("string"), part(F.month(new), month), part(F.dayofmonth(new), day)
        return F.when(ymd, F.concat_ws("-", y, m, d)).when(month_first, F.concat_ws("-", m, d, y)).otherwise(F.concat_ws("-", d, m, y))

    moved = feistel_number(F.date_diff(date, F.lit(FIRST_DAY).cast("date")).cast("long"), DAYS_A, DAYS_B, key, "date")
    return F.when(date.isNull(), value).otherwise(F.replace(_bind(F.date_add(F.lit(FIRST_DAY).cast("date"), moved.cast("int")), written), F.lit("-"), cut))


def _ip(value: Column, key: str) -> Column:
    p = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    return _bind(feistel_number(number, 65536, 65536, key, "ip"), lambda n: F.concat_ws(".", *[F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]))


def pseudonym(value: Column, key: str = KEY) -> Column:
    """The pseudonym of a string that is one value of a kind; other strings stay."""
    is_ = lambda kind: value.rlike(f"^(?:{KINDS[kind]})$")
    prefix = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])|^\+\d", 0)
    at = F.instr(value, "@")
    same = lambda kind, hexa=False: lambda s: feistel_text(s, key, kind, hexa)
    return (
        F.when(at > 0, F.concat(_in_place(F.substr(value, F.lit(1), at - 1), same("email"), r"\p{L}\p{N}"), F.substr(value, at, F.length(value))))
        .when(is_("iban") & ~(is_("secret") & (_mod97(value) != 1)), _in_place(value, lambda s: _iban(s, key)))
        .when(is_("secret"), _secret(value, key))
        .when(is_("ip"), _ip(value, key))
        .when(is_("date"), _date(value, key))
        .when(is_("ssn"), _in_place(value, same("ssn")))
        .when(is_("phone"), F.concat(prefix, _in_place(F.substr(value, F.length(prefix) + 1, F.length(value)), same("phone"))))
        .otherwise(_in_place(value, lambda s: _card(s, key)))
    )


def _pattern() -> str:
    out, groups = [], 0
    for p in KINDS.values():
        out.append(f"(?:{p})".replace(r"\1", f"\\{groups + 1}").replace(r"\2", f"\\{groups + 2}"))
        groups += 2 * (p is DATE)
    return "|".join(out)


def _replaced(text: Column, key: str) -> Column:
    """text and count, for a text that may hold values."""
    found = F.struct(F.split(text, _pattern(), -1).alias("gaps"), F.regexp_extract_all(text, F.lit(_pattern()), F.lit(0)).alias("values"))

    def put(x):
        new = lambda i: F.coalesce(pseudonym(F.get(x["values"], i), key), F.lit(""))
        whole = F.when(F.size(x["values"]) == 0, text).otherwise(F.array_join(F.transform(x["gaps"], lambda g, i: F.concat(g, new(i))), ""))
        return F.struct(whole.alias("text"), F.size(x["values"]).cast("long").alias("n"))

    return _bind(found, put)


def session_key(spark: SparkSession) -> str:
    """The key that the session names in KEY_SETTING; where it names none, or an empty one, KEY, with a warning."""
    key = spark.conf.get(KEY_SETTING, "")
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with a public key", stacklevel=3)
    return key or KEY


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs (text and any other columns) with each value's pseudonym in place, and n_values, how many there were.

    Without a key, that of the session is taken (session_key).
    A null text stays null with no values. Nothing else of a text changes; equal rows stay equal; an
    empty table gives an empty one. A column of docs named n_values is replaced.
    """
    key = session_key(docs.sparkSession) if key is None else key
    text = F.col("text")
    new = F.when(text.rlike("[0-9@]"), _replaced(text, key)).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n")))
    keep = [c for c in docs.columns if c != "n_values"]
    done = docs.select(*keep, new.alias("_new"))
    return done.select(*[F.col("_new.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in keep], F.coalesce(F.col("_new.n"), F.lit(0).cast("long")).alias("n_values"))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_pii_pseudonyms": op4_pii_pseudonyms}
