"""Format-preserving pseudonyms for personal data, in Spark's own functions.

One alternation finds what may be personal: e-mail addresses, card numbers, phone numbers, IPv4 addresses, nine-digit
identity numbers and dates. A validator per kind keeps the real ones (Luhn's check digit, octets, calendar days and so
on). The parts that vary go through a keyed Feistel network within their format: characters change only within their
class (digit, small letter, capital), addresses stay addresses, dates stay dates, and a card keeps a right check digit.
A network is a bijection of its format, so equal values get equal pseudonyms in all documents and different values of a
format stay apart.

Defined cases: null text stays null and has no spans; empty text has none. Repeated rows each give a row. Offsets are
code points of the original text, ends exclusive. A key must not be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilth.llm.common import unused

ROUNDS = 8
#: Days from 1800-01-01 up to the same day 400 years later: one whole cycle of the calendar, 189 * 773 days.
DAY_0, DAYS, DAY_LEFT, DAY_RIGHT = "1800-01-01", 146097, 189, 773

#: Kind and pattern, tried in this order at each place.
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("date", r"(?:1[89]|20|21)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"),
    ("ipv4", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"),
    ("phone", r"\+\d{1,3}[\x20.-]?\(?\d{2,4}\)?(?:[\x20.-]?\d{2,4}){2,3}|\(\d{3}\)\x20?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}"),
    ("identity", r"\d{3}-\d{2}-\d{4}"),
    ("card", r"\d{4}(?:[\x20-]?\d{4}){2}[\x20-]?\d{1,7}"),
)
#: No longer number or word goes on at either end.
ANY = r"(?<![A-Za-z0-9_.+@-])(?:" + "|".join(p for _, p in PATTERNS) + r")(?![A-Za-z0-9_@])(?![.-]\d)"
#: Found in every text in which ANY is found, and quicker to look for: a part that each pattern can't do without.
QUICK = r"@[A-Za-z0-9-]+\.|\d{3}.?\d\d|\d\.\d{1,3}\.\d|\+\d"


def _prf(key: str, *parts: Column) -> Column:
    """128 hexadecimal digits that depend on the key and the parts."""
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]).cast("binary"), 512)


def _shifted(text: Column, stream: Column, sign: int) -> Column:
    """Each letter or digit moved within its class by two hexadecimal digits of the stream, which repeats after 64."""
    small, capital, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def moved(k: Column) -> Column:
        c = F.substring(text, k, 1)
        by = F.conv(F.substring(stream, F.pmod(k - 1, F.lit(64)) * 2 + 1, 2), 16, 10).cast("int") * sign
        out = c
        for alphabet in (small, capital, digit):
            n, place = len(alphabet), F.instr(F.lit(alphabet), c)
            out = F.when((place > 0) & (c != ""), F.substring(F.lit(alphabet), F.pmod(place - 1 + by, F.lit(n)) + 1, 1)).otherwise(out)
        return out

    return F.when(F.length(text) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), moved), ""))


def feistel_text(text: Column, key: str, backwards: bool = False) -> Column:
    """The text with letters and digits permuted within their classes: the halves take turns in shifting each other.
    A text of one character is shifted by the key alone."""
    half = F.floor(F.length(text) / 2).cast("int")
    rounds = list(range(ROUNDS))

    def turn(held: Column, k: Column) -> Column:
        left, right, sign = held["left"], held["right"], -1 if backwards else 1
        even = k % 2 == 0
        moved = _shifted(F.when(even, right).otherwise(left), _prf(key, k, F.length(text), F.when(even, left).otherwise(right)), sign)
        return F.struct(F.when(even, left).otherwise(moved).alias("left"), F.when(even, moved).otherwise(right).alias("right"))

    start = F.struct(F.substring(text, F.lit(1), half).alias("left"), F.substring(text, half + 1, F.length(text)).alias("right"))
    return F.aggregate(F.array(*[F.lit(k) for k in (reversed(rounds) if backwards else rounds)]), start, turn, lambda held: F.concat(held["left"], held["right"]))


def feistel_number(x: Column, left_size: int, right_size: int, key: str, backwards: bool = False) -> Column:
    """A permutation of [0, left_size * right_size) whose halves take turns in moving each other."""
    rounds = list(range(ROUNDS))

    def turn(held: Column, k: Column) -> Column:
        left, right = held["left"], held["right"]
        even = k % 2 == 0
        by = F.conv(F.substring(_prf(key, k, F.when(even, left).otherwise(right)), 1, 12), 16, 10).cast("long") * (-1 if backwards else 1)
        return F.struct(F.when(even, left).otherwise(F.pmod(left + by, F.lit(left_size).cast("long"))).alias("left"), F.when(even, F.pmod(right + by, F.lit(right_size).cast("long"))).otherwise(right).alias("right"))

    start = F.struct(F.floor(x / right_size).cast("long").alias("left"), F.pmod(x, F.lit(right_size)).cast("long").alias("right"))
    return F.aggregate(F.array(*[F.lit(k) for k in (reversed(rounds) if backwards else rounds)]), start, turn, lambda held: held["left"] * right_size + held["right"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn_sum(digits: Column, doubled_last: int) -> Column:
    """Luhn's sum; doubled_last is 1 if the last digit is doubled."""
    from_end = F.reverse(digits)

    def part(k: Column) -> Column:
        d = F.substring(from_end, k, 1).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when((k % 2 == 0) != (doubled_last == 1), twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda total, k: total + F.coalesce(part(k), F.lit(0)))


def _poured(form: Column, digits: Column) -> Column:
    """The digits in place of the form's own, in order."""
    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def put(held: Column, k: Column) -> Column:
        c = F.substring(form, k, 1)
        is_digit = c.rlike("[0-9]")
        return F.struct(F.concat(held["out"], F.when(is_digit, F.substring(digits, held["used"] + 1, F.lit(1))).otherwise(c)).alias("out"), (held["used"] + F.when(is_digit, 1).otherwise(0)).alias("used"))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(form), F.lit(1))), empty, put, lambda held: held["out"])


def _octets(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda x: x.cast("int"))


def kind_of(m: Column) -> Column:
    """The kind whose whole pattern the match is and whose validator it passes, or null."""
    is_whole = {kind: m.rlike(f"^(?:{pattern})$") for kind, pattern in PATTERNS}
    n = F.length(_digits(m))
    valid = {
        "email": ~m.rlike(r"\.\.|^\.|\.@"),
        "date": F.try_to_date(m, "yyyy-MM-dd").isNotNull(),
        "ipv4": F.forall(_octets(m), lambda x: x <= 255) & ~m.rlike(r"(^|\.)0\d"),
        "phone": (n >= 10) & (n <= 15),
        "identity": ~m.rlike("^(000|666|9)|-00-|-0000$"),
        "card": (n >= 13) & (n <= 19) & (_luhn_sum(_digits(m), 0) % 10 == 0),
    }
    found = F.lit(None).cast("string")
    for kind, _ in reversed(PATTERNS):
        found = F.when(is_whole[kind] & valid[kind], F.lit(kind)).otherwise(found)
    return found


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a valid match of the kind."""
    own = lambda kind: f"{key}/{kind}"
    digits = _digits(m)
    body = feistel_text(F.substring(digits, F.lit(1), F.length(digits) - 1), own("card"))
    check = F.pmod(-_luhn_sum(body, 1), F.lit(10)).cast("string")
    octets = _octets(m)
    whole_ip = F.aggregate(octets, F.lit(0).cast("long"), lambda total, x: total * 256 + x)
    new_ip = feistel_number(whole_ip, 1 << 16, 1 << 16, own("ipv4"))
    ip = F.concat_ws(".", *[F.pmod(F.shiftright(new_ip, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])
    day = F.datediff(F.try_to_date(m, "yyyy-MM-dd"), F.lit(DAY_0).cast("date"))
    date = F.date_format(F.date_add(F.lit(DAY_0).cast("date"), feistel_number(day, DAY_LEFT, DAY_RIGHT, own("date")).cast("int")), "yyyy-MM-dd")
    return (
        F.when(kind == "email", F.concat(feistel_text(F.substring_index(m, "@", 1), own("email")), F.lit("@"), F.substring_index(m, "@", -1)))
        .when(kind == "date", date)
        .when(kind == "ipv4", ip)
        .when(kind == "card", _poured(m, F.concat(body, check)))
        .when(kind == "identity", _poured(m, feistel_text(digits, own("identity"))))
        .otherwise(_poured(m, feistel_text(digits, own("phone"))))
    )


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """df, all rows and columns, with the text pseudonymised and the spans found in it: kind, start, end. A column of
    that name is replaced."""
    if not key:
        raise ValueError("the key is empty")
    text, held = F.col(text_col), unused(df, "parts")
    found, between = F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.split(text, ANY, -1)
    parts = F.zip_with(found, between, lambda m, b: F.struct(b.alias("gap"), m.alias("match")))
    judged = F.transform(parts, lambda p: F.struct(p["gap"].alias("gap"), p["match"].alias("match"), F.when(p["match"].isNotNull(), kind_of(p["match"])).alias("kind")))
    new = F.transform(F.col(held), lambda p: F.concat(p["gap"], F.when(p["kind"].isNotNull(), pseudonym(p["match"], p["kind"], key)).otherwise(F.coalesce(p["match"], F.lit("")))))
    kind = "struct<spans:array<struct<kind:string,start:int,end:int>>,at:int>"

    def walk(done: Column, p: Column) -> Column:
        start = done["at"] + F.length(p["gap"])
        end = start + F.coalesce(F.length(p["match"]), F.lit(0))
        return F.struct(F.when(p["kind"].isNotNull(), F.concat(done["spans"], F.array(F.struct(p["kind"].alias("kind"), start.alias("start"), end.alias("end"))))).otherwise(done["spans"]).alias("spans"), end.alias("at"))

    spans = F.aggregate(F.col(held), F.from_json(F.lit('{"spans":[],"at":0}'), kind), walk)["spans"]
    none = F.from_json(F.lit("[]"), "array<struct<kind:string,start:int,end:int>>")
    marked = df.drop(spans_col).withColumn(held, F.when(text.rlike(QUICK), judged))
    any_kind = F.exists(held, lambda p: p["kind"].isNotNull())
    return marked.withColumn(spans_col, F.when(any_kind, spans).otherwise(none)).withColumn(text_col, F.when(any_kind, F.array_join(new, "")).otherwise(text)).drop(held)


def report(df: DataFrame, key: str) -> DataFrame:
    """A row a document that holds personal data: how many values of each kind, their spans, the new text."""
    done = pseudonymise(df.select("doc_id", "text"), key).where(F.size("pii_spans") > 0)
    n = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = F.array_join(F.transform("pii_spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return done.select("doc_id", *[n(kind) for kind, _ in PATTERNS], listed.alias("spans"), "text")
