"""Format-preserving pseudonyms for personal data, in Spark SQL expressions only.

Every value found in a text is replaced by a keyed permutation of itself within
its own format, so the same value gets the same pseudonym in every document and
no table of values is kept. Two Feistel networks do it, both with SHA-512 of
the key, the kind, the round and the other half as round function:

* over strings of an alphabet (digits, hex, letters), adding a key stream to
  the characters of one half at a time;
* over integers below a * b, adding modulo a and b in turn (dates, SSNs).

Each is used as  decrypt(encrypt(x) + 1),  where the 1 is added to the whole value
with its carries. That is again a permutation, without a fixed point and with one cycle
over all values of the format: no value is ever its own pseudonym, and taking
pseudonyms of pseudonyms comes back only after all of them. A string of one character
has no other half; it goes to the next character in an order that the key decides.

Kinds and what is kept: e-mail addresses (domain and punctuation), telephone
numbers (punctuation and the international calling code, or the leading zero of one in
pairs; so a number has one pseudonym in all these notations), IPv4 addresses (four octets below 256),
card and account numbers of 13 to 19 digits (separators; a number that passes
the Luhn check still does, one that fails keeps its difference), IBANs with
right check digits (country, length, valid check digits), US social security
numbers with valid area, group and serial (still valid), calendar dates (year-first, day-first or,
where that is no date, month-first order and separators; a date within the
same 400 years; a time after an ISO date stays),
and hexadecimal secrets of 24 to 128 digits with at least one decimal digit
(length and case). What fails its kind's validation is left alone.

Defined cases: null text stays null, empty text empty; values may repeat, touch
punctuation or stand at either end of the text; other columns are unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.llm import common  # noqa: F401  (same session defaults as the other operators)

ROUNDS = 8
DIGITS = "0123456789"
HEX_LOWER = "0123456789abcdef"
HEX_UPPER = "0123456789ABCDEF"
ALNUM = DIGITS + "abcdefghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: 400 Gregorian years are 146,097 days = 189 * 773.
DAYS_A, DAYS_B = 189, 773
# FIXED VALUES — international calling codes: one digit, two digits, any other three.
CALLING_CODE = r"\+(?:[17]|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
FIRST_DAY, LAST_DAY = "1800-01-01", "2199-12-31"
#: Valid social security numbers: 898 areas, 99 groups, 9,999 serials.
SSN_AREAS, SSN_GROUPS, SSN_SERIALS = 898, 99, 9999

#: Java patterns; one text is searched for all of them at once, the first that fits at a place wins.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "date": r"(?<![\p{L}\p{N}.-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?:(?![\p{L}\p{N}]|[-/.]\d)|(?=[Tt]\d{2}(?::?\d{2})))",
    "ipv4": r"(?<![\p{L}\p{N}.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\p{L}\p{N}]|\.\d)",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\p{L}\p{N}])"
             # country code and groups of two to four; pairs after a leading zero; no separators
             r"|(?<![\p{L}\p{N}+])\+\d{1,3}[ .-](?:\(0\)[ .-]?)?(?:\(\d{1,4}\)[ .-]?|\d{1,4}[ .-])\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\p{L}\p{N}])"
             r"|(?<![\p{L}\p{N}]|\d[ .-])0\d(?:[ .-]\d{2}){4}(?![\p{L}\p{N}]|[ .-]\d)"
             r"|(?<![\p{L}\p{N}+])\+[1-9]\d{6,14}(?![\p{L}\p{N}])"
             r"|(?<![\p{L}\p{N}.,+]|\d-)\d{10}(?![\p{L}\p{N}]|[.,-]\d)",
    "number": r"(?<![\p{L}\p{N}])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?=[0-9A-Fa-f]{24})(?=[A-Fa-f]*\d)(?:[0-9a-f]{24,128}|[0-9A-F]{24,128})(?![\p{L}\p{N}])",
}
ANY = "|".join([PATTERNS["email"], PATTERNS["date"], PATTERNS["ipv4"], PATTERNS["ssn"], PATTERNS["iban"],
                PATTERNS["number"], PATTERNS["phone"], PATTERNS["secret"]])
KINDS = tuple(PATTERNS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once (a one-element transform)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def over(parts: list[Column], body: Callable[..., Column]) -> Column:
    """``body`` with several values computed once, as fields of a struct."""
    names = [f"p{i}" for i in range(len(parts))]
    return let(F.struct(*[p.alias(n) for p, n in zip(parts, names)]), lambda s: body(*[s[n] for n in names]))


#: Forward rounds, the step in the middle (round -1), and the same rounds undone.
SCHEDULE = [(r, 1) for r in range(ROUNDS)] + [(-1, 1)] + [(r, -1) for r in reversed(range(ROUNDS))]


def _schedule() -> Column:
    return F.array(*[F.struct(F.lit(r).alias("r"), F.lit(sign).alias("sign")) for r, sign in SCHEDULE])


def _draw(key: str, kind: str, r: Column, other: Column) -> Column:
    """128 hex digits that only the key's owner can compute."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), other, F.lit(key)), 512)


def permute_string(value: Column, alphabet: str, key: str, kind: str) -> Column:
    """Keyed permutation without fixed points of all strings of that length over
    ``alphabet``, of up to 128 characters."""
    base, letters, one = len(alphabet), F.lit(alphabet), F.lit(1)
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, one, half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))

    def shifted(text: Column, other: Column, step: Column) -> Column:
        """``text`` with the round's key stream added or taken away character by character."""
        def char(draw: Column) -> Callable[[Column], Column]:
            def at(i: Column) -> Column:
                add = F.conv(F.substring(draw, 2 * i - 1, F.lit(2)), 16, 10).cast("int")
                return F.substring(letters, F.pmod(F.instr(letters, F.substring(text, i, one)) - 1 + step["sign"] * add,
                                                   F.lit(base)) + 1, one)
            return at
        return F.when(F.length(text) == 0, F.lit("")).otherwise(let(_draw(key, kind, step["r"], other), lambda draw: F.array_join(
            F.transform(F.sequence(one, F.length(text)), char(draw)), "")))

    def turn(s: Column, step: Column) -> Column:
        right = step["r"] % 2 == 0
        new = shifted(F.when(right, s["r"]).otherwise(s["l"]), F.when(right, s["l"]).otherwise(s["r"]), step)
        bumped = let(_successor(F.concat(s["l"], s["r"]), alphabet), lambda v: F.struct(
            F.substring(v, one, F.length(s["l"])).alias("l"), F.substring(v, F.length(s["l"]) + 1, F.length(v)).alias("r")))
        return F.when(step["r"] < 0, bumped).otherwise(
            let(new, lambda n: F.struct(F.when(right, s["l"]).otherwise(n).alias("l"), F.when(right, n).otherwise(s["r"]).alias("r"))))

    order = "".join(sorted(alphabet, key=lambda c: hashlib.sha512(f"{key}|{kind}|{c}|{key}".encode()).digest()))
    return (F.when(F.length(value) == 0, value).when(F.length(value) == 1, F.translate(value, order, order[1:] + order[:1]))
            .otherwise(F.aggregate(_schedule(), start, turn, lambda s: F.concat(s["l"], s["r"]))))


def _successor(value: Column, alphabet: str) -> Column:
    """The next string of that length in the order of ``alphabet``; the first one after the last."""
    body = F.rtrim(value, F.lit(alphabet[-1]))
    zeros = F.repeat(F.lit(alphabet[0]), F.length(value) - F.length(body))
    last = F.translate(F.substring(body, F.length(body), F.lit(1)), alphabet, alphabet[1:] + alphabet[:1])
    return F.when(F.length(body) == 0, zeros).otherwise(F.concat(F.substring(body, F.lit(1), F.length(body) - 1), last, zeros))


def permute_integer(value: Column, a: int, b: int, key: str, kind: str) -> Column:
    """Keyed permutation without fixed points of the integers 0 .. a * b - 1."""
    def turn(s: Column, step: Column) -> Column:
        right = step["r"] % 2 == 0
        high, low = F.floor(s / b).cast("long"), F.pmod(s, F.lit(b)).cast("long")
        draw = _draw(key, kind, step["r"], F.when(right, high).otherwise(low).cast("string"))
        add = step["sign"] * F.conv(F.substring(draw, 1, 12), 16, 10).cast("long")
        return (F.when(step["r"] < 0, F.pmod(s + 1, F.lit(a * b)))
                .when(right, high * b + F.pmod(low + add, F.lit(b))).otherwise(F.pmod(high + add, F.lit(a)) * b + low)).cast("long")

    return F.aggregate(_schedule(), value.cast("long"), turn)


def refill(template: Column, pattern: str, filling: Column) -> Column:
    """``template`` with its characters of ``pattern`` replaced, in order, by those of ``filling``."""
    def put(acc: Column, char: Column) -> Column:
        hit = char.rlike(pattern)
        return F.struct(F.concat(acc["s"], F.when(hit, F.substring(filling, acc["i"], F.lit(1))).otherwise(char)).alias("s"),
                        (acc["i"] + F.when(hit, 1).otherwise(0)).alias("i"))
    return F.aggregate(F.split(template, "", -1), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), put, lambda acc: acc["s"])


def only(value: Column, pattern: str) -> Column:
    """The characters of ``value`` that are not in the negated class ``pattern``."""
    return F.regexp_replace(value, pattern, "")


def luhn_digit(digits: Column) -> Column:
    """The digit that completes ``digits`` to a number that passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def weight(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, 2 * d).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)
    total = F.aggregate(F.transform(places, weight), F.lit(0), lambda acc, x: acc + x)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))


def _email(m: Column, key: str) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.concat(refill(local, "[A-Za-z0-9]", permute_string(only(local, "[^A-Za-z0-9]"), ALNUM, key, "email")),
                    F.lit("@"), domain)


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, rf"^(?:{CALLING_CODE}[ .-]?(?:\(0\)[ .-]?)?|0(?=\d(?:[ .-]\d{{2}}){{4}}$))", 0)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    return F.concat(country, refill(rest, "[0-9]", permute_string(only(rest, "[^0-9]"), DIGITS, key, "phone")))


def _ipv4(m: Column, key: str) -> Column:
    octets = F.split(m, r"\.")
    value = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, o: acc * 256 + o.cast("long"))
    good = F.forall(octets, lambda o: o.cast("int") < 256)
    new = over([permute_integer(value, 65536, 65536, key, "ipv4")], lambda n: F.concat_ws(".", *[
        F.pmod(F.floor(n / 256 ** i), F.lit(256)).cast("long").cast("string") for i in (3, 2, 1, 0)]))
    return F.when(good, new).otherwise(m)


def _number(m: Column, key: str) -> Column:
    digits = only(m, "[^0-9]")

    def build(prefix: Column, last: Column) -> Column:
        def close(new: Column) -> Column:
            check = F.pmod(luhn_digit(new) + last - luhn_digit(prefix), F.lit(10)).cast("int").cast("string")
            return refill(m, "[0-9]", F.concat(new, check))
        return let(permute_string(prefix, DIGITS, key, "number"), close)
    return over([F.substring(digits, F.lit(1), F.length(digits) - 1), F.substring(digits, -1, 1).cast("int")], build)


def _mod97(text: Column) -> Column:
    """Remainder of the number that ``text`` stands for, letters as 10 to 35."""
    def put(acc: Column, char: Column) -> Column:
        value = F.instr(F.lit(DIGITS + ALNUM[36:]), char) - 1
        return F.pmod(acc * F.when(value > 9, 100).otherwise(10) + value, F.lit(97))
    return F.aggregate(F.split(text, "", -1), F.lit(0), put)


def _iban(m: Column, key: str) -> Column:
    compact = F.replace(m, F.lit(" "), F.lit(""))

    def build(country: Column, check: Column, account: Column) -> Column:
        def close(new: Column) -> Column:
            digits = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
            return refill(m, "[A-Z0-9]", F.concat(country, digits, new))
        good = (_mod97(F.concat(account, country, check)) == 1) & account.rlike("[0-9]")
        new = refill(account, "[0-9]", permute_string(only(account, "[^0-9]"), DIGITS, key, "iban"))
        return F.when(good, let(new, close)).otherwise(m)
    return over([F.substring(compact, 1, 2), F.substring(compact, 3, 2), F.substring(compact, F.lit(5), F.length(compact))], build)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.split(m, "-")[i].cast("int") for i in range(3))
    good = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    value = (place * SSN_GROUPS + group - 1).cast("long") * SSN_SERIALS + serial - 1

    def write(n: Column) -> Column:
        at = F.floor(n / (SSN_GROUPS * SSN_SERIALS))
        return F.concat_ws("-", F.lpad(F.when(at >= 665, at + 2).otherwise(at + 1).cast("string"), 3, "0"),
                           F.lpad((F.pmod(F.floor(n / SSN_SERIALS), F.lit(SSN_GROUPS)) + 1).cast("string"), 2, "0"),
                           F.lpad((F.pmod(n, F.lit(SSN_SERIALS)) + 1).cast("string"), 4, "0"))
    return F.when(good, let(permute_integer(value, SSN_AREAS, SSN_GROUPS * SSN_SERIALS, key, "ssn"), write)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    year_first = m.rlike(r"^\d{4}")
    mark = F.substring(only(m, "[0-9]"), 1, 1)
    parts = F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0))
    width = F.when(year_first, F.length(parts[2])).otherwise(F.length(parts[0]))

    def read(year: Column, month: Column, day: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    first = F.lit(FIRST_DAY).cast("date")

    def build(usual: Column, month_first: Column) -> Column:
        day = F.coalesce(usual, month_first)

        def write(n: Column) -> Column:
            new = F.date_add(first, n.cast("int"))
            # a value written without leading zeros stays so where the new number allows it
            d, mo = F.lpad(F.day(new).cast("string"), 2, "0"), F.lpad(F.month(new).cast("string"), 2, "0")
            y = F.year(new).cast("string")
            return F.when(year_first, F.concat_ws("-", y, mo, d)).when(usual.isNull(), F.concat_ws("-", mo, d, y)).otherwise(
                F.concat_ws("-", d, mo, y))

        good = day.isNotNull() & (day >= first) & (day <= F.lit(LAST_DAY).cast("date")) & (width <= 2)
        new = let(permute_integer(F.datediff(day, first), DAYS_A, DAYS_B, key, "date"), write)
        return F.when(good, F.replace(new, F.lit("-"), mark)).otherwise(m)
    return over([F.when(year_first, read(parts[0], parts[1], parts[2])).otherwise(read(parts[2], parts[1], parts[0])),
                 F.when(~year_first, read(parts[2], parts[0], parts[1]))], build)


def _secret(m: Column, key: str) -> Column:
    return F.when(m.rlike("^[0-9a-f]*$"), permute_string(m, HEX_LOWER, key, "secret")).otherwise(
        permute_string(m, HEX_UPPER, key, "secret"))


def kind_of(m: Column) -> Column:
    """The kind of one match of ``ANY``, by its shape alone."""
    return (F.when(F.contains(m, F.lit("@")), "email")
            .when(m.rlike(r"^(\d{4}([-/.])\d{1,2}\2\d{1,2}|\d{1,2}([-/.])\d{1,2}\3\d{4})$"), "date")
            .when(m.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), "ipv4")
            .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
            .when(m.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$"), "iban")
            .when(m.rlike(r"^(\+.*|\d{10}|0\d([ .-]\d{2}){4})$"), "phone")
            .when(m.rlike(r"^\d+$") & (F.length(m) < 20), "number")
            .when(m.rlike(r"^([0-9a-f]{24,}|[0-9A-F]{24,})$"), "secret")
            .when(m.rlike(r"^(\+\d{1,3}[ .-]?)?(\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}$"), "phone")
            .otherwise("number"))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match."""
    writers = {"email": _email, "date": _date, "ipv4": _ipv4, "ssn": _ssn, "iban": _iban, "phone": _phone,
               "number": _number, "secret": _secret}

    def write(kind: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, writer in writers.items():
            out = F.when(kind == name, writer(m, key)).otherwise(out)
        return out
    return let(kind_of(m), write)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """``docs`` with every value in ``text_col`` replaced; ``found_col`` adds the
    matches as an array. Only texts with a digit or an ``@`` are searched."""
    text = F.col(text_col).cast("string")
    matches, between = F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.split(text, ANY, -1)
    may = text.rlike("[0-9@]")
    if found_col is not None:
        docs = docs.withColumn(found_col, F.when(may, matches).otherwise(F.array().cast("array<string>")))
    new = over([matches, between], lambda found, gaps: F.concat(F.array_join(F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, m: F.concat(gap, pseudonym(m, key))), ""),
        F.element_at(gaps, -1)))
    return docs.withColumn(text_col, F.when(may, new).otherwise(text))
