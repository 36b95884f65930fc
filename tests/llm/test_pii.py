import datetime
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from litspark.llm import pii

KEY = "test key"


def luhn_ok(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(text):
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def masked(spark, texts, key=KEY):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pii.pseudonymise(rows, key, found_col="found").orderBy("doc_id").collect()
    return [r["text"] for r in out], [r["found"] for r in out]


VALUES = {
    "email": ["les.99@mail4.example.com", "Jo+tag@sub.mail.org", "für.12@mail1.example.com", "a@b.co"],
    "phone": ["+1 (017) 555-7713", "(030) 555-7713", "555-123-4567", "+49 030 5557 7713"],
    "ipv4": ["152.143.123.131", "0.0.0.0", "255.255.255.255"],
    "card": ["4111111111111111", "4111 1111 1111 1111", "3782-822463-10005", "6011000990139424"],
    "number": ["4785380592391130", "1234567890123"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
    "ssn": ["123-45-6789", "899-99-9999"],
    "date": ["1980-02-29", "2024/12/31", "31.12.1999", "01-02-2003"],
    "secret": ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"],
}


def test_every_kind_keeps_its_format_and_changes(spark):
    flat = [(k, v) for k, vs in VALUES.items() for v in vs]
    texts, found = masked(spark, [f"see {v}, ok" for _, v in flat])
    for (kind, value), text, hits in zip(flat, texts, found):
        new = re.fullmatch("see (.*), ok", text)[1]
        assert hits == [value] and new != value and (len(new) == len(value) or kind == "ipv4"), (kind, value, new)
        shape = lambda s: re.sub("[0-9]", "9", s)
        if kind in ("phone", "card", "number", "ssn", "date"):
            assert shape(new) == shape(value)
        if kind == "card":
            assert luhn_ok(re.sub(r"\D", "", new))
        if kind == "number":
            assert luhn_ok(re.sub(r"\D", "", value)) == luhn_ok(re.sub(r"\D", "", new))
        if kind == "iban":
            assert iban_ok(new) and new[:2] == value[:2]
        if kind == "email":
            assert new.split("@")[1] == value.split("@")[1]
        if kind == "date":
            y, m, d = re.findall(r"\d+", new) if re.match(r"\d{4}", new) else re.findall(r"\d+", new)[::-1]
            assert 1800 <= datetime.date(int(y), int(m), int(d)).year <= 2199
        if kind == "secret":
            assert re.fullmatch("[0-9a-f]+" if value[2].islower() or value[-1].islower() else "[0-9A-F]+", new)


def test_month_first_dates_and_timestamps(spark):
    values = ["03/25/2024", "12-31-1999", "2.28.2001", "2024-01-15T10:30:00Z", "2024-01-15T1030", "2024/1/5"]
    texts, found = masked(spark, [f"see {v}, ok" for v in values])
    for value, text, hits in zip(values, texts, found):
        new, date = re.fullmatch("see (.*), ok", text)[1], re.split("T", value)[0]
        assert hits == [date] and new.endswith(value[len(date):]) and not new.startswith(date)
        parts = list(map(int, re.findall(r"\d+", new)[:3]))
        y, m, d = parts if value[:4].isdigit() else (parts[2], parts[0], parts[1])
        assert 1800 <= datetime.date(y, m, d).year <= 2199
    left = ["13/25/2024", "02/30/2024", "2024-01-15Tuesday", "2024-02-30T10:30:00Z"]
    assert masked(spark, left)[0] == left


def test_telephone_numbers_without_separators_and_in_pairs(spark):
    values = ["+14155552671", "+33 1 23 45 67 89", "+33123456789", "01 23 45 67 89", "01.23.45.67.89", "4155552671", "+49 30 12 34 56",
              "+442079460958", "+44 20 7946 0958", "+33 (0)1 23 45 67 89", "+1 415 555 2671", "+998901234567890"]
    texts, found = masked(spark, [f"call {v}, ok" for v in values])
    for value, text, hits in zip(values, texts, found):
        new = re.fullmatch("call (.*), ok", text)[1]
        assert hits == [value] and new != value and re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", value), (value, hits, new)
        if " " in value and value[0] == "+":
            assert new.split()[0] == value.split()[0]
    left = ["+123456", "123456789", "12345678901", "3.1415926535", "12 34 56", "order 01 23 45", "a+14155552671b"]
    assert masked(spark, left)[0] == left


def test_octets_stay_octets(spark):
    texts, _ = masked(spark, [f"{a}.{b}.7.9" for a in range(0, 256, 17) for b in (0, 128, 255)])
    assert all(0 <= int(x) <= 255 for t in texts for x in t.split(".")) and len(set(texts)) == len(texts)


def test_same_value_same_pseudonym_and_other_key_other_value(spark):
    a, _ = masked(spark, ["x 4111111111111111 y", "4111111111111111!", "(4111111111111111)"])
    assert len({re.search(r"\d{16}", t)[0] for t in a}) == 1
    b, _ = masked(spark, ["x 4111111111111111 y"], "another key")
    assert b[0] != a[0]


def test_invalid_values_and_plain_numbers_are_left_alone(spark):
    texts = ["300.1.1.1", "2000-02-31", "31/02/2000", "000-12-3456", "version 2.0.1", "page 42 of 1999", "GB00 WEST 1234 5698 7654 32",
             "only words", "abcdefabcdefabcdefabcdefabcd", "", None]
    assert masked(spark, texts)[0] == texts


@pytest.mark.parametrize("base", ["0123456789", "0123456789abcdef"])
def test_strings_are_permuted_without_fixed_points(spark, base):
    n = len(base) ** 2
    df = spark.range(n).select(F.concat(*[F.substring(F.lit(base), (F.floor(F.col("id") / len(base) ** i) % len(base) + 1).cast("int"),
                                                      F.lit(1)) for i in (1, 0)]).alias("x"))
    rows = df.select("x", pii.permute_string(F.col("x"), base, KEY, "t").alias("y")).collect()
    assert {r["x"] for r in rows} == {r["y"] for r in rows} and all(r["x"] != r["y"] for r in rows) and len(rows) == n


def test_odd_short_and_long_strings(spark):
    for length in (1, 2, 3, 5, 128):
        df = spark.range(50).select(F.rpad(F.col("id").cast("string"), length, "7").alias("x")).distinct()
        rows = df.select("x", pii.permute_string(F.col("x"), "0123456789", KEY, "t").alias("y")).collect()
        assert len({r["y"] for r in rows}) == len(rows) and all(len(r["y"]) == length and r["x"] != r["y"] for r in rows)


def test_dates_are_permuted_over_the_whole_cycle(spark):
    n = pii.DAYS_A * pii.DAYS_B
    assert n == (datetime.date(2199, 12, 31) - datetime.date(1800, 1, 1)).days + 1
    out = spark.range(n).select("id", pii.permute_integer(F.col("id"), pii.DAYS_A, pii.DAYS_B, KEY, "date").alias("y"))
    assert out.agg(F.countDistinct("y"), F.min("y"), F.max("y"), F.count_if(F.col("y") == F.col("id"))).first()[:] == (n, 0, n - 1, 0)


def test_text_around_the_values_is_unchanged(spark, sample):
    out = pii.pseudonymise(sample, KEY, found_col="found").select("doc_id", "text", "found")
    old = {r["doc_id"]: r["text"] for r in sample.collect()}
    links = defaultdict(set)
    for r in out.collect():
        gaps = old[r["doc_id"]]
        pattern = ""
        for value in r["found"]:
            head, gaps = gaps.split(value, 1)
            pattern += re.escape(head) + "(.+)"
        got = re.fullmatch(pattern + re.escape(gaps), r["text"], re.S)
        assert got
        for value, new in zip(r["found"], got.groups()):
            links[value].add(new)
            assert value != new
    assert links and all(len(v) == 1 for v in links.values())


def test_messy_rows_and_plan(messy, nothing):
    out = pii.pseudonymise(messy, KEY)
    assert out.columns == messy.columns and out.schema["text"].dataType == messy.schema["text"].dataType
    assert sorted(map(str, (r["text"] for r in out.collect()))) == sorted(map(str, (r["text"] for r in messy.collect())))
    assert pii.pseudonymise(nothing, KEY).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan.replace("Exchange RoundRobin", "")


@pytest.mark.parametrize("alphabet", [pii.DIGITS, pii.ALNUM])
def test_pseudonyms_of_pseudonyms_do_not_come_back(spark, alphabet):
    values = [alphabet[-1] * 6, alphabet[0] * 5, alphabet[:7], alphabet[-2:]]
    df = spark.createDataFrame([(v, v) for v in values], "x string, y string")
    for step in range(1, 17):
        df = spark.createDataFrame(df.select("x", pii.permute_string(F.col("y"), alphabet, KEY, "t").alias("y")).collect(), "x string, y string")
        if step in (1, 2, 8, 10, 16):
            assert all(r["x"] != r["y"] for r in df.collect()), step


def test_strings_have_one_cycle(spark):
    df = spark.range(100).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("x"))
    step = dict(map(tuple, df.select("x", pii.permute_string(F.col("x"), pii.DIGITS, KEY, "t")).collect()))
    value, seen = "00", set()
    while value not in seen:
        seen.add(value)
        value = step[value]
    assert len(seen) == 100


def test_one_character_depends_on_the_key(spark):
    df = spark.createDataFrame([(c,) for c in pii.ALNUM], "x string")
    maps = [dict(map(tuple, df.select("x", pii.permute_string(F.col("x"), pii.ALNUM, key, "email")).collect())) for key in ("one", "two")]
    assert all(sorted(m) == sorted(m.values()) and all(a != b for a, b in m.items()) for m in maps)
    assert sum(maps[0][c] != maps[1][c] for c in pii.ALNUM) > 50
    assert masked(spark, ["write to j@x.org"])[0][0].endswith("@x.org")


def test_one_number_in_several_notations_is_linked_and_keeps_its_kind(spark):
    forms = ["+33123456789", "+33 1 23 45 67 89", "+33 (0)1 23 45 67 89", "+33.1.23.45.67.89", "01 23 45 67 89", "+1 415-555-2671", "+14155552671",
             "+44 20 7946 0958", "+442079460958"]
    new, found = masked(spark, forms)
    assert found == [[f] for f in forms]
    digits = [re.sub("[^0-9]", "", n) for n in new]
    assert digits[0] == digits[1] == digits[3] and digits[2] == digits[0][:2] + "0" + digits[0][2:] and digits[4] == "0" + digits[0][2:]
    assert digits[5] == digits[6] and digits[7] == digits[8] and digits[0] != "33123456789"
    assert masked(spark, new)[1] == [[n] for n in new]
