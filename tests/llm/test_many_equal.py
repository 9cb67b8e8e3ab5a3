"""Texts full of matches, and many equal rows: work that grows with the rows, not with their square."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from murmur.llm import langid, pii, substring_dedup

from .conftest import SCHEMA, prose

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    each = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in each) % 10 == 0


def base_by_contract(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    out = [("email", m) for m in EMAIL.finditer(text)]
    out += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m) for m in CARD.finditer(text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [("phone", m) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def found(spark, texts):
    rows = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r["doc_id"]: r for r in rows}


def test_random_texts_against_the_contract(spark):
    r = random.Random(11)
    bits = ["a", "b.c", "@", ".", "-", " ", "+", "1", "42", "255", "256", "é", "😀", "(", ")", "\n", "_%", "10.0.0.1", "x@y.z", "4111 1111 1111 1111", "+1 (555) 010-9999", "0000000000000000", "GB82 WEST 1234 5698 7654 32"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 60))) for _ in range(2500)]
    texts += [" ".join(r.choice(bits) for _ in range(700)) for _ in range(12)]  # more matches than one block
    got = found(spark, texts)
    for i, t in enumerate(texts):
        assert [(x["kind"], x["start"], x["end"]) for x in got[i]["findings"] if x["kind"] in pii.BASE] == base_by_contract(t), t


def redacted_by_force(text, findings):
    out, at = [], 0
    for start, _, kind, end in sorted((x["start"], x["end"], x["kind"], x["end"]) for x in findings):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join(out) + text[at:]


def test_long_texts_of_many_matches_are_redacted_whole(spark):
    r = random.Random(2)
    unit = ["mail a.b@c.org ", "12 x ", "GB82WEST12345698765432, ", "é" * 40, "10.1.2.3 ", "4111111111111111 ", "ssn 123-45-6789 ", " filler" * 200]
    texts = ["".join(r.choice(unit) for _ in range(n)) for n in (1, 255, 256, 257, 1500)] + [None, "", "none"]
    got = found(spark, texts)
    for i, t in enumerate(texts):
        assert got[i]["redacted"] == (None if t is None else redacted_by_force(t, got[i]["findings"]))
    assert len(got[4]["findings"]) > 3 * pii.MANY


@pytest.mark.parametrize("unit", ["12 x ", "a@b.co, "])
def test_a_text_of_many_matches_ends(spark, unit):
    found(spark, [unit])  # compiled
    at = time.monotonic()
    got = found(spark, [unit * 60_000])
    assert len(got[0]["findings"]) == (60_000 if "@" in unit else 0) and time.monotonic() - at < 60


def test_numbers_are_no_letters():
    assert not any(map(langid.has_letter, ["½", "² ³", "12_34", "Ⅷ", "%", "①"])) and all(map(langid.has_letter, ["x", "é", "漢", "½a", "ª"]))


def test_a_thousand_equal_rows_of_one_text(spark):
    text, other = prose(1, 300, 5000), prose(2, 100, 5000)
    rows = [(None, text, "en", "a", 1)] * 1000 + [(5, text, "en", "a", 1)] * 3 + [(6, other, "en", "a", 1), (None, other + " tail", "en", "a", 1), (7, prose(3, 80, 5000), None, None, 1)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4)).groupBy("doc_id", "n_words", "n_removed").agg(F.count("*").alias("n")).collect()
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["n"]) for r in got} == {(None, 300, 300, 1000), (5, 300, 300, 3), (6, 100, 100, 1), (None, 101, 100, 1), (7, 80, 0, 1)}
