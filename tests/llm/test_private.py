"""Pseudonyms: one for all forms of a value, for others other ones; time in proportion to the text."""

import re
import time
from datetime import date, timedelta

import pytest

from glyphmill.llm import private

P = private.Pseudonyms(b"a key of the tests")


def _new(text):
    return P.replace(text)[0]


def test_forms_of_a_telephone_number():
    forms = ["+1 555 123 4567", "+15551234567", "+1 (555) 123-4567", "+1.555.123.4567", "(555) 123-4567", "555-123-4567", "555.123.4567"]
    own = {re.sub("[^0-9]", "", _new(f))[-10:] for f in forms}
    assert len(own) == 1 and own != {"5551234567"} and all(len(_new(f)) == len(f) for f in forms)
    assert _new("+49 30 123 4567")[:4] == "+49 " and re.sub("[^0-9]", "", _new("+49 30 123 4567")) == _new("+49301234567")[1:]


def test_forms_of_a_date():
    for k in range(0, 60_000, 371):
        d = date(1910, 1, 1) + timedelta(k)
        iso = _new(d.isoformat())
        y, m, day = iso.split("-")
        assert _new(f"{d.year}/{d.month:02d}/{d.day:02d}") == f"{y}/{m}/{day}" and _new(f"{d.year}/{d.month}/{d.day}") == f"{y}/{int(m)}/{int(day)}"
        assert _new(f"{d.day:02d}/{d.month:02d}/{d.year}") == f"{day}/{m}/{y}" and _new(f"{d.day}.{d.month}.{d.year}") == f"{int(day)}.{int(m)}.{y}"
        if d.day > 12:
            assert _new(f"{d.month:02d}/{d.day:02d}/{d.year}") == f"{m}/{day}/{y}"


def test_ibans_are_checked_group_by_group():
    for iban in ("GB82WEST12345698765432", "DE89370400440532013000", "FR1420041010050500013M02606"):
        spaced = " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))
        assert _new(spaced).replace(" ", "") == _new(iban) != iban and private._mod97(_new(iban)) == 1
        assert private._mod97(iban) == int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_different_values_stay_different():
    dates = [(date(1999, 1, 1) + timedelta(k)).isoformat() for k in range(3000)]
    assert len({_new(d) for d in dates}) == 3000
    long_ = ["token=" + "ab1" * 40 + str(k) * 9 for k in range(10)]
    assert len({_new(t) for t in long_}) == 10 and all(_new(t) != t and len(_new(t)) == len(t) for t in long_)


@pytest.mark.parametrize("text", ["a" * 1_000_000, "a" * 500_000 + "@", "a@" * 500_000, "a.b@c" * 30_000, "token=" + "A1b" * 300_000, "token " * 150_000, "1" * 1_000_000, "+1 " * 300_000, "AB12 " * 200_000, "1.2." * 200_000, "12-" * 300_000])
def test_very_long_texts(text):
    began = time.perf_counter()
    assert len(_new(text)) == len(text)
    assert time.perf_counter() - began < 4


def test_key_of_the_session(spark):
    assert private.key_of(spark) != private.key_of(spark)
    spark.conf.set(private.KEY_SETTING, "given")
    try:
        assert private.key_of(spark) == b"given"
    finally:
        spark.conf.unset(private.KEY_SETTING)


def test_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "call +1 555 123 4567", 5), (3, "call +1 555 123 4567", 5), (None, "1999-02-28", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_phone int")
    got = private.pseudonymise(df, b"a key of the tests").collect()
    assert [r["text"] for r in got] == [None if t is None else _new(t) for _, t, _ in rows] and [r["n_phone"] for r in got] == [0, 0, 1, 1, 0]
    assert private.pseudonymise(df.where("false"), b"k").count() == 0
