import datetime
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nodetide.llm import pii

KEY = "k1"
CLEAN = ["Version 1.2.3.4.5 of 2024, 12 apples and 3.14", "call 555 or row 1234567890123456", "300.1.1.1 and 99/99/2020 and a@b and @home", "x" * 50 + " 7" * 50, "éàü 12%"]
PRIVATE = {
    "email": ["bosbt.42@mail8.example.com", "A.B-c_9@x.org"], "card": ["4111111111111111", "4111-1111-1111-1111", "378282246310005"],
    "phone": ["+1 (743) 555-3824", "743-555-3824", "+44 20 7946 0958"], "ip": ["152.143.123.131", "8.8.8.8"], "iban": ["GB82 WEST 1234 5698 7654 32"],
    "ssn": ["078-05-1120"], "date": ["2024-02-29", "12/31/1999", "31/12/1999", "01.02.2003"],
}


@pytest.mark.parametrize("size", [1, 2, 7, 100, 257])
def test_permutation_is_one(size):
    p = pii.Permutation(KEY, "x")
    images = [p.apply(i, size) for i in range(size)]
    assert sorted(images) == list(range(size)) and [p.apply(i, size, True) for i in images] == list(range(size))
    odd = [p.apply(i, size, fits=lambda n: n % 2 == 1) for i in range(size)]
    assert sorted(odd) == list(range(size)) and all(i % 2 == j % 2 for i, j in enumerate(odd))


@pytest.mark.parametrize("kind", pii.KINDS)
def test_values_keep_their_format_and_come_back(kind):
    there, back = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, back=True)
    for value in PRIVATE[kind]:
        text = f"Zu {value}, or: {value}!"
        made, counts = there.replace(text)
        assert counts == {kind: 2} and value not in made
        image = made[3:3 + len(value)] if len(made) == len(text) else re.match(r"Zu (\S+),", made)[1]
        assert made == f"Zu {image}, or: {image}!" and there.replace(image)[1] == {kind: 1}
        if kind != "ip":
            assert re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", image))) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", value)))
        assert back.replace(made)[0] == text
        assert pii.Pseudonyms("other").replace(text)[0] != made
    assert pii.luhn(re.sub(r"\D", "", there.value("card", "4111-1111-1111-1111")))


def test_equal_values_are_linked_whatever_their_separators():
    p = pii.Pseudonyms(KEY)
    plain = lambda s: re.sub(r"\D", "", s)
    assert plain(p.value("card", "4111 1111 1111 1111")) == p.value("card", "4111111111111111")
    assert plain(p.value("phone", "+1 (743) 555-3824"))[-10:] == plain(p.value("phone", "743.555.3824"))


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay(text):
    assert pii.Pseudonyms(KEY).replace(text) == (text, {})


@settings(max_examples=300, deadline=None)
@given(st.dates(datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)), st.sampled_from(["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%d.%m.%Y"]))
def test_dates_come_back(day, form):
    text = day.strftime(form)
    made, counts = pii.Pseudonyms(KEY).replace(text)
    assert counts == {"date": 1} and pii.Pseudonyms(KEY, back=True).replace(made)[0] == text


def test_frames_and_edges(spark):
    rng = random.Random(1)
    private = [v for vs in PRIVATE.values() for v in vs]
    long = "word " * 300_000 + private[0]
    texts = [None, "", long, *CLEAN, *[" ".join([*rng.sample(CLEAN, 2), rng.choice(private), "end"]) for _ in range(40)], CLEAN[0], CLEAN[0]]
    rows = [(i, t, 7, "x") for i, t in enumerate(texts)] + [(None, private[0], 1, None), (3, CLEAN[0], 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_email int, made string")
    want = pii.Pseudonyms(KEY)
    got = pii.pseudonymise(df, KEY).collect()
    assert [(r.doc_id, r.text) for r in got] == [(i, want.replace(t)[0]) for i, t, _, _ in rows]
    assert got[2].n_email == 1 and got[0].n_email == 0
    kept = pii.replaced(df, KEY)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(i, want.replace(t)[0], n, m) for i, t, n, m in rows]
    assert pii.pseudonymise(df.limit(0), KEY).count() == 0


IBANS = ["ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "BE68 5390 0754 7034", "PL61 1090 1014 0000 0712 1981 2874",
         "SE45 5000 0000 0583 9825 7466", "CZ65 0800 0000 1920 0014 5399", "GB82 WEST 1234 5698 7654 32"]


@pytest.mark.parametrize("iban", [*IBANS, "ES9121000418450200051332"])
@pytest.mark.parametrize("after", [" BIC CAIXESBB", " 2024", " EUR", " EUR 20", " BIC@x.org", ""])
def test_an_iban_ends_where_its_country_says(iban, after):
    text = f"an {iban}{after}"
    made, counts = pii.Pseudonyms(KEY).replace(text)
    assert counts["iban"] == 1 and iban not in made and made[:5] == text[:5] and len(made) == len(text)
    if "@" not in after:
        assert made.endswith(after)
    assert pii.Pseudonyms(KEY, back=True).replace(made)[0] == text


@pytest.mark.parametrize("after", ["T10:30:00Z", "T10:30", "T1030Z", "t10:30:00+01:00", "Z", " 10:30"])
def test_dates_before_a_time_are_linked(after):
    p = pii.Pseudonyms(KEY)
    made, counts = p.replace(f"at 2024-01-15{after}, 2024-01-15")
    new = p.value("date", "2024-01-15")
    assert counts == {"date": 2} and made == f"at {new}{after}, {new}"


@pytest.mark.parametrize("text", ["2024-01-15th", "2024-01-15Tx", "2024-01-15Zulu"])
def test_other_letters_after_a_date(text):
    assert pii.Pseudonyms(KEY).replace(text) == (text, {})


def test_long_local_parts_are_replaced_whole():
    text = "to " + "abcdefghij" * 7 + ".k@mail.example.com now"
    made, counts = pii.Pseudonyms(KEY).replace(text)
    assert counts == {"email": 1} and len(made) == len(text)
    assert sum(a == b for a, b in zip(made[3:73], text[3:73])) < 20 and pii.Pseudonyms(KEY, back=True).replace(made)[0] == text
