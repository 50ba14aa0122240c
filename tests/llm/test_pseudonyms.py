"""Permutations, formats and validity of pseudonyms."""

from __future__ import annotations

import datetime
import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folium.llm import pseudonyms as ps
from folium.llm.queries import op10_pseudonyms

KEY = b"k" * 32


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000, 1024])
def test_permutation(size):
    assert sorted(ps.permute(x, size, KEY, "t") for x in range(size)) == list(range(size))


@settings(deadline=None, max_examples=50)
@given(st.integers(2, 10**18), st.integers(0, 10**18))
def test_in_range(size, x):
    assert 0 <= ps.permute(x % size, size, KEY, "t") < size


VALUES = {
    "email": ["bob.smith42@mail8.example.com", "a@b.co"],
    "card": ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005"],
    "ssn": ["123-45-6789"],
    "phone": ["+1 (456) 555-2186", "(030) 1234 567", "212-555-0187", "+49 30 1234567"],
    "ip": ["42.144.35.254"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
    "date": ["1980-02-29", "29.2.1980", "2/29/1980", "31/12/1999", "2024/03/05", "03-05-1980", "1850-01-02", "12 March 1980", "March 3rd, 1980", "1 mars 2001", "3. Dezember 1999", "12 de mayo de 1980"],
}
BAD = ["4111111111111112", "4026083977531332"[:-1] + "0", "000-12-3456", "666-12-3456", "256.1.1.1", "1.2.3", "GB83 WEST 1234 5698 7654 32", "1980-02-30", "31.4.1999", "1799-01-01", "12345", "12345678901234567890", "x@y", "7-8-9"]


@pytest.mark.parametrize(("kind", "value"), [(k, v) for k, vs in VALUES.items() for v in vs])
def test_formats(kind, value):
    text = f"so é {value} and {value}, end"
    new, found = ps.replace(text, KEY)
    assert [(k, text[a:b]) for a, b, k in found] == [(kind, value)] * 2
    first, second = re.fullmatch("so é (.*) and (.*), end", new).groups()
    assert first == second != value
    assert ps.replace(f"x {first} y", KEY)[1][0][2] == kind  # valid again
    if kind not in ("date", "ip"):
        assert re.sub("[0-9]", "9", re.sub("[a-z]", "a", first)) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", value))
    assert ps.replace(text, b"other")[0] != new


@pytest.mark.parametrize("value", BAD)
def test_not_valid(value):
    assert ps.replace(f"so {value} end", KEY) == (f"so {value} end", [])


@pytest.mark.parametrize("value", ["+14155552671", "+33612345678", "+44 7911 123456", "+447911123456", "06 12 34 56 78", "030 1234567", "06.12.34.56.78", "030/1234567", "2125550187"])
def test_compact_and_national_phones(value):
    new, found = ps.replace(f"so {value} and {value}, end", KEY)
    assert [k for _, _, k in found] == ["phone"] * 2 and value not in new
    first, second = re.fullmatch("so (.*) and (.*), end", new).groups()
    assert first == second and re.sub("[0-9]", "9", first) == re.sub("[0-9]", "9", value) and ps.replace(first, KEY)[1][0][2] == "phone"


def test_separators_do_not_change_a_phone():
    compact, spaced = (ps.replace(v, KEY)[0] for v in ("+14155552671", "+1 415 555 2671"))
    assert compact == spaced.replace(" ", "")


def test_dates_in_any_format_are_linked():
    days = [ps.replace(v, KEY)[0] for v in ("1980-03-09", "9.3.1980", "3/9/1980")]
    y, m, d = map(int, days[0].split("-"))
    assert days[1] == f"{d}.{m}.{y}" and days[2] == f"{m}/{d}/{y}" and datetime.date(y, m, d)


def test_rows(spark, documents):
    texts = ["mail bob@x.example.org", "also bob@x.example.org!", None, "", "nothing here", "1 " * 20_000 + "4111111111111111", "a" * 100_000 + "@"]
    got = ps.pseudonymise(documents(texts), "k").collect()
    assert got[0].text.split()[1] == got[1].text.split()[1].rstrip("!") and got[0].n_email == 1 and got[0].spans == "email:5:22"
    assert got[2].text is None and got[2].spans == "" and got[3].text == "" and got[4].text == "nothing here"
    assert got[5].n_card == 1 and got[6].text == texts[6]
    assert ps.pseudonymise(documents([]).limit(0), "k").collect() == []


def test_named_dates_are_linked():
    iso = ps.replace("1980-03-12", KEY)[0]
    day = datetime.date.fromisoformat(iso)
    names = [ps.MONTHS[k][day.month - 1] for k in range(4)]
    assert ps.replace("12 March 1980", KEY)[0] == f"{day.day} {names[0].capitalize()} {day.year}"
    assert ps.replace("12. März 1980", KEY)[0] == f"{day.day}. {names[2].capitalize()} {day.year}"
    assert ps.replace("12 de marzo de 1980", KEY)[0] == f"{day.day} de {names[3]} de {day.year}"
    assert ps.replace("1980/03/12", KEY)[0].replace("/", "-") == iso and ps.replace("31 February 1980", KEY)[1] == []


def test_query_against_plain_replacement(spark, documents, tmp_path):
    """The whole query against replace() text by text, and against the values that were planted."""
    values = [v for vs in VALUES.values() for v in vs]
    rows = [(k, f"so é {values[k % len(values)]}, and {values[(k * 7 + 1) % len(values)]}. end" if k % 3 else "plain words only", "en", "s") for k in range(200)] + [(900, None, None, None), (901, "", None, None), (None, values[0], None, None)]
    documents(rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op10_pseudonyms(spark, str(tmp_path)).collect()}
    secret = hashlib.sha256(b"for tests, where the setting is missing").digest()
    for i, text, _, _ in rows:
        new, found = ps.replace(text or "", secret)
        assert (got[i].text or "") == new and got[i].spans == ",".join(f"{k}:{a}:{b}" for a, b, k in found)
        assert text is None or i in (901,) or (i is not None and i % 3 == 0) or len(found) == (1 if i is None else 2)
