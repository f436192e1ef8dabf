"""The native operator against a plain version of the same network, and its checks."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from sparkfeat.llm import pii
from .conftest import EDGE

KEY = "k"


def plain_permuted(value, kind):
    def alphabet(c):
        if kind in ("secret", "ip"):
            return "0123456789abcdef"
        return next((a for a in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in a), None)

    def shifted(half, other, r):
        out = ""
        for i, c in enumerate(half):
            stream = hashlib.sha256(f"{KEY}|{kind}|{r}|{len(value)}|{other}|{i // 8}".encode()).hexdigest()
            letters = alphabet(c)
            out += c if letters is None else letters[(letters.index(c) + int(stream[i % 8 * 8:i % 8 * 8 + 8], 16)) % len(letters)]
        return out
    a, b = value[:len(value) // 2], value[len(value) // 2:]
    for r in range(pii.ROUNDS):
        a, b = (shifted(a, b, r), b) if r % 2 == 0 else (a, shifted(b, a, r))
    return a + b


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def replaced(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.text for r in pii.pseudonymize(df, KEY).sort("doc_id").collect()]


@pytest.mark.parametrize("kind,values", [("ssn", ["123456789", "000000000"]), ("email", ["john.Doe+99", "a", "x_y"]), ("secret", ["0af9" * 10]), ("ip", ["c0a80001"])])
def test_equals_the_plain_network(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r.p for r in df.select(pii.permuted(F.col("v"), kind, KEY).alias("p")).collect()] == [plain_permuted(v, kind) for v in values]


def test_is_a_permutation(spark):
    three = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    assert three.select(pii.permuted(F.col("v"), "ssn", KEY)).distinct().count() == 1000


def test_formats_checks_and_links(spark):
    card, bad = "4316522678525456", "4316522678525457"
    a, b, c, d, e, f = replaced(spark, [
        f"pay {card} or {card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]}; not {bad}.", f"{card}", "from 10.0.0.255, not 10.0.0.256",
        "on 2024-02-29, 29.02.2024 and 02/29/2024, not 2023-02-29", "GB82WEST12345698765432 DE89 3704 0044 0532 0130 00",
        "x.7@mail.example.com +1 (293) 555-9179 123-45-6789 " + "0af9" * 10])
    new = b
    assert new != card and luhn(new) and new == plain_permuted(card[:-1], "card") + new[-1]
    assert a == f"pay {new} or {new[:4]}-{new[4:8]}-{new[8:12]}-{new[12:]}; not {bad}."
    assert c.endswith("not 10.0.0.256") and "10.0.0.255," not in c
    dates = d.replace(",", "").split(" ")
    iso = datetime.date.fromisoformat(dates[1])
    assert d == f"on {iso}, {iso:%d.%m.%Y} and {iso:%m/%d/%Y}, not 2023-02-29" and str(iso) != "2024-02-29"
    for iban in (e[:22], e[23:].replace(" ", "")):
        digits = "".join(str(int(x, 36)) for x in iban[4:] + iban[:4])
        assert int(digits) % 97 == 1
    assert e[:2] == "GB" and "WEST" not in e and "3704" not in e
    assert "@mail.example.com" in f and "x.7@" not in f and "555-9179" not in f and "123-45-6789" not in f and "0af9" * 10 not in f
    assert len(f) == len("x.7@mail.example.com +1 (293) 555-9179 123-45-6789 " + "0af9" * 10)


def test_digits_beside_a_card_do_not_hide_it(spark):
    card = "4111111111111111"
    parted = "4111 1111 1111 1111"
    texts = [card, f"{card} 12/27", f"{parted} 123", f"5 {card}", f"12 {parted} 123", f"1234 5678 {parted}", f"{card} 10.0.0.1",
             f"{card} 555-123-4567", f"555 123 {parted}", f"{card} 2024-02-29", "3782 822463 10005 12/27"]
    out = replaced(spark, texts)
    new = out[0]
    spaced = " ".join(new[i:i + 4] for i in range(0, 16, 4))
    assert luhn(new) and new != card
    assert out[1:6] == [f"{new} 12/27", f"{spaced} 123", f"5 {new}", f"12 {spaced} 123", f"1234 5678 {spaced}"]
    assert out[6].startswith(f"{new} ") and not out[6].endswith("10.0.0.1")
    assert out[7].startswith(f"{new} ") and not out[7].endswith("555-123-4567")
    assert out[8] == f"555 123 {spaced}"
    assert out[9].startswith(f"{new} ") and not out[9].endswith("2024-02-29")
    assert out[10].endswith(" 12/27") and "822463" not in out[10] and luhn(out[10][:-6].replace(" ", ""))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:6])], "doc_id long, text string")
    assert {r.n_card for r in pii.pseudonymize(df, KEY, counts=True).collect()} == {1}


def test_long_runs_of_numbers(spark):
    numbers = " ".join(str(i) for i in range(6_000))
    got = replaced(spark, [numbers + " 4111111111111111 12/27"])[0]
    assert "4111111111111111" not in got and len(got) == len(numbers) + 23


def test_edge_cases(spark, edge, none):
    out = pii.pseudonymize(edge, KEY, counts=True)
    assert out.columns[:len(edge.columns)] == edge.columns
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.found)
    assert sorted(map(key, out.collect())) == sorted((i is None, i or 0, t or "", "f") for i, t, _ in EDGE)
    assert all(r[f"n_{k}"] == 0 for r in out.collect() for k in pii.KINDS)
    assert pii.pseudonymize(none, KEY).count() == 0
    long = "x" * 200_000 + " 4316522678525456 " + "y@" * 1000
    assert "4316522678525456" not in replaced(spark, [long])[0]


def test_main_path_is_native(spark, edge):
    plan = pii.pseudonymize(edge, KEY)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
