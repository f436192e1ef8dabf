"""Operator 6: format-preserving Feistel pseudonyms for personal data, in SQL functions only.

``pseudonymize`` finds e-mail addresses, payment card numbers, phone numbers, IPv4 addresses,
calendar dates, US social security numbers, IBANs and long hexadecimal secrets, checks them
(Luhn, mod 97, octet range, calendar) and replaces each by another value of the same format: a
keyed Feistel network permutes its digits and letters place by place, so equal values become
equal pseudonyms in all documents and different values stay different; check digits are made
anew, and pseudonyms of dates are dates. What fails its check is left alone.

Digits beside a card (an expiry date, a CVV, an item number) do not hide it: the stretches that
start and end at a separator, are grouped as cards are printed (``PRINTED``) and pass Luhn are
looked up first, and neither the free card pattern nor a phone number runs into them.

A value is cut in two halves; in each of ``ROUNDS`` rounds one half's characters are shifted,
each within its own class (digit, lower or upper case letter, or hexadecimal digit), by a
SHA-256 stream of key, kind, round, length and the other half. That can be undone, so
it is a permutation of the values of a format.

The plan is one projection: a text without digits and without @ is passed through; otherwise it is split at the
matches, and higher-order functions map the matches. No shuffle, no Python.

Defined results: a null text stays null with zero counts; empty texts stay empty; repeated
rows and null ids are kept; all other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.common import fresh_name

ROUNDS = 6
#: kind → pattern, tried in this order at each place of a text; lookarounds keep matches whole
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "secret": r"(?<![0-9A-Za-z])[0-9a-f]{32,128}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "iso_date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "day_date": r"(?<![0-9./])[0-9]{2}[.][0-9]{2}[.][0-9]{4}(?![0-9])",
    "month_date": r"(?<![0-9./])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9+])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,4}"
             r"|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9])",
}
SEP = r"[ -]"
#: groups of digits as cards are printed; at one place at most one of each list matches
PRINTED = [["[0-9]{13,19}", "4 4 4 1,4", "4 4 5", "4 3 3 3", "4 6 4,5", "4 5 6", "5 4 5", "6 13"], ["4 4 4 4 1,3"]]
KINDS = ("email", "secret", "iban", "ip", "date", "ssn", "card", "phone")
DAYS, FIRST_DAY = 100_000, "1900-01-01"          # dates are permuted among so many days from the first


def _alphabet(c: Column, hexadecimal: Column) -> Column:
    return (F.when(hexadecimal, F.lit("0123456789abcdef")).when(c.rlike("[0-9]"), F.lit("0123456789"))
            .when(c.rlike("[a-z]"), F.lit("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")))


def _shifted(half: Column, other: Column, tweak: Column, hexadecimal: Column) -> Column:
    """Each character of a half moved within its class by the stream of the other half."""
    def one(i: Column) -> Column:
        c = F.substring(half, i, F.lit(1))
        stream = F.sha2(F.concat_ws("|", tweak, other, F.floor((i - 1) / 8).cast("string")), 256)
        move = F.conv(F.substring(stream, F.pmod(i - 1, F.lit(8)).cast("int") * 8 + 1, F.lit(8)), 16, 10).cast("long")
        letters = _alphabet(c, hexadecimal)
        moved = F.pmod(F.instr(letters, c) - 1 + move, F.length(letters)).cast("int")
        return F.when(letters.isNull(), c).otherwise(F.substring(letters, moved + 1, F.lit(1)))
    return F.when(F.length(half) == 0, half).otherwise(
        F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(half), F.lit(1))), one), ""))


def permuted(value: Column, kind: str, key: str) -> Column:
    """The keyed permutation of the digits and letters of a string, within its format."""
    hexadecimal = F.lit(kind in ("secret", "ip"))
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("a"), F.substring(value, cut + 1, F.length(value)).alias("b"))

    def step(acc: Column, r: Column) -> Column:
        tweak = F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), F.length(value).cast("string"))
        even = r % 2 == 0
        return F.struct(F.when(even, _shifted(acc["a"], acc["b"], tweak, hexadecimal)).otherwise(acc["a"]).alias("a"),
                        F.when(even, acc["b"]).otherwise(_shifted(acc["b"], acc["a"], tweak, hexadecimal)).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))


def _chars(s: Column) -> Column:
    return F.split(s, "")


def _refill(shape: Column, symbols: Column, place: str) -> Column:
    """The characters of ``shape`` that match ``place`` replaced by those of ``symbols`` in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        hit = c.rlike(place)
        return F.struct(F.concat(acc["out"], F.when(hit, F.substring(symbols, acc["at"], F.lit(1))).otherwise(c)).alias("out"),
                        (acc["at"] + hit.cast("int")).alias("at"))
    return F.aggregate(_chars(shape), start, step, lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a digit string, the last digit counted once."""
    def add(acc: Column, x: Column) -> Column:
        twice = x["d"] * 2
        return acc + F.when(x["i"] % 2 == 0, x["d"]).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))
    numbered = F.transform(F.reverse(_chars(digits)), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(numbered, F.lit(0), add) % 10


def _mod97(text: Column) -> Column:
    """IBAN remainder: letters count 10 to 35."""
    def add(acc: Column, c: Column) -> Column:
        n = F.conv(c, 36, 10).cast("int")
        return F.pmod(F.when(n > 9, acc * 100 + n).otherwise(acc * 10 + n), F.lit(97)).cast("int")
    return F.aggregate(_chars(text), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), "card", key)
    check = F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("int").cast("string")
    return F.when(_luhn(digits) == 0, _refill(m, F.concat(body, check), "[0-9]"))


def _printed_cards(text: Column) -> Column:
    """All different stretches of a text that are grouped like a card and pass Luhn, longest first."""
    def groups(sizes: str) -> str:
        return sizes if sizes.startswith("[") else SEP.join(f"[0-9]{{{n}}}" for n in sizes.split(" "))
    found = [F.regexp_extract_all(text, F.lit(rf"(?<![0-9+])(?=((?:{'|'.join(map(groups, forms))})(?![0-9])))"), F.lit(1)) for forms in PRINTED]
    valid = F.filter(F.array_distinct(F.concat(*found)), lambda c: _luhn(F.regexp_replace(c, "[^0-9]", "")) == 0)
    return F.transform(F.sort_array(F.transform(valid, lambda c: F.struct(-F.length(c), c.alias("c")))), lambda x: x["c"])


def _pattern(cards: Column) -> Column:
    """The pattern of all kinds; where a text has printed cards, no other digits run into them."""
    mark = "CARDS"
    after = rf"(?!(?:{mark})(?![0-9]))"
    free = PATTERNS["card"].replace("[ -]?", f"(?:[ -]{after})?")
    own = PATTERNS | {"card": rf"(?<![0-9+])(?:{mark})(?![0-9])|{free}",
                      "phone": PATTERNS["phone"].replace("[ .-]?", f"(?:[ .-]{after})?").replace("[ .-][", f"[ .-]{after}[")}
    return F.when(F.size(cards) > 0, F.replace(F.lit("|".join(own.values())), F.lit(mark), F.array_join(cards, "|"))).otherwise(
        F.lit("|".join(PATTERNS.values())))


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, tail = F.substring(plain, F.lit(1), F.lit(2)), F.substring(plain, F.lit(5), F.length(plain))
    valid = _mod97(F.concat(tail, F.substring(plain, F.lit(1), F.lit(4)))) == 1
    body = permuted(tail, "iban", key)
    check = F.lpad((F.lit(98) - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid, _refill(m, F.concat(country, check, body), "[0-9A-Z]"))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("int"))
    valid = F.forall(parts, lambda p: p < 256)
    digits = F.lower(F.array_join(F.transform(parts, lambda p: F.lpad(F.hex(p), 2, "0")), ""))
    out = permuted(digits, "ip", key)
    return F.when(valid, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(
        F.substring(out, i * 2 + 1, F.lit(2)), 16, 10)), "."))


def _date(m: Column, pattern: str, key: str) -> Column:
    first = F.to_date(F.lit(FIRST_DAY))
    day = F.datediff(F.try_to_timestamp(m, F.lit(pattern)).cast("date"), first)
    valid = day.isNotNull() & (day >= 0) & (day < DAYS)
    to = permuted(F.lpad(day.cast("string"), 5, "0"), "date", key).cast("int")
    return F.when(valid, F.date_format(F.date_add(first, to), pattern))


def _phone(m: Column, key: str) -> Column:
    """All digits but a leading + country code are permuted."""
    code = F.regexp_extract(m, r"^\+([0-9]{1,3})(?=[ .(-])|^(\+)", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.concat(code, _refill(rest, permuted(F.regexp_replace(rest, "[^0-9]", ""), "phone", key), "[0-9]"))


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(permuted(local, "email", key), F.substring(m, F.length(local) + 1, F.length(m)))


def _pseudonym(m: Column, key: str) -> Column:
    """(kind, pseudonym) of one match; a value that fails its check keeps itself and no kind."""
    whole = {k: m.rlike(f"^(?:{p})$") for k, p in PATTERNS.items()}
    makers = {
        "email": ("email", lambda: _email(m, key)), "secret": ("secret", lambda: permuted(m, "secret", key)),
        "iban": ("iban", lambda: _iban(m, key)), "ip": ("ip", lambda: _ip(m, key)),
        "iso_date": ("date", lambda: _date(m, "yyyy-MM-dd", key)), "day_date": ("date", lambda: _date(m, "dd.MM.yyyy", key)),
        "month_date": ("date", lambda: _date(m, "MM/dd/yyyy", key)),
        "ssn": ("ssn", lambda: _refill(m, permuted(F.replace(m, F.lit("-"), F.lit("")), "ssn", key), "[0-9]")),
        "card": ("card", lambda: _card(m, key)), "phone": ("phone", lambda: _phone(m, key)),
    }
    value, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (name, make) in reversed(makers.items()):
        value = F.when(whole[k], make()).otherwise(value)
        kind = F.when(whole[k], F.lit(name)).otherwise(kind)
    return F.struct(F.coalesce(value, m).alias("to"), F.when(value.isNotNull(), kind).alias("kind"))


def _is_kind(kind: str):
    return lambda x: x["kind"] == kind


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", counts: bool = False) -> DataFrame:
    """All columns of the input with the text's personal data replaced; with ``counts`` also
    one column n_<kind> of replaced values for each kind."""
    text, found, given, pattern = F.col(f"`{text_col}`"), *(fresh_name(docs, n) for n in ("found", "given", "pattern"))
    some, long = text.rlike("[0-9@]"), text.rlike("[0-9](?:[ -]?[0-9]){12}")
    out = docs.withColumn(pattern, _pattern(F.when(long, _printed_cards(text))))
    out = out.withColumn(found, F.when(some, F.regexp_extract_all(text, F.col(pattern), F.lit(0))))
    out = out.withColumn(given, F.when(F.size(found) > 0, F.transform(F.col(found), lambda m: _pseudonym(m, key))))
    pieces = F.zip_with(F.split(text, F.col(pattern), -1), F.col(given), lambda a, b: F.concat(a, F.coalesce(b["to"], F.lit(""))))
    out = out.withColumn(text_col, F.when(F.col(given).isNotNull(), F.array_join(pieces, "")).otherwise(text))
    if counts:
        out = out.withColumns({f"n_{k}": F.greatest(F.size(F.filter(given, _is_kind(k))), F.lit(0)).cast("long") for k in KINDS})
    return out.drop(found, given, pattern)
