"""Format-preserving pseudonyms for personal data by keyed Feistel permutations, in SQL functions only.

Found and validated: e-mail addresses, card numbers (Luhn), US telephone and social security
numbers, IPv4 addresses, dates (ISO, dd.mm.yyyy, mm/dd/yyyy, within DATE_RANGE) and cloud
access keys. Each value is permuted among the values of its own format, and every pseudonym is a
valid value of it: digits stay digits, letters keep their case, cards and social security
numbers stay valid, octets and dates stay in range. A permutation
depends on key and format alone, so equal values get equal pseudonyms in every document,
different values different ones, and the key's holder can invert them. The key has no default.

Defined cases. Telephone numbers after +1 or with the area code in brackets have any area
code; without either, one from 2 to 9, which pseudonyms keep to. Others after + keep their first digit
and what is before the last ten. Of an address the part before @ changes; its letters' case does not count for the
permutation and is put back. The domain stays.
Null text stays null, with nothing found. What is not valid stays as it is.
Repeated rows change alike. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
#: days from 1900-01-01 to 2099-12-31, two fewer than 319 * 229
FIRST_DAY, DAYS, LEFT_DAYS, RIGHT_DAYS = "1900-01-01", 73049, 319, 229

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
ISO = r"(?<![0-9-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])"
DMY = r"(?<![0-9.])(?:0[1-9]|[12][0-9]|3[01])\.(?:0[1-9]|1[0-2])\.(?:19|20)[0-9]{2}(?![0-9])"
MDY = r"(?<![0-9/])(?:0[1-9]|1[0-2])/(?:0[1-9]|[12][0-9]|3[01])/(?:19|20)[0-9]{2}(?![0-9/])"
PHONE = r"(?<![0-9+])(?:\+1[ .-]?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])|\([0-9]{3}\)[ ]?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])\+[1-9][0-9]{7,14}(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
#: every match of a kind holds this
MAY = r"@|[0-9][^A-Za-z]?[0-9]|AKIA|ASIA"
KINDS = {"email": EMAIL, "ip": IP, "ssn": SSN, "date_iso": ISO, "date_dmy": DMY, "date_mdy": MDY, "phone": PHONE, "card": CARD, "key": KEY}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _noise(key: str, what: str, turn: str, half: str) -> str:
    """64 keyed bytes in hexadecimal."""
    return f"sha2(concat_ws('|', {_quoted(key)}, '{what}', cast({turn} as string), cast({half} as string)), 512)"


def _shift(text: str, noise: str) -> str:
    """text with each digit, small and capital letter moved within its class by the bytes of noise."""
    r = f"cast(conv(substr({noise}, 2 * ((p - 1) % 64) + 1, 2), 16, 10) as int)"
    c = f"substr({text}, p, 1)"

    def moved(first: str, size: int) -> str:
        return f"chr(ascii('{first}') + pmod(ascii({c}) - ascii('{first}') + {r}, {size}))"

    one = f"case when {c} between '0' and '9' then {moved('0', 10)} when {c} between 'a' and 'z' then {moved('a', 26)} when {c} between 'A' and 'Z' then {moved('A', 26)} else {c} end"
    return f"case when {text} = '' then '' else array_join(transform(sequence(1, length({text})), p -> {one}), '') end"


def feistel(text: str, key: str, what: str) -> str:
    """SQL for the permutation of text among the texts with the same classes of characters."""
    half = f"cast(length({text}) div 2 as int)"
    turns = "array(" + ", ".join(str(i) for i in range(ROUNDS)) + ")"
    step = _shift("a.l", "a.n")
    # the noise of each turn is put beside the halves first, so it is computed once
    return (
        f"aggregate(flatten(transform({turns}, t -> array(2 * t, 2 * t + 1))), struct(substr({text}, 1, {half}) as l, substr({text}, {half} + 1) as r, '' as n), "
        f"(a, i) -> case when i % 2 = 0 then struct(a.l as l, a.r as r, {_noise(key, what, 'i', 'a.r')} as n) else struct(a.r as l, {step} as r, '' as n) end, "
        f"a -> concat(a.l, a.r))"
    )


def _numbers(x: str, y: str, sizes: tuple[int, int], key: str, what: str) -> str:
    """SQL for the permutation of a pair of numbers below sizes: struct(x, y)."""

    def f(half: str) -> str:
        return f"cast(conv(substr({_noise(key, what, 'i', half)}, 1, 12), 16, 10) as bigint)"

    turns = "array(" + ", ".join(str(i) for i in range(ROUNDS)) + ")"
    return (
        f"aggregate({turns}, struct(cast({x} as bigint) as x, cast({y} as bigint) as y), (a, i) -> "
        f"case when i % 2 = 0 then struct(pmod(a.x + {f('a.y')}, {sizes[0]}L) as x, a.y as y) else struct(a.x as x, pmod(a.y + {f('a.x')}, {sizes[1]}L) as y) end)"
    )


def _refill(text: str, digits: str) -> str:
    """text with its digits replaced in turn."""
    return (
        f"aggregate(split({text}, ''), struct('' as o, 1 as k), (a, c) -> case when c between '0' and '9' "
        f"then struct(concat(a.o, substr({digits}, a.k, 1)) as o, a.k + 1 as k) else struct(concat(a.o, c) as o, a.k as k) end, a -> a.o)"
    )


def _luhn(digits: str) -> str:
    """The Luhn sum of digits whose last is the check digit."""
    d = f"cast(substr({digits}, length({digits}) - p, 1) as int)"
    return f"aggregate(transform(sequence(0, length({digits}) - 1), p -> case when p % 2 = 1 then ({d} * 2) div 10 + ({d} * 2) % 10 else cast({d} as bigint) end), 0L, (a, x) -> a + x)"


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _day(n: str, key: str) -> str:
    """SQL for the permutation of days. A result beyond the last day is permuted again: two numbers are, so thrice always does."""
    one = lambda v: _let(_numbers(f"{v} div {RIGHT_DAYS}", f"{v} % {RIGHT_DAYS}", (LEFT_DAYS, RIGHT_DAYS), key, "date"), "q", f"q.x * {RIGHT_DAYS} + q.y")
    again = lambda v, name: _let(v, name, f"case when {name} < {DAYS} then {name} else {one(name)} end")
    return again(again(one(n), "d1"), "d2")


def _ssn(digits: str, key: str) -> str:
    """SQL for the permutation of the valid social security numbers: 898 areas, 99 groups, 9999 serials."""
    area = f"cast(substr({digits}, 1, 3) as bigint)"
    x = f"({area} - case when {area} > 666 then 2 else 1 end) * 99 + cast(substr({digits}, 4, 2) as bigint) - 1"
    moved = _numbers(x, f"cast(substr({digits}, 6, 4) as bigint) - 1", (898 * 99, 9999), key, "ssn")
    return _let(moved, "q", "concat(lpad(cast(q.x div 99 + case when q.x div 99 >= 665 then 2 else 1 end as string), 3, '0'), lpad(cast(q.x % 99 + 1 as string), 2, '0'), lpad(cast(q.y + 1 as string), 4, '0'))")


def _phone(m: str, key: str) -> str:
    """SQL for the digits of a telephone number's pseudonym."""

    def ten(least: int) -> str:
        moved = _numbers(f"cast(substr(right(d, 10), 1, 3) as bigint) - {least}", "cast(right(d, 7) as bigint)", (1000 - least, 10_000_000), key, f"phone{least}")
        return _let(moved, "q", f"concat(substr(d, 1, length(d) - 10), lpad(cast(q.x + {least} as string), 3, '0'), lpad(cast(q.y as string), 7, '0'))")

    tail = "right(d, least(10, length(d) - 1))"
    other = f"concat(substr(d, 1, length(d) - least(10, length(d) - 1)), {_let(tail, 's', feistel('s', key, 'phone'))})"
    own = f"case when {m} rlike '^[+][0-9]+$' then {other} when {m} rlike '^([+]|[(])' then {ten(0)} else {ten(200)} end"
    return _let(f"regexp_replace({m}, '[^0-9]', '')", "d", own)


def _recased(text: str, like: str) -> str:
    """text with capitals where like has them."""
    return f"array_join(transform(sequence(1, length({text})), p -> case when substr({like}, p, 1) between 'A' and 'Z' then upper(substr({text}, p, 1)) else substr({text}, p, 1) end), '')"


def kind_of(m: str) -> str:
    """SQL for the kind of a match, null if it is not valid."""
    date = {"date_iso": "yyyy-MM-dd", "date_dmy": "dd.MM.yyyy", "date_mdy": "MM/dd/yyyy"}
    cases = []
    for kind, pattern in KINDS.items():
        test = f"{m} rlike {_quoted('^(?:' + pattern + ')$')}"
        if kind in date:
            test += f" and try_to_timestamp({m}, '{date[kind]}') is not null"
        if kind == "card":
            digits = f"regexp_replace({m}, '[^0-9]', '')"
            test += " and " + _let(digits, "d", f"{_luhn('d')} % 10 = 0 and d rlike '[1-9]'")
        cases.append(f"when {test} then '{kind}'")
    return "case " + " ".join(cases) + " end"


def pseudonym(m: str, kind: str, key: str) -> str:
    """SQL for the pseudonym of a valid match of a kind (a column of its own)."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    cases = {
        "email": _let(f"split_part({m}, {_quoted('@')}, 1)", "w", _let(_let("lower(w)", "s", feistel("s", key, "email")), "v", f"concat({_recased('v', 'w')}, '@', split_part({m}, '@', 2))")),
        "ssn": _let(digits, "e", _let(_ssn("e", key), "f", _refill(m, "f"))),
        "phone": _let(_phone(m, key), "f", _refill(m, "f")),
        "key": f"concat(substr({m}, 1, 4), {_let(f'substr({m}, 5)', 's', feistel('s', key, 'key'))})",
    }
    # a card keeps its first digit; its check digit is computed anew
    body = _let(f"substr({digits}, 2, length({digits}) - 2)", "s", feistel("s", key, "card"))
    cases["card"] = _let(f"concat(substr({digits}, 1, 1), {body}, '0')", "d", _refill(m, f"concat(substr(d, 1, length(d) - 1), cast(pmod(10 - {_luhn('d')} % 10, 10) as string))"))
    o = [f"cast(split_part({m}, '.', {i}) as bigint)" for i in range(1, 5)]
    ip = _numbers(f"{o[0]} * 256 + {o[1]}", f"{o[2]} * 256 + {o[3]}", (65536, 65536), key, "ip")
    cases["ip"] = _let(ip, "q", "concat_ws('.', q.x div 256, q.x % 256, q.y div 256, q.y % 256)")
    for name, form in (("date_iso", "yyyy-MM-dd"), ("date_dmy", "dd.MM.yyyy"), ("date_mdy", "MM/dd/yyyy")):
        day = f"datediff(cast(try_to_timestamp({m}, '{form}') as date), date'{FIRST_DAY}')"
        cases[name] = _let(_let(f"cast({day} as bigint)", "n", _day("n", key)), "t", f"date_format(date_add(date'{FIRST_DAY}', cast(t as int)), '{form}')")
    return f"case {kind} " + " ".join(f"when '{k}' then {v}" for k, v in cases.items()) + f" else {m} end"


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, tx, text (with pseudonyms), found (array of kind, value, pseudonym)."""
    pattern = _quoted("|".join(f"(?:{p})" for p in KINDS.values()))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tx"), F.col(text_col).cast("string").alias("text"))
    may = F.col("text").rlike(MAY)
    rows = rows.withColumn("hits", F.when(may, F.expr(f"regexp_extract_all(text, {pattern}, 0)")).otherwise(F.expr("cast(array() as array<string>)")))
    one = _let(f"struct(m as value, {kind_of('m')} as kind)", "x", f"struct(x.kind as kind, x.value as value, {pseudonym('x.value', 'x.kind', key)} as pseudonym)")
    rows = rows.withColumn("made", F.expr(f"transform(hits, m -> {one})"))
    woven = f"array_join(zip_with(split(text, {pattern}, -1), transform(made, x -> x.pseudonym), (a, b) -> concat(a, coalesce(b, ''))), '')"
    text = F.when(F.size("made") > 0, F.expr(woven)).otherwise(F.col("text"))
    return rows.select("id", "tx", text.alias("text"), F.expr("filter(made, x -> x.kind is not null)").alias("found"))
