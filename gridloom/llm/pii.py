"""Format-preserving pseudonyms for personal numbers and dates, in SQL functions only.

Validated values are permuted by a keyed Feistel network within their own format: digits stay digits in their places,
payment-card numbers stay valid under their check digit, addresses stay addresses, dates stay dates. Equal values get
equal pseudonyms in every document, and the key's owner can invert them.
"""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_column

ROUNDS = 8
#: Days of 400 years of the Gregorian calendar, and its factors: the radices of the dates' Feistel network. Dates are
#: permuted within their 400 years (0400 to 0799, ... 9600 to 9999).
CYCLE_DAYS, CYCLE_A, CYCLE_B = 146_097, 189, 773
#: Area, group and serial numbers of national ids that are given out: areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999.
AREAS, NO_AREA, GROUPS, SERIALS = 898, 666, 99, 9_999
#: Finds every value that may be personal; what it is, is decided by validation.
PATTERN = (
    r"(?<![0-9A-Za-z])(?:"
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9])"
    r"|(?:[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
    r"|[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
    r"|(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}"
    r"|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
    r"|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"
    r"|[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}"
    r")(?![0-9A-Za-z]))"
)


@dataclass(frozen=True)
class Kind:
    """A sort of value: its name, and the SQL condition on the matched string ``m`` that validates it."""

    name: str
    valid: str


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """SQL for whether a digit string passes the check-digit rule of payment cards."""
    total = (
        f"aggregate(transform(split(reverse({digits}), ''), (d, i) -> if(i % 2 = 0, int(d), int(d) * 2 - if(int(d) > 4, 9, 0))), 0, (s, d) -> s + d)"
    )
    return f"({total} % 10 = 0)"


KINDS = (
    Kind("email", "m like '%@%'"),
    Kind("date", r"m rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' and m >= '0400' and try_to_date(m) is not null"),
    Kind("ip", r"m rlike '^[0-9]{1,3}(\\.[0-9]{1,3}){3}$' and forall(split(m, '[.]'), x -> int(x) < 256 and (x = '0' or x not like '0%'))"),
    Kind("phone", r"m rlike '\\(' or m rlike '^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$'"),
    Kind("national_id", r"m rlike '^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$'"),
    Kind("card", f"length({_digits('m')}) between 13 and 19 and {luhn(_digits('m'))}"),
)


def _mix(key: str, tweak: str, round_: int, half: str, modulus: str) -> str:
    """A round's keyed function: 52 bits of SHA-256, modulo the other half's radix."""
    text = f"concat_ws('|', {key}, {tweak}, '{round_}', {half})"
    return f"(conv(substr(sha2({text}, 256), 1, 13), 16, 10)::bigint % {modulus})"


def feistel(state: str, key: str, tweak: str, radix_a: str, radix_b: str, rounds: int = ROUNDS, inverse: bool = False) -> str:
    """SQL that permutes the number ``state`` in 0 .. radix_a * radix_b - 1, keyed; ``inverse`` undoes it.

    Even rounds add a function of the low part to the high part, odd rounds the other way, each modulo its radix.
    """
    steps = f"named_struct('a', ({state}) div ({radix_b}), 'b', ({state}) % ({radix_b}))"
    for r in reversed(range(rounds)) if inverse else range(rounds):
        sign = "-" if inverse else "+"
        if r % 2 == 0:
            new = f"named_struct('a', pmod(x.a {sign} {_mix(key, tweak, r, 'x.b', radix_a)}, {radix_a}), 'b', x.b)"
        else:
            new = f"named_struct('a', x.a, 'b', pmod(x.b {sign} {_mix(key, tweak, r, 'x.a', radix_b)}, {radix_b}))"
        steps = f"transform(array({steps}), x -> {new})[0]"
    return f"transform(array({steps}), x -> x.a * ({radix_b}) + x.b)[0]"


def _power(n: str) -> str:
    return f"bigint(concat('1', repeat('0', {n})))"


def permuted_digits(digits: str, key: str, tweak: str, inverse: bool = False) -> str:
    """SQL for a digit string of up to 18 digits permuted among those of its length."""
    n = f"length({digits})"
    return f"lpad(string({feistel(f'bigint({digits})', key, f'concat({tweak}, {n})', _power(f'({n} div 2)'), _power(f'({n} - {n} div 2)'), inverse=inverse)}), int({n}), '0')"


def check_digit(body: str) -> str:
    """SQL for the digit that makes ``body`` followed by it pass the payment-card rule."""
    total = f"aggregate(transform(split(reverse({body}), ''), (d, i) -> if(i % 2 = 1, int(d), int(d) * 2 - if(int(d) > 4, 9, 0))), 0, (s, d) -> s + d)"
    return f"string((10 - {total} % 10) % 10)"


def permuted_letters(word: str, key: str, tweak: str, inverse: bool = False) -> str:
    """SQL for up to 12 lower-case letters and digits permuted among those of that length (as a number in base 36)."""
    n, size = f"length({word})", lambda k: f"bigint(pow(36, {k}))"
    number = f"bigint(conv({word}, 36, 10))"
    moved = feistel(number, key, f"concat({tweak}, {n})", size(f"({n} div 2)"), size(f"({n} - {n} div 2)"), inverse=inverse)
    return f"lpad(lower(conv(string({moved}), 10, 36)), int({n}), '0')"


def _refill(m: str, new: str, places: str = "0-9") -> str:
    """SQL that puts the characters of ``new`` into the places of ``m`` that hold the characters of a class."""
    chars = f"transform(split({m}, ''), (c, i) -> if(c rlike '[{places}]', substr({new}, length(regexp_replace(substr({m}, 1, i), '[^{places}]', '')) + 1, 1), c))"
    return f"array_join({chars}, '')"


def pseudonym(kind: str, key: str, inverse: bool = False) -> str:
    """SQL for the pseudonym of a validated value ``m``."""
    tweak = f"'{kind}:'"
    if kind == "email":
        local, word = "substring_index(m, '@', 1)", "regexp_replace(lower(substring_index(m, '@', 1)), '[^a-z0-9]', '')"
        parts = " , ".join(f"if(length({word}) > {at}, {permuted_letters(f'substr({word}, {at + 1}, 12)', key, tweak, inverse)}, '')" for at in range(0, 64, 12))
        return f"transform(array(concat({parts})), p -> concat({_refill(f'lower({local})', 'p', 'a-z0-9')}, substr(m, instr(m, '@'))))[0]"
    if kind == "date":
        day = "date_diff(try_to_date(m), date'0400-01-01')"
        moved = feistel(f"(bigint({day}) % {CYCLE_DAYS})", key, tweak, str(CYCLE_A), str(CYCLE_B), inverse=inverse)
        return f"date_format(date_add(date'0400-01-01', int({day} div {CYCLE_DAYS} * {CYCLE_DAYS} + {moved})), 'yyyy-MM-dd')"
    if kind == "ip":
        number = "aggregate(split(m, '[.]'), 0L, (s, x) -> s * 256 + int(x))"
        moved = feistel(number, key, tweak, "65536", "65536", inverse=inverse)
        return f"transform(array({moved}), v -> concat_ws('.', v div 16777216, v div 65536 % 256, v div 256 % 256, v % 256))[0]"
    if kind == "national_id":
        area = f"int(left(m, 3)) - if(int(left(m, 3)) > {NO_AREA}, 2, 1)"
        moved = feistel(f"((bigint({area}) * {GROUPS} + int(substr(m, 5, 2)) - 1) * {SERIALS} + int(right(m, 4)) - 1)", key, tweak, str(AREAS * GROUPS), str(SERIALS), inverse=inverse)
        back = f"v div {GROUPS * SERIALS} + if(v div {GROUPS * SERIALS} >= {NO_AREA - 1}, 2, 1)"
        return f"transform(array({moved}), v -> format_string('%03d-%02d-%04d', {back}, v div {SERIALS} % {GROUPS} + 1, v % {SERIALS} + 1))[0]"
    digits = _digits("m")
    if kind == "card":
        body = f"left({digits}, length({digits}) - 1)"
        return f"transform(array({permuted_digits(body, key, tweak, inverse)}), p -> {_refill('m', f'concat(p, {check_digit("p")})')})[0]"
    return f"transform(array({permuted_digits(digits, key, tweak, inverse)}), p -> {_refill('m', 'p')})[0]"


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """``docs`` with the text's personal values replaced, and the number of values of each kind in ``n_<kind>``.

    Whole texts of any length; nothing is shuffled. Values that match a format but fail its validation stay. Null texts
    stay null and count nothing, empty ones stay empty. Repeated rows and other columns stay; columns of the counts' names
    (in any case) are replaced. An empty table gives an empty result. Query plans show keys derived from ``key``, one
    for each kind, never ``key`` itself.
    """
    keys = {x.name: "'" + hmac.new(key.encode(), x.name.encode(), hashlib.sha256).hexdigest() + "'" for x in KINDS}
    pattern = "r'" + PATTERN + "'"
    kind = "case " + " ".join(f"when {x.valid} then '{x.name}'" for x in KINDS) + " end"
    new = "case k " + " ".join(f"when '{x.name}' then {pseudonym(x.name, keys[x.name], inverse)}" for x in KINDS) + " else m end"
    kept = [c for c in docs.columns if not is_column(c, *(f"n_{x.name}" for x in KINDS))]
    whole = docs.select(F.struct(*kept).alias("row"), F.col(text_col).alias("whole"))
    found = whole.withColumn("found", F.expr(f"regexp_extract_all(whole, {pattern}, 0)"))
    found = found.withColumn("kinds", F.expr(f"transform(found, m -> {kind})"))
    found = found.withColumn("new", F.expr(f"zip_with(found, kinds, (m, k) -> {new})"))
    text = F.expr(f"if(size(found) = 0, whole, array_join(zip_with(split(whole, {pattern}, -1), new, (a, b) -> concat(a, coalesce(b, ''))), ''))")
    counts = [F.expr(f"coalesce(size(filter(kinds, k -> k = '{x.name}')), 0)").cast("long").alias(f"n_{x.name}") for x in KINDS]
    text = F.when(F.col("whole").isNotNull(), text)
    return found.select(*(text.alias(c) if is_column(c, text_col) else F.col("row")[c].alias(c) for c in kept), *counts)
