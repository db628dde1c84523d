"""Comparison predicates by token, as column expressions over the two sides of a pair.

A token is ``name`` or ``name:argument``; ``predicate(token)`` gives a function of the left and the
right column. A null on either side makes a predicate null, which counts as not matched. Own
comparators are added with ``register``.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions import kernels as K

Predicate = Callable[[Column, Column], Column]
EARTH_KM = 6371.0088


def jaro_winkler(a: str | bytes, b: str | bytes) -> float:
    """Similarity of two strings by their UTF-8 bytes; 0 if either is empty."""
    s, t = (x.encode() if isinstance(x, str) else x for x in (a, b))
    if not s or not t:
        return 0.0
    if s == t:
        return 1.0
    reach = max(max(len(s), len(t)) // 2 - 1, 0)
    used = bytearray(len(t))
    left = bytearray()
    for i, c in enumerate(s):
        for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
            if not used[j] and t[j] == c:
                used[j] = 1
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = bytes(c for c, u in zip(t, used) if u)
    half = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(s) + m / len(t) + (m - half) / m) / 3
    prefix = 0
    while prefix < min(4, len(s), len(t)) and s[prefix] == t[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


@F.arrow_udf(T.DoubleType())
def jaro_winkler_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Null with a null on either side."""
    got = pa.array(K.jaro_winkler(a, b, jaro_winkler))
    return pc.if_else(pc.and_(pc.is_valid(a), pc.is_valid(b)), got, pa.scalar(None, pa.float64()))


def _within_edits(n: int) -> Predicate:
    """At most n edits between the UTF-8 bytes: of texts that aren't their bytes each byte becomes one character first.
    The distance is worked out no further than n."""

    def near(a: Column, b: Column) -> Column:
        plain = (F.length(a) == F.octet_length(a)) & (F.length(b) == F.octet_length(b))
        each = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
        return F.when(plain, F.levenshtein(a, b, n)).otherwise(F.levenshtein(each(a), each(b), n)) >= 0

    return near


def _number(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def _within_pct(p: float) -> Predicate:
    def near(a: Column, b: Column) -> Column:
        x, y = _number(a), _number(b)
        top = F.greatest(F.abs(x), F.abs(y))
        return F.when(top == 0, x == y).otherwise(F.abs(x - y) <= top * F.lit(p / 100.0))

    return near


def _within_km(r: float) -> Predicate:
    def near(a: Column, b: Column) -> Column:
        part = lambda c, i: F.radians(_number(F.trim(F.split_part(c, F.lit(","), F.lit(i)))))
        la, oa, lb, ob = part(a, 1), part(a, 2), part(b, 1), part(b, 2)
        h = F.pow(F.sin((lb - la) / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin((ob - oa) / 2), 2)
        return 2 * EARTH_KM * F.asin(F.sqrt(h)) <= r

    return near


def _transposed(a: Column, b: Column) -> Column:
    return (F.year(a) == F.year(b)) & (F.month(a) == F.dayofmonth(b)) & (F.dayofmonth(a) == F.month(b)) & (a != b)


_PLAIN: dict[str, Predicate] = {
    "exact": lambda a, b: a == b,
    "variant_match": lambda a, b: F.arrays_overlap(a, b),
    "username_exact": lambda a, b: F.split_part(a, F.lit("@"), F.lit(1)) == F.split_part(b, F.lit("@"), F.lit(1)),
    "domain_exact": lambda a, b: F.split_part(a, F.lit("@"), F.lit(2)) == F.split_part(b, F.lit("@"), F.lit(2)),
    "dob_same_year_month": lambda a, b: F.date_trunc("month", a) == F.date_trunc("month", b),
    "date_transposed": _transposed,
    "contains": lambda a, b: (a != "") & (b != "") & (a.contains(b) | b.contains(a)),
    "soundex": lambda a, b: F.soundex(a) == F.soundex(b),
}
_WITH: dict[str, Callable[[str], Predicate]] = {
    "jaro_winkler": lambda t: lambda a, b: jaro_winkler_similarity(a, b) >= float(t),
    "levenshtein": lambda n: _within_edits(int(n)),
    "first_n": lambda n: lambda a, b: F.substring(a, 1, int(n)) == F.substring(b, 1, int(n)),
    "date_within_days": lambda n: lambda a, b: F.abs(F.datediff(a, b)) <= int(n),
    "numeric_within": lambda x: lambda a, b: F.abs(_number(a) - _number(b)) <= float(x),
    "numeric_within_pct": lambda p: _within_pct(float(p)),
    "datetime_within_hours": lambda n: lambda a, b: F.abs(F.unix_seconds(a.cast("timestamp")) - F.unix_seconds(b.cast("timestamp"))) <= int(float(n) * 3600),
    "geo_within_km": lambda r: _within_km(float(r)),
}


def register(name: str, make: Callable[..., Predicate], takes_argument: bool = False) -> None:
    """Add a comparator: a predicate, or, with ``takes_argument``, a function from the argument to one."""
    (_WITH if takes_argument else _PLAIN)[name] = make


def predicate(token: str) -> Predicate:
    name, colon, arg = token.partition(":")
    if not colon and name in _PLAIN:
        return _PLAIN[name]
    if colon and name in _WITH:
        if name == "jaro_winkler" and not 0 <= float(arg) <= 1:
            raise ValueError(f"{token}: a similarity is between 0 and 1")
        if name == "first_n" and int(arg) <= 0:
            raise ValueError(f"{token}: at least one character")
        return _WITH[name](arg)
    raise ValueError(f"unknown comparison {token!r}")


def address_components(number: tuple[Column, Column], street: tuple[Column, Column], postal: tuple[Column, Column]) -> Column:
    """House number, street and postal code present and equal."""
    return (number[0] == number[1]) & (street[0] == street[1]) & (postal[0] == postal[1])


def blank_match(policy: str, a: Column, b: Column) -> Column:
    """Whether blanks count as agreement: never, both (both blank), either (at least one blank)."""
    na, nb = a.isNull() | (a.cast("string") == ""), b.isNull() | (b.cast("string") == "")
    if policy not in ("never", "both", "either"):
        raise ValueError(f"unknown blank policy {policy!r}")
    return F.lit(False) if policy == "never" else na & nb if policy == "both" else na | nb
