"""Contents of delivered rows: the nine values of a payload in one writing, the address taken apart."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kinweave.functions import address as A
from kinweave.functions import values as V
from kinweave.operators import records as R

VALUES = ["given", "family", "email", "phone", "birth", "region", "postal", "number", "street", "kind", "direction", "unit", "town"]
TYPED = "typed_name"
_INNER = tuple(R.INNER_KEYS)


@lru_cache(maxsize=V.KEEP)
def _line(line: str) -> A.Address:
    a = A.parse(line)
    return a if a.street else a._replace(street=" ".join(A._TOKEN.findall(A.plain(line))) or None)  # no street address: the words stand for themselves


def values_of(payload: str | None, attribute: Callable[[str], str | None]) -> list[str | None]:
    """VALUES of one payload; all None if it can't be read."""
    try:
        got = json.loads(payload) if payload else None
    except ValueError:
        got = None
    if not isinstance(got, dict):
        return [None] * len(VALUES)
    raw: dict[str, str] = {}
    for k, v in got.items():
        if v is not None and (a := attribute(k)) and a not in raw and (t := v if v.__class__ is str else V.text_of(v, _INNER)) is not None and (t := V.present(t)) is not None:
            raw[a] = t
    g = raw.get
    given, family, email, phone, birth, region, postal, line, city = g("given"), g("family"), g("email"), g("phone"), g("birth"), g("region"), g("postal"), g("street"), g("city")
    a = _line(line) if line else A.NOTHING
    return [
        given and V.words(given), family and V.words(family), email and V.email(email), phone and V.phone(phone), birth and V.birth(birth), region and V.words(region), postal and V.postal(postal) or a.postal,
        a.number, a.street, a.kind, a.direction, a.unit, city and A.town_norm(city) or a.town,
    ]


def typed_name(payload: str | None, attribute: Callable[[str], str | None]) -> str:
    """Given and family name as typed: NFC, lower case, single spaces, a null part left out."""
    try:
        got = json.loads(payload) if payload else None
    except ValueError:
        got = None
    parts: dict[str, str] = {}
    for k, v in got.items() if isinstance(got, dict) else ():
        if v is not None and (a := attribute(k)) in ("given", "family") and a not in parts and (t := V.text_of(v, _INNER)) is not None:
            parts[a] = t
    return " ".join(unicodedata.normalize("NFC", " ".join(parts[a] for a in ("given", "family") if a in parts)).lower().split())


#: Stands between packed values; a normalised value holds no control character.
GAP = "\x1f"


def packed_contents(raw: DataFrame, keep: Iterable[str], values: Iterable[str]) -> DataFrame:
    """``keep`` columns and some of VALUES packed into one text ``v`` of each non-deleted row with a payload; a null counts as empty."""
    keep, at = list(keep), [VALUES.index(v) for v in values]
    rows = R.live(raw).select(*keep, "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attribute = lru_cache(maxsize=None)(R.attribute_of)
        for b in batches:
            got = [values_of(p, attribute) for p in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([GAP.join([row[i] or "" for i in at]) for row in got], pa.string())], [*keep, "v"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("v", T.StringType())]))


def contents(raw: DataFrame, keep: Iterable[str], typed: bool = False) -> DataFrame:
    """``keep`` columns and VALUES of each non-deleted row with a payload; with ``typed`` also the full name as typed."""
    keep = list(keep)
    rows = R.live(raw).select(*keep, "payload")
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(n, T.StringType()) for n in (*VALUES, *([TYPED] if typed else [])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attribute = lru_cache(maxsize=None)(R.attribute_of)
        for b in batches:
            payloads = b.column(len(keep)).to_pylist()
            got = [values_of(p, attribute) for p in payloads]
            cols = [*zip(*got)] if got else [[] for _ in VALUES]
            if typed:
                cols.append([typed_name(p, attribute) for p in payloads])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, pa.string()) for c in cols)], [*keep, *VALUES, *([TYPED] if typed else [])])

    return rows.mapInArrow(run, schema)
