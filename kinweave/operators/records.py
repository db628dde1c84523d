"""Delivered payloads as records: one column for each canonical attribute, whatever the file called it.

``delivered`` is the reader that all operators over raw_records_golden share. Field names are
read from the data (the distinct keys, a few dozen), each is given an attribute, and one
``from_json`` with exactly those names parses the payload once, in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from kinweave.functions import text as X

ATTRIBUTES = ["given", "family", "email", "phone", "street", "city", "region", "postal", "birth"]
# Field names of the base layout of each source.
BASE_FIELDS = {
    "given": ["first_name", "fname", "name_first"],
    "family": ["last_name", "lname", "name_last"],
    "email": ["email_address", "billing_email", "email"],
    "phone": ["phone", "contact_phone", "phone_number"],
    "street": ["street_address", "addr1", "address"],
    "city": ["city", "addr_city"],
    "region": ["state", "addr_state", "region"],
    "postal": ["zip", "postal_code", "postcode"],
    "birth": ["dob", "birth_date", "date_of_birth"],
}
# Words in a field's name that tell its attribute, the first that fits.
NAME_HINTS = [
    ("email", r"mail"),
    ("phone", r"phone|(^|_)(tel|telephone|mobile|cell|fon|tel_?no)(_|$)|(^|_)contact_(tel|no|number)"),
    ("birth", r"birth|(^|_)(dob|born|bday)(_|$)"),
    ("postal", r"postal|postcode|post_code|(^|_)(zip|plz|zipcode)(_|$)"),
    ("city", r"city|town|locality|municip"),
    ("region", r"(^|_)(state|region|province|county|prov)(_|$)"),
    ("street", r"street|(^|_)(addr|address|addr1|address1)(_|$)|(^|_)line_?1(_|$)"),
    ("family", r"last_?name|name_?last|family|(^|_)(lname|surname|sname)(_|$)"),
    ("given", r"first_?name|name_?first|given|fore_?name|(^|_)fname(_|$)"),
]
#: Keys under which an object holds the value itself.
INNER_KEYS = ["value", "number", "address", "text", "name"]
MOST_FIELDS = 5000


def attribute_of(field: str) -> str | None:
    """The canonical attribute a field name stands for, or None."""
    for a, names in BASE_FIELDS.items():
        if field in names:
            return a
    f = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", field).lower()
    return next((a for a, p in NAME_HINTS if re.search(p, f)), None)


def payload_fields(raw: DataFrame) -> list[str]:
    """Distinct keys of all payloads that stand for an attribute. They are a schema, not data; keys that stand
    for none, of which there may be any number, are not brought to the driver."""

    @pandas_udf("boolean")
    def known(k: pd.Series) -> pd.Series:
        return k.map(lambda x: x is not None and attribute_of(x) is not None).astype(bool)

    keys = raw.select(F.explode(F.json_object_keys("payload")).alias("k")).distinct().filter(known("k")).limit(MOST_FIELDS + 1)
    got = sorted(r.k for r in keys.collect())
    if len(got) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} names of fields for {len(ATTRIBUTES)} attributes")
    return got


def unwrapped(c: Column) -> Column:
    """The one value in a JSON object or list; other text stays as it is."""
    inner = F.coalesce(*(F.get_json_object(c, f"$.{k}") for k in INNER_KEYS))
    return F.when(c.startswith("{"), inner).when(c.startswith("["), F.get_json_object(c, "$[0]")).otherwise(c)


def live(raw: DataFrame) -> DataFrame:
    return raw.filter(~F.coalesce(F.col("is_deleted"), F.lit(False)) & F.col("payload").isNotNull())


def delivered(raw: DataFrame, keep: Iterable[str | Column] = (), fields: dict[str, list[str]] | None = None) -> DataFrame:
    """Non-deleted rows with ``keep`` and a ``v_<attribute>`` text column for each attribute.

    fields: field names of each attribute, the preferred first; by default found from the names
    present in the data. A blank value gives way to another field of the same attribute. Rows with
    a null or unreadable payload have no row here; absent keys give null.
    """
    rows = live(raw)
    if fields is None:
        fields = {a: [] for a in ATTRIBUTES}
        for f in payload_fields(rows):
            if a := attribute_of(f):
                fields[a].append(f)
    names = sorted({f for fs in fields.values() for f in fs})
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = rows.select(*keep, F.from_json("payload", schema).alias("__p"))
    kept = [c for c in rows.columns if c != "__p"]
    # each step reads the one before more than once, so the steps stay apart and nothing is worked out twice
    inner = T.StructType([T.StructField(k, T.StringType()) for k in INNER_KEYS])
    at = {f: F.col("__p").getField(f) for f in names}
    rows = rows.select(*kept, "__p", *(F.from_json(F.when(c.startswith("{"), c), inner).alias(f"__j{i}") for i, c in enumerate(at.values())))
    objects = [F.coalesce(*(F.col(f"__j{i}").getField(k) for k in INNER_KEYS)) for i in range(len(names))]
    rows = rows.select(*kept, *(F.trim(F.when(c.startswith("{"), o).when(c.startswith("["), F.get_json_object(c, "$[0]")).otherwise(c)).alias(f"__{i}") for i, (c, o) in enumerate(zip(at.values(), objects))))
    filled = {f: F.when(~F.lower(F.col(f"__{i}")).isin(X.FILLER_WORDS), F.col(f"__{i}")) for i, f in enumerate(names)}
    value = {a: F.coalesce(*(filled[f] for f in fields.get(a, []))) if fields.get(a) else F.lit(None).cast("string") for a in ATTRIBUTES}
    return rows.select(*kept, *(c.alias(f"v_{a}") for a, c in value.items()))


def batch_order(profile_runs: DataFrame) -> DataFrame:
    """(ingest_batch_id, batch_no): a batch is as early as its smallest snapshot among raw runs."""
    return (
        profile_runs.filter((F.col("subject") == "raw") & F.col("ingest_batch_id").isNotNull() & F.col("snapshot").isNotNull())
        .groupBy("ingest_batch_id")
        .agg(F.min("snapshot").alias("batch_no"))
    )
