"""Standardization as column functions, supersession of versions, ingest of deliveries, receipts."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that mean null in standardization.
NULL_WORDS = ["", "null", "n/a", "-", "unknown"]
# Legal forms that end a company's name.
LEGAL_FORMS = ["inc", "incorporated", "llc", "corp", "corporation", "ltd", "limited", "co", "company", "gmbh", "plc", "llp", "lp"]
# The address grammar. A unit phrase at the end, a post-office box, a house number in front.
UNIT = "(^| )((apt|apartment|unit|ste|suite|fl|floor|rm|room) [a-z0-9-]+|#[a-z0-9-]+)$"
PO_BOX = "^(p ?o|post office) box( .*)?$"
HOUSE = "^([0-9]+[a-z]?)( |$)"
#: A mailbox: something, an at sign, something with a dot inside, no blank and no second at sign.
MAILBOX = r"^[^@\s]+@[^@\s]+[.][^@\s]+$"
TOMBSTONE = "0" * 64


def _normal(text: pa.Array, form: str) -> pa.Array:
    """Unicode normal form; ASCII values, which are in any form, are not touched."""
    odd = pc.fill_null(pc.invert(pc.string_is_ascii(text)), False)
    if not pc.any(odd).as_py():
        return text
    return pc.replace_with_mask(text, odd, pa.array([unicodedata.normalize(form, s) for s in text.filter(odd).to_pylist()], text.type))


def _chunk(text: pa.Array, *steps: tuple) -> pa.Array:
    """Arrow string kernels one after the other: nfc, nfd, lower, trim (blanks only), or (pattern, replacement)."""
    for step in steps:
        if step[0] in ("nfc", "nfd"):
            text = _normal(text, step[0].upper())
        elif step[0] == "lower":
            text = pc.utf8_lower(text)
        elif step[0] == "trim":
            text = pc.utf8_trim(text, characters=" ")
        else:
            text = pc.replace_substring_regex(text, pattern=step[0], replacement=step[1])
    return text


# Spark exposes no Unicode normalization; these run batch by batch on Arrow's kernels, and value by value only on what isn't ASCII.
_LOWERED = (("nfc",), ("trim",), ("lower",), ("nfc",))
_FOLDED = (*_LOWERED, ("nfd",), (r"\p{Mn}+", ""), ("nfc",))
_COLLAPSED = (("[[:space:]]+", " "), ("trim",))


@F.arrow_udf(T.StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Text in Unicode normal form C."""
    return _chunk(text, ("nfc",))


@F.arrow_udf(T.StringType())
def _lowered(text: pa.Array) -> pa.Array:
    return _chunk(text, *_LOWERED)


@F.arrow_udf(T.StringType())
def _name(text: pa.Array) -> pa.Array:
    return _chunk(text, *_FOLDED, ("[-_]", " "), ("[.'\u2019,]", ""), *_COLLAPSED)


@F.arrow_udf(T.StringType())
def _company(text: pa.Array) -> pa.Array:
    return _chunk(text, *_FOLDED, ("[.,'\u2019&]", ""), ("[-/_]", " "), *_COLLAPSED, (rf"[[:space:]]({'|'.join(LEGAL_FORMS)})$", ""), ("trim",))


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def lowercase_trim(c: Column) -> Column:
    return _filled(_lowered(c))


def null_semantics(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)).isin(NULL_WORDS), None).otherwise(c)


def name_norm(c: Column) -> Column:
    return null_semantics(_name(c))


def name_variants(df: DataFrame, name: str, lexicon: DataFrame) -> DataFrame:
    """``df`` with <name>_variants: the normalized name and, sorted, its one-hop neighbours among the active
    rows of the lexicon (variant_a, variant_b, active); an empty list where there is no name."""
    live = lexicon.filter("active") if "active" in lexicon.columns else lexicon
    both = live.select(F.col("variant_a").alias("__n"), F.col("variant_b").alias("__v")).unionByName(live.select(F.col("variant_b").alias("__n"), F.col("variant_a").alias("__v")))
    near = both.groupBy("__n").agg(F.array_sort(F.collect_set("__v")).alias("__vs"))
    own = df.withColumn("__own", name_norm(F.col(name)))
    out = own.join(near, own["__own"] == F.col("__n"), "left").drop("__n")
    got = F.when(F.col("__own").isNotNull(), F.concat(F.array(F.col("__own")), F.coalesce("__vs", F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>"))
    return out.withColumn(f"{name}_variants", got).drop("__vs", "__own")


def email_norm(c: Column, strip_plus: bool = False, placeholders: Sequence[str] = ()) -> tuple[Column, Column]:
    """(email, email_valid): the caller's placeholders give two nulls, an invalid mailbox null and false."""
    s = lowercase_trim(c)
    s = F.regexp_replace(s, "^([^+]*)[+][^@]*@", "$1@") if strip_plus else s
    fake, good = s.isin(list(placeholders)) if placeholders else F.lit(False), s.rlike(MAILBOX)
    return F.when(~fake & good, s), F.when(s.isNull() | fake, F.lit(None).cast("boolean")).otherwise(good)


def phone_e164(c: Column, region: str = "US") -> tuple[Column, Column]:
    """(phone_e164, phone_valid): a leading plus keeps its 7 to 15 digits; else, in the US, ten digits or
    eleven with a one. Texts that mean null give two nulls."""
    raw = null_semantics(lowercase_trim(c))
    d = F.regexp_replace(raw, "[^0-9]", "")
    out = F.when(raw.startswith("+"), F.when(F.length(d).between(7, 15) & ~d.startswith("0"), F.concat(F.lit("+"), d)))
    if region.upper() == "US":
        out = out.when(F.length(d) == 10, F.concat(F.lit("+1"), d)).when((F.length(d) == 11) & d.startswith("1"), F.concat(F.lit("+"), d))
    return out, F.when(raw.isNotNull(), out.isNotNull())


def address_parse(c: Column, city: Column | None = None, region: Column | None = None, postal: Column | None = None) -> dict[str, Column]:
    """Number, street and unit by one anchored grammar, all null for post-office boxes and where no street is
    left; city, region and postal code pass through."""
    flat = _filled(F.trim(F.regexp_replace(F.regexp_replace(lowercase_trim(c), "[.,]", ""), r"\s+", " ")))
    line = null_semantics(flat)
    line = F.when(~line.rlike(PO_BOX), line)
    rest = F.trim(F.regexp_replace(line, UNIT, ""))
    street = _filled(F.trim(F.regexp_replace(rest, HOUSE, "")))
    out = {"addr_number": _filled(F.regexp_extract(rest, HOUSE, 1)), "addr_street": street, "addr_unit": _filled(F.regexp_extract(line, UNIT, 2))}
    out = {n: F.when(street.isNotNull(), x) for n, x in out.items()}
    through = {"addr_city": city, "addr_region": region, "addr_postal": postal}
    return out | {n: null_semantics(lowercase_trim(x)) for n, x in through.items() if x is not None}


# strptime tokens and Java's letters for them
_JAVA = {"%-d": "d", "%-m": "M", "%Y": "yyyy", "%m": "M", "%d": "d", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "D", "%H": "H", "%M": "m", "%S": "s"}


def date_precision(pattern: str) -> str:
    """day, month or year: what a strptime pattern tells a date to."""
    p = pattern.replace("%%", "")
    return "day" if any(t in p for t in ("%d", "%-d", "%j")) else "month" if any(t in p for t in ("%m", "%-m", "%b", "%B")) else "year"


def parse_date(c: Column, pattern: str) -> Column:
    """Date by a strptime pattern; null unless the pattern tells a day and the text fits. Texts that mean null are null."""
    if date_precision(pattern) != "day":
        return F.lit(None).cast("date")
    java = reduce(lambda p, kv: p.replace(*kv), _JAVA.items(), pattern.replace("'", "''"))
    s = null_semantics(lowercase_trim(c))
    return F.try_to_timestamp(F.initcap(s) if "MMM" in java else s, F.lit(java)).cast("date")


def source_metadata(payload: Column, mapped: Sequence[str]) -> Column:
    """Unmapped fields of a JSON payload, sorted by name, as JSON."""
    m = F.map_filter(F.from_json(payload, "map<string,string>"), lambda k, _: ~k.isin(list(mapped)))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def company_name(c: Column) -> Column:
    return null_semantics(lowercase_trim(c))


def company_name_norm(c: Column) -> Column:
    """Match key: accents and punctuation out, hyphens and slashes to blanks, one trailing legal form off."""
    return null_semantics(_company(c))


def company_variants(c: Column) -> Column:
    n = company_name_norm(c)
    return F.when(n.isNotNull(), F.array(n)).otherwise(F.array().cast("array<string>"))


def domain(c: Column) -> Column:
    return null_semantics(lowercase_trim(c))


def domain_norm(c: Column) -> Column:
    """Without http(s) scheme, a leading www, what follows the host, and dots at the end."""
    s = F.regexp_replace(F.regexp_replace(lowercase_trim(c), "^https?://", ""), "^www[.]", "")
    return null_semantics(F.regexp_replace(F.regexp_replace(s, "[/?].*$", ""), "[.]+$", ""))


def account(df: DataFrame, id_field: str, mapped: Mapping[str, str], region: str = "US") -> DataFrame:
    """Standardized rows of organisations: record_key, source_system, and of each mapped attribute (company_name,
    domain, phone_e164, address_line, city, region, postal) its normalized columns. ``mapped``: attribute -> column."""
    col = {a: F.col(c) for a, c in mapped.items()}
    out: dict[str, Column] = {}
    if "company_name" in col:
        c = col["company_name"]
        out |= {"company_name": company_name(c), "company_name_norm": company_name_norm(c), "company_variants": company_variants(c)}
    if "domain" in col:
        out |= {"domain": domain(col["domain"]), "domain_norm": domain_norm(col["domain"])}
    if "phone_e164" in col:
        out["phone_e164"], out["phone_valid"] = phone_e164(col["phone_e164"], region)
    if "address_line" in col:
        out |= address_parse(col["address_line"], col.get("city"), col.get("region"), col.get("postal"))
    key = F.concat("source_system", F.lit(":"), F.col(id_field).cast("string")).alias("record_key")
    return df.select(key, "source_system", F.lit(None).cast("timestamp_ntz").alias("updated_at_source"), F.lit(None).cast("timestamp_ntz").alias("ingested_at"), *(c.alias(n) for n, c in out.items()))


def transform(c: Column, steps: Sequence[tuple]) -> Column:
    """Field transforms in order: (lower), (upper), (trim), (replace, a, b), (regex_replace, p, r), (strip, chars),
    (substring, from, length), (default, value), (dictionary, map), (words, map), (ignore, words)."""
    for name, *a in steps:
        if name in ("lower", "upper", "trim"):
            c = getattr(F, name)(c)
        elif name == "replace":
            c = F.replace(c, F.lit(a[0]), F.lit(a[1]))
        elif name == "regex_replace":
            c = F.regexp_replace(c, a[0], a[1])
        elif name == "strip":
            c = F.translate(c, a[0], "")
        elif name == "substring":
            c = F.substring(c, a[0], a[1])
        elif name == "default":
            c = F.coalesce(F.when(c != "", c), F.lit(a[0]))
        elif name == "dictionary":
            c = _mapped(c, a[0])
        elif name == "words":
            table = dict(a[0])
            c = F.array_join(F.transform(F.split(c, " "), lambda w: _mapped(w, table)), " ")
        elif name == "ignore":
            drop = [w.lower() for w in a[0]]
            c = F.array_join(F.filter(F.split(c, " "), lambda w: ~F.lower(w).isin(drop)), " ")
        else:
            raise ValueError(f"unknown transform {name!r}")
    return c


def _mapped(c: Column, table: Mapping[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c), c) if table else c


def preview(df: DataFrame, key: str, column: str, steps: Sequence[tuple], k: int) -> DataFrame:
    """(key, before, after) of the first k rows by key that a transform changes."""
    out = df.select(key, F.col(column).alias("before"), transform(F.col(column), steps).alias("after"))
    return out.filter("before IS NOT NULL AND NOT (before <=> after)").orderBy(key).limit(k)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def supersede(raw: DataFrame) -> DataFrame:
    """The current version of each record: last delivered, then last batch; keys whose last version is a deletion have none."""
    last = latest(raw, ["source_system", "source_record_id"], [F.desc_nulls_last("ingested_at"), F.desc_nulls_last("ingest_batch_id"), F.desc("id")])
    return last.filter(~F.coalesce("is_deleted", F.lit(False)))


def content_hash(*columns: Column, metadata: Mapping[str, Column] | None = None) -> Column:
    """SHA-256 of the NFC values joined by the unit separator, a null counting as empty. ``metadata``, unmapped
    fields by name, extends it: hash of each name, then N for null or V and the hash of the value as it is."""
    h = F.sha2(nfc(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))), 256)
    if not metadata:
        return h
    extra = [F.concat(F.sha2(F.lit(n), 256), F.when(c.isNull(), "N").otherwise(F.concat(F.lit("V"), F.sha2(c.cast("string"), 256)))) for n, c in sorted(metadata.items())]
    return F.sha2(F.concat_ws("\x1f", h, F.lit("metadata-v1"), F.concat(*extra)), 256)


# The columns of a standardized row's hash, in the order in which they are hashed.
STD_HASH_COLUMNS = [
    "record_key", "std_version", "given_name", "family_name", "name_variants", "email", "email_valid", "phone_e164", "phone_valid",
    "addr_number", "addr_street", "addr_unit", "addr_city", "addr_region", "addr_postal", "birth_date", "updated_at_source", "content_hash",
]


def std_hash(df: DataFrame) -> Column:
    """Hash of a standardized row: booleans as words, dates and times in ISO form, lists joined by the unit
    separator. A missing column is an error; others change nothing."""
    types = dict(df.dtypes)
    if missing := [c for c in STD_HASH_COLUMNS if c not in types]:
        raise ValueError(f"a row hash needs {missing}")

    def text(c: str) -> Column:
        if types[c].startswith("timestamp"):
            iso = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            return F.concat(iso, F.when(F.date_format(c, "SSSSSS") != "000000", F.date_format(c, ".SSSSSS")).otherwise(""))
        return F.concat_ws("\x1f", c) if types[c].startswith("array") else F.col(c)

    return content_hash(*(text(c) for c in STD_HASH_COLUMNS))


def receipt(raw: DataFrame, batch: str, source: str) -> DataFrame:
    """(new, changed, unchanged, tombstoned, resurrected): what a source's batch did against each key's last
    version in any other batch."""
    mine = raw.filter(F.col("source_system") == source)
    order = [F.desc_nulls_last("ingested_at"), F.desc_nulls_last("ingest_batch_id"), F.desc("id")]
    old = latest(mine.filter(F.col("ingest_batch_id") != batch), ["source_record_id"], order).select("source_record_id", F.col("content_hash").alias("old"))
    x = mine.filter(F.col("ingest_batch_id") == batch).select("source_record_id", F.col("content_hash").alias("new")).join(old, "source_record_id", "left")
    here, was = F.col("new") != TOMBSTONE, F.col("old") != TOMBSTONE
    n = lambda c: F.count_if(c).cast("long")
    return x.agg(
        n(here & F.col("old").isNull()).alias("new"), n(here & was & (F.col("old") != F.col("new"))).alias("changed"), n(here & (F.col("old") == F.col("new"))).alias("unchanged"),
        n(~here & was).alias("tombstoned"), n(here & ~was).alias("resurrected"),
    )


def omitted(raw: DataFrame, source: str, batch: str) -> DataFrame:
    """(source_record_id): live keys of a source that a full delivery no longer brings."""
    live = supersede(raw.filter((F.col("source_system") == source) & (F.col("ingest_batch_id") != batch))).select("source_record_id")
    return live.join(raw.filter((F.col("source_system") == source) & (F.col("ingest_batch_id") == batch)).select("source_record_id"), "source_record_id", "left_anti").distinct()


def ingest(rows: DataFrame, source: str, id_field: str, batch: str, mapped: Sequence[str], at: Column, drop: Sequence[str] = ("persona_id",)) -> DataFrame:
    """A delivered table as versions for the raw store: payload JSON with sorted keys, content hash of the mapped fields."""
    cols = [c for c in rows.columns if c not in drop]
    if len({c.lower() for c in cols}) != len(cols):
        raise ValueError("a header occurs twice")
    entries = F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in sorted(cols)))
    return rows.select(
        F.lit(source).alias("source_system"), F.col(id_field).cast("string").alias("source_record_id"), F.to_json(F.map_from_entries(entries)).alias("payload"),
        content_hash(*(F.col(c) for c in mapped)).alias("content_hash"), F.lit(False).alias("is_deleted"), F.lit(batch).alias("ingest_batch_id"), at.alias("ingested_at"),
    )


def tombstones(raw: DataFrame, source: str, batch: str, at: Column) -> DataFrame:
    """Deletions of the keys that a full delivery leaves out."""
    return omitted(raw, source, batch).select(
        F.lit(source).alias("source_system"), "source_record_id", F.lit(None).cast("string").alias("payload"), F.lit(TOMBSTONE).alias("content_hash"), F.lit(True).alias("is_deleted"), F.lit(batch).alias("ingest_batch_id"), at.alias("ingested_at")
    )


def widened(df: DataFrame, key: str, parent: str, prefix: str, columns: Sequence[str]) -> DataFrame:
    """``df`` with columns borrowed, under a prefix, from the record its ``parent`` column names."""
    other = df.select(F.col(key).alias("__k"), *(F.col(c).alias(f"{prefix}{c}") for c in columns))
    return df.join(other, F.col(parent) == F.col("__k"), "left").drop("__k")


def in_segment(df: DataFrame, condition: str) -> DataFrame:
    """Rows a named condition holds for; null counts as out."""
    return df.filter(F.coalesce(F.expr(condition), F.lit(False)))
