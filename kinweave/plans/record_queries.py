"""Standardization, supersession, ingest, stores, increments, statements and read paths."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import identity as I
from kinweave.operators import quality as Q  # noqa: F401
from kinweave.operators import standardize as S
from kinweave.plans import common as C
from kinweave.plans.registry import MEMBERS, STD, query
from kinweave.session import checkpoint_root, cut, table
from kinweave.sources import readers
from kinweave.sources.store import Store
from kinweave.streaming import incremental as R

_RAW = "raw AS (SELECT * FROM raw_records_golden)"
_FIELD = "json_extract_string(payload, '$.{}')"


def _values(spark, d):
    """(value): every scalar value of any field in the payloads of all sources, once."""
    raw = table(spark, d, "raw_records_golden").filter("payload IS NOT NULL")
    got = raw.select(F.explode(F.map_values(F.from_json("payload", "map<string,string>"))).alias("value"))
    return got.filter("value IS NOT NULL AND substr(value, 1, 1) NOT IN ('{', '[')").distinct()


_VALUES = """vals AS (SELECT DISTINCT value FROM (SELECT json_extract_string(payload, '$."' || k || '"') AS value, json_type(payload, '$."' || k || '"') AS t FROM (SELECT payload, unnest(json_keys(payload)) AS k FROM raw_records_golden WHERE payload IS NOT NULL)) WHERE value IS NOT NULL AND substr(value, 1, 1) NOT IN ('{', '['))"""


# The standardizers as the contract writes them in SQL
def _lt(c):
    return f"nullif(nfc_normalize(lower(trim(nfc_normalize({c})))), '')"


def _ns(c):
    return f"CASE WHEN list_contains(['', 'null', 'n/a', '-', 'unknown'], lower(trim({c}))) THEN NULL ELSE {c} END"


@query(f"WITH {_VALUES} SELECT value, {_lt('value')} AS v FROM vals")
def std_lowercase_trim(spark, d):
    return _values(spark, d).select("value", S.lowercase_trim(F.col("value")).alias("v"))


@query(f"WITH {_VALUES} SELECT value, {_ns('value')} AS v FROM vals")
def std_null_semantics(spark, d):
    return _values(spark, d).select("value", S.null_semantics(F.col("value")).alias("v"))


def _name_sql(c):
    punctuated = f"regexp_replace(regexp_replace(nfc_normalize(strip_accents({_lt(c)})), '[-_]', ' ', 'g'), '[.''’,]', '', 'g')"
    return _ns(f"nullif(trim(regexp_replace({punctuated}, '[[:space:]]+', ' ', 'g')), '')")


@query(f"WITH {_VALUES} SELECT value, {_name_sql('value')} AS v FROM vals")
def std_name_norm(spark, d):
    return _values(spark, d).select("value", S.name_norm(F.col("value")).alias("v"))


_LEXICON = [("william", "bill", True), ("william", "will", True), ("robert", "bob", True), ("robert", "rob", False), ("elizabeth", "liz", True), ("elizabeth", "beth", True)]


@query(f"""WITH lex(a, b, active) AS (VALUES {", ".join(f"('{a}', '{b}', {x})" for a, b, x in _LEXICON)}), s AS (SELECT a, b FROM lex WHERE active UNION ALL SELECT b, a FROM lex WHERE active), {_VALUES}, n AS (SELECT value, {_name_sql('value')} AS n FROM vals)
    SELECT value, CASE WHEN n IS NULL THEN '' ELSE array_to_string(list_prepend(n, coalesce((SELECT list_sort(list_distinct(list(b))) FROM s WHERE a = n), [])), ',') END AS variants FROM n""")
def std_name_variants(spark, d):
    lex = spark.createDataFrame(_LEXICON, "variant_a string, variant_b string, active boolean")
    return S.name_variants(_values(spark, d), "value", lex).select("value", F.array_join("value_variants", ",").alias("variants"))


_PLACEHOLDERS = ["test@example.com", "nobody@example.com", "noreply@example.com"]
_FAKE = "s IN (" + ", ".join(f"'{p}'" for p in _PLACEHOLDERS) + ")"
_MAIL = "regexp_full_match(s, '[^@[:space:]]+@[^@[:space:]]+[.][^@[:space:]]+')"


@query(f"WITH {_VALUES}, n AS (SELECT value, regexp_replace({_lt('value')}, '[+][^@]*@', '@') AS s FROM vals) SELECT value, CASE WHEN {_FAKE} OR NOT {_MAIL} THEN NULL ELSE s END AS email, CASE WHEN s IS NULL OR {_FAKE} THEN NULL ELSE {_MAIL} END AS email_valid FROM n")
def std_email(spark, d):
    e, ok = S.email_norm(F.col("value"), True, _PLACEHOLDERS)
    return _values(spark, d).select("value", e.alias("email"), ok.alias("email_valid"))


_E164 = "CASE WHEN starts_with(p, '+') THEN CASE WHEN length(g) BETWEEN 7 AND 15 AND NOT starts_with(g, '0') THEN '+' || g END WHEN length(g) = 10 THEN '+1' || g WHEN length(g) = 11 AND starts_with(g, '1') THEN '+' || g END"


@query(f"WITH {_VALUES}, n AS (SELECT value, {_ns(_lt('value'))} AS p FROM vals), m AS (SELECT *, regexp_replace(p, '[^0-9]', '', 'g') AS g FROM n) SELECT value, {_E164} AS phone_e164, CASE WHEN p IS NULL THEN NULL ELSE ({_E164}) IS NOT NULL END AS phone_valid FROM m")
def std_phone(spark, d):
    p, ok = S.phone_e164(F.col("value"))
    return _values(spark, d).select("value", p.alias("phone_e164"), ok.alias("phone_valid"))


def _address_sql(source, line, through=""):
    flat = f"nullif(trim(regexp_replace(regexp_replace({_lt(line)}, '[.,]', '', 'g'), '[[:space:]]+', ' ', 'g')), '')"
    return f"""a AS (SELECT *, {_ns(flat)} AS voc FROM {source}), b AS (SELECT *, CASE WHEN regexp_full_match(voc, '{S.PO_BOX}') THEN NULL ELSE voc END AS line FROM a),
        c AS (SELECT *, nullif(regexp_extract(line, '{S.UNIT}', 2), '') AS unit, trim(regexp_replace(line, '{S.UNIT}', '')) AS rest FROM b),
        e AS (SELECT *, nullif(regexp_extract(rest, '{S.HOUSE}', 1), '') AS num, nullif(trim(regexp_replace(rest, '{S.HOUSE}', '')), '') AS street FROM c)"""


@query(f"WITH {_address_sql('address_golden', 'input')} SELECT address_id, CASE WHEN street IS NOT NULL THEN num END AS number, street, CASE WHEN street IS NOT NULL THEN unit END AS unit, {_ns(_lt('addr_city'))} AS city, {_ns(_lt('addr_region'))} AS region, {_ns(_lt('addr_postal'))} AS postal FROM e")
def std_address(spark, d):
    c = F.col
    parts = S.address_parse(c("input"), c("addr_city"), c("addr_region"), c("addr_postal"))
    return table(spark, d, "address_golden").select("address_id", *(x.alias(n.removeprefix("addr_")) for n, x in parts.items()))


@query(f"WITH {_VALUES}, {_address_sql('vals', 'value')} SELECT value, CASE WHEN street IS NOT NULL THEN num END AS addr_number, street AS addr_street, CASE WHEN street IS NOT NULL THEN unit END AS addr_unit FROM e")
def std_address_values(spark, d):
    return _values(spark, d).select("value", *(x.alias(n) for n, x in S.address_parse(F.col("value")).items()))


@query(f"WITH {_VALUES} SELECT value, try_strptime({_ns(_lt('value'))}, '%Y-%m-%d')::DATE::VARCHAR AS iso, try_strptime({_ns(_lt('value'))}, '%m/%d/%Y')::DATE::VARCHAR AS us, NULL::VARCHAR AS month FROM vals")
def std_date(spark, d):
    day = lambda p: S.parse_date(F.col("value"), p).cast("string")
    return _values(spark, d).select("value", day("%Y-%m-%d").alias("iso"), day("%m/%d/%Y").alias("us"), day("%Y-%m").alias("month"))


_MAPPED = ["crm_id", "first_name", "last_name", "email_address", "phone", "street_address", "city", "state", "zip", "dob", "last_modified", "account_no", "fname", "lname", "billing_email", "contact_phone", "addr1", "addr_city", "addr_state", "postal_code", "birth_date", "updated_ts"]


@query("SELECT DISTINCT id, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT unnest(json_keys(payload)) AS k) WHERE k NOT IN (" + ", ".join(f"'{m}'" for m in _MAPPED) + ")) AS extra FROM raw_records_golden WHERE payload IS NOT NULL")
def std_metadata(spark, d):
    raw = table(spark, d, "raw_records_golden").filter("payload IS NOT NULL").select("id", S.source_metadata(F.col("payload"), _MAPPED).alias("m")).distinct()
    return raw.select("id", F.nullif(F.array_join(F.array_sort(F.json_object_keys("m")), ","), F.lit("")).alias("extra"))


_CO = f"trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(strip_accents({_lt('n')})), '[.,''’&]', '', 'g'), '[-/_]', ' ', 'g'), '[[:space:]]+', ' ', 'g'))"
_CO_NORM = _ns(f"nullif(trim(regexp_replace({_CO}, '[[:space:]]({'|'.join(S.LEGAL_FORMS)})$', '')), '')")
_CO_NAMES = "s_suppkey AS id, concat(s_name, CASE s_suppkey % 7 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' GmbH' WHEN 2 THEN '  Co' WHEN 3 THEN '-Wörks & Söhne AG' WHEN 4 THEN '/Nord L.L.P.' WHEN 5 THEN ' Co. Ltd' ELSE '' END) AS n"


@query(f"WITH c AS (SELECT {_CO_NAMES} FROM supplier UNION ALL SELECT NULL, 'N/A') SELECT id, {_ns(_lt('n'))} AS light, {_CO_NORM} AS norm, CASE WHEN ({_CO_NORM}) IS NULL THEN 0 ELSE 1 END AS variants FROM c")
def std_company(spark, d):
    c = table(spark, d, "supplier").selectExpr(*_CO_NAMES.replace(" AS n", " AS n|").replace("AS id, ", "AS id|").split("|")[:2])
    c = c.unionByName(spark.createDataFrame([(None, "N/A")], c.schema))
    n = F.col("n")
    return c.select("id", S.company_name(n).alias("light"), S.company_name_norm(n).alias("norm"), F.size(S.company_variants(n)).alias("variants"))


_DOMAIN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '^https?://', ''), '^www[.]', ''), '[/?].*$', ''), '[.]+$', '')"


@query(f"WITH c AS (SELECT DISTINCT email, concat(CASE length(email) % 3 WHEN 0 THEN 'HTTPS://WWW.' WHEN 1 THEN 'ftp://' ELSE '' END, split_part(email, '@', 2), './p?q=1') AS u FROM int_std_records) SELECT email, {_ns('u')} AS light, {_ns('nullif(' + _DOMAIN.format(_lt('u')) + chr(44) + chr(39) * 2 + ')')} AS v FROM c WHERE email IS NOT NULL")
def std_domain(spark, d):
    c = table(spark, d, "int_std_records").filter("email IS NOT NULL").select("email").distinct()
    u = F.concat(F.when(F.length("email") % 3 == 0, "HTTPS://WWW.").when(F.length("email") % 3 == 1, "ftp://").otherwise(""), F.split_part("email", F.lit("@"), F.lit(2)), F.lit("./p?q=1"))
    return c.select("email", S.null_semantics(u).alias("light"), S.domain_norm(u).alias("v"))


@query("SELECT DISTINCT addr_street AS before, coalesce(nullif(substr(upper(replace(regexp_replace(addr_street, '[0-9]+', 'N', 'g'), 'street', 'st')), 1, 12), ''), 'NONE') AS after FROM int_std_records")
def transform_chain(spark, d):
    steps = [("regex_replace", "[0-9]+", "N"), ("replace", "street", "st"), ("upper",), ("substring", 1, 12), ("default", "NONE")]
    return table(spark, d, "int_std_records").select(F.col("addr_street").alias("before"), S.transform(F.col("addr_street"), steps).alias("after")).distinct()


_W = "CASE w WHEN 'street' THEN 'st' WHEN 'avenue' THEN 'av' WHEN 'road' THEN 'rd' ELSE w END"


@query(f"WITH s AS (SELECT DISTINCT addr_street AS before FROM int_std_records WHERE addr_street IS NOT NULL) SELECT before, array_to_string(list_filter(list_transform(string_split(before, ' '), lambda w: {_W}), lambda w: lower(w) NOT IN ('north', 'south')), ' ') AS after FROM s")
def transform_words(spark, d):
    """A dictionary applied word by word, then words left out."""
    steps = [("words", {"street": "st", "avenue": "av", "road": "rd"}), ("ignore", ["north", "south"])]
    s = table(spark, d, "int_std_records").filter("addr_street IS NOT NULL").select(F.col("addr_street").alias("before")).distinct()
    return s.select("before", S.transform(F.col("before"), steps).alias("after"))


@query("SELECT DISTINCT addr_region AS before, CASE addr_region WHEN 'xa' THEN 'alpha' WHEN 'xb' THEN 'beta' ELSE addr_region END AS after FROM int_std_records")
def transform_dictionary(spark, d):
    return table(spark, d, "int_std_records").select(F.col("addr_region").alias("before"), S.transform(F.col("addr_region"), [("dictionary", {"xa": "alpha", "xb": "beta"})]).alias("after")).distinct()


@query(f"WITH {STD} SELECT record_key, addr_city AS before, replace(addr_city, 'saint', 'st') AS after FROM std WHERE addr_city LIKE '%saint%' ORDER BY record_key LIMIT 25")
def transform_preview(spark, d):
    return S.preview(C.std(spark, d), "record_key", "addr_city", [("replace", "saint", "st")], 25)


_CUR = "cur AS (SELECT * FROM raw_records_golden QUALIFY row_number() OVER (PARTITION BY source_system, source_record_id ORDER BY ingested_at DESC NULLS LAST, ingest_batch_id DESC NULLS LAST, id DESC) = 1)"


@query(f"WITH {_CUR} SELECT source_system, source_record_id, id, content_hash FROM cur WHERE NOT coalesce(is_deleted, false)")
def supersession(spark, d):
    return S.supersede(table(spark, d, "raw_records_golden")).select("source_system", "source_record_id", "id", "content_hash")


@query(f"WITH {_CUR} SELECT source_system AS source, source_record_id, content_hash FROM cur WHERE NOT coalesce(is_deleted, false)")
def stg_union(spark, d):
    """Sources standardized one by one and stacked in the order of their names."""
    cur = cut(S.supersede(table(spark, d, "raw_records_golden")))
    names = sorted(r[0] for r in cur.select("source_system").distinct().collect() if r[0])  # one row for each source
    arms = [cur.filter(F.col("source_system") == s).select(F.lit(s).alias("source"), "source_record_id", "content_hash") for s in names]
    return reduce(DataFrame.unionByName, arms) if arms else cur.select(F.col("source_system").alias("source"), "source_record_id", "content_hash")


@query(f"WITH {STD} SELECT record_key, sha256(concat_ws(chr(31), coalesce(given_name, ''), coalesce(family_name, ''), coalesce(email, ''), coalesce(birth_date::VARCHAR, ''))) AS h FROM std")
def content_hash(spark, d):
    return C.std(spark, d).select("record_key", S.content_hash(*(F.col(c) for c in ("given_name", "family_name", "email", "birth_date"))).alias("h"))


_EXTRA = {"addr_unit": "addr_unit", "addr_city": "addr_city"}


@query(f"WITH {STD}, h AS (SELECT *, sha256(nfc_normalize(concat_ws(chr(31), coalesce(given_name, ''), coalesce(email, '')))) AS h FROM std) SELECT record_key, sha256(concat_ws(chr(31), h, 'metadata-v1', " + " || ".join(f"sha256('{n}') || CASE WHEN {n} IS NULL THEN 'N' ELSE 'V' || sha256({n}) END" for n in sorted(_EXTRA)) + ")) AS h FROM h")
def content_hash_metadata(spark, d):
    """The hash extended by unmapped fields: presence and value of each, by name."""
    return C.std(spark, d).select("record_key", S.content_hash(F.col("given_name"), F.col("email"), metadata={n: F.col(c) for n, c in _EXTRA.items()}).alias("h"))


def _hash_text(c):
    if c == "updated_at_source":
        return "coalesce(CASE WHEN microsecond(updated_at_source) % 1000000 = 0 THEN strftime(updated_at_source, '%Y-%m-%dT%H:%M:%S') ELSE strftime(updated_at_source, '%Y-%m-%dT%H:%M:%S.%f') END, '')"
    return "coalesce(array_to_string(name_variants, chr(31)), '')" if c == "name_variants" else f"coalesce({c}::VARCHAR, '')"


@query(f"WITH {STD} SELECT record_key, sha256(nfc_normalize(concat_ws(chr(31), " + ", ".join(map(_hash_text, S.STD_HASH_COLUMNS)) + "))) AS h FROM std")
def std_row_hash(spark, d):
    s = C.std(spark, d)
    return s.select("record_key", S.std_hash(s).alias("h"))


_LASTB = "b AS (SELECT max_by(ingest_batch_id, (ingested_at, ingest_batch_id)) AS id FROM raw_records_golden WHERE source_system = 'crm')"
_ORD = "ORDER BY ingested_at DESC NULLS LAST, ingest_batch_id DESC NULLS LAST, id DESC"


def _last_batch(spark, d):
    return table(spark, d, "raw_records_golden").filter("source_system = 'crm'").agg(F.max_by("ingest_batch_id", F.struct("ingested_at", "ingest_batch_id"))).first()[0]


_GONE = f"'{S.TOMBSTONE}'"


@query(f"""WITH {_LASTB}, prior AS (SELECT source_record_id, content_hash, row_number() OVER (PARTITION BY source_record_id {_ORD}) AS rn FROM raw_records_golden WHERE source_system = 'crm' AND ingest_batch_id <> (SELECT id FROM b)),
    p AS (SELECT source_record_id, content_hash FROM prior WHERE rn = 1), tb AS (SELECT source_record_id, content_hash FROM raw_records_golden WHERE source_system = 'crm' AND ingest_batch_id = (SELECT id FROM b))
    SELECT count(*) FILTER (WHERE tb.content_hash <> {_GONE} AND p.source_record_id IS NULL) AS new, count(*) FILTER (WHERE tb.content_hash <> {_GONE} AND p.content_hash = {_GONE}) AS resurrected,
        count(*) FILTER (WHERE tb.content_hash <> {_GONE} AND p.content_hash = tb.content_hash) AS unchanged,
        count(*) FILTER (WHERE tb.content_hash <> {_GONE} AND p.source_record_id IS NOT NULL AND p.content_hash <> {_GONE} AND p.content_hash <> tb.content_hash) AS changed,
        count(*) FILTER (WHERE tb.content_hash = {_GONE} AND p.source_record_id IS NOT NULL AND p.content_hash <> {_GONE}) AS tombstoned
    FROM tb LEFT JOIN p ON tb.source_record_id = p.source_record_id""")
def batch_receipt(spark, d):
    return S.receipt(table(spark, d, "raw_records_golden"), _last_batch(spark, d), "crm")


@query(f"WITH {_LASTB}, cur AS (SELECT * FROM raw_records_golden WHERE source_system = 'crm' AND ingest_batch_id <> (SELECT id FROM b) QUALIFY row_number() OVER (PARTITION BY source_record_id {_ORD}) = 1) SELECT source_record_id FROM cur WHERE NOT coalesce(is_deleted, false) AND source_record_id NOT IN (SELECT source_record_id FROM raw_records_golden WHERE source_system = 'crm' AND ingest_batch_id = (SELECT id FROM b))")
def omitted_keys(spark, d):
    return S.omitted(table(spark, d, "raw_records_golden"), "crm", _last_batch(spark, d))


@query(f"WITH {_LASTB}, cur AS (SELECT * FROM raw_records_golden WHERE source_system = 'crm' AND ingest_batch_id <> (SELECT id FROM b) QUALIFY row_number() OVER (PARTITION BY source_record_id {_ORD}) = 1) SELECT 'crm' AS source_system, source_record_id, {_GONE} AS content_hash, true AS is_deleted, 'next' AS ingest_batch_id FROM cur WHERE NOT coalesce(is_deleted, false) AND source_record_id NOT IN (SELECT source_record_id FROM raw_records_golden WHERE source_system = 'crm' AND ingest_batch_id = (SELECT id FROM b))")
def tombstones(spark, d):
    """Deletions of what a full delivery leaves out."""
    raw, last = table(spark, d, "raw_records_golden"), _last_batch(spark, d)
    return S.tombstones(raw, "crm", last, F.lit("2025-04-01").cast("timestamp_ntz")).select("source_system", "source_record_id", "content_hash", "is_deleted", F.lit("next").alias("ingest_batch_id"))


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    """A table written as CSV and read again, numbers told from texts."""
    path = f"{checkpoint_root(spark)}/kinweave/csv-{uuid.uuid4().hex}.csv"
    readers.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return readers.read_any(spark, path)


@query(f"WITH {_CUR} SELECT source_system, source_record_id, content_hash FROM cur")
def stream_latest(spark, d):
    """The raw table delivered as a file stream into a bucketed table: the last version of each key stays."""
    raw = table(spark, d, "raw_records_golden").select("source_system", "source_record_id", "content_hash", "ingested_at", "ingest_batch_id", "id")
    at = f"{checkpoint_root(spark)}/kinweave/stream-{uuid.uuid4().hex}"
    raw.repartition(2).write.parquet(f"{at}/in")
    s = Store(spark, f"{at}/store")
    q = R.deliver(spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), s, "raw", ["source_system", "source_record_id"], f"{at}/cp", order=("ingested_at", "ingest_batch_id", "id"))
    q.awaitTermination()
    return s.read("raw").select("source_system", "source_record_id", "content_hash")


@query("SELECT 'shop' AS source_system, c_custkey::VARCHAR AS source_record_id, sha256(concat_ws(chr(31), c_name, c_mktsegment)) AS content_hash, false AS is_deleted, 'b1' AS ingest_batch_id FROM customer")
def ingest_delivery(spark, d):
    x = S.ingest(table(spark, d, "customer"), "shop", "c_custkey", "b1", ["c_name", "c_mktsegment"], F.lit("2025-01-01").cast("timestamp_ntz"))
    return x.select("source_system", "source_record_id", "content_hash", "is_deleted", "ingest_batch_id")


@query("SELECT c.c_custkey AS k, n.n_name AS nation_n_name, n.n_regionkey AS nation_n_regionkey FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def related_widen(spark, d):
    n = table(spark, d, "nation").selectExpr("n_nationkey AS key", "n_name", "n_regionkey", "cast(null AS int) AS parent", "cast(null AS bigint) AS k")
    c = table(spark, d, "customer").selectExpr("cast(null AS int) AS key", "cast(null AS string) AS n_name", "cast(null AS int) AS n_regionkey", "c_nationkey AS parent", "c_custkey AS k")
    both = n.unionByName(c)
    return S.widened(both, "key", "parent", "nation_", ["n_name", "n_regionkey"]).filter("k IS NOT NULL").select("k", "nation_n_name", "nation_n_regionkey")


@query(f"WITH {STD} SELECT record_key FROM std WHERE coalesce(email_valid AND addr_region = 'xa', false)")
def segment(spark, d):
    return S.in_segment(C.std(spark, d), "email_valid AND addr_region = 'xa'").select("record_key")


# Stores -----------------------------------------------------------------------------------------
def _store(spark):
    return Store(spark, f"{checkpoint_root(spark)}/kinweave/store-{uuid.uuid4().hex}")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 2")
def store_as_of(spark, d):
    """An append and a replacement, then the version between them read again."""
    s, n = _store(spark), table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    s.write("nation", n.filter("n_regionkey = 0"))
    v = s.write("nation", n.filter("n_regionkey = 1"), "append", order_by=["n_nationkey"])
    s.write("nation", n.filter("n_regionkey = 4"))
    return s.read("nation", v).select("n_nationkey", "n_name")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'merged' ELSE s_name END AS s_name FROM supplier WHERE s_suppkey % 5 <> 0 OR s_suppkey % 3 = 0")
def store_merge(spark, d):
    s, x = _store(spark), table(spark, d, "supplier").select("s_suppkey", "s_name")
    s.write("t", x.filter("s_suppkey % 5 <> 0"))
    s.merge("t", x.filter("s_suppkey % 3 = 0").withColumn("s_name", F.lit("merged")), ["s_suppkey"])
    return s.read("t")


@query("SELECT p_partkey, p_brand FROM part WHERE p_size > 10 OR p_size IS NULL")
def store_delete(spark, d):
    s = _store(spark)
    s.write("t", table(spark, d, "part").select("p_partkey", "p_brand", "p_size"))
    s.delete("t", "p_size <= 10")
    s.compact("t", 2)
    s.expire("t", 1)
    return s.read("t").select("p_partkey", "p_brand")


@query("SELECT n_nationkey AS k, n_name AS name, NULL::VARCHAR AS note FROM nation UNION ALL SELECT r_regionkey + 100, r_name, 'region' FROM region")
def schema_reconcile(spark, d):
    """A column that a later write adds is null in earlier rows."""
    s = _store(spark)
    s.write("t", table(spark, d, "nation").selectExpr("n_nationkey AS k", "n_name AS name"))
    s.write("t", table(spark, d, "region").selectExpr("r_regionkey + 100 AS k", "r_name AS name", "'region' AS note"), "append")
    return s.read("t").select("k", "name", "note")


# Increments -------------------------------------------------------------------------------------
_LEDGER = "led AS (SELECT DISTINCT rec_a_key AS record_key, rec_a_content_hash AS content_hash, model_version FROM match_scores UNION SELECT DISTINCT rec_b_key, rec_b_content_hash, model_version FROM match_scores)"


def _ledger(spark, d):
    m = table(spark, d, "match_scores")
    side = lambda s: m.select(F.col(f"rec_{s}_key").alias("record_key"), F.col(f"rec_{s}_content_hash").alias("content_hash"), "model_version")
    return side("a").unionByName(side("b")).distinct()


@query(f"WITH {STD}, {_LEDGER} SELECT record_key, content_hash FROM std WHERE NOT EXISTS (SELECT 1 FROM led WHERE led.record_key = std.record_key AND led.content_hash = std.content_hash AND model_version = 'm2')")
def delta_records(spark, d):
    return R.delta(C.std(spark, d), _ledger(spark, d), "m2").select("record_key", "content_hash")


@query(f"WITH {STD}, {_LEDGER} SELECT DISTINCT record_key FROM led WHERE record_key NOT IN (SELECT record_key FROM std)")
def departed_keys(spark, d):
    return R.departed(_ledger(spark, d), C.std(spark, d))


@query(f"WITH {STD}, {_LEDGER}, delta AS (SELECT record_key FROM std WHERE NOT EXISTS (SELECT 1 FROM led WHERE led.record_key = std.record_key AND led.content_hash = std.content_hash AND model_version = 'm2')) SELECT id, rec_a_key, rec_b_key FROM match_scores WHERE rec_a_key NOT IN (SELECT record_key FROM delta) AND rec_b_key NOT IN (SELECT record_key FROM delta)")
def scores_still_valid(spark, d):
    delta = cut(R.delta(C.std(spark, d), _ledger(spark, d), "m2").select("record_key"))
    return R.still_valid(table(spark, d, "match_scores"), delta).select("id", "rec_a_key", "rec_b_key")


_FRESH = "fresh AS (SELECT record_key FROM std WHERE NOT EXISTS (SELECT 1 FROM led WHERE led.record_key = std.record_key AND led.content_hash = std.content_hash AND model_version = 'm2')), touched AS (SELECT record_key FROM fresh UNION SELECT record_key FROM led WHERE record_key NOT IN (SELECT record_key FROM std))"


@query(f"WITH {STD}, {_LEDGER}, {_FRESH}, {C.pairs_sql()}, {C.weights_sql()} SELECT rec_a_key, rec_b_key, round(match_probability, 6) AS p FROM match_scores WHERE rec_a_key NOT IN (SELECT record_key FROM touched) AND rec_b_key NOT IN (SELECT record_key FROM touched) UNION ALL SELECT record_key_l, record_key_r, match_probability FROM scored WHERE record_key_l IN (SELECT record_key FROM fresh) OR record_key_r IN (SELECT record_key FROM fresh)")
def rescored(spark, d):
    """Scores after a delivery: new and changed records against all others and each other, the rest as they were."""
    s = C.std(spark, d).select(*C.PEOPLE, "content_hash")
    x = R.rescore(s, _ledger(spark, d), table(spark, d, "match_scores"), C.PLAIN, "m2")
    return x.select("rec_a_key", "rec_b_key", F.round("match_probability", 6).alias("p"))


@query("SELECT model_version, is_active AND model_version = 'm2' AS active, count(*) AS n FROM match_scores GROUP BY 1, 2")
def models_retired(spark, d):
    return R.retired_models(table(spark, d, "match_scores"), "m2").groupBy("model_version", F.col("is_active").alias("active")).agg(F.count(F.lit(1)).alias("n"))


_UP = "up AS (SELECT rec_a_key, rec_b_key, model_version, match_probability AS p, 'new' AS origin FROM match_scores WHERE run_id > 'run-5' QUALIFY row_number() OVER (PARTITION BY rec_a_key, rec_b_key, model_version ORDER BY scored_at DESC, id DESC) = 1), base AS (SELECT rec_a_key, rec_b_key, model_version, match_probability AS p, 'old' AS origin FROM match_scores WHERE run_id <= 'run-5' QUALIFY row_number() OVER (PARTITION BY rec_a_key, rec_b_key, model_version ORDER BY scored_at DESC, id DESC) = 1)"


@query(f"WITH {_UP} SELECT * FROM up UNION ALL SELECT b.* FROM base b ANTI JOIN up USING (rec_a_key, rec_b_key, model_version)")
def score_upsert(spark, d):
    key = ["rec_a_key", "rec_b_key", "model_version"]
    m = table(spark, d, "match_scores")
    part = lambda c, o: S.latest(m.filter(c), key, [F.desc("scored_at"), F.desc("id")]).select(*key, F.col("match_probability").alias("p"), F.lit(o).alias("origin"))
    return I.merge(part("run_id <= 'run-5'", "old"), part("run_id > 'run-5'", "new"), key)


_GRAY = "SELECT rec_a_key, rec_b_key, max(match_probability) AS p FROM match_scores WHERE is_active AND run_id {0} GROUP BY 1, 2 HAVING max(match_probability) >= 0.6 AND max(match_probability) < 0.95"


@query(f"WITH old AS ({_GRAY.format("<= 'run-5'")}), new AS ({_GRAY.format("> 'run-5'")}) SELECT coalesce(n.rec_a_key, o.rec_a_key) AS rec_a_key, coalesce(n.rec_b_key, o.rec_b_key) AS rec_b_key, 'gray_band' AS reason, coalesce(n.p, o.p) AS p, CASE WHEN o.rec_a_key IS NOT NULL THEN 'resolved' ELSE 'open' END AS status FROM old o FULL JOIN new n ON o.rec_a_key = n.rec_a_key AND o.rec_b_key = n.rec_b_key")
def review_upsert(spark, d):
    """Reviews of pairs between the thresholds, merged into those there are: a pair keeps its status, its probability is renewed."""
    m = table(spark, d, "match_scores")
    gray = lambda c: I.gray_band(m.filter(c), 0.6, 0.95)
    s = _store(spark)
    s.write("reviews", gray("run_id <= 'run-5'").withColumn("status", F.lit("resolved")), bucket_by=["rec_a_key", "rec_b_key", "reason"])
    I.upsert_reviews(s, "reviews", gray("run_id > 'run-5'"))
    return s.read("reviews").select("rec_a_key", "rec_b_key", "reason", "p", "status")


@query(f"WITH {STD}, {_LEDGER} SELECT record_key, content_hash, model_version FROM led WHERE record_key IN (SELECT record_key FROM std) AND model_version = 'm2'")
def ledger_prune(spark, d):
    """The ledger of what models scored, without records that are gone and models that are retired."""
    s = _store(spark)
    s.write("ledger", _ledger(spark, d), bucket_by=["record_key", "model_version"])
    I.prune_ledger(s, "ledger", C.std(spark, d), ["m2"])
    return s.read("ledger")


@query(f"WITH {STD}, {_LEDGER} SELECT record_key, 'm2' AS model_version, content_hash FROM std UNION ALL SELECT record_key, 'm2', max(content_hash) FROM led WHERE model_version = 'm2' AND record_key NOT IN (SELECT record_key FROM std) GROUP BY 1")
def ledger_sync(spark, d):
    """After a scoring run each live record stands in the ledger once for the model, with its present content."""
    s = _store(spark)
    led = _ledger(spark, d).filter("model_version = 'm2'").groupBy("record_key", "model_version").agg(F.max("content_hash").alias("content_hash"))
    s.write("ledger", led, bucket_by=["record_key", "model_version"])
    R.sync_ledger(s, "ledger", C.std(spark, d), "m2")
    return s.read("ledger").select("record_key", "model_version", "content_hash")


# Read paths -------------------------------------------------------------------------------------
@query(f"WITH {STD}, {MEMBERS}, g AS (SELECT entity_id, count(*) AS n, string_agg(record_key, ',' ORDER BY record_key) AS members FROM mem GROUP BY 1), l AS (SELECT entity_id, count(DISTINCT attribute) AS attributes FROM golden_lineage GROUP BY 1) SELECT entity_id, n, members, coalesce(attributes, 0) AS attributes FROM g LEFT JOIN l USING (entity_id)")
def entity_detail(spark, d):
    g = C.membership(spark, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("record_key")), ",").alias("members"))
    lines = table(spark, d, "golden_lineage").groupBy("entity_id").agg(F.countDistinct("attribute").alias("attributes"))
    return g.join(lines, "entity_id", "left").select("entity_id", "n", "members", F.coalesce("attributes", F.lit(0)).alias("attributes"))


@query("SELECT id, rec_a_key, rec_b_key, match_probability FROM match_scores WHERE is_active AND match_probability BETWEEN 0.6 AND 0.95 AND (rec_a_key, rec_b_key, id) > ('crm', '', '') ORDER BY rec_a_key, rec_b_key, id LIMIT 50")
def score_page(spark, d):
    """A page of active scores by keyset: the keys after the last one seen."""
    s = table(spark, d, "match_scores").filter("is_active AND match_probability BETWEEN 0.6 AND 0.95 AND struct(rec_a_key, rec_b_key, id) > struct('crm', '', '')")
    return s.select("id", "rec_a_key", "rec_b_key", "match_probability").orderBy("rec_a_key", "rec_b_key", "id").limit(50)


@query(f"WITH {MEMBERS}, p AS (SELECT DISTINCT rec_a_key, rec_b_key FROM match_scores WHERE is_active AND match_probability BETWEEN 0.6 AND 0.95), e AS (SELECT rec_a_key, rec_b_key, entity_id FROM p JOIN mem ON record_key IN (rec_a_key, rec_b_key)) SELECT DISTINCT rec_a_key, rec_b_key, m.record_key FROM e JOIN mem m USING (entity_id)")
def merge_group(spark, d):
    """All members of the entities on either side of a pair under review."""
    p = table(spark, d, "match_scores").filter("is_active AND match_probability BETWEEN 0.6 AND 0.95").select("rec_a_key", "rec_b_key").distinct()
    m = C.membership(spark, d).select("record_key", "entity_id")
    ends = p.select("*", F.explode(F.array("rec_a_key", "rec_b_key")).alias("record_key")).join(m, "record_key").select("rec_a_key", "rec_b_key", "entity_id")
    return ends.join(m, "entity_id").select("rec_a_key", "rec_b_key", "record_key").distinct()


@query(f"WITH {_CUR} SELECT source_system || ':' || source_record_id AS record_key, content_hash FROM cur WHERE NOT coalesce(is_deleted, false) AND source_system || ':' || source_record_id IN (SELECT rec_a_key FROM match_scores)")
def records_by_key(spark, d):
    cur = S.supersede(table(spark, d, "raw_records_golden")).select(F.concat("source_system", F.lit(":"), "source_record_id").alias("record_key"), "content_hash")
    return cur.join(table(spark, d, "match_scores").select(F.col("rec_a_key").alias("record_key")).distinct(), "record_key", "left_semi")
