"""Schemas that drift between files (problem 2).

Tagged-union inference: every delivered file is reduced to a schema in which each path keeps all
the types it was seen with and how often (``file_schemas``, and with the inside of objects and lists
``path_schemas``). Such schemas fuse by adding their counts, so they can be built per file, in parallel,
and merged in any order (``fuse``; ``tagged_union`` is the fused schema of each source). A path with
more than one type becomes a struct of typed branches beside its canonical conversion
(``unified``, which also follows the renames found); types that appear later are reported
(``alternatives``), and so is each field added, removed, renamed or retyped from one batch to the next (``changes``).

Defined results: an empty table gives empty results; rows with a null or unreadable payload and
deleted rows count for nothing; a field that is null wherever it is present has no type, so it is
never retyped; equal counts of two types resolve to the first in TYPE_ORDER; repeated rows count
as often as they occur; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions import text as X
from kinweave.operators import records as R
from kinweave.session import cut

TYPE_ORDER = ["string", "number", "boolean", "array", "object"]
#: A removed and an added field are one renamed field from this likeness of content on.
RENAME_LIKENESS = 0.55


def _tag(v: Column) -> Column:
    """JSON type of a variant."""
    s = F.schema_of_variant(v)
    return (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean")
        .when(s.isNull() | (s == "VOID"), "null").otherwise("number")
    )


def _exploded(rows: DataFrame, v: str, *keep: str) -> DataFrame:
    """``keep`` with the key (null in a list) and value of each entry of the variant column ``v``."""
    spark = rows.sparkSession
    name = f"__kinweave_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(name)
    try:
        return spark.sql(f"SELECT {', '.join(f'p.{k}' for k in keep)}, e.key AS key, e.value AS value FROM {name} p, LATERAL variant_explode(p.{v}) AS e")
    finally:
        spark.catalog.dropTempView(name)


def entries(raw: DataFrame) -> DataFrame:
    """(source_system, ingest_batch_id, field, tag, leaf): each field of each non-deleted row.

    leaf: the value without its wrapping, as text.
    """
    rows = R.live(raw).select("source_system", "ingest_batch_id", F.try_parse_json("payload").alias("v")).filter(F.col("v").isNotNull())
    flat = _exploded(rows, "v", "source_system", "ingest_batch_id").withColumnRenamed("key", "field").filter("field IS NOT NULL")
    tag = _tag(F.col("value"))
    inner = F.coalesce(*(F.try_variant_get("value", f"$.{k}", "string") for k in R.INNER_KEYS))
    leaf = F.when(tag == "object", inner).when(tag == "array", F.try_variant_get("value", "$[0]", "string")).otherwise(F.try_variant_get("value", "$", "string"))
    return flat.select("source_system", "ingest_batch_id", "field", tag.alias("tag"), leaf.alias("leaf"))


def path_schemas(raw: DataFrame) -> DataFrame:
    """The tagged-union schema of each (source, batch) down to the leaves: ``field`` is a path, ``a.b`` for a key of
    an object and ``a[]`` for the elements of a list, with the rows and the count of each type. One pass for each level of nesting."""
    keep = ["source_system", "ingest_batch_id"]
    level = R.live(raw).select(*keep, F.lit("").alias("path"), F.try_parse_json("payload").alias("v")).filter("v IS NOT NULL")
    out = None
    while True:
        here = _exploded(level, "v", *keep, "path")
        path = F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key"))
        here = cut(here.select(*keep, path.alias("path"), _tag(F.col("value")).alias("tag"), F.to_json("value").alias("text")))
        counts = [F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in [*TYPE_ORDER, "null"]]
        told = here.groupBy(*keep, F.col("path").alias("field")).agg(F.count(F.lit(1)).alias("rows"), *counts)
        out = told if out is None else out.unionByName(told)
        inside = here.filter(F.col("tag").isin("object", "array"))
        if inside.isEmpty():
            return out
        level = inside.select(*keep, "path", F.try_parse_json("text").alias("v"))


def tagged_union(raw: DataFrame) -> DataFrame:
    """(source_system, field, type, n_values, alternatives): the fused schema of each source, a row for each
    type a path was seen with, and how many types it has."""
    fused = fuse(path_schemas(raw), "source_system")
    types = F.filter(F.array(*(F.struct(F.lit(t).alias("type"), F.col(f"n_{t}").alias("n")) for t in TYPE_ORDER)), lambda x: x["n"] > 0)
    each = fused.select("source_system", "field", types.alias("x"))
    return each.select("source_system", "field", F.size("x").alias("alternatives"), F.explode("x").alias("t")).select("source_system", "field", "t.type", F.col("t.n").alias("n_values"), "alternatives")


SHAPE = ["has_at", "len", "digits", "letters", "spaces", "marks", "starts_digit"]


def _content() -> list[Column]:
    """Sums over a field's filled values that describe its content; all of them add up."""
    leaf = X.present(F.col("leaf"))
    n = F.length(leaf)
    digits, letters = n - F.length(F.regexp_replace(leaf, "[0-9]", "")), n - F.length(F.regexp_replace(leaf, r"\p{L}", ""))
    spaces = n - F.length(F.replace(leaf, F.lit(" "), F.lit("")))
    shape = [leaf.contains("@").cast("int") * F.lit(20), n, digits, letters, spaces * 3, n - digits - letters - spaces, leaf.rlike("^[0-9]").cast("int") * 5]
    return [F.count(leaf).alias("filled"), *(F.sum(c).cast("double").alias(f"s_{name}") for name, c in zip(SHAPE, shape)), F.hll_sketch_agg(F.lower(leaf), F.lit(12)).alias("values")]


def file_schemas(raw: DataFrame) -> DataFrame:
    """The tagged-union schema of each (source, batch): a row for each field with its rows, the
    count of each type, and a sketch of the content. One pass, one partial aggregation."""
    e = entries(raw)
    counts = [F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in [*TYPE_ORDER, "null"]]
    return e.groupBy("source_system", "ingest_batch_id", "field").agg(F.count(F.lit(1)).alias("rows"), *counts, *_content())


def fuse(schemas: DataFrame, *keys: str) -> DataFrame:
    """Schemas of many files as one for each value of ``keys``: counts and sketches add up."""
    sums = [F.sum(c).alias(c) for c in schemas.columns if c.startswith(("n_", "s_")) or c in ("rows", "filled")]
    sketches = [F.hll_union_agg("values").alias("values")] if "values" in schemas.columns else []
    return schemas.groupBy(*keys, "field").agg(*sums, *sketches)


def _main_type() -> Column:
    most = F.greatest(*(F.col(f"n_{t}") for t in TYPE_ORDER))
    out = F.when(most == 0, None)
    for t in TYPE_ORDER:
        out = out.when(F.col(f"n_{t}") == most, t)
    return out


def batch_fields(raw: DataFrame, profile_runs: DataFrame, schemas: DataFrame) -> DataFrame:
    """Fields each batch has (most of its rows carry the key), with their type and the batch's place
    in its source's order. A batch without a raw run comes after all others, by its id."""
    sizes = R.live(raw).groupBy("source_system", "ingest_batch_id").agg(F.count(F.lit(1)).alias("batch_rows"))
    order = Window.partitionBy("source_system").orderBy(F.col("batch_no").asc_nulls_last(), "ingest_batch_id")
    seq = sizes.join(R.batch_order(profile_runs), "ingest_batch_id", "left").withColumn("seq", F.row_number().over(order))
    return (
        schemas.join(seq.select("source_system", "ingest_batch_id", "batch_rows", "seq"), ["source_system", "ingest_batch_id"])
        .filter(2 * F.col("rows") > F.col("batch_rows"))
        .withColumn("type", _main_type())
    )


def likeness() -> Column:
    """Likeness of the content of two fields (prefixes a_ and b_): how alike the mean shapes of the
    values are, raised where the values themselves recur."""
    mean = lambda p, s: F.col(f"{p}s_{s}") / F.greatest(F.col(f"{p}filled"), F.lit(1))
    near = F.lit(0.0)
    whole = F.lit(1e-9)
    for s in SHAPE:
        near += F.abs(mean("a_", s) - mean("b_", s))
        whole += mean("a_", s) + mean("b_", s)
    shape = 1 - near / whole
    na, nb = F.hll_sketch_estimate("a_values"), F.hll_sketch_estimate("b_values")
    both = na + nb - F.hll_sketch_estimate(F.hll_union("a_values", "b_values"))
    again = F.greatest(F.lit(0.0), F.least(F.lit(1.0), both / F.greatest(F.least(na, nb), F.lit(1))))
    # words without digits all have one shape: only recurring values tell a town from a surname
    wordy = (mean("a_", "digits") < 0.5) & (mean("a_", "has_at") < 1) & (mean("b_", "digits") < 0.5)
    filled = (F.col("a_filled") > 0) & (F.col("b_filled") > 0)
    return F.when(~filled, 0.0).when(wordy, 0.4 * shape + 0.6 * F.sqrt(again)).otherwise(0.85 * shape + 0.15 * F.sqrt(again))


def renames(pairs: DataFrame) -> DataFrame:
    """(source_system, seq, old_field, new_field): of ``pairs`` with their likeness those that are each other's
    best, then the best among what is left, until nothing is left. Ties go to the smaller name, so each round takes a pair."""
    renamed, rest = None, cut(pairs)
    while not rest.isEmpty():
        a = Window.partitionBy("source_system", "seq", "old_field").orderBy(F.desc("like"), "new_field")
        b = Window.partitionBy("source_system", "seq", "new_field").orderBy(F.desc("like"), "old_field")
        best = cut(rest.withColumn("ra", F.row_number().over(a)).withColumn("rb", F.row_number().over(b)).filter("ra = 1 AND rb = 1").select("source_system", "seq", "old_field", "new_field"))
        renamed = best if renamed is None else renamed.unionByName(best)
        rest = cut(
            rest.join(best.select("source_system", "seq", "old_field"), ["source_system", "seq", "old_field"], "left_anti").join(
                best.select("source_system", "seq", "new_field"), ["source_system", "seq", "new_field"], "left_anti"
            )
        )
    return renamed if renamed is not None else rest.select("source_system", "seq", "old_field", "new_field")


def changes(raw: DataFrame, profile_runs: DataFrame, likeness_at: float = RENAME_LIKENESS) -> DataFrame:
    """(source_system, ingest_batch_id, change_kind, old_field, new_field) of each batch against the
    one before it of the same source. A rename takes the removed and the added field most alike in
    content, each at most once; the rest are removals and additions."""
    have = cut(batch_fields(raw, profile_runs, file_schemas(raw)))  # a few rows for each batch: later steps are small
    batches = have.select("source_system", "ingest_batch_id", "seq").distinct()
    before = batches.select("source_system", (F.col("seq") + 1).alias("seq"))
    later = batches.join(before, ["source_system", "seq"]).select("source_system", "ingest_batch_id", "seq")
    cols = ["type", "filled", *(f"s_{s}" for s in SHAPE), "values"]
    new = have.join(later.drop("ingest_batch_id"), ["source_system", "seq"], "left_semi").select("source_system", "seq", "field", *(F.col(c).alias(f"b_{c}") for c in cols))
    old = have.select("source_system", (F.col("seq") + 1).alias("seq"), "field", *(F.col(c).alias(f"a_{c}") for c in cols)).join(later, ["source_system", "seq"], "left_semi")
    both = cut(old.join(new, ["source_system", "seq", "field"], "full").withColumn("in_old", F.col("a_filled").isNotNull()).withColumn("in_new", F.col("b_filled").isNotNull()))
    gone = both.filter(~F.col("in_new")).select("source_system", "seq", F.col("field").alias("old_field"), *(f"a_{c}" for c in cols))
    come = both.filter(~F.col("in_old")).select("source_system", "seq", F.col("field").alias("new_field"), *(f"b_{c}" for c in cols))
    pairs = gone.join(come, ["source_system", "seq"]).withColumn("like", likeness()).filter(F.col("like") >= likeness_at)
    pairs = pairs.select("source_system", "seq", "old_field", "new_field", "like")
    renamed = renames(pairs)
    say = lambda df, kind, o, n: df.select("source_system", "seq", F.lit(kind).alias("change_kind"), o.alias("old_field"), n.alias("new_field"))
    at = ["source_system", "seq"]
    out = (
        say(renamed, "renamed", F.col("old_field"), F.col("new_field"))
        .unionByName(say(gone.join(renamed, [*at, "old_field"], "left_anti"), "removed", F.col("old_field"), F.lit("")))
        .unionByName(say(come.join(renamed, [*at, "new_field"], "left_anti"), "added", F.lit(""), F.col("new_field")))
        .unionByName(say(both.filter("in_old AND in_new AND a_type IS NOT NULL AND b_type IS NOT NULL AND a_type <> b_type"), "retyped", F.col("field"), F.col("field")))
    )
    return out.join(later, at).select("source_system", "ingest_batch_id", "change_kind", "old_field", "new_field")


def alternatives(raw: DataFrame, profile_runs: DataFrame) -> DataFrame:
    """Each type a field was ever seen with: (source_system, field, type, first_batch, n_batches, n_values).
    More than one row for a field is a conflict that ``unified`` splits into branches."""
    schemas = file_schemas(raw).join(R.batch_order(profile_runs), "ingest_batch_id", "left")
    types = F.explode(F.array(*(F.struct(F.lit(t).alias("type"), F.col(f"n_{t}").alias("n")) for t in TYPE_ORDER)))
    return (
        schemas.select("source_system", "ingest_batch_id", "batch_no", "field", types.alias("x"))
        .filter("x.n > 0")
        .groupBy("source_system", "field", F.col("x.type").alias("type"))
        .agg(F.min_by("ingest_batch_id", F.struct(F.coalesce("batch_no", F.lit(2**62)), "ingest_batch_id")).alias("first_batch"), F.count(F.lit(1)).alias("n_batches"), F.sum("x.n").alias("n_values"))
    )


def followed(raw: DataFrame, profile_runs: DataFrame) -> dict[str, list[tuple[str, str]]]:
    """Attributes of fields whose names don't tell them, by (source, field): a field that was renamed from or to
    one of a known attribute has that attribute. Only renames come to the driver, a few for each batch."""
    told = changes(raw, profile_runs).filter("change_kind = 'renamed'").select("source_system", "old_field", "new_field").distinct().collect()
    known: dict[tuple[str, str], str] = {}
    more = True
    while more:
        more = False
        for s, old, new in sorted(told):
            for a, b in ((old, new), (new, old)):
                got = R.attribute_of(a) or known.get((s, a))
                if got and not R.attribute_of(b) and (s, b) not in known:
                    known[s, b] = got
                    more = True
    out: dict[str, list[tuple[str, str]]] = {}
    for (s, f), a in sorted(known.items()):
        out.setdefault(a, []).append((s, f))
    return out


def unified(raw: DataFrame, profile_runs: DataFrame | None = None) -> DataFrame:
    """All batches as one table: id, source_system, source_record_id, ingest_batch_id, is_deleted, and for each attribute
    its canonical text and, where payloads disagree on the type, the typed branches it came in
    (``<attribute>_as``: string, number, boolean, array, object; exactly one is filled). With ``profile_runs``
    fields that were renamed to or from one of the attribute count for it, whatever they are called. Fields
    without an attribute stay in ``rest`` as JSON text by name. Deleted rows keep their row with
    null attributes."""
    rows = raw.select("id", "source_system", "source_record_id", "ingest_batch_id", F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"), F.try_parse_json("payload").alias("v"), F.from_json("payload", "map<string,string>").alias("m"))
    fields: dict[str, list[tuple[str | None, str]]] = {a: [] for a in R.ATTRIBUTES}
    for f in R.payload_fields(R.live(raw)):
        fields[R.attribute_of(f)].append((None, f))  # type: ignore[index]
    for a, more in (followed(raw, profile_runs) if profile_runs is not None else {}).items():
        fields[a] += more
    out = [F.col(c) for c in ("id", "source_system", "source_record_id", "ingest_batch_id", "is_deleted")]
    for a, fs in fields.items():
        its = lambda sf, c: c if sf[0] is None else F.when(F.col("source_system") == sf[0], c)
        value = lambda sf: its(sf, F.col("m")[sf[1]])
        tagged = lambda sf: F.when(value(sf).isNotNull(), _tag(F.try_variant_get("v", f"$['{sf[1]}']", "variant")))
        none = F.lit(None).cast("string")
        text = F.coalesce(*(X.present(R.unwrapped(value(sf))) for sf in fs)) if fs else none
        tag = F.coalesce(*(tagged(sf) for sf in fs)) if fs else none
        whole = F.coalesce(*(value(sf) for sf in fs)) if fs else none
        branches = F.struct(*(F.when(tag == t, whole).alias(t) for t in TYPE_ORDER))
        out += [text.alias(a), branches.alias(f"{a}_as")]
    everywhere = [f for fs in fields.values() for s, f in fs if s is None]
    here = [F.concat(F.lit(s), F.lit("\x1f"), F.lit(f)) for fs in fields.values() for s, f in fs if s is not None]
    mine = lambda k: k.isin(everywhere) | (F.concat(F.col("source_system"), F.lit("\x1f"), k).isin(*here) if here else F.lit(False))
    return rows.select(*out, F.map_filter("m", lambda k, _: ~F.coalesce(mine(k), F.lit(False))).alias("rest"))
