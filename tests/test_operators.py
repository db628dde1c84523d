"""Operators against small cases and brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.functions import address as A
from kinweave.functions import kernels as K
from kinweave.functions import values as V
from kinweave.operators import comparators as C
from kinweave.operators import drift as D
from kinweave.operators import graph as G
from kinweave.operators import identity as I
from kinweave.operators import linkage as L
from kinweave.operators import records as R
from kinweave.operators import training as T
from kinweave.sources.readers import read_any, read_csv, write_csv
from kinweave.sources.store import Store


@pytest.mark.parametrize(
    "line, want",
    [
        ("12/2871 Eskan Rd", ("2871", "eskan", "road", None, "12")),
        ("Zimo Dr 4282", ("4282", "zimo", "drive", None, None)),
        ("7496 W. Yoro Boulevard Unit 2-b", ("7496", "yoro", "boulevard", "west", "2b")),
        ("c/o front desk, #5A, 29 Juni Lane, Eastry", ("29", "juni", "lane", None, "5a")),
        ("169 Tenth Kala Pl", ("169", "10th kala", "place", None, None)),
        ("P.O. Box 674", (None, None, None, None, None)),
        (None, (None, None, None, None, None)),
        ("", (None, None, None, None, None)),
    ],
)
def test_address(line, want):
    a = A.parse(line, A.Towns({"eastry"}))
    assert (a.number, a.street, a.kind, a.direction, a.unit) == want


def test_address_long_text():
    assert A.parse("9 " + "x" * 200_000 + " St").number == "9"
    assert A.slips("a" * 100_000 + "bc", "a" * 100_000 + "cb") == 1


def test_slips_is_edit_distance():
    def full(a, b):
        d = {(-1, -1): 0}
        for i in range(len(a)):
            d[i, -1] = i + 1
        for j in range(len(b)):
            d[-1, j] = j + 1
        for i, j in itertools.product(range(len(a)), range(len(b))):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a) - 1, len(b) - 1]

    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in "ab")
        assert A.slips(a, b, 2) == min(full(a, b), 3), (a, b)


def test_values():
    assert V.phone("1-212-555-1267") == "2125551267" and V.phone("000.000.0000") is None and V.phone("") is None
    assert V.email(" A@B.Example ") == "a@b.example" and V.email("nobody@example.com") is None
    assert V.birth("20 May 1958") == V.birth("05/20/1958") == V.birth("1958-05-20") == "1958-05-20"
    assert V.birth("1900-01-01") is None and V.birth("soon") is None


def test_kernels():
    col = pa.array(["Abc, abc déf", None, "", "x-y " * 3])
    h, a, b, row = K.words(col)
    assert list(np.bincount(row, minlength=4)) == [3, 0, 0, 6]
    assert h[0] == h[1] != h[2]
    s, at = K.shingles(h, row, 3)
    assert len(s) == 1 + 4 and s[1] == s[3]
    g, starts = K.gram_hashes(pa.array(["abab", "a"]), 2)
    assert list(np.diff(starts)) == [3, 0] and g[0] == g[2]


def test_minwise_estimates_jaccard():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(40)]
    texts = [w for w in words for w in (w, w[:30] + "".join(rng.choice("ijkl") for _ in range(10)))]
    h, st = K.gram_hashes(pa.array(texts), 2)
    sig = K.minwise(h, st, 256)
    for i in range(0, len(texts), 2):
        x, y = (set(h[st[k] : st[k + 1]].tolist()) for k in (i, i + 1))
        assert abs((sig[i] == sig[i + 1]).mean() - len(x & y) / len(x | y)) < 0.12


def test_jaro_winkler_of_many():
    import random as rnd

    import pyarrow as pa

    from kinweave.functions import kernels as K

    g = rnd.Random(4)
    word = lambda n: "".join(g.choice("abcdeé") for _ in range(n))
    pairs = [(word(g.randrange(14)), word(g.randrange(14))) for _ in range(3000)] + [(word(g.randrange(55, 90)), word(g.randrange(55, 90))) for _ in range(60)]
    pairs += [(w, w[: len(w) // 2] + w[len(w) // 2 :][::-1]) for w, _ in pairs[:300]]
    got = K.jaro_winkler(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]), C.jaro_winkler, 500)
    assert all(abs(x - C.jaro_winkler(a, b)) < 1e-12 for x, (a, b) in zip(got, pairs))
    assert len(K.jaro_winkler(pa.array([], pa.string()), pa.array([], pa.string()), C.jaro_winkler)) == 0


def test_levenshtein_counts_bytes(spark):
    df = spark.createDataFrame([("é", "e"), ("cat", "cut"), (None, "x")], "a string, b string")
    got = df.select(C.predicate("levenshtein:1")(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [False, True, None]


def test_jaro_winkler():
    assert C.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert C.jaro_winkler("", "a") == 0 and C.jaro_winkler("abc", "abc") == 1


def test_unknown_comparator():
    with pytest.raises(ValueError):
        C.predicate("nearly")
    C.register("always", lambda a, b: F.lit(True))
    assert C.predicate("always")


def test_model_round_trip():
    m = L.Model.from_json('{"uid": "id", "rules": [{"keys": ["a"]}], "comparisons": [{"column": "a", "levels": [{"token": "exact", "m": 0.9, "u": 0.1}]}], "owner": "us"}')
    assert L.Model.from_json(m.to_json()) == m and '"owner": "us"' in m.to_json()


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randint(0, 300):03d}", f"n{rng.randint(0, 300):03d}") for _ in range(200)] + [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(120)] + [("h", f"h{i}") for i in range(80)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.cluster for r in G.components(spark.createDataFrame([*edges, (None, "x")], "a string, b string")).collect()}
    assert got == {n: find(n) for n in parent}
    assert G.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_bridges_by_tour_and_by_search(spark):
    import random as rnd

    g = rnd.Random(12)
    edges = {(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)}  # a chain
    edges |= {tuple(sorted((f"r{g.randrange(40)}", f"r{g.randrange(40)}"))) for _ in range(45)} | {("hub", f"s{i}") for i in range(30)} | {("s1", "s2"), ("c010", "c020")}
    edges = sorted(e for e in edges if e[0] != e[1])
    df = spark.createDataFrame(edges + edges[:5], "a string, b string")
    cl = G.components(df)
    want = set(G._bridges([a for a, _ in edges], [b for _, b in edges]))
    assert len(want) > 60
    assert {tuple(r) for r in G.bridges(df, cl).collect()} == want
    assert {tuple(r) for r in G.bridges(df, cl, most_edges=3).collect()} == want
    none = spark.createDataFrame([], "a string, b string")
    assert G.bridges(none, G.components(none)).count() == 0


def test_bridges(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d")], "a string, b string")
    assert {tuple(r) for r in G.bridges(e, G.components(e)).collect()} == {("c", "d")}


def test_never_cuts(spark):
    e = spark.createDataFrame([("a", "b", 0.9, False), ("b", "c", 0.8, False), ("c", "d", 0.99, True)], "a string, b string, p double, protected boolean")
    n = spark.createDataFrame([("a", "c"), ("c", "d"), ("x", "y")], "a string, b string")
    assert {tuple(r) for r in I.never_cuts(e, n).collect()} == {("b", "c", "cut"), ("c", "d", "unsatisfiable")}


def test_redirect_circle(spark):
    r = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "entity_id string, merged_into string")
    assert {tuple(x) for x in I.resolved(r).collect()} == {("a", "c"), ("b", "c"), ("x", None), ("y", None)}


@pytest.mark.parametrize("hops", [2, 32])
def test_redirects_against_walks(spark, hops):
    """Trees, chains and circles, redirects told twice; an end 2^hops away is found, one further on isn't."""
    rng = random.Random(5)
    to = {i: rng.randrange(400) for i in range(300)} | {i: i // 2 for i in range(1000, 1200)} | {i: i + 1 for i in range(2000, 2040)} | {3000: 3001, 3001: 3002, 3002: 3000, 3003: 3001}
    want = {}
    for e in to:
        at, n = to[e], 1
        while at in to and n < 2 ** min(hops, 12):
            at, n = to[at], n + 1
        want[e] = None if at in to else at
    df = spark.createDataFrame([*to.items(), *to.items(), (5000, None)], "entity_id long, merged_into long")
    assert sorted(tuple(r) for r in I.resolved(df, hops).collect()) == sorted(want.items())


def test_redirects_are_not_broadcast(spark):
    """The files of rows numbered in order are small beside the rows: none may go through the driver whole."""
    limit = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "64k")
    try:
        got = I.resolved(spark.range(1, 20_001).selectExpr("id AS entity_id", "id div 2 AS merged_into"))
        assert got.agg(F.count("entity_id"), F.max("target")).first() == (20_000, 0)
    finally:
        spark.conf.set(limit, before)


def test_em_finds_the_two_classes():
    rng = np.random.default_rng(1)
    m, u, lam = [0.95, 0.9, 0.85], [0.1, 0.05, 0.2], 0.2
    match = rng.random(20000) < lam
    g = np.stack([np.where(match, rng.random(20000) < a, rng.random(20000) < b) for a, b in zip(m, u)], 1).astype(int)
    pats, n = np.unique(g, axis=0, return_counts=True)
    model = L.Model("id", (), tuple(L.Comparison(f"c{i}", (L.Level("exact", 0.8, 0.2),), 0.2, 0.8) for i in range(3)), 0.1)
    got = T.em(pats, n.astype(float), model, rounds=500, tolerance=1e-7)
    assert got["prior"] == pytest.approx(lam, abs=0.02)
    for i in range(3):
        assert got["levels"][f"c{i}"][0][1] == pytest.approx(m[i], abs=0.03)


def test_cartesian_is_refused(spark):
    df = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(ValueError):
        L.block(df, L.Model("id", (L.Rule(()),), ()))


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    v1 = s.write("t", spark.range(3))
    s.write("t", spark.range(3, 5), "append")
    s.merge("t", spark.range(4, 7), ["id"])
    assert s.read("t", v1).count() == 3 and s.read("t").count() == 7
    s.expire("t", 1)
    assert [v["version"] for v in s.versions("t")] == [3] and s.read("t").count() == 7
    with pytest.raises(ValueError):
        s.read("t", v1)


def test_csv(spark, tmp_path):
    p = str(tmp_path / "x.csv")
    write_csv(spark.createDataFrame([(1, "2020-01-02", 1.5)], "a int, d string, x double"), p)
    assert dict(read_csv(spark, p).dtypes) == {"a": "bigint", "d": "string", "x": "double"}
    assert read_any(spark, p).first().d == "2020-01-02"


def test_stream_merge_is_idempotent(spark, tmp_path):
    from kinweave.streaming.incremental import deliver

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.parquet(src)
    spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string").write.mode("append").parquet(src)
    s = Store(spark, f"file://{tmp_path}/store")
    q = deliver(spark.readStream.schema("id int, v string").option("maxFilesPerTrigger", 1).parquet(src), s, "t", ["id"], str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(r.id for r in s.read("t").collect()) == [1, 2, 3]


RAW = "id string, source_system string, source_record_id string, payload string, is_deleted boolean, ingest_batch_id string, ingested_at timestamp_ntz, field string, type string"
RUNS = "subject string, ingest_batch_id string, snapshot long, type string"


def raw(spark, rows):
    return spark.createDataFrame([(str(i), "crm", str(i), p, d, b, None, "x", "y") for i, (b, p, d) in enumerate(rows)], RAW)


def test_drift(spark):
    name = lambda i: ["Ann", "Bob", "Cy", "Dee"][i % 4]
    rows = [("b1", f'{{"first_name": "{name(i)}", "zip": "1234{i}", "n": null}}', False) for i in range(4)]
    rows += [("b2", f'{{"given": "{name(i)}", "zip": 1234{i}, "vip": true, "n": null}}', False) for i in range(4)]
    rows += [("b2", None, True), ("b2", "not json", False), ("b1", '{"late": 1}', False)]
    runs = spark.createDataFrame([("raw", "b2", 9, "q"), ("raw", "b1", 3, "q"), ("raw", "b1", None, None), ("golden", None, 1, None)], RUNS)
    got = {(r.change_kind, r.old_field, r.new_field) for r in D.changes(raw(spark, rows), runs).collect()}
    assert got == {("renamed", "first_name", "given"), ("retyped", "zip", "zip"), ("added", "", "vip")}
    u = {r.id: r for r in D.unified(raw(spark, rows)).collect()}
    assert u["0"].given == u["4"].given == "Ann" and u["0"].postal == u["4"].postal == "12340"
    assert u["0"].postal_as.string == "12340" and u["4"].postal_as.number == "12340" and u["4"].postal_as.string is None
    assert u["4"].rest == {"vip": "true", "n": None} and u["8"].is_deleted and u["8"].given is None
    alt = {(r.field, r.type): r.n_values for r in D.alternatives(raw(spark, rows), runs).collect()}
    assert alt["zip", "string"] == 4 and alt["zip", "number"] == 4 and ("n", "string") not in alt


def test_nested_schemas_and_followed_names(spark):
    rows = [("b1", f'{{"first_name": "Ann{i}", "tel": {{"kind": "home", "no": {i}}}, "tags": ["a", 1]}}', False) for i in range(6)]
    rows += [("b2", f'{{"zz9": "Ann{i}", "tel": {{"kind": "home", "no": "{i}"}}, "tags": []}}', False) for i in range(6)]
    runs = spark.createDataFrame([("raw", "b1", 1, "q"), ("raw", "b2", 2, "q")], RUNS)
    got = {(r.field, r.type): (r.n_values, r.alternatives) for r in D.tagged_union(raw(spark, rows)).collect()}
    assert got[("tel.no", "number")] == (6, 2) and got[("tel.no", "string")] == (6, 2) and got[("tags[]", "string")] == (6, 2) and got[("tags", "array")] == (12, 1)
    u = {r.id: r for r in D.unified(raw(spark, rows), runs).collect()}
    assert u["0"].given == u["6"].given == "Ann0" and "zz9" not in u["6"].rest and D.unified(raw(spark, rows)).filter("given IS NULL").count() == 6


def test_drift_empty(spark):
    runs = spark.createDataFrame([], RUNS)
    assert D.changes(raw(spark, []), runs).count() == 0 and D.unified(raw(spark, [])).count() == 0 and D.alternatives(raw(spark, []), runs).count() == 0


def test_fused_schemas_equal_the_whole(spark, sf):
    df = spark.read.parquet(f"{sf}/raw_records_golden.parquet")
    f = D.fuse(D.file_schemas(df), "source_system")
    whole = D.entries(df).groupBy("source_system", "field").agg(F.count(F.lit(1)).alias("rows"))
    assert {tuple(r) for r in f.select("source_system", "field", "rows").collect()} == {tuple(r) for r in whole.collect()}


def test_field_names():
    assert [R.attribute_of(x) for x in ("last_modified", "addr_line_1", "mail_address", "daytime_phone", "order_count")] == [None, "street", "email", "phone", None]


def test_fingerprint():
    from kinweave.plans.pipeline import Fingerprint, config_hash

    assert config_hash({"a": 1, "b": [2]}) == config_hash({"b": [2], "a": 1}) != config_hash({"a": 2, "b": [2]})
    f = Fingerprint(*"abcdef")
    assert f.verdict(f) == "proceed" and f.verdict(Fingerprint(*"xbcdef")) == "full" and f.verdict(Fingerprint(*"abcdxf")) == "reassemble" and f.verdict(Fingerprint(*"abcdex")) == "refuse"


def test_chunks_and_increments_equal_the_whole(spark, sf):
    from kinweave.plans import common as P

    df = P.people(spark, sf)
    pairs = lambda x: sorted((r.record_key_l, r.record_key_r) for r in x.select("record_key_l", "record_key_r").collect())
    whole = pairs(L.predict(df, P.PLAIN))
    assert pairs(L.predict_chunked(df, P.PLAIN, 3)) == whole
    old, new = df.filter("source_system = 'crm'"), df.filter("source_system <> 'crm'")
    parts = [tuple(sorted(p)) for x in (L.predict(old, P.PLAIN), L.predict(new, P.PLAIN), L.predict_between(old, new, P.PLAIN)) for p in pairs(x)]
    assert sorted(parts) == whole


def test_u_full_takes_all_pairs_of_any_number_of_suppliers(spark, tmp_path):
    from kinweave.plans import linkage_queries as Q

    n = 4_600  # more pairs than 1e7
    spark.range(n).selectExpr("id AS s_suppkey", "id % 25 AS s_nationkey", "cast(id AS double) AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r.comparison, r.gamma): r.n for r in Q.u_full(spark, str(tmp_path)).collect()}
    assert sum(v for (c, _), v in got.items() if c == "s_nationkey") == n * (n - 1) // 2
    assert got["s_nationkey", 1] == 25 * 184 * 183 // 2 and got["s_acctbal", 2] == sum(n - k for k in range(1, 101))


def test_renames_of_a_long_chain_of_preferences(spark):
    likes = [("crm", 1, f"o{i}", f"n{i - k}", 0.99 - 0.02 * i + 0.01 * k) for i in range(1, 7) for k in (0, 1) if i > k]
    got = D.renames(spark.createDataFrame(likes, "source_system string, seq int, old_field string, new_field string, like double"))
    assert {(r.old_field, r.new_field) for r in got.collect()} == {(f"o{i}", f"n{i}") for i in range(1, 7)}


# Compiled models and what conditions say --------------------------------------------------------
def test_weights_to_probabilities():
    from kinweave.operators import compile as M

    for bits in (20.0, 10.0, 0.0, -3.0):
        m, u = M.probabilities(bits)
        assert 0 < m < 1 and 0 < u < 1 and abs(L.bits(m, u) - bits) < 1e-9
    assert M.weights({"a": M.Field(("exact",)), "b": M.Field(("exact",))}) == {"a": 50.0, "b": 50.0}
    for bad in ({"a": M.Field(("exact",), 50.0), "b": M.Field(("exact",))}, {"a": M.Field(("exact",), 150.0)}, {"a": M.Field(("exact",), 60.0), "b": M.Field(("exact",), 60.0)}):
        with pytest.raises(ValueError):
            M.weights(bad)


def test_compiled_levels(spark):
    from kinweave.operators import compile as M

    fields = {"name": M.Field(("exact", "first_n:2"), 60.0), "mail": M.Field(("exact",), 40.0, blank="both"), }
    model = M.compiled("id", [L.Rule(("k",))], fields)
    name, mail = model.comparisons
    assert [round(L.bits(x.m, x.u), 6) for x in name.levels] == [36.0, 18.0] and round(L.bits(name.m_else, name.u_else), 6) == -7.2
    assert [x.token for x in mail.levels] == ["blank:both", "exact"] and round(L.bits(mail.levels[0].m, mail.levels[0].u), 6) == 20.0
    df = spark.createDataFrame([(1, "k", "anna", None), (2, "k", "anne", None), (3, "k", None, "x")], "id int, k string, name string, mail string")
    got = {(r.id_l, r.id_r): (r.gamma_name, r.gamma_mail) for r in L.predict(df, model).collect()}
    assert got == {(1, 2): (1, 2), (1, 3): (-1, -1), (2, 3): (-1, -1)}
    assert L.Model.from_json(model.to_json()) == model
    with pytest.raises(ValueError):
        M.comparison("g", M.Field(("variant_match",), attributes=("a", "b")), 50)
    with pytest.raises(ValueError):
        M.comparison("g", M.Field((), attributes=("a", "b")), 50)


def test_cross_field_group(spark):
    from kinweave.operators import compile as M

    model = M.compiled("id", [], {"phone": M.Field(("exact",), attributes=("home", "mobile")), "name": M.Field(("exact",))})
    df = spark.createDataFrame([(1, "5", None, "a"), (2, "7", "5", "a"), (3, "9", "9", "b"), (4, None, None, "a")], "id int, home string, mobile string, name string")
    got = {(r.id_l, r.id_r): r.gamma_phone for r in L.predict(df, model).collect()}
    assert got == {(1, 2): 1}


def test_conditions_are_read(spark):
    from kinweave.operators import compile as M

    assert M.exact_columns(spark, "a_l = a_r AND B_l = b_R") == ["a", "b"]
    assert M.exact_columns(spark, "a_l = b_r") is None and M.exact_columns(spark, "lower(a_l) = a_r") is None and M.exact_columns(spark, "ELSE") is None
    assert M.equi_columns(spark, "l.a = r.a AND l.b = r.b") == ["a", "b"]
    assert M.equi_columns(spark, "l.a = r.a AND l.c > 1") is None and M.equi_columns(spark, "l.a = r.b") is None
    assert M.columns_used(spark, "exists(tags_l, x -> x = name_r) AND substr(name_l, 1, 2) = 'ab'") == ["tags", "name"]
    r = M.rule(spark, "l.a = r.a AND length(l.b) > 2")
    assert r.keys == ("a",) and r.also == "((length(b_l) > 2))"


def test_training(spark):
    import random as rnd

    from kinweave.operators import training as T

    g = rnd.Random(3)
    rows = []
    for i in range(300):
        name, year, town = f"n{g.randrange(60)}", f"{g.randrange(30)}", f"t{g.randrange(8)}"
        rows.append((f"a{i}", name, year, town))
        rows.append((f"b{i}", name if g.random() < 0.9 else f"n{g.randrange(60)}", year if g.random() < 0.95 else "x", town))
    df = spark.createDataFrame(rows, "id string, name string, year string, town string")
    model = L.Model("id", (L.Rule(("name",)), L.Rule(("year",))), tuple(L.Comparison(c, (L.Level("exact"),)) for c in ("name", "year", "town")), 0.001)
    labels = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(0, 300, 3)], "id_l string, id_r string")
    assert T.starting_prior(model, ["name"]) > model.prior
    got, sessions = T.train(df, model, [L.Rule(("name", "year", "town"))], 0.8, [L.Rule(("name",)), L.Rule(("year",))], labels=labels)
    by = {c.column: c for c in got.comparisons}
    assert len(sessions) == 2 and 0 < got.prior < 0.05
    assert abs(by["name"].levels[0].m - 0.9) < 0.06 and by["name"].levels[0].u < 0.05 and abs(by["town"].levels[0].u - 1 / 8) < 0.05
    assert T.full_agreement_bits(got) > 8


# Store -------------------------------------------------------------------------------------------
def test_two_writers_and_orphans(spark, tmp_path):
    from kinweave.sources.manifest import Conflict

    s = Store(spark, f"file://{tmp_path}")
    s.write("t", spark.range(4), bucket_by=["id"], buckets=4)
    at, have = s._manifests("t").last()
    s.write("t", spark.range(4, 6), "append")
    with pytest.raises(Conflict):  # built on a state that is gone
        s._manifests("t").commit(at, have)
    s._write("t", spark.range(9), (), (), 1)  # a writer that died before its commit
    assert len(s.clean("t")) == 1 and s.read("t").count() == 6
    before = {tuple(f) for f in s.versions("t")[-1]["folders"]}
    s.merge("t", spark.range(1), ["id"])
    after = {tuple(f) for f in s.versions("t")[-1]["folders"]}
    assert before & after and s.read("t").count() == 6  # only one bucket is written again
    s.expire("t", 1)
    assert s.read("t").count() == 6


def test_late_rows_replace_nothing_newer(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    at = lambda rows: spark.createDataFrame(rows, "id int, ingested_at int, v string")
    s.merge("t", at([(1, 5, "new"), (1, 3, "mid"), (None, 1, "n")]), ["id"], ["ingested_at"])
    s.merge("t", at([(1, 4, "late"), (2, 1, "other")]), ["id"], ["ingested_at"])
    assert {(r.id, r.v) for r in s.read("t").collect()} == {(1, "new"), (2, "other"), (None, "n")}


def test_standardizers_follow_the_contract(spark):
    from kinweave.operators import standardize as S

    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)).select(c).first()[0]
    c = F.col("x")
    for x in ("n/a", "-", "Unknown", " NULL "):
        assert one(S.phone_e164(c)[1], x=x) is None
    assert one(S.phone_e164(c)[0], x="(212) 555-0101") == "+12125550101" and one(S.phone_e164(c, "GB")[0], x="2125550101") is None
    assert one(S.lowercase_trim(c), x="  É ") == "é" and one(S.name_norm(c), x="O’Neil-Smith\tJr.") == "oneil smith jr"
    unit = lambda x: one(F.struct(*(v.alias(k) for k, v in S.address_parse(c).items())), x=x)
    assert tuple(unit("12 Main St. Apartment 4B")) == ("12", "main st", "apartment 4b") and tuple(unit("12 Main St Floor 3")) == ("12", "main st", "floor 3")
    assert tuple(unit("P.O. Box 12")) == (None, None, None) and tuple(unit("5th Ave")) == (None, "5th ave", None)
    assert one(S.company_name_norm(c), x="Müller-Söhne & Co. LLP") == "muller sohne co" and one(S.domain_norm(c), x="https://www.a.example./x?y") == "a.example"
    assert one(S.parse_date(c, "%-d.%-m.%Y").cast("string"), x="3.2.1980") == "1980-02-03" and one(S.parse_date(c, "%Y").cast("string"), x="1980") is None
    assert one(S.email_norm(c, placeholders=["a@b.example"])[1], x="A@b.example") is None and one(S.email_norm(c)[1], x="a b@c") is False
