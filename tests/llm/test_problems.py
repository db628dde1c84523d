"""Each operator against brute force, invariants and odd input."""

import itertools
import json
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from kinweave.functions import kernels as K
from kinweave.llm import components, history, leakage, matching, names, packing, person, places, spam, survivors
from kinweave.operators import records as R

RAW = "id string, source_system string, source_record_id string, payload string, is_deleted boolean, ingest_batch_id string, ingested_at timestamp_ntz, key string, batch_no string, content string, given int, band string"
RUNS = "subject string, ingest_batch_id string, snapshot long"
NAMES = {"crm": ("first_name", "last_name", "email_address", "phone", "street_address", "city", "state", "zip", "dob"), "billing": ("fname", "lname", "billing_email", "contact_phone", "addr1", "addr_city", "addr_state", "postal_code", "birth_date")}
ANN = ("Ann", "Stanmoor", "ann.stanmoor@post.example", "212-555-0101", "12 Oak St Apt 4", "Anwell", "XA", "10001", "1980-02-03")
BOB = ("Robert", "Penham", "rp77@post.example", "212-555-0102", "9 Elm Road", "Corfield", "XC", "16001", "1971-05-06")


def payload(source, values, **extra):
    return json.dumps({k: v for k, v in zip(NAMES[source], values) if v != "-absent-"} | extra)


def raw(spark, rows):
    """rows: (id, source, record id, payload, batch)."""
    return spark.createDataFrame([(i, s, r, p, False if p else True, b, None, "x", "y", "z", 1, "w") for i, s, r, p, b in rows], RAW)


def runs(spark, *batches):
    return spark.createDataFrame([("raw", b, n) for n, b in enumerate(batches)] + [("golden", None, 0), ("raw", None, 1)], RUNS)


def put(values, **new):
    keys = ("given", "family", "email", "phone", "street", "city", "state", "zip", "dob")
    return tuple(new.get(k, v) for k, v in zip(keys, values))


ROWS = [
    ("a1", "crm", "1", payload("crm", ANN), "b1"),
    ("a1", "crm", "1", payload("crm", ANN), "b1"),  # the row twice
    ("a2", "crm", "1", payload("crm", put(ANN, family="STANMOR", street="12 Oak Street, Apt. 4", phone="+12125550101", dob="03 Feb 1980")), "b2"),
    ("a3", "crm", "7", payload("crm", put(ANN, given="ánn", phone=2125550101)), "b3"),
    ("a4", "crm", "1", payload("crm", put(ANN, phone="212-555-0999")), "b3"),  # another phone
    ("a5", "crm", "1", payload("crm", put(ANN, email="unknown")), "b3"),  # a value lost
    ("a6", "crm", "1", payload("crm", put(ANN, email="n/a")), "b4"),  # blank for blank
    ("a7", "billing", "1", payload("billing", ANN), "b2"),  # another source
    ("a8", "crm", "2", None, "b2"),
    ("a9", "crm", "3", "not json", "b2"),
    ("b0", "crm", "4", "{}", "b2"),
    ("b1", "crm", "5", payload("crm", put(BOB, street="x" * 100_000)), "b1"),
    ("b2", "crm", "5", payload("crm", put(BOB, street="x" * 100_000)), "b2"),
    (None, None, None, None, None),
]
WANT = {("a2", "a1"), ("a3", "a1"), ("a6", "a5"), ("b2", "b1")}


def test_found(spark):
    got = {tuple(r) for r in history.found(raw(spark, ROWS), runs(spark, "b1", "b2", "b3", "b4")).collect()}
    assert got == WANT


def test_found_empty(spark):
    assert history.found(raw(spark, []), runs(spark)).count() == 0


@pytest.mark.parametrize("options", [{}, {"hot": 0}, {"bucket_rows": 1, "most_runs": 2}])
def test_index_batch_by_batch(spark, tmp_path, options):
    order = R.batch_order(runs(spark, "b1", "b2", "b3", "b4"))
    got = set()
    for b in ("b1", "b2", "b2", "b3", "b4"):  # one batch is delivered again
        index = history.HistoryIndex(spark, f"file://{tmp_path}/index", **options)
        got |= {tuple(r) for r in index.accept(raw(spark, [r for r in ROWS if r[4] == b]), order, b).collect()}
        index.close()  # the next batch finds the runs by the manifest
    assert got == WANT
    if options.get("hot") != 0:
        assert sum(r["rows"] for r in index.manifests.last()[1]) == 6


def test_index_equals_brute_force(spark):
    """Contents that agree in what must agree, compared in pairs; a hot group and slips throughout."""
    rng = random.Random(7)
    slip = lambda w: w[: (k := rng.randrange(1, len(w)))] + rng.choice("aeiou") + w[k + 1 :] if rng.random() < 0.5 else w
    word = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(4))
    people = [(word(), word(), word()) for _ in range(40)]
    rows = []
    for i in range(400):
        g, f, t = rng.choice(people)
        rows.append((f"r{i:03d}", "crm", str(i), payload("crm", (slip(g), f, "", None, f"{slip(t)} street" if rng.random() < 0.3 else None, "-absent-", None, None, None)), f"b{rng.randrange(4)}"))
    df, order = raw(spark, rows), runs(spark, "b0", "b1", "b2", "b3")
    c = [r.asDict(recursive=True) for r in history.contents(df, R.batch_order(order)).collect()]
    like = lambda x, y: x["strict"] == y["strict"] and all(history._near(x[k], y[k]) for k in ("given", "family", "town")) and history._same_street(*(z[k] for z in (x, y) for k in ("street", "kind", "direction")))
    first, root = {}, {}
    for x in sorted(c, key=lambda x: (x["batch_no"], x["id"])):
        key = tuple(x["content"].values())
        if key not in first:
            root[key] = min([root[k] for k, y in first.items() if like(y, x)] + [(x["batch_no"], x["id"])])
            first[key] = x
    want = {(x["id"], root[k][1]) for x in c if root[k := tuple(x["content"].values())][0] < x["batch_no"]}
    assert len(want) > 100
    for hot, loads in ((1000, 1), (1000, 4), (5, 2)):
        assert {tuple(r) for r in history.found(df, order, hot=hot, loads=loads).collect()} == want


def test_hot_content(spark):
    rows = [(f"h{i:05d}", "crm", str(i), payload("crm", put(ANN, family="Stanmoor" if i % 2 else "Stanmoorr")), f"b{i % 3 + 1}") for i in range(3000)]
    got = {tuple(r) for r in history.found(raw(spark, rows), runs(spark, "b1", "b2", "b3")).collect()}
    assert got == {(f"h{i:05d}", "h00000") for i in range(3000) if i % 3}


def test_components(spark):
    rng = random.Random(5)
    edges = [(f"c{i:05d}", f"c{i + 1:05d}") for i in range(700)] + [("hub", f"s{i}") for i in range(500)] + [(f"r{rng.randint(0, 400)}", f"r{rng.randint(0, 400)}") for _ in range(250)]
    edges += edges[:20] + [(b, a) for a, b in edges[:20]] + [("z", "z"), (None, "q")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    for seed in (0, 1):
        got = {r.vertex: r["group"] for r in components.components(spark.createDataFrame(edges, "a string, b string"), seed=seed).collect()}
        assert got == {n: find(n) for n in parent}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_latest_score_decides(spark):
    import datetime as dt

    t = lambda n: dt.datetime(2025, 1, n)
    rows = [("1", "x", "y", 0.99, True, t(1)), ("2", "y", "x", 0.5, True, t(2)), ("3", "x", "z", 0.96, True, t(1)), ("4", "x", "z", 0.1, False, t(3)), ("5", "w", "w", 1.0, True, t(1)), ("6", None, "w", 1.0, True, t(1))]
    s = spark.createDataFrame(rows, "id string, rec_a_key string, rec_b_key string, match_probability double, is_active boolean, scored_at timestamp_ntz")
    assert {tuple(r) for r in components.grouped_records(s).collect()} == {("x", "x"), ("z", "x")}


def test_evidence_bounds_hold():
    rng = random.Random(4)
    given, family = ["bob", "robert", "liz", "beth", "elizabeth", "ann", "ned", "j", "william t", None, "roberrt", "x y z"], ["stanmoor", "stanmor", "oak", "hulme", "st", None, "oak hulme", "bob"]
    pick = lambda xs: rng.choice(xs)
    rows = [
        (pick(given), pick(family), pick(["a@b", "c@d", None]), pick(["1", "2", None]), pick(["1980-02-03", "1980-03-02", "1980-02-04", "1971-01-01", None]), pick(["1", "2", None]), pick(["oak", "oaak", "elm", None]), pick(["4", None]), pick(["anwell", None]), pick(["10", "11", None]))
        for _ in range(400)
    ]
    t = pa.table({c: pa.array([r[k] for r in rows], pa.string()) for k, c in enumerate(person.COLUMNS)})
    i, j = (np.array(x) for x in zip(*itertools.combinations(range(len(rows)), 2)))
    hit, score = person.Block(t).scores(i, j)
    want = {k for k in range(len(i)) if person.evidence(rows[i[k]], rows[j[k]]) >= person.THRESHOLD}
    lost, extra = want - set(hit.tolist()), set(hit.tolist()) - want
    assert len(lost) <= 0.01 * len(want) and len(extra) <= 0.01 * len(want)


def test_bounds_hold_for_every_pair():
    rng = random.Random(5)
    base = ["christopherson", "chris", "christopher", "albert", "albret", "bertie", "bert", "robert", "bobby", "bobbyy", "rob", "anna katharina", "katharina", "w " * 50, "j", "j q", "williamm", "billy", "harry", "harald", "haarold", "stan moor", "stanmoor", "li", "kate", "jate", None, None, "dr", "\u00f6z"]

    def typed(x):
        if x and len(x) > 2 and rng.random() < 0.4:  # a slip
            k = rng.randrange(len(x) - 1)
            x = rng.choice([x[:k] + x[k + 1 :], x[:k] + "z" + x[k:], x[:k] + x[k + 1] + x[k] + x[k + 2 :], x[: k + 1], x[:k] + "q" + x[k + 1 :]])
        return x

    births = ["1985-03-12", "1985-03-21", "1985-12-03", "1958-03-12", "185-03-12", "1985-3-12", "19855-03-12", "1985-04-22", "1980-53-12", None]
    rows = [(typed(rng.choice(base)), typed(rng.choice(base)), rng.choice(["a@b", "c@d", None]), rng.choice(["1", "2", None]), rng.choice(births), rng.choice(["1", None]), typed(rng.choice(["oakfield", "elm", None])), rng.choice(["4", None]), typed(rng.choice(["anwell", None])), rng.choice(["10", "11", None])) for _ in range(500)]
    t = pa.table({c: pa.array([r[k] for r in rows], pa.string()) for k, c in enumerate(person.COLUMNS)})
    i, j = (np.array(x) for x in zip(*itertools.combinations(range(len(rows)), 2)))
    low, high = person.Block(t).bounds(i, j)
    exact = np.array([person.evidence(rows[x], rows[y]) for x, y in zip(i.tolist(), j.tolist())])
    wrong = np.flatnonzero((high < exact - 1e-9) | (low > exact + 1e-9))
    assert not len(wrong), [(rows[i[k]], rows[j[k]], low[k], exact[k], high[k]) for k in wrong[:3]]


def test_neighbours_swapped_in_a_birth_date_are_near():
    a = ("ann", "stanmoor", "a@b", "1", "1985-03-12", "1", "oakfield", None, "anwell", "10")
    b = (*a[:4], "1985-03-21", "2", "elm", None, "penham", "16")  # moved
    hit, score = person.Block(pa.table({c: pa.array([a[k], b[k]], pa.string()) for k, c in enumerate(person.COLUMNS)})).scores(np.array([0]), np.array([1]))
    assert hit.tolist() == [0] and score[0] >= person.THRESHOLD


PEOPLE = [
    ("1", "crm", "A", payload("crm", ANN), "b1"),
    ("2", "billing", "B", payload("billing", put(ANN, given="Annn", phone="unknown")), "b1"),
    ("3", "billing", "C", payload("billing", put(ANN, given="Thomas", dob="2001-09-09", email="t.s@post.example")), "b1"),  # of the household
    ("4", "crm", "D", payload("crm", BOB), "b1"),
    ("5", "billing", "E", payload("billing", put(BOB, given="Bob", phone=None)), "b1"),
    ("6", "billing", "F", payload("billing", put(BOB, given="BOB", email="-")), "b2"),
    ("7", "crm", "G", payload("crm", (None,) * 9), "b1"),
    ("8", "crm", "H", payload("crm", put(BOB, given="w " * 5000, street="y" * 50_000, email="q@r.example", phone="1", dob="")), "b1"),
    ("9", None, None, payload("crm", BOB), None),
]


def test_matches(spark):
    got = {(r.rec_a_key, r.rec_b_key): r.confidence for r in matching.matches(raw(spark, PEOPLE + PEOPLE[:2])).collect()}
    assert set(got) == {("billing:B", "crm:A"), ("billing:E", "crm:D"), ("billing:F", "crm:D")}
    assert all(0.5 < c <= 1 for c in got.values())
    assert matching.matches(raw(spark, [])).count() == 0


def test_window_finds_pairs_across_partitions(spark):
    rows = [(str(i), s, f"{i}", payload(s, put(ANN, given=f"Ann{chr(97 + i % 26)}{i}", email=f"p{i}@post.example", phone=f"212-555-{i:04d}", dob=f"19{i % 90 + 10}-0{i % 9 + 1}-1{i % 9}", street=f"{i} Oak{i} Street")), "b1") for i in range(400) for s in ("crm", "billing")]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {tuple(r[:2]) for r in matching.matches(raw(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(f"billing:{i}", f"crm:{i}") for i in range(400)} <= got


def test_variants(spark):
    got = {tuple(r) for r in names.variants(raw(spark, PEOPLE + PEOPLE[:2]), runs(spark, "b1", "b2")).collect()}
    assert got == {("billing:B", "crm:A"), ("billing:E", "crm:D"), ("billing:F", "crm:D")}
    assert names.variants(raw(spark, []), runs(spark)).count() == 0


def test_contexts_of_any_size_are_compared(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(4))
    rows, want = [], set()
    for k in range(150):  # a mailbox of 300 records, of each person one in either source
        name = word()
        for source, given in (("crm", name), ("billing", name + "s")):
            rows.append((f"{source}:{k:03d}", given, None, "office@post.example", *[None] * 7))
        want.add((f"billing:{k:03d}", f"crm:{k:03d}"))
    df = spark.createDataFrame(rows, "key string, " + ", ".join(f"{c} string" for c in person.COLUMNS))
    whole = {tuple(r) for r in names.person_pairs(df).collect()}
    assert want <= {r[:2] for r in whole}
    assert {tuple(r) for r in names.person_pairs(df, 40).collect()} == whole  # groups of 40


def test_ten_thousand_share_a_mailbox(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(n))
    rows = [(f"crm:{i:05d}", word(4), word(4), "office@post.example", *[None] * 7) for i in range(10_000)]
    want = set()
    for i in range(0, 10_000, 100):  # a few persons stand in the other source, with a slip in the surname
        key, given, family = rows[i][:3]
        rows.append((f"billing:{i:05d}", given, family[:3] + "x" + family[4:], "office@post.example", *[None] * 7))
        want.add((f"billing:{i:05d}", key))
    df = spark.createDataFrame(rows, "key string, " + ", ".join(f"{c} string" for c in person.COLUMNS))
    got = {tuple(r)[:2] for r in names.person_pairs(df).collect()}
    assert len(want & got) >= 0.97 * len(want)


def test_reordered_and_pet_names_meet_by_birth_date(spark):
    at = lambda key, given, family, birth: (key, given, family, None, None, birth, *[None] * 5)
    rows = [at("a:1", "john", "smith", "1980-02-03"), at("b:1", "smith", "john", "1980-02-03"), at("c:1", "john smith", None, "1980-02-03")]
    rows += [at("a:2", "bob", "penham", "1971-05-06"), at("b:2", "robert", "pnham", "1971-05-06"), at("a:3", "bert", "oakley", "1972-05-06"), at("b:3", "albert", "aokley", "1972-05-06")]
    df = spark.createDataFrame(rows, "key string, " + ", ".join(f"{c} string" for c in person.COLUMNS))
    got = {tuple(r)[:2] for r in names.person_pairs(df).collect()}
    assert {("a:1", "b:1"), ("b:1", "c:1"), ("a:2", "b:2"), ("a:3", "b:3")} <= got


def test_bands_follow_the_curve():
    assert K.collision(names.NAME_LIKENESS, names.BANDS, names.ROWS) >= names.RECALL > K.collision(names.NAME_LIKENESS, names.BANDS - 1, names.ROWS)


def test_monge_elkan():
    assert person.monge_elkan(("bob", "penham"), ("penham", "robert")) == 1 and person.monge_elkan((), ("x",)) == 0


def test_survivors(spark):
    import datetime as dt

    t = lambda n: dt.datetime(2025, 1, n)
    m = spark.createDataFrame([("1", "crm:1", "E", t(1)), ("2", "billing:1", "E", t(1)), ("3", "webforms:1", "E", t(1)), ("4", "crm:2", "F", t(1)), ("5", "crm:2", "G", t(2)), ("6", "crm:9", "E", t(1)), ("7", None, "E", None)], "id string, record_key string, entity_id string, assigned_at timestamp_ntz")
    cols = "id string, record_key string, source_system string, given_name string, family_name string, email string, email_valid boolean, phone_e164 string, phone_valid boolean, addr_number string, addr_street string, addr_unit string, addr_city string, addr_region string, addr_postal string, birth_date date, updated_at_source timestamp_ntz, ingested_at timestamp_ntz, value string, attribute string"
    d = dt.date
    rows = [
        ("1", "crm:1", "crm", "w", "xxx", "a@b.example", None, "+12125550101", False, "1", "oak st", None, None, None, None, d(1900, 1, 1), t(5), t(5), "q", "r"),
        ("2", "billing:1", "billing", "will", "oak", "nobody@example.com", True, "+12125550102", True, "1", "oak st", "apt 2", "anwell", None, None, d(1980, 1, 1), t(3), t(3), "q", "r"),
        ("3", "webforms:1", "webforms", "bill", "oak", "c@d.example", False, None, None, None, "unknown", "apt 3", "anwell", "xa", "10001", d(1980, 1, 2), None, t(4), "q", "r"),
        ("0", "webforms:1", "webforms", "old", "old", "old@d.example", True, None, None, None, None, None, None, None, None, None, t(9), t(1), "q", "r"),
        ("4", "crm:2", "crm", "ann", "oak", None, None, None, None, None, None, None, None, None, None, None, t(3), t(3), "q", "r"),
    ]
    s = spark.createDataFrame(rows + rows[:1], cols)
    got = {(r.entity_id, r.attribute): r.record_key for r in survivors.survivors(m, s).collect()}
    assert got == {("E", "given_name"): "webforms:1", ("E", "family_name"): "webforms:1", ("E", "email"): "crm:1", ("E", "phone_e164"): "billing:1", ("E", "address"): "billing:1", ("E", "birth_date"): "webforms:1"}
    assert survivors.survivors(m.limit(0), s.limit(0)).count() == 0


def test_em_of_sources():
    rng = np.random.default_rng(2)
    truth = rng.random(30000) < 0.5
    sens, spec = [0.9, 0.7, 0.8], [0.95, 0.9, 0.7]
    x = np.stack([np.where(truth, rng.random(30000) < a, rng.random(30000) > b) for a, b in zip(sens, spec)], 1).astype(int)
    pats, n = np.unique(x, axis=0, return_counts=True)
    prior, rates = survivors.fit([("email", [("abc"[i], bool(v)) for i, v in enumerate(p)], int(k)) for p, k in zip(pats.tolist(), n)])["email"]
    assert abs(prior - 0.5) < 0.06
    assert all(abs(rates[k][0] - a) < 0.06 and abs(rates[k][1] - b) < 0.06 for k, a, b in zip("abc", sens, spec))


def test_values_are_judged(spark):
    rng = random.Random(9)
    rows = []
    for e in range(300):
        for i in range(20):  # twenty sources, the last four often wrong; a phone may be written in two ways
            if rng.random() < 0.4:
                v = "right" if rng.random() < (0.95 if i < 16 else 0.3) else f"wrong{rng.randrange(3)}"
                rows.append((f"e{e}", "email", f"s{i}:{e}", f"s{i}", v, 1, None))
    rows.append(("x", "email", "n:1", None, "nobody", 1, None))
    made = spark.createDataFrame(rows, "entity_id string, attribute string, record_key string, source_system string, value string, completeness int, at timestamp_ntz")
    got = {tuple(r[:2]) + (r.value,): (r.p_true, r.kept) for r in survivors.judged(made).collect()}
    right = [k for (_, _, v), (_, k) in got.items() if v == "right"]
    wrong = [k for (_, _, v), (_, k) in got.items() if v != "right"]
    assert sum(right) / len(right) > 0.97 and sum(wrong) / len(wrong) < 0.05
    survivors.ROUNDS, rounds = 4, survivors.ROUNDS
    try:
        few = survivors.judged(made).orderBy("entity_id", "value").collect()
        lie = survivors.judged(made, most_patterns=0).orderBy("entity_id", "value").collect()
    finally:
        survivors.ROUNDS = rounds
    assert [tuple(r)[:4] + (round(r.p_true, 6), r.kept) for r in few] == [tuple(r)[:4] + (round(r.p_true, 6), r.kept) for r in lie]
    assert survivors.judged(made.limit(0)).count() == 0


LINES = [
    (1, "12 Oakenshaw Street Apt 4", "Anwell", "10001"),
    (2, "12 OAKENSHAW ST., # 4, Anwell, XA 10001", None, None),
    (3, "Oaknshaw St 12 Unit 4", None, "10001"),
    (4, "12 Oakenshaw Street", "Anwell", "10001"),  # no unit
    (5, "12 Oakenshaw Road Apt 4", "Anwell", "10001"),  # another type
    (6, "12 W Oakenshaw Street Apt 4", "Anwell", None),  # another direction
    (7, "12 Oakenshaw Street Apt 4", "Corfield", None),  # another town
    (8, "4/12 Oakenshaw", "Anwel", None),
    (9, "P.O. Box 12", None, None),
    (10, None, None, None),
    (11, "", "", ""),
    (12, "7 " + "y" * 60_000 + " Lane", None, None),
    (12, "7 " + "y" * 60_000 + " Lane", None, None),
    (None, "12 Oakenshaw Street Apt 4", "Anwell", "10001"),
    (13, "12 Oakenshaw Street Apt 4", "Anwell", "10001"),
]


def lines(spark, rows):
    return spark.createDataFrame([(i, x, None, c, p, "a", "b") for i, x, c, p in rows], "address_id long, input string, addr_unit string, addr_city string, addr_postal string, c string, town string")


def test_same_door(spark):
    extra = [(100 + i, f"{i} Elm Road", t, p) for i, (t, p) in enumerate([("Anwell", "10001"), ("Corfield", "16001")] * 8)]
    got = {tuple(r) for r in places.same_door(lines(spark, LINES + extra)).collect()}
    same = [1, 2, 3, 8, 13]
    assert got == set(itertools.combinations(same, 2))
    left_out = [(1, "12 Elm Road", "Anwell", None), (2, "12 Elm", "Anwell", None), (3, "12 Elm Rd, Anwell", None, None), (4, "12 Elm Road", None, None), (5, "12 N Elm Road", "Anwell", None)]
    got = {tuple(r) for r in places.same_door(lines(spark, left_out)).collect()}
    assert got == set(itertools.combinations((1, 2, 3, 4), 2))


def test_towns_in_blocks_read_alike(spark):
    towns = [f"{a}{b}" for a in ("an", "cor", "pen", "hol") for b in ("well", "field", "ham", "lowby")]
    rows = [(i, f"{i % 40 + 1} Elm Road {towns[i % 16]}", None, None) for i in range(80)] + [(100 + i, "1 Oak Lane", towns[i % 16], None) for i in range(48)]
    df = lines(spark, rows)
    names = places.gazetteer(df)
    assert {r.town for r in names.collect()} == set(towns)
    read = lambda block: {tuple(r) for r in places.doors(df, names, block).collect()}
    assert read(200_000) == read(3)


def test_prefix_loses_no_two_slips(spark):
    """Every pair of street names up to two slips apart is a candidate, against all pairs."""
    from kinweave.functions.address import slips

    rng = random.Random(11)
    base = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(4, 12))) for _ in range(25)]

    def typo(w):
        k = rng.randrange(len(w) - 1)
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + "q" + w[k + 1 :]])

    names = sorted({*base, *(typo(w) for w in base), *(typo(typo(w)) for w in base if len(w) > 5)})
    rows = [(i, "7", n, None, None, None, "anwell" if i % 3 else None, 1) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "c long, number string, street string, kind string, direction string, unit string, town string, lines long")
    got = {tuple(sorted(r)) for r in places._candidates(places.weighed(df)).collect()}
    want = {(i, j) for i, j in itertools.combinations(range(len(names)), 2) if slips(names[i], names[j], 2) <= 2}
    assert len(want) > 30 and want <= got
    assert places.same_door(lines(spark, [])).count() == 0


def test_difference_is_karmarkar_karp():
    w, s = packing.difference(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(s) == [14, 16] and np.array_equal(np.bincount(w, weights=[8, 7, 6, 5, 4]), s)


def test_pack_fits():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = np.sort(rng.integers(0, 100, rng.integers(1, 80)))[::-1]
        w = packing.pack(sizes, 100)
        assert np.bincount(w, weights=sizes).max() <= 100


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "a", "b") for i, t in texts], "doc_id long, text string, n_tokens string, item_id string")


def test_containers_do_not_depend_on_the_split(spark):
    texts = [(i // 2, "word " * (i % 60)) for i in range(300)] + [(7, "many words " * 300)] * 3
    targets = spark.createDataFrame([(1, 64), (2, 512)], "target_id long, capacity_tokens long")
    one, other = (sorted(tuple(r) for r in packing.containers(docs(spark, texts).repartition(n), targets, block=64).collect()) for n in (1, 7))
    assert one == other


def test_containers(spark):
    texts = [(i, "word " * (i % 60)) for i in range(300)] + [(1000, "many words " * 300), (1001, ""), (1002, None), (1000, "many words " * 300), (None, "x"), (1003, "z" * 40_000)]
    targets = spark.createDataFrame([(1, 64), (2, 512), (3, 0), (4, None)], "target_id long, capacity_tokens long")
    out = packing.containers(docs(spark, texts), targets, block=64).collect()
    enc = packing.encoder(packing.TOKENIZER)
    want = sorted(len(enc.encode_ordinary(t)) for _, t in texts if t is not None)
    for target, cap in ((1, 64), (2, 512)):
        rows = [r for r in out if r.target_id == target]
        load = defaultdict(int)
        for r in rows:
            load[r.container_id] += r.n_tokens
        assert max(load.values()) <= cap
        assert sum(r.n_tokens for r in rows) == sum(want)
        assert len({(r.doc_id, r.piece) for r in rows if r.doc_id not in (1000,)}) == len([r for r in rows if r.doc_id not in (1000,)])
        split = {r.doc_id for r in rows if r.piece > 0}
        assert all(len(enc.encode_ordinary(t)) > cap for i, t in texts if i in split)
        assert sum(load.values()) / (cap * len(load)) > 0.9
    assert {r.target_id for r in out} == {1, 2}
    assert packing.containers(docs(spark, []), targets).count() == 0


ITEM = "Card Bave315 supersedes card Davo693, dated 2024-02-19, unless seal Lovi732 of Pellham was broken 59 times by Lorcan Zelgate before noon."
NOISE = "the quick brown fox jumps over a lazy dog while nobody looks at the moon tonight and then all goes home again "


def brute(doc, item):
    import re

    w = lambda s: re.sub(r"[^\w\s]", "", re.sub(r"<[^>]*>", " ", s.lower())).split()
    d, q = w(doc), w(item)
    for n in range(12, len(q) + 1):
        for i in range(len(q) - n + 1):
            for j in range(len(d) - n + 1):
                if sum(x != y for x, y in zip(q[i : i + n], d[j : j + n])) <= n // 9:
                    return True
    return False


def test_short_items_and_common_shingles(spark):
    texts = [(1, "<P>Some</P> text: to be or not"), (2, "nothing here"), (3, "we hold these truths to be self evident today"), (4, "alpha beta " * 400), (5, "a < b and c > d holds")]
    items = [(1, "To be, or not"), (2, "nothing"), (3, "these truths to be self evident"), (4, "..."), (5, "absent words entirely")] + [(100 + i, "alpha beta " * 8) for i in range(60)]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in leakage.leaks(docs(spark, texts), df).collect()}
    assert got == {(1, 1), (2, 2), (3, 3)} | {(4, 100 + i) for i in range(60)}
    most, leakage.MOST_HITS = leakage.MOST_HITS, 50  # piece by piece
    try:
        assert {tuple(r) for r in leakage.leaks(docs(spark, texts), df).collect()} == got
    finally:
        leakage.MOST_HITS = most


def test_least_hashes_of_runs():
    h = np.array([5, 3, 9, 1, 7, 2, 8], dtype=np.uint64)
    row = np.array([0, 0, 0, 0, 1, 1, 2])
    assert leakage.RUN == 2
    assert leakage.least_of_runs(h, np.arange(7), row).tolist() == [False, True, False, True, False, True, True]


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    words = ITEM.split()
    texts = []
    for k in range(120):
        n = rng.randint(8, len(words))
        at = rng.randint(0, len(words) - n)
        part = words[at : at + n]
        for _ in range(rng.randint(0, 4)):
            part[rng.randrange(n)] = "altered"
        texts.append((k, NOISE * rng.randint(0, 2) + " ".join(part).upper() + " " + NOISE))
    texts += [(500, None), (501, ""), (502, NOISE * 3000 + f"<p>{ITEM}</p>"), (503, ITEM.replace(" ", "  "))]
    items = spark.createDataFrame([(1, ITEM, "x"), (2, NOISE.replace("fox", "cat")[:20], "x"), (3, None, "x"), (4, "", "x"), (1, ITEM, "x")], "item_id long, text string, doc_id string")
    got = {tuple(r) for r in leakage.leaks(docs(spark, texts + texts[:3]), items).collect()}
    want = {(i, 1) for i, t in texts if t and i != 502 and brute(t.replace(" ", " "), ITEM)} | {(502, 1)}
    assert got == want
    assert leakage.leaks(docs(spark, texts), items.limit(0)).count() == 0 and leakage.leaks(docs(spark, []), items).count() == 0


def test_spam(spark):
    rng = random.Random(7)
    subject, verb = ["the desk", "our team", "a clerk", "the office"], ["asked for", "looked at", "wrote about", "closed"]
    prose = lambda n: " ".join(f"{rng.choice(subject).capitalize()} {rng.choice(verb)} the {rng.choice(['record', 'case', 'row', 'name'])} of {rng.choice(['Anna', 'Bruno', 'Carla'])} on day {rng.randint(1, 99)}, but it was not in the list." for _ in range(n))
    texts = [(i, prose(rng.randint(2, 12))) for i in range(300)]
    texts += [(900, "cheap watches • cheap watches • buy watches • " * 30), (901, "\n".join(f"https://s{i}.example/cheap-watches?ref={i}" for i in range(40))), (902, " ".join(f"#cheap_watches{i % 3}" for i in range(60)))]
    honest = [(950, "\n".join(f"0{i % 10}:0{i % 6} heartbeat ok, crm idle" for i in range(40))), (951, "source,id,given\n" + "\n".join(f"crm,{i},Anna,Bell,1980" for i in range(40))), (952, None), (953, ""), (954, "..."), (955, prose(4) + " #one #two #three")]
    honest += [(960, "x" * 300_000), (961, "[a " * 20_000), (962, "<a " * 20_000), (963, "." * 100_000), (964, "a" + "," * 100_000)]
    got = {r.doc_id for r in spam.spam(docs(spark, texts + honest + texts[:2])).collect()}
    assert got == {900, 901, 902}
    assert spam.spam(docs(spark, [])).count() == 0
