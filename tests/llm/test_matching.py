"""Windows and assignment of problem 4 against brute force."""

import random

from kinweave.llm import assignment, matching, person
from kinweave.llm.assignment import solve

EDGES = "side string, a string, b string, score double, part string"


def most(edges):
    ends = sorted({a for a, _, _ in edges})

    def rest(i, used):
        if i == len(ends):
            return 0.0
        return max([rest(i + 1, used)] + [w + rest(i + 1, used | {b}) for a, b, w in edges if a == ends[i] and b not in used])

    return rest(0, frozenset())


def graph(rng, n, m, k):
    return [(a, b, w) for (a, b), w in {(f"a{rng.randrange(n)}", f"b{rng.randrange(m)}"): rng.choice([9.5, 10.0, 11.0, 12.3, 20.0, 30.5]) for _ in range(k)}.items()]


def test_solve_is_the_optimum():
    rng = random.Random(1)
    for _ in range(400):
        edges = graph(rng, rng.randint(1, 5), rng.randint(1, 5), rng.randint(1, 12))
        got = [edges[k] for k in solve(edges)]
        assert len({a for a, _, _ in got}) == len({b for _, b, _ in got}) == len(got)
        assert abs(sum(w for _, _, w in got) - most(edges)) < 1e-9


def test_assign(spark):
    rng = random.Random(2)
    rows, best = [], 0.0
    for k in range(12):
        edges = [(f"{k}{a}", f"{k}{b}", w) for a, b, w in graph(rng, 4, 4, 9)]
        best += most(edges)
        rows += [("crm-web", a, b, w, "x") for a, b, w in edges]
    rows += [rows[0], (*rows[0][:3], 1.0, "y"), ("crm-web", None, "q", 50.0, "x"), ("crm-web", "q", "r", None, "x"), ("crm-web", "q", "s", 0.0, "x")]
    df = spark.createDataFrame(rows, EDGES)
    weight = {r[:3]: r[3] for r in reversed(rows)}
    exact = [tuple(r) for r in assignment.assign(df).collect()]
    assert abs(sum(weight[r] for r in exact) - best) < 1e-6
    parts = [tuple(r) for r in assignment.assign(df, most_edges=20).collect()]  # part by part
    assert abs(sum(weight[r] for r in parts) - best) < 1e-6
    near = [tuple(r) for r in assignment.assign(df, most_edges=0, epsilon=0.5).collect()]  # all parts by auction
    for got in (exact, parts, near):
        assert len({r[1] for r in got}) == len({r[2] for r in got}) == len(got)
    assert best - 0.5 * len({a for _, a, _ in near}) - 1e-6 <= sum(weight[r] for r in near) <= best + 1e-6
    assert assignment.assign(spark.createDataFrame([], EDGES)).count() == 0


def test_edges_of_partitions_lose_no_pair(spark):
    rng = random.Random(3)
    rows = [(f"{s}:{i}", s, f"name{rng.randrange(40)}", "stanmoor", f"m{i % 25}@post.example", None, f"19{rng.randrange(60, 99)}-01-02", *[None] * 5) for i in range(150) for s in ("crm", "billing")]
    df = spark.createDataFrame(rows, "key string, source_system string, " + ", ".join(f"{c} string" for c in person.COLUMNS))
    got = []
    for n in ("1", "5", "150"):  # partitions of fewer rows than the window, too
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got.append({tuple(r) for r in matching.window_pairs(matching.packed(df), 4, 9).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] and got[0] == got[1] == got[2]


def test_the_window_widens_within_a_mailbox(spark):
    rows = [("crm:a", "crm", "ann", "stanmoor", "home@post.example", None, None, *[None] * 5)]
    rows += [(f"crm:{i:02d}", "crm", f"b{chr(97 + i)}rt", "penham", "home@post.example", None, "1990-01-02", *[None] * 5) for i in range(14)]
    rows += [("billing:a", "billing", "ann", "stanmoor", "home@post.example", None, "1980-02-03", *[None] * 5)]
    df = spark.createDataFrame(rows, "key string, source_system string, " + ", ".join(f"{c} string" for c in person.COLUMNS))
    assert ("billing:a", "crm:a") in {tuple(r)[:2] for r in matching.window_pairs(matching.packed(df)).collect()}
