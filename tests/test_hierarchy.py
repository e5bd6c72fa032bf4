import random
from datetime import datetime

from atlasloom.operators import hierarchy as h


def brute(par):
    out = {}
    for i in par:
        seen, x = [i], i
        while True:
            p = par[x]
            if p is None or p not in par:
                out[i] = ("tree" if p is None else "orphan", x, len(seen) - 1, seen[::-1])
                break
            if p in seen:
                k = seen.index(p)
                ring = seen[k:]
                out[i] = ("cycle" if k == 0 else "below_cycle", min(ring), k, seen[: k + 1][::-1])
                break
            seen.append(p)
            x = p
    return out


def links(spark, par):
    return spark.createDataFrame(list(par.items()), "id string, parent string")


def check(spark, par):
    got = {r.id: (r.state, r.root_id, r.depth, r.path) for r in h.hierarchy(links(spark, par)).collect()}
    assert got == brute(par)


def test_chain_star_rings_and_strays(spark):
    par = {f"c{i}": f"c{i - 1}" if i else None for i in range(40)}  # a deep chain
    par |= {f"s{i}": "c0" for i in range(60)}  # a hot parent
    par |= {"self": "self", "r1": "r2", "r2": "r3", "r3": "r1", "b1": "r2", "b2": "b1", "b3": "self"}
    par |= {"o1": "nowhere", "o2": "o1", "alone": None}
    check(spark, par)


def test_random_forest_and_descendants(spark):
    rnd = random.Random(3)
    ids = [f"n{i}" for i in range(70)]
    par = {i: rnd.choice([None, *ids, "gone"]) for i in ids}
    tree = h.hierarchy(links(spark, par))
    want = brute(par)
    got = {r.id: (r.state, r.root_id, r.depth, r.path) for r in tree.collect()}
    assert got == want
    pairs = {(r.id, r.descendant_id, r.steps) for r in h.descendants(tree).collect()}
    assert pairs == {(a, i, len(w[3]) - 1 - k) for i, w in want.items() for k, a in enumerate(w[3][:-1])}
    size = {r.id: r.subtree for r in tree.collect()}
    for i, w in want.items():
        assert size[i] == (None if w[0] == "cycle" else 1 + sum(1 for x in want.values() if i in x[3][:-1]))


def test_empty(spark):
    assert h.hierarchy(spark.createDataFrame([], "id string, parent string")).count() == 0


def test_current_links(spark):
    t = lambda n: datetime(2025, 1, n)
    a = spark.createDataFrame([("a", " b ", t(1), "x"), ("a", "c", t(3), "x"), ("a", "d", t(2), "y"), ("e", "\t ", t(1), "z"), (None, "a", t(1), ""), ("e", "\t ", t(1), "z")], "id string, up string, updated_at timestamp, parent string")
    b = spark.createDataFrame([("c", None, None)], "id string, up string, updated_at timestamp")
    got = {r.id: r.parent for r in h.current_links((a, "up"), (b, "up")).collect()}
    assert got == {"a": "c", "e": None, "c": None}
