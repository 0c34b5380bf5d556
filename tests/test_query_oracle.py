"""The query algebra against plain Python: predicates, orders and windows; random predicates; terminals."""

from __future__ import annotations

import random

import pytest

from millrace.functions.expressions import TRUE, field, from_json, negate, to_json
from millrace.operators.query import query

ROWS = [
    (11, "rope", "deck", 4.5, 120.0), (12, "Lamp", "cabin", 18.0, 6.0), (13, "anchor", "deck", 96.0, 1.0), (14, "chart", "bridge", 7.25, 0.0),
    (15, "Bell", "deck", 33.0, 2.0), (16, "kettle", "galley", 18.0, 4.0), (17, "mug", "galley", 2.0, 48.0), (18, "oar", "deck", 0.0, 8.0), (19, "Pump", "hold", 64.0, 0.0),
]
NAMES = ["id", "item", "place", "cost", "stock"]
cost, stock, place, item = field("cost"), field("stock"), field("place"), field("item")
PREDICATES = [
    (TRUE, lambda r: True), (cost > 18, lambda r: r[3] > 18), (cost <= 18, lambda r: r[3] <= 18), (cost == 18, lambda r: r[3] == 18),
    (cost != 18, lambda r: r[3] != 18), (stock == 0, lambda r: r[4] == 0), (place == "deck", lambda r: r[2] == "deck"),
    (item.startswith("P"), lambda r: r[1].startswith("P")), (place.is_in(["cabin", "hold"]), lambda r: r[2] in ("cabin", "hold")),
    ((place != "deck") & (stock >= 4), lambda r: r[2] != "deck" and r[4] >= 4), ((place == "bridge") | (cost < 4.5), lambda r: r[2] == "bridge" or r[3] < 4.5),
    (~((cost > 5) & (stock < 5)), lambda r: not (r[3] > 5 and r[4] < 5)), (stock < 0, lambda r: r[4] < 0),
]
ORDERS = [(None, False), ("cost", False), ("cost", True), ("stock", True), ("item", False)]
WINDOWS = [(0, 0), (3, 0), (0, 2), (2, 4), (1, 50), (40, 0)]


@pytest.fixture(scope="module")
def rows(spark):
    return query(spark.createDataFrame(ROWS, NAMES).cache(), "id")


@pytest.mark.parametrize("n", range(len(PREDICATES)))
def test_orders_and_windows(rows, n):
    expr, test = PREDICATES[n]
    for by, down in ORDERS:
        for skip, take in WINDOWS:
            q = rows.where(expr)
            kept = [r for r in ROWS if test(r)]
            if by:
                q = q.sort(by, down)
                i = NAMES.index(by)
                kept = sorted(kept, key=lambda r: r[0])
                kept = sorted(kept, key=lambda r, i=i: r[i], reverse=down)
            got = [tuple(r) for r in q.skip(skip).take(take).collect()]
            want = kept[skip:][: take or None]
            assert len(got) == len(want)
            if by:
                assert [g[NAMES.index(by)] for g in got] == [w[NAMES.index(by)] for w in want]
                assert sorted(got) == sorted(want) or skip or take
            else:
                assert set(got) <= set(kept)


@pytest.mark.parametrize("n", range(len(PREDICATES)))
def test_terminals(rows, n):
    expr, test = PREDICATES[n]
    kept = [r[3] for r in ROWS if test(r)]
    q = rows.where(expr)
    assert q.count() == len(kept)
    assert q.some() == bool(kept)
    costs = q.map("cost")
    if kept:
        assert (costs.sum(), costs.min(), costs.max()) == (sum(kept), min(kept), max(kept))
    else:
        for terminal in (costs.sum, costs.min, costs.max, q.first):
            with pytest.raises(LookupError):
                terminal()


def test_random_predicates_and_their_complements(rows):
    rng = random.Random(77)

    def leaf():
        if rng.random() < 0.6:
            i, v = rng.choice([3, 4]), rng.randint(-1, 100)
            op = rng.choice(["gt", "ge", "lt", "le", "eq", "ne"])
            f = field(NAMES[i])
            e = {"gt": f > v, "ge": f >= v, "lt": f < v, "le": f <= v, "eq": f == v, "ne": f != v}[op]
            return e, lambda r: {"gt": r[i] > v, "ge": r[i] >= v, "lt": r[i] < v, "le": r[i] <= v, "eq": r[i] == v, "ne": r[i] != v}[op]
        v = rng.choice(["deck", "hold", "galley", "mast"])
        return place == v, lambda r: r[2] == v

    def tree(depth):
        if not depth:
            return leaf()
        (a, f), (b, g) = tree(depth - 1), tree(depth - 1)
        return (a & b, lambda r: f(r) and g(r)) if rng.random() < 0.5 else (a | b, lambda r: f(r) or g(r))

    for _ in range(25):
        e, test = tree(2)
        want = {r[0] for r in ROWS if test(r)}
        assert {r.id for r in rows.where(from_json(to_json(e))).collect()} == want
        assert {r.id for r in rows.where(negate(e)).collect()} == {r[0] for r in ROWS} - want


def test_null_rules(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", 5.0), (3, "b", 6.0)], "id long, s string, x double")
    q = query(df, "id")
    ids = lambda e: [r.id for r in q.where(e).sort("id").collect()]
    assert ids(field("s") != "a") == [1, 3]
    assert ids(~field("s").is_in(["a"])) == [1, 3]
    assert ids(field("s").is_in(["a", None])) == [1, 2]
    assert ids(~(field("x") > 5)) == [2]
    assert ids(~field("s").startswith("a")) == [3]
    assert ids(field("s").is_null()) == [1]
    assert q.sort("x").collect()[0].id == 1 and q.sort_descending("x").collect()[-1].id == 1
    assert [r.x for r in q.map("x").distinct().collect()] and q.map("x").min() == 5.0


def test_pushdown_and_explain(spark, sf_dir):
    orders = query(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey")
    df, told = orders.where((field("o_orderstatus") == "F") & (field("o_totalprice") != 5.0)).map("o_orderkey").explain()
    assert any("o_orderstatus" in p for p in told.pushed) and not told.python and not told.exchanges
    assert set(told.columns_read) <= {"o_orderkey", "o_orderstatus", "o_totalprice"}
    assert "shuffles: 0" in str(told) and df.count() > 0


def test_a_window_is_one_top_n(spark, sf_dir):
    orders = query(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey").sort_descending("o_totalprice")
    plan = orders.skip(5).take(20).to_df()._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "SinglePartition" not in plan and "rangepartitioning" not in plan.split("TakeOrderedAndProject")[1]
    prices = sorted(((r.o_totalprice, -r.o_orderkey) for r in orders.df.collect()), reverse=True)
    assert [(r.o_totalprice, -r.o_orderkey) for r in orders.skip(2).skip(3).take(20).collect()] == prices[5:25]


@pytest.mark.parametrize("width", [64, 96, 97, 768, 3072])
def test_nearest_at_any_width(spark, width):
    rng = random.Random(width)
    rows = [(i, [rng.gauss(0, 1) for _ in range(width)]) for i in range(12)] + [(20, None), (21, [0.0] * width), (22, [1.0]), (23, [1.0] * (width - 1) + [None])]
    probe = [rng.gauss(0, 1) for _ in range(width)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    cosine = lambda v: sum(a * b for a, b in zip(v, probe, strict=True)) / (sum(a * a for a in v) * sum(b * b for b in probe)) ** 0.5
    want = [i for i, _ in sorted(rows[:12], key=lambda r: -cosine(r[1]))]
    assert [r.id for r in query(df, "id").nearest("v", probe, 14).collect()] == [*want, 20, 21]
