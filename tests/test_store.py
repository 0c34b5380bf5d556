"""Schemas, the write path, views, live queries and wrappers on small data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace import schema as S
from millrace.functions.expressions import field
from millrace.operators.query import query
from millrace.plans import wire
from millrace.sources import tables, wrappers
from millrace.sources.store import VERSION, Collection, ConcurrencyError, DataStore, View
from millrace.streaming.live import LiveQuery

PRODUCTS = S.define("products", id=S.string().key().identity(), name=S.string(), price=S.number().default(1.0), deleted=S.boolean().nullable(), sku=S.string().nullable().distinct())


def rows(spark, *r):
    return spark.createDataFrame(list(r), "id string, name string, price double, sku string")


def test_write_path(spark, tmp_path):
    store = DataStore(spark, f"file://{tmp_path}", Collection(PRODUCTS, soft_delete="deleted", audit="trail", versioned=True))
    store.add("products", rows(spark, ("a", "apple", 3.0, "1"), ("b", "bread", None, "2"), (None, "cake", 5.0, None)))
    assert store.has_changes()
    store.save()
    found = {r.name: r for r in store.query("products").collect()}
    assert found["bread"].price == 1.0 and len(found["cake"].id) == 36
    seen = store.query("products", versions=True).to_df()
    assert {r[VERSION] for r in seen.collect()} == {1}
    store.update("products", spark.createDataFrame([("a", 4.0, 1)], f"id string, price double, {VERSION} long"))
    store.save()
    store.update("products", spark.createDataFrame([("a", 9.0, 1)], f"id string, price double, {VERSION} long"))
    with pytest.raises(ConcurrencyError):
        store.save()
    store.staged.clear()
    assert store.query("products").where(field("id") == "a").first().price == 4.0
    store.remove("products", store.query("products").where(field("name") == "bread"))
    store.save()
    assert {r.name for r in store.query("products").collect()} == {"apple", "cake"}
    assert store.stored("products").count() == 3
    trail = [(r.op, r.place) for r in store.audit_trail("trail").orderBy("place", "op").collect()]
    assert trail.count(("add", 2)) == 3 and trail.count(("update", 1)) == 2


def test_constraints_leave_the_store_alone(spark, tmp_path):
    store = DataStore(spark, f"file://{tmp_path}", Collection(PRODUCTS))
    store.add("products", rows(spark, ("a", "x", 1.0, "1"), ("b", "y", 1.0, "1")))
    with pytest.raises(ValueError, match="sku is not unique"):
        store.save()
    assert store.query("products").count() == 0


def test_views(spark, tmp_path):
    store = DataStore(spark, f"file://{tmp_path}", Collection(PRODUCTS))
    now = {"df": spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")}
    mirror, history = View(store, "m", lambda: now["df"], ["k"]), View(store, "h", lambda: now["df"])
    mirror.compute(), history.compute()
    now["df"] = spark.createDataFrame([(1, "c"), (3, "d")], "k long, v string")
    assert sorted((r._op, r.k) for r in mirror.compute().collect()) == [("add", 3), ("remove", 2), ("update", 1)]
    assert history.compute().count() == 2 and history.read().count() == 4
    assert sorted(tuple(r) for r in mirror.read().collect()) == [(1, "c"), (3, "d")]
    assert history.compute().count() == 0
    mirror.empty()
    assert mirror.read().count() == 0


def test_live_query(spark, tmp_path):
    state, got = {"rows": [(1, 10), (2, 1)]}, []
    run = lambda: spark.createDataFrame(state["rows"], "k long, v long").where("v > 5")
    q = LiveQuery(run, ["k"], lambda df: got.append(sorted(r.k for r in df.collect())), F.col("v") > 5)
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema("k long, v long, _op string").json(str(folder))
    for n, (data, change) in enumerate([([(1, 10), (2, 2)], '{"k":2,"v":2,"_op":"update"}'), ([(1, 1), (2, 2)], '{"k":1,"v":1,"_op":"update"}'), ([(1, 1), (2, 9)], '{"k":2,"v":9,"_op":"update"}')]):
        state["rows"] = data if n else state["rows"]
        (folder / f"{n}.json").write_text(change)
        s = q.subscribe(stream, str(tmp_path / "cp"), availableNow=True)
        s.awaitTermination(60)
    # each start delivers once; the first change is irrelevant, the second a row that leaves, the third one that enters
    assert got[0] == [1] and got[-1] == [2] and [] in got


def test_sources_and_encryption(spark, tmp_path):
    secret = tables.encryption("0123456789abcdef", deterministic=True)
    people = S.define("people", id=S.number("long").key().stored_as("pk"), mail=S.string().transformed(secret))
    files = tables.FileSource(spark, str(tmp_path), "json")
    files.write(people, spark.createDataFrame([(1, "a@x.org"), (2, None)], "id long, mail string"))
    stored = spark.read.json(f"{tmp_path}/people.json")
    assert set(stored.columns) == {"pk", "mail"} and stored.where("pk = 1").first().mail.startswith("enc:v1:")
    assert {r.id: r.mail for r in files.read(people).collect()} == {1: "a@x.org", 2: None}
    calls = []
    source = wrappers.Retried(wrappers.Observed(files, lambda *a: calls.append(a[:2])))
    assert wrappers.Replicated([source]).read(people).count() == 2 and calls == [("read", "people")]
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.txt").write_text("hello")
    ref = tables.file_references(spark, str(tmp_path / "f")).first()
    assert (ref.size, ref.content_type, ref.file_name, ref.key) == (5, "text/plain", "a.txt", ref.checksum)


def test_wire_errors_are_values(spark):
    q = query(spark.createDataFrame([(1, "a")], "id long, s string"), "id")
    plan = wire.encode("c", q.where(field("s") == "a"))
    assert wire.handle(plan, {"c": q})[0].count() == 1
    assert wire.handle(plan, {"c": q}, authorize=lambda p: False)[1] == "not authorized"
    plan["steps"][0]["predicate"]["left"]["property"] = "nope"
    assert wire.handle(plan, {"c": q})[1].startswith("KeyError")
    assert wire.handle({"collection": "c", "steps": [{"kind": "drop"}]}, {"c": q})[0] is None


def test_joins_of_fixture(spark):
    teams = query(spark.createDataFrame([("A", "east"), ("B", "west"), ("G", "east")], "id string, region string"), "id")
    members = query(spark.createDataFrame([(1, "A", 10), (2, "A", 20), (3, "B", 30), (4, "Z", 40), (5, None, 50)], "id long, team string, rank long"), "id")
    assert teams.join(members, "id", "team").count() == 3 and teams.left_join(members, "id", "team").count() == 4
    assert members.left_join(teams, "team", "id").where(field("inner").id.is_null()).count() == 2
    with pytest.raises(TypeError):
        query(spark.createDataFrame([(True,)], "b boolean")).join(teams, "b", "id")


def test_vectors_of_fixture(spark):
    v = [("x", [1.0, 0.0, 0.0]), ("y", [0.0, 1.0, 0.0]), ("o", [0.0, 0.0, 0.0]), ("xy", [1.0, 1.0, 0.0]), ("n", [-1.0, 0.0, 0.0]), ("null", None)]
    q = query(spark.createDataFrame(v, "id string, e array<double>"), "id")
    names = [r.id for r in q.nearest("e", [1, 0, 0], 6).collect()]
    assert names[:2] == ["x", "xy"] and set(names[-2:]) == {"o", "null"}
    assert q.nearest("e", [1, 0, 0], 0).count() == 0
    assert [r.id for r in q.where(field("id") != "x").nearest("e", [1, 0, 0], 3).take(1).collect()] == ["xy"]


def test_updates_to_null_and_back(spark, tmp_path):
    store = DataStore(spark, f"file://{tmp_path}", Collection(PRODUCTS, soft_delete="deleted"))
    store.add("products", rows(spark, ("a", "x", 1.0, "1"), ("b", "y", 2.0, "2")))
    store.save()
    store.remove("products", store.query("products").where(field("id") == "a"))
    store.update("products", spark.createDataFrame([("b", None)], "id string, sku string"))
    store.save()
    assert [(r.id, r.sku, r.price) for r in store.query("products").collect()] == [("b", None, 2.0)]
    store.update("products", spark.createDataFrame([("a", None)], "id string, deleted boolean"))
    store.save()
    assert store.query("products").count() == 2


def test_manifests(spark, tmp_path):
    root = f"file://{tmp_path}"
    one, two = (DataStore(spark, root, Collection(PRODUCTS)) for _ in range(2))
    one.add("products", rows(spark, ("a", "x", 1.0, "1")))
    one.save()
    assert [p.name for p in tmp_path.glob("manifest-*.json")] == ["manifest-000000000001.json"]
    # another writer publishes the next commit in between: nothing of this save shows
    one.add("products", rows(spark, ("b", "y", 1.0, "2")))
    seen = two._manifest()
    assert two.files.publish("manifest", 2, __import__("json").dumps(seen | {"commit": 2}))
    one._manifest = lambda: seen
    with pytest.raises(ConcurrencyError):
        one.save()
    assert two.query("products").count() == 1
    # what a killed writer leaves behind names nothing
    (tmp_path / ".manifest.left").write_text("{")
    assert two._manifest()["commit"] == 2 and not two.files.publish("manifest", 2, "{}")


def test_mirror_keeps_the_last(spark):
    from millrace.operators import changes as C

    derived = spark.createDataFrame([(1, "a"), (2, "x"), (1, "b"), (1, "c")], "k long, v string").coalesce(1)
    assert sorted((r.k, r.v) for r in C.mirror(derived.limit(0), derived, ["k"]).collect()) == [(1, "c"), (2, "x")]
