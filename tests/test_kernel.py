"""Sessions over stored documents, types, layout, merges, linked live queries."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import ElementAlreadyExists, NoElement, NoLinkTarget, PermissionsError, SchemaMismatch, UnknownCardType, UnknownRelationship
from graphloom.functions.merge import merge, merged
from graphloom.kernel import ContractStore, Kernel
from graphloom.sources import layout
from graphloom.sources.types import TypeRegistry, spark_type
from graphloom.streaming import changes


def kind(slug, data=None):
    return {"slug": slug, "version": "1.0.0", "data": {"schema": {"type": "object", "properties": {"data": data or {"type": "object"}}}}}


TYPES = [kind(s) for s in ("user", "org", "role", "card", "link")] + [kind("thread", {"type": "object", "properties": {"n": {"type": "integer"}}})]
RELATIONSHIPS = [{"name": "has member", "data": {"inverseName": "is member of", "from": {"type": "org"}, "to": {"type": "user@1.0.0"}}}, {"name": "is attached to", "data": {"inverseName": "has attached", "from": {"type": "*"}, "to": {"type": "thread"}}}]


def link(a, name, inverse, b):
    return {"type": "link", "name": name, "slug": f"link-{a['slug']}-{b['slug']}-{name.replace(' ', '-')}", "data": {"inverseName": inverse, "from": {"id": a["id"], "type": a["type"]}, "to": {"id": b["id"], "type": b["type"]}}}


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    k = Kernel(ContractStore(spark, str(tmp_path_factory.mktemp("store"))), TypeRegistry(TYPES, RELATIONSHIPS))
    read = {"type": "object", "properties": {"active": {"const": True}, "type": {"enum": ["card@1.0.0", "thread@1.0.0"]}}, "required": ["active", "type"]}
    docs = {d["slug"]: d for d in k.insert_many([{"type": "user", "slug": "user-ann", "data": {"roles": ["reader"]}}, {"type": "user", "slug": "user-bob"}, {"type": "org", "slug": "org-x"}, {"type": "role", "slug": "role-reader", "data": {"read": read}}, {"type": "card", "slug": "card-open", "data": {"n": 1, "l": [1]}}, {"type": "card", "slug": "card-org", "markers": ["org-x"]}, {"type": "card", "slug": "card-bob", "markers": ["user-bob"]}, {"type": "card", "slug": "card-gone", "active": False}, {"type": "thread", "slug": "thread-a", "data": {"n": 1}}])}
    k.insert(link(docs["org-x"], "has member", "is member of", docs["user-ann"]))
    return k, docs


def test_reads_are_authorized(world):
    k, docs = world
    slugs = lambda actor: {r.slug for r in k.query({"properties": {"type": {"const": "card@1.0.0"}}, "required": ["type"]}, actor).collect()}
    assert slugs(docs["user-ann"]) == {"card-open", "card-org"}
    assert slugs(docs["user-bob"]) == set()
    assert slugs(None) == {"card-open", "card-org", "card-bob", "card-gone"}
    assert k.get("card-bob@1.0.0", docs["user-ann"]) is None and k.get("card-open@latest")["data"] == {"n": 1, "l": [1]}


def test_writes(world):
    k, docs = world
    with pytest.raises(ElementAlreadyExists):
        k.insert({"type": "card", "slug": "card-open"})
    with pytest.raises(UnknownCardType):
        k.insert({"type": "nothing", "slug": "x"})
    with pytest.raises(SchemaMismatch):
        k.insert({"type": "thread", "slug": "thread-b", "data": {"n": "x"}})
    with pytest.raises(PermissionsError):
        k.insert({"type": "org", "slug": "org-y"}, docs["user-ann"])
    with pytest.raises(NoLinkTarget):
        k.insert(link(docs["card-open"], "is attached to", "has attached", {"id": "nowhere", "slug": "n", "type": "thread@1.0.0"}))
    with pytest.raises(UnknownRelationship):
        k.insert(link(docs["card-open"], "owns", "is owned by", docs["thread-a"]))
    made = k.replace({"type": "card", "slug": "card-org", "markers": ["org-x"], "data": {"v": 2}})
    assert made["id"] == docs["card-org"]["id"] and made["updated_at"] and made["data"] == {"v": 2}
    assert k.patch("card-open@1.0.0", [{"op": "add", "path": "/data/l/-", "value": 2}])["data"]["l"] == [1, 2]
    before = k.contracts.version()
    k.patch("card-open@1.0.0", [{"op": "replace", "path": "/data/n", "value": 1}])
    assert k.contracts.version() == before
    with pytest.raises(NoElement):
        k.patch("card-bob@1.0.0", [], docs["user-ann"])


def test_links_set_linked_at_and_feed_live_queries(world, tmp_path):
    k, docs = world
    events = []
    schema = {"type": "object", "required": ["type"], "properties": {"type": {"const": "thread@1.0.0"}}, "$$links": {"has attached": {"required": ["slug"], "properties": {"slug": {"const": "card-open"}}}}}
    live = k.live(schema, f"{tmp_path}/live", lambda df, b: events.append({(r.id, r.event) for r in df.collect()}))
    run = lambda: live.start(k.contracts.changes(streaming=True)).awaitTermination()
    run()
    k.insert(link(docs["card-open"], "is attached to", "has attached", docs["thread-a"]))
    run()
    assert not events[0] and events[-1] == {(docs["thread-a"]["id"], "update")}
    assert set(k.get("thread-a@1.0.0")["linked_at"]) == {"has attached"} and set(k.get("card-open@1.0.0")["linked_at"]) == {"is attached to"}
    assert k.query(schema).count() == 1
    # A change of the linked document reaches its root; one that takes it out of the schema, or the link away, unmatches it.
    name = lambda slug, path, value: k.patch(f"{slug}@1.0.0", [{"op": "replace", "path": path, "value": value}])
    name("card-open", "/data/n", 77)
    run()
    assert events[-1] == {(docs["thread-a"]["id"], "update")}
    removed = "link-card-open-thread-a-is-attached-to"
    name(removed, "/active", False)
    run()
    assert events[-1] == {(docs["thread-a"]["id"], "unmatch")} and k.query(schema).count() == 0
    name(removed, "/active", True)
    run()
    assert events[-1] == {(docs["thread-a"]["id"], "update")}
    # The link leads elsewhere now: only the seen-set knows of its former root.
    other = k.insert({"type": "thread", "slug": "thread-other", "data": {"n": 2}})
    name(removed, "/data/to/id", other["id"])
    run()
    assert events[-1] == {(docs["thread-a"]["id"], "unmatch"), (other["id"], "insert")}
    before = len(events)
    name("card-bob", "/data", {"x": 1})
    run()
    assert not any(events[before:])


def test_nested_links_touch_their_roots(spark, tmp_path):
    k = Kernel(ContractStore(spark, f"{tmp_path}/s"), TypeRegistry(TYPES, [*RELATIONSHIPS, {"name": "has", "data": {"inverseName": "is in", "from": {"type": "thread"}, "to": {"type": "thread"}}}]))
    a, b, c = k.insert_many([{"type": "thread", "slug": s, "data": {"n": 1}} for s in "abc"])
    k.insert_many([link(a, "has", "is in", b), link(b, "has", "is in", c)])
    schema = {"required": ["slug"], "properties": {"slug": {"const": "a"}}, "$$links": {"has": {"$$links": {"has": {"properties": {"data": {"properties": {"n": {"const": 2}}}}}}}}}
    events = []
    live = k.live(schema, f"{tmp_path}/l", lambda df, n: events.append([(r.id, r.event) for r in df.collect()]))
    run = lambda: live.start(k.contracts.changes(streaming=True)).awaitTermination()
    run()
    for n in (2, 1, 3):
        k.patch("c@1.0.0", [{"op": "replace", "path": "/data/n", "value": n}])
        run()
    assert [e for e in events if e] == [[(a["id"], "update")], [(a["id"], "unmatch")]]


def test_a_later_commit_is_read_without_a_join_to_itself(spark, tmp_path):
    k = Kernel(ContractStore(spark, f"{tmp_path}/s"), TypeRegistry(TYPES, RELATIONSHIPS))
    k.insert_many([{"type": "card", "slug": s, "data": {"n": 0}} for s in "abc"] + [{"type": "thread", "slug": "t", "data": {"n": 0}}])
    change = lambda slug, n: k.patch(f"{slug}@1.0.0", [{"op": "replace", "path": "/data/n", "value": n}])
    cards = lambda: k.contracts.now().where("type = 'card@1.0.0'").selectExpr("slug", "try_variant_get(data, '$.n', 'int') AS n")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    pushed = "EqualTo(type,card@1.0.0)"
    assert pushed in plan(cards()) and "Join" not in plan(cards())
    change("a", 1)
    one = plan(cards())
    assert sum("Join" in line for line in one.split("\n")) == 1 and one.count(pushed) == 2
    assert {(r.slug, r.n) for r in cards().collect()} == {("a", 1), ("b", 0), ("c", 0)}
    for slug, n in (("b", 2), ("a", 3), ("t", 4), ("b", 5)):
        change(slug, n)
    assert sorted((r.slug, r.n) for r in cards().collect()) == [("a", 3), ("b", 5), ("c", 0)]
    k.contracts.compact()
    change("c", 6)
    assert sorted((r.slug, r.n) for r in cards().collect()) == [("a", 3), ("b", 5), ("c", 6)] and k.contracts.now().count() == 4


def test_links_are_worked_out_once_a_batch(world, tmp_path):
    k, docs = world
    schema = {"type": "object", "required": ["type"], "properties": {"type": {"const": "org@1.0.0"}}, "$$links": {"has member": {"required": ["slug"], "properties": {"slug": {"const": "user-ann"}}}}}
    live = k.live(schema, f"{tmp_path}/once", lambda df, b: None)
    stored = lambda: ["InMemoryTableScan" in df._jdf.queryExecution().executedPlan().toString() for df in (live.links.edges(), k.engine().edges)]
    during, entries = [], live._entries
    live._entries = lambda roots: (during.append(stored()), entries(roots))[1]
    live.process(k.contracts.changes(), 0)
    assert during == [[True, True]] and stored() == [False, False]
    assert {(r.root == docs["org-x"]["id"], r.id in {docs["user-ann"]["id"], docs["org-x"]["id"]}) for r in live._seen(k.contracts.spark, 1).collect()} == {(True, True), (True, False)}


def test_a_failing_live_query_starts_anew(world, tmp_path):
    k, docs = world
    heard, seen = [], []

    def emit(df, batch):
        if not heard:
            raise ValueError("lost")
        seen.append({(r.id, r.event) for r in df.collect()})

    live = k.live({"required": ["slug"], "properties": {"slug": {"const": "card-bob"}}}, f"{tmp_path}/f", emit)
    live.run(lambda: k.contracts.changes(streaming=True), lambda event, error: heard.append(event), delay=0)
    assert heard == ["error", "reconnect", "closed"]
    assert [{i for i, event in batch if event in ("insert", "update")} for batch in seen if batch] == [{docs["card-bob"]["id"]}]
    heard.clear()
    bad = k.live({"properties": {"slug": {"const": "card-bob"}}}, f"{tmp_path}/g", lambda df, batch: 1 / 0)
    with pytest.raises(changes.StreamingQueryException):
        bad.run(lambda: k.contracts.changes(streaming=True), lambda event, error: heard.append(event), retries=1, delay=0)
    assert heard == ["error", "reconnect", "error"]


def test_the_seen_set_is_put_together(world, tmp_path, monkeypatch):
    k, docs = world
    monkeypatch.setattr(changes, "DELTAS", 2)
    rows = k.contracts.changes()
    live = k.live({"required": ["type"], "properties": {"type": {"const": "card@1.0.0"}}}, f"{tmp_path}/p", lambda df, b: None)
    for batch in range(5):
        live.process(rows.where(F.col("id") == docs[("card-open", "card-org", "card-bob")[batch % 3]]["id"]), batch)
        seen = {r.id for r in live._seen(k.contracts.spark, batch + 1).collect()}
        assert seen == {docs[s]["id"] for s in ("card-open", "card-org", "card-bob")[: batch + 1]}
    assert len(list((tmp_path / "p" / "seen").iterdir())) <= 3 and len(list((tmp_path / "p" / "whole").iterdir())) == 1


def test_types_follow_the_store_and_writes_end_what_is_remembered(spark, tmp_path):
    from graphloom.sources import builtin

    k = Kernel(ContractStore(spark, f"{tmp_path}/s"), TypeRegistry(builtin.types(), builtin.relationships()))
    k.insert({"type": "type", "slug": "note", "data": {"schema": {"properties": {"data": {"required": ["n"]}}}}})
    follow = k.follow_types(f"{tmp_path}/types")
    run = lambda: follow.start(k.contracts.changes(streaming=True)).awaitTermination()
    with pytest.raises(UnknownCardType):
        k.insert({"type": "note", "slug": "x", "data": {"n": 1}})
    run()
    assert k.remembered("x@1.0.0") is None
    k.insert({"type": "note", "slug": "x", "data": {"n": 1}})
    assert k.remembered("x@1.0.0")["data"] == {"n": 1} and k.remembered("x@latest")["data"] == {"n": 1}
    k.patch("x@1.0.0", [{"op": "replace", "path": "/data/n", "value": 2}])
    assert k.remembered("x@1.0.0")["data"] == k.remembered("x@latest")["data"] == {"n": 2}
    k.patch("note@1.0.0", [{"op": "replace", "path": "/active", "value": False}])
    run()
    with pytest.raises(UnknownCardType):
        k.insert({"type": "note", "slug": "y", "data": {"n": 1}})
    assert k.unsafe_upsert({"type": "card", "slug": "z"})["slug"] == "z"


def test_dataset_counts_as_seen(world, tmp_path):
    k, docs = world
    events = []
    live = changes.LiveQuery(k.engine, {"required": ["slug"], "properties": {"slug": {"const": "card-gone"}, "active": {"const": False}}}, f"{tmp_path}/d", lambda df, b: events.append({(r.id, r.event) for r in df.collect()}))
    assert live.dataset().count() == 1
    k.patch("card-gone@1.0.0", [{"op": "replace", "path": "/active", "value": True}])
    live.process(k.contracts.changes(), 0)
    assert events == [{(docs["card-gone"]["id"], "unmatch")}]
    live.process(k.contracts.changes(), 0)
    assert events[1] == events[0]  # a batch that is run again gives the same events
    live.set_schema({"required": ["slug"], "properties": {"slug": {"const": "card-gone"}}})
    live.process(k.contracts.changes(), 1)
    assert events[-1] == {(docs["card-gone"]["id"], "insert")} or events[-1] == {(docs["card-gone"]["id"], "update")}


def test_types():
    r = TypeRegistry(TYPES)
    assert r.data_type("thread@1.0.0") == T.StructType([T.StructField("n", T.LongType())])
    assert spark_type({"type": ["string", "null"]}) == T.StringType() and spark_type({}) == T.VariantType() and spark_type({"type": "array", "items": {"type": "number"}}) == T.ArrayType(T.DoubleType())


def test_layout(spark, tmp_path):
    df = spark.createDataFrame([(str(i), f"s{i}", "a@1.0.0" if i % 2 else "b@1.0.0", f"The running dogs {i}") for i in range(20)], "id string, slug string, type string, text string")
    layout.write_contracts(df, f"{tmp_path}/c")
    back = spark.read.parquet(f"{tmp_path}/c")
    assert back.where("type = 'a@1.0.0'").count() == 10
    assert "PartitionFilters: [isnotnull(type" in back.where("type = 'a@1.0.0'")._jdf.queryExecution().executedPlan().toString()
    stored = layout.with_lexemes(df, "text")
    assert stored.where(layout.holds("lexemes", "dog runs")).count() == 20 and stored.where(layout.holds("lexemes", "the")).count() == 0


def test_merge(spark):
    assert merge({"a": {"b": 1, "c": 2}, "l": [1]}, {"a": {"b": 9, "d": 3}, "l": [2], "z": 0}) == {"a": {"b": 1, "c": 2, "d": 3}, "l": [1], "z": 0}
    df = spark.sql("""SELECT parse_json('{"a":{"x":1}}') AS p, parse_json('{"a":{"x":2,"y":3}}') AS q""")
    assert df.select(F.to_json(merged(F.col("p"), F.col("q"))).alias("m")).first().m == '{"a":{"x":1,"y":3}}'


def test_builtin_types_and_payloads(spark):
    from graphloom.operators.present import payloads
    from graphloom.sources import builtin

    r = TypeRegistry(builtin.types(), builtin.relationships())
    assert "link@1.0.0" in r.schemas and r.data_type("event@1.0.0")["actor"].dataType == T.StringType()
    df = spark.sql("SELECT 1 AS id, TIMESTAMP_NTZ '2024-01-02 03:04:05' AS at, CAST(NULL AS string) AS name, named_struct('v', array(named_struct('t', TIMESTAMP_NTZ '2024-01-01')), 'w', cast(array() AS array<int>)) AS links")
    assert payloads(df).first().payload == '{"id":1,"at":"2024-01-02T03:04:05.000Z","links":{"v":[{"t":"2024-01-01T00:00:00.000Z"}]}}'


def test_dispatcher_serves_several_queries(world, tmp_path):
    k, docs = world
    got = {}
    both = changes.Dispatcher()
    for name, slug in (("a", "card-open"), ("b", "card-org")):
        got[name] = []
        both.attach(name, changes.LiveQuery(k.engine, {"required": ["slug"], "properties": {"slug": {"const": slug}}}, f"{tmp_path}/{name}", lambda df, b, name=name: got[name].append({r.id for r in df.collect()})))
    both.start(k.contracts.changes(streaming=True), f"{tmp_path}/checkpoint").awaitTermination()
    assert got == {"a": [{docs["card-open"]["id"]}], "b": [{docs["card-org"]["id"]}]}
    assert k.engine().profile({"properties": {"slug": {"const": "card-open"}}, "required": ["slug"]})["rows"] == 1


def test_compaction_and_reset(spark, tmp_path):
    k = Kernel(ContractStore(spark, f"{tmp_path}/s"), TypeRegistry(TYPES, RELATIONSHIPS))
    k.insert({"type": "card", "slug": "one", "data": {"n": 1}})
    k.patch("one@1.0.0", [{"op": "replace", "path": "/data/n", "value": 2}])
    k.contracts.compact()
    k.insert({"type": "card", "slug": "two"})
    k.patch("one@1.0.0", [{"op": "replace", "path": "/data/n", "value": 3}])
    assert k.get("one@1.0.0")["data"] == {"n": 3} and k.contracts.now().count() == 2
    assert [r.op for r in k.contracts.changes().orderBy("seq").collect()] == ["insert", "update", "insert", "update"]
    k.contracts.reset()
    assert k.contracts.now().count() == 0 and k.contracts.changes().where("op = 'delete'").count() == 2
    k.insert({"type": "card", "slug": "one"})
    assert k.contracts.now().count() == 1
