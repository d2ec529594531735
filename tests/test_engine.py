"""The query language against hand-written triples, through VARIANT, typed columns and plain Python; engine behaviour on small documents."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.errors import ElementAlreadyExists, InvalidLimit, InvalidPatch, InvalidRegularExpression, InvalidSchema, InvalidSlug, InvalidVersion, SchemaMismatch, UnknownCardType
from graphloom.functions import text
from graphloom.functions.formats import java_pattern
from graphloom.functions.merge import merge, merged
from graphloom.functions.versions import Version, parse_slug, parse_version
from graphloom.operators import authorization, links, patch, store
from graphloom.operators.links import Verb
from graphloom.operators.validate import valid
from graphloom.operators.views import view_schema
from graphloom.plans.schema import parse
from graphloom.sources import layout
from graphloom.sources.tables import contract, kind, store_variant
from graphloom.streaming import changes

#: schema, valid instances, invalid instances
TRIPLES = [
    ({"type": "integer"}, [1, 1.0, -3], [1.5, "1", True, None, [1], {}]),
    ({"type": ["number", "null"]}, [1, 2.5, None], ["x", True, []]),
    ({"type": "string"}, ["", "x"], [1, None, {}]),
    ({"type": "object"}, [{}, {"a": 1}], [[], "x", 1]),
    ({"const": "1"}, ["1"], [1, True, None, ["1"]]),
    ({"const": 1}, [1, 1.0], ["1", True, 2]),
    ({"const": False}, [False], [0, "false", None]),
    ({"const": None}, [None], [0, "", False]),
    ({"const": {"a": [1, {"b": 2}]}}, [{"a": [1, {"b": 2}]}], [{"a": [1]}, [], {"a": [1, {"b": 2}], "c": 1}]),
    ({"enum": [1, "a", None, [1]]}, [1, "a", None, [1]], [2, "b", [], True]),
    ({"minimum": 50}, [50, 60.5, "x", None, True, {}], [49.9, -1]),
    ({"type": "number", "minimum": 50}, [60, 60.5, 6e1], ["60", True, None, [60], {"a": 60}, 49]),
    ({"exclusiveMinimum": 1, "exclusiveMaximum": 3}, [2, 1.5, "x"], [1, 3]),
    ({"maximum": 3}, [3, "a"], [3.1]),
    ({"multipleOf": 0.1}, [2.5, 0, "x"], [0.25]),
    ({"multipleOf": 2}, [4, -2], [3, 2.5]),
    ({"minLength": 2, "maxLength": 3}, ["ab", "äöü", 5], ["a", "abcd"]),
    ({"pattern": "b$"}, ["ab", 3], ["ab\n", "ba"]),
    ({"pattern": "^a.c"}, ["abcd"], ["xabc"]),
    ({"regexp": "foo"}, ["foo", "xfoox", True], ["FOO", "abc"]),
    ({"regexp": {"pattern": "foo", "flags": "i"}}, ["foo", "FOO", True], ["abc"]),
    ({"pattern": "^[[:alpha:]]+$"}, ["abc"], ["ab1", ""]),
    ({"format": "email"}, ["a@b.co", 3], ["a@", "x"]),
    ({"format": "ipv6"}, ["::1", "1::8"], ["1::2::3", "12345::"]),
    ({"format": "date-time"}, ["2018-08-08T00:00:00Z"], ["2018-13-08T00:00:00Z", "x"]),
    ({"format": "date-time", "formatMaximum": "2019-08-08T00:00:00Z"}, ["2018-08-08T00:00:00.000Z", "2019-08-08 00:00:00.000+00", 5], ["2020-08-08T00:00:00.000Z", "2020-08-08 00:00:00.000+00"]),
    ({"format": "date-time", "formatMinimum": "2019-08-08T00:00:00Z"}, ["2020-08-08T00:00:00Z", "2019-08-08T00:00:00+05:00"], ["2018-08-08T00:00:00Z"]),
    ({"required": ["a"]}, [{"a": None}, {"a": 1, "b": 2}, 5, "x", []], [{}, {"b": 1}]),
    ({"properties": {"a": {"type": "string"}}}, [{}, {"a": "x"}, {"b": 1}, 3], [{"a": 1}, {"a": None}]),
    ({"required": ["a"], "properties": {"a": {"const": 1}}}, [{"a": 1}], [{}, {"a": 2}, {"a": None}]),
    ({"properties": {"a": False}}, [{}, {"b": 1}], [{"a": 1}, {"a": None}]),
    ({"required": ["a"], "properties": {"a": True}}, [{"a": None}, {"a": 0}], [{}]),
    ({"properties": {"a": {"properties": {"b": {"minimum": 2}}}}}, [{}, {"a": {}}, {"a": {"b": 2}}, {"a": 3}], [{"a": {"b": 1}}]),
    ({"minProperties": 1, "maxProperties": 2}, [{"a": 1}, {"a": None, "b": 2}, []], [{}, {"a": 1, "b": 2, "c": 3}]),
    ({"minItems": 1, "maxItems": 2}, [[1], [1, 2], {}], [[], [1, 2, 3]]),
    ({"items": [{"type": "integer"}, {"type": "string"}]}, [[], [1], [1, "a"], [1, "a", None], "x"], [["a"], [1, 2]]),
    ({"items": [{"type": "integer"}], "additionalProperties": False}, [[], [1]], [[1, 2], ["a"]]),
    ({"items": {"type": "string", "pattern": "^a"}}, [[], ["a", "ab"], 3], [["b"], ["a", 1], [None]]),
    ({"items": False}, [[]], [[1]]),
    ({"contains": {"minimum": 5}}, [[1, 7], ["x"], 3], [[], [1, 2]]),
    ({"contains": {"const": "x"}}, [["x", 1]], [["y"], [], [["x"]]]),
    ({"contains": {"required": ["name"], "properties": {"name": {"const": "z"}}}}, [[{"name": "z"}, {"name": "y"}], [5]], [[{"name": "y"}], [{}], []]),
    ({"allOf": [{"minimum": 1}, {"maximum": 3}, True]}, [2, "x"], [0, 4]),
    ({"anyOf": [{"const": 1}, {"anyOf": [{"type": "string"}, False]}]}, [1, "x"], [2, None]),
    ({"oneOf": [{"minimum": 2}, {"maximum": 3}]}, [1, 4], [2, 3, "x"]),
    ({"not": {"type": "string"}}, [1, None, []], ["x"]),
    ({"not": {"required": ["a"], "properties": {"a": {"const": 1}}}}, [{}, {"a": 2}, {"b": 1}], [{"a": 1}, 5]),
    ({"if": {"type": "number"}, "then": {"minimum": 5}, "else": {"type": "string"}}, [5, "x"], [4, None, {}]),
    ({"if": {"required": ["a"]}, "then": {"required": ["b"]}}, [{}, {"a": 1, "b": 2}, 5], [{"a": 1}]),
    ({"title": "t", "description": "d", "examples": [1]}, [1, "x", None], []),
    (True, [1, None], []),
    (False, [], [1, None, {}]),
    ({"type": "string", "fullTextSearch": {"term": "running dogs"}}, ["a dog ran while running", "Running the dog"], ["dog", "", "cats run"]),
    ({"fullTextSearch": {"term": "deep word"}}, [{"a": {"b": ["some words"]}, "c": "deep"}], [{"a": "word"}, {"word": "deep"}]),
    ({"properties": {"a'b": {"const": 1}, 'q"x': {"const": 2}, "d.e; DROP TABLE": {"const": 3}}}, [{"a'b": 1, 'q"x': 2, "d.e; DROP TABLE": 3}, {}], [{"a'b": 2}, {'q"x': 1}, {"d.e; DROP TABLE": 1}]),
]


def test_triples_in_python():
    for schema, good, bad in TRIPLES:
        for x in good:
            assert valid(schema, x), (schema, x)
        for x in bad:
            assert not valid(schema, x), (schema, x)


@pytest.mark.parametrize("wrapped", [False, True])
def test_triples_through_variant(spark, wrapped):
    rows, n = [], 0
    for t, (_, good, bad) in enumerate(TRIPLES):
        for x, ok in [*((x, True) for x in good), *((x, False) for x in bad)]:
            rows.append((n, t, json.dumps({"wrapper": {"x": x}} if wrapped else {"x": x}), ok))
            n += 1
    df = spark.createDataFrame(rows, "id long, t int, j string, ok boolean").cache()
    tests = None
    for t, (schema, _, _) in enumerate(TRIPLES):
        inner = {"required": ["x"], "properties": {"x": schema}}
        data = {"properties": {"wrapper": inner}, "required": ["wrapper"]} if wrapped else inner
        if schema is False:
            data = {"required": ["x"], "properties": {"x": {"not": True}}}
        docs = contract(df.where(F.col("t") == t), "doc", F.col("id"), data=F.parse_json("j"))
        found = Engine(spark, docs).query({"required": ["data"], "properties": {"data": data}}, limit=None).select("id")
        tests = found if tests is None else tests.unionByName(found)
    got = {r.id for r in tests.collect()}
    wrong = [(TRIPLES[t][0], j, ok) for i, t, j, ok in rows if (i in got) != ok]
    assert not wrong


TYPED = "n long, x double, s string, b boolean, l array<string>, o struct<a:long,c:string>, m map<string,long>, ts timestamp_ntz"


def typed_rows(seed=1):
    r = random.Random(seed)
    pick = lambda *xs: None if r.random() < 0.2 else r.choice(xs)
    return [(i, pick(0, 1, 5, 7), pick(1.0, 2.5, 7.0), pick("a", "abc", "xb"), pick(True, False), pick([], ["a"], ["a", "xb", "c"]), pick({"a": 1, "c": None}, {"a": None, "c": "z"}), pick({}, {"a": 3}, {"k": 1, "a": 9}), None) for i in range(120)]


def json_of(row):
    doc = {k: v for k, v in zip(["n", "x", "s", "b", "l", "o", "m"], row[1:8], strict=True) if v is not None}
    if "o" in doc:
        doc["o"] = {k: v for k, v in doc["o"].items() if v is not None}
    return doc


def random_schema(r, depth=0):
    leaf = [
        lambda: {"type": r.choice(["integer", "number", "string", "boolean", "array", "object", "null", ["string", "number"]])},
        lambda: {"const": r.choice([1, 7.0, "a", True, ["a"], {"a": 1}])},
        lambda: {"enum": r.sample([0, 1, 2.5, "abc", "xb", False], 3)},
        lambda: {r.choice(["minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"]): r.choice([1, 2.5, 5])},
        lambda: {"multipleOf": r.choice([2, 0.5])},
        lambda: {"minLength": r.randint(0, 3), "maxLength": r.randint(1, 3)},
        lambda: {"pattern": r.choice(["^a", "b$", "."])},
        lambda: {"minItems": r.randint(0, 2)},
        lambda: {"items": {"pattern": "a"}},
        lambda: {"contains": {"const": r.choice(["a", "c", 5])}},
        lambda: {"minProperties": r.randint(0, 2), "maxProperties": r.randint(0, 2)},
        lambda: {"properties": {"a": {"minimum": r.choice([1, 2, 5])}}, **({"required": ["a"]} if r.random() < 0.5 else {})},
        lambda: {"required": ["c"]},
    ]
    if depth > 1 or r.random() < 0.6:
        return r.choice(leaf)()
    sub = lambda: random_schema(r, depth + 1)
    return r.choice([lambda: {"not": sub()}, lambda: {"allOf": [sub(), sub()]}, lambda: {"anyOf": [sub(), sub()]}, lambda: {"oneOf": [sub(), sub()]}, lambda: {"if": sub(), "then": sub(), "else": sub()}])()


def test_random_schemas_typed_and_variant_agree_with_python(spark):
    rows = typed_rows()
    typed = spark.createDataFrame(rows, f"id long, {TYPED}")
    fields = ["n", "x", "s", "b", "l", "o", "m"]
    variants = spark.createDataFrame([(row[0], json.dumps(json_of(row))) for row in rows], "id long, j string")
    engines = [
        Engine(spark, contract(typed, "doc", F.col("id"), data=F.struct(*fields)).cache()),
        Engine(spark, contract(variants, "doc", F.col("id"), data=F.parse_json("j")).cache()),
    ]
    r = random.Random(12)
    cases = []
    for _ in range(60):
        props = {f: random_schema(r) for f in r.sample(fields, r.randint(1, 2))}
        schema = {"type": "object", "properties": props, "required": r.sample(list(props), r.randint(0, len(props)))}
        cases.append({"not": schema} if r.random() < 0.2 else schema)
    for n, engine in enumerate(engines):
        out = None
        for c, schema in enumerate(cases):
            found = engine.query({"required": ["data"], "properties": {"data": schema}}, limit=None).select("id", F.lit(c).alias("c"))
            out = found if out is None else out.unionByName(found)
            if c % 20 == 19 or c == len(cases) - 1:
                got = {(x.c, x.id) for x in out.collect()}
                for k in range(c - c % 20, c + 1):
                    want = {row[0] for row in rows if valid(cases[k], json_of(row))}
                    assert {i for kk, i in got if kk == k} == want, (n, cases[k])
                out = None


def test_bad_schemas_and_limits(spark):
    for bad in ({"foo": 1}, {"type": "x"}, {"$ref": "#"}, {"enum": []}, {"format": "nope"}, {"minimum": "1"}, {"properties": {"a": {"uniqueItems": True}}}, {"formatMaximum": "x"}, {"items": 5}, 3):
        with pytest.raises(InvalidSchema):
            parse(bad)
    with pytest.raises(InvalidSchema, match="properties/a"):
        parse({"properties": {"a": {"patternProperties": {}}}})
    for bad in ("(", "[a", "[[:nope:]]"):
        with pytest.raises(InvalidRegularExpression):
            parse({"pattern": bad})
    assert java_pattern(r"a$\y[$]") == r"a\z\b[$]"
    e = office(spark)
    for limit in (-1, 1001, 1.5, "3", True):
        with pytest.raises(InvalidLimit):
            e.query({}, limit=limit)
    with pytest.raises(InvalidLimit):
        e.query({}, skip=-1)
    assert e.query({"properties": {"type": {"const": kind("office")}}}, limit=0).count() == 0
    with pytest.raises(InvalidSchema):
        e.query({"properties": {"type": {"const": kind("office")}}, "$$links": {"unknown verb": {}}})


def test_deep_schema(spark):
    schema = {"minimum": 1}
    for _ in range(60):
        schema = {"anyOf": [schema, {"not": {"type": "number"}}]}
    df = contract(spark.range(4), "doc", F.col("id"), data=F.struct("id"))
    assert Engine(spark, df).query({"properties": {"data": {"properties": {"id": schema}}}}).count() == 3


def office(spark):
    offices = contract(spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id long, n string"), "office", F.col("id"), F.col("n"))
    workers = [(10, 1, True, 0), (11, 1, False, 1), (12, 2, False, 2), (13, None, True, 3), (14, 1, True, 4)]
    w = spark.createDataFrame(workers, "id long, office long, stressed boolean, idx int")
    edges = w.where("office is not null").select(F.col("id").alias("from_id"), F.col("office").alias("to_id"))
    inverse = edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    edges = edges.unionByName(edges.limit(1))  # an edge that is there twice counts once
    verbs = [Verb("works at", kind("worker"), kind("office"), edges=edges), Verb("has worker", kind("office"), kind("worker"), edges=inverse)]
    return Engine(spark, {kind("office"): offices, kind("worker"): contract(w, "worker", F.col("id"))}, verbs)


def of(slug, **k):
    return {"type": "object", "properties": {"type": {"const": kind(slug)}, **k.pop("properties", {})}, **k}


STRESSED = of("worker", properties={"data": {"required": ["stressed"], "properties": {"stressed": {"const": True}}}})


def test_links_by_place(spark):
    e = office(spark)
    ids = lambda schema, **k: [r.id for r in e.query(schema, **k).orderBy("id").collect()]
    assert ids(of("office", **{"$$links": {"has worker": STRESSED}})) == [1]
    assert ids(of("office", **{"$$links": {"has worker": {}}})) == [1, 2]
    assert ids(of("office", **{"not": {"$$links": {"has worker": STRESSED}}})) == [2, 3]
    assert ids(of("office", anyOf=[{"properties": {"name": {"const": "C"}}}, {"$$links": {"has worker": STRESSED}}])) == [1, 3]
    assert ids(of("worker", **{"$$links": {"works at": of("office", **{"$$links": {"has worker": STRESSED}})}})) == [10, 11, 14]
    rows = {r.id: r.links["has worker"] for r in e.query(of("office", anyOf=[{"$$links": {"has worker": STRESSED}}, True])).collect()}
    assert {k: [w.id for w in v] for k, v in rows.items()} == {1: [10, 14], 2: [], 3: []}


def test_linked_order_skip_limit_and_nesting(spark):
    e = office(spark)
    r = e.query(of("office", **{"$$links": {"has worker": of("worker", **{"$$links": {"works at": {"additionalProperties": False, "required": ["name"]}}})}}), links={"has worker": {"sort_by": ["data", "idx"], "sort_dir": "desc", "skip": 1, "limit": 1}}, sort_by="name").collect()
    assert [(x.id, [w.id for w in x.links["has worker"]]) for x in r] == [(1, [11]), (2, [])]
    assert r[0].links["has worker"][0].links["works at"][0].asDict() == {"name": "A"}
    wide = e.query(of("worker", **{"$$links": {"works at": {}}})).where("id = 10").first()
    assert len(wide.links["works at"]) == 1


def test_plans_push_filters_and_use_semi_joins(spark, tmp_path):
    office(spark).tables[kind("worker")].select("id", "data").write.parquet(f"{tmp_path}/w")
    df = spark.read.parquet(f"{tmp_path}/w")
    w = df.select("id", F.lit(kind("worker")).alias("type"), "data")
    e = Engine(spark, {kind("worker"): w, kind("office"): office(spark).tables[kind("office")]}, [Verb("works at", kind("worker"), kind("office"), "data.office", "id")])
    plan = e.query(of("worker", properties={"data": {"type": "object", "required": ["idx"], "properties": {"idx": {"type": "integer", "minimum": 2}}}}, required=["data"], **{"$$links": {"works at": {}}}), limit=None).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "GreaterThanOrEqual(data.idx,2)" in plan and "stressed" not in plan


def test_projection(spark):
    rows = [(1, "x", 5, "u"), (2, "y", 6, "v")]
    df = contract(spark.createDataFrame(rows, "id long, a string, b long, c string"), "doc", F.col("id"), data=F.struct("a", "b", "c"))
    e = Engine(spark, df)
    assert e.query({"additionalProperties": False}).columns == []
    assert e.query({}).columns == df.columns
    one = e.query({"additionalProperties": False, "required": ["id"], "properties": {"data": {"additionalProperties": False, "properties": {"a": {"const": "x"}}, "required": ["c"]}}}).first()
    assert one.asDict(True) == {"id": 1, "data": {"a": "x", "c": "u"}}
    role = {"additionalProperties": False, "properties": {"id": True, "data": {"additionalProperties": False, "properties": {"b": True}}}}
    seen = e.query({"properties": {"data": {"properties": {"a": {"const": "x"}}, "required": ["a"]}}}, permission=role).collect()
    assert [r.asDict(True) for r in seen] == [{"id": 1, "data": {"b": 5}}]
    branch = e.query({"additionalProperties": False, "required": ["id"], "anyOf": [{"properties": {"id": {"const": 1}, "data": {"additionalProperties": False, "required": ["a"]}}}, {"required": ["slug"], "properties": {"id": {"const": 2}}}]}).orderBy("id").collect()
    assert [(r.id, r.slug, r.data.a) for r in branch] == [(1, None, "x"), (2, "doc-2", None)]


def test_variant_projection_keeps_missing_keys_missing(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":2}'), (2, '{"b":3}')], "id long, j string")
    e = Engine(spark, contract(df, "doc", F.col("id"), data=F.parse_json("j")))
    out = e.query({"additionalProperties": False, "required": ["id"], "properties": {"data": {"additionalProperties": False, "properties": {"a": True}}}})
    assert [(r.id, r.d) for r in out.select("id", F.to_json("data").alias("d")).orderBy("id").collect()] == [(1, '{"a":1}'), (2, "{}")]


def test_versions_order(spark):
    names = ["1.0.0-beta", "1.0.0", "1.0.0-alpha+001", "1.0.0-beta+001", "1.0.1", "1.1.0"]
    df = contract(spark.createDataFrame([(i, v) for i, v in enumerate(names)], "id long, v string"), "doc", F.col("id")).withColumns({"version": F.col("data.v"), "slug": F.lit("doc")})
    e = Engine(spark, df)
    order = lambda d: [r.version for r in e.query({}, sort_by="version", sort_dir=d).collect()]
    assert order("asc") == ["1.0.0", "1.0.1", "1.1.0", "1.0.0-alpha+001", "1.0.0-beta", "1.0.0-beta+001"]
    assert order("desc") == ["1.1.0", "1.0.1", "1.0.0", "1.0.0-alpha+001", "1.0.0-beta+001", "1.0.0-beta"]
    assert e.cached("doc@latest")["version"] == "1.1.0" and e.cached("doc@1.0.0-beta")["id"] == 0 and e.cached("none@1.0.0") is None
    assert [e.get_many([0, 5, 99]).count(), e.get_many([]).count()] == [2, 0]


def test_version_texts():
    assert parse_version("1.2.3-alpha+rev1") == Version(1, 2, 3, "alpha", "rev1") and parse_version("1") == Version(1) and parse_version("1.1") == Version(1, 1)
    assert parse_slug("a-b@latest") == ("a-b", None) and parse_slug("a@-alpha+r")[1] == Version(prerelease="alpha", build="r") and parse_slug("a@+rev1")[1].build == "rev1"
    for bad in ("x", "", "1.2.3.4"):
        with pytest.raises(InvalidVersion):
            parse_version(bad)
    for bad in ("a", "a_b@1.0.0", "@1.0.0"):
        with pytest.raises(InvalidSlug):
            parse_slug(bad)


def test_markers(spark):
    cases = [([], 1), (["org-x", "user-a"], 1), (["user-a"], 1), (["org-x+user-a"], 1), (["foo+user-a"], 1), (["org-x+user-f"], 1), (["user-f"], 0), (["user-a", "user-f"], 0), (["org-x", "user-f"], 0), (["org-x", "user-f+user-b"], 0), (["user-ab"], 0)]
    df = contract(spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "id long, m array<string>"), "doc", F.col("id")).withColumn("markers", F.col("data.m"))
    schema = authorization.marker_schema("user-a", ["org-x"])
    got = {r.id for r in Engine(spark, df).query({}, permission=schema).collect()}
    assert got == {i for i, (_, ok) in enumerate(cases) if ok}
    assert {r.id for r in df.where(authorization.markers_visible(F.col("markers"), ["user-a", "org-x"])).collect()} == got
    assert all(valid(schema, {"markers": m}) == bool(ok) for m, ok in cases) and authorization.marker_schema("user-admin", []) is True


def test_authorization_reaches_linked_documents():
    out = authorization.authorize({"anyOf": [{"$$links": {"v": {"$$links": {"w": {}}}}}, {"properties": {"$$links": {"const": 1}}}]}, {"properties": {"active": {"const": True}}})
    inner = out["allOf"][1]["anyOf"][0]["$$links"]["v"]["allOf"]
    assert inner[0] == {"properties": {"active": {"const": True}}} and inner[1]["$$links"]["w"]["allOf"][0] == inner[0]
    assert authorization.evaluate({"const": {"$eval": "user.data.roles[1]"}, "$id": "x"}, {"user": {"data": {"roles": ["a", "b"]}}}) == {"const": "b"}
    assert view_schema({"data": {}}) is None and view_schema({"data": {"anyOf": [{"schema": {"a": 1}}]}}) == {"anyOf": [{"a": 1}]}


def test_patches():
    doc = {"id": "i", "slug": "s", "data": {"n": 1, "l": [1, 2], "a/b": 0}}
    ops = [{"op": "add", "path": "/data/x", "value": 5}, {"op": "replace", "path": "/data/n", "value": 2}, {"op": "remove", "path": "/data/l/0"}, {"op": "add", "path": "/data/l/-", "value": 9}, {"op": "move", "from": "/data/x", "path": "/data/y"}, {"op": "copy", "from": "/data/y", "path": "/data/z"}, {"op": "test", "path": "/data/z", "value": 5}, {"op": "replace", "path": "/data/a~1b", "value": 3}, {"op": "replace", "path": "/id", "value": "other"}]
    assert patch.apply(doc, ops) == {"id": "i", "slug": "s", "data": {"n": 2, "l": [2, 9], "a/b": 3, "y": 5, "z": 5}} and doc["data"]["n"] == 1
    for bad in ({"op": "replace", "path": "/data/none", "value": 1}, {"op": "remove", "path": "/x"}, {"op": "add", "path": "/data/q/r", "value": 1}, {"op": "test", "path": "/data/n", "value": "1"}, {"op": "fly", "path": "/data"}, {"op": "add"}, {"op": "remove", "path": "/data/l/7"}):
        with pytest.raises(InvalidPatch):
            patch.apply(doc, [{"op": "replace", "path": "/data/n", "value": 7}, bad])
    new, seen, changed = patch.patched(doc, {"data": {"n": 1}}, [{"op": "replace", "path": "/data/n", "value": 1}], {"type": "object"})
    assert not changed and new == doc and seen == {"data": {"n": 1}}
    with pytest.raises(SchemaMismatch):
        patch.patched(doc, doc, [{"op": "replace", "path": "/data/n", "value": "x"}], {"properties": {"data": {"properties": {"n": {"type": "number"}}}}})


def test_store(spark):
    doc = store.defaults({"type": "card", "name": "The Quick: brown fox"})
    assert doc["slug"].startswith("card-quick-brown-fox-") and doc["version"] == "1.0.0" and doc["active"] is True and doc["type"] == "card@1.0.0"
    types = {"card@1.0.0": {"properties": {"data": {"properties": {"n": {"type": "number"}}}}}}
    assert store.check({"type": "card", "data": {"n": 1}}, types)["data"] == {"n": 1}
    for bad, error in (({"type": "card", "data": {"n": "x"}}, SchemaMismatch), ({"type": "nope"}, UnknownCardType), ({"type": "card", "slug": "A_b"}, InvalidSlug), ({"type": "card", "slug": "a" * 256}, InvalidSlug)):
        with pytest.raises(error):
            store.check(bad, types)
    now = spark.createDataFrame([(1, "a", "1.0.0", "x", None), (2, "b", "1.0.0", "y", None)], "id long, slug string, version string, name string, updated_at string")
    with pytest.raises(ElementAlreadyExists):
        store.insert(now, now.limit(1))
    with pytest.raises(ElementAlreadyExists):
        store.insert(now, spark.createDataFrame([(8, "q", "1.0.0"), (9, "q", "1.0.0")], "id long, slug string, version string"))
    new = spark.createDataFrame([(7, "a", "1.0.0", "new"), (8, "a", "2.0.0", "other")], "id long, slug string, version string, name string")
    out = {(r.id, r.slug, r.version, r.name, r.updated_at) for r in store.replace(now, new, "t").collect()}
    assert out == {(1, "a", "1.0.0", "new", "t"), (2, "b", "1.0.0", "y", None), (8, "a", "2.0.0", "other", None)}


def test_links_tables(spark):
    schema = "id long, name string, active boolean, created_at string, data struct<inverseName:string,from:struct<id:long>,to:struct<id:long>>"
    rows = [(1, "v", True, "2", ("w", (10,), (20,))), (2, "v", False, "1", ("w", (10,), (21,))), (3, "v", True, "3", ("w", (10,), (22,)))]
    df = spark.createDataFrame(rows, schema)
    assert {(r.forward, r.from_id, r.name, r.to_id) for r in links.edges_of(df).collect()} == {(True, 10, "v", 20), (False, 20, "w", 10), (True, 10, "v", 22), (False, 22, "w", 10)}
    assert {r.id: r.linked_at for r in links.linked_at(df).collect()} == {10: {"v": "1"}, 20: {"w": "2"}, 21: {"w": "1"}, 22: {"w": "3"}}


def test_text_search():
    assert text.lexemes("The Lorem ipsum's dolor, running ponies!") == {"lorem", "ipsum", "dolor", "run", "poni"}
    pairs = "consigned consign consistency consist knightly knight generously generous communication communic happy happi dying die skies sky relational relat hopping hop hoping hope".split()
    assert [text.stem(a) for a in pairs[::2]] == pairs[1::2]
    assert text.matches(F.lit("x"), "the of") is False


def test_stored_variant_filters_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(i, json.dumps({"k": i})) for i in range(50)], "id long, data string")
    stored = store_variant(df, f"{tmp_path}/v")
    docs = stored.select("id", F.lit(kind("doc")).alias("type"), "data")
    q = Engine(spark, {kind("doc"): docs}).query({"required": ["data"], "properties": {"data": {"type": "object", "required": ["k"], "properties": {"k": {"type": "number", "minimum": 40}}}}}, limit=None).select("id")
    assert q.count() == 10


def test_live_query(spark, tmp_path):
    log = f"{tmp_path}/log"
    state = {}
    events = []

    def engine():
        docs = spark.createDataFrame([(i, s) for i, s in state.items()] or [], "id string, status string")
        return Engine(spark, {kind("doc"): contract(docs, "doc", F.col("id"))})

    schema = of("doc", properties={"data": {"required": ["status"], "properties": {"status": {"const": "open"}}}})
    live = changes.LiveQuery(engine, schema, f"{tmp_path}/state", lambda df, b: events.append(sorted((r.id, r.event) for r in df.collect())))
    seq = [0]

    def write(*ops):
        rows = []
        for id_, status, op in ops:
            seq[0] += 1
            state.pop(id_, None) if op == "delete" else state.update({id_: status})
            rows.append((seq[0], id_, op, kind("doc")))
        spark.createDataFrame(rows, "seq long, id string, op string, type string").write.mode("append").parquet(log)
        q = live.start(spark.readStream.schema("seq long, id string, op string, type string").parquet(log))
        q.awaitTermination()

    write(("a", "open", "insert"), ("b", "closed", "insert"), ("c", "open", "insert"))
    write(("a", "closed", "update"), ("b", "open", "update"), ("c", "open", "update"))
    write(("c", None, "delete"), ("b", "closed", "update"), ("b", "open", "update"), ("x", "closed", "insert"), ("a", "closed", "update"))
    assert events == [[("a", "insert"), ("c", "insert")], [("a", "unmatch"), ("b", "update"), ("c", "update")], [("b", "update"), ("c", "delete")]]
    live.close()


def test_catalog_matches_duckdb(spark):
    """A few registered queries end to end; the driver compares all of them."""
    duckdb = pytest.importorskip("duckdb")
    from graphloom.plans import catalog

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("flagship", "k08_multiple_of", "k21_contains", "j05_nested_links", "j06_link_in_items", "l03_version_sort", "v03_variant_vacuous", "p04_branch_select", "s12_linked_at", "z04_authorized_links"):
        got = catalog.queries()[name](spark, d)
        columns = sorted(got.columns)
        want = c.sql(catalog.oracle_sql()[name]).fetchall()
        names = [x[0] for x in c.description] if c.description else None
        rel = c.sql(catalog.oracle_sql()[name])
        assert sorted(rel.columns) == columns, name
        order = [rel.columns.index(x) for x in columns]
        assert sorted(str(tuple(r[i] for i in order)) for r in want) == sorted(str(tuple(r[x] for x in columns)) for r in got.collect()), name
        del names


def test_large_variant_numbers_are_compared_exactly(spark):
    """Many whole numbers and decimals share one double."""
    big = 1 << 53
    values = [big - 1, big, big + 1, big + 2, -big - 1, "0.1", "5.00000000000000001", "5.0", "9.007199254740992e15", 10**25 + 1, 10**25, (1 << 63) - 1]
    df = spark.createDataFrame([(i, str(v)) for i, v in enumerate(values)], "id long, j string").select("id", F.lit("a@1.0.0").alias("type"), F.parse_json(F.concat(F.lit('{"x":'), "j", F.lit("}"))).alias("data"))
    e = Engine(spark, {"a@1.0.0": df})
    exact = [Decimal(str(v)) for v in values]
    tests = {"const": lambda v, x: v == x, "minimum": lambda v, x: v >= x, "maximum": lambda v, x: v <= x, "exclusiveMinimum": lambda v, x: v > x, "exclusiveMaximum": lambda v, x: v < x}
    for x in (big, big + 1, -big - 1, 5, 0.1, 10**25, (1 << 63) - 1):
        for word, test in tests.items():
            got = {r.id for r in e.query({"properties": {"type": {"const": "a@1.0.0"}, "data": {"properties": {"x": {word: x}}}}}, limit=None).collect()}
            assert got == {i for i, v in enumerate(exact) if test(v, Decimal(str(x)))}, (word, x)
    got = {r.id for r in e.query({"properties": {"type": {"const": "a@1.0.0"}, "data": {"properties": {"x": {"type": "integer"}}}}}, limit=None).collect()}
    assert got == {i for i, v in enumerate(exact) if v == v.to_integral_value()}


def test_merges_in_builtin_functions_equal_plain_python(spark):
    r = random.Random(4)

    def value(depth):
        n = r.randint(0, 5)
        if depth and n > 1:
            return {k: value(depth - 1) for k in r.sample("abcd", r.randint(0, 3))}
        return r.choice([None, 1, "x", [1, {"a": 2}], True, 2.5])

    rows = [(json.dumps(value(4)), json.dumps(value(4))) for _ in range(60)]
    df = spark.createDataFrame(rows, "x string, y string").select("x", "y", F.to_json(merged(F.parse_json("x"), F.parse_json("y"))).alias("m"))
    for row in df.collect():
        assert json.loads(row.m or "null") == merge(json.loads(row.x), json.loads(row.y)), row


def test_untyped_queries_are_filtered_by_type(spark, tmp_path):
    for n, t in (("a", "x long, y string"), ("b", "x string"), ("c", "x long")):
        spark.createDataFrame([(7, "q")] if n == "a" else [("7",)] if n == "b" else [(9,)], t).write.parquet(f"{tmp_path}/{n}")
    tables = {f"{n}@1.0.0": contract(spark.read.parquet(f"{tmp_path}/{n}"), n, F.lit(i)) for i, n in enumerate("abc")}
    e = Engine(spark, tables)
    df = e.query({"required": ["data"], "properties": {"data": {"required": ["x"], "properties": {"x": {"type": "number", "minimum": 8}}}}})
    assert [(r.id, r.type) for r in df.collect()] == [("2", "c@1.0.0")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    # Both numbers reach their scans; x of b is a text, so b is not read at all.
    assert plan.count("GreaterThanOrEqual(x,8)") == 2 and "/b]" not in plan
    got = e.query({"properties": {"data": {"properties": {"x": {"minimum": 8}}}}}, sort_by=["data", "x"])
    assert [r.id for r in got.collect()] == ["1", "2"]


def test_only_stored_columns_of_children_are_moved_to_the_parents_test(spark):
    orders = contract(spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "key long, total long"), "order", F.col("key"))
    lines = contract(spark.createDataFrame([(10, 1), (11, 3), (12, 3), (13, 4), (14, None)], "line long, of long"), "lineitem", F.col("line"))
    e = Engine(spark, {kind("order"): orders, kind("lineitem"): lines}, [Verb("has line", kind("order"), kind("lineitem"), "id", "data.of")])
    schema = {"properties": {"type": {"const": kind("order")}, "data": {"required": ["total"], "properties": {"total": {"minimum": 6}}}}, "anyOf": [{"$$links": {"has line": {"properties": {"type": {"const": kind("lineitem")}}}}}, True]}
    found = e.query(schema, limit=None)
    assert sorted((r.id, [x.id for x in r.links["has line"]]) for r in found.collect()) == [(2, []), (3, [11, 12])]

    def joins(plan):
        below = [plan.children().apply(i) for i in range(plan.children().length())]
        here = [below[0].output().mkString(",")] if plan.nodeName() == "Join" and "LeftSemi" in plan.toString().split("\n")[0] else []
        return here + [x for p in below for x in joins(p)]

    assert any("of#" in x and "slug" not in x and "data" not in x for x in joins(found._jdf.queryExecution().optimizedPlan()))


def test_bounded_parents_bound_their_linked_documents(spark):
    plain = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 10).alias("up"))
    tables = {f"{n}@1.0.0": contract(plain, n, F.col("k")) for n in "abc"}
    e = Engine(spark, tables, [Verb("has", "a@1.0.0", "b@1.0.0", "id", "data.up"), Verb("has", "b@1.0.0", "c@1.0.0", "id", "data.up")])
    schema = {"properties": {"type": {"const": "a@1.0.0"}}, "$$links": {"has": {"$$links": {"has": True}}}}
    short, whole = (e.query(schema, limit=n).collect() for n in (1000, None))
    assert [r.id for r in short] == list(range(10)) and sorted(map(str, short)) == sorted(map(str, whole))
    assert [[c.id for c in b.links["has"]] for b in short[3].links["has"]] == [[3, 13, 23, 33, 43]]


def test_searches_use_stored_stems(spark, tmp_path):
    texts = ["The licenses of this version", "license versions", "a licensed thing", None, "", "Version licensing and more"]
    plain = contract(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "a", F.col("k"))
    layout.with_search(plain, "data.text").write.parquet(f"{tmp_path}/a")
    schema = {"properties": {"type": {"const": "a@1.0.0"}, "data": {"required": ["text"], "properties": {"text": {"fullTextSearch": {"term": "license version"}}}}}, "required": ["data"]}
    want, got = (Engine(spark, {"a@1.0.0": t}).query(schema) for t in (plain, spark.read.parquet(f"{tmp_path}/a")))
    assert got.columns == want.columns and got.orderBy("id").collect() == want.orderBy("id").collect() and [r.id for r in got.orderBy("id").collect()] == [0, 1, 5]
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (want, got)]
    assert "ArrowEvalPython" in plans[0] and "ArrowEvalPython" not in plans[1]


def test_eval():
    context = {"user": {"slug": "user-ann", "data": {"roles": ["a", "b", "c"], "n": 3}}}
    found = lambda text: authorization.evaluate({"x": {"$eval": text}}, context)["x"]
    assert found("user.slug") == "user-ann" and found("user.data.roles[1]") == "b" and found("user['slug'] + '-x!&&'") == "user-ann-x!&&"
    assert found("user.data.roles[1:]") == ["b", "c"] and found("[1, -2, true, null]") == [1, -2, True, None]
    assert found("'a' in user.data.roles && !(user.data.n < 3)") is True and found("user.data.n * 2 == 6 || false") is True and found("user.data.n != 3") is False
    assert authorization.evaluate({"$id": "x", "enum": [{"$eval": "user.data.n"}]}, context) == {"enum": [3]}
    for bad in ("f(user)", "user.", "lambda: 1", "user if true else 1"):
        with pytest.raises(InvalidSchema):
            found(bad)
