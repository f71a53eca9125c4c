"""The filter language's corners."""

import math

import pytest

from lodeworks.plans import filters as L


@pytest.fixture(scope="module")
def rows(spark):
    schema = "id long, s string, n long, f double, b boolean, tags array<string>, geo struct<lat:double,lon:double>"
    return spark.createDataFrame(
        [
            (0, "Go Spark", 3, 3.0, True, ["red fox", "blue"], (0.0, 0.0)),
            (1, "", 5, math.nan, False, [], (10.0, 10.0)),
            (2, None, None, None, None, None, None),
            (3, "spark-plug", -1, math.inf, True, ["x"], (89.0, 179.0)),
        ],
        schema,
    )


def ids(df, tree, **more):
    return sorted(r["id"] for r in L.where(df, tree, **more).collect())


@pytest.mark.parametrize(
    "tree, expected",
    [
        ({}, [0, 1, 2, 3]),
        (L.and_(), [0, 1, 2, 3]),
        (L.or_(), []),
        (L.not_(L.eq("n", 3)), [1, 2, 3]),
        (L.ne("n", 3), [1, 3]),
        (L.eq("n", 3.0), []),  # kinds are strict for equality
        (L.gte("n", 3.0), [0, 1]),  # but not for order
        (L.eq("f", math.nan), []),
        (L.ne("f", 3.0), [1, 3]),
        (L.gt("f", 1), [0, 3]),
        (L.not_(L.gt("f", 1)), [1, 2]),
        (L.gt("s", "a"), [3]),
        (L.in_("n", [3, -1, "x"]), [0, 3]),
        (L.contains("tags", "blue"), [0]),
        (L.leaf("match", "s", "SPARK"), [0, 3]),
        (L.leaf("match", "s", " ,"), [0, 1, 3]),
        (L.leaf("match", "tags", "fox red"), [0]),
        (L.leaf("regex", "s", "^(?P<a>Go)"), [0]),
        (L.leaf("is_empty", "s"), [1, 2]),
        (L.leaf("is_empty", "tags"), [1, 2]),
        (L.leaf("is_empty", "nowhere"), [0, 1, 2, 3]),
        (L.eq("nowhere", 1), []),
        (L.leaf("is_null", "n"), []),
        (L.leaf("geo_radius", "geo", lat=0, lon=0, radius_m=1000), [0]),
        (L.leaf("geo_bounding_box", "geo", min_lat=-1, max_lat=20, min_lon=-1, max_lon=20), [0, 1]),
        (L.leaf("geo_polygon", "geo", polygon=[5, 5, 5, 20, 20, 20, 20, 5]), [1]),
    ],
)
def test_trees(rows, tree, expected):
    assert ids(rows, tree) == expected


def test_null_is_not_absent(rows):
    assert ids(rows, L.leaf("is_null", "n"), nulls="present") == [2]


@pytest.mark.parametrize(
    "tree",
    [
        {"op": "near", "field": "n"}, {"op": "eq", "value": 1}, {"op": "not", "filters": []}, L.leaf("in", "n", 3), L.leaf("eq", "n", [1]),
        L.leaf("regex", "s", "(?=x)"), L.leaf("regex", "s", "("), L.leaf("geo_radius", "geo", lat=0, lon=0, radius_m=-1),
        L.leaf("geo_bounding_box", "geo", min_lat=5, max_lat=1, min_lon=0, max_lon=1), L.leaf("geo_polygon", "geo", polygon=[1, 2, 3]), L.leaf("dt_gt", "n", "no time"),
    ],
)
def test_bad_trees(rows, tree):
    with pytest.raises(L.FilterError):
        L.where(rows, tree)


def tagged(kind, member, value):
    return {"kind": kind, member: value}


@pytest.mark.parametrize(
    "tree, expected",
    [
        ({"op": "and", "and": [{"op": "eq", "field": "n", "value": tagged("int", "int", 3)}]}, [0]),
        ({"op": "or", "or": [{"op": "eq", "field": "n", "value": tagged("int", "int", 3)}, {"op": "eq", "field": "b", "value": {"kind": "bool", "bool": False}}]}, [0, 1]),
        ({"op": "or", "or": []}, []),
        ({"op": "and"}, [0, 1, 2, 3]),
        ({"op": "and", "field": "", "value": {"kind": "none"}}, [0, 1, 2, 3]),
        ({"op": "not", "not": {"op": "in", "field": "s", "value": tagged("strings", "strs", ["", "Go Spark"])}, "value": {"kind": "none"}}, [2, 3]),
        ({"op": "eq", "field": "s", "value": {"kind": "string"}}, [1]),  # a zero value's member may be left out
        ({"op": "contains", "field": "tags", "value": tagged("string", "str", "blue")}, [0]),
        ({"op": "geo_radius", "field": "geo", "geo": {"radius_m": 1000}}, [0]),
        ({"op": "geo_bounding_box", "field": "geo", "geo": {"min_lat": -1, "max_lat": 20, "min_lon": -1, "max_lon": 20}}, [0, 1]),
        ({"op": "geo_polygon", "field": "geo", "geo": {"polygon": [5, 5, 5, 20, 20, 20, 20, 5]}}, [1]),
    ],
)
def test_trees_in_their_json_form(rows, tree, expected):
    import json

    assert ids(rows, json.dumps(tree)) == expected


@pytest.mark.parametrize(
    "tree",
    [
        {"op": "and", "or": []}, {"op": "or"}, {"op": "not"}, {"op": "not", "not": {}, "filters": []}, {"op": "and", "and": [], "filters": []}, {"op": "and", "children": []}, {"op": "and", "and": ["x"]},
        {"op": "eq", "field": "n", "value": {"kind": "number", "int": 1}}, {"op": "eq", "field": "n", "value": 1, "valeu": 2}, {"op": "geo_radius", "field": "geo", "geo": {"lat": 1}}, {"op": "geo_radius", "field": "geo", "geo": {"radius": 1}},
        {"op": "match", "field": "s", "value": 3}, "[1", "[1]", {"op": "is_null", "field": "n", "value": 3},
    ],
)
def test_bad_members(rows, tree):
    with pytest.raises(L.FilterError):
        L.where(rows, tree)


def test_payload_codec():
    from lodeworks.functions import payload as P

    for value, form in ((7, {"kind": "int", "int": 7}), (True, {"kind": "bool", "bool": True}), (2.5, {"kind": "float", "flt": 2.5}), ("a", {"kind": "string", "str": "a"}), ([1, 2], {"kind": "ints", "ints": [1, 2]}),
                        (["a"], {"kind": "strings", "strs": ["a"]}), ([0.5], {"kind": "floats", "flts": [0.5]}), (None, {"kind": "none"}), ({"lat": 1.0, "lon": 0.0}, {"kind": "geo", "lat": 1.0})):
        assert P.encode(value) == form and P.decode(form) == value
    assert P.decode({"kind": "int"}) == 0 and P.decode({"kind": "strings"}) == []
    for bad in ([], [True], [1, 2.0], {"a": 1}, object()):
        with pytest.raises(P.PayloadError):
            P.encode(bad)
    for bad in ({"int": 3}, {"kind": "integer"}, {"kind": "int", "integer": 3}):
        with pytest.raises(P.PayloadError):
            P.decode(bad)


def test_tagged_payloads(spark):
    from pyspark.sql import functions as F

    from lodeworks.functions import payload as P

    texts = ['{"a":{"kind":"int","int":3}}', '{"a":{"kind":"float","flt":3.5}}', '{"a":{"kind":"string","str":"3"}}', '{"a":{"kind":"none"}}', "{}", '{"a":{"kind":"strings","strs":["x y"]}}', '{"a":{"kind":"geo","lat":10}}', '{"a":{"kind":"string"}}']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("payload", P.from_json(F.col("t")))
    found = lambda tree: sorted(r["id"] for r in L.where_tagged(df, tree).collect())
    assert found(L.eq("a", 3)) == [0] and found(L.gte("a", 3)) == [0, 1] and found(L.eq("a", "3")) == [2] and found(L.ne("a", 3)) == [1, 2, 3, 5, 6, 7]
    assert found(L.not_(L.eq("a", 3))) == [1, 2, 3, 4, 5, 6, 7] and found(L.leaf("is_null", "a")) == [3] and found(L.leaf("is_empty", "a")) == [3, 4, 7]
    assert found(L.leaf("match", "a", "Y x")) == [5] and found(L.contains("a", "x y")) == [5] and found(L.in_("a", ["3", 3])) == [0, 2]
    assert found(L.leaf("geo_radius", "a", lat=10, lon=0, radius_m=10)) == [6] and found(L.leaf("regex", "a", "^x|^3")) == [2, 5]
    assert found({}) == list(range(8)) and found(L.leaf("dt_gt", "a", "1970-01-01T00:00:00.001Z")) == [0, 1]


def test_filters_of_other_forms(rows):
    assert ids(rows, L.from_equalities({"n": {"$gte": 3}, "b": True})) == [0] and ids(rows, L.from_equalities({"n": [3, -1]})) == [0, 3]
    assert ids(rows, L.from_conditions({"operator": "NOT", "conditions": [{"field": "meta.n", "operator": ">", "value": 0}]})) == [2, 3]
    for bad in (lambda: L.from_equalities({"n": {"$near": 1}}), lambda: L.from_conditions({"operator": "XOR", "conditions": []}), lambda: L.from_conditions({"field": "n", "operator": "~", "value": 1})):
        with pytest.raises(L.FilterError):
            bad()


def test_filter_reaches_the_scan(spark):
    df = L.where(spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_orderstatus"), L.and_(L.eq("o_orderstatus", "F")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan
    assert "o_totalprice" not in plan
