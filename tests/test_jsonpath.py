import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.functions import jsonpath

DOC = {"host": "q", "disk": {"vendor": "Okta", "slot": {"bay": 7}, "parts": ["m", 2], "vendor.rev": "B"}, "rack/row.io": {"unit": "u9"}, "fan": {}, "fan.rpm": 900}


def model(v, segments):
    for n in range(1, len(segments) + 1):
        if not isinstance(v, dict):
            return None
        k = ".".join(segments[:n])
        if k in v:
            return [v[k]] if n == len(segments) else model(v[k], segments[n:])
    return None


@pytest.mark.parametrize(("path", "want"), [("host", '"q"'), ("disk.vendor", '"Okta"'), ("disk.slot.bay", "7"), ("disk.parts", '["m",2]'), ("disk.none", None), ("disk.vendor.rev", None), ("rack/row.io.unit", '"u9"'), ("fan.rpm", None), ("disk.parts.0", None)])
def test_paths(spark, path, want):
    df = spark.createDataFrame([(json.dumps(DOC),)], "t string").select(F.to_json(jsonpath.resolve(jsonpath.body(F.col("t")), path)).alias("v"))
    assert df.first().v == want


KEYS = st.sampled_from(["a", "b", "a.b", "b.a", "c'", "d?", 'e"'])
VALUES = st.recursive(st.none() | st.integers(-3, 3) | st.text("xy", max_size=2), lambda c: st.lists(c, max_size=2) | st.dictionaries(KEYS, c, max_size=3), max_leaves=8)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.dictionaries(KEYS, VALUES, max_size=3), min_size=20, max_size=40))
def test_against_model(spark, docs):
    paths = ["a", "a.b", "a.b.a", "b.a.b", "c'", "d?.a"]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "t string").select(*[F.to_json(jsonpath.resolve(jsonpath.body(F.col("t")), p)).alias(f"p{i}") for i, p in enumerate(paths)])
    for d, got in zip(docs, df.collect(), strict=True):
        for i, p in enumerate(paths):
            want = model(d, p.split("."))
            assert (None if got[i] is None else [json.loads(got[i])]) == want, (d, p)


def test_scalars(spark):
    v = ["1", "1.0", "1e3", "1.50", '"s"', "true", "null", "[1]", "{}", "1e20", "-0.5", "1e-15", "-2.5e-9", "1.25e30", "1234567.5e3"]
    df = spark.createDataFrame([(x,) for x in v], "t string").select(jsonpath.scalar_text(jsonpath.body(F.col("t"))).alias("s"))
    assert [r.s for r in df.collect()] == ["1", "1", "1000", "1.5", "s", "true", "null", None, None, "100000000000000000000", "-0.5", "0.000000000000001", "-0.0000000025", "1250000000000000000000000000000", "1234567500"]


def test_numeric(spark):
    v = ["1", '"1.5"', '" 1"', '"1f"', '".5"', '"5."', '"+2e1"', "true", "null", "[1]", '"inf"', '"x"']
    df = spark.createDataFrame([(x,) for x in v], "t string").select(jsonpath.numeric(jsonpath.body(F.col("t"))).alias("s"))
    assert [r.s for r in df.collect()] == [1.0, 1.5, None, None, 0.5, 5.0, 20.0, None, None, None, float("inf"), None]


def test_flatten(spark):
    df = spark.createDataFrame([('{"a":{"b":[1.0,{"c":"x"},[null]]},"d":true,"e":[],"f":1e3}',), ("[1]",), (None,), ("{",), ('{"a":' * 3000 + "1" + "}" * 3000,)], "t string")
    got = [r[0] for r in df.select(jsonpath.flatten(F.col("t"))).collect()]
    assert got == [{"a.b": ["1", "null"], "a.b.c": ["x"], "d": ["true"], "f": ["1000"]}, None, None, None, None]
    assert [r[0] for r in df.select(jsonpath.object_keys(F.col("t"))).collect()] == [["a.b", "d", "e", "f"], None, None, None, None]
