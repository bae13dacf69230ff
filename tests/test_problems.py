"""Problems 2, 5, 6 and 7 on small fixtures, against brute force where that is simple."""

import json
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import drift, layouts, nested, ordered, skewed
from logloom.sources import push


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- ordered ---


def test_running_sum_and_previous(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), rng.randrange(50), i, rng.choice([None, 1, 2, 5])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o bigint, i bigint, v bigint")
    got = {r.i: r.s for r in ordered.running_sum(df, ["k"], ["o", "i"], "v", "s").collect()}
    prev = {r.i: r.prev_i for r in ordered.previous(df, ["k"], ["o", "i"], ["i"]).collect()}
    top = {r.i: r.m for r in ordered.running_max(df, ["k"], ["o", "i"], "v", "m").collect()}
    for key in ("hot", "b", None):
        total, last, most = 0, None, None
        for _, o, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            most = v if most is None else max(most, v or most)
            assert (got[i], prev[i], top[i]) == (total, last, most)
            total, last = total + (v or 0), i


def test_ranges_with_payload(spark):
    # more rows than a sample of range borders holds, and a column that the ranges' totals don't need
    n = 60_000
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    df = spark.range(n, numPartitions=4).select(key.alias("k"), F.xxhash64("id").alias("o"), F.lit(1).alias("v"), F.concat(F.lit("payload"), "id").alias("p"))
    rows = sorted((r.k, r.o, r.p) for r in df.collect())
    at, want = {}, []
    for k, o, p in rows:
        want.append((k, o, p, at.get(k, 0)))
        at[k] = at.get(k, 0) + 1
    assert sorted(map(tuple, ordered.running_sum(df, ["k"], ["o"], "v", "s").select("k", "o", "p", "s").collect())) == want
    assert sorted(map(tuple, ordered.running_max(df, ["k"], ["o"], "o", "m").select("k", "m", "p").collect())) == rows
    before = ordered.previous(df, ["k"], ["o"], ["o"])
    assert before.select("p", "has_prev").where("NOT has_prev").count() == len(at)
    assert before.where("prev_o >= o").count() == 0
    seqs = push.with_seq(df.withColumnRenamed("k", "source"), ["o"])
    assert sorted(map(tuple, seqs.select("source", "o", "p", F.col("seq") - 1).collect())) == want


# --- nested (2) ---


def brute(v, pointer="", parent="", at=None):
    if isinstance(v, dict):
        if at is not None:
            yield pointer, parent
            parent = pointer
        for k, x in v.items():
            yield from brute(x, f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}", parent)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from brute(x, f"{pointer}/{i}", parent, i)


TEXTS = ['[{"a":[[{"b/c":[{"~":1}]}],{}]},3]', '{"x":{"y":[{"z":[{"w":null}]}]}}', '{"s":"[{}]"}', "[{}] x", '{"a":[{"b":NaN}]}', '[{"a":1}', "", None, '{"a":[{"b":1}],"a":[{"c":2},{}]}', "[" * 50 + "{}" + "]" * 50, "[" * 100_000, '{"*":[{"a.b":[{}],"c\'d?\\"":[[{}]]}]}', '{"o":' * 300 + '[{"deep":[{}]}]' + "}" * 300]


def test_nested_objects(spark):
    rows = [("s", i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, None, '[{"q":1}]', "clash"), ("s", 0, TEXTS[0], "clash")]
    df = spark.createDataFrame(rows, "source string, seq bigint, raw_data string, pointer string")
    want = []
    for s, q, t, _ in rows:
        try:
            want += [(s, q, p, a) for p, a in brute(json.loads(t, parse_constant=nested._no_constant))]
        except (ValueError, TypeError, RecursionError):
            pass
    got = nested.nested_objects(df, "raw_data", ["source", "seq"]).select("source", "seq", "pointer", "parent")
    assert tuples(got) == sorted(want, key=repr)
    assert nested.nested_objects(df.limit(0), "raw_data", ["seq"]).count() == 0


def test_child_tables(spark):
    docs = ['{"items":[{"sku":"a","qty":1,"Qty":2,"opts":[{"o":true}]},{"sku":"b","qty":"3"}]}', '{"items":[{"sku":null,"d":{"e":1.5}}]}']
    t = nested.child_tables(spark.createDataFrame(list(enumerate(docs)), "id bigint, j string"), "j", ["id"])
    assert set(t) == {"/items/*", "/items/*/opts/*"}
    items = t["/items/*"]
    assert dict(items.dtypes)["f_d_e"] == "double" and dict(items.dtypes)["f_Qty"] == "bigint" and dict(items.dtypes)["f_qty_2"] == "string"
    assert tuples(items.select("id", "ordinal", "f_sku", "f_d_e")) == sorted([(0, 0, "a", None), (0, 1, "b", None), (1, 0, None, 1.5)], key=repr)
    assert tuples(t["/items/*/opts/*"].select("id", "pointer", "parent", "f_o")) == [(0, "/items/0/opts/0", "/items/0", True)]


def test_child_rows(spark):
    docs = ['{"items":[{"sku":"a","n":[1],"opts":[{"o":true}]},{}]}', '{"e":[{"d":{"x":1.5,"y":null}}]}', '{"e":[{}],"only":[{},[{}]]}', "[{"]
    df = spark.createDataFrame(list(enumerate(docs)), "id bigint, j string")
    got = tuples(nested.child_rows(df, "j", ["id"]))
    assert got == sorted([
        ("/items/*", 0, "/items/0", "", 0, "sku", "string", "a"), ("/items/*", 0, "/items/0", "", 0, "n", "array", "[1]"), ("/items/*", 0, "/items/0", "", 0, "opts", "array", '[{"o": true}]'),
        ("/items/*/opts/*", 0, "/items/0/opts/0", "/items/0", 0, "o", "boolean", "true"), ("/items/*", 0, "/items/1", "", 1, None, None, None),
        ("/e/*", 1, "/e/0", "", 0, "d.x", "double", "1.5"), ("/e/*", 1, "/e/0", "", 0, "d.y", "null", None), ("/e/*", 2, "/e/0", "", 0, None, None, None),
        ("/only/*", 2, "/only/0", "", 0, None, None, None), ("/only/*/*", 2, "/only/1/0", "", 0, None, None, None),
    ], key=repr)
    assert {r[1:4] for r in got} == set(map(tuple, nested.nested_objects(df, "j", ["id"]).select("id", "pointer", "parent").collect()))
    assert set(nested.child_tables(df, "j", ["id"])) == {r[0] for r in got}
    assert nested.child_rows(df.limit(0), "j", ["id"]).count() == 0


def test_queries_of_children(spark, log_table, tmp_path):
    from logloom import catalog

    rows = [{"structured": True, "raw_data": '{"env":[{"name":"a"}],"ports":[{"p":1}]}'}]
    log_table(rows).write.parquet(f"{tmp_path}/loglines.parquet")
    assert {(r.path, r.field, r.value) for r in catalog.QUERIES["p2_children"](spark, str(tmp_path)).collect()} == {("/env/*", "name", "a"), ("/ports/*", "p", "1")}
    assert catalog.QUERIES["p2_containers"](spark, str(tmp_path)).count() == 0
    assert len(tuples(catalog.QUERIES["p2_found"](spark, str(tmp_path)))) == 2


# --- layouts (5) ---

MS = 1704258803000
HEADS = [
    ("I0103 05:13:23.000044    6994 te.go:296] hi", MS, "INFO", "te.go"),
    ('time="2024-01-03T05:13:23.500000169Z" level=warning msg="a b" module=per', MS + 500, "WARN", "per"),
    ("2024-01-03 05:13:23,245 [drairurk        ][CRITICAL][107] offset", MS + 245, "FATAL", "drairurk"),
    ("2024-01-03 05:13:23.999999 D | zuv: peer", MS + 999, "DEBUG", "zuv"),
    ("2024-01-03T10:43:23.129+05:30 \x1b[33mTRACE\x1b[0m [pool-thread] io.a.B - x", MS + 129, "DEBUG", "io.a.B"),
    ("[Panic] (hen) 03/Jan/2024:07:13:23 +0200 route", MS, "FATAL", "hen"),
    ("[1704258803.604] sk/notice: route", MS + 604, "INFO", "sk"),
    ("<11>Jan  3 05:13:23 host app[46]: x", MS, "ERROR", "app"),
    ("Jan  3 05:13:23 host app[46]: x", MS, "", "app"),
    ('2024-01-03T05:13:23.277624000Z AUDIT: id="3" response="500"', MS + 277, "", "AUDIT"),
]
NO_HEADS = ["heartbeat", "2016-05 romk 896", "connected to 10.0.0.1:5383", "", None, "2024-13-45 05:13:23,245 [d   ][INFO    ][1] x", "at 2024-01-03 05:13:23,245 [d   ][INFO    ][1] x"]


def test_log_entries(log_table):
    rows = [{"seq": i, "ts": MS // 1000, "raw_data": h[0] + "\n\tat x" * (i % 2)} for i, h in enumerate(HEADS * 2)]
    rows += [{"seq": 100 + i, "ts": MS // 1000, "raw_data": t} for i, t in enumerate(NO_HEADS)] + [{"seq": 200, "structured": True, "raw_data": HEADS[0][0]}]
    got = {r.seq: (r.entry_ms, r.level, r.component) for r in layouts.log_entries(log_table(rows)).collect()}
    assert got == {i: h[1:] for i, h in enumerate(HEADS * 2)}
    m = {r.seq: r.message for r in layouts.log_entries(log_table(rows)).collect()}
    assert m[0] == "hi" and m[1] == "a b\n\tat x"


def test_tail_entries(spark):
    j = '{"ts": 1704258803.528, "level": "info", "logger": "dea", "msg": "m"}'
    lines = [("a", 1, "lost"), ("a", 2, HEADS[0][0]), ("a", 3, "\tat x"), ("a", 3, "\tat x"), ("a", 4, None), ("a", 6, j), ("a", 7, HEADS[6][0]), (None, 1, HEADS[6][0]), (None, 2, "x"), ("a", None, "x")]
    df = spark.createDataFrame([(a, n, MS // 1000, t == j, t) for a, n, t in lines], "app string, line_no bigint, ts bigint, structured boolean, `inner` string")
    got = tuples(layouts.tail_entries(df))
    assert got == sorted([("a", 2, 4, MS, "INFO", "te.go"), ("a", 6, 6, MS + 528, "INFO", "dea"), ("a", 7, 7, MS + 604, "INFO", "sk"), (None, 1, 2, MS + 604, "INFO", "sk")], key=repr)
    text = {(r.app, r.first_pos): r.message for r in layouts.tail_entries(df, with_message=True).collect()}
    assert text[("a", 2)] == "hi\n\tat x" and text[(None, 1)] == "route\nx"
    assert layouts.tail_entries(df.limit(0)).count() == 0


def test_templates(spark):
    df = spark.createDataFrame([(f"[170425880{i}.1] c{i}/err: disk d{'abc'[i % 3]} above watermark",) for i in range(6)] + [("heart beat 1",)], "line string")
    t = layouts.templates(layouts.leaves(df)).collect()
    assert {bool(r.pattern) for r in t} == {True, False} and sum(r.lines for r in t) == 7
    assert any("above watermark" in r.template for r in t)


UNSEEN = [
    ("2024/01/03 05:13:23 billing.core WARN retry scheduled: later", MS, "WARN", "billing.core"),
    ("[2024-01-03T05:13:23.5Z] [error] [net/worker-3] socket closed", MS + 500, "ERROR", "net/worker-3"),
    ("2024-01-03 05:13:23,007 NOTICE (scheduler) 4 jobs", MS + 7, "INFO", "scheduler"),
    ("<14>Jan  3 05:13:23 10.0.0.7 cron[9]: ran", None, None, None),
]


def test_layouts_of_other_programs(log_table):
    # no list of layouts: heads of programs that no one told of
    got = {r.seq: (r.entry_ms, r.level, r.component) for r in layouts.log_entries(log_table([{"seq": i, "ts": MS // 1000, "raw_data": h[0]} for i, h in enumerate(UNSEEN * 3)])).collect()}
    assert {i: g for i, g in got.items() if i % 4 < 3} == {i: h[1:] for i, h in enumerate(UNSEEN * 3) if i % 4 < 3}


def test_partitions_decide(log_table, monkeypatch):
    # layouts of as many tokens fall into one leaf without the splits, and then show no common head
    rows = [{"seq": i, "ts": MS // 1000, "raw_data": f"{h} {w} went on"} for i, (h, w) in enumerate((h, w) for h in (HEADS[2][0] + " of topic", HEADS[3][0]) for w in ("a", "b", "c"))]
    t = log_table(rows)
    assert layouts.log_entries(t).count() == 6
    monkeypatch.setattr(layouts, "by_least_variable", lambda sigs, within=None: sigs)
    monkeypatch.setattr(layouts, "by_bijection", lambda sigs: sigs)
    assert layouts.log_entries(t).count() == 0


# --- drift (6) ---


def pushes(spark, *files):
    rows = [(i, s, [None if x is None else (ts, None, True, x if isinstance(x, str) else json.dumps(x), None) for ts, x in lines]) for i, s, lines in files]
    return spark.createDataFrame(rows, "push_id bigint, source string, lines array<struct<ts:bigint,indexes:array<string>,structured:boolean,raw_data:string,json_keys:array<string>>>")


def test_changes(spark):
    words = [{"w": x, "n": 5, "id": f"ab-{i}", "flag": True, "deep": {"x": 1}} for i, x in enumerate(["p", "q", "r"])]
    moved = [{"deep": {"w": x["w"]}, "n": "5", "code": x["id"], "flag": True, "big": 10**9} for x in words]
    p = pushes(
        spark,
        (1, "s", [(10, x) for x in words]),
        (2, "s", []),
        (7, "s", [(30, x) for x in moved]),
        (4, "s", [(20, words[0]), (21, "{broken"), (22, None), (23, '"text"'), (24, {"n": None, "deep": {}})]),
        (5, None, [(1, {"a": 1})]),
        (6, None, [(2, {"a": [1]})]),
        (None, "s", [(1, {"a": 1})]),
    )
    got = tuples(drift.changes(p))
    assert got == sorted([
        (None, 6, "retyped", "a", "a"),
        ("s", 7, "renamed", "w", "deep.w"), ("s", 7, "renamed", "id", "code"), ("s", 7, "retyped", "n", "n"), ("s", 7, "removed", "deep.x", ""), ("s", 7, "added", "", "big"),
    ], key=repr)
    assert drift.changes(p.limit(0)).count() == 0


def test_renames_of_many_values(spark):
    few = [{"old": f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x"} for i in range(40)]
    many = [{"new": f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x"} for i in range(600)]
    other = [{"third": f"o{chr(97 + i % 26)}{chr(97 + i // 26)}x"} for i in range(600)]
    lists = [{"third": None, "l": [v["third"] for v in other]}]
    moved = [{"m": [f"o{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(300, 2000)]}]
    p = pushes(spark, (1, "s", [(10, x) for x in few]), (2, "s", [(20, x) for x in many]), (3, "s", [(30, x) for x in other]), (4, "s", [(40, x) for x in lists]), (5, "s", [(50, x) for x in moved]))
    assert tuples(drift.changes(p)) == sorted([
        ("s", 2, "renamed", "old", "new"), ("s", 3, "removed", "new", ""), ("s", 3, "added", "", "third"),
        ("s", 4, "removed", "third", ""), ("s", 4, "added", "", "l"), ("s", 5, "renamed", "l", "m"),
    ], key=repr)


def test_consistent_table(spark):
    big = (1 << 53) + 1
    p = pushes(spark, (1, "s", [(1, {"a": 1, "b": {"c": "x"}, "n": big, "d": 1.5}), (2, {"a": "no", "B.C": True, "d": big}), (3, "{bad"), (4, {"a": 2, "d": 2})]))
    types = drift.column_types(p)
    assert types == [("B.C", "boolean"), ("a", "bigint"), ("b.c", "string"), ("d", "double"), ("n", "bigint")]
    got = {r.ts: r for r in drift.consistent_table(p).collect()}
    assert (got[1].f_a, got[1].f_b_c_2, got[1].f_n, got[1].f_d, got[1].failed) == (1, "x", big, 1.5, [])
    # an integer that a double can't hold is reported, not changed
    assert (got[2].f_a, got[2].f_d, got[2].f_B_C, sorted(got[2].failed)) == (None, None, True, ["a", "d"])
    assert (got[3].valid, got[3].failed, got[4].f_a, got[4].f_d) == (False, [], 2, 2.0)
    assert {(r.path, r.sql_type): r.n_failed for r in drift.failed_casts(p).collect()} == {("B.C", "boolean"): 0, ("a", "bigint"): 1, ("b.c", "string"): 0, ("d", "double"): 1, ("n", "bigint"): 0}
    assert drift.consistent_table(p.limit(0)).count() == 0 and drift.failed_casts(p.limit(0)).count() == 0


# --- skew (7) ---


def late_brute(rows):
    return [(k, q, t, m - t) for k, q, t in rows if q is not None and t is not None and (m := max((u for j, p, u in rows if j == k and p is not None and u is not None and p < q), default=t)) > t]


@pytest.mark.parametrize("block", [4, 1024])
def test_late_rows(spark, block):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["b", "c", None]), rng.randrange(-5, 900), rng.randrange(100)) for _ in range(600)] + [("b", None, 5), ("b", 9, None), (None, 3, 4)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "source string, seq bigint, ts bigint, block string")
    got = sorted(map(tuple, skewed.late_rows(df, block=block).collect()), key=repr)
    assert got == sorted(late_brute(rows), key=repr)
    assert skewed.late_rows(df.limit(0)).count() == 0


def test_key_totals(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 5), ("b", None)], "k string, v bigint")
    assert tuples(skewed.key_totals(df, "k", "v")) == sorted([("a", 2, 1, 1), (None, 1, 1, 5), ("b", 1, 0, 0)], key=repr)


# --- columns of the input that are called like the operators' own ---


def test_clashing_columns(spark, log_table):
    rows = log_table([{"ts": 5, "raw_data": HEADS[i % 8][0], "seq": i} for i in range(20)])
    named = rows.withColumns({c: F.lit(1) for c in ("line", "sig", "part", "layout", "pos", "rest", "f", "entry_ms", "head", "tokens")})
    assert tuples(layouts.log_entries(named)) == tuples(layouts.log_entries(rows))
    p = pushes(spark, (1, "s", [(1, {"a": 1})]), (2, "s", [(2, {"b": 10**9})]))
    more = p.withColumns({c: F.lit(1) for c in ("ts", "path", "kind", "words", "first_ts", "raw_data", "has_prev")})
    assert tuples(drift.changes(more)) == tuples(drift.changes(p)) == [("s", 2, "added", "", "b"), ("s", 2, "removed", "a", "")]
    assert tuples(drift.consistent_table(more)) == tuples(drift.consistent_table(p))


def test_entries_of_both_tables(spark, log_table):
    logs = log_table([{"ts": MS // 1000, "raw_data": h[0]} for h in HEADS])
    tail = spark.createDataFrame([("a", i, MS // 1000, False, h[0]) for i, h in enumerate(HEADS)], "app string, line_no bigint, ts bigint, structured boolean, `inner` string")
    got = layouts.all_entries(logs, tail).groupBy("tab").count().collect()
    assert {(r.tab, r["count"]) for r in got} == {("loglines", len(HEADS)), ("taillines", len(HEADS))}
    assert layouts.all_entries(logs.limit(0), tail.limit(0)).count() == 0
