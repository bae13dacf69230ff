import json

import pytest

from logloom.plans.planner import Request, plan
from logloom.plans.render import answer

PEOPLE = [("Rust", 30, 2), ("Go", 40, 3), ("Ruby", 20, 4), ("Rust", 15, 5), ("Go", 45, 7)]


@pytest.fixture(scope="module")
def people(log_table):
    return log_table([{"ts": t, "structured": True, "raw_data": json.dumps({"name": "x", "skills": {"language": lang, "la": ["a"]}, "age": age})} for lang, age, t in PEOPLE])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_people(people):
    r = Request(1, 9, forward=True)
    assert rows(plan(people, "avg(age) as a", r)) == [(30.0,)]
    assert rows(plan(people, "avg(age) as a by skills.language", r)) == [("Go", 42.5), ("Ruby", 20.0), ("Rust", 22.5)]
    assert rows(plan(people, "count(age) as n", r)) == [(5,)]
    assert rows(plan(people, "count(age) as n by skills.language", r)) == [("Go", 2), ("Ruby", 1), ("Rust", 2)]
    assert rows(plan(people, "distinct_count(skills.language)", r)) == [("Go", 2), ("Ruby", 1), ("Rust", 2)]
    assert rows(plan(people, "distinct(skills.language)", r)) == [("Go",), ("Ruby",), ("Rust",)]
    assert rows(plan(people, "distinct(skills.la)", r)) == []
    assert json.loads(answer(people, "avg(age) as a", r)) == {"data": [{"a": "30"}]}
    assert json.loads(answer(people, "count(age) as n", r)) == {"data": [{"n": "5"}]}


TRANSFERS = [
    {"ts": 2, "raw_data": "liala transfered money to raja", "indexes": ["liala", "transfered", "money", "raja", "money"]},
    {"ts": 4, "raw_data": "roja transfered money to navin", "indexes": ["roja", "transfered", "money", "navin"]},
]


def test_fuzzy(log_table):
    t = log_table(TRANSFERS)
    assert [r.ts for r in plan(t, 'message="navi"', Request(1, 5)).collect()] == [4]
    # D1: two matching terms or a repeated one still give a line once
    assert [r.ts for r in plan(t, 'message="money"', Request(1, 5)).collect()] == [4, 2]
    assert plan(t, "", Request(1, 5)).count() == 2


def test_fuzzy_nulls_and_case(log_table):
    t = log_table([{"indexes": None}, {"indexes": [None, "Money"]}, {"indexes": []}, {"indexes": [None]}])
    assert [r.ts for r in plan(t, 'message="money"').collect()] == [0]
    assert plan(t, 'message="MON" | distance 1').count() == 0


def test_first_segment_without_match(log_table):  # D2
    t = log_table([{"ts": i, "indexes": ["x" * 9]} for i in range(1, 5)] + [{"ts": 9, "indexes": ["hit"]}])
    assert plan(t, 'message="hit" | distance 1').count() == 1


def test_structured_selection(log_table):
    t = log_table([{"structured": True, "raw_data": '{"a":"hit","b":"x"}', "indexes": ["hit", "x"], "json_keys": ["a", "b"]}, {"indexes": ["hit"], "json_keys": None}])
    assert plan(t, 'b="hit"').count() == 1  # the term may come from any field
    assert plan(t, 'c="hit"').count() == 0


def test_order_and_limit(log_table):
    t = log_table([{"source": s, "ts": ts} for s in ("p", "q") for ts in ((1, 3, 5, 7) if s == "p" else (2, 4, 6, 8))])
    assert [r.ts for r in plan(t, "", Request(forward=True)).collect()] == list(range(1, 9))
    assert [r.ts for r in plan(t, "limit 3").collect()] == [8, 7, 6]
    assert [r.ts for r in plan(t, "limit 3", Request(count=2)).collect()] == [8, 7]
    assert [r.ts for r in plan(t, "", Request(3, 5, forward=True)).collect()] == [3, 4, 5]
    assert plan(t, "", Request(5, 0)).count() == 0


def test_ties_follow_the_source_list(log_table):  # O1, D5, D6
    t = log_table([{"source": "b", "ts": 0, "seq": 1}, {"source": "a", "ts": 0, "seq": 1}, {"source": "a", "ts": 0, "seq": 2}])
    got = [(r.source) for r in plan(t, "source=b,a").collect()]
    assert got == ["b", "a", "a"]
    assert [r.source for r in plan(t, "").collect()] == ["a", "a", "b"]


def test_request_sources(log_table):  # D7
    t = log_table([{"source": "kube-a"}, {"source": "b"}])
    assert [r.source for r in plan(t, "", Request(partitions=("kube-a",))).collect()] == ["kube-a"]
    assert [r.source for r in plan(t, "source=b", Request(partitions=("kube-a",))).collect()] == ["b"]


EDGE = ['{"k":1,"g":"x"}', '{"k":"1","g":null}', '{"k":1.0,"g":1e3}', '{"k":null,"g":{"a":1}}', '{"k":[1],"g":[1]}', '{"g":"x"}', "{broken", '{"k":" 1"}', '{"k":"1f"}', '{"k":true,"g":true}', '{"k":"5."}']


def test_edge_values(log_table):
    t = log_table([{"structured": True, "raw_data": r} for r in EDGE] + [{"raw_data": '{"k":7}'}, {"structured": True, "raw_data": None}])
    assert rows(plan(t, "count(k) as n")) == [(10,)]  # D8: text that is JSON counts too; null is present
    assert rows(plan(t, "distinct(k)")) == [(" 1",), ("1",), ("1f",), ("5.",), ("null",), ("true",)]
    assert rows(plan(t, "distinct_count(k)"))[1] == ("1", 3)
    assert plan(t, "avg(k) as a").first().a == (1 + 1 + 1 + 5) / 4
    assert dict(rows(plan(t, "count(k) as n by g"))) == {"x": 1, "null": 1, "1000": 1, '""': 6, "true": 1}


def test_empty(log_table):  # D20
    t = log_table([]).limit(0)
    assert rows(plan(t, "count(k) as n")) == [(0,)] and rows(plan(t, "avg(k) as a")) == [(0.0,)]
    assert json.loads(answer(t, "count(k) as n by g")) == {"data": [{"n": "", "g": ""}]}
    assert json.loads(answer(t, "avg(k) as a")) == {"data": [{"a": "0"}]}
    assert json.loads(answer(t, "distinct(k)")) == {"data": []} == json.loads(answer(t, ""))


def test_envelope_is_valid_json(log_table):  # D13
    t = log_table([{"raw_data": 'say "hi"\n'}, {"structured": True, "raw_data": '{"a":1}', "ts": 1}])
    assert json.loads(answer(t, ""))["data"] == [{"ts": 1, "entry": {"a": 1}, "source": "a"}, {"ts": 0, "entry": 'say "hi"\n', "source": "a"}]


def test_filters_reach_the_scan(spark, log_table, tmp_path):
    from logloom.sources import store

    store.write(log_table([{"ts": 86400 * i} for i in range(4)]), str(tmp_path / "s"))
    df = plan(store.read(spark, str(tmp_path / "s")), "source=a | count(k) as n", Request(86400, 2 * 86400))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "event_date" in text.split("PartitionFilters")[1]
    assert "GreaterThanOrEqual(ts,86400)" in text and "indexes" not in text.split("ReadSchema")[1]
