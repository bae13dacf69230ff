import json

import pytest
from pyspark.sql import functions as F

from logloom.functions.text import stem
from logloom.plans.planner import Request, plan
from logloom.sources import push, store


def test_write_read_ingest(spark, tmp_path, log_table):
    path = str(tmp_path / "s")
    first = log_table([{"source": s, "ts": 100 + i, "raw_data": f"the running line {i}"} for i in range(5) for s in ("a", "7")]).drop("seq")
    store.ingest(first, path, ["ts"])
    store.ingest(first.withColumn("ts", F.col("ts") + 86400), path, ["ts"])
    got = store.read(spark, path)
    assert sorted((r.source, r.seq) for r in got.collect()) == sorted((s, i) for s in ("a", "7") for i in range(1, 11))
    assert sorted(r.source for r in store.sources(got).collect()) == ["7", "a"]
    # null index columns were derived: the stop word is gone, the rest stemmed
    assert got.where("seq = 1 AND source = 'a'").first().indexes == ["run", "line", "0"]
    assert plan(got, 'message="runs" | distance 1').count() == 20


def test_mandatory_fields(spark, tmp_path, log_table):
    bad = log_table([{"raw_data": None}])
    with pytest.raises(Exception, match="mandatory"):
        store.write(bad, str(tmp_path / "s"))


def test_push_files(spark, tmp_path):
    line = {"ts": 1, "indexes": ["x"], "structured": True, "raw_data": '{"country":"india"}', "json_keys": ["country"]}
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok/p.json").write_text(json.dumps({"source": "demo", "lines": [line, line | {"ts": 2}]}) + "\n")
    got = push.lines_of(push.read_pushes(spark, str(tmp_path / "ok")))
    assert [(r.source, r.place, r.ts) for r in got.orderBy("place").collect()] == [("demo", 0, 1), ("demo", 1, 2)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/p.json").write_text('{"source": "demo", "lines": [{"ts": 1}]}\n')
    with pytest.raises(Exception, match="mandatory"):
        push.read_pushes(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "bad/p.json").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        push.read_pushes(spark, str(tmp_path / "bad")).collect()


def test_seq_of_a_hot_source(log_table):
    t = log_table([{"source": "a" if i % 3 else None, "ts": i % 7} for i in range(300)]).drop("seq")
    got = push.with_seq(t, ["ts"]).orderBy("source", "seq").collect()
    assert [r.seq for r in got] == [*range(1, 101), *range(1, 201)]
    assert all(x.ts <= y.ts for x, y in zip(got, got[1:]) if x.source == y.source)


def test_segments_and_retention(log_table):
    t = log_table([{"ts": ts, "seq": i} for i, ts in enumerate([5, 9, 7, 100, 300, 200], 1)])
    got = sorted(map(tuple, store.segments(t, 2).collect()))
    assert got == [("a", 1, 5, 9, 1, 2, 2), ("a", 2, 7, 100, 3, 4, 2), ("a", 3, 300, 200, 5, 6, 2)]
    # strict: an age of exactly the period stays; D21: an end in the future stays
    assert sorted(r.seq for r in store.retain(t, 109, 100, 2).collect()) == [1, 2, 3, 4, 5, 6]
    assert sorted(r.seq for r in store.retain(t, 110, 100, 2).collect()) == [3, 4, 5, 6]


def test_drop_days(spark, tmp_path, log_table):
    path = str(tmp_path / "s")
    store.write(log_table([{"ts": 10}, {"ts": 86400 * 3}]), path)
    assert store.drop_days(spark, path, 86400 * 4, 86400 * 2) == ["source=a/event_date=1970-01-01"]
    assert [r.ts for r in store.read(spark, path).collect()] == [86400 * 3]


def test_segment_inside_and_around_the_range(log_table):  # D3
    t = log_table([{"ts": s + k} for s in (1, 4, 7, 10) for k in (0, 2)])
    assert [r.ts for r in plan(t, "", Request(1, 9, forward=True)).collect()] == [1, 3, 4, 6, 7, 9]
    assert [r.ts for r in plan(t, "", Request(1, 9)).collect()] == [9, 7, 6, 4, 3, 1]


def test_reindex(log_table):
    t = log_table([{"structured": True, "raw_data": '{"name":"navin"}'}, {"structured": True, "raw_data": '{"name":"schoolboy","n":[{"x":"the  b"}]}'}, {"structured": True, "raw_data": "[1]"}, {"raw_data": None}])
    got = store.reindex(t).orderBy("seq").collect()
    assert got[1].indexes == ["schoolboy", "", "b"] and got[1].json_keys == ["name", "n.x"]
    assert got[2].indexes == [] and got[2].json_keys == [] and got[3].indexes is None
    q = 'name="schoolboy" | distance 1'
    assert plan(store.reindex(t), q).count() == 1


def test_search_by_terms_and_files(spark, tmp_path, log_table):
    path = str(tmp_path / "s")
    day = 86400
    rows = [{"source": s, "ts": d * day + i, "seq": d * 10 + i, "indexes": [w, w, None]} for s in "ab" for d in range(3) for i, w in enumerate(["money", "tree", "honey"])]
    rows[0]["indexes"] = None
    store.write(log_table(rows), path)
    store.write(log_table([{"source": "c", "ts": 5, "seq": 1, "indexes": ["monet"]}]), path)
    assert {(r.term, r.source, r.event_date.day) for r in store.near_terms(spark, path, "money", 1).collect()} == {(t, s, d + 1) for s in "ab" for d in range(3) for t in ("money", "honey") if (t, s, d) != ("money", "a", 0)} | {("monet", "c", 1)}
    for q, r in (('message="money" | distance 1', Request()), ('message="nothing"', Request()), ('source=b | message="tree"', Request(day, 2 * day)), ("", Request(day, day + 1)), ("limit 3", Request(5, 5)), ('message="monet" | count(x) as n', Request())):
        whole = plan(store.read(spark, path), q, r).collect()
        assert store.search(spark, path, q, r).collect() == whole, q
    files = store.files_of(spark, path, 2 * day, 3 * day, ("a",))
    assert len(files) >= 1 and all("source=a" in f and "event_date=1970-01-03" in f for f in files)
    assert store.files_of(spark, path, 0, 0) is None and store.files_of(spark, path, -9, -1) == []
    # a day that goes takes its bounds and terms along
    store.drop_days(spark, path, 3 * day, day + day // 2)
    assert {r.event_date.day for r in store.side(spark, path, "_terms").collect()} == {r.event_date.day for r in store.read(spark, path).collect()} == {2, 3}
    store.compact(spark, path)
    assert store.search(spark, path, 'message="money" | distance 1').count() == 8 and store.side(spark, path, "_files").agg({"n_lines": "sum"}).first()[0] == 12


def test_what_a_broken_write_leaves(spark, tmp_path, log_table):
    path = str(tmp_path / "s")
    store.write(log_table([{"ts": 1, "raw_data": "running wild"}]), path, "whole")
    store.write(log_table([{"ts": 2, "raw_data": "running late"}]), path, "half")
    import shutil

    shutil.rmtree(f"{path}/_terms/batch=half")
    shutil.rmtree(f"{path}/_seq/batch=half")
    assert store.reindex_missing(spark, path) == ["batch=half"] and store.reindex_missing(spark, path) == []
    assert store.search(spark, path, 'message="run" | distance 1').select("ts").collect() == [(2,)]


def test_every():
    import threading

    ran, stop = [], threading.Event()

    def job():
        ran.append(1)
        if len(ran) == 3:
            stop.set()
        raise ValueError("one run fails")

    store.every(0.01, job, stop).join(10)
    assert len(ran) == 3


@pytest.mark.parametrize(
    ("word", "want"),
    [("running", "run"), ("caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("gaps", "gap"), ("hoping", "hope"), ("hopped", "hop"), ("agreed", "agre"), ("national", "nation"), ("generously", "generous"),
     ("happy", "happi"), ("say", "say"), ("by", "by"), ("skies", "sky"), ("sensational", "sensat"), ("adjustment", "adjust"), ("adoption", "adopt"), ("rate", "rate"), ("controlling", "control"), ("'tis", "tis"), ("inning", "inning"), ("", ""), ("knightly", "knight"), ("consignment", "consign")],
)
def test_stems(word, want):
    assert stem(word) == want
