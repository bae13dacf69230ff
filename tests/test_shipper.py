from pyspark.sql import functions as F

from logloom.sources import shipper


def one(spark, f, text):
    r = spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("p")).first().p
    return None if r is None else r.asDict()


def test_parsers(spark):
    assert one(spark, shipper.klog, "I0204 07:32:30.020537    3368 server.go:1048] POST /stats\nmore") == {"severity": "I", "time": "0204 07:32:30.020537", "pid": "3368", "source": "server.go:1048", "message": "POST /stats\nmore"}
    assert one(spark, shipper.klog, "no head") is None and one(spark, shipper.klog, None) is None
    assert one(spark, shipper.salt, "2014-04-09 10:15:46,687 [salt.utils][ERROR   ] boom") == {"time": "2014-04-09 10:15:46", "severity": "ERROR", "message": "boom"}
    d = one(spark, shipper.docker, 'time="2016-02-04T06:53:57.505612354Z" level=error msg="bad" err="x" statusCode=404')
    assert d == {"time": "2016-02-04T06:53:57.505612354Z", "severity": "error", "message": "bad", "error": "x", "status_code": "404"}
    assert one(spark, shipper.syslog, "<14>Jan  5 21:58:59 host app[46]: hi")["ident"] == "app"
    a = one(spark, shipper.audit, '2017-02-09T00:15:57.9Z AUDIT: user="a \\"b\\"" zz="1" id="9"')
    assert a["user"] == 'a \\"b\\"' and a["id"] == "9" and a["ip"] is None
    assert len(one(spark, shipper.audit, '2017-02-09T00:15:57.9Z AUDIT: uri="' + 'a\\\"' * 50_000 + '"')["uri"]) == 150_000
    assert one(spark, shipper.container, '{"log":"x","stream":"stdout","time":"2024-01-03T00:00:00.5Z"}') == {"log": "x", "stream": "stdout", "ts": 1704240000}
    assert one(spark, shipper.journal, '{"MESSAGE":"m","_SYSTEMD_UNIT":"u","__REALTIME_TIMESTAMP":"1704240000123456"}')["ts"] == 1704240000


def test_multiline(spark):
    rows = [("a", 1, "lost"), ("a", 2, "I0101 x"), ("a", 3, " more"), ("a", 4, None), ("a", 5, "E0102 y"), (None, 1, "I0103 z")]
    got = shipper.multiline(spark.createDataFrame(rows, "app string, no bigint, t string"), ["app"], "no", "t", shipper.KLOG_FIRST)
    assert {(r.app, r.first, r.t) for r in got.collect()} == {("a", 2, "I0101 x\n more"), ("a", 5, "E0102 y"), (None, 1, "I0103 z")}


def test_routing(spark):
    rows = [('{"kubernetes":{"pod_name":"p"},"m":"The  quick\\nfox","l":["a",1,{"x":"no"}]}', 5), ("[1]", 6), ("{bad", 7), ('{"m":"x"}', 8), (None, 9)]
    got = shipper.routed(spark.createDataFrame(rows, "raw string, ts bigint"), "raw", F.col("ts"), ["the", "The"]).collect()
    assert [(r.source, r.ts, r.indexes, r.json_keys) for r in got] == [("p", 5, ["p", "quick", "fox", "a"], ["kubernetes.pod_name", "m", "l"])]


def test_own_records_and_enrichment(spark):
    df = spark.createDataFrame([("fluent.warn", "p"), ("kubernetes.x", "p"), (None, "q")], "tag string, pod string")
    pods = spark.createDataFrame([("p", "n1"), ("p", "n1")], "pod string, node string")
    got = shipper.enriched(shipper.forwarded(df, "tag"), pods, "pod").collect()
    assert sorted((r.tag or "", r.pod, r.node) for r in got) == [("", "q", None), ("kubernetes.x", "p", "n1")]
