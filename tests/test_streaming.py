import json

from logloom import cli
from logloom.sources import store
from logloom.streaming import live


def line(ts, text):
    return {"ts": ts, "indexes": [text], "structured": False, "raw_data": text, "json_keys": []}


def test_ingest_then_tail(spark, tmp_path, capsys):
    inbox, path = tmp_path / "inbox", str(tmp_path / "store")
    inbox.mkdir()
    for i in (1, 2):
        (inbox / f"{i}.json").write_text(json.dumps({"source": f"s{i}", "lines": [line(10 * i, f"x{i}"), line(5, "late")]}) + "\n")
        live.ingest_stream(live.push_stream(spark, str(inbox)), path, str(tmp_path / "ck")).awaitTermination()
    got = store.read(spark, path).collect()
    assert sorted((r.source, r.ts) for r in got) == [("s1", 5), ("s1", 10), ("s2", 5), ("s2", 20)]
    assert len({(r.source, r.seq) for r in got}) == 4
    q = live.tail(spark, path, ["s2"]).writeStream.format("memory").queryName("tailed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.app, r.ts, r.inner) for r in spark.sql("SELECT * FROM tailed").collect()) == [("s2", 5, "late"), ("s2", 20, "x2")]
    q = live.tail(spark, path).writeStream.format("memory").queryName("tailed_all").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT * FROM tailed_all").count() == 4  # D12: no list, no filter
    cli.main(["--store", path, "apps"], spark)
    assert capsys.readouterr().out.split("\n")[:3] == ["App Names", "s1", "s2"]
    cli.main(["--store", path, "logs", "--apps", "s1", "--query", 'message="x1"'], spark)
    assert json.loads(capsys.readouterr().out)["data"][0]["entry"] == "x1"
    cli.main(["--store", path, "tail", "--apps", "s1", "--once"], spark)
    assert "APP: s1, ts: 1970-01-01 00:00:10, line: x1" in capsys.readouterr().out


def test_numbers_of_batches(spark, tmp_path):
    # two batches of two files each: numbers are unique and dense in every source
    inbox, path = tmp_path / "inbox", str(tmp_path / "store")
    inbox.mkdir()
    for b in range(2):
        for f in range(2):
            (inbox / f"{b}{f}.json").write_text("".join(json.dumps({"source": s, "lines": [line(i, f"{b}{f}{i}") for i in range(300)]}) + "\n" for s in ("a", "b")))
        live.ingest_stream(live.push_stream(spark, str(inbox)), path, str(tmp_path / "ck")).awaitTermination()
    got = store.read(spark, path).collect()
    for s in ("a", "b"):
        assert sorted(r.seq for r in got if r.source == s) == list(range(1, 1201))
    first = {r.raw_data[0] for r in got if r.seq <= 600}
    assert first == {"0"}


def test_durations():
    assert cli.seconds("1h30m") == 5400 and cli.seconds("90s") == 90
