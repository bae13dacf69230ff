import json
import threading
import urllib.error
import urllib.request

import pytest

from logloom.server import server

LINE = {"ts": 1, "indexes": ["india"], "structured": True, "raw_data": '{"country":"india"}', "json_keys": ["country"]}
ASK = {"query": "", "start_ts": 0, "end_ts": 0, "count": 0, "offset": 0, "partitions": [], "forward": False}


@pytest.fixture
def call(spark, tmp_path):
    s = server(spark, str(tmp_path / "store"), 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def ask(path, body=None, method=None):
        data = None if body is None else json.dumps(body).encode()
        r = urllib.request.Request(f"http://127.0.0.1:{s.server_port}{path}", data, method=method)
        try:
            with urllib.request.urlopen(r) as got:
                return got.status, got.read().decode(), got.headers
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode(), e.headers

    yield ask
    s.shutdown()


def test_push_query_partitions(call):
    assert call("/hello")[0] == 200
    assert call("/push", {"source": "demo", "lines": [LINE, LINE | {"ts": 2, "raw_data": '{"country":"pakistan"}', "indexes": ["pakistan"]}]})[:2] == (201, "ok")
    assert call("/push", {"source": "demo", "lines": [{"ts": 1}]})[0] == 406
    assert call("/push", {"source": "demo", "lines": [LINE | {"ts": 1 << 63}]})[0] == 406  # beyond a long
    assert json.loads(call("/partitions")[1]) == {"partitions": ["demo"]}
    rows = json.loads(call("/query", ASK)[1])["data"]
    assert [r["ts"] for r in rows] == [2, 1] and rows[0]["entry"] == {"country": "pakistan"}
    assert json.loads(call("/query", ASK | {"query": 'country="pakistn"'})[1])["data"][0]["ts"] == 2
    code, text, _ = call("/query", ASK | {"query": "count(a) as b | limit 2"})
    assert code == 406 and "Limit is not supported" in text
    code, _, headers = call("/query", method="OPTIONS")
    assert code == 200 and headers["Access-Control-Allow-Methods"] == "POST"
