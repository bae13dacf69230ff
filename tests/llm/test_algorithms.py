"""Problems 1, 3 and 4 against brute force."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logloom.llm import heavy, runs, terms


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- terms (1) ---


def test_terms(spark):
    rng = random.Random(5)
    rows = [(None if rng.random() < 0.1 else [rng.choice(["a", "b", "B", "", None, f"id{i}"]) for _ in range(rng.randrange(5))],) for i in range(500)]
    df = spark.createDataFrame(rows, "indexes array<string>").repartition(5)
    occ, recs = Counter(), Counter()
    for (t,) in rows:
        occ.update(x for x in t or [] if x)
        recs.update({x for x in t or [] if x})
    n = sum(t is not None for (t,) in rows)
    want = sorted(((t, occ[t], recs[t], "rare" if recs[t] < 3 else "common" if recs[t] > 0.2 * n else None) for t in occ), key=repr)
    assert tuples(terms.marked_terms(df, F.col("indexes"))) == want


def test_terms_edges(spark):
    df = spark.createDataFrame([(["x"] * 300, "k"), (["x"], "k"), ([], "k"), (None, "k"), (["y" * 100_000], "k")], "indexes array<string>, term string")
    got = {r.term[:1]: (r.n_occurrences, r.n_records, r.mark) for r in terms.marked_terms(df, F.col("indexes")).collect()}
    assert got == {"x": (301, 2, "rare"), "y": (1, 1, "rare")}
    assert terms.marked_terms(df.limit(0), F.col("indexes")).count() == 0
    same = spark.createDataFrame([(["z"],)] * 7, "indexes array<string>")  # rows equal in all columns are records each
    assert tuples(terms.marked_terms(same, F.col("indexes"))) == [("z", 7, 7, "common")]


# --- frequent items (3) ---


def test_frequent(spark):
    rng = random.Random(6)
    vals = [f"hot{rng.randrange(4)}" if rng.random() < 0.4 else f"v{rng.randrange(10**6)}" for _ in range(4000)] + [None] * 100 + [""] * 60
    df = spark.createDataFrame([(v, "n") for v in vals], "v string, n string")
    c = Counter(v for v in vals if v is not None)
    assert tuples(heavy.frequent(df, F.col("v"), 0.01, len(vals))) == sorted((v, n) for v, n in c.items() if n >= 0.01 * len(vals))
    best = sorted(c.items(), key=lambda x: (-x[1], x[0]))
    for k in (1, 3, 40):
        assert [tuple(r) for r in heavy.most_frequent(df, F.col("v"), k).collect()] == best[:k]


def test_frequent_edges(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "v string")
    assert tuples(heavy.frequent(df, F.col("v"), 0.5, 4)) == [("b", 2)]  # at least, not more than
    assert [tuple(r) for r in heavy.most_frequent(df, F.col("v"), 9).collect()] == [("b", 2), ("a", 1)]
    assert heavy.frequent(df.limit(0), F.col("v"), 0.01, 0).count() == 0
    assert heavy.most_frequent(df.limit(0), F.col("v"), 3).count() == 0
    edge = spark.createDataFrame([("c",)] * 7 + [(f"u{i}",) for i in range(693)], "v string")
    assert tuples(heavy.frequent(edge, F.col("v"), 0.01, 700)) == [("c", 7)]
    big = spark.createDataFrame([("x" * 200_000,)] * 3, "v string")
    assert heavy.frequent(big, F.col("v"), 1.0, 3).first().n == 3


def test_many_candidates_are_joined(spark, monkeypatch):
    monkeypatch.setattr(heavy, "LISTED", 2)
    df = spark.createDataFrame([(str(i % 50),) for i in range(300)], "v string")
    assert len(heavy.most_frequent(df, F.col("v"), 10).collect()) == 10


# --- runs (4) ---

ALIKE = [
    ['time="2024-01-05T07:03:33.247886084Z" level=warning msg="leader  moved to lus in term 62693" module=mea', 'time="2024-02-05T07:04:06.332362084Z" level=warning msg="Leader moved to lus in term 7." module=mea'],
    ['{"severity":"WARN","message":"checksum in block bf10d32eafbb on cro","latency":7.045}', '{"message": "checksum in block req-c94ce040d9f1 on cro …", "latency": 39, "severity": "WARN"}', '{"latency":1e3,"severity":"WARN","message":"CHECKSUM in block 6d6349a6-8c14-4ef1-9123-8e4ec0c9334d on cro [=====>    ]"}'],
    ["<22>Jan  3 15:16:31 gla rux[316]: cache jog evicted 83650 entries in 13ms [===========>         ]", "<22>Jan 13 15:17:15 gla rux[9]: \x1b[1mcache jog evicted 9907 entries in 5.04 s\x1b[0m"],
    ["I0103 06:53:33.637215    3035 kai.go:603] peer 10.63.194.140", "I1231 06:53:40.861591       5 kai.go:3] peer 10.63.1.1:29077..."],
    ["[Info] (vin) 04/Jan/2024:11:23:11 +0200 leader moved in 741 ms", "[info] (vin) 04/Feb/2024:11:23:11 +0530 Leader moved in 0.3s.", "[info] (vin) 04/Feb/2024:11:23:11 +0530 Leader moved in 2m3.5s"],
    ['{"log":"\\u001b[31mreplica g lagging by 5.715s\\u001b[0m\\n","n":1}', '{"log":"replica g lagging by 7 ms.\\n","n":22}'],
    ["", ""],
]
UNLIKE = ["I0103 06:53:33.637215    3035 kai.go:603] peer", "E0103 06:53:33.637215    3035 kai.go:603] peer", "<22>Jan  3 15:16:31 h a[1]: x", "<19>Jan  3 15:16:31 h a[1]: x", '{"a":"peer"}', "peer", "peers", None, '{"a":"b"} {"a":"c"}', '{"a":"b"}']


def test_said(spark):
    flat = [(i, t) for i, g in enumerate(ALIKE) for t in g]
    got = spark.createDataFrame(flat, "i int, t string").select("i", "t", runs.said(F.col("t")).alias("s")).collect()
    for _, g in itertools.groupby(got, key=lambda r: r.i):
        assert len({r.s for r in g}) == 1, [r.s for r in g]
    assert len({r.s for r in got}) == len(ALIKE)
    other = spark.createDataFrame([(t,) for t in UNLIKE], "t string").select(runs.said(F.col("t")).alias("s")).collect()
    assert len({r.s for r in other}) == len(UNLIKE)


def brute_runs(rows, gap=600):
    out = []
    key = lambda x: (x is not None, x or 0)
    for s in {r[0] for r in rows}:
        line = sorted((r for r in rows if r[0] == s), key=lambda r: (key(r[1]), key(r[2])))
        run = [line[0]]
        for a, b in zip(line, line[1:]):
            if a[3] == b[3] and a[1] is not None and b[1] is not None and b[1] - a[1] <= gap:
                run.append(b)
            else:
                out.append((s, run[0][2], run[-1][2], len(run)))
                run = [b]
        out.append((s, run[0][2], run[-1][2], len(run)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_runs(spark, seed):
    rng = random.Random(seed)
    rows, word = [], "a"
    for i in range(1500):
        word = rng.choice("ab") if rng.random() < 0.2 else word
        rows.append((rng.choice(["hot"] * 7 + ["b", None]), 200 * i + rng.choice([0, 0, 900]), i, word if rng.random() > 0.01 else None))
    rows += [("long", 5, i, "same") for i in range(3000)] + [("late", None, 1, "x"), ("late", None, 2, "x"), ("late", 7, None, "x"), ("late", 7, 3, "x")]
    df = spark.createDataFrame([(*r, "?") for r in rows], "source string, ts bigint, seq bigint, raw_data string, n_lines string").repartition(6)
    got = runs.runs(df).collect()
    assert sorted(((r.source, r.first_seq, r.last_seq, r.n_lines) for r in got), key=repr) == brute_runs(rows)
    assert sum(r.n_lines for r in got) == len(rows)
    assert all(r.duration_s == r.last_ts - r.first_ts for r in got if r.first_ts is not None)


def test_runs_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 1, "x")] * 5 + [("a", 602, 2, "x"), ("a", 601, 3, "x")], "source string, ts bigint, seq bigint, raw_data string")
    assert tuples(runs.runs(df).select("n_lines", "duration_s")) == [(7, 601)]
    far = spark.createDataFrame([("a", 1, 1, "x"), ("a", 602, 2, "x")], "source string, ts bigint, seq bigint, raw_data string")
    assert runs.runs(far).count() == 2
    assert runs.runs(df.limit(0)).count() == 0


def test_said_of_long_runs(spark):
    n = 300_000
    texts = ["a" + " " * n + "b", "a" + "." * n + "b", "[" * n, "[" + "=" * n, "1" * n, "f" * n, "a " * n, '{"k":"' + "x " * n + '"}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.length(runs.said(F.col("t"))).alias("n"))
    assert [r.n for r in df.collect()][0] == 3
