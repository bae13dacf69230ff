"""The registered queries of the core and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom import adapters
from logloom.functions import jsonpath
from logloom.functions.text import stems, stop_words, tokens, without_stop_words
from logloom.operators import drift, layouts, nested, skewed
from logloom.plans.planner import Request, plan
from logloom.plans.render import answer
from logloom.runtime import column_names, scratch, table
from logloom.sources import push, shipper, store
from logloom.streaming import live

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def logs(spark, d):
    return table(spark, d, "loglines")


def events(spark, d):
    return adapters.events_as_logs(table(spark, d, "events"))


# --- scans and row queries ---

_ORDER = "ORDER BY ts DESC, {rank} ASC, seq DESC"


def _plain(df):
    """Dots in the names of group columns as _."""
    return df.toDF(*[c.replace(".", "_") for c in df.columns])


def _piped(name: str, text: str, sql: str, request: Request = Request(), of=logs):  # noqa: B008
    query(name, sql)(lambda spark, d: _plain(plan(of(spark, d), text, request)))


_piped("scan_all", "", "SELECT ts, raw_data AS entry, source FROM loglines")
_piped("filter_source", "source=coxlotmet", "SELECT ts, raw_data AS entry, source FROM loglines WHERE source = 'coxlotmet' ORDER BY ts DESC, seq DESC LIMIT 10000")
_piped(
    "filter_source_multi", "source=terjundflind_droumoulsairk,coxlotmet,nosuch | limit 500",
    "SELECT ts, raw_data AS entry, source FROM loglines WHERE source IN ('terjundflind_droumoulsairk', 'coxlotmet') ORDER BY ts DESC, CASE source WHEN 'coxlotmet' THEN 2 ELSE 1 END, seq DESC LIMIT 500",
)
_piped("request_sources", "", "SELECT ts, raw_data AS entry, source FROM loglines WHERE source IN ('kube-cutrux', 'zainpir-gateway')", Request(partitions=("kube-cutrux", "zainpir-gateway")))
_piped("filter_time", "", "SELECT ts, raw_data AS entry, source FROM loglines WHERE ts BETWEEN 1704300000 AND 1704330000", Request(1704300000, 1704330000))
_piped("tail_newest_limit", "limit 25", "SELECT ts, raw_data AS entry, source FROM loglines ORDER BY ts DESC, source, seq DESC LIMIT 25")
_piped("head_oldest_limit", "limit 25", "SELECT ts, raw_data AS entry, source FROM loglines ORDER BY ts, source, seq LIMIT 25", Request(forward=True))
_piped("default_limit", "distance 3", "SELECT ts, raw_data AS entry, source FROM loglines ORDER BY ts DESC, source, seq DESC LIMIT 10000")
_piped("request_count_offset", "limit 9", "SELECT ts, raw_data AS entry, source FROM loglines ORDER BY ts DESC, source, seq DESC LIMIT 40 OFFSET 10", Request(count=40, offset=10))


@query("list_sources", "SELECT DISTINCT source FROM loglines WHERE source IS NOT NULL")
def list_sources(spark, d):
    return store.sources(logs(spark, d))


# --- fuzzy selection ---

_NEAR = "coalesce(len(list_filter(indexes, lambda t: levenshtein(t, '{v}') <= {d})) > 0, false)"
_piped("fuzzy_message", 'message = "brokr"', f"SELECT ts, raw_data AS entry, source FROM loglines WHERE {_NEAR.format(v='brokr', d=2)} ORDER BY ts DESC, source, seq DESC LIMIT 10000")
_piped("fuzzy_distance_1", 'message = "expired" | distance 1', f"SELECT ts, raw_data AS entry, source FROM loglines WHERE {_NEAR.format(v='expired', d=1)} ORDER BY ts DESC, source, seq DESC LIMIT 10000")
_piped(
    "structured_select", 'details.message = "broker"',
    f"SELECT ts, raw_data AS entry, source FROM loglines WHERE list_contains(json_keys, 'details.message') AND {_NEAR.format(v='broker', d=2)} ORDER BY ts DESC, source, seq DESC LIMIT 10000",
)


def _stored(spark, d):
    path = scratch(spark, "store")
    store.write(logs(spark, d), path)
    return path


@query("term_index_lookup", f"SELECT DISTINCT t.term, l.source, CAST(make_date(1970, 1, 1) + CAST(floor(ts / 86400) AS INT) AS DATE) AS event_date FROM (SELECT *, unnest(indexes) AS term FROM loglines) AS l, (SELECT l.term) AS t WHERE levenshtein(l.term, 'brokr') <= 2")
def term_index_lookup(spark, d):
    return store.near_terms(spark, _stored(spark, d), "brokr", 2)


@query("store_search", f"SELECT ts, raw_data AS entry, source FROM loglines WHERE {_NEAR.format(v='brokr', d=2)} ORDER BY ts DESC, source, seq DESC LIMIT 10000")
def store_search(spark, d):
    # the term table names the terms and the directories, lines are only compared with those terms
    return store.search(spark, _stored(spark, d), 'message = "brokr"')


@query("store_time_range", "SELECT ts, raw_data AS entry, source FROM loglines WHERE ts BETWEEN 1704300000 AND 1704330000")
def store_time_range(spark, d):
    # the table of files names those whose bounds overlap the range
    return store.search(spark, _stored(spark, d), "", Request(1704300000, 1704330000))


# --- aggregates ---

_J = "(SELECT *, CASE WHEN json_valid(raw_data) THEN raw_data::JSON END AS j FROM loglines) AS x"
_EV = "(SELECT *, CASE WHEN json_valid(props) THEN props::JSON END AS p FROM events) AS e"
_piped("count", "count(level) as n", f"SELECT count(*) AS n FROM {_J} WHERE json_exists(j, '$.level')")
_piped("count_by", "count(user_id) as n by event_type", "SELECT event_type, count(user_id) AS n FROM events GROUP BY event_type", of=events)
_piped("count_by_level", "count(msg) as n by level", f"SELECT coalesce(json_extract_string(j, '$.level'), '\"\"') AS level, count(*) AS n FROM {_J} WHERE json_exists(j, '$.msg') GROUP BY 1")
_piped("count_missing_key", "count(msg) as n by nosuch.key", f"SELECT '\"\"' AS nosuch_key, count(*) AS n FROM {_J} WHERE json_exists(j, '$.msg') HAVING count(*) > 0")
_piped(
    "json_dotted_path", "count(kubernetes.labels.app.io/name) as n by kubernetes.labels.lvl",
    f"SELECT coalesce(json_extract_string(j, '$.kubernetes.labels.lvl'), '\"\"') AS kubernetes_labels_lvl, count(*) AS n FROM {_J} WHERE json_exists(j, '$.kubernetes.labels.\"app.io/name\"') GROUP BY 1",
)
_piped("distinct", "distinct(severity)", f"SELECT DISTINCT json_extract_string(j, '$.severity') AS value FROM {_J} WHERE structured AND json_exists(j, '$.severity')")
_piped("distinct_count", "distinct_count(details.error_code)", f"SELECT json_extract_string(j, '$.details.error_code') AS value, count(*) AS count FROM {_J} WHERE structured AND json_exists(j, '$.details.error_code') GROUP BY 1")


def _rounded(name: str, text: str, column: str, sql: str, of=logs):
    # sums of doubles depend on their order
    query(name, sql)(lambda spark, d: _plain(plan(of(spark, d), text)).withColumn(column, F.round(column, 6)))


_rounded("avg", "avg(latency) as a", "a", f"SELECT round(coalesce(avg(CAST(json_extract_string(j, '$.latency') AS DOUBLE)), 0), 6) AS a FROM {_J} WHERE structured")
_rounded("avg_by", "avg(latency) as a by severity", "a", f"SELECT json_extract_string(j, '$.severity') AS severity, round(avg(CAST(json_extract_string(j, '$.latency') AS DOUBLE)), 6) AS a FROM {_J} WHERE structured AND json_exists(j, '$.latency') GROUP BY 1")
_rounded("avg_nested_by", "avg(value) as a by props.k", "a", f"SELECT coalesce(json_extract_string(p, '$.k'), '\"\"') AS props_k, round(avg(value), 6) AS a FROM {_EV} WHERE value IS NOT NULL GROUP BY 1", events)
_rounded("avg_of_text", "avg(details.error_code) as a by from", "a", f"SELECT coalesce(json_extract_string(j, '$.from'), '\"\"') AS \"from\", round(avg(CAST(json_extract_string(j, '$.details.error_code') AS DOUBLE)), 6) AS a FROM {_J} WHERE structured AND json_exists(j, '$.details.error_code') GROUP BY 1")
_piped(
    "combined_pipeline", 'message="expires" | count(level) as n by level',
    f"SELECT json_extract_string(j, '$.level') AS level, count(*) AS n FROM {_J} WHERE json_exists(j, '$.level') AND {_NEAR.format(v='expires', d=2)} GROUP BY 1",
)


@query("render_json", """
SELECT CAST(row_number() OVER (ORDER BY ts DESC, source, seq DESC) - 1 AS INT) AS place, ts, source, CASE WHEN json_valid(raw_data) AND json_type(raw_data) IN ('OBJECT', 'ARRAY') THEN 'json' ELSE raw_data END AS entry
FROM loglines ORDER BY ts DESC, source, seq DESC LIMIT 200
""")  # fmt: skip
def render_json(spark, d):
    # the envelope read back: a text entry as it was, JSON entries as JSON
    text = spark.createDataFrame([(answer(logs(spark, d), "limit 200"),)], "t string").select(F.parse_json("t").alias("v"))
    rows = text.select(F.posexplode(F.variant_get("v", "$.data", "array<variant>")).alias("place", "r"))
    entry = F.variant_get("r", "$.entry", "variant")
    is_json = F.substring(F.to_json(entry), 1, 1).isin("{", "[")
    return rows.select("place", F.variant_get("r", "$.ts", "bigint").alias("ts"), F.variant_get("r", "$.source", "string").alias("source"), F.when(is_json, "json").otherwise(F.variant_get(entry, "$", "string")).alias("entry"))


@query("render_groups", f"""
WITH g AS (SELECT coalesce(json_extract_string(j, '$.level'), '""') AS level, count(*) AS n FROM {_J} WHERE json_exists(j, '$.msg') GROUP BY 1)
SELECT level AS g, CAST(n AS VARCHAR) AS n FROM g
""")  # fmt: skip
def render_groups(spark, d):
    text = spark.createDataFrame([(answer(logs(spark, d), "count(msg) as n by level"),)], "t string")
    rows = text.select(F.explode(F.from_json("t", "data array<struct<level:string,n:string>>")["data"]).alias("r"))
    return rows.select(F.col("r.level").alias("g"), "r.n")


# --- text and keys ---


@query("tokenize_terms", "SELECT term, count(*) AS n FROM (SELECT unnest(string_split(raw_data, ' ')) AS term FROM loglines WHERE NOT structured) AS t GROUP BY term")
def tokenize_terms(spark, d):
    t = logs(spark, d).where("NOT structured").select(F.explode(tokens(F.col("raw_data"))).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


# fixed values: the stop words of the English list
_STOPS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those
am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below
to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just
don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't
don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's would
"""
_STOPPED = f"string_split_regex(trim(regexp_replace($${_STOPS}$$, '\\s+', ' ', 'g')), ' ')"


@query("stopword_terms", f"SELECT term, count(*) AS n FROM (SELECT unnest(string_split(raw_data, ' ')) AS term FROM loglines WHERE NOT structured) AS t WHERE NOT list_contains({_STOPPED}, term) GROUP BY term")
def stopword_terms(spark, d):
    t = without_stop_words(tokens(F.col("raw_data")), stop_words(spark))
    return logs(spark, d).where("NOT structured").select(F.explode(t).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("stemmed_terms")
def stemmed_terms(spark, d):
    t = stems(without_stop_words(tokens(F.col("raw_data")), stop_words(spark)))
    return logs(spark, d).where("NOT structured").select(t.alias("t")).select(F.explode("t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


_OBJECTS = "(SELECT *, raw_data::JSON AS j FROM loglines WHERE structured AND json_valid(raw_data) AND json_type(raw_data) = 'OBJECT') AS x, json_tree(x.j) AS n"
_DOTTED = "replace(regexp_replace(n.fullkey[3:], '\\[\\d+\\]', '', 'g'), '\"', '')"


@query("flatten_keys", f"SELECT source, seq, {_DOTTED} AS key, CAST(count(*) AS INT) AS n_leaves FROM {_OBJECTS} WHERE n.type NOT IN ('OBJECT', 'ARRAY') GROUP BY ALL")
def flatten_keys(spark, d):
    x = logs(spark, d).where("structured").select("source", "seq", jsonpath.flatten(F.col("raw_data")).alias("flat"))
    return x.select("source", "seq", F.explode("flat").alias("key", "leaves")).select("source", "seq", "key", F.size("leaves").alias("n_leaves"))


@query("object_keys", f"SELECT source, seq, {_DOTTED} AS key FROM {_OBJECTS} WHERE n.type <> 'OBJECT' AND NOT contains(n.fullkey, '[')")
def object_keys(spark, d):
    return logs(spark, d).where("structured").select("source", "seq", F.explode(jsonpath.object_keys(F.col("raw_data"))).alias("key"))


@query("reindex")
def reindex(spark, d):
    return store.reindex(logs(spark, d)).select("source", "seq", F.size("indexes").alias("n_terms"), F.size("json_keys").alias("n_keys"))


# --- pushes, store, stream ---

_SEQ = """
SELECT source, push_id, place - 1 AS place, l.ts AS ts, l.raw_data AS raw_data, row_number() OVER (PARTITION BY source ORDER BY pushed_at, push_id, place) AS seq
FROM (SELECT source, push_id, pushed_at, unnest(lines) AS l, generate_subscripts(lines, 1) AS place FROM pushes) AS p WHERE l IS NOT NULL
"""


@query("ingest_pushes", _SEQ)
def ingest_pushes(spark, d):
    x = push.with_seq(push.lines_of(table(spark, d, "pushes")), ["pushed_at", "push_id", "place"])
    return x.select("source", "push_id", F.col("place").cast("bigint").alias("place"), "ts", "raw_data", "seq")


@query("store_roundtrip", "SELECT source, ts, seq, structured, raw_data FROM loglines")
def store_roundtrip(spark, d):
    return store.read(spark, _stored(spark, d)).select("source", "ts", "seq", "structured", "raw_data")


_SEGMENTS = """
SELECT source, CAST(floor((seq - 1) / 400) + 1 AS BIGINT) AS segment_id, arg_min(ts, seq) AS start_ts, arg_max(ts, seq) AS end_ts, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS n_lines
FROM loglines GROUP BY 1, 2
"""


@query("segment_catalog", _SEGMENTS)
def segment_catalog(spark, d):
    return store.segments(logs(spark, d))


@query("retention", f"WITH s AS ({_SEGMENTS}) SELECT s.source, segment_id, end_ts FROM s JOIN sources USING (source) WHERE 1705090000 - end_ts > retention_s")
def retention(spark, d):
    s = store.segments(logs(spark, d)).join(table(spark, d, "sources").select("source", "retention_s"), "source")
    return store.expired(s, 1705090000, F.col("retention_s")).select("source", "segment_id", "end_ts")


@query("retained_lines", f"WITH s AS ({_SEGMENTS}) SELECT l.source, l.seq FROM loglines AS l JOIN s ON s.source = l.source AND s.segment_id = floor((l.seq - 1) / 400) + 1 WHERE NOT (1705290000 - end_ts > 864000)")
def retained_lines(spark, d):
    return store.retain(logs(spark, d), 1705290000, 864000).select("source", "seq")


@query("registry_lookup", "SELECT source, segment_id FROM segments WHERE least(start_ts, end_ts) <= 1704330000 AND greatest(start_ts, end_ts) >= 1704300000")
def registry_lookup(spark, d):
    return store.overlapping(table(spark, d, "segments"), 1704300000, 1704330000).select("source", "segment_id")


_PUSHED = "SELECT source, pushed_at, push_id, unnest(lines) AS l, generate_subscripts(lines, 1) AS place FROM pushes"


@query("ingest_twice", f"""
WITH p AS ({_PUSHED}), k AS (SELECT *, CASE WHEN push_id % 2 = 0 THEN 0 ELSE 1 END AS turn FROM p WHERE l IS NOT NULL AND l.raw_data IS NOT NULL AND l.ts IS NOT NULL AND l.structured IS NOT NULL AND source IS NOT NULL)
SELECT source, l.ts AS ts, l.raw_data AS raw_data, row_number() OVER (PARTITION BY source ORDER BY turn, pushed_at, push_id, place) AS seq FROM k
""")  # fmt: skip
def ingest_twice(spark, d):
    # two pushes' worth of batches into one store: numbers go on where the first ended
    lines = push.lines_of(table(spark, d, "pushes")).where("source IS NOT NULL AND ts IS NOT NULL AND raw_data IS NOT NULL AND structured IS NOT NULL")
    path = scratch(spark, "store")
    for turn in (0, 1):
        store.ingest(lines.where(F.pmod("push_id", F.lit(2)) == turn), path, ["pushed_at", "push_id", "place"], index=False)
    return store.read(spark, path).select("source", "ts", "raw_data", "seq")


def _lineitems(spark, d):
    return adapters.lineitems_as_logs(table(spark, d, "lineitem"))


_LINES = "SELECT CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts, concat(l_orderkey, '-', l_linenumber) AS entry, l_returnflag AS source, l_orderkey * 8 + l_linenumber AS seq FROM lineitem"
_piped("default_limit_reached", "distance 3", f"SELECT ts, entry, source FROM ({_LINES}) AS x ORDER BY ts DESC, source, seq DESC LIMIT 10000", of=_lineitems)


@query("stream_tail", "SELECT source AS app, ts, structured, raw_data AS \"inner\" FROM loglines WHERE source IN ('coxlotmet', 'kube-cutrux')")
def stream_tail(spark, d):
    out = scratch(spark, "tail")
    rows = live.tail(spark, f"{d}/loglines.parquet", ["coxlotmet", "kube-cutrux"])
    rows.writeStream.format("parquet").option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


# --- the shipper's parsers ---


def _parsed(name: str, f, sql: str):
    @query(name, sql)
    def run(spark, d):
        x = logs(spark, d).where("NOT structured").select("source", "seq", f(F.col("raw_data")).alias("_p")).where("_p IS NOT NULL")
        return x.select("source", "seq", *[F.col(f"_p.{n}").alias(f"f_{n}") for n in x.schema["_p"].dataType.names])


_TEXT = "(SELECT source, seq, raw_data AS t FROM loglines WHERE NOT structured) AS x"
# independent of the parsers' patterns: cut at the separators of each layout
_parsed("klog_parse", shipper.klog, f"""
SELECT source, seq, t[1:1] AS f_severity, t[2:position(' ' IN t[7:]) + 5] AS f_time, split_part(ltrim(t[position(' ' IN t[7:]) + 6:], ' '), ' ', 1) AS f_pid,
split_part(split_part(ltrim(ltrim(t[position(' ' IN t[7:]) + 6:], ' '), '0123456789')[2:], '] ', 1), ' ', 1) AS f_source, substr(t, position('] ' IN t) + 2) AS f_message
FROM {_TEXT} WHERE regexp_matches(t, '^[A-Z][0-9][0-9][0-9][0-9] [0-9:.]+ +[0-9]+ [^ ]+[]] ')
""")  # fmt: skip
_parsed("docker_parse", shipper.docker, f"""
SELECT source, seq, split_part(t, '"', 2) AS f_time, split_part(split_part(t, ' level=', 2), ' ', 1) AS f_severity, split_part(split_part(t, ' msg="', 2), '"', 1) AS f_message, '' AS f_error, '' AS f_status_code
FROM {_TEXT} WHERE starts_with(t, 'time="') AND contains(t, ' level=') AND contains(t, ' msg="')
""")  # fmt: skip
_parsed("syslog_parse", shipper.syslog, f"""
SELECT source, seq, CASE WHEN t[1:1] = '<' THEN split_part(t[2:], '>', 1) ELSE '' END AS f_pri, u[1:15] AS f_time, split_part(u[17:], ' ', 1) AS f_host, split_part(split_part(u[17:], ' ', 2), '[', 1) AS f_ident,
split_part(split_part(split_part(u[17:], ' ', 2), '[', 2), ']', 1) AS f_pid, ltrim(split_part(substr(u, position(']: ' IN u) + 3), chr(10), 1), ' ') AS f_message
FROM (SELECT *, CASE WHEN t[1:1] = '<' THEN substr(t, position('>' IN t) + 1) ELSE t END AS u FROM {_TEXT}) AS y WHERE regexp_matches(u, '^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [ 0-9][0-9] [0-9:]+ ') AND NOT contains(u, chr(10)) AND NOT contains(u, chr(13))
""")  # fmt: skip
_AUDIT = ", ".join(rf"""regexp_extract_all(raw_data, '\s{k}="((?:[^"\\]|\\.)*)"', 1)[-1] AS f_{k}""" for k in shipper.AUDIT_FIELDS)
_parsed("audit_parse", shipper.audit, rf"SELECT source, seq, split_part(raw_data, ' ', 1) AS f_time, {_AUDIT} FROM loglines WHERE NOT structured AND regexp_matches(raw_data, '^\S+ AUDIT:')")


@query("salt_parse", f"""
SELECT source, seq, t[1:19] AS f_time, rtrim(split_part(split_part(t, '][', 2), ']', 1), ' ') AS f_severity, regexp_replace(substr(t, position('][' IN t) + 2), '^[^]]*[]][[][0-9]*[]] ', '') AS f_message
FROM {_TEXT} WHERE regexp_matches(t, '^[0-9-]+ [0-9:]+,[0-9]+ [[][^]]*[]][[][A-Z]+ *[]][[][0-9]+[]] ') AND NOT contains(t, chr(10)) AND NOT contains(t, chr(13))
""")  # fmt: skip
def salt_parse(spark, d):
    # the salt programs' layout, which has no process id
    text = F.regexp_replace("raw_data", r"^(\S+ \S+ \[[^\]]*\]\[[^\]]*\])\[\d+\] ", "$1 ")
    x = logs(spark, d).where("NOT structured").select("source", "seq", shipper.salt(text).alias("_p")).where("_p IS NOT NULL")
    return x.select("source", "seq", *[F.col(f"_p.{n}").alias(f"f_{n}") for n in ("time", "severity", "message")])


@query("container_parse", "SELECT source, seq, json_extract_string(j, '$.log') AS log, json_extract_string(j, '$.stream') AS stream, CAST(floor(epoch(TRY_CAST(json_extract_string(j, '$.time') AS TIMESTAMPTZ))) AS BIGINT) AS ts FROM (SELECT *, CASE WHEN json_valid(raw_data) THEN raw_data::JSON END AS j FROM loglines) AS x WHERE structured AND json_extract_string(j, '$.log') IS NOT NULL")
def container_parse(spark, d):
    x = logs(spark, d).where("structured").select("source", "seq", shipper.container(F.col("raw_data")).alias("p")).where("p.log IS NOT NULL")
    return x.select("source", "seq", "p.log", "p.stream", "p.ts")


@query("route_records", f"""
WITH n AS (SELECT x.source, x.seq, x.ts, json_extract_string(x.j, '$.kubernetes.pod_name') AS pod, n.type, n.atom, n.fullkey, n.key FROM {_OBJECTS} WHERE json_extract_string(x.j, '$.kubernetes.pod_name') IS NOT NULL),
w AS (SELECT source, seq, unnest(string_split(trim(regexp_replace(json_extract_string(atom, '$'), '\\s+', ' ', 'g'), ' '), ' ')) AS term FROM n WHERE type = 'VARCHAR' AND regexp_matches(fullkey, '^[^\\[]*(\\[[0-9]+\\])?$') AND NOT (contains(fullkey, '[') AND NOT ends_with(fullkey, ']'))),
k AS (SELECT source, seq, any_value(ts) AS ts, any_value(pod) AS pod, count(*) FILTER (WHERE type <> 'OBJECT' AND NOT contains(fullkey, '[')) AS n_keys FROM n GROUP BY source, seq),
c AS (SELECT source, seq, count(*) AS n_terms FROM w WHERE term <> '' AND NOT list_contains({_STOPPED}, term) GROUP BY source, seq)
SELECT pod AS source, ts, CAST(coalesce(n_terms, 0) AS INT) AS n_terms, CAST(n_keys AS INT) AS n_keys FROM k LEFT JOIN c USING (source, seq)
""")  # fmt: skip
def route_records(spark, d):
    return shipper.routed(logs(spark, d).where("structured"), "raw_data", F.col("ts"), stop_words(spark)).select("source", "ts", F.size("indexes").alias("n_terms"), F.size("json_keys").alias("n_keys"))


@query("multiline_group", r"""
WITH t AS (SELECT DISTINCT app, line_no, "inner" FROM taillines), s AS (SELECT *, max(CASE WHEN regexp_matches("inner", '^\w\d{4}') THEN line_no END) OVER (PARTITION BY app ORDER BY line_no) AS first FROM t)
SELECT app, first, string_agg("inner", chr(10) ORDER BY line_no) AS "inner" FROM s WHERE first IS NOT NULL GROUP BY app, first
""")  # fmt: skip
def multiline_group(spark, d):
    lines = table(spark, d, "taillines").select("app", "line_no", "inner").distinct()
    return shipper.multiline(lines, ["app"], "line_no", "inner", shipper.KLOG_FIRST)


# --- problems 2, 5, 6 and 7 ---


@query("p2_found", """
WITH RECURSIVE s AS (SELECT row_number() OVER () AS line, source, seq, raw_data::JSON AS j FROM loglines WHERE structured AND json_valid(raw_data)),
t AS (SELECT s.line, s.source, s.seq, n.id, n.parent AS up, n.key, n.type FROM s, json_tree(s.j) AS n WHERE n.type IN ('OBJECT', 'ARRAY')),
r AS (
  SELECT line, source, seq, id, up, type, '' AS pointer, '' AS below FROM t WHERE up IS NULL
  UNION ALL
  SELECT t.line, t.source, t.seq, t.id, t.up, t.type, r.pointer || '/' || replace(replace(t.key, '~', '~0'), '/', '~1'), CASE WHEN r.type = 'ARRAY' AND t.type = 'OBJECT' THEN r.pointer || '/' || t.key ELSE r.below END
  FROM r JOIN t ON t.line = r.line AND t.up = r.id
)
SELECT c.source, c.seq, c.pointer, p.below AS parent FROM r AS c JOIN r AS p ON p.line = c.line AND p.id = c.up WHERE c.type = 'OBJECT' AND p.type = 'ARRAY'
""")  # fmt: skip
def p2_found(spark, d):
    lines = logs(spark, d).where("structured")
    return nested.nested_objects(lines, "raw_data", ["source", "seq"]).select("source", "seq", "pointer", "parent")


@query("p2_schema")
def p2_schema(spark, d):
    return nested.merged_schema(logs(spark, d).where("structured"), F.col("raw_data"))


@query("p2_children")
def p2_children(spark, d):
    return nested.child_rows(logs(spark, d).where("structured"), "raw_data", ["source", "seq"])


@query("p2_containers")
def p2_containers(spark, d):
    lines = logs(spark, d).where("structured")
    none = nested.nested_objects(lines.limit(0), "raw_data", ["source", "seq"]).select("source", "seq", "pointer", "parent", "ordinal")
    return nested.child_tables(lines, "raw_data", ["source", "seq"]).get("/spec/containers/*", none)


@query("p5_found")
def p5_found(spark, d):
    return layouts.all_entries(logs(spark, d), table(spark, d, "taillines"))


@query("p5_log_entries")
def p5_log_entries(spark, d):
    return layouts.log_entries(logs(spark, d))


@query("p5_tail_entries")
def p5_tail_entries(spark, d):
    return layouts.tail_entries(table(spark, d, "taillines"), with_message=True)


@query("p5_templates")
def p5_templates(spark, d):
    lines = logs(spark, d).where("NOT structured").select(layouts.first_line(F.col("raw_data")).alias("line"))
    return layouts.templates(layouts.leaves(lines))


@query("p6_found")
def p6_found(spark, d):
    return drift.changes(table(spark, d, "pushes"))


@query("p6_statistics")
def p6_statistics(spark, d):
    return drift.path_stats(table(spark, d, "pushes"))


@query("p6_consistent_rows")
def p6_consistent_rows(spark, d):
    # the wide table of every path, here back in rows of path and value
    pushes = table(spark, d, "pushes")
    types = drift.column_types(pushes)
    wide = drift.consistent_table(pushes, types)
    names = dict(zip([p for p, _ in types], column_names([p for p, _ in types]), strict=True))
    cells = F.array(*[F.struct(F.lit(p).alias("path"), F.col(c).cast("string").alias("value")) for p, c in names.items()])
    x = wide.select("source", "push_id", "ts", F.explode(F.filter(cells, lambda s: s["value"].isNotNull())).alias("c"))
    return x.select("source", "push_id", "ts", "c.path", "c.value")


@query("p6_failed_casts")
def p6_failed_casts(spark, d):
    return drift.failed_casts(table(spark, d, "pushes"))


@query("p7_found", """
WITH w AS (SELECT source, seq, ts, max(ts) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM loglines)
SELECT source, seq FROM w WHERE top > ts
""")  # fmt: skip
def p7_found(spark, d):
    return skewed.late_rows(logs(spark, d)).select("source", "seq")


@query("p7_totals", """
WITH w AS (SELECT source, ts, max(ts) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM loglines)
SELECT source, count(*) AS n_late, CAST(sum(top - ts) AS BIGINT) AS behind_s FROM w WHERE top > ts GROUP BY source
""")  # fmt: skip
def p7_totals(spark, d):
    late = skewed.late_rows(logs(spark, d))
    return skewed.key_totals(late, "source", "behind").select("source", F.col("n").alias("n_late"), F.col("total").alias("behind_s"))
