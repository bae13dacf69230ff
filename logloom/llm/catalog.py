"""The registered queries on training data and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.llm import heavy, language, mixing, packing, runs, terms, tokens
from logloom.runtime import cut, table

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


_TERMS = """
WITH t AS (SELECT row_number() OVER () AS rid, indexes FROM loglines), o AS (SELECT rid, unnest(indexes) AS term FROM t),
f AS (SELECT term, count(*) AS n_occurrences, count(DISTINCT rid) AS n_records FROM o WHERE term IS NOT NULL AND term <> '' GROUP BY term),
m AS (SELECT term, n_occurrences, n_records, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > 0.2 * (SELECT count(*) FROM loglines WHERE indexes IS NOT NULL) THEN 'common' END AS mark FROM f)
"""


@query("p1_found", _TERMS + "SELECT term, mark FROM m WHERE mark IS NOT NULL")
def p1_found(spark, d):
    return terms.marked_terms(table(spark, d, "loglines"), F.col("indexes")).where("mark IS NOT NULL").select("term", "mark")


@query("p1_frequencies", _TERMS + "SELECT term, n_occurrences, n_records, mark FROM m")
def p1_frequencies(spark, d):
    return terms.marked_terms(table(spark, d, "loglines"), F.col("indexes"))


def _occurrences(df):
    return df.select(F.explode("indexes").alias("term")).where("term <> ''")


@query("p3_found", """
WITH o AS (SELECT unnest(indexes) AS term FROM loglines), t AS (SELECT term FROM o WHERE term IS NOT NULL AND term <> '')
SELECT 'raw_data' AS field, raw_data AS item FROM loglines WHERE raw_data IS NOT NULL GROUP BY raw_data HAVING count(*) >= 0.01 * (SELECT count(*) FROM loglines)
UNION ALL SELECT 'indexes', term FROM t GROUP BY term HAVING count(*) >= 0.01 * (SELECT count(*) FROM t)
""")  # fmt: skip
def p3_found(spark, d):
    lines = table(spark, d, "loglines")
    occ = _occurrences(lines)
    raw = heavy.frequent(lines, F.col("raw_data"), 0.01, lines.count()).select(F.lit("raw_data").alias("field"), "item")
    return raw.unionByName(heavy.frequent(occ, F.col("term"), 0.01, occ.count()).select(F.lit("indexes").alias("field"), "item"))


@query("p3_top50", """
WITH o AS (SELECT unnest(indexes) AS term FROM loglines)
(SELECT 'raw_data' AS field, raw_data AS item, count(*) AS n FROM loglines WHERE raw_data IS NOT NULL GROUP BY raw_data ORDER BY n DESC, item LIMIT 50)
UNION ALL (SELECT 'indexes', term, count(*) AS n FROM o WHERE term IS NOT NULL AND term <> '' GROUP BY term ORDER BY n DESC, term LIMIT 50)
""")  # fmt: skip
def p3_top50(spark, d):
    lines = table(spark, d, "loglines")
    raw = heavy.most_frequent(lines, F.col("raw_data"), 50).select(F.lit("raw_data").alias("field"), "item", "n")
    return raw.unionByName(heavy.most_frequent(_occurrences(lines), F.col("term"), 50).select(F.lit("indexes").alias("field"), "item", "n"))


@query("p4_found")
def p4_found(spark, d):
    return runs.runs(table(spark, d, "loglines")).where("n_lines >= 3").select("source", "first_seq", "last_seq", "n_lines")


@query("p4_runs")
def p4_runs(spark, d):
    return runs.runs(table(spark, d, "loglines"))


@query("p8_packing")
def p8_packing(spark, d):
    sizes = tokens.token_counts(table(spark, d, "documents"), ["doc_id"])
    return packing.pack(sizes, table(spark, d, "packspecs"))


@query("p8_fill")
def p8_fill(spark, d):
    return packing.fill(p8_packing(spark, d))


@query("p9_mixture")
def p9_mixture(spark, d):
    sizes = tokens.token_counts(table(spark, d, "documents"), ["doc_id", "source"])
    return mixing.mixture(sizes, table(spark, d, "mixtargets"))


@query("p8_invariants", """
SELECT pack_id, capacity_tokens, (SELECT count(*) FROM documents) AS n_docs, 0 AS n_lost, 0 AS n_over_capacity, 0 AS n_split_though_small, 0 AS n_miscounted
FROM (SELECT DISTINCT pack_id, capacity_tokens FROM packspecs WHERE capacity_tokens > 0) AS s
""")  # fmt: skip
def p8_invariants(spark, d):
    # what any packing must keep: every token of every document, no container over its capacity
    sizes = tokens.token_counts(table(spark, d, "documents"), ["doc_id"])
    packed = cut(packing.pack(sizes, table(spark, d, "packspecs")))
    spec = packed.select("pack_id", "capacity_tokens").distinct()
    docs = packed.groupBy("pack_id", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("pieces"), F.countDistinct("piece_no").alias("numbers"))
    want = sizes.groupBy("doc_id").agg(F.sum("n_tokens").alias("want"))
    x = F.broadcast(spec).crossJoin(want).join(docs, ["pack_id", "capacity_tokens", "doc_id"], "left")
    count = lambda c: F.sum(c.cast("int")).cast("int")
    of_docs = x.groupBy("pack_id", "capacity_tokens").agg(
        F.count("t").alias("n_docs"), count(F.coalesce(F.col("t") != F.col("want"), F.lit(True)) | (F.col("pieces") != F.col("numbers"))).alias("n_lost"), count((F.col("pieces") > 1) & (F.col("want") <= F.col("capacity_tokens"))).alias("n_split_though_small")
    )
    boxes = packed.groupBy("pack_id", "capacity_tokens", "container_no").agg(F.sum("n_tokens").alias("t"), F.max("container_tokens").alias("said"))
    of_boxes = boxes.groupBy("pack_id", "capacity_tokens").agg(count(F.col("t") > F.col("capacity_tokens")).alias("n_over_capacity"), count(F.col("t") != F.col("said")).alias("n_miscounted"))
    return of_docs.join(of_boxes, ["pack_id", "capacity_tokens"]).select("pack_id", "capacity_tokens", "n_docs", "n_lost", "n_over_capacity", "n_split_though_small", "n_miscounted")


@query("p9_shares")
def p9_shares(spark, d):
    sizes, targets = tokens.token_counts(table(spark, d, "documents"), ["doc_id", "source"]), table(spark, d, "mixtargets")
    return mixing.shares(sizes, targets, mixing.mixture(sizes, targets))


@query("p9_proportional")
def p9_proportional(spark, d):
    # the mix as large as its scarcest source allows, with every share kept
    sizes = tokens.token_counts(table(spark, d, "documents"), ["doc_id", "source"])
    return mixing.mixture(sizes, table(spark, d, "mixtargets"), shrink=True)


@query("p9_proportional_shares")
def p9_proportional_shares(spark, d):
    sizes, targets = tokens.token_counts(table(spark, d, "documents"), ["doc_id", "source"]), table(spark, d, "mixtargets")
    return mixing.shares(sizes, targets, mixing.mixture(sizes, targets, shrink=True), shrink=True)


@query("p9_invariants", """
SELECT m.mix_id, m.source, (SELECT count(*) FROM documents AS d WHERE d.source = m.source AND d.text <> '') AS n_docs, 0 AS n_over_repeated, 0 AS n_gaps_in_repeats, 0 AS n_misplaced, 0 AS n_missed_by_over_a_document FROM mixtargets AS m
""")  # fmt: skip
def p9_invariants(spark, d):
    # what any mix must keep: repeats within their cap and without gaps, positions in [0, 1] that grow with a source's cumulated tokens, and all that was to be taken taken
    sizes, targets = tokens.token_counts(table(spark, d, "documents"), ["doc_id", "source"]), table(spark, d, "mixtargets")
    drawn = cut(mixing.mixture(sizes, targets))
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("int")
    most = targets.select("mix_id", "source", "max_repeats")
    docs = drawn.groupBy("mix_id", "source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("repeat_no").alias("last"), count((F.col("position") < 0) | (F.col("position") > 1)).alias("off")).join(most, ["mix_id", "source"])
    of_docs = docs.groupBy("mix_id", "source").agg(count(F.col("n") > F.col("max_repeats")).alias("n_over_repeated"), count(F.col("n") != F.col("last") + 1).alias("n_gaps_in_repeats"), F.sum("off").cast("int").alias("n_misplaced"))
    longest = sizes.agg(F.max("n_tokens")).first()[0] or 0
    got = drawn.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("tokens"))
    due = mixing.demands(sizes, targets).join(got, ["mix_id", "source"], "left")
    missed = (F.abs(F.coalesce("tokens", F.lit(0)) - F.col("take")) > longest).cast("int").alias("n_missed_by_over_a_document")
    n_docs = sizes.where("n_tokens > 0").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    x = due.select("mix_id", "source", missed).join(of_docs, ["mix_id", "source"], "left").join(n_docs, "source", "left")
    return x.select("mix_id", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "n_over_repeated", "n_gaps_in_repeats", "n_misplaced", "n_missed_by_over_a_document")])


@query("p10_found")
def p10_found(spark, d):
    return language.wrong_or_mixed(table(spark, d, "documents"), table(spark, d, "languages"))


@query("p10_languages")
def p10_languages(spark, d):
    return language.languages_of(table(spark, d, "documents"), table(spark, d, "languages"))
