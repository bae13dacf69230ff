"""Semi-structured log lines into fields (problem 5), by iterative partitioning.

Lines are reduced to signatures (decoration off, digit runs as ``#``). The table of distinct
signatures is split by token count, then by the values of each partition's least-variable
position, then by the bijections between two positions; partitions whose head positions still hold
values of several kinds go through the last two steps again. Every leaf gives a template: its
constants and variable slots. What a slot of the head holds - date, time, zone, level, component,
number, words - is inferred from the values that the leaf's signatures have there, and from the
order of these slots follows the pattern by which the leaf's lines are cut. There is no list of
layouts: a program's layout is whatever its leaves show.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.ordered import running_max
from logloom.runtime import cut

ANSI = r"\x1B\[[0-9;]*[A-Za-z]"
#: Tokens of a template among which its head is looked for.
HEAD = 8
#: A partition with at least this share of constant positions isn't split by bijections.
GOOD = 0.6
#: Patterns that are named in the query; where leaves show more, each line brings its own.
NAMED = 128
#: Of a one-to-many relation, the many side is variable above this share of distinct tokens per line.
VARIABLE = 0.5

#: What the slots of a head give, in this order.
SLOTS = ["year", "month", "day", "time", "fraction", "zone", "level", "component", "priority", "seconds", "message"]
LEVELS = {
    "DEBUG": ["trace", "debug", "dbg", "t", "d"],
    "INFO": ["info", "notice", "information", "i", "n"],
    "WARN": ["warn", "warning", "w"],
    "ERROR": ["error", "err", "e"],
    "FATAL": ["fatal", "critical", "crit", "alert", "emerg", "emergency", "panic", "f", "c", "a"],
}
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


# kinds of what a token holds, as Greek letters: date, time, zone, day with month name and time, month
# name, level, single capital, word
_MONTH, _LEVEL = "|".join(MONTHS), "|".join(w for ws in LEVELS.values() for w in ws if len(w) > 1)
KINDS = [
    (r"(?<![\p{L}#])#/(?:" + _MONTH + r")/#:#:#:#", "κ"),
    (r"(?<![\p{L}#/.-])#([-/])#\1#(?![/.#-])", "δ"),
    (r"(?:(?<![\p{L}#:])|(?<=δT))#:#:#(?:[.,]#)?(?![#:])", "τ"),
    ("δTτ", "δτ"),
    (r"(?<=τ)(?:Z|[+-]#(?::#)?)|(?<= )[+-]#(?::#)?(?= |$)", "ζ"),
    (r"(?<![\p{L}#])(?:" + _MONTH + r")(?![\p{L}#=])", "μ"),
    (r"(?<![\p{L}#_.-])(?i:" + _LEVEL + r")(?![\p{L}#_.=-])", "λ"),
    (r"(?<![\p{L}#_.-])\p{Lu}(?![\p{L}_.=-])", "α"),
    (r"[\p{L}_$@][\p{L}_$@#.-]*+(?!=)", "ω"),
]


def first_line(text: Column) -> Column:
    """The first line without terminal decoration."""
    return F.regexp_replace(F.substring_index(F.substring_index(text, "\n", 1), "\r", 1), ANSI, "")


def signature(line: Column) -> Column:
    """The line with digit runs as # and single spaces, none before a closing bracket."""
    sig = F.regexp_replace(F.regexp_replace(line, r"\d+", "#"), r"\s+(?=\])", "")
    return F.trim(F.regexp_replace(sig, r"\s{2,}|[^\S ]", " "))


def kinds(sig: Column) -> Column:
    """The kinds of a signature's first tokens, punctuation and the names of key=value kept."""
    out = F.array_join(F.slice(F.split(sig, " "), 1, HEAD), " ")
    # in between the kinds are digits, of which a signature has none
    greek, digits = "δτζκμλαω", "12345678"
    coded = str.maketrans(greek, digits)
    for pattern, kind in KINDS:
        out = F.regexp_replace(out, pattern.translate(coded), kind.translate(coded))
    return F.split(F.translate(out, digits, greek), " ")


def tokens() -> Column:
    return F.split("sig", " ")


def signatures(lines: DataFrame) -> DataFrame:
    """(sig, lines, kinds): the distinct signatures of a column ``line``; none for null."""
    s = lines.select(signature(F.col("line")).alias("sig")).where("sig IS NOT NULL")
    return s.groupBy("sig").agg(F.count(F.lit(1)).alias("lines")).withColumn("kinds", kinds(F.col("sig")))


def _hashed(sigs: DataFrame) -> DataFrame:
    """(part, pos, tok): the tokens of every partition by position, as 64-bit hashes."""
    return sigs.select("part", F.posexplode(F.transform(tokens(), lambda t: F.xxhash64(t))).alias("pos", "tok"))


def _cardinalities(sigs: DataFrame) -> DataFrame:
    """(part, pos, distinct): how many tokens each position of each partition has."""
    return _hashed(sigs).distinct().groupBy("part", "pos").agg(F.count(F.lit(1)).alias("distinct"))


def by_count(sigs: DataFrame) -> DataFrame:
    """Step 1: a partition per number of tokens."""
    return sigs.withColumn("part", F.xxhash64(F.size(tokens())))


def by_least_variable(sigs: DataFrame, within: int | None = None) -> DataFrame:
    """Step 2: split by the tokens of the position with the fewest distinct ones (at least two), of
    the first ``within`` positions if given."""
    c = _cardinalities(sigs).where("distinct > 1")
    c = c if within is None else c.where(F.col("pos") < within)
    best = c.groupBy("part").agg(F.min_by("pos", F.struct("distinct", "pos")).alias("_p"))
    out = sigs.join(best, "part", "left")
    tok = F.when(F.col("_p").isNotNull(), F.try_element_at(tokens(), F.col("_p") + 1))
    return out.withColumn("part", F.xxhash64("part", "_p", tok)).drop("_p")


def by_bijection(sigs: DataFrame) -> DataFrame:
    """Step 3: split by the relation between two positions of equal, most usual cardinality.

    Pairs that are one-to-one are partitions; of one-to-many pairs the one side splits if the
    many side is variable, else the many side; many-to-many pairs stay together.
    """
    c = _cardinalities(sigs)
    good = c.groupBy("part").agg((F.avg((F.col("distinct") == 1).cast("double")) >= GOOD).alias("_good"))
    usual = c.where("distinct > 1").groupBy("part", "distinct").agg(F.count(F.lit(1)).alias("k"), F.sort_array(F.collect_list("pos")).alias("ps"))
    two = usual.where("k > 1").groupBy("part").agg(F.min_by("ps", F.struct(-F.col("k"), "distinct")).alias("ps"))
    two = two.join(good.where("NOT _good").select("part"), "part", "left_semi").select("part", F.col("ps")[0].alias("_p1"), F.col("ps")[1].alias("_p2"))
    x = sigs.join(two, "part", "left")
    x = x.withColumn("_t1", F.when(F.col("_p1").isNotNull(), F.try_element_at(tokens(), F.col("_p1") + 1))).withColumn("_t2", F.when(F.col("_p2").isNotNull(), F.try_element_at(tokens(), F.col("_p2") + 1)))
    pairs = x.where("_p1 IS NOT NULL").groupBy("part", "_t1", "_t2").agg(F.count(F.lit(1)).alias("_n"))
    right = pairs.groupBy("part", "_t1").agg(F.count(F.lit(1)).alias("_of1"), F.sum("_n").alias("_n1"))
    left = pairs.groupBy("part", "_t2").agg(F.count(F.lit(1)).alias("_of2"), F.sum("_n").alias("_n2"))
    rel = pairs.join(right, ["part", "_t1"]).join(left, ["part", "_t2"])
    both, one, two = F.concat(F.lit("b "), "_t1", F.lit(" "), "_t2"), F.concat(F.lit("1 "), "_t1"), F.concat(F.lit("2 "), "_t2")
    key = (
        F.when((F.col("_of1") == 1) & (F.col("_of2") == 1), both)
        .when(F.col("_of2") == 1, F.when(F.col("_of1") > VARIABLE * F.col("_n1"), one).otherwise(two))
        .when(F.col("_of1") == 1, F.when(F.col("_of2") > VARIABLE * F.col("_n2"), two).otherwise(one))
    )
    split = rel.select("part", "_t1", "_t2", F.xxhash64(key).alias("_key"))
    return x.join(split, ["part", "_t1", "_t2"], "left").withColumn("part", F.xxhash64("part", F.coalesce("_key", F.lit(0)))).select(*sigs.columns)


class Mixed(Exception):
    """A slot of the head holds values of several kinds."""


class _Pattern:
    """A regular expression under construction and which of its groups is which slot."""

    def __init__(self):
        self.text, self.slots, self.n = "", {}, 0

    def add(self, text: str, *slots: str) -> None:
        self.text += text
        for name in slots:
            self.n += 1
            self.slots[name] = f"${self.n}"

    def space(self) -> None:
        self.text += " +" if self.text else ""

    def cutter(self) -> str:
        return "\x02" + "\x01".join(self.slots.get(x, "") for x in SLOTS)


_CLOCK, _OFFSET = r"(\d\d:\d\d:\d\d)(?:[.,](\d+))?", r"(Z|[+-]\d\d:?(?:\d\d)?)"
_GROUP = re.compile(r"\[([^\[\]]*)\]|\(([^()]*)\)|<([^<>]*)>")


def _stamp(p: _Pattern, at, i: int) -> int | None:
    """Adds the time that begins at slot ``i``; the slot after it, None if none begins there."""
    t = at(i) or ""
    p.space()
    if m := re.fullmatch(r"([A-Za-z_.@-]+=\"?|[\[(])?δτ(ζ?)([\"\])]?[:,]?)", t):
        p.add(re.escape(m[1] or "") + r"(\d{4})[-/](\d\d)[-/](\d\d)T" + _CLOCK, "year", "month", "day", "time", "fraction")
        if m[2]:
            p.add(_OFFSET, "zone")
        p.add(re.escape(m[3]))
        return i + 1
    if (m := re.fullmatch(r"([\[(]?)δ", t)) and (n := re.fullmatch(r"τ(ζ?)([\])]?[:,]?)", at(i + 1) or "")):
        p.add(re.escape(m[1]) + r"(\d{4})[-/](\d\d)[-/](\d\d) +" + _CLOCK, "year", "month", "day", "time", "fraction")
        if n[1]:
            p.add(_OFFSET, "zone")
        p.add(re.escape(n[2]))
        i += 2
    elif t == "κ":
        p.add(r"(\d\d)/(\w{3})/(\d{4}):(\d\d:\d\d:\d\d)", "day", "month", "year", "time")
        i += 1
    elif (m := re.fullmatch("(<#>)?μ", t)) and at(i + 1) == "#" and at(i + 2) == "τ":
        if m[1]:
            p.add(r"<(\d+)>", "priority")
        p.add(r"([A-Z][a-z]{2}) +(\d{1,2}) +" + _CLOCK, "month", "day", "time", "fraction")
        return i + 3
    elif t == "α#" and at(i + 1) == "τ":
        p.add(r"([A-Z])(\d\d)(\d\d) +" + _CLOCK, "level", "month", "day", "time", "fraction")
        return i + 2
    elif t == "[#.#]":
        p.add(r"\[(\d{9,11})\.(\d+)\]", "seconds", "fraction")
        return i + 1
    else:
        return None
    if at(i) == "ζ":
        p.add(" +" + _OFFSET, "zone")
        i += 1
    return i


def _grouped(p: _Pattern, t: str) -> bool:
    """Adds a slot of bracketed groups: level, component, numbers; False if it is none."""
    if not re.fullmatch(rf"(?:{_GROUP.pattern})+:?", t):
        return False
    for m in _GROUP.finditer(t):
        what = next(x for x in m.groups() if x is not None)
        open_, close = re.escape(m[0][0]), re.escape(m[0][-1])
        if what == "λ" and "level" not in p.slots:
            p.add(rf"{open_}(\w+)\s*{close}", "level")
        elif "ω" in what and "component" not in p.slots:
            p.add(rf"{open_}([^{close}]*?)\s*{close}", "component")
        else:
            p.add(rf"{open_}[^{close}]*{close}")
    p.add(":?" if t.endswith(":") else "")
    return True


def derive(low: list[str], high: list[str]) -> tuple[str, str] | None:
    """(pattern, cutter) of a leaf by the kinds of its slots, None if it shows no head with a time.

    ``low`` and ``high`` are the least and greatest kind at each slot; where they differ the leaf
    holds several kinds, and if the head reaches there, ``Mixed`` is raised.
    """

    def at(i: int) -> str | None:
        if i >= min(len(low), len(high)):
            if len(low) != len(high):
                raise Mixed
            return None
        if low[i] != high[i]:
            raise Mixed
        return low[i]

    p, i = _Pattern(), 0
    while (j := _stamp(q := _copy(p), at, i)) is None:
        # only bracketed slots and a level may come before the time
        p.space()
        t = at(i)
        if i >= 3 or t is None:
            return None
        if re.fullmatch("λ:?", t) and "level" not in p.slots:
            p.add(r"(\w+)" + t[1:], "level")
        elif not _grouped(p, t):
            return None
        i += 1
    p, i = q, j
    keyed, first = "=" in low[0], i
    while (t := at(i)) is not None:
        has_level, has_component = "level" in p.slots, "component" in p.slots
        if keyed and (m := re.fullmatch(r'([A-Za-z_.@-]+)=(.*)', t)):
            if re.fullmatch("\"?λ\"?", m[2]) and not has_level:
                p.add(" +" + re.escape(m[1]) + '="?(\\w+)"?', "level")
            elif m[1] in ("msg", "message"):
                break
            else:
                p.add(r" +\S+")
        elif has_level and has_component and not _SEPARATOR.fullmatch(t):
            break
        elif re.fullmatch("λ:?", t) and not has_level:
            p.add(r" +(\w+)" + t[1:], "level")
        elif t == "α" and at(i + 1) == "|" and not has_level:
            p.add(" +([A-Z])", "level")
        elif _SEPARATOR.fullmatch(t) and i > first:
            p.add(" +" + re.escape(t))
            if has_component:
                i += 1
                break
        elif t == "#" and not has_component:
            p.add(r" +\d+")
        elif t[0] in "[(<" and not has_component and _GROUP.match(t):
            if re.fullmatch(r"[\[(<]ω[\])>]", t) and at(i + 1) == "ω" and at(i + 2) == "-":
                p.add(r" +\S+")  # a thread's name, the component comes after it
            else:
                p.add(" +")
                if not _grouped(p, t):
                    p.text = p.text[:-2]
                    break
        elif has_component:
            break
        elif t == "ω:#]":
            p.add(r" +([^\s:]+):\d+\]", "component")
            i += 1
            break
        elif t == "ω/λ:":
            p.add(r" +([^\s/]+)/(\w+):", "component", "level")
            i += 1
            break
        elif t in ("ω:", "ω[#]:"):
            p.add(r" +([^\s\[:]+)(?:\[\d+\])?:", "component")
            i += 1
            break
        elif t == "ω" and at(i + 1) == "-":
            p.add(r" +(\S+) +-", "component")
            i += 2
            break
        elif t == "ω" and not has_level and re.fullmatch(r"\[?λ\]?", at(i + 1) or ""):
            p.add(r" +(\S+)", "component")
        elif t == "ω" and i == first and not has_level and at(i + 1) in ("ω:", "ω[#]:", "ω/λ:"):
            p.add(r" +\S+")  # a host's name
        else:
            break
        i += 1
    if keyed:
        p.add(r' *(?:(?:msg|message)=)?"?(.*?)"?(?: (?:module|logger|component)="?([^\s"]+)"?)?\s*', "message", *(["component"] if "component" not in p.slots else []))
    else:
        p.add(" ?(.*)", "message")
    return f"(?s)^{p.text}$", p.cutter()


_SEPARATOR = re.compile(r"[|-]|--|::?|>>?")


def _copy(p: _Pattern) -> _Pattern:
    q = _Pattern()
    q.text, q.slots, q.n = p.text, dict(p.slots), p.n
    return q


def _derived(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        out = []
        for part, low, high in zip(pdf["part"], pdf["low"], pdf["high"], strict=True):
            trim = lambda ks: [k for k in ks if k is not None]
            try:
                got = derive(trim(low), trim(high))
            except Mixed:
                out.append((part, True, None, None))
            else:
                out.append((part, False, *(got or (None, None))))
        yield pd.DataFrame(out, columns=["part", "mixed", "pattern", "cutter"])


def heads_of(sigs: DataFrame) -> DataFrame:
    """(part, mixed, pattern, cutter): per leaf how its lines are cut; null where it shows no head,
    and where it is mixed."""
    ends = [f(F.get("kinds", F.lit(i))).alias(f"{n}{i}") for i in range(HEAD) for n, f in (("l", F.min), ("h", F.max))]
    x = sigs.groupBy("part").agg(*ends)
    # a slot that some signature lacks is mixed: by_count keeps these apart
    x = x.select("part", F.array(*[f"l{i}" for i in range(HEAD)]).alias("low"), F.array(*[f"h{i}" for i in range(HEAD)]).alias("high"))
    return x.mapInPandas(_derived, "part bigint, mixed boolean, pattern string, cutter string")


def leaves(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaf of every distinct signature of a column ``line`` (sig, lines, kinds, part), and the
    leaves' heads (part, mixed, pattern, cutter).

    Mixed partitions are split again by one further head position each round, so that after
    ``HEAD`` rounds none is left.
    """
    sigs = cut(signatures(lines))
    now = cut(by_bijection(cut(by_least_variable(by_count(sigs)))))
    done: list[tuple[DataFrame, DataFrame]] = []
    for _ in range(HEAD + 1):
        found = cut(heads_of(now))
        done.append((now.join(found.where("NOT mixed").select("part"), "part", "left_semi"), found.where("NOT mixed")))
        if found.where("mixed").isEmpty():
            break
        rest = now.join(found.where("mixed").select("part"), "part", "left_semi")
        now = cut(by_bijection(cut(by_least_variable(rest, HEAD))))
    out, heads = done[0]
    for more, more_heads in done[1:]:
        out, heads = out.unionByName(more), heads.unionByName(more_heads)
    return out, heads


def templates(found: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(part, template, lines, pattern): per leaf its slots (a constant, or ``*``), how many lines
    it has and the pattern that cuts them (null without head)."""
    sigs, heads = found
    same = _hashed(sigs).groupBy("part", "pos").agg((F.min("tok") == F.max("tok")).alias("same"))
    same = same.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("pos", "same"))).alias("_s"))
    one = sigs.groupBy("part").agg(F.min("sig").alias("sig"), F.sum("lines").alias("lines")).join(same, "part").join(heads.select("part", "pattern"), "part", "left")
    constants = F.zip_with(tokens(), "_s", lambda t, s: F.when(s["same"], t).otherwise("*"))
    return one.select("part", F.array_join(constants, " ").alias("template"), "lines", "pattern")


def _level(word: Column) -> Column:
    known = F.create_map(*[F.lit(x) for name, words in LEVELS.items() for w in words for x in (w, name)])
    return F.coalesce(F.try_element_at(known, F.lower(word)), F.lit(""))


def _priority(digits: Column) -> Column:
    sev = F.coalesce(digits.try_cast("int"), F.lit(6)) % 8
    return F.when(digits == "", "").when(sev <= 2, "FATAL").when(sev == 3, "ERROR").when(sev == 4, "WARN").when(sev <= 6, "INFO").otherwise("DEBUG")


def _fraction(digits: Column) -> Column:
    return F.substring(F.concat(digits, F.lit("000")), 1, 3)


def _millis(iso: Column) -> Column:
    return F.unix_millis(iso.try_cast("timestamp"))


def _year(ts: Column) -> Column:
    return F.year(F.date_from_unix_date(F.floor(ts / 86400).cast("int"))).cast("string")


def _month(name: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name)
    return F.when(at > 0, F.lpad(at.cast("string"), 2, "0")).otherwise(name)


def cut_up(line: Column, pattern: Column, cutter: Column, named: list[tuple[str, str]]) -> Column:
    """A line by its leaf's pattern: the mark, then its slots in order of ``SLOTS``; the line itself where
    it doesn't fit. Patterns that are ``named`` are compiled once, others whenever they change from
    line to line."""
    out = F.lit(None).cast("string") if named else F.regexp_replace(line, pattern, cutter)
    for p, c in named:
        out = F.when(pattern == p, F.regexp_replace(line, F.lit(p), F.lit(c))).otherwise(out)
    return out


def fields(got: Column, ts: Column) -> Column:
    """struct(entry_ms, level, component, message) of a line's slots."""
    of = {s: got[i] for i, s in enumerate(SLOTS)}
    year = F.when(of["year"] == "", _year(ts)).otherwise(of["year"])
    zone = F.when(of["zone"] == "", "Z").otherwise(F.regexp_replace(of["zone"], r"^([+-]\d\d):?(\d\d)$", "$1:$2"))
    day = F.concat_ws("-", year, _month(of["month"]), F.lpad(of["day"], 2, "0"))
    frac = _fraction(of["fraction"])
    iso = _millis(F.concat(day, F.lit("T"), of["time"], F.lit("."), frac, zone))
    millis = F.when(of["seconds"] == "", iso).otherwise(of["seconds"].try_cast("bigint") * 1000 + frac.try_cast("bigint"))
    level = F.when(of["priority"] == "", _level(of["level"])).otherwise(_priority(of["priority"]))
    return F.when(got.isNotNull(), F.struct(millis.alias("entry_ms"), level.alias("level"), of["component"].alias("component"), of["message"].alias("message")))


def json_fields(text: Column) -> Column:
    """The same struct for a line of JSON with its own time, level and logger."""
    get = lambda k: F.get_json_object(text, f"$['{k}']")
    stamp = F.coalesce(get("@timestamp"), get("time"), get("timestamp"))
    number = F.coalesce(get("ts"), get("at")).try_cast("decimal(24,6)")
    millis = F.when(number.isNotNull(), F.floor(F.when(number >= 10**11, number).otherwise(number * 1000)).cast("bigint"))
    level = _level(F.coalesce(get("level"), get("severity"), get("lvl")))
    name = F.coalesce(get("logger"), get("component"), get("from"), get("module"), F.lit(""))
    message = F.coalesce(get("message"), get("msg"), get("log"), F.lit(""))
    return F.struct(F.coalesce(_millis(F.when(stamp.rlike(r"(?i)(z|[+-]\d\d:?\d\d)$"), stamp).otherwise(F.concat(stamp, F.lit("Z")))), millis).alias("entry_ms"), level.alias("level"), name.alias("component"), message.alias("message"))


def heads(rows: DataFrame) -> DataFrame:
    """``rows`` (a column ``line``, a column ``ts``) that begin an entry, with their ``f`` (fields).

    Rows without two numbers joined as in a time of day, or nine digits as in epoch seconds, carry
    no time and are left out before the exchange.
    """
    some = rows.where(F.col("line").rlike(r"\d:\d|\d{9}")).withColumn("sig", signature(F.col("line")))
    sigs, cutters = leaves(some.select("line"))
    cutters = cutters.where("pattern IS NOT NULL").select("part", "pattern", "cutter")
    named = [(r.pattern, r.cutter) for r in cutters.select("pattern", "cutter").distinct().limit(NAMED + 1).collect()]
    laid = sigs.join(cutters, "part")
    laid = laid.select(F.xxhash64("sig").alias("_a"), F.xxhash64(F.lit(1), "sig").alias("_b"), "pattern", "cutter")
    keyed = some.withColumns({"_a": F.xxhash64("sig"), "_b": F.xxhash64(F.lit(1), "sig")}).drop("sig")
    out = keyed.join(laid, ["_a", "_b"])
    # the generators keep the optimizer from copying an expression into each of its uses
    once = lambda df, name, c: df.withColumn(name, F.explode(F.array(c)))
    out = once(out, "_cut", cut_up(F.col("line"), F.col("pattern"), F.col("cutter"), named if len(named) <= NAMED else [])).where(F.col("_cut").startswith("\x02"))
    out = once(out, "_got", F.split(F.substring("_cut", 2, 1 << 30), "\x01", len(SLOTS)))
    return once(out, "f", fields(F.col("_got"), F.col("ts"))).where("f.entry_ms IS NOT NULL").drop("_a", "_b", "_cut", "_got", "pattern", "cutter")


def log_rows(lines: DataFrame) -> DataFrame:
    """The text rows of the log table by their first lines."""
    return lines.where("NOT structured AND raw_data IS NOT NULL").select("source", F.col("seq").alias("pos"), "ts", first_line(F.col("raw_data")).alias("line"), F.regexp_extract("raw_data", r"(?s)^[^\r\n]*(.*)$", 1).alias("rest"))


def tail_rows(tail: DataFrame) -> DataFrame:
    """The text lines of a tail that have a place."""
    return tail.where("NOT coalesce(structured, false) AND line_no IS NOT NULL").select(F.col("app").alias("source"), F.col("line_no").alias("pos"), "ts", first_line(F.col("inner")).alias("line"))


def log_entries(lines: DataFrame) -> DataFrame:
    """(source, seq, entry_ms, level, component, message): every text row of the log table
    whose first line carries its own time; the message keeps the further lines.

    Null text, headless text and structured rows give none; a head with an impossible date is no
    head. Rows equal in all columns each give a row.
    """
    return heads(log_rows(lines)).select("source", F.col("pos").alias("seq"), "f.entry_ms", "f.level", "f.component", F.concat("f.message", "rest").alias("message"))


def tail_heads(tail: DataFrame, found: DataFrame) -> DataFrame:
    """(app, line_no, entry_ms, level, component, message): the lines of a tail that begin an entry,
    from those that ``heads`` found and the structured ones; rows stored twice count once."""
    kinds = found.schema["f"].dataType.fieldNames()
    json = tail.where("structured").select("app", "line_no", json_fields(F.col("inner")).alias("f"))
    json = json.select("app", "line_no", F.struct(*[F.col(f"f.{k}").alias(k) for k in kinds]).alias("f"))
    both = found.select(F.col("source").alias("app"), F.col("pos").alias("line_no"), "f").unionByName(json)
    return both.groupBy("app", "line_no").agg(F.min("f").alias("f")).select("app", "line_no", "f.*")


def all_entries(lines: DataFrame, tail: DataFrame) -> DataFrame:
    """(tab, source, first_pos, last_pos, entry_ms, level, component): the entries of the log table
    and of a tail, their templates found over both at once."""
    rows = log_rows(lines).drop("rest").withColumn("tab", F.lit("loglines")).unionByName(tail_rows(tail).withColumn("tab", F.lit("taillines")))
    found = cut(heads(rows).select("tab", "source", "pos", F.col("f").dropFields("message").alias("f")))
    own = found.where("tab = 'loglines'").select("tab", "source", F.col("pos").alias("first_pos"), F.col("pos").alias("last_pos"), "f.entry_ms", "f.level", "f.component")
    more = tail_entries(tail, found=found.where("tab = 'taillines'"))
    return own.unionByName(more.select(F.lit("taillines").alias("tab"), F.col("app").alias("source"), "first_pos", "last_pos", "entry_ms", "level", "component"))


def tail_entries(tail: DataFrame, with_message: bool = False, found: DataFrame | None = None) -> DataFrame:
    """(app, first_pos, last_pos, entry_ms, level, component[, message]): the entries of a tail.

    An entry runs from its head to the line before the app's next head; lines before the first
    head belong to none. Rows without line_no have no place and are left out. With
    ``with_message``, the message holds the lines that follow the head too.
    """
    rows = tail.where("line_no IS NOT NULL")
    start = cut(tail_heads(rows, heads(tail_rows(rows)) if found is None else found))
    marks = start.select("app", "line_no", F.col("line_no").alias("_start"), F.lit(True).alias("_json"))
    plain = rows.select("app", "line_no", F.lit(None).cast("bigint").alias("_start"), F.lit(False).alias("_json"))
    line = cut(marks.unionByName(plain).groupBy("app", "line_no").agg(F.max("_start").alias("_start")))
    own = running_max(line, ["app"], ["line_no"], "_start", "first_pos").where("first_pos IS NOT NULL")
    spans = own.groupBy("app", "first_pos").agg(F.max("line_no").alias("last_pos"))
    head = start.withColumnRenamed("line_no", "first_pos").withColumnRenamed("app", "_app")
    same = [spans["app"].eqNullSafe(head["_app"]), spans["first_pos"] == head["first_pos"]]
    out = spans.join(head, same).select("app", spans["first_pos"], "last_pos", "entry_ms", "level", "component", *(["message"] if with_message else []))
    if not with_message:
        return out
    text = rows.select(F.col("app").alias("_app"), F.col("line_no").alias("_no"), "inner").distinct()
    more = own.where("line_no > first_pos").join(text, own["app"].eqNullSafe(text["_app"]) & (own["line_no"] == text["_no"]))
    more = more.groupBy(F.col("app").alias("_app"), F.col("first_pos").alias("_first")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "inner"))), lambda s: s.inner), "\n").alias("_more"))
    return out.join(more, out["app"].eqNullSafe(more["_app"]) & (out["first_pos"] == more["_first"]), "left").withColumn("message", F.concat_ws("\n", "message", "_more")).drop("_app", "_first", "_more")
