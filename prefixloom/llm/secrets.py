"""Secret scans: fixed patterns, and Shannon entropy of sliding windows over candidate strings.

Everything is built-in column expressions on one row: no shuffle, no Python on the executors.

Base kinds: ``assign`` (a name such as password, a sign, a value of 6 or more characters), ``access``
(AKIA and capitals or digits, 20 or more characters), ``hex`` (24 or more lower-case hex digits).
Matches are leftmost and do not overlap within a kind; positions are code points, ends exclusive.
They follow from the lengths of the matches and of what lies between them, in one pass.

Entropy kinds: a candidate is a maximal run of a class's characters of at least the window's length.
A window of fixed length slides over it; the counts of its characters are held in an array, of which
one step changes two, and the sum of c log2 c follows from the counts before and after. Windows over
the class's threshold are hot; hot windows that touch or overlap make one span. A candidate that an
allow-list pattern matches gives none: words, numbers, paths. A placeholder word (example, your_) suppresses only the
part between joiners that holds it, so a key after /examples/ is found. Base spans always stay.

Null texts count as empty and have no span. Other columns stay; old columns with the names of new ones
are replaced. Repeated rows give equal results; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

VALUE = 6
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# greedy runs end where the unbounded ones do, so a shorter run holds no match that is long enough
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")
MASK = "[SECRET]"


@dataclass(frozen=True)
class EntropyClass:
    """Candidates of one class: their pattern, its characters, the window and its least entropy in bits."""

    name: str
    pattern: str
    characters: str
    window: int
    bits: float


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CLASSES = (
    EntropyClass("hexwindow", "[0-9A-Fa-f]{18,}", DIGITS + "ABCDEFabcdef", 18, 2.95),
    EntropyClass("capitals", "[A-Z0-9]{20,}", UPPER + DIGITS, 20, 3.45),
    EntropyClass("base64", "[A-Za-z0-9+/=_-]{24,}", UPPER + LOWER + DIGITS + "+/=_-", 24, 3.95),
)
ALLOW = (
    r"^[A-Za-z][a-z]*$", r"^[A-Z]+$", r"^[0-9]+$",  # words and numbers
    r"(?i)example|placeholder|changeme|dummy|sample|xxxx|your[_-]",
    r"^[A-Za-z]+([/_=-]+[A-Za-z]+)*[/_=-]*$",  # paths and joined words
    r"^[-_=+/]+$",  # rules
)
SPAN = "array<struct<start:int,rank:int,stop:int>>"
# the same rules without a repeated group, which Java matches by recursion: a run of thousands of words overflows its stack
RULES = tuple(r"^[A-Za-z][A-Za-z/_=-]*$" if p.startswith("^[A-Za-z]+(") else p for p in ALLOW)
PLACEHOLDERS = ALLOW[3]
PART = r"[A-Za-z0-9+]+[_-]?|[^A-Za-z0-9+]+"


def spans(text: Column, pattern: str, rank: int, keep=None) -> Column:
    """All matches as an array of (start, rank, stop); keep tells from a match whether it stays."""
    parts = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
        lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"),
                                (m.isNotNull() & (keep(m) if keep else F.lit(True))).alias("ok")),
    )

    def step(state, x):
        start = state["at"] + x["gap"]
        stop = start + F.coalesce(x["size"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(x["ok"], F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))
    return F.aggregate(parts, first, step, lambda state: state["out"])


def candidates(text: Column, kind: EntropyClass) -> Column:
    """The class's candidates that no allow-list pattern matches: (start, codes), codes from 1."""
    def wanted(m):
        allowed = F.lit(False)
        for pattern in RULES:
            allowed = allowed | m.rlike(pattern)
        return ~allowed

    def with_codes(s):
        run = F.substring(text, s["start"] + 1, s["stop"] - s["start"])
        codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(kind.characters), c))
        return F.struct(s["start"].alias("start"), F.filter(codes, lambda c: c > 0).alias("codes"))

    return F.transform(spans(text, kind.pattern, 0, wanted), with_codes)


def hot_windows(candidate: Column, kind: EntropyClass, rank: int) -> Column:
    """The spans of one candidate's hot windows."""
    size = kind.window
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(size + 2)])
    codes = candidate["codes"]

    def entered(counts, code, by):
        return F.transform(counts, lambda c, i: F.when(i + 1 == code, c + by).otherwise(c))

    def count(counts, code):
        return F.element_at(counts, code)

    def term(n):
        return F.element_at(terms, n + 1)

    def step(state, i):
        """Character i (from 1) enters; character i - size leaves."""
        new = F.element_at(codes, i)
        old = F.when(i > size, F.element_at(codes, F.greatest(i - size, F.lit(1)))).otherwise(0)
        fewer = F.when(i > size, entered(state["counts"], old, -1)).otherwise(state["counts"])
        less = F.when(i > size, term(count(state["counts"], F.greatest(old, F.lit(1))) - 1)
                      - term(count(state["counts"], F.greatest(old, F.lit(1))))).otherwise(0.0)
        same = F.when(old == new, 1).otherwise(0)  # the one that leaves is the one that enters
        before = count(state["counts"], new) - same
        total = state["total"] + less + term(before + 1) - term(before)
        hot = (i >= size) & (F.lit(math.log2(size)) - total / size >= kind.bits)
        start, stop = candidate["start"] + i - size, candidate["start"] + i
        last = F.try_element_at(state["out"], F.lit(-1))
        joined = F.concat(
            F.slice(state["out"], 1, F.greatest(F.size(state["out"]) - 1, F.lit(0))),
            F.array(F.struct(last["start"].alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"))))
        fresh = F.concat(state["out"], F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"))))
        out = F.when(~hot, state["out"]).when(last["stop"] >= start, joined).otherwise(fresh)
        return F.struct(entered(fewer, new, 1).alias("counts"), total.alias("total"), out.alias("out"))

    first = F.struct(
        F.array_repeat(F.lit(0), len(kind.characters)).alias("counts"), F.lit(0.0).alias("total"),
        F.expr(f"cast(array() as {SPAN})").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.size(codes)), first, step, lambda state: state["out"])


def without_placeholders(text: Column) -> Column:
    """The text with blanks in place of every part between joiners that holds a placeholder word."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(PART), F.lit(0)), lambda p: F.when(p.rlike(PLACEHOLDERS), F.repeat(F.lit(" "), F.length(p))).otherwise(p))
    return F.when(text.rlike(PLACEHOLDERS), F.array_join(parts, "")).otherwise(text)


def windows_of(kind: EntropyClass, rank: int):
    return lambda candidate: hot_windows(candidate, kind, rank)


def listed(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined, by start and then kind."""
    names = F.array(*[F.lit(n) for n in (*BASE, *(k.name for k in CLASSES))])
    return F.array_join(F.transform(
        F.array_sort(found), lambda s: F.concat_ws(":", F.element_at(names, s["rank"]), s["start"], s["stop"])), ",")


def scan(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """docs with a column ``out``: array of (start, rank, stop), by start and rank.

    Ranks 1 to 3 are the base kinds, further ones the entropy classes in their order.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= VALUE
    base = F.concat(spans(body, ASSIGN, 1, long_enough), spans(body, ACCESS, 2), spans(body, HEX, 3))
    [plain] = fresh("plain")
    found = docs.withColumn(plain, without_placeholders(body)).withColumn(out, base)
    for i, kind in enumerate(CLASSES):
        hot = F.transform(candidates(F.col(plain), kind), windows_of(kind, len(BASE) + 1 + i))
        found = found.withColumn(out, F.concat(F.col(f"`{out}`"), F.flatten(hot)))
    return found.withColumn(out, F.array_sort(F.col(f"`{out}`"))).drop(plain)


def redacted(docs: DataFrame, text: str = "text", mask: str = MASK) -> DataFrame:
    """docs with every span of the text replaced by the mask; overlapping spans give one mask."""
    [name] = fresh("spans")
    body = F.col(f"`{text}`")

    def step(state, s):
        apart = s["start"] >= state["at"]
        piece = F.concat(state["out"], F.substring(body, state["at"] + 1, s["start"] - state["at"]), F.lit(mask))
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.when(apart, piece).otherwise(state["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda state: F.concat(state["out"], F.substring(body, state["at"] + 1, F.length(body) - state["at"]))
    found = F.col(name)
    clean = F.when(F.size(found) == 0, body).otherwise(F.aggregate(found, first, step, rest))
    columns = [clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return scan(docs, text, name).select(*columns)


def op4_secrets(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = scan(docs).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["rank"] <= len(BASE))
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", count(1).alias("n_assign"), count(2).alias("n_access"), count(3).alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def oracle() -> str:
    """The query's rows in DuckDB's SQL."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def matches(name: str, rank: int, pattern: str, keep: str, t: str = "t") -> str:
        return f"""
{name} AS (
  SELECT r, {rank} AS rank, until - length(m) AS a, until AS z, m FROM (
    SELECT r, m, sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY r ORDER BY i) AS until FROM (
      SELECT r, unnest(gaps) AS gap, unnest(ms) AS m, generate_subscripts(gaps, 1) AS i FROM (
        SELECT r, string_split_regex({t}, {quoted(pattern)}) AS gaps, regexp_extract_all({t}, {quoted(pattern)}) AS ms FROM d)))
  WHERE m IS NOT NULL AND {keep})"""

    allowed = " OR ".join(f"regexp_matches(m, {quoted(p)})" for p in ALLOW)
    tables = [
        "e AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)",
        f"""
d AS (SELECT r, doc_id, t, CASE WHEN regexp_matches(t, {quoted(PLACEHOLDERS)}) THEN array_to_string(list_transform(regexp_extract_all(t, {quoted(PART)}),
    lambda p: CASE WHEN regexp_matches(p, {quoted(PLACEHOLDERS)}) THEN repeat(' ', length(p)) ELSE p END), '') ELSE t END AS plain FROM e)""",
        matches("assign", 1, ASSIGN, f"length(regexp_extract(m, {quoted(ASSIGN)}, 2)) >= {VALUE}"),
        matches("access", 2, ACCESS, "true"), matches("hexes", 3, HEX, "true"),
    ]
    for i, kind in enumerate(CLASSES):
        rank = len(BASE) + 1 + i
        tables += [
            matches(f"run{rank}", rank, kind.pattern, f"NOT ({allowed})", "plain"),
            f"""
hot{rank} AS (
  SELECT r, a AS run, a + i AS s FROM run{rank}, unnest(range(length(m) - {kind.window} + 1)) AS u(i)
  WHERE list_aggregate(string_split(substr(m, i::INT + 1, {kind.window}), ''), 'entropy') >= {kind.bits})""",
            f"""
span{rank} AS (
  SELECT r, {rank} AS rank, min(s) AS a, max(s) + {kind.window} AS z FROM (
    SELECT r, run, s, sum(fresh::INT) OVER (PARTITION BY r, run ORDER BY s) AS part FROM (
      SELECT r, run, s, s > coalesce(lag(s) OVER (PARTITION BY r, run ORDER BY s), -1000) + {kind.window} AS fresh FROM hot{rank}))
  GROUP BY r, run, part)""",
        ]
    names = "['" + "', '".join([*BASE, *(k.name for k in CLASSES)]) + "']"
    every = " UNION ALL ".join(f"SELECT r, rank, a, z FROM {n}" for n in ["assign", "access", "hexes", *(f"span{len(BASE) + 1 + i}" for i in range(len(CLASSES)))])
    text = f"string_agg(concat({names}[rank], ':', a, ':', z), ',' ORDER BY a, rank)"
    tables.append(f"""
s AS (
  SELECT r, count(*) FILTER (WHERE rank = 1) AS n1, count(*) FILTER (WHERE rank = 2) AS n2, count(*) FILTER (WHERE rank = 3) AS n3,
    {text} FILTER (WHERE rank <= {len(BASE)}) AS base, {text} AS spans
  FROM ({every}) GROUP BY r)""")
    return "WITH " + ",".join(tables) + """
SELECT doc_id, coalesce(n1, 0) AS n_assign, coalesce(n2, 0) AS n_access, coalesce(n3, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (r)"""
