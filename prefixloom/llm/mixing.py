"""Temperature mixing: source weights from exponentiated token shares, realised as block permutations.

The weight of a source with token share p is p**a / sum(p**a). The exponent a is bisected (five
halvings per pass over the table of sources, 30 in all) to the largest value that reaches an entropy,
a share of the largest possible one, or to the smallest that keeps the number of times a source is
repeated within a limit. 1 keeps the shares, 0 makes all sources equal.

A token is a run of characters other than blank and \\x09-\\x0D. The budget is given in tokens, or
left out: then it is the least for which every source is used in full once, so no document is lost.
A source's part of the budget is spent in epochs. Each epoch deals the source's blocks in an order of
its own; the last, partial epoch takes whole blocks while they fit, then documents of the next block
while they fit. ``pace`` (0 to 1) orders the whole mix: sources advance evenly, blocks stay together.

Scale: a document's block and places follow from a hash of its id, so the only things ever shuffled
are token sums by source and by block (at most MAX_BLOCKS for a source), and the cut block's ids. A
source's cuts are three numbers, so each document is decided in its own row, wherever it is. Sources
are joined by broadcast up to FEW_SOURCES of them, else by a plain join that AQE can split.

Null sources are a source of their own; null and empty texts have no tokens and are kept with their
blocks; a source without tokens is taken once. Repeated rows share a place. Old columns with the names
of new ones are replaced. An empty table gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, table, written

WORD = r"[^\x20\x09-\x0D]+"
MAX_BLOCKS = 1_024
BLOCK_ROWS = 64
FEW_SOURCES = 10_000
STEPS, ROUNDS = 32, 6
ADDED = ("epoch", "block", "pace")


def draw(*parts: Column | str) -> Column:
    """60 bits from an MD5 of the parts."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exponent(sources: DataFrame, entropy: float | None, repeats: float | None, budget: float | None) -> float:
    """The exponent from 0 to 1, a multiple of 2**-30, for a table (name, n_tokens).

    ``entropy``: the largest exponent whose weights have at least that share of the largest entropy.
    ``repeats``: the smallest exponent for which no source is dealt out more often (1 if none is).
    """
    known = sources.filter("n_tokens > 0")
    sums = known.agg(F.sum("n_tokens").cast("double").alias("all"), F.count("*").alias("n"),
                     F.min("n_tokens").alias("least"), F.max("n_tokens").alias("most")).first()
    if not sums["n"] or (entropy is None and repeats is None):
        return 1.0
    if (entropy is None) == (repeats is None):
        raise ValueError("give an entropy or a limit of repeats")
    share = F.col("n_tokens") / F.lit(sums["all"])
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        tried = [low + (high - low) * i / STEPS for i in range(1, STEPS)]
        powers = [F.pow(share, F.lit(a)) for a in tried]
        got = known.agg(*[F.sum(p).alias(f"z{i}") for i, p in enumerate(powers)],
                        *[F.sum(p * F.log(share)).alias(f"l{i}") for i, p in enumerate(powers)]).first()

        def meets(i: int) -> bool:
            a, z = tried[i], got[f"z{i}"]
            if entropy is not None:  # entropy falls as the exponent rises
                return math.log(z) - a * got[f"l{i}"] / z >= entropy * math.log(sums["n"]) - 1e-12
            p_least, p_most = sums["least"] / sums["all"], sums["most"] / sums["all"]
            spent = budget if budget is not None else sums["all"] * z * p_most ** (1 - a)
            return spent / sums["all"] * p_least ** (a - 1) / z <= repeats + 1e-12

        good = [i for i in range(len(tried)) if meets(i)]
        if entropy is not None:  # good ones come first; keep the last of them as low
            cut = len(good)
        else:  # good ones come last; keep the first of them as high
            cut = len(tried) - len(good)
        low, high = low + (high - low) * cut / STEPS, low + (high - low) * (cut + 1) / STEPS
    return low if entropy is not None else high


def plan(rows: DataFrame, entropy: float | None, repeats: float | None, budget: float | None, seed: str) -> DataFrame:
    """One row per source from rows (name, place, n_tokens): weight, epochs and the cuts of the last one."""
    sources = written(rows.groupBy("name").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"), F.first("shown").alias("shown")))
    a = exponent(sources, entropy, repeats, budget)
    power = F.when(F.col("n_tokens") > 0, F.pow(F.col("n_tokens").cast("double"), F.lit(a))).otherwise(0.0)
    raw = sources.withColumn("raw", power)
    # tokens that a unit of raw weight stands for: the whole budget, or enough for one use of every source
    unit = raw.agg(F.sum("raw").alias("z"), F.max(F.when(F.col("n_tokens") > 0, F.col("n_tokens") / F.col("raw"))).alias("u")).first()
    z = unit["z"] or 1.0
    each = budget / z if budget is not None else unit["u"] or 0.0
    # a part that is whole up to rounding counts as whole
    part = F.floor(F.col("raw") * F.lit(each) * F.lit(1 + 1e-12) + F.lit(1e-6)).cast("long")
    out = raw.select(
        "name", "shown", "n_tokens", "n_rows", (F.col("raw") / F.lit(z)).alias("weight"), part.alias("part"),
        F.when(F.col("n_tokens") > 0, F.floor(part / F.col("n_tokens")).cast("long")).otherwise(1).cast("long").alias("full"),
        F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("n_rows") / BLOCK_ROWS)).cast("long").alias("n_blocks"),
    )
    out = written(out.withColumn("rest", F.when(F.col("n_tokens") > 0, F.col("part") - F.col("full") * F.col("n_tokens")).otherwise(0)))

    # the partial epoch: which blocks fit, and how much of the budget is left for the first that doesn't
    partial = beside(rows, out.filter("rest > 0").select("name", "full", "rest", "n_blocks"))
    block = F.col("place") % F.col("n_blocks")
    blocks = partial.groupBy("name", block.alias("block"), "full", "rest").agg(F.sum("n_tokens").alias("n_tokens"))
    blocks = blocks.withColumn("turn", draw(seed, F.col("name"), F.col("full"), F.col("block")))
    order = Window.partitionBy("name").orderBy("turn", "block")  # at most MAX_BLOCKS rows
    summed = blocks.withColumn("until", F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    over = F.min(F.when(F.col("until") > F.col("rest"), F.struct("turn", "block", (F.col("rest") - F.col("until") + F.col("n_tokens")).alias("left"))))
    cut = written(summed.groupBy("name").agg(over.alias("cut")).filter("cut is not null").select("name", "cut.*"))
    inside = beside(partial, cut.select("name", F.col("block").alias("cut_block"), "left")).filter(block == F.col("cut_block"))
    within = Window.partitionBy("name").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)  # one block per source
    last = (inside.withColumn("until", F.sum("n_tokens").over(within)).filter("until > left")
            .groupBy("name").agg(F.min("place").alias("last_place")))
    return written(out.join(cut.select("name", F.col("turn").alias("cut_turn"), F.col("block").alias("cut_block")), "name", "left")
                   .join(last, "name", "left"))


def beside(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows joined with a table of one row per source."""
    few = sources.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    return rows.join(F.broadcast(sources) if few else sources, "name")


def mix(
    docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None,
    seed: str = "mix", key: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """docs as often as their source is dealt out, with epoch, block and pace."""
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("null"))
    place = draw(seed, F.col(f"`{key}`"))
    narrow = written(docs.select(name.alias("name"), F.col(f"`{source}`").alias("shown"), place.alias("place"),
                                 tokens(F.col(f"`{text}`")).alias("n_tokens")))
    fields = ("name", "full", "rest", "n_blocks", "cut_turn", "cut_block", "last_place", "n_tokens", "part")
    of = dict(zip((*fields, "place", "block", "turn", "number"), fresh(*fields, "place", "block", "turn", "number")))  # beside columns of any name
    col = {c: F.col(n) for c, n in of.items()}
    asked = plan(narrow, entropy, repeats, budget, seed).select(*[F.col(c).alias(of[c]) for c in fields])
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ADDED]
    few = asked.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    rows = docs.select(*own, name.alias(of["name"]), place.alias(of["place"])).join(F.broadcast(asked) if few else asked, of["name"])
    rows = rows.withColumn(of["block"], col["place"] % col["n_blocks"])
    rows = rows.withColumn(of["turn"], draw(seed, col["name"], col["full"], col["block"]))
    before = F.struct(col["turn"].alias("t"), col["block"].alias("b")) < F.struct(col["cut_turn"].alias("t"), col["cut_block"].alias("b"))
    in_cut = (col["block"] == col["cut_block"]) & (col["last_place"].isNull() | (col["place"] < col["last_place"]))
    taken = (col["rest"] > 0) & (col["cut_turn"].isNull() | before | in_cut)
    copies = col["full"] + F.when(taken, 1).otherwise(0)
    dealt = rows.filter(copies > 0).withColumn(of["number"], F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))))
    turn = draw(seed, col["name"], col["number"], col["block"])
    times = F.when(col["n_tokens"] > 0, col["part"] / col["n_tokens"]).otherwise(1.0)
    pace = F.least(F.lit(1.0), (col["number"] + turn / F.lit(2.0**60)) / times)
    return dealt.select(*own, col["number"].alias("epoch"), col["block"].cast("int").alias("block"), pace.alias("pace"))


def op7_mixing(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    dealt = mix(docs, repeats=2.0)
    return dealt.select("doc_id", "source", "epoch", "block", "pace")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS name,
         ('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS place,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM documents),
s AS (SELECT name, sum(n)::BIGINT AS n, count(*) AS n_rows FROM d GROUP BY 1),
t AS (SELECT sum(n)::DOUBLE AS total, min(n) AS least, max(n) AS most FROM s WHERE n > 0),
bisect AS (
  SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN low ELSE (low + high) / 2 END, CASE WHEN ok THEN (low + high) / 2 ELSE high END
  FROM (SELECT b.*, pow(most / total, 1 - (low + high) / 2) * pow(least / total, (low + high) / 2 - 1) <= 2.0 + 1e-12 AS ok
        FROM bisect b, t WHERE i < 30)),
a AS (SELECT high AS a FROM bisect WHERE i = 30),
raw AS (SELECT s.*, CASE WHEN n > 0 THEN pow(n::DOUBLE, a) ELSE 0 END AS raw FROM s, a),
unit AS (SELECT max(n / raw) AS u FROM raw WHERE n > 0),
p AS (SELECT name, n, least(1024, (n_rows + 63) // 64)::BIGINT AS n_blocks,
             floor(raw * coalesce(u, 0) * (1 + 1e-12) + 1e-6)::BIGINT AS part FROM raw, unit),
q AS (SELECT *, CASE WHEN n > 0 THEN part // n ELSE 1 END AS fulls, CASE WHEN n > 0 THEN part % n ELSE 0 END AS rest FROM p),
w AS (SELECT d.*, q.n AS n_source, part, fulls, rest, n_blocks, place % n_blocks AS block,
             ('0x' || substr(md5(concat_ws('|', 'mix', name, fulls, place % n_blocks)), 1, 15))::BIGINT AS turn
      FROM d JOIN q USING (name)),
b AS (SELECT name, block, turn, rest, sum(n) AS n FROM w WHERE rest > 0 GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY name ORDER BY turn, block ROWS UNBOUNDED PRECEDING) AS until FROM b),
fits AS (SELECT name, block FROM c WHERE until <= rest),
firsts AS (SELECT name, block, rest - until + n AS room, row_number() OVER (PARTITION BY name ORDER BY turn, block) AS rn
           FROM c WHERE until > rest),
f AS (SELECT w.name, doc_id, place, room, sum(n) OVER (PARTITION BY w.name ORDER BY place RANGE UNBOUNDED PRECEDING) AS until
      FROM w JOIN firsts ON w.name = firsts.name AND w.block = firsts.block AND rn = 1),
e AS (SELECT doc_id, source, name, block, part, n_source, fulls,
             fulls + CASE WHEN rest > 0 AND ((name, block) IN (SELECT (name, block) FROM fits)
                               OR (name, place) IN (SELECT (name, place) FROM f WHERE until <= room)) THEN 1 ELSE 0 END AS copies
      FROM w),
x AS (SELECT *, unnest(range(copies)) AS epoch FROM e WHERE copies > 0)
SELECT doc_id, source, epoch::INT AS epoch, block::INT AS block,
       least(1.0, (epoch + ('0x' || substr(md5(concat_ws('|', 'mix', name, epoch, block)), 1, 15))::BIGINT / pow(2.0, 60))
             / CASE WHEN n_source > 0 THEN part / n_source ELSE 1.0 END) AS pace
FROM x
"""
