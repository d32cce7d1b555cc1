"""Problem 8: mixing sources to target shares of the total size.

Method: Pareto order sampling.  A source's budget is its share of the tokens of
all listed sources, at most ``max_repeats`` times its own; with ``fill`` what
such sources lack is dealt to the others in proportion to their targets, within
their repeats, so that the mix keeps its size.  Whole copies that fit the budget
are certain; for the rest of the budget every document of the source gets an
inclusion probability p that grows with the square root of its size (by size
class), and documents are selected in the order of u / (1 - u) : p / (1 - p),
u being a hash of seed and key.  The sample is fixed in size, counted in
tokens: it ends at the document whose middle lies beyond the rest, so every
source is within half a document of its budget.

Nothing is sorted by source: tokens are counted by bins of the ranking variable,
the bins under the edge are taken whole, the bin that holds the edge is divided
again until few rows are left in it, and only those are ranked.  A source of a
third of all rows is spread over all tasks in every pass.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.lineage import cut

from .arrow import bounded, need_columns
from .tokens import with_counts

CLASSES_PER_OCTAVE = 4
OCTAVES = 60
BINS = 128
EDGE_ROWS = 2_000
MAX_SOURCES = 10_000
TRIM = r"(?U)^\s+|\s+$"


def _name(column: str):
    return F.lower(F.regexp_replace(F.col(column), TRIM, ""))


def sized_rows(df: DataFrame, targets: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, tokens) of the rows that belong to a listed source, as spelled there."""
    need_columns(df, key, text, source)
    need_columns(targets, "source", "target_share", "max_repeats")
    bounded(targets.select("source"), MAX_SOURCES)
    listed = targets.filter("source is not null").select(_name("source").alias("name"), F.col("source").alias("listed"))
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), _name(source).alias("name"))
    kept = rows.join(F.broadcast(listed), "name").select("key", F.col("listed").alias("source"), "text")
    return with_counts(kept, "text", "key", "source")


def allocation(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, target_tokens, reachable, budget).

    Listed sources without documents have 0 tokens; a null share counts as 0 and
    null repeats as 1.
    """
    held = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    total = held.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    rows = targets.filter("source is not null").select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    rows = rows.join(held, "source", "left").join(F.broadcast(total)).fillna(0, ["documents", "tokens"])
    target = F.col("target_share") * F.col("total")
    most = F.col("max_repeats") * F.col("tokens")
    return rows.select("source", "target_share", "max_repeats", "documents", "tokens", target.alias("target_tokens"), (target <= most).alias("reachable"), F.least(target, most.cast("double")).alias("budget"))


def filled(rows: list[dict]) -> list[int]:
    """Budgets in whole tokens that together are the total of all sources, as far as the repeats allow.

    A source that cannot reach its target gives its ``max_repeats`` copies; what
    is left of the total is shared by the others in proportion to their targets.
    """
    left = float(sum(r["tokens"] for r in rows))
    most = [r["max_repeats"] * r["tokens"] for r in rows]
    out = [0] * len(rows)
    wanting = [i for i, r in enumerate(rows) if r["target_share"] > 0]
    shares = sum(rows[i]["target_share"] for i in wanting)
    for i in sorted(wanting, key=lambda i: (most[i] / rows[i]["target_share"], rows[i]["source"])):
        share = rows[i]["target_share"]
        level = left / shares if shares > 1e-12 else 0.0
        if level * share >= most[i]:
            out[i] = most[i]
            left, shares = left - most[i], shares - share
        else:
            out[i] = math.floor(level * share + 1e-6)
    return out


def _scale(classes: list[tuple[int, int]], rest: float) -> float:
    """c with sum of min(1, c sqrt(size)) tokens over the size classes equal to ``rest``.

    The largest classes reach 1 first; what they leave is met by the others.
    """
    if rest <= 0 or not classes:
        return 0.0
    weigh = lambda k: class_size(k) ** 0.5
    own = sorted(classes, reverse=True)
    rate = sum(weigh(k) * t for k, t in own)
    for k, t in own:
        c = rest / rate if rate > 0 else math.inf
        if c * weigh(k) <= 1:
            return c
        rest, rate = rest - t, rate - weigh(k) * t
    return math.inf


def class_size(k: int) -> float:
    return 2.0 ** (k / CLASSES_PER_OCTAVE)


def _edges(drawn: DataFrame, rests: dict[str, int]) -> list[tuple[str, float, float, int]]:
    """(source, low, high, tokens below low): where in the order of ``q`` every source's rest is used up.

    The range that holds the edge is divided again until it holds ``EDGE_ROWS``
    rows or fewer, or cannot be divided; a source that is used up wholly has an
    edge at infinity.
    """
    spark = drawn.sparkSession
    edges = [(name, 0.0, math.inf, 0) for name in rests]
    open_, done = edges, []
    first = True
    while open_:
        table = F.broadcast(spark.createDataFrame([(n, lo, hi) for n, lo, hi, _ in open_], "source string, low double, high double"))
        inside = drawn.join(table, "source").filter("q >= low and q < high")
        octave = F.greatest(F.lit(-OCTAVES), F.least(F.lit(OCTAVES), F.floor(F.log2("q")).cast("int")))
        linear = F.least(F.lit(BINS - 1), F.floor((F.col("q") - F.col("low")) / (F.col("high") - F.col("low")) * BINS).cast("int"))
        counted: dict[str, list] = {}
        for r in inside.groupBy("source", (octave if first else linear).alias("bin")).agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.min("q").alias("lo"), F.max("q").alias("hi")).collect():
            counted.setdefault(r["source"], []).append(r)
        todo = []
        for name, _, _, before in open_:
            for r in sorted(counted.get(name, []), key=lambda r: r["bin"]):
                if before + r["t"] >= rests[name]:
                    edge = (name, r["lo"], math.nextafter(r["hi"], math.inf), before)
                    (todo if r["n"] > EDGE_ROWS and r["hi"] > r["lo"] else done).append(edge)
                    break
                before += r["t"]
            else:
                done.append((name, math.inf, math.inf, before))
        open_, first = todo, False
    return done


def mixed(df: DataFrame, targets: DataFrame, key: str, text: str, source: str, *, seed: int = 42, fill: bool = False) -> tuple[DataFrame, DataFrame]:
    """(mix, shares): ``mix(key, source, tokens, copies)`` and the report per source.

    Documents without tokens are never taken.  Repeated rows are sampled one by
    one.  The report has the columns of ``allocation`` and ``mixed_tokens``,
    ``mixed_share``, ``most_copies``.  Without ``fill`` the mix is smaller by
    what sources lack that cannot reach their targets; with it ``budget`` is
    raised for the others (see ``filled``).
    """
    spark = df.sparkSession
    sized = cut(sized_rows(df, targets, key, text, source))
    plan = cut(allocation(sized, targets))
    rows = [r.asDict() for r in plan.collect()]
    for r, budget in zip(rows, filled(rows) if fill else [math.floor(r["budget"] + 1e-6) for r in rows]):
        r["budget"] = budget
    kept = sized.filter("tokens > 0").withColumn("class", F.floor(F.log2("tokens") * CLASSES_PER_OCTAVE + 1e-9).cast("int"))
    by_class: dict[str, list[tuple[int, int]]] = {}
    for r in kept.groupBy("source", "class").agg(F.sum("tokens").alias("t")).collect():
        by_class.setdefault(r["source"], []).append((r["class"], r["t"]))
    chances, rests = [], {}
    for r in rows:
        if r["tokens"]:
            copies, rest = divmod(r["budget"], r["tokens"])
            own = by_class.get(r["source"], [])
            c = _scale(own, rest)
            chances += [(r["source"], k, min(1.0, c * class_size(k) ** 0.5) if c else 0.0, copies) for k, _ in own]
            if rest:
                rests[r["source"]] = rest
    table = spark.createDataFrame(chances, "source string, class int, p double, whole bigint")
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("key"))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    odds = F.when(F.col("p") >= 1, u * 2.0 ** -(OCTAVES + 1)).when(F.col("p") <= 0, F.lit(None)).otherwise(u / (1 - u) * (1 - F.col("p")) / F.col("p"))
    drawn = cut(kept.join(F.broadcast(table), ["source", "class"]).select("key", "source", "tokens", "whole", odds.alias("q")))
    edges = _edges(drawn.filter("q is not null"), rests)
    border = F.broadcast(spark.createDataFrame([(*e, rests[e[0]]) for e in edges], "source string, low double, high double, before bigint, rest bigint"))
    marked = drawn.join(border, "source", "left")
    at_edge = F.coalesce((F.col("q") >= F.col("low")) & (F.col("q") < F.col("high")), F.lit(False))
    others = marked.filter(~at_edge).withColumn("extra", F.when(F.col("q") < F.col("low"), 1).otherwise(0))
    earlier = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("q", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = marked.filter(at_edge).withColumn("extra", ((F.col("before") + earlier) * 2 + F.col("tokens") <= F.col("rest") * 2).cast("int"))
    copies = (F.col("whole") + F.col("extra")).alias("copies")
    mix = others.unionByName(ranked).select("key", "source", "tokens", copies).filter("copies > 0")
    got = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("mixed_tokens").alias("mixed_total"))
    stated = spark.createDataFrame([(r["source"], r["budget"]) for r in rows], "source string, budget bigint")
    shares = plan.drop("budget").join(F.broadcast(stated), "source").join(got, "source", "left").join(F.broadcast(total)).fillna(0, ["mixed_tokens", "most_copies"])
    shares = shares.withColumn("mixed_share", F.coalesce(F.col("mixed_tokens") / F.col("mixed_total"), F.lit(0.0))).drop("mixed_total")
    return mix.withColumnRenamed("key", key), shares


def used_up(shares: DataFrame) -> DataFrame:
    """(source): sources of which the mix holds every document ``max_repeats`` times and yet less than the target."""
    return shares.filter("mixed_tokens >= max_repeats * tokens and mixed_tokens < target_tokens").select("source")
