"""Mixing sources to target weights by capped water-filling.

Each source's target is its weight's share of the total, but at most ``max_epochs`` times the source's size;
what a clamped source cannot take is shared again among the others in proportion to their weights, until no
source is above its cap. A target of r times the source's size takes every document floor(r) times and a seeded
fraction of them once more.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relslice.llm.merkle import ranked
from relslice.scratch import materialize

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Sources whose weights may be given as a list, and whose plan is broadcast; rules of weights have no bound.
MAX_SOURCES = 100_000

#: Ranges of the seeded order per source; only documents of the one range that the cut falls into are sorted.
BINS = 4096


def word_count(text: Column) -> Column:
    """Number of words; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, max_epochs: float) -> list[float]:
    """Targets by weight that add up to ``total`` (or to all caps, if those are less), none above its cap.

    In order of the water level at which sources fill up, each is clamped if its share of what is left would be
    above its cap; the others share the rest by weight. Sources of weight 0 or size 0 get 0.
    """
    targets = [0.0] * len(sizes)
    caps = [max_epochs * s for s in sizes]
    order = sorted((i for i in range(len(sizes)) if weights[i] > 0), key=lambda i: (caps[i] / weights[i], i))
    left, weight = total, sum(weights[i] for i in order)
    for k, i in enumerate(order):
        if weights[i] * left / weight <= caps[i]:
            for j in order[k:]:
                targets[j] = weights[j] * left / weight
            break
        targets[i] = caps[i]
        left, weight = left - caps[i], weight - weights[i]
    return targets


def mix(
    docs: DataFrame,
    weight_of: Callable[[list], Sequence[float]] | None,
    share: float,
    max_epochs: float = 2.0,
    seed: int = 0,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    columns: Sequence[str] | None = None,
    by_rank: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``docs`` (of these ``columns``; all by default) with size, source_size, target, repeats and taken of the mix.

    ``weight_of`` gets all source names by code point, null last (a null source is a source of its own), and
    returns their weights; more than MAX_SOURCES sources are an error then. With ``by_rank`` instead, which makes a
    weight of a source's place in that order (from 0), sources are ranked, filled and joined as tables and may be any number. The mix is ``share`` times the words of all documents. ``repeats`` is how often it
    takes the whole document, ``taken`` the words of all its repeats. Of each source, documents are taken once
    more in a seeded order of their keys until the fraction is reached; the document that the cut falls into is
    in if more than half of it is below the cut, so a source is off its target by half a document at most.

    Null and empty texts have size 0 and follow their source's whole repeats. Rows that repeat a key are ordered
    by size and a digest of the text among themselves; fully equal rows are interchangeable. Columns of ``docs`` that clash
    with the new names are replaced. An empty table gives an empty result. No word count depends on partitioning, so reruns agree. Where ``columns`` leaves the text out, words are
    counted once and narrow rows are written; else the rows aren't copied and their words are counted twice.
    """
    made = ["size", "source_size", "target", "repeats", "taken"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    kept = docs.columns if columns is None else [c for c in docs.columns if c in columns]
    docs = docs.withColumn("size", word_count(F.col(text)))
    # An order that any engine with MD5 can repeat: hexadecimal digests of seed and key.
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    docs = docs.withColumn("__order", order).withColumn("__bin", F.conv(F.substring("__order", 1, 3), 16, 10).cast("int"))
    docs = docs.withColumn("__tie", F.xxhash64(text))
    if text not in kept:
        docs = materialize(docs.select(*dict.fromkeys([*kept, source]), "size", "__order", "__bin", "__tie"), "sizes")
    bins = materialize(docs.groupBy(F.col(source).alias("__source"), "__bin").agg(F.sum("size").alias("__size")), "bins")
    targets = _ruled(bins, by_rank, share, max_epochs) if by_rank else _listed(bins, weight_of, share, max_epochs)
    placed = _with_plan(docs, source, materialize(_cuts(bins, targets), "plan"))
    cut_bin = F.col("__bin") == F.col("__cut_bin")
    # Within the one range that holds the cut: running sizes in seeded order. Other rows aren't sorted.
    inside = placed.where(cut_bin)
    by = Window.partitionBy("__source", "__bin").orderBy("__order", "size", "__tie")
    inside = inside.withColumn("__upto", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.withColumn("__more", (F.col("__upto") - F.col("size") / 2 < F.col("__cut_left")).cast("int")).drop("__upto")
    outside = placed.where(~cut_bin).withColumn("__more", (F.col("__bin") < F.col("__cut_bin")).cast("int"))
    done = outside.unionByName(inside)
    done = done.withColumn("repeats", (F.col("__whole") + F.col("__more")).cast("int"))
    done = done.withColumn("taken", F.col("size") * F.col("repeats"))
    return done.select(*kept, *made)


_TARGETS = "source_size long, target double, __whole int, __fraction double"


def _listed(bins: DataFrame, weight_of: Callable[[list], Sequence[float]], share: float, max_epochs: float) -> DataFrame:
    """A row per source: size, target, whole repeats and the words of the fraction. The driver sees one row per source."""
    spark = bins.sparkSession
    totals = bins.groupBy("__source").agg(F.sum("__size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r[0] is None, r[0].encode("utf-8", "surrogatepass") if isinstance(r[0], str) else r[0]))
    sizes = [int(r["size"] or 0) for r in totals]
    weights = list(weight_of([r[0] for r in totals]))
    targets = water_fill(sizes, weights, share * sum(sizes), max_epochs)
    rows = []
    for r, s, t in zip(totals, sizes, targets, strict=True):
        whole = min(int(t // s), int(max_epochs)) if s else 0
        rows.append((r[0], s, float(t), whole, float(t - whole * s)))
    return spark.createDataFrame(rows, f"__source {bins.schema['__source'].dataType.simpleString()}, {_TARGETS}")


def _ruled(bins: DataFrame, by_rank: Callable[[Column], Column], share: float, max_epochs: float) -> DataFrame:
    """The same for weights that follow a rule, by Spark alone; the driver sees the level up to which sources are full.

    In the order in which sources fill up, each one's share of what those before it have left says whether it is
    full; the first that isn't gives the level of all after it.
    """
    sizes = bins.groupBy("__source").agg(F.coalesce(F.sum("__size"), F.lit(0)).alias("size"))
    named = ranked(sizes.select(F.lit(0).alias("__all"), F.col("__source").isNull().alias("__last"), "__source", "size"), "__all", ["__last", "__source"])
    cap = F.col("size") * F.lit(float(max_epochs))
    named = named.select("__source", "size", "at", by_rank(F.col("at")).cast("double").alias("weight"), cap.alias("cap"))
    some = named.where("weight > 0").withColumn("level", F.col("cap") / F.col("weight"))
    filled = running(some, ["level", "at"], ["cap", "weight"])
    total, weights = named.agg(F.coalesce(F.sum("size"), F.lit(0)) * F.lit(float(share)), F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("weight"))), F.lit(0.0))).first()
    rest, rest_weight = F.lit(total) - F.col("cap_before"), F.lit(weights) - F.col("weight_before")
    open_ = filled.where(F.col("weight") * rest / rest_weight <= F.col("cap"))
    first = open_.agg(F.min(F.struct("level", "at", rest.alias("rest"), rest_weight.alias("rest_weight"))).alias("f")).first()["f"]
    target = F.col("cap")
    if first is not None:
        full = (F.col("cap") / F.col("weight") < first["level"]) | ((F.col("cap") / F.col("weight") == first["level"]) & (F.col("at") < first["at"]))
        target = F.when(full, F.col("cap")).otherwise(F.col("weight") * F.lit(first["rest"]) / F.lit(first["rest_weight"]))
    named = named.withColumn("target", F.when(F.col("weight") > 0, target).otherwise(0.0))
    whole = F.when(F.col("size") > 0, F.least(F.floor(F.col("target") / F.col("size")), F.lit(int(max_epochs)))).otherwise(0).cast("int")
    named = named.withColumn("__whole", whole).withColumn("__fraction", F.col("target") - F.col("__whole") * F.col("size"))
    return named.select("__source", F.col("size").cast("long").alias("source_size"), "target", "__whole", "__fraction")


def running(rows: DataFrame, order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """``rows`` with ``<name>_before``, the sum of each of some columns over all rows before in the given order.

    Sums run within the parts of one range partitioning, and on top of the parts' totals; no task sees all rows.
    """
    dealt = materialize(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "dealt")
    parts = dealt.groupBy("__part").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0.0)).alias(f"__{c}_before") for c in sums])  # a row per part
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(parts), "__part")
    return out.select(*rows.columns, *[(F.coalesce(F.sum(c).over(within), F.lit(0.0)) + F.col(f"__{c}_before")).alias(f"{c}_before") for c in sums])


def _cuts(bins: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with where in the seeded order each source's fraction ends, from running sums over its at most BINS sums."""
    plan = materialize(plan, "targets")
    running_ = Window.partitionBy("__source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    upto = bins.withColumn("__upto", F.sum("__size").over(running_))
    within = F.col("__upto") <= F.col("__fraction")
    found = (
        upto.join(plan.select(F.col("__source").alias("__s"), "__fraction"), F.col("__source").eqNullSafe(F.col("__s")))
        .groupBy(F.col("__s").alias("__t"))
        .agg(F.min(F.when(~within, F.col("__bin"))).alias("__cut_bin"), F.max(F.when(within, F.col("__upto"))).alias("__below"))
    )
    return plan.join(found, F.col("__source").eqNullSafe(F.col("__t")), "left").select(
        "__source", "source_size", "target", "__whole",
        F.coalesce("__cut_bin", F.lit(-1)).alias("__cut_bin"),
        (F.col("__fraction") - F.coalesce("__below", F.lit(0))).alias("__cut_left"),
    )


def _with_plan(docs: DataFrame, source: str, plan: DataFrame) -> DataFrame:
    """``docs`` with their source's plan. Up to MAX_SOURCES plans are broadcast; of more, those of sources that hold more
    than a thousandth of all words, which are fewer than 1,000, and the others are joined."""
    same = F.col(source).eqNullSafe(F.col("__source"))
    if plan.count() <= MAX_SOURCES:
        return docs.join(F.broadcast(plan), same, "left")
    hot = F.col("source_size") * 1000 > (plan.agg(F.sum("source_size")).first()[0] or 0)
    marked = docs.join(F.broadcast(plan.where(hot)), same, "left")
    cold = marked.where("target is null").select(*docs.columns).join(plan.where(~hot), same)
    return marked.where("target is not null").unionByName(cold)


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: ``columns`` of each document as many times as it is taken."""
    times = mixed.where(F.col("repeats") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return times.select(*columns)
