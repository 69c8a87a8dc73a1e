"""Mixing sources to target weights by Poisson replication.

Each source s has n_s rows and a target weight w_s; a row of s is wanted on average rate_s = total * w_s / n_s times. Its
number of copies is drawn by inverting the Poisson distribution with that mean at a uniform number hashed from the seed
and the row's id, so that any executor draws the same number again. The copies are exploded and shuffled globally by a
hash of (seed, id, copy number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_rank, private_names

SEED = 20
#: Without given weights the target weight of a source is its row count to this power, divided by the sum.
TEMPERATURE = 0.5
#: The sources' tables of steps are broadcast up to so many bytes; beyond that Spark joins by the source, splitting hot ones.
MOST_BROADCAST = 32 << 20
#: The largest rate whose distribution is tabulated in full; exp(-rate) and all partial sums are exact enough below it.
MOST_RATE = 500.0

OUTPUT = ("repeats", "copy_no", "position")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 random bits, from the MD5 digest of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_steps(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1) ... of the Poisson distribution, until the tail is below the 52 bits of uniform()."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    grown = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("steps")),
        lambda acc, k: F.struct(
            (acc["p"] * rate / k).alias("p"),
            (acc["sum"] + acc["p"] * rate / k).alias("sum"),
            F.concat(acc["steps"], F.array(acc["sum"] + acc["p"] * rate / k)).alias("steps"),
        ),
        lambda acc: acc["steps"],
    )
    return grown


def source_rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, total: int | None = None) -> DataFrame:
    """One row per source: n_rows, weight and rate. Null is a source of its own.

    weights: target shares by source name; a source that isn't named gets none of the mixture, and shares are divided by
    the sum over the sources that have rows. total: the wanted number of rows, without it as many as there are.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        wanted = F.pow(F.col("n_rows").cast("double"), F.lit(TEMPERATURE))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        wanted = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)
    counts = counts.withColumn("wanted", wanted)
    # one row comes to the driver; micro-units make the sum independent of the order of addition
    micro = F.round(F.col("wanted") * 1e6).cast("decimal(38,0)")
    all_wanted, all_rows = counts.agg(F.sum(micro), F.sum("n_rows")).first()
    weight = micro.cast("double") / F.lit(float(all_wanted or 1))
    goal = float(all_rows or 0) if total is None else float(total)
    return counts.withColumn("weight", weight).select("source", "n_rows", "weight", (F.col("weight") * F.lit(goal) / F.col("n_rows")).alias("rate"))


def poisson_mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    total: int | None = None,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """One row per copy: docs' columns with repeats, copy_no (from 1) and position (gapless, the global random order).

    Rates above MOST_RATE are a sum of equal parts, each drawn by its own hash. Nulls: null source is a source; a null id
    is hashed as an empty one. Repeated rows draw the same number. Empty table: empty result. Extra columns stay; one that
    has the name of an output column is replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in OUTPUT])
    steps, parts, name, key = private_names(docs, "steps", "parts", "name", "key")
    rates = source_rates(docs, source_col, weights, total)
    part_rate = F.col("rate") / F.col(parts)
    tables = (
        rates.withColumn(parts, F.greatest(F.ceil(F.col("rate") / MOST_RATE), F.lit(1)).cast("int"))
        .select(F.col("source").alias(name), parts, poisson_steps(part_rate).alias(steps))
    )
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    n_sources, highest = rates.agg(F.count(F.lit(1)), F.max("rate")).first()
    highest = min(highest or 0.0, MOST_RATE)
    if n_sources * 8 * (highest + 12 * highest**0.5 + 64) <= MOST_BROADCAST:
        tables = F.broadcast(tables)
    drawn = docs.join(tables, docs[source_col].eqNullSafe(tables[name]), "left").drop(name)

    def copies(part: Column) -> Column:
        u = uniform(F.lit(str(seed)), ident, part.cast("string"))
        return F.aggregate(F.col(steps), F.lit(0), lambda n, p: n + F.when(p <= u, 1).otherwise(0))

    draws = F.aggregate(F.transform(F.sequence(F.lit(1), F.col(parts)), copies), F.lit(0), lambda a, b: a + b)
    out = drawn.withColumn("repeats", draws).drop(steps, parts).where(F.col("repeats") > 0)
    out = out.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    out = out.withColumn(key, F.md5(F.concat_ws(":", F.lit(str(seed)), ident, F.col("copy_no").cast("string"))))
    keys = [F.col(key), F.col(id_col), F.col("copy_no"), F.xxhash64(*docs.columns)]
    share = F.conv(F.substring(F.col(key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return hashed_rank(out, share, keys, "position", "mix").drop(key)
