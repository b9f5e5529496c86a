"""Mixing sources to target weights by Poisson replication.

A document of a source that should be seen ``rate`` times is repeated as often
as a Poisson variable of that mean says. The variable is the inverse of the
distribution function at a uniform number made from the document's hash, so
the copies of a document never depend on where or when it is processed. All
copies are then put into one global random order.

Everything is built-in functions; there is one shuffle by source of the sizes
(combined before it) and one of the copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import keep

#: A uniform number has 52 bits, the hexadecimal digits 1 to 13 of a SHA-256.
DIGITS = 13
#: Ranks are counted in this many parts of the hash range and added up.
ORDER_BITS = 12


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone (null counts as empty)."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """Mean repetitions per source: columns _source and rate.

    ``weights`` has columns source and weight; without it a source's weight is
    its size (bytes of text, 1 a document at least) to the power ``alpha``. A rate is
    epochs x total size x the source's share of the weights / its size. A null
    source is a source; with ``weights``, sources it leaves out get rate 0.
    """
    size = F.sum(F.greatest(F.octet_length(F.coalesce("text", F.lit(""))), F.lit(1)))
    # "" and null sources are told apart by the prefix
    sizes = docs.groupBy(source_key(F.col("source")).alias("_source")).agg(size.alias("size"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow("size", F.lit(alpha)))
    else:
        given = weights.groupBy(source_key(F.col("source")).alias("_source")).agg(F.sum("weight").alias("weight"))
        weighted = sizes.join(given, "_source", "left").fillna(0.0, ["weight"])
    all_size, all_weight = weighted.agg(F.sum("size")).scalar(), weighted.agg(F.sum("weight")).scalar()
    rate = F.lit(epochs) * all_size * F.try_divide(F.col("weight"), all_weight) / F.col("size")
    return weighted.select("_source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


#: exp(-rate) is far from underflow below this; larger rates are drawn in parts.
LARGEST_PART = 500.0
#: Rates of up to this many sources are broadcast (a few MB); more are joined by shuffle.
MOST_BROADCAST = 10_000


def parts_of(rate: Column) -> Column:
    return F.greatest(F.ceil(rate / LARGEST_PART), F.lit(1)).cast("int")


def poisson_table(rate: Column) -> Column:
    """The Poisson distribution function at 0, 1, ... as an array, empty for rate 0.

    It ends before ``rate + 12 sqrt(rate) + 30``, beyond which less than 2**-53 is left.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    first = F.exp(-rate)
    walk = F.aggregate(
        F.sequence(F.lit(1), last - 1),
        F.struct(first.alias("p"), first.alias("f"), F.array(first).alias("table")),
        lambda s, i: F.struct(
            (s["p"] * rate / i).alias("p"),
            (s["f"] + s["p"] * rate / i).alias("f"),
            F.concat(s["table"], F.array(s["f"] + s["p"] * rate / i)).alias("table"),
        ),
    )
    return F.when(rate <= 0, F.array().cast("array<double>")).otherwise(walk["table"])


def poisson_inverse(u: Column, table: Column) -> Column:
    """The least k whose distribution function exceeds ``u``: how many entries of the table don't."""
    return F.size(F.filter(table, lambda f: f <= u))


def copies(key: list[Column], rate: Column, table: Column, seed: int) -> Column:
    """Number of copies of a document from its key; ``table`` is for the rate divided by its parts."""
    draw = lambda i: poisson_inverse(uniform(*key, F.lit(f"copies{seed}"), i), table)
    return F.aggregate(F.sequence(F.lit(1), parts_of(rate)), F.lit(0), lambda n, i: n + draw(i))


def replicate(docs: DataFrame, rates: DataFrame, seed: int = 0) -> DataFrame:
    """Every column of ``docs`` with _copy (from 0) and _order, a uniform number for the global order.

    Documents whose count is 0 go. The key of a document is its doc_id, or its
    text where that is null; repeated rows have the same count and order.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_row"), source_key(F.col("source")).alias("_source"), F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("_key"))
    # the distribution is tabulated once per source; a hot source isn't shuffled by its name
    tables, _ = keep(rates.withColumn("table", poisson_table(F.col("rate") / parts_of(F.col("rate")))), "rates")
    joined = packed.join(F.broadcast(tables) if tables.count() <= MOST_BROADCAST else tables, "_source")
    counted = joined.withColumn("_n", copies([F.col("_key")], F.col("rate"), F.col("table"), seed)).where("_n > 0")
    out = counted.select("_row", "_key", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_copy"))
    return out.select("_row", "_copy", uniform(F.col("_key"), F.lit(f"order{seed}"), F.col("_copy")).alias("_order"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 0) -> DataFrame:
    """The replicated rows of ``docs`` in global random order, with the columns of ``docs`` alone."""
    rates = source_rates(docs, weights, alpha, epochs)
    return replicate(docs, rates, seed).orderBy("_order").select("_row.*")


def global_positions(rows: DataFrame, ties: list[str]) -> DataFrame:
    """Adds position, the rank of _order from 0, without a window over all rows.

    Ranks are counted within equal parts of [0, 1), which hash-made numbers
    fill evenly, and the sizes of the earlier parts are added (2**ORDER_BITS rows).
    """
    from pyspark.sql import Window

    parts = rows.withColumn("_part", F.floor(F.col("_order") * (1 << ORDER_BITS)).cast("int"))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_order", *ties))
    ranked = parts.withColumn("_rank", within).join(F.broadcast(offsets), "_part")
    return ranked.withColumn("position", F.col("_before") + F.col("_rank") - 1).drop("_part", "_rank", "_before")
