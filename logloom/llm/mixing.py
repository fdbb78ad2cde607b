"""Mixing sources to target weights by Poisson replication.

A source with n documents and a target of w documents gets the rate w / n. Each document is repeated as often as
a Poisson variable of that mean says; the variable is the inverse of its distribution at a number that is hashed
from the seed and the document's id. Copies are then shuffled globally by a hash of the id and the copy's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Distribution functions of all sources together are broadcast up to this many steps (eight bytes each); beyond it they
#: are joined by key.
BROADCAST_STEPS = 1 << 20
#: A larger rate is the sum of variables of equal rates up to this one, so that no table of steps is long.
PIECE = 512
#: Rows of a source are dealt over so many keys where tables are joined by key.
SALTS = 64


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of the seed and the parts. Nulls count as empty texts."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rates(df: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: int | None = None) -> DataFrame:
    """A row for each source: m_source, m_n (its count), m_rate, m_pieces and m_steps, the distribution function of
    the rate by pieces.

    ``weights`` name the shares of sources (others get none). Without them a source's share is in proportion to
    its count to the power ``temperature``. ``total`` documents are aimed at, by default as many as there are.
    Counts are added up before the shuffle, so a hot source costs nothing.
    """
    counts = df.groupBy(common.column("source").alias("m_source")).agg(F.count(F.lit(1)).alias("m_n"))
    if weights is None:
        share = F.pow(F.col("m_n").cast("double"), F.lit(temperature))
    else:
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))]), F.col("m_source")), F.lit(0.0)) if weights else F.lit(0.0)
    counts = counts.withColumn("m_share", share)
    sums = counts.agg(F.sum("m_share").alias("s"), F.sum("m_n").alias("n"))  # one row
    rate = F.col("m_share") / F.col("s") * (F.lit(total) if total is not None else F.col("n")) / F.col("m_n")
    out = counts.join(F.broadcast(sums)).select("m_source", "m_n", F.when(F.col("s") > 0, rate).otherwise(0.0).alias("m_rate"))
    out = out.withColumn("m_pieces", F.greatest(F.lit(1), F.ceil(F.col("m_rate") / PIECE)).cast("int"))
    return out.withColumn("m_steps", steps(F.col("m_rate") / F.col("m_pieces")))


def steps(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until what is left lies below the hash's resolution; from logarithms, so no
    rate is too large."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")

    def add(a: Column, k: Column) -> Column:
        log = a["log"] + F.log(rate / k)
        at = a["at"] + F.exp(log)
        return F.struct(log.alias("log"), at.alias("at"), F.concat(a["all"], F.array(at)).alias("all"))

    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("at"), F.array(F.exp(-rate)).alias("all"))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, add, lambda a: a["all"])).otherwise(F.array(F.lit(1.0)))


def mix(df: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: int | None = None, seed: int = 17, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` (which has a column source), each repeated by its count, in an order drawn by hash.

    Adds ``copy`` (1, 2, ...) and ``rate``; columns of ``df`` of these names give way to the new ones, all others pass
    through as they are, null and very long texts too. A null source is a source of its own; a null id is hashed as an
    empty text. Rows of one id have the same count, so repeated rows stay repeated. An empty table gives an empty one.
    Texts are read once and shuffled once.
    """
    spark = df.sparkSession
    table = common.stored(rates(df, weights, temperature, total), common.scratch(spark, "mixing"))
    steps_in_all = table.agg(F.sum(F.size("m_steps") + 8)).first()[0] or 0
    rows, own, back = common.apart(df, "copy", "rate", m_own=common.column("source"), m_id=common.column(id_col))
    same = F.col("m_own").eqNullSafe(F.col("m_source"))
    if steps_in_all <= BROADCAST_STEPS:
        joined = rows.join(F.broadcast(table), same)
    else:
        table = table.withColumn("m_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("m_key", F.pmod(F.xxhash64("m_id"), F.lit(SALTS)).cast("int")).join(table, same & (F.col("m_key") == F.col("m_salt"))).drop("m_key", "m_salt")
    # The optimizer would move the hashed number into the inner function, to be made for each step; an element of an array is made once.
    invert = lambda u: F.transform(F.array(u), lambda x: F.size(F.filter("m_steps", lambda c: c <= x)))[0]
    joined = joined.withColumn("m_first", invert(uniform(seed, F.col("m_id"))))
    further = F.aggregate(F.sequence(F.lit(2), F.col("m_pieces")), F.col("m_first"), lambda n, k: n + invert(uniform(seed, F.col("m_id"), k)))
    joined = joined.withColumn("m_count", F.when(F.col("m_pieces") > 1, further).otherwise(F.col("m_first")))
    numbers = F.when(F.col("m_count") > 0, F.sequence(F.lit(1), F.col("m_count")))  # null gives no row; a filter would count anew
    copies = joined.select(*own, "m_id", "m_rate", F.explode(numbers).alias("m_copy"))
    copies = copies.withColumn("m_key", F.xxhash64(F.lit(seed), F.col("m_id"), F.col("m_copy")))
    mixed = copies.repartition("m_key").sortWithinPartitions("m_key")  # the session's count at most: each file costs processes on a local store
    return mixed.select(*back, F.col("m_copy").cast("int").alias("copy"), F.round("m_rate", 9).alias("rate"))
