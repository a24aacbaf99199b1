"""Mixing sources to target weights by hash thresholds.

Every document has a fixed 60-bit hash. Sizes are summed by source and leading hash bits; the bucket in
which a source's budget runs out is split by the next bits, and so on until it holds one hash. The result
is one row per source: how many whole copies its documents give, and up to which hash one copy more.
Nothing is sorted but the histogram of a source, at most ``1 << BITS`` rows.

Nulls: a null source is a source of its own, after all others; a null text has size 0; a null id hashes as
the empty string. Documents with the same id have the same hash and go together. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gleanery.session import broadcast_if_small, durable

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
#: bits of the hash that one level of the histogram reads
BITS = 10
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3


def word_count(text: str):
    return F.coalesce(F.expr(f"regexp_count(`{text}`, r'{WORD}')"), F.lit(0)).cast("long")


def document_hash(key: str):
    """The first 60 bits of the id's MD5, as SQL engines can repeat it."""
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, hash): all that mixing needs of a document."""
    return docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"), document_hash(key).alias("hash")
    )


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    The sources in order of code points, null last, weigh ``weights`` in turn and share the sum of all sizes;
    a target stops at ``most`` times its source's size and the excess is shared by weight among the others.
    One row per source goes through one task.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = by_source.withColumn("n", F.row_number().over(order)).withColumn(
        "weight", F.element_at(cycle, ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    )
    # those that stop first are the ones with the least room per weight
    fill = Window.orderBy((F.col("room") / F.col("weight")).asc(), F.col("n").asc())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    level = (
        weighed.withColumn("room", F.col("source_size") * most)
        .withColumn("given", F.coalesce(F.sum("room").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(after))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level", (F.col("total") - F.col("given")) / F.col("open"))
        .withColumn("full", F.col("level") * F.col("weight") >= F.col("room"))
    )
    # the first source that is not full has the largest level of those; it holds for all of them
    open_level = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy())
    return level.withColumn("final", open_level).select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("room").cast("double")).otherwise(F.col("final") * F.col("weight")).alias("target"),
    )


def thresholds(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, upto): documents of a source give ``copies`` copies each, those
    with a hash of at most ``upto`` one more. ``upto`` is the hash whose total comes nearest to the target."""
    goal = goal.withColumn(
        "copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    ).withColumn("need", F.col("target") - F.col("copies") * F.col("source_size"))
    edge = durable(goal.select("source", "need", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")))
    inside = rows.where("size > 0")
    for shift in range(HASH_BITS - BITS, -1, -BITS):
        near = broadcast_if_small(edge.select(F.col("source").alias("__source"), "need", "prefix", "below"))
        inside = inside.join(near, F.col("source").eqNullSafe(F.col("__source"))).where(
            F.shiftright("hash", shift + BITS) == F.col("prefix")
        )
        histogram = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket"), "need", "below").agg(
            F.sum("size").alias("size"), F.min("hash").alias("least"), F.max("hash").alias("most")
        )
        along = Window.partitionBy("source").orderBy("bucket")
        running = histogram.withColumn("upto", F.col("below") + F.sum("size").over(along))
        # the first bucket that reaches the need; if none does, the last one
        turn = F.when(F.col("upto") >= F.col("need"), F.col("bucket")).otherwise(F.lit(1 << 62) - F.col("bucket"))
        at = F.struct("need", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("size")).alias("below"), "size", "least", "most")
        edge = durable(running.groupBy("source").agg(F.min_by(at, turn).alias("at")).select("source", "at.*"))
        if edge.where("least < most").isEmpty():
            break
        inside = inside.select(*rows.columns)
    nearer = F.col("below") + F.col("size") - F.col("need") <= F.col("need") - F.col("below")
    last = edge.select(
        F.col("source").alias("__source"), F.when(nearer, F.col("most")).otherwise(F.col("least") - 1).alias("upto")
    )
    return goal.join(last, F.col("source").eqNullSafe(F.col("__source")), "left").select(
        "source", "source_size", "target", "copies", F.coalesce("upto", F.lit(-1).cast("long")).alias("upto")
    )


def plan(rows: DataFrame, weights=WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """One row per source: its size, target and thresholds; ``rows`` come from :func:`sized`."""
    goal = durable(targets(rows, weights, most))
    return durable(thresholds(rows, goal))


def apply(rows: DataFrame, made: DataFrame, source: str = "source", hashed: str = "hash") -> DataFrame:
    """Adds source_size, target and copies (whole copies that the mix takes) to rows with a source and a hash."""
    side = broadcast_if_small(made.select(*[F.col(c).alias(f"__{c}") for c in made.columns]))
    joined = rows.join(side, F.col(source).eqNullSafe(F.col("__source")))
    more = (F.col(hashed) <= F.col("__upto")).cast("int")
    return joined.withColumns(
        {"source_size": F.col("__source_size"), "target": F.col("__target"), "copies": F.col("__copies") + more}
    ).drop(*[f"__{c}" for c in made.columns])


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """The documents, with all their columns, as often as the mix takes them."""
    made = plan(durable(sized(docs, key, text, source)), weights, most)
    rows = docs.select(F.struct("*").alias("__row"), F.col(source).alias("__from"), document_hash(key).alias("__at"))
    taken = apply(rows, made, "__from", "__at").where("copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")
