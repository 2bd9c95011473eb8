"""Mixing sources to target weights by capped water-filling.

Targets share the total by weight; a source is clamped at ``cap`` times its size and its excess is shared anew
by weight until none is above. A source's target is then met by whole repetitions of all its documents and one
more of a seeded part of them, taken in hash order; what is larger than the room left is skipped, until nothing fits.

Rows go by their content. Equal rows are one unit with a number of copies, of which the part may take some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_stage, free_name, numbered, stage

WORD = r"[^\x20\x09-\x0D]+"
#: Buckets of the seeded order; only the buckets on a threshold are ever sorted.
BUCKETS = 1 << 16
#: Copies of one row that a task writes at a time.
COPIES = 1 << 16
#: Sources up to which the plan, a row of about 200 bytes for each, is broadcast.
BROADCAST_SOURCES = 20_000
MEASURES = ("size", "source_size", "target", "repeats", "taken")


def water_fill(sizes: list[float], weights: list[float], cap: float, total: float | None = None) -> list[float]:
    """Targets by source, none above ``cap`` times its size; where the total can't be reached all are clamped."""
    if any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    left = float(sum(sizes) if total is None else total)
    target, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        share = left / sum(weights[i] for i in free)
        full = [i for i in free if share * weights[i] > cap * sizes[i]]
        if not full:
            for i in free:
                target[i] = share * weights[i]
            break
        for i in full:
            target[i] = cap * float(sizes[i])
            left -= target[i]
            free.discard(i)
    return target


def targets(sources: DataFrame, weights, cap: float) -> DataFrame:
    """``sources`` (source, source_size) with target: the same water-filling, whatever their number.

    Only the share of a weight of 1 is held by the driver. It rises while more sources are clamped.
    """
    if any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    ranked = numbered(sources, [F.col("source").asc_nulls_last()], "_at")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = stage(ranked.withColumn("_w", F.element_at(cycle, (F.col("_at") % len(weights) + 1).cast("int"))).drop("_at"), "mix-sources")
    most = F.lit(float(cap)) * F.col("source_size")
    share, clamped = 0.0, -1
    while True:
        full = F.lit(share) * F.col("_w") > most
        got = ranked.agg(F.count_if(full).alias("k"), F.sum("source_size").cast("double").alias("all"), F.sum(F.when(full, most)).alias("spent"), F.sum(F.when(~full, F.col("_w"))).alias("w")).first()
        if got["k"] == clamped or not got["w"]:
            break
        clamped, share = got["k"], ((got["all"] or 0.0) - (got["spent"] or 0.0)) / got["w"]
    free = F.lit(share) * F.col("_w")
    return ranked.withColumn("target", F.when(free > most, most).otherwise(free)).drop("_w")


def keyed(docs: DataFrame, seed: int, id_col: str = "doc_id") -> DataFrame:
    """Rows packed up as ``row``, with source, size and the seeded hash of all that they hold but maps."""
    if id_col not in docs.columns:
        raise ValueError(f"there is no column {id_col}")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), *plain).alias("key"))


def _bucket() -> Column:
    return F.pmod("key", F.lit(BUCKETS)).cast("int")


def _mixed(docs: DataFrame, weights, cap: float, seed: int, id_col: str) -> DataFrame:
    """row, size, source_size, target, repeats for every row of ``docs``."""
    rows = keyed(docs, seed, id_col)
    slim = stage(rows.select("source", "size", "key"), "mix-sizes")
    units = stage(slim.groupBy("source", "key", "size").agg(F.count("*").alias("copies")), "mix-units")
    drop_stage(slim)
    plan, parts = thresholds(units, weights, cap)
    met = _by_source(rows.withColumn("bucket", _bucket()), plan)
    here = lambda p: (p["bucket"] == F.col("bucket")) & (p["key"] == F.col("key")) & (p["size"] == F.col("size"))
    at = F.struct("bucket", "key", "size")
    once = F.exists("parts", lambda p: (at <= F.struct(p["bucket"].alias("bucket"), p["key"].alias("key"), p["size"].alias("size"))) & (F.col("size") <= p["room"]))
    repeats = F.when(F.col("size") > 0, F.col("whole") + once.cast("long")).otherwise(F.lit(0)).cast("long")
    if parts.where("split").isEmpty():
        return met.select("row", "size", "source_size", "target", repeats.alias("repeats"))
    # of a unit that a part takes some copies of, one row is kept with their number and written out again
    split = F.coalesce(F.exists("parts", lambda p: p["split"] & here(p)), F.lit(False))
    plain = met.where(~split).select("row", "size", "source_size", "target", repeats.alias("repeats"))
    more = F.get(F.filter("parts", lambda p: p["split"] & here(p)), F.lit(0))["more"]
    few = met.where(split).groupBy("source", "key", "size").agg(F.first("row").alias("row"), F.count("*").alias("n"), F.first(more).alias("more"), *[F.first(c).alias(c) for c in ("source_size", "target", "whole")])
    dealt = few.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}")))).repartition("key", "block")
    last = F.least(F.col("n"), (F.col("block") + 1) * COPIES) - 1
    copies = dealt.withColumn("i", F.explode(F.sequence(F.col("block") * COPIES, last)))
    return plain.unionByName(copies.select("row", "size", "source_size", "target", (F.col("whole") + (F.col("i") < F.col("more")).cast("long")).alias("repeats")))


def mix_sources(docs: DataFrame, weights=(1.0, 2.0, 3.0), cap: float = 3.0, seed: int = 17, id_col: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` and size, source_size, target, repeats (whole takes of the row), taken (words).

    Sources are ordered by code point, null last, and take the weights in turn; their number is not limited. Every
    row is returned, an empty table gives none; null and empty texts have size 0 and take nothing. Ids may repeat or
    be null: rows are told apart by all their columns, and of equal rows, which can't be, as many are taken as the
    target has room for. A text larger than what its source's target leaves is skipped. Columns of ``docs`` that have
    the name of one of the five give way to it, all others stay as they are.
    """
    mixed = _mixed(docs, weights, cap, seed, id_col)
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in MEASURES]
    return mixed.select(*own, "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def repeated(docs: DataFrame, name: str, weights=(1.0, 2.0, 3.0), cap: float = 3.0, seed: int = 17, id_col: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` and, as ``name``, how often the mix takes the row."""
    own = [F.col("row").getField(c).alias(c) for c in docs.columns]
    return _mixed(docs, weights, cap, seed, id_col).select(*own, F.col("repeats").alias(free_name(docs.columns, name)))


def _by_source(left: DataFrame, plan: DataFrame) -> DataFrame:
    """``left`` with its source's row of the plan, a small table unless sources are very many."""
    plan = plan.withColumnRenamed("source", "_source")
    small = plan.count() <= BROADCAST_SOURCES
    return left.join(F.broadcast(plan) if small else plan, left["source"].eqNullSafe(plan["_source"])).drop("_source")


def thresholds(units: DataFrame, weights=(1.0, 2.0, 3.0), cap: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """A row for each source, with its target, whole repetitions and the parts of the partial one; and all parts.

    ``units`` has source, key, size and copies. A part ends at a place of the hash order and takes the units up to
    there that are not larger than its room; of the unit on the place it takes ``more`` copies, where it is split.
    Rooms shrink from part to part, so a unit is taken if any part that ends at or behind it has room for it.
    """
    sources = targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, cap)
    whole = F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0)).cast("long")
    plan = sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = stage(plan, "mix-plan")
    placed = units.where("size > 0").withColumn("bucket", _bucket())
    nowhere = F.struct(F.lit(-1).alias("bucket"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("size"))
    now = stage(plan.where("rest >= 1").select("source", nowhere.alias("at"), F.col("rest").alias("room")), "mix-room")
    parts = stage(_next_parts(placed, now), "mix-part")
    found = [parts]
    while not parts.isEmpty():  # a room shrinks whenever anything is taken; a source that takes nothing leaves
        left = parts.where("room - taken >= 1").select("source", F.struct("bucket", "key", "size").alias("at"), (F.col("room") - F.col("taken")).alias("room"))
        parts = stage(_next_parts(placed, left), "mix-part")
        found.append(parts)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = stage(every, "mix-parts")
    for done in found:
        drop_stage(done)
    lists = every.groupBy("source").agg(F.collect_list(F.struct("bucket", "key", "size", "more", "split", "room")).alias("parts"))
    lists = lists.withColumnRenamed("source", "_listed")
    plan = plan.join(lists, plan["source"].eqNullSafe(lists["_listed"]), "left").drop("_listed", "rest")
    none = F.array().cast(lists.schema["parts"].dataType)
    return stage(plan.withColumn("parts", F.coalesce("parts", none)), "mix-thresholds"), every


def _next_parts(placed: DataFrame, now: DataFrame) -> DataFrame:
    """For each source of ``now`` (source, at, room): the longest run behind ``at`` of what fits, copy by copy.

    Returns source, room, the run's last unit (bucket, key, size), the copies taken of it, whether that leaves some,
    and the words taken.
    """
    free = _by_source(placed, now).where((F.col("size") <= F.col("room")) & (F.struct("bucket", "key", "size") > F.col("at")))
    words = F.col("size") * F.col("copies")
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = free.groupBy("source", "room", "bucket").agg(F.sum(words).alias("words"), F.max(F.struct("key", "size", "copies")).alias("last"))
    sums = sums.withColumn("upto", F.sum("words").over(order))
    whole = sums.where("upto <= room").select("source", "room", "bucket", "last.key", "last.size", F.col("last.copies").alias("more"), F.lit(False).alias("split"), F.col("upto").alias("taken"))
    edge = sums.where("upto > room AND upto - words <= room").select(F.col("source").alias("_at"), F.col("bucket").alias("_edge"), (F.col("upto") - F.col("words")).alias("_below"))
    # of a source's units only those of the bucket on the threshold are sorted: 1 / BUCKETS of them
    inner = Window.partitionBy("source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    split = free.join(edge, free["source"].eqNullSafe(edge["_at"]) & (F.col("bucket") == F.col("_edge")))
    split = split.withColumn("before", F.col("_below") + F.sum(words).over(inner) - words).where("before <= room")
    more = F.least(F.col("copies"), F.floor((F.col("room") - F.col("before")) / F.col("size")))
    split = split.withColumn("more", more).where("more > 0")
    ends = whole.unionByName(split.select("source", "room", "bucket", "key", "size", "more", (F.col("more") < F.col("copies")).alias("split"), (F.col("before") + F.col("more") * F.col("size")).alias("taken")))
    end = F.max(F.struct("bucket", "key", "size", "more", "split", "taken")).alias("e")
    return ends.groupBy("source", "room").agg(end).select("source", "room", "e.*")
