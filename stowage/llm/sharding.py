"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard has VNODES points on a ring of 2**32; a row's home is the shard of
the first point clockwise of its own. A shard takes at most its capacity, here
its exact share of the rows, so counts differ by one at most. Rows that find
their shard full go on clockwise to the first shard with room. Rows that fit at
home stay there whatever happens elsewhere, which limits movement.

Only the number of rows in each arc between two points matters for where the
overflow goes. These numbers (shards x VNODES of them, whatever the input) are
folded once around the ring; rows then need their rank in their own arc, and
no window is wider than an arc. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import keep

VNODES = 64
RING = 1 << 32
#: Arcs are looked up by this many equal cells of the ring.
CELL_BITS = 12
CELL = RING >> CELL_BITS


def ring_point(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def ring_arcs(spark: SparkSession, shards: int, vnodes: int = VNODES) -> DataFrame:
    """Arcs [lo, hi) in order with their shards; the last, beyond all points, is the first one's."""
    nodes = spark.range(shards * vnodes).select(
        (F.col("id") % shards).cast("int").alias("home"),
        ring_point(F.concat(F.lit("shard-"), F.col("id") % shards, F.lit("-"), F.floor(F.col("id") / shards))).alias("point"),
    )
    points = nodes.groupBy("point").agg(F.min("home").alias("home"))  # two shards at one point: the lower
    first = points.agg(F.min_by("home", "point").alias("home")).select(F.lit(RING - 1).cast("long").alias("point"), "home")
    ends = points.where(F.col("point") < RING - 1).unionByName(first)
    order = Window.orderBy("point")
    return ends.select(
        (F.row_number().over(order) - 1).alias("arc"),
        F.coalesce(F.lag("point").over(order) + 1, F.lit(0)).alias("lo"),
        (F.col("point") + 1).alias("hi"),
        "home",
    )


def place(arcs: DataFrame, shards: int) -> DataFrame:
    """Where the rows of each arc go: ranks [begin, stop) of ``arc`` to ``shard``, from ``slot`` on.

    ``arcs`` has arc, home and n, the number of its rows. All steps work on as
    many rows as there are arcs.
    """
    earlier = Window.partitionBy("home").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    room = F.floor(F.col("total") / shards) + F.when(F.col("home") < F.col("total") % shards, 1).otherwise(0)
    homes = (
        arcs.withColumn("total", arcs.agg(F.sum("n")).scalar())
        .withColumn("cap", room)
        .withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn("fits", F.least(F.col("n"), F.greatest(F.col("cap") - F.col("base"), F.lit(0))))
        .withColumn("over", F.col("n") - F.col("fits"))
        .withColumn("over_from", F.coalesce(F.sum("over").over(before), F.lit(0)))
    )
    at_home = homes.where("fits > 0").select("arc", F.lit(0).cast("long").alias("begin"), F.col("fits").alias("stop"), F.col("home").alias("shard"), F.col("base").alias("slot"))
    # the fold: twice around the ring, the overflow queue in front, the rooms left behind
    used = homes.groupBy("home").agg(F.sum("fits").alias("used"))
    caps = arcs.agg(F.sum("n").alias("total")).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("home"), "total")
    left = caps.join(used, "home", "left").select("home", (room - F.coalesce("used", F.lit(0))).alias("left"), F.coalesce("used", F.lit(0)).alias("used"))
    lefts = left.agg(F.transform(F.array_sort(F.collect_list(F.struct("home", "left"))), lambda x: x["left"]).alias("lefts"))
    ring = homes.agg(F.array_sort(F.collect_list(F.struct("arc", "home", "over"))).alias("ring"))
    again = lambda x: F.struct(x["arc"], x["home"], F.lit(0).cast("long").alias("over"))
    start = F.struct(
        F.col("lefts").alias("lefts"), F.lit(0).cast("long").alias("queue"), F.lit(0).cast("long").alias("taken"),
        F.array().cast("array<struct<shard:int,begin:bigint,stop:bigint>>").alias("out"),
    )

    def step(s: Column, arc: Column) -> Column:
        waiting = s["queue"] + arc["over"]
        take = F.least(waiting, F.element_at(s["lefts"], arc["home"] + 1))
        piece = F.struct(arc["home"].cast("int").alias("shard"), s["taken"].alias("begin"), (s["taken"] + take).alias("stop"))
        return F.struct(
            F.when(take > 0, F.transform(s["lefts"], lambda x, i: F.when(i == arc["home"], x - take).otherwise(x))).otherwise(s["lefts"]).alias("lefts"),
            (waiting - take).alias("queue"),
            (s["taken"] + take).alias("taken"),
            F.when(take > 0, F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"),
        )

    folded = ring.withColumn("lefts", lefts.scalar()).select(F.aggregate(F.concat("ring", F.transform("ring", again)), start, step, lambda s: s["out"]).alias("out"))
    moves = folded.select(F.explode("out").alias("m")).select("m.*")
    filled = Window.partitionBy("shard").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    moves = moves.withColumn("filled", F.coalesce(F.sum(F.col("stop") - F.col("begin")).over(filled), F.lit(0)))
    moves = moves.join(F.broadcast(left.select(F.col("home").alias("shard"), "used")), "shard").select("shard", "begin", (F.col("used") + F.col("filled")).alias("slot"))
    # cut the queue at the starts of arcs and of moves; each piece has one of both
    starts = homes.where("over > 0").select(F.col("over_from").alias("cut"), F.struct("arc", "fits", "over_from", "over").alias("a"), F.lit(None).cast("struct<shard:int,begin:bigint,slot:bigint>").alias("m"))
    cuts = starts.unionByName(moves.select(F.col("begin").alias("cut"), F.lit(None).cast(starts.schema["a"].dataType).alias("a"), F.struct(F.col("shard").cast("int").alias("shard"), "begin", "slot").alias("m")))
    cuts = cuts.groupBy("cut").agg(F.max("a").alias("a"), F.max("m").alias("m"))
    order = Window.orderBy("cut")
    pieces = cuts.select(
        "cut", F.lead("cut").over(order).alias("next"), F.last("a", True).over(order).alias("a"), F.last("m", True).over(order).alias("m")
    )
    inner = F.col("cut") - F.col("a.over_from") + F.col("a.fits")
    length = F.least(F.coalesce("next", F.lit(1 << 62)), F.col("a.over_from") + F.col("a.over")) - F.col("cut")
    moved = pieces.select(F.col("a.arc").alias("arc"), inner.alias("begin"), (inner + length).alias("stop"), F.col("m.shard").alias("shard"), (F.col("m.slot") + F.col("cut") - F.col("m.begin")).alias("slot"))
    return at_home.unionByName(moved)


def assign_shards(docs: DataFrame, shards: int = 40, vnodes: int = VNODES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and home_shard of every row.

    Size is the UTF-8 bytes of the text (null: none) plus 16. The law is
    ``rows``: counts differ by one at most. A row's place on the ring is the
    hash of its doc_id (null: of its text); ties are broken by the other columns, and rows equal in
    all of them are interchangeable. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        ring_point(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text-"), F.sha2(text, 256)))).alias("point"),
    )
    arcs, _ = keep(ring_arcs(spark, shards, vnodes), "arcs")
    # cells and arcs: shards x vnodes + 2**CELL_BITS rows whatever the input
    cells = arcs.select("arc", "lo", "hi", "home", F.explode(F.sequence(F.floor(F.col("lo") / CELL), F.floor((F.col("hi") - 1) / CELL))).alias("cell"))
    inside = (F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi"))
    located = rows.withColumn("cell", F.floor(F.col("point") / CELL)).join(F.broadcast(cells), "cell").where(inside).drop("cell", "lo", "hi")
    counts = located.groupBy("arc").agg(F.count("*").alias("n"))
    counted, _ = keep(arcs.select("arc", "home").join(counts, "arc", "left").fillna(0, ["n"]), "arc-counts")
    pieces, _ = keep(place(counted, shards), "arc-pieces")
    rank = F.row_number().over(Window.partitionBy("arc").orderBy("point", "doc_id", "text_crc32", "size")) - 1
    ranked = located.withColumn("rank", rank)
    fits = (F.col("rank") >= F.col("begin")) & (F.col("rank") < F.col("stop"))
    placed = ranked.join(F.broadcast(pieces), "arc").where(fits)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("slot") + F.col("rank") - F.col("begin")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("home").cast("int").alias("home_shard"),
    )
