"""Boxes and words on pages: rows from word boxes, nearest values, bands, overlapping rectangles."""

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lintel.plans.storage import settled


def overlap(a: str, b: str) -> Column:
    """Intersection over union of two rectangles given as x0, y0, x1, y1 columns with these prefixes."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(f"{a}{hi}", f"{b}{hi}") - F.greatest(f"{a}{lo}", f"{b}{lo}"))
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    both = side("x0", "x1") * side("y0", "y1")
    union = area(a) + area(b) - both
    return F.when(union > 0, both / F.when(union > 0, union)).otherwise(0.0)


#: Fixed values of rows from word boxes: words a page needs, height where none is known; tolerance and gap as multiples of the median height, and their bounds.
LEAST_WORDS, USUAL_HEIGHT = 20, 6.0
TOLERANCE, GAP = (0.8, 3.0, 8.0), (2.4, 12.0, 30.0)


def text_rows(words: DataFrame) -> DataFrame:
    """The lines of each page from word boxes (page_id, x0, x1, top, bottom, word): words whose tops round to one multiple of the
    tolerance stand in one row, and a wide gap is a pipe. Tolerance and gap follow the median of the heights above zero.

    Rounding is half to even. A page of few words has no lines; blank words are left out, a row of blank words too.
    """
    tall = F.when(F.col("bottom") - F.col("top") > 0, F.col("bottom") - F.col("top"))
    pages = words.groupBy("page_id").agg(F.coalesce(F.percentile(tall, 0.5), F.lit(USUAL_HEIGHT)).alias("h"), F.count("*").alias("n")).where(F.col("n") >= LEAST_WORDS)
    clamped = lambda by, least, most: F.greatest(F.lit(least), F.least(F.lit(most), F.col("h") * by))
    rows = words.withColumn("word", F.btrim("word")).where("word <> ''").join(pages, "page_id")
    rows = rows.withColumn("row", F.bround(F.col("top") / clamped(*TOLERANCE), 0).cast("long")).withColumn("gap", clamped(*GAP))
    before = F.lag("x1").over(Window.partitionBy("page_id", "row").orderBy("x0", "x1", "word"))
    piece = F.when(before.isNull(), F.col("word")).when(F.col("x0") - before > F.col("gap"), F.concat(F.lit("  |  "), F.col("word"))).otherwise(F.concat(F.lit(" "), F.col("word")))
    parts = rows.withColumn("piece", piece).groupBy("page_id", "row").agg(F.array_sort(F.collect_list(F.struct("x0", "x1", "word", "piece"))).alias("parts"))
    return parts.select("page_id", "row", F.array_join(F.col("parts.piece"), "").alias("line"))


def nearest_values(anchors: DataFrame, items: DataFrame, band: float) -> DataFrame:
    """For each anchor (page_id, anchor_id, x, y) the item (page_id, x, y, text) nearest in x within a band of y.

    Items are dealt by bands of y, so each anchor meets only the three bands around it.
    """
    at = lambda c: F.floor(F.col(c) / band).cast("long")
    dealt = items.select("page_id", F.col("x").alias("item_x"), F.col("y").alias("item_y"), "text", at("y").alias("cell"))
    around = anchors.withColumn("cell", F.explode(F.array(at("y") - 1, at("y"), at("y") + 1)))
    met = around.join(dealt, ["page_id", "cell"]).where(F.abs(F.col("item_y") - F.col("y")) <= band)
    return met.groupBy("page_id", "anchor_id").agg(F.min_by("text", F.struct(F.abs(F.col("item_x") - F.col("x")), "item_y", "item_x", "text")).alias("text"))


def segments(items: DataFrame, is_header: Column) -> DataFrame:
    """Items (page_id, y, x, text) with the header that they stand under: from 4 below it to 2 above the next."""
    head = F.when(is_header, F.struct(F.col("y").alias("from_y"), F.col("text").alias("header")))
    rows = items.select("page_id", "y", "x", "text", head.alias("head"))
    order = Window.partitionBy("page_id").orderBy("y", F.col("head").isNull(), "text")
    above = F.last("head", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first("head", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("above", above).withColumn("to_y", F.coalesce(below["from_y"], F.lit(1e18)))
    inside = F.col("head").isNull() & (F.col("y") >= F.col("above.from_y") + 4) & (F.col("y") < F.col("to_y") - 2)
    return rows.where(inside).select("page_id", F.col("above.header").alias("header"), "y", "x", "text")


def looked_into(levels: DataFrame, most: float, step: float) -> DataFrame:
    """levels (boxes with their levels lx, ly) for each cell (lx, ly, cx, cy) that may hold the corner of a box that overlaps them."""
    near = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    # How far a corner of that level may be, with a little more for rounding.
    far = lambda lo, hi, lev: (1 - most + 1e-6) * F.greatest(F.col(hi) - F.col(lo), F.exp((F.col(lev) + 1) * step))
    edge = lambda at, lev: F.floor(at / F.exp(F.col(lev) * step))
    cells = lambda lo, hi, lev: F.explode(F.sequence(edge(F.col(lo) - far(lo, hi, lev), lev), edge(F.col(lo) + far(lo, hi, lev), lev)))
    looking = levels.withColumn("lx", near("lx")).withColumn("ly", near("ly"))
    return looking.withColumn("cx", cells("x0", "x1", "lx")).withColumn("cy", cells("y0", "y1", "ly"))


def overlapping(boxes: DataFrame, most: float) -> DataFrame:
    """(a, b) of the boxes (page_id, rotation, no, x0, y0, x1, y1; no in order) whose overlap is more than most, the earlier one first.

    Such boxes have widths and heights within a factor of 1 / most and corners within (1 - most) of the larger side of each other. So
    a box stands in one cell, for its level of width and of height (powers of 1 / most) and its corner on that level's grid, and
    looks on its own level and the ones next to it into the cells where such a corner may be, mostly one or two a side: pairs of boxes
    far apart are never met.
    """
    step = math.log(1 / most) * (1 + 1e-6)  # a little more, so that no rounding puts two such sizes two levels apart
    sized = boxes.where("x1 > x0 and y1 > y0")
    level = lambda lo, hi: F.floor(F.log(F.col(hi) - F.col(lo)) / step).cast("int")
    cell = lambda at, lev: F.floor(F.col(at) / F.exp(F.col(lev) * step))
    levels = sized.withColumns({"lx": level("x0", "x1"), "ly": level("y0", "y1")})
    place = ["page_id", "rotation", "lx", "ly", "cx", "cy"]
    home = levels.withColumns({"cx": cell("x0", "lx"), "cy": cell("y0", "ly")})
    looking = looked_into(levels, most, step)
    sides = ["no", "x0", "y0", "x1", "y1"]
    first = home.select(*place, *(F.col(c).alias(f"a_{c}") for c in sides))
    second = looking.select(*place, *(F.col(c).alias(f"b_{c}") for c in sides))
    met = first.join(second, place).where("a_no < b_no")
    return met.where(overlap("a_", "b_") > most).select(F.col("a_no").alias("a"), F.col("b_no").alias("b"))


def distinct_rectangles(boxes: DataFrame, most: float = 0.75) -> DataFrame:
    """Of rectangles (page_id, rotation, box_id, x0, y0, x1, y1) that overlap by more than this, the first by box_id, x0 and y0.

    A box stays unless an earlier one that stays overlaps it. Equal boxes go first; the others are decided by rounds over the
    pairs that overlap: boxes without an undecided earlier one stay, those that meet them go. Rounds are half the longest chain of boxes
    that each overlap the next; a page may be split over any number of tasks.
    """
    sides, out = ["x0", "y0", "x1", "y1"], ["page_id", "rotation", "box_id", "x0", "y0", "x1", "y1"]
    flat = ~((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    single = boxes.where(~flat).groupBy("page_id", "rotation", *sides).agg(F.min("box_id").alias("box_id")).select(*out)
    order = F.struct("box_id", "x0", "y0", "x1", "y1")
    rows = settled(single.withColumn("no", order))
    undecided = settled(overlapping(rows, most))
    gone = None
    while not undecided.isEmpty():
        kept = undecided.select("a").distinct().join(undecided.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        lost = settled(undecided.join(kept, "a", "left_semi").select(F.col("b").alias("no")).distinct())
        gone = lost if gone is None else gone.unionByName(lost)
        left = undecided.join(lost.select(F.col("no").alias("b")), "b", "left_anti").join(lost.select(F.col("no").alias("a")), "a", "left_anti")
        undecided = settled(left.select("a", "b"))
    stay = rows if gone is None else rows.join(gone, "no", "left_anti")
    return stay.select(*out).unionByName(boxes.where(flat).select(*out))


def _carried(const: Column, flips: Column, order: WindowSpec) -> tuple[Column, Column]:
    """A switch's state after each row of an order: rows set it (const true or false), turn it over (flips) or leave it.

    Returns the state as set by the last row that set it and turned over since, null before any, and whether it was turned over an
    odd number of times since then.
    """
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    turned = F.sum(flips.cast("int")).over(upto)
    at_set = F.last(F.when(const.isNotNull(), F.struct(const.alias("state"), turned.alias("turned"))), ignorenulls=True).over(upto)
    odd = (turned - F.coalesce(at_set["turned"], F.lit(0))) % 2 == 1
    return at_set["state"] != odd, odd


def repaired_sequence(rows: DataFrame) -> DataFrame:
    """Mark numbers (page_id, pos, number) in order; where the next is the previous plus two, the one between is set
    to the previous plus one. Repairs count for later ones, left to right.

    Whether a number is repaired depends on whether the one before was, and on its neighbours as they are: each place is one of four
    small functions of that switch (set, unset, keep, turn over), and functions compose. Rows are dealt by ranges of (page, place); each
    task composes its stretch of a page, the stretches of a page are composed in turn, and what they carry goes back to the rows.
    """
    dealt = settled(rows.select("page_id", "pos", "number").repartitionByRange("page_id", "pos", "number").withColumn("part", F.spark_partition_id()))
    piece, order = ["page_id", "part"], ["pos", "number"]
    ends = dealt.groupBy(*piece).agg(F.min_by("number", F.struct(*order)).alias("first"), F.max_by("number", F.struct(*order)).alias("last"))
    page = Window.partitionBy("page_id").orderBy("part")
    # Pages within one partition have nothing beside them: what is left is two rows for each partition at most.
    beside = ends.withColumns({"left": F.lag("last").over(page), "right": F.lead("first").over(page)}).where("left is not null or right is not null").select(*piece, "left", "right")
    own = Window.partitionBy(*piece).orderBy(*order)
    known = dealt.join(F.broadcast(beside), piece, "left")
    known = known.withColumns({"before": F.coalesce(F.lag("number").over(own), "left"), "after": F.coalesce(F.lead("number").over(own), "right")})
    inside = F.col("before").isNotNull() & F.col("after").isNotNull()
    if_set, if_not = inside & (F.col("after") == F.col("number") + 1), inside & (F.col("after") == F.col("before") + 2)
    known = known.withColumns({"const": F.when(if_set == if_not, if_set), "flips": ~if_set & if_not})
    state, odd = _carried(F.col("const"), F.col("flips"), own)
    known = settled(known.withColumns({"state": state, "odd": odd}))
    whole = known.groupBy(*piece).agg(F.max_by("state", F.struct(*order)).alias("end"), F.max_by("odd", F.struct(*order)).alias("turned"))
    after, _ = _carried(F.col("end"), F.col("end").isNull() & F.col("turned"), page)
    carried = whole.withColumn("after", after).withColumn("carry", F.lag("after").over(page)).where("carry is not null").select(*piece, "carry")
    # The first row of a page sets the switch, so only later stretches of a page have something carried in.
    out = known.join(F.broadcast(carried), piece, "left")
    repaired = F.coalesce("state", F.col("carry") != F.col("odd"))
    return out.select("page_id", "pos", F.when(repaired, F.col("after") - 1).otherwise(F.col("number")).alias("number"))
