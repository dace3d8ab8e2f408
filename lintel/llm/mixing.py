"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's rows are permuted by a seeded hash into blocks of about BLOCK_ROWS rows, at any size of the input. The
source's target, in words, is a number of whole passes over it and a part. The part is a prefix of its permuted blocks; what
is left of it at the cut is filled from the next ZONE blocks, the largest rows that fit first and then the one that comes
nearest. Drawn blocks are a quota per source. A binary tree over the output shards splits the quotas: each node gives
its left half an exact number of draws, taken from the sources by a multivariate hypergeometric draw, so every shard gets a
random and exact share of every source. A shard's blocks are the next ones in an affine permutation of the block
numbers, another one for each pass, disjoint from all others, and its rows are ordered by a seeded hash.

Which copies of a row are drawn, and where they go, follows from the row's hash and its source's row of the plan alone: no
row of documents is shuffled for it. Sums of blocks are shuffled (one row a block, added up in two steps), and the rows of
the cut. The driver plans one row of under 3 KB for each source; with over BROADCAST_SOURCES of them the plan is joined by
a shuffle instead of a broadcast.

Defined cases: a null text has size 0, a very long one is counted whole; null is a source of its own, the last; a source
with no words has target 0; rows that repeat a doc_id are rows of their own, and those alike in id and text share their fate; other
columns are not read, mixed() hands them on; an empty table gives no rows.
"""

from itertools import accumulate
from math import gcd

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.storage import checkpointed

WEIGHTS, SHARE, CEILING = (5, 2, 1), 1.5, 2
SHARDS, SEED = 24, 1
#: Rows of a block, blocks from which the cut is filled, and blocks whose sizes are added up in one group.
BLOCK_ROWS, ZONE, GROUP = 16, 16, 64
BROADCAST_SOURCES = 10_000
#: Standard deviations on either side of the mode that a draw's law is written out for; what lies beyond is below a double's precision.
DEVIATIONS = 12

_PLAN = "source_no int, source string, source_size long, target double, passes int, n_blocks long"
_CUT = "plan_no int, cut long, taken_places array<long>, part_blocks long, steps array<long>, ends array<long>"


def targets(sizes: list[int], weights: list[float], share: float = SHARE, ceiling: float = CEILING) -> list[float]:
    """Shares of share * sum(sizes) by weight; none above ceiling times its size, the excess reshared by weight."""
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = share * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > ceiling * sizes[i]}
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            return out
        for i in full:
            out[i] = float(ceiling * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in full]
    return out


def hypergeometric(rng: np.random.Generator, own: int, others: int, draws: int) -> int:
    """How many of so many draws without replacement are own ones: one law at any size.

    The law is written out from its mode by the exact ratios of neighbouring probabilities and inverted; it takes memory in proportion
    to the standard deviation, 100 MB of doubles at some 10**12 of each kind.
    """
    lo, hi, total = max(0, draws - others), min(own, draws), own + others
    if lo >= hi:
        return lo
    mode = min(hi, max(lo, (draws + 1) * (own + 1) // (total + 2)))
    deviation = (draws * (own / total) * (others / total) * ((total - draws) / max(1, total - 1))) ** 0.5
    reach = int(DEVIATIONS * deviation) + 64
    first, last = max(lo, mode - reach), min(hi, mode + reach)
    down, up = np.arange(mode, first, -1, dtype=np.float64), np.arange(mode, last, dtype=np.float64)
    spare = float(others - draws)
    below = np.cumprod(down / (own - down + 1) * ((spare + down) / (draws - down + 1)))
    above = np.cumprod((own - up) / (up + 1) * ((draws - up) / (spare + up + 1)))
    law = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return first + int(np.searchsorted(law, rng.random() * law[-1], "right"))


def _drawn(rng: np.random.Generator, left: list[int], draws: int) -> list[int]:
    """A multivariate hypergeometric draw, source by source."""
    out, rest = [], sum(left)
    for own in left:
        n = hypergeometric(rng, own, rest - own, draws)
        out.append(n)
        rest, draws = rest - own, draws - n
    return out


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """Draws of each source for each shard; shard totals differ by at most one."""
    rng = np.random.Generator(np.random.PCG64(seed))
    totals = [sum(quotas) // shards + (i < sum(quotas) % shards) for i in range(shards)]

    def split(left: list[int], lo: int, hi: int) -> list[list[int]]:
        if hi - lo == 1:
            return [left]
        mid = (lo + hi) // 2
        own = _drawn(rng, left, sum(totals[lo:mid]))
        return split(own, lo, mid) + split([x - y for x, y in zip(left, own)], mid, hi)

    return [list(x) for x in zip(*split(list(quotas), 0, shards))]


def _step(n: int, salt: int) -> int:
    """A multiplier without a common factor with n, of an affine permutation of n numbers."""
    step = max(1, int(n * ((0.6180339887 + 0.137 * salt) % 1)))
    while gcd(step, n) > 1:
        step += 1
    return step


def _measured(docs: DataFrame, seed: int) -> tuple[Column, Column, Column]:
    """Size, text hash and place of a row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = F.xxhash64(F.lit(0), text)
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), hashed, F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), hashed)


def _block(place: Column, n_blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed + 1), place), n_blocks)


def _filled(zone: Column, gap: Column) -> Column:
    """Places of the rows (words, place) of a cut that fill its gap: the largest that fit, then the one that comes nearest."""
    start = F.struct(gap.alias("left"), F.array().cast("array<long>").alias("taken"), F.lit(None).cast("struct<words:long,place:long>").alias("other"))
    fits = lambda a, x: x["words"] <= a["left"]
    step = lambda a, x: F.struct(
        F.when(fits(a, x), a["left"] - x["words"]).otherwise(a["left"]).alias("left"),
        F.when(fits(a, x), F.concat(a["taken"], F.array(x["place"]))).otherwise(a["taken"]).alias("taken"),
        F.when(fits(a, x), a["other"]).otherwise(x).alias("other"),  # the smallest that did not fit
    )
    nearer = lambda a: F.coalesce(a["other"]["words"] < 2 * a["left"], F.lit(False))
    return F.aggregate(F.sort_array(zone, asc=False), start, step, lambda a: F.when(nearer(a), F.concat(a["taken"], F.array(a["other"]["place"]))).otherwise(a["taken"]))


def _planned(rows: DataFrame, weights: tuple[float, ...], share: float, ceiling: int, shards: int, seed: int, block_rows: int) -> DataFrame:
    """One row for each source: its blocks, its cut and its draws; rows: source, size, place."""
    spark = rows.sparkSession
    stats = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).collect()
    stats.sort(key=lambda r: (r.source is None, r.source or ""))  # Python compares by code point
    aims = targets([r.source_size for r in stats], [float(weights[i % len(weights)]) for i in range(len(stats))], share, ceiling)
    plan = [(i, r.source, r.source_size, aim, int(aim // r.source_size) if r.source_size else 0, -(-r.n // block_rows)) for i, (r, aim) in enumerate(zip(stats, aims))]
    sources = _small(spark.createDataFrame(plan, _PLAN), len(plan))

    cell = rows.withColumnRenamed("source", "from").join(sources, F.col("from").eqNullSafe(F.col("source"))).withColumn("block", _block(F.col("place"), F.col("n_blocks"), seed))
    cell = cell.select("source_no", "block", "place", F.col("size").alias("words"), (F.col("target") - F.col("passes") * F.col("source_size")).alias("part"))
    blocks = cell.groupBy("source_no", "block", "part").agg(F.sum("words").alias("words")).withColumn("group", F.floor(F.col("block") / GROUP))
    blocks = checkpointed(blocks)
    ahead = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    groups = blocks.groupBy("source_no", "group").agg(F.sum("words").alias("words"))
    groups = groups.select("source_no", "group", F.coalesce(F.sum("words").over(ahead(["source_no"], "group")), F.lit(0)).alias("earlier"))
    placed = blocks.withColumn("before", F.coalesce(F.sum("words").over(ahead(["source_no", "group"], "block")), F.lit(0))).join(groups, ["source_no", "group"])
    placed = placed.withColumn("before", F.col("before") + F.col("earlier")).where(F.col("before") + F.col("words") > F.col("part"))
    cuts = placed.groupBy("source_no").agg(F.min("block").alias("cut"), F.min_by(F.col("part") - F.col("before"), "block").alias("gap"))
    cuts = _small(checkpointed(cuts), len(plan))
    zone = cell.join(cuts, "source_no").where((F.col("block") >= F.col("cut")) & (F.col("block") < F.col("cut") + ZONE) & (F.col("gap") > 0))
    # Rows alike in id and text are one entry; a zone has some ZONE * block_rows rows.
    zone = zone.groupBy("source_no", "gap", "place").agg(F.sum("words").alias("words"))
    taken = zone.groupBy("source_no", "gap").agg(F.collect_list(F.struct("words", "place")).alias("zone")).select("source_no", _filled(F.col("zone"), F.col("gap")).alias("taken"))
    found = {r.source_no: r for r in cuts.join(taken, "source_no", "left").collect()}

    shares, quotas, parts = [], [], []
    for i, _, _, aim, passes, n_blocks in plan:
        r = found.get(i)
        inside = r is not None and r.gap > 0
        cut = r.cut if r is not None else 0
        parts.append((cut, list(r.taken or []) if inside else [], min(n_blocks, cut + ZONE) if inside else cut))
        quotas.append(passes * n_blocks + parts[-1][2])
    for (i, _, _, _, passes, n_blocks), (cut, chosen, part_blocks), draws in zip(plan, parts, split_quotas(quotas, shards, seed)):
        shares.append((i, cut, chosen, part_blocks, [*(_step(n_blocks, c) for c in range(passes)), _step(max(part_blocks, 1), passes)], list(accumulate(draws))))
    both = spark.createDataFrame(plan, _PLAN).join(spark.createDataFrame(shares, _CUT), F.col("source_no") == F.col("plan_no")).drop("plan_no")
    return _small(both, len(plan))


def _small(frame: DataFrame, rows: int) -> DataFrame:
    """Broadcast, where it has few rows."""
    return F.broadcast(frame) if rows <= BROADCAST_SOURCES else frame


def _placements(place: Column, s: str, seed: int) -> Column:
    """(copy, shard) of each drawn copy of a row; s: the struct column of its source's plan."""
    p = F.col(s)
    block = _block(place, p["n_blocks"], seed)

    def placed(b: Column) -> Column:
        draw = lambda c, n: c * p["n_blocks"] + (b * F.get(p["steps"], c) + c) % n + 1
        shard = lambda d: F.size(F.filter(p["ends"], lambda e: e < d))
        copy = lambda c, n: F.struct(c.alias("copy"), F.transform(F.array(draw(c, n)), shard)[0].alias("shard"))
        whole = F.filter(F.sequence(F.lit(0), p["passes"]), lambda c: c < p["passes"])
        in_part = (b < p["cut"]) | ((b < p["part_blocks"]) & F.array_contains(p["taken_places"], place))
        part = F.when(in_part, F.array(copy(p["passes"], p["part_blocks"]))).otherwise(F.array().cast("array<struct<copy:int,shard:int>>"))
        return F.concat(F.transform(whole, lambda c: copy(c, p["n_blocks"])), part)

    return F.transform(F.array(block), placed)[0]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The decision for every row, and the draws.

    The first frame has doc_id, source, size, source_size, target, copies, taken (copies * size) and shards (one for each
    copy) for each row of docs (doc_id, text, source). The second has doc_id, text_hash, source, copy, shard and position in the shard's
    local shuffle (an order key, not a gapless number), one row for each copy.
    """
    size, hashed, place = _measured(docs, seed)
    rows = checkpointed(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), hashed.alias("text_hash"), place.alias("place")))
    plan = _planned(rows, weights, share, ceiling, shards, seed, block_rows).select(F.struct("*").alias("plan"))
    cell = rows.join(plan, F.col("source").eqNullSafe(F.col("plan.source"))).withColumn("placements", _placements(F.col("place"), "plan", seed)).withColumn("copies", F.size("placements"))
    decisions = cell.select(
        "doc_id", "text_hash", "source", "size", F.col("plan.source_size").alias("source_size"), F.col("plan.target").alias("target"), "copies",
        (F.col("copies") * F.col("size")).alias("taken"), F.col("placements.shard").alias("shards"),
    )
    draws = cell.select("doc_id", "text_hash", "source", "place", F.explode("placements").alias("p")).select("doc_id", "text_hash", "source", F.col("p.copy").alias("copy"), F.col("p.shard").alias("shard"), "place")
    draws = draws.withColumn("position", F.xxhash64(F.lit(seed + 3), "shard", "place", "copy")).drop("place")
    return decisions, draws


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of docs (doc_id, text, source and any others), each as often as the mix draws it."""
    size, _, place = _measured(docs, seed)
    rows = checkpointed(docs.select(F.col("source").cast("string"), size.alias("size"), place.alias("place")))
    plan = _planned(rows, weights, share, ceiling, SHARDS, seed, block_rows)
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").cast("string").alias("from"), place.alias("place"))
    met = whole.join(plan.select(F.struct("*").alias("plan")), F.col("from").eqNullSafe(F.col("plan.source")))
    return met.select("row", F.explode(_placements(F.col("place"), "plan", seed))).select("row.*")
