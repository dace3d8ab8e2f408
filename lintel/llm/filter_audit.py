"""Filter interaction audit: what each filter removes at each place of each order, by first-failure lookup.

Five filters give each document a mask of five bits. A table of 32 masks by 120 orders, computed once, says at which step a
mask fails first; each task indexes it with its masks and adds up removals by part, order and step (np.bincount, once for
each label). The partial arrays of all tasks are then summed.

Filters A to D depend on the text alone, E on equal texts. Equal texts thus share four bits: rows are folded to one for each
(digest, part, labels) before anything is gathered on a digest, and of equal texts only those with the smallest doc_id pass
E. A digest's folded rows are as few as parts and labels; a hot text never gathers. Digests are SHA-256 of the UTF-8 bytes.

Defined cases: a null text counts as empty; a null lang is the part with the empty name; a null doc_id is smaller than none, has
no smaller one, and no labels; rows that repeat a doc_id and text are not smaller than each other; a doc_id with several labels counts as
good or toxic if one of them says so; an empty table gives no rows; other columns are not read.
"""

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Words a document needs; percent of its words that are distinct, at least; percent of its characters that are capitals, at most.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
SYMBOLS = "[#$%&*|]"
#: Keys that null doc_ids are dealt to where labels are looked up.
NULL_SLOTS = 4096

_PLACES = len(ORDERS) * len(FILTERS)
_MEASURES = ["total", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def first_failures() -> np.ndarray:
    """By mask and order: the step, from 0, of the first filter that fails; 5 where none does. Bit k of a mask is filter k."""
    masks = np.arange(1 << len(FILTERS))
    fails = np.array([[masks >> FILTERS.index(f) & 1 for f in order] for order in ORDERS])  # order, step, mask
    return np.where(fails.any(axis=1), fails.argmax(axis=1), len(FILTERS)).T


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest and mask of filters A to D for every row of docs (doc_id, text, lang)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("words"))
    fails = [
        F.size("words") < LEAST_WORDS,
        100 * F.size(F.array_distinct("words")).cast("long") < DISTINCT_PERCENT * F.size("words").cast("long"),
        100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long") > CAPITAL_PERCENT * F.length("text").cast("long"),
        F.col("text").rlike(SYMBOLS),
    ]
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """With good and toxic, 0 or 1. Rows without a doc_id are dealt out by their digest: they meet no label."""
    each = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = each.agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic")))).withColumn("slot", F.lit(0))
    slot = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(NULL_SLOTS)).cast("int")).otherwise(0)
    joined = rows.withColumn("slot", slot).join(known, ["doc_id", "slot"], "left").drop("slot")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def weighed(rows: DataFrame) -> DataFrame:
    """part, mask of all five filters, good, toxic and the number of documents n, one row or two for each (digest, part, labels)."""
    folded = rows.groupBy("digest", "part", "mask", "good", "toxic", "doc_id").agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    groups = folded.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), least)
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    passes = F.col("n_null") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("passes").alias("n")), F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - F.col("passes")).alias("n")))
    return groups.withColumn("passes", passes).withColumn("one", F.explode(both)).select("part", "one.mask", "good", "toxic", "one.n").where("n > 0")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each part that the task has: its partial arrays, by order and step."""
    table, singles = first_failures(), 1 << np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    parts: dict[str, np.ndarray] = {}
    place = np.arange(len(ORDERS)) * (len(FILTERS) + 1)
    for batch in batches:
        coded = batch.column("part").dictionary_encode()
        code, mask, good, toxic, n = coded.indices.to_numpy(), *(batch.column(c).to_numpy() for c in ("mask", "good", "toxic", "n"))
        for k, part in enumerate(coded.dictionary.to_pylist()):
            own = code == k
            # Documents by mask, then by where each order removes them: float sums of whole numbers below 2**53 are exact.
            weights = [np.bincount(mask[own], n[own] * w, 1 << len(FILTERS)) for w in (np.ones(own.sum()), good[own], toxic[own])]
            step = (place + table).ravel()
            removed, lost, harm = (np.bincount(step, np.repeat(w, len(ORDERS)), len(ORDERS) * 6).reshape(len(ORDERS), 6)[:, :5] for w in weights)
            failing = np.array([[weights[0][np.flatnonzero(np.arange(32) & s)].sum() for s in order] for order in singles])
            found = np.stack([np.full_like(removed, weights[0].sum()), removed, failing - removed, weights[0][singles], lost, harm]).astype(np.int64)
            parts[part] = parts[part] + found if part in parts else found
    if parts:
        arrays = {m: pa.array([list(found[k].ravel()) for found in parts.values()], pa.list_(pa.int64())) for k, m in enumerate(_MEASURES)}
        yield pa.record_batch({"part": pa.array(parts, pa.string()), **arrays})


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included."""
    weights = weighed(_labelled(masked(docs), labels))
    partial = weights.mapInArrow(_added, f"part string, {', '.join(f'{m} array<long>' for m in _MEASURES)}")
    each = partial.select("part", F.posexplode(F.arrays_zip(*_MEASURES)).alias("place", "at"))
    summed = each.groupBy("part", "place").agg(*(F.sum(f"at.{m}").alias(m) for m in _MEASURES))
    order = F.element_at(F.lit(ORDERS), (F.floor(F.col("place") / len(FILTERS)) + 1).cast("int"))
    named = summed.select("part", order.alias("filter_order"), (F.col("place") % len(FILTERS) + 1).cast("int").alias("step"), *_MEASURES)
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    letter = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return named.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("removed").over(so_far)).alias("kept"), "removed", "redundant",
        "unique_fails", "good_lost", "toxic_lost", F.sum("removed").over(letter).alias("shapley"),
    )
