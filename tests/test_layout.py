"""Boxes, sequences, places and vectors against plain loops."""

import math
import random

import numpy as np
import pytest

from lintel.operators import layout, ordinals, retrieve

BOXES = "page_id int, rotation int, box_id int, x0 double, y0 double, x1 double, y1 double"


def iou(a, b):
    w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - w * h)


def folded(rows):
    """One after the other, each against all that stay."""
    kept = []
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3], r[4], r[5], r[6])):
        if not any(k[:2] == r[:2] and iou(r, k) > 0.75 for k in kept):
            kept.append(r)
    return kept


def test_distinct_rectangles(spark):
    """Stacks, chains that each overlap the next, sizes around the levels' limits, flat and equal boxes, negative places."""
    rng, rows = random.Random(3), []
    for page in range(3):
        for n in range(120):
            x, y, w, h = (rng.choice([-40.0, 0.0, 13.0, 200.0]) + rng.random() * 9, rng.random() * 12 - 6, rng.choice([3.0, 4.0, 16 / 3, 40.0, 0.0]) * rng.choice([1, 1, 1.2]), rng.choice([2.0, 8 / 3, 30.0]))
            rows.append((page, rng.choice([0, 90]), n, x, y, x + w, y + h))
        rows += [(page, 0, 1000 + k, 500.0 + k, 500.0, 520.0 + k, 520.0) for k in range(12)]  # a chain
        rows += [rows[-1], (*rows[-3][:2], 5000, *rows[-3][3:])]
    got = sorted(map(tuple, layout.distinct_rectangles(spark.createDataFrame(rows, BOXES).repartition(4)).collect()))
    want = sorted(r for r in folded(rows) if r[5] > r[3] and r[6] > r[4])
    assert [r for r in got if r[5] > r[3] and r[6] > r[4]] == want
    assert sorted(r for r in got if not (r[5] > r[3] and r[6] > r[4])) == sorted(r for r in rows if not (r[5] > r[3] and r[6] > r[4]))  # nothing overlaps a flat box


def test_a_page_of_many_boxes(spark):
    boxes = spark.range(100_000).selectExpr("1 as page_id", "0 as rotation", "cast(id as int) as box_id", "cast((id div 4) % 250 * 30 + id % 4 as double) as x0", "cast((id div 1000) * 30 as double) as y0")
    boxes = boxes.selectExpr("*", "x0 + 20 as x1", "y0 + 20 as y1")
    kept = layout.distinct_rectangles(boxes)
    # Of four boxes that are moved by one each, the first stays, and the last: 17 of 23 is under the limit.
    assert kept.count() == 50_000 and kept.where("box_id % 4 in (0, 3)").count() == 50_000


def repaired(numbers):
    numbers = list(numbers)
    for i in range(1, len(numbers) - 1):
        if numbers[i + 1] == numbers[i - 1] + 2 and numbers[i] != numbers[i - 1] + 1:
            numbers[i] = numbers[i - 1] + 1
    return numbers


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_repaired_sequence(spark, partitions):
    """Pages of any length, one of which is split over all tasks; runs in which each repair depends on the one before."""
    rng = random.Random(partitions)
    pages = {p: [rng.choice([0, 1, 2, 3, k, k + 1]) for k in range(rng.choice([0, 1, 2, 3, 9, 30]))] for p in range(30)}
    pages[99] = [0 if k % 2 else k for k in range(400)] + [rng.randint(0, 2) + k for k in range(600)]
    rows = [(p, k, n) for p, numbers in pages.items() for k, n in enumerate(numbers)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.page_id, r.pos): r.number for r in layout.repaired_sequence(spark.createDataFrame(rows, "page_id int, pos int, number int").repartition(3)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(p, k): n for p, numbers in pages.items() for k, n in enumerate(repaired(numbers))}


def test_text_rows(spark):
    """Heights above zero have the median 10: tolerance 8, gap 24. Tops of 4 and 12 round to rows 0 and 2, halves to even."""
    words = [(1, 0.0, 10.0, 0.0, 10.0, "A"), (1, 34.0, 40.0, 4.0, 14.0, "B"), (1, 64.5, 70.0, 0.0, 0.0, " C "), (1, 71.0, 72.0, 0.0, 9.0, "  "), (1, 95.0, 99.0, 1.0, 11.0, "D"), (1, 0.0, 5.0, 12.0, 22.0, "E")]
    words += [(1, float(k), k + 1.0, 100.0, 110.0, "") for k in range(14)]
    words += [(2, float(k), k + 1.0, 0.0, 8.0, "x") for k in range(19)]  # too few
    words += [(3, float(k * 50), k * 50 + 1.0, 5.0, 5.0, f"w{k}") for k in range(20)]  # no heights: 6.0, gap 14.4
    found = {(r.page_id, r.row): r.line for r in layout.text_rows(spark.createDataFrame(words, "page_id int, x0 double, x1 double, top double, bottom double, word string")).collect()}
    assert found == {(1, 0): "A B  |  C  |  D", (1, 2): "E", (3, 1): "  |  ".join(f"w{k}" for k in range(20))}


def test_places(spark):
    rng = random.Random(1)
    values = [(rng.randint(0, 50), str(k)) for k in range(1000)]
    from pyspark.sql import functions as F

    got = ordinals.numbered(spark.createDataFrame(values, "a int, b string").repartition(5), [F.col("a"), F.col("b")]).collect()
    assert sorted((r.place, r.a, r.b) for r in got) == [(k, *v) for k, v in enumerate(sorted(values), 1)]
    assert ordinals.numbered(spark.createDataFrame([], "a int"), [F.col("a")]).collect() == []


def test_index_recall(spark):
    """Nine of ten neighbours are found with some of the cells, all with all of them; a hot vector fills many blocks."""
    rng = np.random.default_rng(5)
    points = rng.normal(size=(3000, 16)) + rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] * 2
    points[2000:] = points[2000]
    vectors = spark.createDataFrame([(k, v.astype(float).tolist()) for k, v in enumerate(points)], "vec_id long, embedding array<float>").repartition(4)
    queries = vectors.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as query")
    exact = {(r.query_id, r.vec_id) for r in retrieve.nearest(vectors, queries).collect()}
    some = {(r.query_id, r.vec_id) for r in retrieve.nearest_by_index(vectors, queries, cells=64, probes=12).collect()}
    assert len(exact & some) >= 0.9 * len(exact) and len(some) == len(exact)
    assert {(r.query_id, r.vec_id) for r in retrieve.nearest_by_index(vectors, queries, cells=8, probes=8).collect()} == exact
    assert retrieve.nearest_by_index(vectors.limit(0), queries).collect() == []


def test_boxes_look_into_few_cells(spark):
    """A box may meet corners in one or two cells a side on each of nine levels, not in three."""
    boxes = spark.range(200).selectExpr("id * 7.3D as x0", "id * 3.1D as y0", "id * 7.3D + 5 + id % 9 as x1", "id * 3.1D + 4 + id % 5 as y1", "floor(log(5 + id % 9) / log(4 / 3D)) as lx", "floor(log(4 + id % 5) / log(4 / 3D)) as ly")
    assert 200 * 9 < layout.looked_into(boxes, 0.75, math.log(4 / 3)).count() < 200 * 40
