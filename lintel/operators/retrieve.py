"""Nearest vectors to stated queries: exactly, and by an index."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.plans.storage import settled

#: Queries that go over all vectors at once: a block travels with the tasks and bounds what the driver holds.
BLOCK = 4096
#: Queries that one numpy step compares with a batch of vectors.
STEP = 16


def _nearest(ids: np.ndarray, queries: np.ndarray, k: int):
    """The k nearest vectors of each batch to each query of a block."""

    def batches(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items:
            own = batch.column("vec_id").to_numpy(zero_copy_only=False)
            vectors = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False)) if len(own) else np.zeros((0, queries.shape[1]), queries.dtype)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lo in range(0, len(ids) if len(own) else 0, STEP):
                part = queries[lo : lo + STEP]
                distance = np.square((vectors[None] - part[:, None]).astype(np.float64)).sum(axis=2)
                distance[own[None] == ids[lo : lo + STEP, None]] = np.inf
                for i, row in enumerate(distance):
                    order = np.lexsort((own, row))[:k]
                    order = order[row[order] < np.inf]
                    found.append((np.full(len(order), ids[lo + i]), own[order], row[order]))
            columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "distance"])

    return batches


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """T5: the k nearest of vectors (vec_id, embedding) to each of queries (query_id, query) by squared distance, ties by id.

    Queries go in blocks of bounded size over all vectors, k rows a query leave each batch, and the best k of those stay. Where
    there is more than one block, each one's result is settled before the next block is read. A query is not its own neighbour.
    """
    blocks = 2 * queries.count() // BLOCK + 1  # hashed into twice as many as needed, so that none is over the bound
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        part = numbered.where(F.col("block") == block).select(F.col("query_id").cast("long"), "query").toArrow()
        if not part.num_rows:
            continue
        ids, rows = part.column("query_id").to_numpy(), np.stack(part.column("query").to_numpy())
        met = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_nearest(ids, rows, k), "query_id long, vec_id long, distance double")
        found = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
        found = settled(found) if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, distance double, rank int")


#: Vectors that centroids are fitted on at most, rounds of fitting, vectors of one cell that lie in one block.
SAMPLE, ROUNDS, CELL_BLOCK = 16_384, 8, 2048


def centroids(vectors: DataFrame, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """Centres of vectors (vec_id, embedding), fitted by k-means on a bounded sample: those of the smallest hashed ids."""
    part = vectors.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    points = np.stack(part.column("embedding").to_numpy()).astype(np.float64) if part.num_rows else np.zeros((0, 1))
    centres = np.unique(points, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(cells, len(centres))).astype(int)] if len(centres) else centres
    for _ in range(ROUNDS if len(centres) else 0):
        own = _to_centres(points, centres).argmin(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = points[own == c].mean(axis=0)
    return centres


def _to_centres(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.square(points).sum(axis=1)[:, None] - 2 * points @ centres.T + np.square(centres).sum(axis=1)[None]


def _celled(centres: np.ndarray, probes: int, columns: tuple[str, str]):
    """Each vector with its nearest cells, as many rows as probes."""
    key, vector = columns

    def batches(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items:
            if batch.num_rows and len(centres):
                distance = _to_centres(np.stack(batch.column(vector).to_numpy(zero_copy_only=False)).astype(np.float64), centres)
                n = min(probes, len(centres))
                near = np.argsort(distance, axis=1, kind="stable")[:, :n]
                rows = np.repeat(np.arange(batch.num_rows), n)
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows)), pa.array(near.ravel().astype(np.int32)), batch.column(vector).take(pa.array(rows))], [key, "cell", vector])

    return batches


def _ranked(k: int):
    """The k nearest vectors of a block to each of a block's queries, exactly."""

    def batches(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items:
            for ids, vectors, query_ids, queries in zip(*(batch.column(c).to_pylist() for c in ("ids", "vectors", "query_ids", "queries")), strict=True):
                own, points, asked = np.array(ids), np.array(vectors), np.array(query_ids)
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for i, query in enumerate(np.array(queries)):
                    distance = np.square(points - query).sum(axis=1)
                    order = np.lexsort((own, distance))[: k + 1]
                    order = order[own[order] != asked[i]][:k]
                    found.append((np.full(len(order), asked[i]), own[order], distance[order]))
                columns = [np.concatenate(x) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "distance"])

    return batches


def nearest_by_index(vectors: DataFrame, queries: DataFrame, k: int = 3, cells: int = 256, probes: int = 24) -> DataFrame:
    """T5 by an inverted file: like nearest(), but each query looks at the cells nearest to it alone; distances are exact.

    Centres are fitted on a bounded sample and go to the tasks; every vector is in the cell of its nearest centre. A cell's vectors
    lie in blocks of bounded size, by hash, so that a hot cell is many blocks; so do the queries of a cell. Blocks of one cell meet.
    A query's work is its probes' share of the vectors. What it finds grows with probes; all cells give the exact answer.
    """
    centres = centroids(vectors, cells)
    placed = settled(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_celled(centres, 1, ("vec_id", "embedding")), "vec_id long, cell int, embedding array<float>"))
    asked = settled(queries.select(F.col("query_id").cast("long"), "query").mapInArrow(_celled(centres, probes, ("query_id", "query")), "query_id long, cell int, query array<float>"))

    def blocks(rows: DataFrame, key: str, value: str, names: tuple[str, str]) -> DataFrame:
        sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / (CELL_BLOCK // 2)).cast("int").alias("blocks"))  # a row for each cell
        dealt = rows.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")))
        packed = dealt.groupBy("cell", "block").agg(F.collect_list(F.struct(key, value)).alias("held"))
        return packed.select("cell", F.col(f"held.{key}").alias(names[0]), F.col(f"held.{value}").alias(names[1]))

    pairs = blocks(placed, "vec_id", "embedding", ("ids", "vectors")).join(blocks(asked, "query_id", "query", ("query_ids", "queries")), "cell")
    met = pairs.select("ids", "vectors", "query_ids", "queries").mapInArrow(_ranked(k), "query_id long, vec_id long, distance double")
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
