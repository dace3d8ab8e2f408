"""Benchmark decontamination on a distributed positional inverted index.

The index is dealt by document: each segment holds some MB of whole documents, with an exact term dictionary and, for
every term, the ordered positions of its postings (delta coded). Segments are rows of a Parquet table in the shared
folder; building them needs no shuffle, and no term's postings gather in one task however common it is. Row groups hold a few
segments each, so neither writing nor reading holds more of them at once, however large a task's split is.

A benchmark item's windows are looked up segment by segment. A window with a term that the segment lacks is dropped
at once; for the rest, the positions of its rarest term, less its offset, are intersected with those of the next
rarest, and so on, until none is left or all terms agree. What remains are exact phrase matches; with a slop, a
term may stand up to that many words from its place (proximity matches). A document lies within one segment, so its
result is complete there.

The benchmark is the stated query set. It is read in blocks of BLOCK_BYTES (or of one item, where that is longer). A
block's texts go over the whole index, and its result is written before the next block is read: the driver holds one block's
texts and no windows, which each Python worker makes for itself. Results of the blocks are merged for each document, and
the index is deleted once they are written.

Defined cases: null or empty texts have no words and no hits; items with no words have no windows; a null item_id is
the empty string in the digest; rows that repeat an id are rows of their own; a null doc_id is kept as null; other
columns are not read; a very long text is a segment of its own; an empty table gives no rows, an empty benchmark no hits.
"""

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.storage import remove_table, write_table, written
from lintel.llm.text import slices, utf8, word_bounds, word_codes

WINDOW, SLOP = 10, 2
#: Text of a segment, and of a block of the benchmark.
SEGMENT_BYTES, BLOCK_BYTES = 4 << 20, 4 << 20
#: The index's row groups. A reader holds all rows of a row group at once, and segments are large rows: they are measured at each
#: row. Otherwise Parquet's writer first looks after 100 rows, and after a small one takes those that follow for as small.
ROW_GROUPS = {"parquet.block.size": str(8 << 20)} | {f"parquet.{x}.size.row.check.{end}": "1" for x in ("block", "page") for end in ("min", "max")}

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text.
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_INDEX = "doc_ids array<long>, first_words array<long>, terms binary, counts binary, positions binary"
_FOUND = "segment long, place int, doc_id long, n_words long, items array<string>, near_items array<string>, begins array<int>, ends array<int>"


def _segments(segment_bytes: int):
    def batches(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items:
            for lo, hi in slices(batch.column("text"), segment_bytes):
                piece, at = utf8(batch.column("text").slice(lo, hi - lo))
                piece = _FOLD[piece]
                starts, ends, first = word_bounds(piece, at, _TERM)
                codes, terms = word_codes(piece, starts, ends, _TERM)
                positions = np.argsort(codes, kind="stable").astype(np.int32)
                counts = np.bincount(codes, minlength=len(terms)).astype(np.int32)
                row = [[batch.column("doc_id")[lo:hi].to_pylist()], [first.tolist()], [b" ".join(terms)], [counts.tobytes()], [np.diff(positions, prepend=np.int32(0)).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()))], ["doc_ids", "first_words", "terms", "counts", "positions"])

    return batches


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> str:
    """The path of the positional index of docs (doc_id, text), a table in the shared folder of one row for each segment."""
    built = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_segments(segment_bytes), _INDEX)
    return write_table(built.withColumn("segment", F.monotonically_increasing_id()), "postings", ROW_GROUPS)


def item_words(text: str | None) -> list[bytes]:
    """The words of one text, as the index has them."""
    data, bounds = utf8(pa.array([text], pa.string()))
    data = _FOLD[data]
    starts, ends, _ = word_bounds(data, bounds, _TERM)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


def item_windows(words: list[bytes], window: int) -> set[tuple[bytes, ...]]:
    """The different windows of an item; one shorter than the window, but not empty, is its own window."""
    return {tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()


def intersect(postings: list[np.ndarray], slop: int = 0) -> np.ndarray:
    """Starts at which every list, less its offset, has a position within slop; from the rarest list on."""
    order = sorted(range(len(postings)), key=lambda i: len(postings[i]))
    starts = postings[order[0]] - order[0]
    for i in order[1:]:
        if not len(starts):
            break
        shifted = postings[i] - i
        at = np.searchsorted(shifted, starts - slop)
        starts = starts[(at < len(shifted)) & (shifted[np.minimum(at, len(shifted) - 1)] <= starts + slop)]
    return starts


class _Lookup:
    """The windows of a block's items as rows of term codes, and the items that have each."""

    def __init__(self, items: tuple[tuple[str, str], ...], window: int):
        found: dict[tuple[bytes, ...], list[str]] = {}
        for item, text in items:
            for w in sorted(item_windows(item_words(text), window)):
                found.setdefault(w, []).append(item)
        self.terms = {t: i for i, t in enumerate(sorted({t for w in found for t in w}))}
        self.items = {tuple(self.terms[t] for t in w): x for w, x in found.items()}
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for w in self.items:
            by_length.setdefault(len(w), []).append(w)
        self.matrices = [np.array(x) for x in by_length.values()]


@lru_cache(1)
def _looked_up(items: tuple[tuple[str, str], ...], window: int) -> _Lookup:
    """A block's windows, made once in a Python worker."""
    return _Lookup(items, window)


def _search(items: tuple[tuple[str, str], ...], window: int, slop: int):
    """Looks the items' windows up in each segment; one row for each document."""

    def found(known_items: _Lookup, batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
        terms, shared, matrices = known_items.terms, known_items.items, known_items.matrices
        get = lambda name: batch.column(name)[k].as_py()
        first = np.array(get("first_words"), np.int64)
        own = get("terms")
        known = np.array([terms.get(t, -1) for t in own.split(b" ")] if own else [], np.int64)
        counts = np.frombuffer(get("counts"), np.int32).astype(np.int64)
        positions = np.cumsum(np.frombuffer(get("positions"), np.int32), dtype=np.int64)
        ends = np.cumsum(counts)
        lists: dict[int, np.ndarray] = {int(known[i]): positions[ends[i] - counts[i] : ends[i]] for i in np.flatnonzero(known >= 0)}
        present = np.zeros(len(terms), bool)
        present[list(lists)] = True
        rows = len(first) - 1
        hits, near, spans = [set() for _ in range(rows)], [set() for _ in range(rows)], [[] for _ in range(rows)]
        for matrix in matrices:
            for codes in map(tuple, matrix[present[matrix].all(axis=1)].tolist()):
                lists_ = [lists[t] for t in codes]
                close = intersect(lists_, slop)
                for exact, starts in ((False, close), (True, intersect(lists_) if len(close) else close)):
                    place = np.searchsorted(first, starts, "right") - 1
                    whole = (place >= 0) & (place < rows)
                    whole[whole] &= starts[whole] + len(codes) <= first[place[whole] + 1]
                    for p, s in zip(place[whole].tolist(), starts[whole].tolist()):
                        (hits if exact else near)[p].update(shared[codes])
                        if exact:
                            spans[p].append((s - int(first[p]), s - int(first[p]) + len(codes)))
        spans = [sorted(set(x)) for x in spans]
        columns = [[get("segment")] * rows, range(rows), get("doc_ids"), np.diff(first).tolist(), [sorted(x) for x in hits], [sorted(x) for x in near], [[b for b, _ in x] for x in spans], [[e for _, e in x] for x in spans]]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds)], ["segment", "place", "doc_id", "n_words", "items", "near_items", "begins", "ends"])

    def batches(segments: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_items = _looked_up(items, window)
        for batch in segments:
            for k in range(batch.num_rows):
                yield found(known_items, batch, k)

    return batches


def find_items(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Matches of benchmark (item_id, text) in the index, one row for each document.

    doc_id, n_words, items (those with an exact window), near_items (those with one within slop words),
    begins and ends (words of exact windows, ends exclusive).
    """
    queries = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = queries.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = int(total // block_bytes + 1)
    queries = queries.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    parts = []
    for block in range(blocks):
        items = tuple((r.item_id, r.text) for r in queries.where(F.col("block") == block).orderBy("item_id", "text").collect())
        parts.append(written(index.mapInArrow(_search(items, window, slop), _FOUND), "found"))
    if blocks == 1:
        return parts[0].drop("segment", "place")
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    spans = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("begins", "ends")))))
    rows = reduce(DataFrame.unionByName, parts).groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), merged("items"), merged("near_items"), spans.alias("spans"))
    return rows.select("doc_id", "n_words", "items", "near_items", F.col("spans.begins").alias("begins"), F.col("spans.ends").alias("ends"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items, items and spans of every document."""
    spark = docs.sparkSession
    path = build_index(docs)
    found = find_items(spark.read.parquet(path), benchmark, window, slop)
    remove_table(spark, path)
    # Spans are in order of begin: each adds what lies beyond the end of those before it.
    covered = F.aggregate(
        F.arrays_zip("begins", "ends"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["ends"] - F.greatest(x["begins"], a["end"]))).alias("n"), F.greatest(a["end"], x["ends"]).alias("end")),
        lambda a: a["n"].cast("long"),
    )
    rows = found.withColumn("n_hit", covered)
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"), "items", "begins", "ends",
    )
