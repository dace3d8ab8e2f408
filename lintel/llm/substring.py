"""Exact substring dedup over word windows, by super-k-mer partitioning.

Each document's windows of ``window`` words are cut into super-k-mers: runs of consecutive windows that share
one minimiser (the smallest hash of ``mer`` consecutive words in the window that have MER_BYTES bytes together). A window without any so long
is one of short words, which are frequent in every text: its minimiser is the smallest hash of twice as many words, so that
it does not gather with all others that have three such words. A run travels as one packed string
to the bucket of its minimiser, where all windows that could be equal meet; the bucket sorts them and compares
neighbours word by word, so counts are exact and not hash-based.

The plan has three exchanges: documents into chunks by hash of doc_id and text (reused for the last step), packed
strings into buckets, verdicts back to chunks. Within a chunk equal packed strings travel once, with the
smallest and largest doc_id that hold them, so a passage shared by a third of all documents reaches its bucket
once a chunk and not once a document. Chunks and buckets grow in number with the bytes of text, not in size.

Defined cases: a null or empty text has no words and nothing removed; a null doc_id counts as the largest; rows
that repeat a doc_id do not remove from one another (no smaller doc_id); a very long text is a chunk's like any other; an empty table gives no
rows; columns of the input other than doc_id and text are not read, so their names cannot clash.
"""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.text import SOLID, SPACE, mixed, passes, span_hashes, utf8, word_bounds, word_codes, word_hashes

WINDOW = 13
#: Words of the minimiser, and the bytes that they must have together.
MER, MER_BYTES = 3, 18
#: Text bytes of a chunk and packed bytes of a bucket.
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
#: Packed bytes for each byte of text, about.
PACKED = 3

LAST_ID = np.iinfo(np.int64).max
_BLANKED = np.where(SPACE, 0x20, np.arange(256)).astype(np.uint8)
_PACKED_SCHEMA = "bucket long, chunk long, slots binary, strings binary, lows binary, highs binary"
_VERDICT_SCHEMA = "chunk long, slots binary, offsets binary, lengths binary, lows binary"
_RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def _shrunk(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def _grown(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


class _Chunk:
    """The documents of one chunk in a fixed order, and their super-k-mers."""

    def __init__(self, table: pa.Table, window: int, mer: int):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.doc_id = table.column("doc_id")
        ids = self.doc_id.fill_null(LAST_ID).to_numpy()
        data, bounds = utf8(table.column("text"))
        self.raw = _BLANKED[data].tobytes()
        parts = []
        for lo, hi in passes(bounds):
            piece, at = data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
            starts, ends, first = word_bounds(piece, at, SOLID)
            parts.append((starts + bounds[lo], ends + bounds[lo], np.diff(first), word_hashes(piece, starts, ends)))
        self.starts, self.ends, self.n_words, hashes = (np.concatenate(x) for x in zip(*parts))
        self.row = np.repeat(np.arange(len(ids)), self.n_words)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])
        n = len(self.starts) - window + 1
        at = np.flatnonzero(self.row[: max(n, 0)] == self.row[window - 1 :]) if n > 0 else np.zeros(0, np.int64)
        if not len(at):
            self.begin = self.count = self.slot = at
            self.strings, self.lows, self.highs, self.minimiser = [], at, at, np.zeros(0, np.uint64)
            return
        sums = np.concatenate([[0], np.cumsum(self.ends - self.starts)])

        def smallest(words: int, least: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Where the minimiser of each of these windows stands, and its hash: of so many words, those of least bytes first."""
            every = np.arange(len(hashes) - words + 1)
            short = (sums[every + words] - sums[every] < least).astype(np.uint64)
            mers = (span_hashes(hashes, every, every + words) >> np.uint64(1)) | (short << np.uint64(63))
            views = np.lib.stride_tricks.sliding_window_view(mers, window - words + 1)
            place = np.concatenate([views[at[i : i + 65536]].argmin(axis=1) for i in range(0, len(at), 65536)]) + at if len(at) else at
            return place, mers[place]

        pick, key = smallest(mer, MER_BYTES, at)
        plain = np.flatnonzero(key >> np.uint64(63))  # windows of short words only
        place, longer = smallest(min(2 * mer, window), 0, at[plain])
        pick[plain], key[plain] = place + len(hashes), mixed(longer)  # no place of the other kind
        cut = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
        self.begin, self.count = at[cut], np.diff(np.concatenate([cut, [len(at)]]))
        last = self.begin + self.count + window - 2
        owner = ids[self.row[self.begin]]
        slots: dict[bytes, int] = {}
        raw = self.raw
        self.slot = np.array([slots.setdefault(raw[s:e], len(slots)) for s, e in zip(self.starts[self.begin].tolist(), self.ends[last].tolist())])
        self.strings = list(slots)
        self.lows, self.highs = np.full(len(slots), LAST_ID), np.full(len(slots), np.iinfo(np.int64).min)
        np.minimum.at(self.lows, self.slot, owner)
        np.maximum.at(self.highs, self.slot, owner)
        self.minimiser = np.zeros(len(slots), np.uint64)
        self.minimiser[self.slot] = key[cut]


def _pack(buckets: int, window: int, mer: int):
    """A chunk's distinct super-k-mers, one row for each bucket that they go to."""

    def packed(table: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window, mer)
        bucket = (mixed(chunk.minimiser) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows = []
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            strings = zstandard.compress(b"\n".join([chunk.strings[i] for i in part.tolist()]), 3)
            rows.append((int(bucket[part[0]]), _shrunk(part.astype(np.int32)), strings, _shrunk(chunk.lows[part]), _shrunk(chunk.highs[part])))
        columns = list(zip(*rows)) or [[], [], [], [], []]
        chunks = pa.array([table.column("chunk")[0].as_py()] * len(rows), pa.int64())
        return pa.table({"bucket": pa.array(columns[0], pa.int64()), "chunk": chunks, **{k: pa.array(v, pa.binary()) for k, v in zip(("slots", "strings", "lows", "highs"), columns[1:])}})

    return packed


def _repeats(texts: list[bytes], lows: np.ndarray, highs: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows whose words also start in a smaller doc_id: string, offset, length, smallest doc_id."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.flatnonzero(data == 0x0A) + 1, [len(data)]])
    starts, ends, first = word_bounds(data, bounds, SOLID)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    codes, words = word_codes(data, starts, ends, SOLID)
    at = np.flatnonzero(row[: len(row) - window + 1] == row[window - 1 :])
    values = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 64, len(words), dtype=np.uint64)[codes]
    keys = span_hashes(values, at, at + window)
    order = np.argsort(keys, kind="stable")

    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    fresh = np.ones(len(order), bool)
    fresh[same + 1] = False
    if _unlike(codes, at[order], same, window).any():  # two sequences share a hash: sort by the words themselves
        order = np.lexsort([codes[at + k] for k in range(window)][::-1])
        fresh[1:] = _unlike(codes, at[order], np.arange(len(order) - 1), window)
    groups = np.flatnonzero(fresh)
    low = np.minimum.reduceat(lows[row[at[order]]], groups)
    size = np.diff(np.concatenate([groups, [len(order)]]))
    smallest = np.empty(len(order), np.int64)
    smallest[order] = np.repeat(low, size)
    hit = np.flatnonzero(highs[row[at]] > smallest)
    if not len(hit):
        return (hit,) * 4
    where, least = at[hit], smallest[hit]
    new = np.concatenate([[True], (where[1:] != where[:-1] + 1) | (least[1:] != least[:-1]) | (row[where[1:]] != row[where[:-1]])])
    begin = np.flatnonzero(new)
    length = np.diff(np.concatenate([begin, [len(hit)]]))
    return row[where[begin]], where[begin] - first[row[where[begin]]], length, least[begin]


def _unlike(codes: np.ndarray, windows: np.ndarray, which: np.ndarray, window: int) -> np.ndarray:
    """Whether these windows differ from the ones after them in any word."""
    one, two = windows[which], windows[which + 1]
    differ = np.zeros(len(which), bool)
    for k in range(window):
        differ |= codes[one + k] != codes[two + k]
    return differ


def _count(window: int):
    """A bucket's verdicts: one row for each chunk that has windows to remove."""

    def counted(table: pa.Table) -> pa.Table:
        texts = [zstandard.decompress(x) for x in table.column("strings").to_pylist()]
        slots = [_grown(x, np.int32) for x in table.column("slots").to_pylist()]
        lows, highs = (np.concatenate([_grown(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("lows", "highs"))
        source = np.repeat(np.arange(len(slots)), [len(x) for x in slots])
        string, offset, length, least = _repeats(texts, lows, highs, window)
        from_slot, chunks, rows = np.concatenate(slots), table.column("chunk").to_pylist(), []
        cuts = np.searchsorted(source[string], np.arange(len(chunks) + 1))
        for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
            if lo < hi:
                rows.append((chunks[i], _shrunk(from_slot[string[lo:hi]]), _shrunk(offset[lo:hi].astype(np.uint8)), _shrunk(length[lo:hi].astype(np.uint8)), _shrunk(least[lo:hi])))
        columns = list(zip(*rows)) or [[], [], [], [], []]
        return pa.table({"chunk": pa.array(columns[0], pa.int64()), **{k: pa.array(v, pa.binary()) for k, v in zip(("slots", "offsets", "lengths", "lows"), columns[1:])}})

    return counted


def _remove(window: int, mer: int, with_text: bool):
    """A chunk's documents without the words that its verdicts cover."""

    def removed(table: pa.Table, verdicts: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string()), "kept_sha256": pa.array([], pa.string())})
        chunk = _Chunk(table, window, mer)
        ids = chunk.doc_id.fill_null(LAST_ID).to_numpy()
        edge = np.zeros(len(chunk.starts) + 1, np.int64)
        if verdicts.num_rows:
            slot, offset, length, least = (np.concatenate([_grown(x, kind) for x in verdicts.column(c).to_pylist()]) for c, kind in (("slots", np.int32), ("offsets", np.uint8), ("lengths", np.uint8), ("lows", np.int64)))
            order = np.argsort(slot, kind="stable")
            lo, hi = (np.searchsorted(slot[order], chunk.slot, side) for side in ("left", "right"))
            run = np.repeat(np.arange(len(chunk.slot)), hi - lo)
            entry = order[np.arange(len(run)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
            begin = chunk.begin[run] + offset[entry]
            later = ids[chunk.row[begin]] > least[entry]
            begin, end = begin[later], (begin + length[entry] + (window - 1))[later]
            np.add.at(edge, begin, 1)
            np.add.at(edge, end, -1)
        gone = np.cumsum(edge[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        n_removed = before[chunk.first[1:]] - before[chunk.first[:-1]]
        shas, kept = [], []
        raw, starts, ends = chunk.raw, chunk.starts, chunk.ends
        for lo, hi, n in zip(chunk.first[:-1].tolist(), chunk.first[1:].tolist(), n_removed.tolist()):
            if n == hi - lo:
                text = b""
            elif not n:
                text = b" ".join(raw[starts[lo] : ends[hi - 1]].split())
            else:
                left = np.flatnonzero(~gone[lo:hi]) + lo
                text = b" ".join([raw[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist())])
            shas.append(hashlib.sha256(text).hexdigest())
            kept.append(text.decode() if with_text else None)
        return pa.table({"doc_id": chunk.doc_id, "n_words": pa.array(chunk.n_words.astype(np.int64)), "n_removed": pa.array(n_removed.astype(np.int64)), "kept_text": pa.array(kept, pa.string()), "kept_sha256": pa.array(shas, pa.string())})

    return removed


def substring_dedup(docs: DataFrame, window: int = WINDOW, mer: int = MER, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, with_text: bool = True) -> DataFrame:
    """Removes each word that a window covers whose word sequence also starts in a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_text (null unless with_text) and kept_sha256, one row per row of docs.
    """
    if not 1 <= mer <= window <= 200:
        raise ValueError("mer must be from 1 to window, window to 200")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(2 * partitions, total // chunk_bytes + 1)
    buckets = max(2 * partitions, PACKED * total // bucket_bytes + 1)
    chunked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"))
    packed = chunked.groupBy("chunk").applyInArrow(_pack(buckets, window, mer), _PACKED_SCHEMA)
    verdicts = packed.groupBy("bucket").applyInArrow(_count(window), _VERDICT_SCHEMA)
    return chunked.groupBy("chunk").cogroup(verdicts.groupBy("chunk")).applyInArrow(_remove(window, mer, with_text), _RESULT_SCHEMA)
