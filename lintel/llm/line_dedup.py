"""Line dedup by pairwise alignment: shared blocks link overlapping documents, patience diff aligns them.

Equal texts are one text first: a later copy is one common block with the first and loses all its lines. Over
different texts the result is that of aligning each text with every earlier text (by first doc_id, then text).

Links go by units: for each line, the shortest stretch that ends at it, and the shortest that begins at it, and
is large enough to be removed. Each line of a removable block lies in such a unit within the block, so texts without a
common unit have nothing to remove, and a line outside all shared units stays. A text is linked to the first text that
has each of its units and not to all of them: links grow with lines and not with the square of a unit's texts. No
link is left out, unless the caller bounds them by rare and few.

Each linked pair is aligned with patience diff over line hashes: lines unique in both, longest increasing subsequence,
recursion between, and matching ends. Aligned blocks of LEAST_LINES lines or LEAST_CHARS characters leave the later
document (larger doc_id). Blocks as large that both have and no alignment in order can pair, moved across a
longer passage or repeated, are aligned by patience diff once more, each stretch that holds a common unit with its first place in the
earlier text. Nothing leaves that was not aligned. Thus a unit leaves whichever earlier text holds it, and one link for each unit
gives what all pairs give. Pairs carry line hashes and lengths and no texts. A unit that very many texts have, and a text that
very many are linked to, goes to their rows by broadcast, up to a size that is checked; those rows never gather on it.

Lines end at a newline; space at the ends of a line does not count; blank lines link nothing and never count for a
block's size. Line equality is by 64-bit hash and length.

Defined cases: a null or empty text has no lines; null doc_id counts as the largest; rows that repeat a doc_id and text are
copies of which the row of the group's first doc_id stays whole; a very long text is one row of line hashes and is aligned whole; an
empty table gives no rows; other columns are not read.
"""

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm import hot
from lintel.llm.storage import checkpointed
from lintel.llm.text import mixed, passes, span_hashes

LEAST_LINES, LEAST_CHARS = 2, 40
#: Bytes of text, or of line hashes, that a task takes out of an Arrow batch at a time.
HELD_BYTES = 1 << 20
LAST_ID = (1 << 63) - 1
#: Line hashes of texts with very many links that are broadcast (32 MB).
BROADCAST_LINES = 4_000_000


def patience(one: list, two: list) -> list[tuple[int, int]]:
    """Aligned (place in one, place in two) of equal items, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(one), 0, len(two))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and one[a] == two[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and one[b - 1] == two[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        counts = Counter(one[a:b])
        once = {x: i for i, x in enumerate(one[a:b], a) if counts[x] == 1}
        counts = Counter(two[c:d])
        pairs = [(once[x], j) for j, x in enumerate(two[c:d], c) if counts[x] == 1 and x in once]
        chain = _increasing(pairs)
        if not chain:
            continue
        edges = [(a - 1, c - 1), *chain, (b, d)]
        out += chain
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence whose first parts increase."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (x, _) in enumerate(pairs):
        k = bisect_left(tops, x)
        back[i] = ends[k - 1] if k else -1
        tops[k : k + 1], ends[k : k + 1] = [x], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def units(lines: np.ndarray, chars: np.ndarray, least_lines: int, least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end (exclusive) of a text's units: from each line, forwards and backwards, the least that may be removed."""
    solid = np.flatnonzero(chars > 0)
    m, k, at = len(solid), np.arange(len(solid)), np.arange(len(lines))
    total = np.concatenate([[0], np.cumsum(chars[solid], dtype=np.int64)])
    last = np.minimum(k + least_lines - 1, np.searchsorted(total, total[:-1] + least_chars) - 1)
    first = np.maximum(k - least_lines + 1, np.searchsorted(total, total[1:] - least_chars, "right") - 1)
    after, before = np.searchsorted(solid, at), np.searchsorted(solid, at, "right") - 1
    ahead = at[after < m]
    ahead = ahead[last[after[ahead]] < m]
    behind = at[before >= 0]
    behind = behind[first[before[behind]] >= 0]
    begins = np.concatenate([ahead, solid[first[before[behind]]]])
    ends = np.concatenate([solid[last[after[ahead]]], behind]) + 1
    return span_hashes(lines.view(np.uint64), begins, ends).view(np.int64), begins, ends


def common_lines(earlier: list, later: list, chars: list[int], least_lines: int, least_chars: int) -> list[int]:
    """Places in the later document of the common blocks, aligned or moved, that are large enough; chars: its lines' lengths."""
    out, block = [], []
    for i, j in [*patience(earlier, later), (-9, -9)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            places = [q for _, q in block]
            if sum(chars[q] > 0 for q in places) >= least_lines or sum(chars[q] for q in places) >= least_chars:
                out += places
            block = []
        block.append((i, j))
    if len(out) == len(later):
        return out
    # Blocks that both have and no alignment in order pairs: each stretch that holds a common unit is aligned with its first place in
    # the earlier text. Lines of that text that the later one lacks are in no common unit, whatever their length.
    codes: dict = {}
    own = mixed(np.array([codes.setdefault(x, len(codes)) for x in later], np.uint64))
    size = dict(zip(later, chars))
    other = mixed(np.array([codes.get(x, len(codes)) for x in earlier], np.uint64))
    hashes, begins, ends = units(own, np.array(chars), least_lines, least_chars)
    known, places, _ = units(other, np.array([size.get(x, 1) for x in earlier]), least_lines, least_chars)
    order = np.lexsort((places, known))
    known, places = known[order], places[order]
    at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
    met = np.flatnonzero(known[at] == hashes) if len(known) else np.zeros(0, np.int64)
    begins, ends, moved = begins[met], ends[met], places[at[met]] - begins[met]
    gone = np.zeros(len(later), bool)
    gone[out] = True
    stretches: list[list[int]] = []
    for k in np.lexsort((begins, moved)):
        lo, hi, by = int(begins[k]), int(ends[k]), int(moved[k])
        if stretches and stretches[-1][2] == by and stretches[-1][1] >= lo:
            stretches[-1][1] = max(stretches[-1][1], hi)
        else:
            stretches.append([lo, hi, by])
    for lo, hi, by in stretches:
        if not gone[lo:hi].all():
            gone[[lo + j for _, j in patience(earlier[lo + by : hi + by], later[lo:hi])]] = True
    return np.flatnonzero(gone).tolist()


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the bounds of its rows in them; null counts as empty."""
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), bounds


def _with_units(least_lines: int, least_chars: int, held_bytes: int):
    """The different units of each text."""

    def batches(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in items:
            for batch in _slices(whole, pc.multiply(pc.list_value_length(whole.column("lines")), 8), held_bytes):
                (lines, bounds), (chars, _) = _numbers(batch.column("lines")), _numbers(batch.column("chars"))
                found = [np.unique(units(lines[lo:hi], chars[lo:hi], least_lines, least_chars)[0]) for lo, hi in zip(bounds, bounds[1:])]
                row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([batch.column("text_no").take(row), batch.column("first_id").take(row), pa.array(np.concatenate(found))], ["text_no", "first_id", "unit"])

    return batches


def _slices(batch: pa.RecordBatch, sizes: pa.Array, held_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about held_bytes, of one row at least; sizes: bytes of each row."""
    bounds = np.concatenate([[0], np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False))])
    for lo, hi in passes(bounds, held_bytes):
        yield batch.slice(lo, hi - lo)


def _aligned(least_lines: int, least_chars: int, held_bytes: int):
    def batches(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in items:
            lines = pc.add(pc.list_value_length(whole.column("earlier")), pc.list_value_length(whole.column("later")))
            for batch in _slices(whole, pc.multiply(lines, 8), held_bytes):
                columns = [batch.column(c).to_pylist() for c in ("text_no", "earlier", "later", "chars")]
                found = [common_lines(e, x, n, least_lines, least_chars) for _, e, x, n in zip(*columns)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(found, pa.list_(pa.int32()))], ["text_no", "gone"])

    return batches


def _lines(text):
    return F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))


def _kept(with_text: bool, held_bytes: int):
    def batches(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_ in items:
            for batch in _slices(all_, pc.binary_length(all_.column("text")), held_bytes):
                kept, shas, lines, removed = [], [], [], []
                for text, whole, gone in zip(*(batch.column(c).to_pylist() for c in ("text", "whole", "gone"))):
                    own = text.split("\n") if text else []
                    away = set(range(len(own))) if whole else set(gone or ())
                    left = "\n".join(x for i, x in enumerate(own) if i not in away)
                    kept.append(left if with_text else None)
                    shas.append(hashlib.sha256(left.encode()).hexdigest())
                    lines.append(len(own))
                    removed.append(len(away))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(shas, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_text", "kept_sha256"])

    return batches


def _light(links: DataFrame, key: str, texts: DataFrame) -> DataFrame | None:
    """The texts that have very many links on this side, if their lines may be broadcast."""
    held = hot.hot_keys(links, key)
    if held is None:
        return None
    lines = texts.join(F.broadcast(held.select(F.col(key).alias("text_no"))), "text_no", "left_semi").agg(F.sum(F.size("lines"))).first()[0]
    return held if lines <= BROADCAST_LINES else None


def line_dedup(docs: DataFrame, rare: int | None = None, few: int | None = None, least_lines: int = LEAST_LINES, least_chars: int = LEAST_CHARS, with_text: bool = True, held_bytes: int = HELD_BYTES) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text (null unless with_text) and kept_sha256 for every row of docs (doc_id, text).

    Only a caller that gives rare or few bounds the links: to units that at most rare texts have, and the few rarest of a text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("text_no", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    order = F.coalesce(F.col("doc_id"), F.lit(LAST_ID))
    clean = _lines(F.col("text"))
    hashed = rows.where("text <> ''").select("text_no", order.alias("first_id"), F.transform(clean, lambda x: F.xxhash64(x)).alias("lines"), F.transform(clean, lambda x: F.length(x)).alias("chars"))
    texts = checkpointed(hashed.groupBy("text_no").agg(F.min("first_id").alias("first_id"), F.first("lines").alias("lines"), F.first("chars").alias("chars")))

    own_units = checkpointed(texts.mapInArrow(_with_units(least_lines, least_chars, held_bytes), "text_no binary, first_id long, unit long"))
    owners = checkpointed(own_units.groupBy("unit").agg(F.count("*").alias("n"), F.min(F.struct("first_id", "text_no")).alias("owner")).where("n > 1"))
    met = hot.looked_up(own_units, "unit", owners, hot.hottest(owners, "unit"))
    met = met.where("text_no <> owner.text_no").select("text_no", "n", F.col("owner.text_no").alias("other"))
    links = met.groupBy("text_no", "other").agg(F.min("n").alias("n"))
    if rare is not None or few is not None:
        rank = F.row_number().over(Window.partitionBy("text_no").orderBy("n", "other"))
        links = links.withColumn("rank", rank).where((F.col("n") <= (rare or 0)) | (F.col("rank") <= (few or 0)))

    earlier = texts.select(F.col("text_no").alias("other"), F.col("lines").alias("earlier"))
    links = checkpointed(links.select("text_no", "other"))
    pairs = hot.looked_up(links, "text_no", texts.select("text_no", F.col("lines").alias("later"), "chars"), _light(links, "text_no", texts))
    pairs = hot.looked_up(pairs, "other", earlier, _light(links, "other", texts))
    aligned = pairs.select("text_no", "earlier", "later", "chars").mapInArrow(_aligned(least_lines, least_chars, held_bytes), "text_no binary, gone array<int>")
    gone = aligned.where("size(gone) > 0").groupBy("text_no").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))

    verdict = texts.select("text_no", "first_id").join(gone, "text_no", "left")
    whole = F.col("first_id").isNotNull() & (order > F.col("first_id"))
    out = rows.join(verdict, "text_no", "left").select("doc_id", "text", whole.alias("whole"), "gone")
    return out.mapInArrow(_kept(with_text, held_bytes), "doc_id long, n_lines long, n_removed long, kept_text string, kept_sha256 string")
