"""Spelling variant grouping: near words by two-dimensional range reporting over wavelet trees.

Words are counted over whole texts, pre-aggregated in each task. Two words are near if one inserted, deleted or replaced code point
makes one the other. For an edit position i, the words that share the i code points before it are an interval of the forward
order, those that share what comes after it are an interval of the reverse order; a wavelet tree over the reverse ranks in
forward order reports the words in both. Words of one length are targets; those of the same length ask for replacements, those one
shorter for insertions, which are deletions seen from the other side.

The orders are dealt out: positions [a, b) of a length are a shape, and words that agree outside [a, b) are a bucket, which holds all
answers for edits at these positions. Each word starts with two shapes (the halves). Buckets over a limit are halved again,
by their words only, until they are small or [a, b) is one position, where a bucket has at most one word for each character and the one
word without it. So no bucket grows with the data, and no pair is lost. Buckets of one shape are searched many at a time.

A pair is reported once: a replacement has one position, an insertion counts at the first of equal characters. Each task adds up a
word's near words and keeps the best before anything is shuffled. Forms point to words at least twice as frequent, so roots
follow by pointer jumping in a few rounds; pointers to hot words go by broadcast.

Defined cases: null and empty texts have no words; a null doc_id counts as the empty string in the hash; rows that repeat count
again; a very long text is read in stretches cut between words; an empty table gives no rows; other columns are not read.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.hot import hot_keys, looked_up
from lintel.llm.storage import checkpointed

LETTERS = r"A-Za-zÀ-ÿ"
#: Code points and occurrences of a word, at least; from which multiple of a word's count a near word is its form.
LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 5, 3, 2
#: One occurrence in so many, by hash, loses a code point.
DELETE_EACH = 97

#: Words a bucket may hold before its positions are halved; buckets' keys that may be broadcast; rows and bytes searched at a time.
BUCKET_WORDS, BROADCAST_KEYS, CHUNK_ROWS, CHUNK_BYTES = 4096, 1_000_000, 1 << 16, 8 << 20
#: Code points of a text looked at together; different words a task holds before it hands them on; questions asked of a tree together.
STRETCH, HELD_WORDS, QUESTIONS = 1 << 20, 200_000, 1 << 14

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_SHAPE = ["length", "a", "b", "key"]


def _stretches(text: str) -> Iterator[str]:
    """The text in stretches that end between words."""
    if len(text) <= STRETCH:
        yield text
        return
    gap, at = re.compile(f"[^{LETTERS}]"), 0
    while at < len(text):
        found = gap.search(text, at + STRETCH)
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each task's texts, a word perhaps more than once."""
    runs = re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}")
    held: Counter = Counter()

    def handed() -> pa.RecordBatch:
        out = pa.record_batch({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
        held.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            begin = zlib.crc32(f"{'' if not doc_id.is_valid else doc_id.as_py()}:".encode())
            for stretch in _stretches(text.as_py() or ""):
                for run, n in Counter(runs.findall(stretch)).items():
                    word = run.lower() if run.isascii() else run.translate(_LOWER)
                    h = zlib.crc32(word.encode(), begin)
                    if h % DELETE_EACH == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                    held[word] += n
                if len(held) >= HELD_WORDS:
                    yield handed()
    if held:
        yield handed()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that occur often enough in docs (doc_id, text)."""
    counted = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_partial_counts, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _keyed(rows: DataFrame) -> DataFrame:
    """With the bucket's key: what stands before a and from b on in the target. A word that asks for an insertion lacks one code point in between."""
    before = F.substring("word", F.lit(1), F.col("a"))
    after = F.substring("word", F.col("b") + F.when(F.col("target"), 1).otherwise(0), F.length("word"))
    return rows.withColumn("key", F.xxhash64(before, after))


def _halves(length: Column, a: Column, b: Column) -> Column:
    half = F.floor((a + b) / 2).cast("int")
    return F.array(F.struct(length.alias("length"), a.alias("a"), half.alias("b")), F.struct(length.alias("length"), half.alias("a"), b.alias("b")))


def _entries(words: DataFrame) -> DataFrame:
    """(word, n, target, length, a, b, key): every word in every bucket it belongs to."""
    each = words.select("word", "n", F.explode(F.array(F.lit(True), F.lit(False))).alias("target"))
    length = F.length("word") + F.when(F.col("target"), 0).otherwise(1)
    rows = _keyed(each.withColumn("shape", F.explode(_halves(length, F.lit(0), length))).select("word", "n", "target", "shape.*"))
    done = None
    while True:
        large = (F.count("*") > BUCKET_WORDS) & (F.col("b") - F.col("a") > 1)
        hot = checkpointed(rows.groupBy(_SHAPE).agg(large.alias("large")).where("large").select(_SHAPE))
        n_hot = hot.count()
        if not n_hot:
            return rows if done is None else done.unionByName(rows)
        known = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
        small = rows.join(known, _SHAPE, "left_anti")
        done = small if done is None else done.unionByName(small)
        split = rows.join(known, _SHAPE, "left_semi").withColumn("shape", F.explode(_halves(F.col("length"), F.col("a"), F.col("b"))))
        rows = _keyed(split.select("word", "n", "target", "shape.*"))


def wavelet_tree(sequence: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Per bit, the highest first: how many zeros stand before each place, and how many there are."""
    levels = []
    for bit in range(max(1, int(len(sequence) - 1).bit_length()) - 1, -1, -1):
        one = (sequence >> bit) & 1
        zeros = np.zeros(len(sequence) + 1, np.int64)
        np.cumsum(1 - one, out=zeros[1:])
        levels.append((zeros, int(zeros[-1])))
        sequence = np.concatenate([sequence[one == 0], sequence[one == 1]])
    return levels


def report(tree: list[tuple[np.ndarray, int]], lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(question, value) of all values in [least, most) at places [lo, hi), for many questions at once."""
    asked, node = np.arange(len(lo)), np.zeros(len(lo), np.int64)
    for depth, (zeros, n_zeros) in enumerate(tree):
        bit = len(tree) - 1 - depth
        left, right = zeros[lo], zeros[hi]
        asked, node = np.concatenate([asked, asked]), np.concatenate([node * 2, node * 2 + 1])
        lo, hi = np.concatenate([left, lo - left + n_zeros]), np.concatenate([right, hi - right + n_zeros])
        kept = np.flatnonzero((lo < hi) & ((node + 1) << bit > least[asked]) & (node << bit < most[asked]))
        asked, node, lo, hi = asked[kept], node[kept], lo[kept], hi[kept]
    return asked, node


def _order(chars: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows sorted by bucket and characters, and how many characters each shares with the row before it (-1: another bucket)."""
    order = np.lexsort((np.ascontiguousarray(chars).view(f"S{chars.shape[1]}").ravel(), bucket))
    shared = np.full(len(order), -1, np.int64)
    differs = chars[order[1:]] != chars[order[:-1]]
    same = np.where(differs.any(axis=1), differs.argmax(axis=1), chars.shape[1])
    shared[1:] = np.where(bucket[order[1:]] == bucket[order[:-1]], same, -1)
    return order, shared


def _intervals(order: np.ndarray, shared: np.ndarray, target: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the ranks [from, to) among the targets that share its first characters, depth of them."""
    before = np.zeros(len(order) + 1, np.int64)
    np.cumsum(target[order], out=before[1:])
    starts = np.flatnonzero(shared < depth)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(shared < depth) - 1
    ends = np.append(starts[1:], len(order))
    return before[starts][group], before[ends][group]


def near_pairs(words: list[bytes], target: np.ndarray, bucket: np.ndarray, a: int, b: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, near row) within buckets for edits at positions [a, b) of targets of this length; both directions.

    Words are one byte for each code point; targets are of this length, the others one shorter.
    """
    chars = np.array(words, f"S{length}").view(np.uint8).reshape(len(words), length)
    backward = np.where(target[:, None], chars[:, ::-1], np.roll(chars[:, ::-1], -1, axis=1))
    forward_order, forward_shared = _order(chars, bucket)
    reverse_order, reverse_shared = _order(backward, bucket)
    by_forward, by_reverse = forward_order[target[forward_order]], reverse_order[target[reverse_order]]
    reverse_rank = np.empty(len(words), np.int64)
    reverse_rank[by_reverse] = np.arange(len(by_reverse))
    tree = wavelet_tree(reverse_rank[by_forward])
    sources, nears = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(a, b):
        lo, hi = _intervals(forward_order, forward_shared, target, i)
        least, most = _intervals(reverse_order, reverse_shared, target, length - 1 - i)
        asking = np.flatnonzero(np.minimum(hi - lo, most - least) > target)  # a target always meets itself
        for k in range(0, len(asking), QUESTIONS):
            some = asking[k : k + QUESTIONS]
            question, value = report(tree, lo[some], hi[some], least[some], most[some])
            source, near = some[question], by_reverse[value]
            first = (chars[near, i] != chars[near, i - 1]) if i else np.ones(len(near), bool)
            replaced, inserted = target[source] & (source != near), ~target[source] & first
            sources += [source[replaced], source[inserted], near[inserted]]
            nears += [near[replaced], near[inserted], source[inserted]]
    return np.concatenate(sources), np.concatenate(nears)


def _best(words: list[bytes], counts: np.ndarray, source: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    """(word, n_near, near_n, near): each word's near words counted, and the most frequent of them, the smallest of equals."""
    order = np.lexsort((np.array(words, object)[near] if len(near) else near, -counts[near], source))
    source, near = source[order], near[order]
    first = np.flatnonzero(np.diff(source, prepend=-1))
    said = lambda rows: pa.array([words[i].decode("latin-1") for i in rows], pa.string())
    return pa.record_batch({"word": said(source[first]), "n_near": np.diff(np.append(first, len(source))), "near_n": counts[near[first]], "near": said(near[first])})


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words within the buckets of a partition sorted by shape and key."""

    def searched(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key = rows.column("key").to_numpy()
        bucket = np.cumsum(np.diff(key, prepend=key[0]) != 0)
        target = rows.column("target").to_numpy()
        met = np.bincount(bucket)[bucket] > 1
        met &= np.bincount(bucket, target)[bucket] > 0
        kept = np.flatnonzero(met)
        if len(kept):
            words = [w.encode("latin-1") for w in rows.column("word").take(kept).to_pylist()]
            length, a, b = (rows.column(c)[0].as_py() for c in ("length", "a", "b"))
            found = near_pairs(words, target[kept], bucket[kept], a, b, length)
            if len(found[0]):
                yield _best(words, rows.column("n").to_numpy()[kept], *found)

    def cut(rows: pa.Table, last: bool) -> Iterator[pa.Table]:
        """Whole buckets of one shape, as many as are searched at a time; what is left over, unless it is the last, comes last."""
        size = rows.num_rows
        if not size:
            return
        fresh = np.zeros(size, bool)
        shape = np.zeros(size, bool)
        for c in _SHAPE:
            changed = np.diff(rows.column(c).to_numpy()) != 0
            fresh[1:] |= changed
            if c != "key":
                shape[1:] |= changed
        begins, shapes = np.flatnonzero(fresh), np.append(np.flatnonzero(shape), size)
        lengths, at = rows.column("length").to_numpy(), 0
        while at < size:
            end = shapes[np.searchsorted(shapes, at, "right")]
            limit = min(CHUNK_ROWS, max(1, CHUNK_BYTES // int(lengths[at])))
            if end - at > limit:  # up to the last bucket that begins within the limit, one at least
                k = np.searchsorted(begins, at + limit, "right") - 1
                end = begins[k] if k >= 0 and begins[k] > at else (begins[k + 1] if k + 1 < len(begins) else size)
            if end == size and not last:
                break
            yield rows.slice(at, int(end - at))
            at = int(end)
        if at < size:
            yield rows.slice(at)

    held, n_held = [], 0
    for batch in batches:
        held.append(batch)
        n_held += batch.num_rows
        if n_held >= CHUNK_ROWS:
            parts = list(cut(pa.Table.from_batches(held).combine_chunks(), False))
            for part in parts[:-1]:
                yield from searched(part.combine_chunks())
            held = parts[-1].to_batches()
            n_held = 0 if len(parts) > 1 else -CHUNK_ROWS  # what is left is not looked at again for each batch
    if held:
        for part in cut(pa.Table.from_batches(held).combine_chunks(), True):
            yield from searched(part.combine_chunks())


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) of the words of (word, n) that have near words: how many, and the most frequent one."""
    rows = _entries(words).repartition(*_SHAPE).sortWithinPartitions(*_SHAPE)
    found = rows.select(*_SHAPE, "target", "word", "n").mapInArrow(_search, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("near_n"), "best.near")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of (word, form) and their forms, by pointer jumping."""
    ends = forms.select(F.col("form").alias("word")).distinct().join(forms, "word", "left_anti").select("word", F.col("word").alias("root"))
    pointers = checkpointed(forms.select("word", F.col("form").alias("root")).unionByName(ends))
    while True:
        table = pointers.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = checkpointed(looked_up(pointers, "root", table, hot_keys(pointers, "root")))
        pointers = jumped.select("word", F.col("next").alias("root"))
        if jumped.where("root <> next").isEmpty():
            return pointers


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs (doc_id, text)."""
    words = checkpointed(vocabulary(docs))
    is_form = F.col("near_n") >= FORM_FACTOR * F.col("n")
    named = words.join(near_words(words), "word", "left").select("word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near_n")).alias("form_n"))
    named = checkpointed(named)
    roots = _roots(named.where("form IS NOT NULL").select("word", "form"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
