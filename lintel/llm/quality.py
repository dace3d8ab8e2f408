"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pair term is computed in linear time as
half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). Words are hashed to WORD_SLOTS slots, weighted by their share of
the text. Each statistic of the text's structure, and n_chars against the text's length (metadata), is a
one-hot bucket. labels, lang, source and doc_id are no inputs.

The model is fitted by Adam on at most FIT_ROWS labelled rows, those with the smallest hash of doc_id among the rows
that are not held out; that bound is a parameter and does not grow with the data, so features of the sample may be
collected: 12 bytes for each different word of a sampled text, some MB as a rule, and hundreds of MB only if all FIT_ROWS of
them had thousands of different words. Scoring is one map over whole texts, with the model (a few MB at any input size) in the task.

Defined cases: a null or empty text is scored by its statistics, a very long one whole; a null quality label is no label; where an
id repeats in labels the largest label counts, where it repeats in the documents each row is scored by its own text; ties in the sample's
order go by doc_id and features; no labels or labels of one kind give the constant score of their
share (0.5 without any); an empty table gives no rows; other columns are not read, n_chars may be missing.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.text import SOLID, mixed, slices, utf8, word_bounds, word_hashes

FIT_ROWS, WORD_SLOTS, RANK = 4000, 1 << 14, 8
BINS, THRESHOLD, SEED = 16, 0.7, 7
#: Steps of the fit, as many for any number of rows.
STEPS, STEP, DECAY, BATCH = 400, 0.02, 1e-4, 128

_UPPER, _LOWER, _DIGIT, _WIDE, _MARK = (np.zeros(256, bool) for _ in range(5))
_UPPER[0x41:0x5B] = _LOWER[0x61:0x7B] = _DIGIT[0x30:0x3A] = _WIDE[0x80:] = True
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(c) for c in ".,;:'\"-()?"]] = True
_LINE = np.zeros(256, bool)
_LINE[0x0A] = True
#: Statistics, and the ends of the range that BINS buckets divide.
STATISTICS = {
    "log_words": (0, 10), "word_length": (0, 16), "upper": (0, 1), "digits": (0, 0.3), "marks": (0, 0.5), "odd_marks": (0, 0.4), "wide": (0, 0.6),
    "distinct": (0, 1), "top_word": (0, 0.5), "repeats": (0, 0.5), "words_a_line": (0, 60), "repeated_lines": (0, 1), "ends_marked": (0, 1), "long_words": (0, 0.5), "chars_given": (-1, 1),
}
SLOTS = WORD_SLOTS + len(STATISTICS) * BINS


def _shares(flags: np.ndarray, bounds: np.ndarray, whole: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(whole, 1)


def features(data: np.ndarray, bounds: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and value of the non-zero features of these texts; given: their n_chars, nan if unknown."""
    rows, size = len(bounds) - 1, np.diff(bounds)
    starts, ends, first = word_bounds(data, bounds, SOLID)
    n = np.diff(first)
    row = np.repeat(np.arange(rows), n)
    hashes = word_hashes(data, starts, ends)
    slot = (hashes % np.uint64(WORD_SLOTS)).astype(np.int64)
    pair, count = np.unique(row * WORD_SLOTS + slot, return_counts=True)
    word_row, word_slot = pair // WORD_SLOTS, pair % WORD_SLOTS
    letters = _shares(_UPPER[data] | _LOWER[data], bounds, 1)
    lengths = ends - starts
    top = np.zeros(rows)
    np.maximum.at(top, word_row, count / np.maximum(n[word_row], 1))
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])]) if len(hashes) else np.zeros(0, bool)
    line_starts, line_ends, first_line = word_bounds(data, bounds, ~_LINE)
    lines = np.diff(first_line)
    line_row = np.repeat(np.arange(rows), lines)
    line_keys = mixed(word_hashes(data, line_starts, line_ends) ^ mixed(line_row.astype(np.uint64)))
    _, at = np.unique(line_keys, return_index=True)
    different = np.bincount(line_row[at], minlength=rows)
    stats = np.stack([
        np.log1p(n), _shares(lengths, first, n), _shares(_UPPER[data], bounds, letters), _shares(_DIGIT[data], bounds, size), _shares(_MARK[data], bounds, size),
        _shares(_MARK[data] & ~_PLAIN[data], bounds, size), _shares(_WIDE[data], bounds, size), np.bincount(word_row, minlength=rows) / np.maximum(n, 1), top,
        _shares(again, first, n), n / np.maximum(lines, 1), 1 - different / np.maximum(lines, 1), _shares(_MARK[data[ends - 1]] if len(ends) else again, first, n),
        _shares(lengths > 14, first, n), np.nan_to_num(1 - size / np.maximum(given, 1), nan=-1.0),
    ], axis=1)
    low, high = np.array(list(STATISTICS.values()), float).T
    bucket = np.clip((stats - low) / (high - low) * BINS, 0, BINS - 1).astype(np.int64)
    stat_slot = WORD_SLOTS + np.arange(len(STATISTICS)) * BINS + bucket
    value = np.sqrt(count / np.maximum(n[word_row], 1))
    every = np.repeat(np.arange(rows), len(STATISTICS))
    all_row = np.concatenate([word_row, every])
    order = np.argsort(all_row, kind="stable")
    all_slot, all_value = np.concatenate([word_slot, stat_slot.ravel()]), np.concatenate([value, np.full(len(every), 1 / np.sqrt(len(STATISTICS)))])
    return all_row[order], all_slot[order], all_value[order]


class Machine:
    """w0, linear weights and factors of a factorisation machine."""

    def __init__(self, slots: int = SLOTS, rank: int = RANK, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bias, self.linear, self.factors = 0.0, np.zeros(slots), rng.normal(0, 0.05, (slots, rank))

    def margins(self, row: np.ndarray, slot: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """Scores before the sigmoid; features in order of row, each row with one feature at least."""
        at = np.searchsorted(row, np.arange(rows))
        own = self.factors[slot] * value[:, None]
        sums, squares = np.add.reduceat(own, at, axis=0), np.add.reduceat(own * own, at, axis=0)
        return self.bias + np.add.reduceat(self.linear[slot] * value, at) + 0.5 * (sums * sums - squares).sum(axis=1)

    def fit(self, row: np.ndarray, slot: np.ndarray, value: np.ndarray, labels: np.ndarray) -> "Machine":
        rng = np.random.Generator(np.random.PCG64(SEED))
        share = labels.mean()
        self.bias = float(np.log(share / (1 - share)))
        first = np.searchsorted(row, np.arange(len(labels) + 1))
        state = {k: (np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))) for k in ("linear", "factors")}
        batches: list[np.ndarray] = []
        for step in range(1, STEPS + 1):
            if not batches:
                order = rng.permutation(len(labels))
                batches = [np.sort(order[lo : lo + BATCH]) for lo in range(0, len(order), BATCH)]
            chosen = batches.pop()
            n = first[chosen + 1] - first[chosen]
            at = np.repeat(first[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            r, s, v = np.repeat(np.arange(len(chosen)), n), slot[at], value[at]
            own = self.factors[s] * v[:, None]
            sums = np.add.reduceat(own, np.cumsum(n) - n, axis=0)
            error = 1 / (1 + np.exp(-self.margins(r, s, v, len(chosen)))) - labels[chosen]
            self.bias -= STEP * float(error.mean())
            pull = (error / len(chosen))[r]
            used, inverse = np.unique(s, return_inverse=True)
            gradients = {"linear": np.bincount(inverse, pull * v), "factors": np.stack([np.bincount(inverse, pull * v * (sums[r, f] - own[:, f])) for f in range(self.factors.shape[1])], axis=1)}
            for k, g in gradients.items():
                w, (m, u) = getattr(self, k), state[k]
                g = g + DECAY * w[used]
                m[used] = 0.9 * m[used] + 0.1 * g
                u[used] = 0.99 * u[used] + 0.01 * g * g
                w[used] -= STEP * (m[used] / (1 - 0.9**step)) / (np.sqrt(u[used] / (1 - 0.99**step)) + 1e-8)
        return self


def held_out() -> Column:
    """Whether a doc_id is held out: crc32 of it as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _given(docs: DataFrame) -> Column:
    return (F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")).alias("given")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine | float:
    """The machine fitted to a bounded sample of labelled rows, or a constant where there is nothing to tell apart."""
    labelled = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # Twice as many labels as rows wanted, as some may have no document; ids alone decide which.
    chosen = labelled.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * fit_rows)
    sample = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _given(docs)).join(F.broadcast(chosen), "doc_id")
    weigh = sample.mapInArrow(_featured, "doc_id long, quality int, slots array<int>, parts array<double>")
    rows = weigh.orderBy(F.xxhash64("doc_id"), "doc_id", "slots").limit(fit_rows).toArrow()
    quality = rows.column("quality").to_numpy().astype(float)
    if not len(quality) or quality.min() == quality.max():
        return float(quality.mean()) if len(quality) else 0.5
    slots, parts = rows.column("slots").combine_chunks(), rows.column("parts").combine_chunks()
    row = np.repeat(np.arange(len(quality)), pc.list_value_length(slots).to_numpy())
    return Machine().fit(row, slots.flatten().to_numpy(), parts.flatten().to_numpy(), quality)


def _featured(batches):
    for batch in batches:
        given = batch.column("given").to_numpy(zero_copy_only=False)
        slots, parts = [], []
        for lo, hi in slices(batch.column("text")):
            row, slot, value = features(*utf8(batch.column("text").slice(lo, hi - lo)), given[lo:hi])
            cuts = np.searchsorted(row, np.arange(1, hi - lo))
            slots += np.split(slot.astype(np.int32), cuts)
            parts += np.split(value, cuts)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(slots, pa.list_(pa.int32())), pa.array(parts, pa.list_(pa.float64()))], ["doc_id", "quality", "slots", "parts"])


def scored(docs: DataFrame, model: Machine | float) -> DataFrame:
    """docs with the column quality_score, a double from 0 to 1."""

    @F.arrow_udf("double")
    def score(text: pa.Array, given: pa.Array) -> pa.Array:
        if not isinstance(model, Machine):
            return pa.array(np.full(len(text), model))
        given = given.to_numpy(zero_copy_only=False)
        out = [model.margins(*features(*utf8(text.slice(lo, hi - lo)), given[lo:hi]), hi - lo) for lo, hi in slices(text)]
        return pa.array(1 / (1 + np.exp(-np.concatenate(out))) if out else np.zeros(0))

    return docs.withColumn("quality_score", score(F.col("text").cast("string"), _given(docs)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text, and n_chars if there)."""
    rows = scored(docs.select("doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else [])), fit(docs, labels, fit_rows))
    return rows.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
