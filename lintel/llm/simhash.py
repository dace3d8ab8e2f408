"""SimHash fingerprints and near-duplicate components, pruned by pigeonring chains.

A fingerprint's 64 bits are a ring of 8 segments. If two fingerprints differ in at most ``distance`` bits, some
segment starts a chain in which the first l segments differ in at most floor(l * distance / 8) bits together, for
every l from 1 to 8 (the pigeonring principle). For distance 3 the budgets are 0, 0, 1, 1, 1, 2, 2, 3: the
first two segments are equal, and of the next three at least two are. Candidates therefore meet on
(start, choice of the two, four segments), 24 keys of 32 bits for a fingerprint; the full chain is checked
before the Hamming distance.

Exact copies are one fingerprint row before any pairing. Keys that one fingerprint alone has go before the pair
stage; a key with very many fingerprints is dealt to blocks of them, and each pair of blocks is one unit of work.
A unit returns links and not pairs: up to RUN fingerprints every link, beyond that a spanning forest, which has
the same components.

Defined cases: a null, empty or blank text has fingerprint zero, linked like any other; rows that repeat a doc_id
or a text are one row each; a null doc_id is never the name of a component unless all its members are null;
columns other than doc_id and text are not read.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.components import connected_components
from lintel.llm.storage import checkpointed

SHINGLE, DISTANCE, SEED = 3, 3, 42
SEGMENTS, BITS = 8, 8
#: Of segments 2 to 4 of the chain, the two that must be equal.
CHOICES = ((2, 3), (2, 4), (3, 4))
#: Fingerprints of a block of a key that has more; runs in which every pair is looked at in one numpy step.
BLOCK, RUN = 4096, 32


def _fingerprints(shingle: int):
    def batches(items):
        for batch in items:
            prints = np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                words = text.encode().lower().split() if text else []
                if not words:
                    continue
                parts = [b" ".join(x) for x in zip(*(words[k:] for k in range(shingle)))] if len(words) >= shingle else [b" ".join(words)]
                h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in parts), np.uint64, len(parts))
                bits = np.zeros(64, np.int64)
                for at in range(0, len(h), 1 << 16):
                    bits += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                prints[i] = np.packbits(bits * 2 > len(h), bitorder="little").view(np.uint64)[0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    return batches


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint as a signed long): a bit is set if it is in over half of the shingles' hashes."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints(shingle), "doc_id long, fingerprint long")


def _keys() -> Column:
    """The 24 keys of a fingerprint: start and choice, then four of its segments."""
    keys = []
    for start in range(SEGMENTS):
        print_ = F.col("fingerprint")
        ring = print_ if not start else F.shiftrightunsigned(print_, BITS * start).bitwiseOR(F.shiftleft(print_, 64 - BITS * start))
        head = ring.bitwiseAND(F.lit(0xFFFF))
        for k, (one, two) in enumerate(CHOICES):
            parts = [F.shiftleft(F.shiftrightunsigned(ring, BITS * s).bitwiseAND(F.lit(0xFF)), 16 + BITS * i) for i, s in enumerate((one, two))]
            keys.append(head.bitwiseOR(parts[0]).bitwiseOR(parts[1]).bitwiseOR(F.lit((start * len(CHOICES) + k) << 32)))
    return F.array(*keys)


def chained(one: np.ndarray, two: np.ndarray, start: np.ndarray, distance: int) -> np.ndarray:
    """Whether the chain from each start keeps to its budgets; its last link is the Hamming distance."""
    differ = one ^ two
    shift = (start * BITS).astype(np.uint64)
    ring = (differ >> shift) | (differ << ((np.uint64(64) - shift) & np.uint64(63)))
    alive = np.arange(len(one))
    for links in range(1, SEGMENTS + 1):
        mask = np.uint64((1 << (BITS * links)) - 1)
        alive = alive[np.bitwise_count(ring[alive] & mask) <= links * distance // SEGMENTS]
    return alive


def _forest(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among one unit's fingerprints."""
    left, froms, tos = np.arange(1, len(prints)), [], []
    queue = [0]
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        at = queue.pop()
        near = np.bitwise_count(prints[left] ^ prints[at]) <= distance
        if near.any():
            found = left[near]
            froms.append(np.full(len(found), at))
            tos.append(found)
            queue += found.tolist()
            left = left[~near]
    none = [np.zeros(0, np.int64)]
    return np.concatenate(froms or none), np.concatenate(tos or none)


def _links(distance: int):
    """Links within runs of equal (key, unit), which arrive together and in order."""

    def linked(key: np.ndarray, node: np.ndarray, prints: np.ndarray, cuts: np.ndarray):
        size = np.diff(cuts)
        run = np.repeat(np.arange(len(size)), size)
        short = np.flatnonzero(size[run] <= RUN)
        froms, tos = [], []
        for step in range(1, min(RUN, int(size.max()))):
            at = short[short + step < len(run)]
            at = at[run[at] == run[at + step]]
            if not len(at):
                break
            at = at[chained(prints[at], prints[at + step], (key[at] >> 32) // len(CHOICES), distance)]
            froms.append(node[at])
            tos.append(node[at + step])
        for i in np.flatnonzero(size > RUN):
            own = slice(cuts[i], cuts[i + 1])
            one, two = _forest(prints[own], distance)
            froms.append(node[own][one])
            tos.append(node[own][two])
        if froms:
            pairs = np.unique(np.stack([np.concatenate(froms), np.concatenate(tos)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])

    def batches(items):
        kept = None
        for batch in items:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if kept is not None:
                columns = [np.concatenate(x) for x in zip(kept, columns)]
            key, unit, node, prints = columns
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (unit[1:] != unit[:-1])) + 1])
            kept = [x[cuts[-1] :] for x in columns]  # the last run may go on in the next batch
            if len(cuts) > 1:
                yield from linked(key[: cuts[-1]], node, prints.view(np.uint64), cuts)
        if kept is not None and len(kept[0]):
            yield from linked(kept[0], kept[2], kept[3].view(np.uint64), np.array([0, len(kept[0])]))

    return batches


def near_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links among distinct (node long, fingerprint long) rows, enough to give their components."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError("the keys hold for distances up to 3")
    keyed = prints.select("node", "fingerprint", F.explode(_keys()).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), blocks).cast("int")
    met = keyed.join(shared, "key").withColumn("blocks", blocks).withColumn("own", own)
    unit = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.least(x, F.col("own")).cast("long") * F.col("blocks") + F.greatest(x, F.col("own"))))
    dealt = met.select("key", unit.alias("unit"), "node", "fingerprint").repartition("key", "unit").sortWithinPartitions("key", "unit")
    return dealt.mapInArrow(_links(distance), "a long, b long").distinct()


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for each row of docs (doc_id, text)."""
    rows = checkpointed(fingerprints(docs, shingle))
    nodes = checkpointed(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).select("fingerprint", "least", F.col("fingerprint").alias("node")))
    named = connected_components(near_links(nodes.select("node", "fingerprint"), distance))
    joined = nodes.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = joined.join(least, "component").select("fingerprint", "component_id")
    return rows.join(answer, "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
