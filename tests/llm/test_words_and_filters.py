"""Filter audit and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from lintel.llm import filter_audit, spelling

SPACE = "[\x20\x09-\x0d]+"


@pytest.fixture(scope="module")
def labels(rows):
    rng = random.Random(3)
    found = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 0, 1, None])) for r in rows if r[0] is None or r[0] % 3]
    return [*found, (rows[3][0], 1, 1), (10_000, 1, 1)]


def audit_brute(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    fails = []
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        words = [w for w in re.split(SPACE, text) if w]
        earlier = any((t or "") == text and d is not None and doc_id is not None and d < doc_id for d, t, *_ in rows)
        own = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": earlier}
        fails.append((lang or "", doc_id in good, doc_id in toxic, {f for f, failed in own.items() if failed}))
    out = []
    for part in {f[0] for f in fails}:
        own, total_removed, lines = [f for f in fails if f[0] == part], Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone, before = [x for x in left if f in x[3]], len(left)
                left = [x for x in left if f not in x[3]]
                total_removed[f] += before - len(left)
                redundant = sum(f in x[3] for x in own) - len(gone)
                lines.append([part, order, step, len(left), len(gone), redundant, sum(x[3] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone), f])
        out += [(*line[:-1], total_removed[line[-1]]) for line in lines]
    return Counter(out)


def test_audit(spark, docs, rows, labels):
    table = spark.createDataFrame([(*x, "l") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = Counter(tuple(r) for r in filter_audit.audit(docs, table).collect())
    assert got == audit_brute(rows, labels)
    assert filter_audit.audit(docs, table).columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_of_every_mask(spark):
    """Texts for all 32 masks, each several times; equal texts in several parts."""
    rng, rows = random.Random(8), []
    for mask in range(16):
        words = [f"w{mask}x{i}" for i in range(50 if mask & 1 else 150)]
        words = words + words[:60] + words[:30] if mask & 2 else words
        text = " ".join(words) + (" " + "Q" * len(" ".join(words)) if mask & 4 else "") + (" #" if mask & 8 else "")
        rows += [(rng.randrange(500), text, rng.choice(["x", "y", None])) for _ in range(6)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(500)]
    labels = [(i, q, int(t)) for i, q, t in labels]
    got = filter_audit.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert Counter(tuple(r) for r in got.collect()) == audit_brute(rows, labels)


def test_audit_empty(spark, empty):
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def variants_brute(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near, forms = defaultdict(set), {}
    for w in n:
        for x in n:
            if abs(len(w) - len(x)) < 2 and w != x:
                i = next((k for k in range(min(len(w), len(x))) if w[k] != x[k]), min(len(w), len(x)))
                if w[i + 1 :] == x[i + 1 :] or w[i:] == x[i + 1 :] or w[i + 1 :] == x[i:]:
                    near[w].add(x)
    for w in near:
        best = min(near[w], key=lambda x: (-n[x], x))
        if n[best] >= 2 * n[w]:
            forms[w] = best

    def root(w):
        while w in forms:
            w = forms[w]
        return w

    return {w: (w, forms.get(w), root(w), n[w], len(near[w]), n.get(forms.get(w))) for w in n}


@pytest.fixture(scope="module")
def misspelt():
    """Words with variants, families that share long beginnings and endings, chains of forms, very long words."""
    rng = random.Random(21)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(5, 9))) for _ in range(30)]
    base += ["aaaaa", "aaaaaa", "aaaaaaa", "ÀaaaA", "÷÷÷÷÷", "prefixprefix" + "abc", "endingending"] + ["q" * 3000, "q" * 2999, "q" * 1500 + "r" + "q" * 1499]
    base += ["common" + a + b + "shared" for a in "abcdefg" for b in "abcdefg"]
    words = []
    for k, w in enumerate(base):
        words += [w] * (3 << (k % 5))
        for _ in range(3):
            i = rng.randrange(len(w))
            words += [rng.choice([w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "X" + w[i + 1 :]])] * rng.randint(2, 5)
    rng.shuffle(words)
    return [(i, " ".join(words[i * 7 : i * 7 + 7]) + rng.choice([".", "\n", "9"])) for i in range(len(words) // 7 + 1)] + [(None, " ".join(words[:200])), (5, None), (6, "")]


@pytest.mark.parametrize("bucket, chunk, stretch", [(4096, 1 << 16, 1 << 20), (8, 16, 50), (2, 1, 7)])
def test_variants(spark, misspelt, monkeypatch, bucket, chunk, stretch):
    for name, value in (("BUCKET_WORDS", bucket), ("CHUNK_ROWS", chunk), ("STRETCH", stretch), ("HELD_WORDS", chunk)):
        monkeypatch.setattr(spelling, name, value)
    frame = spark.createDataFrame([(*r, "w", 1) for r in misspelt], "doc_id long, text string, word string, n int").repartition(3)
    got = {r.word: tuple(r) for r in spelling.variants(frame).collect()}
    want = variants_brute(misspelt)
    assert got == want
    assert any(x[1] and x[2] != x[1] for x in want.values())


def test_variants_of_the_shared_rows(spark, docs, rows, empty):
    assert {r.word: tuple(r) for r in spelling.variants(docs).collect()} == variants_brute(rows)
    assert spelling.variants(empty).collect() == []


def test_wavelet_tree():
    rng = np.random.default_rng(4)
    for size in (1, 2, 7, 64, 333):
        values = rng.permutation(size)
        bounds = np.sort(rng.integers(0, size + 1, (50, 2, 2)), axis=2)
        asked, value = spelling.report(spelling.wavelet_tree(values), bounds[:, 0, 0], bounds[:, 0, 1], bounds[:, 1, 0], bounds[:, 1, 1])
        got = sorted(zip(asked.tolist(), value.tolist(), strict=True))
        assert got == sorted((k, int(v)) for k, ((lo, hi), (least, most)) in enumerate(bounds) for v in values[lo:hi] if least <= v < most)


@pytest.mark.parametrize("limit", [1, 7, 64, 1 << 16])
def test_tasks_cut_into_small_pieces(spark, misspelt, monkeypatch, limit):
    """What a task does, in pieces of any size, in this process."""
    for name in ("CHUNK_ROWS", "STRETCH", "HELD_WORDS", "QUESTIONS"):
        monkeypatch.setattr(spelling, name, limit)
    table = pa.table({"doc_id": [r[0] for r in misspelt], "text": [r[1] for r in misspelt]})
    counts = Counter()
    for batch in spelling._partial_counts(iter(table.to_batches(max_chunksize=5))):
        counts.update(dict(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
    want = variants_brute(misspelt)
    assert {w: n for w, n in counts.items() if n >= 3} == {w: x[3] for w, x in want.items()}
    keys = ["length", "a", "b", "key"]
    words = spark.createDataFrame([(w, x[3]) for w, x in want.items()], "word string, n long")
    entries = spelling._entries(words).toArrow().sort_by([(k, "ascending") for k in keys])
    near = Counter()
    for batch in spelling._search(iter(entries.to_batches(max_chunksize=max(1, limit // 2)))):
        near.update(dict(zip(batch.column("word").to_pylist(), batch.column("n_near").to_pylist(), strict=True)))
    assert near == {w: x[4] for w, x in want.items() if x[4]}
