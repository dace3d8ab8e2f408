"""Exact, near, line and substring dedup against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lintel.llm import exact_dedup, line_dedup, simhash, substring
from lintel.llm import hot as hot_module
from lintel.llm.components import connected_components

LAST = (1 << 63) - 1


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def multiset(rows):
    return Counter(tuple(r) for r in rows)


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    for keep, pick in (("largest", max), ("smallest", min)):
        expected = []
        for r in rows:
            ids = [x for x in groups[r[1] or ""] if x is not None]
            kept = pick(ids) if ids else None
            expected.append((r[0], kept, len(groups[r[1] or ""]), r[0] == kept, sha(r[1] or "")))
        assert multiset(exact_dedup.exact_dedup(docs, keep).collect()) == multiset(expected)


def test_exact_dedup_under_memory_pressure(docs):
    wide, narrow = exact_dedup.exact_dedup(docs), exact_dedup.exact_dedup(docs, held_bytes=50)
    assert multiset(wide.collect()) == multiset(narrow.collect())


def test_exact_dedup_empty(empty):
    assert exact_dedup.exact_dedup(empty).collect() == []


@given(st.lists(st.tuples(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), st.integers(0, 9)), max_size=40))
def test_trie_holds_what_was_inserted(items):
    trie, expected = exact_dedup.Trie(), {}
    for text, i in items:
        trie.insert(text, i, i, 1)
        e = expected.setdefault(text, [i, i, 0])
        e[:] = [min(e[0], i), max(e[1], i), e[2] + 1]
    assert dict(trie.release()) == expected
    assert trie.held == 0


@given(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=40), st.binary(max_size=4).map(lambda b: bytes(x % 3 for x in b)))
def test_trie_releases_what_comes_before(texts, cut):
    trie = exact_dedup.Trie()
    for text in texts:
        trie.insert(text, 1, 1, 1)
    assert {t for t, _ in trie.release_before(cut)} == {t for t in texts if t < cut}
    assert {t for t, _ in trie.release()} == {t for t in texts if t >= cut}
    assert trie.held == 0


def _owned(texts, limit):
    batch = pa.RecordBatch.from_pydict({"text": sorted(texts), "low": range(len(texts)), "high": range(len(texts)), "rows": [1] * len(texts)})
    return [r for b in exact_dedup._own(limit)(iter([batch])) for r in b.to_pylist()]


def test_owner_trie_shares_beginnings_and_spills_complete_subtrees(monkeypatch):
    shared = [b"x" * 10_000 + b"%03d" % i for i in range(100)]
    apart = [b"%03d" % i + b"x" * 10_000 for i in range(100)]
    most, calls = [], []
    insert, before = exact_dedup.Trie.insert, exact_dedup.Trie.release_before
    monkeypatch.setattr(exact_dedup.Trie, "insert", lambda self, *a: (insert(self, *a), most.append(self.held))[0])
    monkeypatch.setattr(exact_dedup.Trie, "release_before", lambda self, t: calls.append(t) or before(self, t))
    assert len(_owned(shared, 100_000)) == 100
    assert max(most) < 100_000 and not calls  # one long edge, not a hundred
    most.clear()
    assert {r["text_sha256"] for r in _owned(apart, 100_000)} == {hashlib.sha256(t).hexdigest() for t in apart}
    assert calls and max(most) < 120_000  # a limit and one text


def substring_brute(rows, window):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    ids = [LAST if r[0] is None else r[0] for r in rows]
    first = {}
    for i, words in zip(ids, texts):
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, LAST), i)
    out = []
    for r, i, words in zip(rows, ids, texts):
        gone = {p for k in range(len(words) - window + 1) if first[tuple(words[k : k + window])] < i for p in range(k, k + window)}
        out.append((r[0], len(words), len(gone), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    return out


@pytest.mark.parametrize(("window", "mer", "size"), [(13, 3, 8 << 20), (13, 1, 1000), (3, 3, 3000), (1, 1, 8 << 20)])
def test_substring_dedup(docs, rows, window, mer, size):
    found = substring.substring_dedup(docs, window, mer, chunk_bytes=size, bucket_bytes=size)
    assert multiset(found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == multiset(substring_brute(rows, window))
    assert all(sha(r.kept_text) == r.kept_sha256 for r in found.collect())


def test_substring_dedup_empty(empty):
    assert substring.substring_dedup(empty).collect() == []


def fingerprint_brute(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(ids, prints, distance):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= distance:
            parent[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = i if least[root(k)] is None else min(least[root(k)], i)
    return [(i, f"{p:016x}", least[root(k)]) for k, (i, p) in enumerate(zip(ids, prints))]


def test_simhash(docs, rows):
    prints = [fingerprint_brute(r[1]) for r in rows]
    assert multiset(simhash.simhash_components(docs).collect()) == multiset(components_brute([r[0] for r in rows], prints, 3))


def test_simhash_empty(empty):
    assert simhash.simhash_components(empty).collect() == []


@pytest.mark.parametrize(("block", "run"), [(4096, 32), (20, 4)])
def test_no_link_is_lost(spark, monkeypatch, block, run):
    rng = np.random.Generator(np.random.PCG64(3))
    centres = rng.integers(0, 1 << 64, 25, dtype=np.uint64)
    prints = set(centres.tolist())
    for c in centres.tolist():
        for _ in range(12):
            x = c
            for b in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                x ^= 1 << b
            prints.add(x)
    prints |= {int(centres[0]) ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}  # one group of many
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "RUN", run)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame(list(zip(range(len(signed)), signed)), "node long, fingerprint long")
    edges = simhash.near_links(frame)
    named = {r.node: r.component for r in connected_components(edges).collect()}
    brute = components_brute(list(range(len(prints))), prints, 3)
    assert [named.get(i, i) for i in range(len(prints))] == [c for _, _, c in brute]
    for r in edges.collect():
        assert (prints[r.a] ^ prints[r.b]).bit_count() <= 3


@pytest.mark.parametrize("hot", [3, 1000])
def test_components_with_hubs(spark, monkeypatch, hot):
    """Stars, paths between them and chance edges, with and without keys that count as hot."""
    monkeypatch.setattr(hot_module, "HOT", hot)
    rng = random.Random(hot)
    edges = [(h, h + k) for h in (1000, 2000, 3000) for k in range(1, 40)] + [(1005, 2007), (5000, 5001)] + [(rng.randint(1, 200), rng.randint(1, 200)) for _ in range(120)]
    part = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in part:
        for a, b in edges:
            if a != b:
                part[a] = part[b] = min(part[a], part[b])
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == part


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}


@given(st.lists(st.integers(0, 8), max_size=30), st.lists(st.integers(0, 8), max_size=30))
def test_patience_aligns_equal_items_in_order(one, two):
    pairs = line_dedup.patience(one, two)
    assert all(one[i] == two[j] for i, j in pairs)
    assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
    if one == two:
        assert len(pairs) == len(one)


def line_brute(rows, rare, few):
    """Every step of line_dedup on plain lists."""
    first = {}
    for r in rows:
        if r[1]:
            first[r[1]] = min(first.get(r[1], LAST), LAST if r[0] is None else r[0])
    lines = {t: [x.strip(" \t\r\x0b\x0c") for x in t.split("\n")] for t in first}
    having = defaultdict(set)
    for t, own in lines.items():
        for x in own:
            if x:
                having[x].add(t)
    number = {t: hashlib.sha256(t.encode()).digest()[:16] for t in first}
    gone = defaultdict(set)
    for t, own in lines.items():
        links = {}
        for x in set(own) - {""}:
            owner = min(having[x], key=lambda u: (first[u], number[u]))
            if len(having[x]) > 1 and owner != t:
                links[owner] = min(links.get(owner, LAST), len(having[x]))
        for k, (owner, n) in enumerate(sorted(links.items(), key=lambda e: (e[1], number[e[0]]))):
            if n <= rare or k < few:
                gone[t] |= set(line_dedup.common_lines(lines[owner], own, [len(x) for x in own], 2, 40))
    out = []
    for r in rows:
        own = r[1].split("\n") if r[1] else []
        away = gone[r[1]] if r[1] else set()
        if r[1] and (LAST if r[0] is None else r[0]) > first[r[1]]:
            away = set(range(len(own)))
        out.append((r[0], len(own), len(away), sha("\n".join(x for i, x in enumerate(own) if i not in away))))
    return out


@pytest.mark.parametrize(("rare", "few"), [(16, 3), (1, 1)])
def test_line_dedup(docs, rows, rare, few):
    found = line_dedup.line_dedup(docs, rare, few)
    assert multiset(found.select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()) == multiset(line_brute(rows, rare, few))


def test_line_dedup_removes_the_later_block(spark):
    shared = "a line that both of them have\nand another one behind it\nand a third"
    frame = spark.createDataFrame([(1, f"first\n{shared}\nend one"), (2, f"other start\nmore\n{shared}\nend two"), (3, "nothing shared")], "doc_id long, text string")
    kept = {r.doc_id: r.kept_text for r in line_dedup.line_dedup(frame).collect()}
    assert kept == {1: f"first\n{shared}\nend one", 2: "other start\nmore\nend two", 3: "nothing shared"}


def test_line_dedup_in_slices(docs):
    """Slices of one row each, and no texts, give the same digests."""
    digests = lambda **x: sorted(tuple(r) for r in line_dedup.line_dedup(docs, **x).select(F.coalesce("doc_id", F.lit(-1)), "n_lines", "n_removed", "kept_sha256").collect())
    assert digests(held_bytes=1) == digests(with_text=False) == digests()


def test_line_dedup_removes_only_what_is_aligned(spark, monkeypatch):
    """Without the alignment nothing leaves, but for later copies of a whole text; moved and repeated blocks are aligned too."""
    rng = random.Random(30)
    for _ in range(400):
        one, two = ([rng.choice(["aaaa", "bbbb", "cccc", "", "dd"]) for _ in range(rng.randint(0, 12))] for _ in range(2))
        chars = [len(x) for x in two]
        got = set(line_dedup.common_lines(one, two, chars, 2, 8))
        want = set()
        for i in range(len(two)):
            for k in range(i + 1, len(two) + 1):
                own = two[i:k]
                if (sum(map(bool, own)) >= 2 or sum(map(len, own)) >= 8) and any(one[p : p + len(own)] == own for p in range(len(one))):
                    want |= {*range(i + next(x for x, y in enumerate(own) if y), k - next(x for x, y in enumerate(own[::-1]) if y))}
        assert want <= got and all(not two[j] for j in got - want), (one, two)
    monkeypatch.setattr(line_dedup, "patience", lambda one, two: [])
    for _ in range(50):
        one = [rng.choice("abc") * 9 for _ in range(10)]
        assert line_dedup.common_lines(one, list(one), [9] * 10, 2, 8) == []


def test_line_dedup_empty(empty):
    assert line_dedup.line_dedup(empty).collect() == []


def all_pairs_brute(rows):
    """Lines of each text in a large enough stretch that any earlier text has too: their number by doc_id; texts and ids differ."""
    cut = {i: [x.strip(" \t\r\x0b\x0c") for x in t.split("\n")] for i, t in rows}
    gone = {i: set() for i in cut}
    for i, own in cut.items():
        for other in (x for j, x in cut.items() if j < i):
            for a, b in itertools.product(range(len(other)), range(len(own))):
                n = 0
                while a + n < len(other) and b + n < len(own) and other[a + n] == own[b + n]:
                    n += 1
                run = own[b : b + n]
                if sum(x != "" for x in run) >= 2 or sum(map(len, run)) >= 40:
                    gone[i] |= set(range(b, b + n))
    return {i: len(x) for i, x in gone.items()}


@pytest.mark.parametrize("hot", [5, 1000])
def test_line_dedup_aligns_every_earlier_text(spark, monkeypatch, hot):
    """Blocks that the first text with a line does not have, or has in another order, and texts of many frequent passages."""
    monkeypatch.setattr(hot_module, "HOT", hot)
    rng = random.Random(11)
    long = [f"passage {k} is a line of well over forty characters in all" for k in range(8)]
    rows = [(1, "L1\nalone one"), (2, "L2\nalone two"), (3, "x\nL1\nL2\ny"), (4, "p\nL1\nL2\nq")]
    rows += [(5, "m1\nm2\nm3\nn1\nn2"), (6, "u\nn1\nn2\nv"), (7, "n1\nn2\nw\nm1\nm2\nm3")]
    rows += [(10 + k, f"own {k}\n{long[k % 8]}\nand {k}") for k in range(160)]
    rows += [(200, "\n-\n".join(f"{x}\nbetween {k}" for k, x in enumerate(long)))]
    some = [rng.choice(["", "a", "b", "c", "d", "e", "f" * 41]) for _ in range(60)]
    rows += [(300 + k, f"row {k}\n" + "\n".join(rng.choice(some) for _ in range(rng.randint(1, 12)))) for k in range(60)]
    found = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == all_pairs_brute(rows)
    assert found[4] == 2 and found[7] == 5 and found[200] == 8
