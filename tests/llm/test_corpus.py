"""Quality, sharding, mixing and the pipeline against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

import corpus_pipeline
from lintel.llm import mixing, quality, sharding
from lintel.llm.storage import written


@given(st.integers(1, 3000), st.integers(0, 5))
def test_permutation_is_a_bijection_and_inverts(rows, seed):
    places = sharding.permute(np.arange(rows), rows, seed)
    assert sorted(places.tolist()) == list(range(rows))
    assert sharding.permute(places, rows, seed, inverse=True).tolist() == list(range(rows))


def test_shards(docs, rows):
    found = sharding.shard(docs, 7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    sizes = Counter(r.shard for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7
    for shard, n in sizes.items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(n))
    ordered = sorted(found, key=lambda r: r.row_number)
    assert [r.row_number for r in ordered] == list(range(len(rows)))
    assert [(r.doc_id is not None, r.doc_id or 0, r.size) for r in ordered] == sorted((r.doc_id is not None, r.doc_id or 0, r.size) for r in found)
    places = sharding.permute(np.arange(len(rows)), len(rows))
    assert all((r.shard, r.slot) == (places[r.row_number] % 7, places[r.row_number] // 7) for r in found)


def test_shards_do_not_depend_on_partitions(docs):
    one, two = (Counter(tuple(r) for r in sharding.shard(x).collect()) for x in (docs.repartition(1), docs.repartition(9)))
    assert one == two


def test_shards_empty(empty):
    assert sharding.shard(empty).collect() == []


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    found = mixing.targets(sizes, weights)
    assert all(0 <= t <= 2 * s + 1e-6 for t, s in zip(found, sizes))
    assert math.isclose(sum(found), 1.5 * sum(sizes), abs_tol=1e-6)
    units = [t / w for t, w, s in zip(found, weights, sizes) if s and t < 2 * s - 1e-6]
    assert not units or max(units) - min(units) < 1e-6


@given(st.lists(st.integers(0, 200), min_size=1, max_size=6), st.integers(1, 9))
def test_quotas_are_split_exactly(quotas, shards):
    found = mixing.split_quotas(quotas, shards)
    assert [sum(x) for x in found] == quotas
    totals = [sum(x[i] for x in found) for i in range(shards)]
    assert max(totals) - min(totals) <= 1


def _matched(rows, found):
    """Each input row with its decision; rows alike in id and text have the same one."""
    by_row = defaultdict(list)
    for f in found:
        by_row[f.doc_id, f.source, f["size"]].append(f)
    return [(r, by_row[r[0], r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))].pop()) for r in rows]


def test_quotas_beyond_the_exact_generator():
    found = mixing.split_quotas([3_000_000_000, 5, 2_000_000_000], 3)
    assert [sum(x) for x in found] == [3_000_000_000, 5, 2_000_000_000]
    totals = [sum(x[i] for x in found) for i in range(3)]
    assert max(totals) - min(totals) <= 1


@pytest.mark.parametrize("block_rows", [16, 2])
def test_mix(docs, rows, block_rows):
    decisions, draws = mixing.mix(docs, block_rows=block_rows)
    found = decisions.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r["size"]) for r in found) == Counter((r[0], r[3], size(r[1])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    aims = dict(zip(names, mixing.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    taken = defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, aims[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2 and len(r.shards) == r.copies
        taken[r.source] += r.taken
    for s in names:
        own = [size(r[1]) for r in rows if r[3] == s]
        assert abs(taken[s] - aims[s]) <= max(own) / 2 + 1e-6
        assert max(own) > aims[s] / 10 or abs(taken[s] - aims[s]) <= aims[s] / 100
    assert Counter((r.doc_id, r.text) for r in mixing.mixed(docs, block_rows=block_rows).collect()) == sum((Counter({(r[0], r[1]): f.copies}) for r, f in _matched(rows, found)), Counter())
    drawn = draws.collect()
    assert Counter((r.doc_id, r.text_hash, r.source) for r in drawn) == sum((Counter({(r.doc_id, r.text_hash, r.source): r.copies}) for r in found), Counter())
    assert all(0 <= r.shard < mixing.SHARDS for r in drawn)
    again, _ = mixing.mix(docs.repartition(5), block_rows=block_rows)
    assert Counter(map(str, again.collect())) == Counter(map(str, found))


def test_mix_empty(empty):
    decisions, draws = mixing.mix(empty)
    assert decisions.collect() == [] and draws.collect() == []


def test_margins_match_the_pairwise_sum():
    rng = np.random.Generator(np.random.PCG64(1))
    machine = quality.Machine(slots=30, rank=3)
    machine.linear, machine.bias = rng.normal(size=30), 0.3
    row = np.array([0, 0, 0, 1, 1, 2])
    slot, value = np.array([1, 5, 7, 5, 9, 2]), rng.normal(size=6)
    expected = []
    for r in range(3):
        own = [(s, v) for k, s, v in zip(row, slot, value) if k == r]
        total = machine.bias + sum(machine.linear[s] * v for s, v in own)
        total += sum(machine.factors[a] @ machine.factors[b] * v * w for i, (a, v) in enumerate(own) for b, w in own[i + 1 :])
        expected.append(total)
    assert np.allclose(machine.margins(row, slot, value, 3), expected)


def test_scores_are_the_double_sum(judged):
    """The query's score of every row against sigmoid(w0 + sum + pair by pair)."""
    docs, labels = judged
    model = quality.fit(docs, labels)
    scores = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    for r in docs.where("doc_id % 40 = 0").collect():
        data = np.frombuffer(r.text.encode(), np.uint8)
        _, slot, value = quality.features(data, np.array([0, len(data)]), np.array([float(r.n_chars)]))
        total = model.bias + sum(model.linear[s] * v for s, v in zip(slot, value))
        total += sum(model.factors[slot[i]] @ model.factors[slot[j]] * value[i] * value[j] for j in range(len(slot)) for i in range(j))
        assert math.isclose(scores[r.doc_id], 1 / (1 + math.exp(-total)), abs_tol=1e-9)


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) + str(rng.randint(0, 50)) for _ in range(rng.randint(5, 60)))
        rows.append((i, text if good else text.upper().replace(" ", "!! "), len(text)))
        labels.append((i, int(good), 0))
    labels += [(3, None, 0), (None, 1, 0), (5, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(judged):
    found = quality.classify(*judged).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert sum((r.doc_id % 3 > 0) == r.predicted for r in held) / len(held) > 0.97


def test_quality_never_sees_held_out_labels(judged):
    docs, labels = judged
    turned = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    one, two = quality.classify(docs, labels).orderBy("doc_id").collect(), quality.classify(docs, turned).orderBy("doc_id").collect()
    assert one == two


def test_quality_edges(spark, docs, rows, empty, judged):
    labels = judged[1]
    assert quality.classify(docs, labels).where("score between 0 and 1").count() == len(rows)
    assert quality.classify(empty, labels).collect() == []
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.drop("n_chars"), labels).count() == len(rows)


WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def near_brute(rows):
    """Which rows stay: of each component of fingerprints within 3 bits, the first by (doc_id, null last)."""
    prints = []
    for r in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and part[i] != part[j]:
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    groups = defaultdict(list)
    for i, p in enumerate(part):
        groups[p].append(i)
    return [min((rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0) for i in g) for g in groups.values()], groups


def hit_brute(text, benchmark):
    terms = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 10]) for w in map(terms, benchmark) if w for i in range(max(1, len(w) - 9))}
    own = terms(text)
    return any(tuple(own[i : i + len(w)]) == w for w in windows for i in range(len(own) - len(w) + 1))


CLASHES = {"row": "r", "number": 5, "text_hash": 6, "own_hash": 7, "copies": 8, "time": 9, "again": 1, "nth": 2, "alike": 3, "quality_score": 0.1, "component_id": 4, "placements": "p", "plan": "q", "from": "f", "place": 2, "given": 1.0, "kept": True}


def test_pipeline_stages(spark, docs, rows, tmp_path):
    """Each stage against brute force on its own input, with columns whose names the operators use as well."""
    clashing = docs.where("size(split(coalesce(text, ''), ' ')) < 5000").withColumns({k: quality.F.lit(v) for k, v in CLASHES.items()})
    clashing.write.parquet(f"{tmp_path}/documents.parquet")
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 25]
    benchmark = [" ".join(texts[0].split()[2:20]), "one two", None]
    spark.createDataFrame(list(enumerate(benchmark)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    own = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    key = lambda r: str(r.asDict())
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = own.collect()
        own = written(stage(spark, own, str(tmp_path)), "stage")
        after = own.collect()
        assert own.columns == clashing.columns
        assert not Counter(map(key, after)) - Counter({k: 2 * n for k, n in Counter(map(key, before)).items()})
        if name == "quality classifier":
            good = Counter(r.doc_id for r in quality.classify(spark.createDataFrame(before, own.schema), labels).where("predicted = 1").collect())
            assert Counter(r.doc_id for r in after) == good and after
        elif name == "simhash near-dedup":
            first, groups = near_brute(before)
            assert Counter((r.doc_id is None, r.doc_id or 0) for r in after) == Counter(first)
            assert len(after) == len(groups) < len(before)
        elif name == "benchmark decontamination":
            assert Counter(map(key, after)) == Counter(key(r) for r in before if not hit_brute(r.text, benchmark))
        else:
            size = lambda r: len(WORD.findall(r.text or ""))
            totals = defaultdict(int)
            for r in before:
                totals[r.source] += size(r)
            names = sorted(totals, key=lambda s: (s is None, s or ""))
            for s, aim in zip(names, mixing.targets([totals[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])):
                assert abs(sum(size(r) for r in after if r.source == s) - aim) <= max(size(r) for r in before if r.source == s) / 2 + 1e-6
    last = corpus_pipeline.shard(spark, own, str(tmp_path))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert Counter(tuple(r) for r in found.collect()) == Counter(tuple(r) for r in last.collect())
    assert Counter((r.doc_id, r["size"]) for r in found.collect()) == Counter((r.doc_id, len((r.text or "").encode()) + 8) for r in own.collect())
    for shard, slots in found.groupBy("shard").agg(quality.F.collect_list("slot")).collect():
        assert sorted(slots) == list(range(len(slots)))


def test_pipeline_of_nothing(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_judges_rows_and_not_ids(spark, tmp_path):
    """Rows without a doc_id, or that repeat one, stay or go each for its own text; without a model all stay."""
    unlike = [" ".join(f"{c}{i}{k * 31 % 97}" for k in range(80)) for i, c in enumerate("abcdefg")]
    six = list(zip([None, None, None, 3, 3, 4], unlike))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in corpus_pipeline.near_dedup(spark, frame(six), "").collect()) == Counter(six)
    rows = [(3, unlike[0]), (5, unlike[0]), (5, unlike[1]), (None, unlike[2]), (None, unlike[3]), (None, unlike[3]), (7, unlike[4]), (7, unlike[5])]
    docs = frame(rows)
    first = [rows[0], *rows[2:5], *rows[6:]]
    assert Counter(tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == Counter(first)
    spark.createDataFrame([(1, unlike[2]), (2, unlike[4])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [r for r in rows if r[1] not in (unlike[2], unlike[4])]
    assert Counter(tuple(r) for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()) == Counter(clean)
    spark.createDataFrame([(3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).count() == len(rows)


def test_hypergeometric_law():
    """Draws follow the exact law, counted with whole numbers; far beyond what generators take, mean and spread are the law's."""
    rng = np.random.Generator(np.random.PCG64(7))
    for own, others, draws in ((5, 3, 4), (10, 2, 11), (40, 60, 30), (1, 9, 5), (7, 0, 3), (0, 5, 2)):
        n = 20_000
        seen = Counter(mixing.hypergeometric(rng, own, others, draws) for _ in range(n))
        law = {k: math.comb(own, k) * math.comb(others, draws - k) / math.comb(own + others, draws) for k in range(max(0, draws - others), min(own, draws) + 1)}
        assert set(seen) <= set(law)
        assert sum((seen[k] - n * p) ** 2 / (n * p) for k, p in law.items() if n * p >= 5) < 60
    own, others, draws = 3 * 10**12, 10**13, 4 * 10**10
    found = np.array([mixing.hypergeometric(rng, own, others, draws) for _ in range(200)], dtype=float)
    p = own / (own + others)
    spread = (draws * p * (1 - p) * (own + others - draws) / (own + others - 1)) ** 0.5
    assert abs(found.mean() - draws * p) < 5 * spread / 200**0.5 and 0.8 < found.std() / spread < 1.2
    assert [sum(x) for x in mixing.split_quotas([10**12, 5, 0, 10**11], 7)] == [10**12, 5, 0, 10**11]
