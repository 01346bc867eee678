import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from larkspur.llm import jaccard_join as j
from larkspur.llm import packing, tokenizing
from larkspur.llm.common import freeing
from tests.llm.conftest import ROWS


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x1c", "\x1c")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k in range(len(sets)):
        groups.setdefault(find(k), []).append(sets[k][0])
    return sorted(str((sets[k][0], len(sets[k][1]), min((i for i in groups[find(k)] if i is not None), default=None))) for k in range(len(sets)))


def got(df):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in df.collect())


def corpus(seed):
    """Clusters of near copies around a few texts, a passage that many share, exact copies and unrelated texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(3):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for _ in range(30):
            t = base[:]
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    texts += [" ".join(passage + [rng.choice(words) for _ in range(rng.randint(1, 40))]) for _ in range(60)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(0, 50))) for _ in range(40)] + texts[:10]
    return [(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed,cell,leaf,marks", [(2, 20, 4, 4), (3, 7, 2, 1)])
def test_components_equal_brute_force(spark, monkeypatch, seed, cell, leaf, marks):
    monkeypatch.setattr(j, "CELL", cell)
    monkeypatch.setattr(j, "LEAF", leaf)
    monkeypatch.setattr(j, "LEAST_COUNT", marks)
    rows = corpus(seed)
    assert got(j.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute(rows)


@pytest.mark.parametrize("leaf", [2, 64])
def test_clusters_without_an_original(spark, monkeypatch, leaf):
    """Near copies whose common original is missing: their links are chains between copies that few others link with."""
    monkeypatch.setattr(j, "LEAF", leaf)
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = []
    for k in range(150):
        t = base[:]
        for at in rng.sample(range(150), rng.choice((2, 2, 2, 3, 4))):
            t[at] = f"n{rng.randrange(40) if k % 3 else rng.randrange(10**6)}"
        texts.append(" ".join(t[: 150 - k % 4]))
    rows = list(enumerate(texts))
    want = brute(rows)
    assert 1 < len({r.split(", ")[2] for r in want}) < 150
    assert got(j.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == want


def test_many_staged_files_of_growing_size(spark):
    """Spark reads larger files first and several in a task, so rids don't ascend within a batch."""
    rng = random.Random(12)
    rows = []
    for k in range(40):
        for _ in range(1 + k // 3):
            t = [f"w{rng.randrange(9000)}" for _ in range(30 + 3 * k)]
            rows += [(len(rows), " ".join(t)), (len(rows) + 1, " ".join([*t[:-1], "changed"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(40, "doc_id")  # longer texts come later
    assert docs.rdd.getNumPartitions() == 40
    assert got(j.components(docs)) == brute(rows)


def test_odd_rows(odd, none):
    assert got(j.components(odd)) == brute([r[:2] for r in ROWS])
    assert j.components(none).count() == 0
    kept = j.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7]
    assert j.keep_one(none).count() == 0


def test_hashed_sets_have_the_sizes_of_real_ones():
    rows = corpus(3)
    texts = [t for _, t in rows] + [None, "A b\tC", "word " * 300_000]
    hashed = list(j.shingle_sets(texts))
    real = [shingles(t) for t in texts]
    assert [len(h) for h in hashed] == [len(r) for r in real]
    for a, b in combinations(range(60), 2):
        assert len(np.intersect1d(hashed[a], hashed[b])) == len(real[a] & real[b])
    assert all((j.unpack_set(j.pack_set(h)) == h >> np.uint64(16)).all() for h in hashed)


def test_trees_find_all_links():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    base = rng.integers(1, 2**63, (12, 80), dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(80) < 0.04, rng.integers(1, 2**63, 80, dtype=np.uint64), base[k % 12])) for k in range(150)]
    bits = j.exact_bitmaps(pa.array([j.pack_set(s) for s in sets], pa.binary()))
    n = np.array([len(s) for s in sets])
    tree = j.Tree(bits, n, n * 185 // 85 - n, np.arange(150))
    found = {(int(a), int(b)) for x, y in j.tree_pairs(tree, tree) for a, b in zip(x, y)}
    assert found == {(a, b) for a in range(150) for b in range(150) if a != b and j.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))} and found


def test_connected_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 80)]
    rows = j.connected(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.rid: r.component for r in rows} == {**{k: 0 for k in range(41)}, 80: 80, 90: 80, 100: 80}


def test_pipeline_stages(spark, odd, none):
    docs, empty = odd, none
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs, empty = stage(spark, docs, ""), stage(spark, empty, "")
        assert empty.count() == 0, name
        if k < 4:
            assert docs.columns == odd.columns
            assert [r.doc_id for r in docs.select("doc_id").orderBy("doc_id").collect()] == ([1, 5, 9], [1], [1], [1])[k]
    assert [r.doc_id for r in docs.collect()] == [1]


def test_near_stage_takes_five_words_and_four_fifths(spark):
    rng = random.Random(6)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    base = new(1000)
    rows = [(1, base), (2, base + new(200)), (3, base + new(280)), (4, new(300))]
    spread = base[:]
    for k in range(21):
        spread[20 + 45 * k] = "changed"
    rows = [(k, " ".join(w)) for k, w in [*rows, (5, spread)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def five(text):
        w = text.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    links = {(a, b) for (a, x), (b, y) in combinations(rows, 2) if 100 * len(five(x) & five(y)) >= 80 * len(five(x) | five(y))}
    assert links == {(1, 2), (1, 5)}
    assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in j.keep_one(docs).collect()) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("shingle,percent", [(5, 80), (3, 60)])
def test_components_of_other_parameters_equal_brute_force(spark, shingle, percent):
    rows = corpus(7)
    sets = [{tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set() for w in (t.split() for _, t in rows)]
    label = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in j.components(docs, shingle, percent).collect()} == dict(enumerate(label))


def own_mb() -> float:
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024


def test_workers_give_back_memory():
    kept = []

    def rows(batches):
        held = [bytes(3000) for _ in range(70_000)]
        kept.append(bytes(3000))  # above all others, so that malloc gives nothing back by itself
        yield from batches
        del held

    before = own_mb()
    assert list(freeing(rows)(iter([1, 2]))) == [1, 2]
    assert own_mb() - before < 60


def test_packing_leaves_no_tokenizer_in_workers(spark, odd):
    import public_tokenizers

    def held(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([tokenizing.encoder.cache_info().currsize + tokenizing.tokenizer.cache_info().currsize])], ["n"])

    pieces = packing.token_pieces(odd, public_tokenizers.path("byte_bpe_50k.json"), 2048)
    assert pieces.count() >= 10
    assert {r.n for r in spark.range(4, numPartitions=4).mapInArrow(held, "n long").collect()} == {0}
