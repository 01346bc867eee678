import tempfile
import time
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from larkspur.llm import packing, sharding, token_store, tokenizing
from larkspur.llm.common import shared_folder
from larkspur.llm.pretokens import split
from larkspur.llm.tokenizing import cut_points, encode_texts
from tests.llm.conftest import ROWS

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ids():
    t = Tokenizer.from_file(PATH)
    return {k: [*t.encode(r[1] or "", add_special_tokens=False).ids, 0] for k, r in enumerate(ROWS)}


def test_long_texts_are_cut_without_changing_ids():
    text = ("some words, and more; 123 numbers\n\n  spaced " * 9000) + "end"
    assert len(cut_points(text)) > 1
    assert next(encode_texts(PATH, [text])).tolist() == [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 0]


def test_texts_taken_together_know_nothing_of_each_other(monkeypatch):
    whole = Tokenizer.from_file(PATH)
    texts = ["'", "s it", "it'", "s", "", None, "  ", " a  ", "\0", "a\0\0", " \0 ", "don't 'll", "\u00a0", "\u3000 b", "漢字", "🙂'", "re🙂", "12 34", "5", "<|endoftext|> x", "z" * 300, "z" * 300, "naïve l'été ", "\n\n", "\n"]
    made = np.random.default_rng(5)
    texts += ["".join(made.choice(list("ab'srd 1é漢🙂\0\n,"), made.integers(0, 30))) for _ in range(3000)]
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    tokenizing.encoder.cache_clear()
    monkeypatch.setattr(tokenizing, "CACHED", 300)  # several generations of known pre-tokens
    monkeypatch.setattr(tokenizing, "CACHED_BYTES", 8)
    for together in (1, 700, 1 << 21):
        monkeypatch.setattr(tokenizing, "TOGETHER", together)
        assert [x.tolist() for k in range(0, len(texts), 500) for x in encode_texts(PATH, texts[k : k + 500])] == want
    known = tokenizing.encoder(PATH).known
    assert known.older[0] and max(len(known.ends), len(known.older[2])) < 300 + 500 * 30
    tokenizing.encoder.cache_clear()


def test_a_vocabulary_without_some_bytes():
    model = Tokenizer(models.BPE({"a": 0, "b": 1, "ab": 2}, [("a", "b")]))
    model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    with tempfile.TemporaryDirectory() as folder:
        model.save(f"{folder}/some.json")
        texts = ["ab abc", "c", "cab", "c c", "bab"]
        assert [x.tolist() for x in encode_texts(f"{folder}/some.json", texts)] == [[*model.encode(t).ids, 0] for t in texts]


def test_words_that_come_again_are_not_looked_up_one_by_one():
    texts = [" ".join(f"word{(k * j) % 97}" for j in range(3000)) for k in range(200)]

    def seconds(work):
        taken = []
        for _ in range(3):
            began = time.process_time()
            work()
            taken.append(time.process_time() - began)
        return min(taken)

    assert seconds(lambda: list(encode_texts(PATH, texts))) < seconds(lambda: [split(t) for t in texts])


def test_store_round_trip(spark, odd, ids):
    rows = token_store.token_digest(odd, token_store.StoreOptions(PATH)).collect()
    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((ROWS[k][0], len(x), crc(x)) for k, x in ids.items())
    order = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in order] == list(np.cumsum([0, *(r.n_tokens for r in order[:-1])]))
    assert [r.doc_id for r in order if r.doc_id is not None] == sorted(r[0] for r in ROWS if r[0] is not None)


def test_few_texts_are_ordered_for_the_sample(spark, none):
    docs = spark.range(0, 4000, 1, 40).selectExpr("id as doc_id", "case when id % 5 = 0 then 'a copy of one text' when id % 7 = 0 then repeat('long ', 50) when id % 11 > 0 then concat('text ', id) end as text")
    o = token_store.StoreOptions(PATH, sample_docs=30, sample_chars=100)
    short = [r for r in docs.selectExpr("text", "xxhash64(text) as h").collect() if r.text and len(r.text) <= 100]
    first = sorted(r.h for r in short)[:30]
    chosen = [r.text for r in token_store._candidates(docs, o).collect()]
    assert Counter(chosen) == Counter(r.text for r in short if r.h <= first[-1]) and len(set(chosen)) <= 30
    sampled = [r.text for r in short if r.h in first]
    assert {s for s in token_store._sample(docs, o)} == {x.astype("<u2").tobytes() for x in encode_texts(PATH, sampled)}
    assert token_store._sample(none, o) == []


def test_store_gives_single_documents(spark, odd, ids):
    folder = f"{shared_folder(spark)}/store-test-{uuid.uuid4().hex}"
    token_store.write_store(odd, folder, token_store.StoreOptions(PATH, segment_bytes=64))
    assert token_store.read_document(spark, folder, 6).tolist() == ids[5]
    assert token_store.read_document(spark, folder, 3).tolist() == [0]
    assert token_store.read_document(spark, folder, 404) is None


def test_empty_tables(none):
    assert token_store.token_digest(none, token_store.StoreOptions(PATH)).count() == 0
    assert packing.pack(none, PATH).count() == 0
    assert sharding.assign(none).count() == 0


def test_jump_hash_moves_rows_only_to_the_new_shard(odd):
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64)

    def plain(key, n):  # the published loop
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    a, b = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert a[:500].tolist() == [plain(int(k), 16) for k in keys[:500]]
    assert set(b[a != b]) == {16} and 0.04 < (a != b).mean() < 0.08 and max(np.bincount(a)) < 1400
    rows = sharding.assign(odd).collect()
    slots = defaultdict(list)
    for r in rows:
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
        slots[r.shard].append(r.slot)
    assert len(rows) == len(ROWS) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    assert sizes == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)


def test_pieces():
    assert packing.piece_bounds(5, 2) == [(0, 1), (1, 2), (3, 2)]
    assert packing.piece_bounds(4, 2) == [(0, 2), (2, 2)]
    assert packing.piece_bounds(1, 2) == [(0, 1)]


def best_fit(histogram, capacity):
    """One piece at a time into the fullest sequence that takes it."""
    free = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [k for k, f in enumerate(free) if f >= length]
            if fits:
                free[min(fits, key=lambda k: free[k])] -= length
            else:
                free.append(capacity - length)
    return len(free)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 30), max_size=12))
def test_plan_is_best_fit_and_gapless(histogram):
    taken, ranks = defaultdict(list), defaultdict(list)
    for length, lo, hi, first, per, off in packing.plan(histogram, 24):
        for r in range(lo, hi):
            ranks[length].append(r)
            taken[first + (r - lo) // per].append((off + (r - lo) % per * length, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    for slots in taken.values():
        at = 0
        for off, length in sorted(slots):
            assert off == at
            at += length
        assert at <= 24
    assert len(taken) == best_fit(histogram, 24)


def test_packing_of_odd_rows(odd, ids):
    rows = packing.pack(odd, PATH, 512).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows) == Counter(
        (ROWS[k][0], s, n, zlib.crc32(np.array(x[s : s + n], dtype="<u4").tobytes())) for k, x in ids.items() for s, n in packing.piece_bounds(len(x), 512)
    )
    taken = defaultdict(list)
    for r in rows:
        taken[r.sequence_id].append((r.offset, r.length))
    for slots in taken.values():
        ends = [0, *np.cumsum([n for _, n in sorted(slots)])]
        assert [o for o, _ in sorted(slots)] == ends[:-1] and ends[-1] <= 512
