import hashlib
import re
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from larkspur.llm import exact_dedup as x
from tests.llm.conftest import ROWS

norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@given(st.text(alphabet="ab \t\n\x0b\x0cé漢", max_size=60))
def test_normalise(text):
    assert x.normalise(text.encode()) == norm(text).encode()


@given(st.binary(max_size=9000), st.integers(0, 9000))
def test_fingerprints_compose(raw, cut):
    assert x.fingerprint(raw) == x.combine(x.fingerprint(raw[:cut]), x.fingerprint(raw[cut:]))


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(map(str, out))


def test_odd_rows(odd, none):
    rows = x.classes(odd).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in rows) == expected(ROWS)
    assert sorted(r.doc_id or 0 for r in rows if r.kept) == [0, 1, 2, 4, 6, 7]
    assert x.classes(none).count() == 0
    left = x.deduplicate(odd)
    assert left.columns == odd.columns and left.count() == 6
    assert x.deduplicate(none).count() == 0


@pytest.mark.parametrize("per_task", [2, 512])
def test_colliding_fingerprints_are_told_apart(spark, monkeypatch, per_task):
    monkeypatch.setattr(x, "COPIES_PER_TASK", per_task)

    def flat(docs):  # every text gets the same fingerprint
        F = x.F
        text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
        return docs.select("doc_id", F.lit(1).cast("long").alias("h0"), F.lit(2).cast("long").alias("h1"), F.lit(3).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), x.text_hash().alias("text_hash"))

    monkeypatch.setattr(x, "_hashed", flat)
    rows = [(k, f"text {k % 4}", None, None) for k in range(20)]
    got = x.classes(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == expected(rows)


@pytest.mark.parametrize("piece,compare", [(64, 100), (1, 7)])
def test_huge_texts_are_hashed_in_pieces(spark, monkeypatch, piece, compare):
    monkeypatch.setattr(x, "HUGE_BYTES", 100)
    monkeypatch.setattr(x, "PIECE_BYTES", piece)
    monkeypatch.setattr(x, "COMPARE_BYTES", compare)
    long = "a  b\t\n c é 漢 " * 30
    rows = [(1, long), (2, long.replace("  ", " \n ")), (3, long + "."), (4, "short"), (5, long + "."), (6, None), (None, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = x._fingerprints(docs).collect()
    assert {r.doc_id: (r.h0, r.h1, r.n_bytes) for r in hashed} == {i: x.fingerprint(norm(t).encode()) for i, t in rows}
    got = x.classes(docs).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == expected([(i, t, None, None) for i, t in rows])
