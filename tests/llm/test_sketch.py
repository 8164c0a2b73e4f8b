import hashlib
import random

import numpy as np
import pyarrow as pa

from posegrid.llm import iblt


def brute_likeness(a: str, b: str) -> float:
    x, y = ({(d, r) for d, r in zip(*iblt.digests(pa.array([t])))} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def ring(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    return [(r, order[(i + 1) % len(order)]) for i, r in enumerate(order)]


def test_ring_edits_and_likeness(docs, rows, nothing):
    got = sorted((tuple(r) for r in iblt.fingerprints(docs).collect()), key=str)
    want = []
    for r, nxt in ring(rows):
        text, following = r[1] or "", nxt[1] or ""
        edit = iblt.edited(text, following)
        assert edit == text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        want.append((r[0], len(text), hashlib.sha256(edit.encode()).hexdigest(), round(brute_likeness(text, edit), 9), round(brute_likeness(text, following), 9)))
    assert sorted([(*r[:3], round(r[5], 9), round(r[6], 9)) for r in got], key=str) == sorted(want, key=str)
    assert iblt.fingerprints(nothing).count() == 0
    one = iblt.fingerprints(docs.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_many_ranges_give_the_same_rows(spark, docs):
    want = sorted(map(str, iblt.fingerprints(docs).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "90")
    try:
        assert sorted(map(str, iblt.fingerprints(docs).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_equal_texts_have_equal_fingerprints(docs, rows):
    by_text = {}
    for r in iblt.fingerprints(docs).collect():
        by_text.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert len(by_text[80]) == 1
    assert by_text[70] == by_text[71] == by_text[72]


def test_paragraphs_of_a_text():
    count = lambda t: len(iblt.digests(pa.array([t]))[0])
    assert [count(t) for t in ("", " \n ", "a", "a\nb", "A b. C d! E", "a\n\na\n", "x " * 45)] == [0, 0, 1, 2, 3, 2, 3]
    a, b = (iblt.digests(pa.array([t]))[0] for t in ("One two.\nThree", "Three\nOne two. "))
    assert set(a.tolist()) == set(b.tolist())
    # A text's digests do not depend on the texts beside it.
    alone = iblt.digests(pa.array(["b c.\nd"]))[0]
    both, row = iblt.digests(pa.array(["a", "b c.\nd", ""]))
    assert both[row == 1].tolist() == alone.tolist()


def test_peeling_recovers_the_difference():
    rng = np.random.default_rng(3)
    common, left, right = (rng.integers(1, 1 << 63, n, dtype=np.uint64) for n in (200, 9, 4))
    a, b = np.concatenate([common, left]), np.concatenate([common, right])
    zeros = lambda x: np.zeros(len(x), np.int64)
    cells = iblt.sketch(b, zeros(b), 1, 96, -1, iblt.sketch(a, zeros(a), 1, 96))
    n_left, n_right, full = iblt.peel(cells, 1, 96)
    assert (n_left[0], n_right[0], full[0]) == (9, 4, True)


def test_small_sketches_retry_larger():
    rng = random.Random(1)
    texts = [".\n".join(f"p{rng.randrange(10**9)}" for _ in range(n)) for n in (1, 30, 400, 2000)]
    other = [t[: len(t) // 2] + "\nnew" for t in texts]
    a, b = iblt.digests(pa.array(texts)), iblt.digests(pa.array(other))
    got = iblt.likeness(a, b, 4)
    assert np.allclose(got, [brute_likeness(x, y) for x, y in zip(texts, other)])
