import random
import re

import numpy as np
import pytest

from posegrid.llm import bayeslsh
from posegrid.llm.graph import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def shingles(text, n=4):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


class Union(dict):
    def top(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = x = self[self[x]]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self[max(a, b)] = min(a, b)


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    u = Union()
    for k, (i, a) in enumerate(sets):
        u.top(i)
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                u.join(i, j)
    return {i: (len(s), u.top(i)) for i, s in sets}


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = bayeslsh.near_duplicates(df, words=4, **options).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["component_id"] == r["doc_id"])
        else:
            assert r["component_id"] is None and r["kept"]


def test_edge_cases(spark, docs, rows, nothing):
    got = {r["doc_id"]: r for r in bayeslsh.near_duplicates(docs, words=4).collect()}
    want = brute([(r[0], r[1]) for r in rows])
    assert {i: (got[i]["n_shingles"], got[i]["component_id"]) for i in want} == want
    assert bayeslsh.near_duplicates(docs, words=4).count() == len(rows)
    assert bayeslsh.near_duplicates(nothing, words=4).count() == 0


@pytest.mark.parametrize("block", [8, 256])
def test_groups_without_a_clear_centre(spark, block):
    """Edited copies of edited copies: links that no hub has must still be found, in small blocks as in large ones."""
    rng, rows = random.Random(7), []
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = [base]
    for _ in range(60):
        own = list(rng.choice(texts))
        for _ in range(rng.randrange(1, 5)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        texts.append(own)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, " ".join(t)) for i, t in enumerate(texts[:5])]
    rows += [(200 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(40))) for i in range(20)]
    rng.shuffle(rows)
    check(spark, rows, block=block)


def test_least_matches_bound_the_miss_rate():
    rng, k = np.random.default_rng(1), 128
    least = bayeslsh.least_matches(80, 100, 16, k, 1e-3)
    a = rng.integers(0, 1 << 30, (20_000, k), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, a + 1)
    assert (bayeslsh.survives(a, b, least) < 0).mean() < 8e-3
    far = np.where(rng.random(a.shape) < 0.4, a, a + 1)
    assert (bayeslsh.survives(a, far, least) >= 0).mean() < 1e-3


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(200, 200), (300, 301), (301, 300), (None, 5), (7, None)]
    edges += [(400 + rng.randrange(60), 400 + rng.randrange(60)) for _ in range(50)]
    u = Union()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            u.join(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: u.top(x) for x in list(u)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ids_with_several_texts_and_rows_without_ids(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(2, a), (2, b), (1, b), (7, c), (7, c), (None, c), (None, a + " x"), (None, "d e f g h i"), (None, "d e f g h i"), (9, None), (9, "")]
    got = sorted(map(str, ((r["doc_id"], r["component_id"], r["kept"]) for r in bayeslsh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    want = [(2, 2, True), (2, 1, False), (1, 1, True), (7, 7, True), (7, 7, True), (None, 7, False), (None, 2, False), (None, None, True), (None, None, True), (9, 9, True), (9, 9, True)]
    assert got == sorted(map(str, want))


def test_one_large_group_around_no_centre(spark):
    """Copies of a page whose variants drift apart in four directions, beside a class of many equal rows."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for way in range(4):
        text = list(base)
        for i in range(60):
            text[(way * 30 + i) % 120] = f"v{way}x{i}"
            own = list(text)
            own[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(1000 + i, " ".join(base)) for i in range(150)]
    check(spark, rows)
