import math
import random

import numpy as np
import pyarrow as pa
import pytest

from posegrid.llm import crossparse, factor, raking


def brute_phrases(sample: bytes, text: bytes) -> int:
    """Greedy longest phrases of ``text`` that occur in ``sample``, by substring search."""
    sample, text = bytes(crossparse.SYMBOLS[list(sample)]), bytes(crossparse.SYMBOLS[list(text)])
    total = i = 0
    while i < len(text):
        n = 0
        while i + n < len(text) and text[i : i + n + 1] in sample:
            n += 1
        i += n or 1
        total += 1
    return total


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))


@pytest.mark.parametrize("block", [3, 7, 64, 1024])
def test_phrases_equal_substring_search(block, monkeypatch):
    monkeypatch.setattr(crossparse, "BLOCK", block)
    rng = random.Random(5)
    sample = words(rng, "abcd", 80).encode()
    texts = ["", "a", "zzz", "abc", words(rng, "abcd", 10), words(rng, "abcdé", 600), words(rng, "xyz", 5), "A1 b2,c", sample.decode() * 2, "a" * 500]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = crossparse.rates((("x", sample),), np.frombuffer(data, np.uint8), offsets)[:, 0]
    want = [brute_phrases(sample, t.encode()) / max(1, len(t.encode())) for t in texts]
    assert np.allclose(got, want)


def test_languages_are_told_apart(spark, nothing):
    rng = random.Random(6)
    kinds = {"aa": "abcde", "bb": "cdefg", "cc": "éàüxy"}
    rows = [(i, words(rng, kinds[k], rng.randrange(10, 200)), k, "s", 0, "k", i, 1) for i, k in ((i, list(kinds)[i % 3]) for i in range(300))]
    rows += [(900, None, "aa", "s", 0, "k", 0, 1), (901, "", "aa", "s", 0, "k", 0, 1), (902, "123 !?", "aa", "s", 0, "k", 0, 1), (903, "日本", None, "s", 0, "k", 0, 1), (None, "abc abd", None, "s", 0, "k", 0, 1)]
    df = spark.createDataFrame(rows, nothing.schema).repartition(3)
    samples = crossparse.learn(df)
    assert [k for k, _ in samples] == list(kinds) and all(len(t) <= crossparse.SAMPLE_BYTES for _, t in samples)
    got = {r["doc_id"]: r for r in crossparse.identify(df, samples).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if r[0] is not None and r[0] < 300 and got[r[0]]["held_out"]]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.98 * len(held)
    assert all(got[i]["lang_pred"] == "und" for i in (900, 901, 902)) and got[903]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    import zlib

    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(300))
    assert crossparse.learn(df.union(df).union(df)) == samples  # repeated rows are sampled once
    small = crossparse.learn(df, total_bytes=600, most_languages=2)
    assert len(small) == 2 and all(len(t) <= 300 for _, t in small)
    assert crossparse.learn(nothing) == ()
    assert crossparse.identify(nothing, ()).count() == 0
    assert {r["lang_pred"] for r in crossparse.identify(df, ()).collect()} == {"und"}


def test_interactions_equal_all_pairs():
    rng = np.random.default_rng(2)
    m = factor.Machine(0.3, rng.standard_normal(factor.WIDTH).astype(np.float32), rng.standard_normal((factor.RANK, factor.WIDTH)).astype(np.float32))
    columns = rng.choice(factor.WIDTH, 12, replace=False).astype(np.int32)
    values = rng.random(12).astype(np.float32)
    want = m.bias + float(m.linear[columns] @ values)
    for i in range(12):
        for j in range(i):
            want += float(m.factors[:, columns[i]] @ m.factors[:, columns[j]]) * float(values[i]) * float(values[j])
    assert math.isclose(m.logits(np.zeros(12, np.int64), columns, values, 1)[0], want, rel_tol=1e-4)


def test_features_of_a_text_do_not_depend_on_others():
    one = factor.features(pa.array(["b b c. D\nE"]))
    row, column, value = factor.features(pa.array(["x", "b b c. D\nE", None, ""]))
    assert column[row == 1].tolist() == one[1].tolist() and np.allclose(value[row == 1], one[2])
    assert set(row.tolist()) == {0, 1, 2, 3}


def test_quality_of_held_out_rows(spark, nothing):
    rng = random.Random(8)
    good = lambda: (words(rng, "abcdefg", 80).capitalize() + ".")
    bad = lambda: rng.choice([lambda: words(rng, "abcdefg", 80).upper().replace(" ", "!! "), lambda: words(rng, "abcdefg", 80).replace(" ", "*** "), lambda: "same " * 100])()
    rows = [(i, good() if i % 4 else bad(), "en", "s", 0, "k", i, 1) for i in range(600)] + [(700, None, None, None, None, None, None, None), (701, "", "en", "s", 0, "k", 0, 0), (None, "a b", "en", "s", 0, "k", 0, 0)]
    df = spark.createDataFrame(rows, nothing.schema).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(600)] + [(5, 1, 0), (700, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in factor.score(df, factor.learn(df, labels)).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    held = [i for i in range(600) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == int(i % 4 > 0) for i in held) >= 0.97 * len(held)
    untrained = factor.score(df, factor.learn(df, labels.limit(0))).collect()
    assert len(untrained) == len(rows)
    assert factor.score(nothing, factor.untrained()).count() == 0
    kept = factor.score(df, factor.untrained(), keep=("key", "bucket")).collect()
    assert {(r["doc_id"], r["key"], r["bucket"]) for r in kept} == {(r[0], r[5], r[6]) for r in rows}


def test_raked_shares_meet_their_targets(spark, docs, rows, nothing):
    rng = random.Random(9)
    data = [(i, words(rng, "abc", rng.randrange(5, 60)), rng.choice(["en", "fr"]), rng.choice("pqr"), 0, "k", i, 1) for i in range(4000)]
    df = spark.createDataFrame(data, nothing.schema)
    targets = {"source": {"p": 0.2, "q": 0.3, "r": 0.5}, "lang": {"en": 0.7, "fr": 0.3}}
    got = raking.mix(df, targets=targets, budget=0.4).collect()
    whole = sum(r["n_tokens"] for r in got)
    for key, want in targets.items():
        for k, share in want.items():
            assert abs(sum(r["n_tokens"] * r["raked"] for r in got if r[key] == k) / whole - share) < 1e-3
            assert abs(sum(r["n_tokens"] * r["weight"] for r in got if r[key] == k and r["sampled"]) / whole - share) < 0.04
    assert abs(sum(r["n_tokens"] for r in got if r["sampled"]) / whole - 0.4) < 0.03
    edge = raking.mix(docs).collect()
    assert len(edge) == len(rows) and all(0 <= r["probability"] <= 1 for r in edge)
    assert raking.mix(nothing).count() == 0
    drawn = raking.sample(docs)
    assert drawn.columns == docs.columns
    chosen = {r["doc_id"] for r in edge if r["sampled"]}
    assert {r["doc_id"] for r in drawn.collect()} == chosen
