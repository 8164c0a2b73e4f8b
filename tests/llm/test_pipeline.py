import random
from collections import Counter

import corpus_pipeline
from posegrid.llm import factor, outliers, raking
from posegrid.llm.tokens import encoder, vocabulary

from .test_dedup import Union, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key_id string, component long, doc string, score double"


def tables(spark, folder, docs, labels):
    df = spark.createDataFrame(docs, SCHEMA)
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def one_of_each_group(rows):
    """Brute force over rows: for each group of near duplicates, the texts of its least id; texts without words apart."""
    sets, u = [shingles(r[1], 5) for r in rows], Union()
    for i, a in enumerate(sets):
        u.top(i)
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                u.join(i, j)
    groups = {}
    for i, a in enumerate(sets):
        groups.setdefault(u.top(i) if a else -1 - i, []).append(rows[i])
    return [{(r[0], r[1]) for r in g if r[0] == min((x[0] for x in g if x[0] is not None), default=None)} for g in groups.values()]


def test_stages_keep_columns_and_do_their_work(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n=150: "\n".join(" ".join(f"word{rng.randrange(3000)}" for _ in range(n // 3)).capitalize() + "." for _ in range(3))
    row = lambda i, t, lang="en", source="s0": (i, t, lang, source, 0, "k", 1, "d", None)
    clean = [row(i, text(), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(300)]
    copies = [row(300 + i, clean[i][1]) for i in range(20)] + [row(330 + i, clean[i][1].replace("word1", "wird1", 1)) for i in range(20)]
    copies += [row(2, clean[3][1]), row(7, clean[7][1]), row(7, clean[7][1]), row(None, clean[8][1]), row(None, text()), row(350, text(30_000))]
    junk = [row(400 + i, text().upper().replace(" ", "!! ")) for i in range(60)] + [row(480, None), row(481, "", None, None), row(482, "short")]
    labels = [(i, 1, 0) for i in range(0, 300)] + [(400 + i, 0, 0) for i in range(60)]
    docs, kept = tables(spark, tmp_path, clean + copies + junk, labels), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        rows = [tuple(r) for r in before.collect()]
        after = stage(spark, before, str(tmp_path))
        if name != "packing":
            assert after.columns == docs.columns
            after.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            kept[name] = Counter(tuple(r) for r in docs.collect())
            assert not kept[name] - Counter(rows)  # no row twice
        if name == "quality classifier":
            scores = factor.score(before, factor.learn(before, spark.read.parquet(f"{tmp_path}/labels.parquet")))
            good = Counter(r["doc_id"] for r in scores.where("predicted = 1").collect())
            assert Counter(r[0] for r in kept[name].elements()) == good
        if name == "quality rules":
            good = Counter(r["doc_id"] for r in outliers.judge(before).where("kept").collect())
            assert Counter(r[0] for r in kept[name].elements()) == good
        if name == "near-dedup":
            want = one_of_each_group(rows)
            left = Counter((r[0], r[1]) for r in kept[name].elements())
            assert sum(left.values()) == len(want)
            assert all(sum(left[k] for k in g) == 1 for g in want)
        if name == "mixing":
            drawn = Counter(r["doc_id"] for r in raking.mix(before).where("sampled").collect())
            assert Counter(r[0] for r in kept[name].elements()) == drawn
        if name == "packing":
            ids = Counter()
            for r in after.collect():
                ids[r["doc_id"]] += r["length"]
            want = Counter()
            for r in rows:
                want[r[0]] += len(encoder(vocabulary()).library.encode(r[1] or "", add_special_tokens=False).ids) + 1
            assert ids == want
    ids = {r[0] for r in kept["quality rules"]}
    assert not ids & set(range(400, 483)) and len(ids & set(range(300))) > 290
    assert 0 < sum(kept["mixing"].values()) < sum(kept["near-dedup"].values())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r[0] for r in kept["mixing"]}


def test_near_dedup_by_id_and_text(spark, tmp_path):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    row = lambda i, t: (i, t, None, None, None, None, None, None, None)
    rows = [row(2, a), row(2, b), row(1, b), row(7, c), row(7, c), row(7, c + " "), row(None, a), row(3, None), row(3, None), row(None, "")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    left = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert left[2, a] == left[1, b] == 1 and left[2, b] == left[None, a] == 0
    assert left[7, c] + left[7, c + " "] == 1
    assert left[3, None] == 2 and left[None, ""] == 1


def test_empty_tables_go_through(spark, tmp_path):
    tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
