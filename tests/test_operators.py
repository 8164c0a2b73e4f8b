"""Micro-fixtures with results worked out by hand, and invariants."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from posegrid.functions import geometry as g
from posegrid.operators import cluster, evaluate, forest, history, imaging, skeleton
from posegrid.sources import files
from posegrid.streaming import codebook, people, run


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_scalars(spark):
    assert [value(spark, g.ladder_step(F.lit(k))) for k in range(5)] == [0, 1, -1, 2, -2]
    assert [value(spark, g.node_depth(F.lit(k))) for k in (0, 1, 2, 3, 6, 7)] == [0, 1, 1, 2, 2, 3]
    assert value(spark, g.signed_power(F.lit(-3.0), 2.0)) == -9.0
    assert [round(value(spark, g.decayed(F.lit(x), 100.0, 1.0)), 6) for x in (50.0, -100.0, 125.0, 200.0, 900.0)] == [50.0, -100.0, 150.0, 200.0, 200.0]
    assert forest.threshold_ladder(5, 0.4) == [0.0, 0.2, -0.2, 0.4, -0.4]
    assert len(forest.threshold_ladder(4, 0.4)) == 5
    assert imaging.xorshift_table(3) == [270369, 67634689, 2647435461]


def test_projection_is_the_inverse_of_unprojection(spark):
    x, y = g.unproject(F.lit(3.0), F.lit(6.0), F.lit(2.5))
    u, v = g.project(x, y, F.lit(2.5))
    assert value(spark, u) == pytest.approx(3.0) and value(spark, v) == pytest.approx(6.0)


def test_quaternions(spark):
    q = lambda *v: [F.lit(float(x)) for x in v]
    h = math.sqrt(0.5)
    both = [value(spark, c) for c in g.quat_mul(q(h, h, 0, 0), q(h, h, 0, 0))]
    assert both == pytest.approx([0, 1, 0, 0])
    assert value(spark, g.quat_angle(q(1, 0, 0, 0), q(h, h, 0, 0))) == pytest.approx(90.0)
    half = [value(spark, c) for c in g.slerp(q(1, 0, 0, 0), q(h, h, 0, 0), F.lit(0.5))]
    assert half == pytest.approx([math.cos(math.pi / 8), math.sin(math.pi / 8), 0, 0])
    m = [value(spark, c) for c in g.pose_matrix(q(h, h, 0, 0), q(1, 2, 3))]
    assert m == pytest.approx([1, 0, 0, 1, 0, 0, -1, 2, 0, 1, 0, 3])


def test_mirror_twice_is_the_image(spark):
    img = list(map(float, range(64)))
    df = spark.createDataFrame([(img,)], "depth array<double>")
    assert df.select(forest.mirrored(forest.mirrored(F.col("depth"))).alias("d")).first()["d"] == img


def test_culling(spark):
    z = spark.createDataFrame([(0.4,), (1.0,), (4.0,), (float("nan"),), (None,)], "z double")
    assert [r[0] for r in z.select(imaging.near_far(F.col("z"), 0.5, 3.5, True)).collect()] == [None, 1.0, 3.5, None, None]
    assert [r[0] for r in z.select(imaging.near_far(F.col("z"), 0.5, 3.5, False)).collect()] == [None, 1.0, None, None, None]
    assert [r[0] for r in z.where("z > 0 and not isnan(z)").select(imaging.to_millimetres(F.col("z") * 300)).collect()] == [120000, 300000, 32000]


def picture(spark, rows):
    flat = [1.0 if c == "#" else 0.0 for r in rows for c in r.ljust(8, ".")] + [0.0] * (64 - 8 * len(rows))
    return spark.createDataFrame([(1, flat)], "frame_id long, depth array<double>")


def test_components_merge_late_and_not_over_corners(spark):
    got = {r["i"]: r["root"] for r in cluster.components(picture(spark, ["#.#.....", "#.#.....", "###..#..", "......#."]), 0.5).collect()}
    assert {got[i] for i in (0, 2, 8, 10, 16, 17, 18)} == {0}
    assert got[21] == 21 and got[30] == 30
    assert len(got) == 9


def test_flood_takes_nearer_pixels_and_keeps_below_its_seed(spark):
    depth = [2.0] * 64
    depth[20], depth[21], depth[28] = 2.5, 2.0, 1.0
    got = {r["i"] for r in cluster.flood(spark.createDataFrame([(1, depth)], "frame_id long, depth array<double>"), 0.1, 19).collect()}
    assert 20 not in got and 28 in got and not any(i < 16 for i in got)


def test_tree_growth_conserves_samples_and_leaf_shares(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(v[0] > v[1]) + 2 * int(v[2] > 0.5), [float(x) for x in v]) for i, v in enumerate(rng.random((400, 4)))]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    nodes = [r.asDict() for r in forest.train_tree(df, [(0, 1), (2, 3), (1, 2)], [0.0, 0.2, -0.2], 4).collect()]
    by = {r["node"]: r for r in nodes}
    assert by[0]["n"] == 400 and not by[0]["is_leaf"]
    for r in nodes:
        assert sum(r["pr"].values()) == pytest.approx(1.0)
        if not r["is_leaf"]:
            assert by[2 * r["node"] + 1]["n"] + by[2 * r["node"] + 2]["n"] == r["n"]
    assert forest.pruned(spark.createDataFrame([(0, 1, 1, 0.5, False), (1, None, None, None, True), (2, None, None, None, True)], "node long, c int, t int, gain double, is_leaf boolean"), 1).collect()[0]["is_leaf"]


def test_accuracy_summary_takes_the_upper_median(spark):
    df = spark.createDataFrame(list(enumerate([0.2, 0.4, 0.6, 1.0])), "frame_id long, accuracy double")
    r = evaluate.accuracy_summary(df).first()
    assert (r["median"], r["worst"], r["best"]) == (0.6, 0.2, 1.0)
    assert {x["bucket"] for x in evaluate.accuracy_histogram(df).collect()} == {10, 20, 30, 49}


def test_argmax_takes_the_first(spark):
    assert value(spark, evaluate.argmax_label(F.array(*[F.lit(x) for x in (0.1, 0.4, 0.4)]))) == 1


def test_frames_must_differ_from_the_last_kept(spark):
    df = spark.createDataFrame([(1, i, i, d) for i, d in enumerate([1.0, 1.0, 2.0, 2.001, 3.0])], "key long, event_id long, us long, depth double")
    assert [r["event_id"] for r in history.changed_frames(df, 0.01).orderBy("us").collect()] == [0, 2, 4]


def test_brackets_and_ends(spark):
    frames = spark.createDataFrame([(1, 1000, 1.0), (1, 1100, 2.0), (1, 1200, 4.0)], "key long, us long, depth double")
    asked = spark.createDataFrame([(1, i, t) for i, t in enumerate([950, 1050, 1100, 1150, 1400])], "key long, request_id long, us long")
    got = {r["request_id"]: r["depth"] for r in history.bracketed(asked, frames).collect()}
    assert got == {0: 1.0, 1: 1.5, 2: 2.0, 3: 3.0, 4: 4.0}


def test_codeword_runs_count_from_the_second_match():
    seen = {1, 2, 4, 5, 6, 8}
    words, frames = codebook.fold([], 0, [(i, "view", 1.0 if i in seen else 9.0 + i) for i in range(1, 11)], codebook.Rules())
    word = next(w for w in words if abs(w[0] - 1.0) < 0.01)
    assert (word[1], word[4], frames) == (6, 2, 10)
    assert codebook.fold(words, frames, [(11, "error", 0.0)], codebook.Rules()) == ([], 0)
    assert codebook.fold([], 0, [(1, "none", 1.0)], codebook.Rules()) == ([], 0)


def test_people_expire_and_are_capped():
    rules = people.Rules(reach=0.5, idle_us=100, most=2)
    found, _ = people.fold([], 0, [(1, 1.0), (2, 5.0), (3, 1.1), (4, 9.0), (5, 5.1)], rules)
    assert [p[0] for p in found] == [0, 1]
    found, _ = people.fold(found, 3, [(200, 3.0)], rules)
    assert [p[0] for p in found] == [3]


def test_stream_state_goes_on_over_micro_batches(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i), i % 3, ("view", "click", "error")[i % 7 == 6 and 2 or i % 2], 100.0 + i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    for k in range(3):
        df.where(f"event_id div 20 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    frames = run.event_frames(spark, f"{tmp_path}/e", files_per_batch=1)
    batch = df.select(F.col("user_id").alias("key"), "event_id", F.unix_micros("ts").alias("us"), F.col("event_type").alias("kind"), (F.col("value") / 100).alias("depth"))
    got = run.newest(run.drained(codebook.stream_codebook(frames)), ["key"])
    assert got.select(F.max("frames")).first()[0] is not None
    want = codebook.batch_codebook(batch)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_association_is_greedy_in_order(spark):
    a = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.1)], "grp long, person long, px double")
    b = spark.createDataFrame([(1, 7, 0.1), (1, 8, 0.4), (1, 9, 5.0)], "grp long, skeleton long, sx double")
    assert {(r["person"], r["skeleton"]) for r in skeleton.associate(a, b, 0.5).collect()} == {(1, 7), (2, 8)}


def test_rings_are_searched_without_a_join(spark):
    """A join could broadcast one side: pixels or places of all frames, on the driver."""
    rng = np.random.default_rng(4)
    rows = [(f, i, i % 8, i // 8, f % 8, f // 8 % 8, bool(rng.random() < 0.03)) for f in range(80) for i in range(64)]
    df = spark.createDataFrame(rows, "frame_id long, i int, x int, y int, sx long, sy long, body boolean")
    found = skeleton.ring_search(df, 2)
    want = {}
    for f, i, x, y, sx, sy, body in rows:
        if body and (ring := max(abs(x - sx), abs(y - sy))) <= 2:
            want[f] = min(want.get(f, (9, 0)), (ring, i))
    assert {r["frame_id"]: (r["ring"], r["i"]) for r in found.collect()} == want and 0 < len(want) < 80
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and "Broadcast" not in plan


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_previous_joint_search_broadcasts_nothing(spark):
    from posegrid.plans import catalogue

    plan = catalogue.queries()["previous_joint_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_tidy_gives_native_memory_back(spark, monkeypatch):
    from posegrid import session

    real, said = session.trim, []
    monkeypatch.setattr(session, "trim", lambda s: said.append(real(s)))
    session.tidy(spark)
    assert said == [True]


TREE = {"depth": 2, "n_labels": 2, "vertical_fov": 0.5, "bg_label": 0, "bg_depth": 32.0, "root": {"t": 0.25, "u": [1.0, 0.0], "v": [0.0, -0.5], "l": {"p": [0.25, 0.75]}, "r": {}}}


def test_trees_round_trip(spark):
    assert files.tree_from_binary(files.tree_binary(TREE)) == TREE
    assert len(files.tree_binary(TREE)) == 272 + 3 * 32 + 8
    nodes = files.read_trees(spark, [json.dumps(TREE)])
    text = files.tree_json(nodes.drop("tree"), {k: TREE[k] for k in ("n_labels", "vertical_fov")})
    assert json.loads(text)["root"] == TREE["root"]
    with pytest.raises(ValueError):
        files.read_trees(spark, [json.dumps(TREE), json.dumps(TREE | {"n_labels": 3})])
    with pytest.raises(ValueError):
        files.tree_from_binary(b"XXX" + files.tree_binary(TREE)[3:])


def test_images_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    img = rng.integers(0, 255, (5, 7), dtype=np.uint8)
    assert np.array_equal(files.png_grey(files.write_png_grey(img))[2], img)
    depth = rng.random((4, 6)).astype(np.float32)
    assert np.array_equal(files.pfm(files.write_pfm(depth)), depth)
    (tmp_path / "labels/a").mkdir(parents=True)
    (tmp_path / "labels/a/f0.png").write_bytes(files.write_png_grey(img))
    (tmp_path / "labels/a/f0.json").write_text(json.dumps({"bones": [{"name": "neck", "head": [1, 2, 3], "tail": [4, 5, 6]}]}))
    (tmp_path / "index.test").write_text("a/f0\n\n")
    (tmp_path / "meta.json").write_text(json.dumps({"camera": {"width": 7, "height": 5, "vertical_fov": 90.0}, "n_labels": 2, "labels": [{"name": "l", "opposite": "r"}, {"name": "r"}]}))
    index = files.frame_index(spark, str(tmp_path), "test")
    assert [tuple(r) for r in index.collect()] == [(0, "a/f0")] and files.frame_path(index, 1) is None
    r = files.label_images(spark, str(tmp_path), index).first()
    assert (r["width"], r["height"], r["labels"]) == (7, 5, img.ravel().tolist())
    assert files.dataset_meta(spark, str(tmp_path)).first()["vertical_fov"] == pytest.approx(math.pi / 2)
    joints = spark.createDataFrame([(0, "neck.head"), (1, "neck.tail")], "joint_id int, joint string")
    found = files.frame_joints(files.frame_bones(spark, str(tmp_path), index), joints).orderBy("joint_id").collect()
    assert [(x["x"], x["y"], x["z"]) for x in found] == [(1, 2, 3), (4, 5, 6)]


def test_maps_and_parameters(spark):
    assert files.flip_map([{"name": "l", "opposite": "r"}, {"name": "r", "opposite": "l"}, {"name": "m"}]) == [1, 0, 2]
    with pytest.raises(KeyError):
        files.flip_map([{"name": "l", "opposite": "gone"}])
    _, _, edges = files.joint_map(spark, json.dumps([{"joint": "a.head", "labels": [1], "connections": ["b.tail"]}, {"joint": "b.tail", "labels": [2, 3]}]))
    assert {tuple(r) for r in edges.collect()} == {(0, 1), (1, 0)}
    p = files.joint_params(spark, json.dumps({"params": [{"bandwidth": 0.1, "threshold": 0.2, "offset": 0.3}]}), 1)
    assert json.loads(files.joint_params_json(p))["params"][0]["threshold"] == 0.2
    with pytest.raises(ValueError):
        files.joint_params(spark, json.dumps({"params": []}), 1)
    bones = files.bone_tree({"name": "root", "head": "a", "tail": "b", "children": [{"name": "x", "head": "b", "tails": [{"name": "c"}, {"name": "d"}]}, {"name": "y", "head": "b", "tail": "e"}]})
    assert [(b[0], b[1], b[2]) for b in bones] == [(0, None, "root"), (1, 0, "x"), (2, 0, "y")] and bones[1][4] == [("c", 0.5), ("d", 0.5)]


def test_raw_buffers():
    assert files.decode_depth(np.array([1500], "<u2").tobytes(), "Z_U16_MM").tolist() == [1.5]
    assert files.decode_depth(np.array([1.5], "<f2").tobytes(), "Z_F16_M").tolist() == [1.5]
    assert files.decode_depth(np.array([1, 2, 3, 4], "<f4").tobytes(), "POINTS_XYZC_F32").tolist() == [3.0]
    assert files.decode_video(bytes([1, 2, 3, 9]), "BGRX_U8").tolist() == [[3, 2, 1]]
    assert files.decode_video(bytes([5]), "LUMINANCE_U8").tolist() == [[5, 5, 5]]


def test_packs_append(spark, tmp_path):
    path = f"{tmp_path}/pack"
    for k in range(2):
        files.write_pack(spark.createDataFrame([(k, bytearray(b"l"), bytearray(b"d"))], "frame long, labels binary, depth binary"), path)
    assert files.read_pack(spark, path, ["depth"]).columns == ["frame", "depth"] and files.read_pack(spark, path).count() == 2


def test_packed_parameters():
    p = [(0.5, 0.25, 0.125), (1.0, 2.0, 3.0)]
    assert files.joint_params_from_binary(files.joint_params_binary(p)) == p
    with pytest.raises(ValueError):
        files.joint_params_from_binary(files.joint_params_binary(p)[:-1])


def test_properties_keep_their_ranges():
    from posegrid.config import TrainerProperties

    p = TrainerProperties()
    assert p.load('{"max_depth": 5, "nothing": 1}') == ["nothing"] and p.max_depth == 5
    with pytest.raises(ValueError):
        p.set("max_depth", 31)
    assert json.loads(p.dump())["n_thresholds"] == 49


def test_short_api(spark):
    from posegrid import api
    from posegrid.config import TrainerProperties

    rng = np.random.default_rng(3)
    rows = [(i, int(v[0] > 0), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(200, 64)))]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    trainer = api.TreeTrainer(TrainerProperties(n_uvs=20, n_thresholds=5, max_depth=3, uv_range=64.0))
    nodes = trainer.train(df)
    pr = nodes.select(F.lit(0).alias("tree"), "node", "c", "t", F.array(*[F.coalesce(F.try_element_at("pr", F.lit(k)), F.lit(0.0)) for k in (0, 1)]).alias("pr"))
    uv, cuts = trainer.candidates(64)
    got = {r["vec_id"]: r["label"] for r in api.Forest(pr, uv, cuts, 3).labels(df).collect()}
    assert len(got) == 200
    assert sum(got[i] == label for i, label, _ in rows) > 110
