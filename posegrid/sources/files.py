"""File connectors: frame indexes, images, trees, joint parameters, recordings, packs and target sequences.

Folders of many small files are read by Spark's text, JSON and binary sources, so that any store that Spark reads
will do; decoding is by Arrow batches on the executors. A model file (a tree, parameters) is small and is read whole.
"""

from __future__ import annotations

import json
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship


def frame_index(spark: SparkSession, top: str, name: str) -> DataFrame:
    """(frame_id, path) of ``index.<name>``, in file order, blank lines dropped."""
    lines = spark.read.option("wholetext", True).text(f"{top}/index.{name}")
    rows = lines.select(F.posexplode(F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("frame_id", "path"))
    return rows


def frame_path(index: DataFrame, n: int) -> str | None:
    """Path of the nth frame, None past the end."""
    row = index.where(F.col("frame_id") == n).first()
    return row["path"] if row else None


def dataset_meta(spark: SparkSession, top: str) -> DataFrame:
    """One row: width, height, vertical_fov in radians, n_labels and labels."""
    schema = "camera struct<width:int,height:int,vertical_fov:double>, n_labels int, labels array<struct<name:string,opposite:string>>"
    m = spark.read.schema(schema).option("multiLine", True).json(f"{top}/meta.json")
    return m.select("camera.width", "camera.height", F.radians("camera.vertical_fov").alias("vertical_fov"), "n_labels", "labels")


def frame_bones(spark: SparkSession, top: str, index: DataFrame) -> DataFrame:
    """(frame_id, name, head, tail) of each frame's JSON."""
    schema = "bones array<struct<name:string,head:array<double>,tail:array<double>>>"
    files = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{top}/labels")
    at = F.regexp_extract(F.input_file_name(), r"/labels/(.*)\.json$", 1)
    return files.withColumn("path", at).join(index, "path").select("frame_id", F.explode("bones").alias("b")).select("frame_id", "b.*")


def frame_joints(bones: DataFrame, joint_map: DataFrame) -> DataFrame:
    """Joint positions by ``bone.head`` or ``bone.tail``; a frame without one of the joints is an error."""
    n = joint_map.count()
    ends = bones.select("frame_id", "name", F.explode(F.map_from_arrays(F.array(F.lit("head"), F.lit("tail")), F.array("head", "tail"))).alias("end", "p"))
    named = joint_map.select("joint_id", F.substring_index("joint", ".", 1).alias("name"), F.substring_index("joint", ".", -1).alias("end"))
    frames = bones.select("frame_id").distinct()
    found = ends.join(F.broadcast(named), ["name", "end"])  # a row a joint
    rows = frames.join(found, "frame_id", "left").select("frame_id", "joint_id", *[F.get("p", F.lit(k)).alias(c) for k, c in enumerate("xyz")])
    whole = F.count("*").over(Window.partitionBy("frame_id"))
    return rows.withColumn("n", whole).withColumn("x", F.when(F.col("n") == n, F.col("x")).otherwise(F.raise_error(F.lit("a frame lacks a joint")).cast("double"))).drop("n")


def png_grey(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and 8-bit samples of a grey or palette PNG without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    width, height, bits, colour, _, _, interlace = head
    if bits != 8 or colour not in (0, 3) or interlace:
        raise ValueError("only 8-bit grey or palette images are read")
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    out, above = np.zeros((height, width), np.uint8), np.zeros(width, np.int64)
    for y in range(height):
        how, line = int(lines[y, 0]), lines[y, 1:].astype(np.int64)
        if how == 1:
            line = np.cumsum(line) & 255
        elif how == 2:
            line = line + above & 255
        elif how in (3, 4):
            left = corner = 0
            for x in range(width):
                up = int(above[x])
                if how == 3:
                    guess = left + up >> 1
                else:
                    p = left + up - corner
                    guess = min(((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)))[2]
                left = line[x] = int(line[x]) + guess & 255
                corner = up
        out[y] = above = line
    return width, height, out


def write_png_grey(image: np.ndarray) -> bytes:
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    height, width = image.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), image.astype(np.uint8)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def label_images(spark: SparkSession, top: str, index: DataFrame) -> DataFrame:
    """(frame_id, width, height, labels) of each frame's PNG."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(f"{top}/labels")
    at = F.regexp_extract("path", r"/labels/(.*)\.png$", 1)
    rows = files.select(at.alias("path"), "content").join(index, "path").select("frame_id", "content")

    def decode(batches):
        for batch in batches:
            images = [png_grey(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[k] for m in images], pa.int32()) for k in (0, 1)), pa.array([m[2].ravel().tolist() for m in images], pa.list_(pa.int16()))], names=["frame_id", "width", "height", "labels"])

    return rows.mapInArrow(decode, "frame_id int, width int, height int, labels array<short>")


# PFM: the portable float map, beside which depth arrays live in Parquet.
def pfm(data: bytes) -> np.ndarray:
    head, body = data.split(b"\n", 3)[:3], data.split(b"\n", 3)[3]
    width, height = map(int, head[1].split())
    return np.frombuffer(body, "<f4" if float(head[2]) < 0 else ">f4").reshape(height, width)[::-1]


def write_pfm(image: np.ndarray) -> bytes:
    height, width = image.shape
    return b"Pf\n%d %d\n-1.0\n" % (width, height) + image[::-1].astype("<f4").tobytes()


# --- trees -------------------------------------------------------------------------------------------------------
#: Fixed values of the binary format: tag, version, header and node layout (u, v, threshold, 1-based table or 0).
TREE_TAG, TREE_VERSION = b"RDT", 6
_TREE_HEAD, _TREE_NODE = struct.Struct("<3sBBBBxff256s"), struct.Struct("<4ffI8x")


def tree_nodes(tree: dict) -> list[tuple]:
    """(node_id, u, v, t, is_leaf, pr) of a nested tree, children 2n+1 and 2n+2; an empty leaf is untrained."""
    out, todo = [], [(0, tree["root"])]
    while todo:
        k, node = todo.pop()
        if "p" in node:
            out.append((k, None, None, None, True, [float(x) for x in node["p"]]))
        elif "t" in node:
            out.append((k, [float(x) for x in node["u"]], [float(x) for x in node["v"]], float(node["t"]), False, None))
            todo += [(2 * k + 1, node["l"]), (2 * k + 2, node["r"])]
        else:
            out.append((k, None, None, None, True, None))
    return sorted(out)


TREE_SCHEMA = "tree int, node int, u array<double>, v array<double>, t double, is_leaf boolean, pr array<double>"


def read_trees(spark: SparkSession, texts: list[str]) -> DataFrame:
    """A forest from JSON texts; all trees must have the same number of labels."""
    trees = [json.loads(t) for t in texts]
    if len({t["n_labels"] for t in trees}) > 1:
        raise ValueError("trees of a forest have different numbers of labels")
    return spark.createDataFrame([(i, *n) for i, t in enumerate(trees) for n in tree_nodes(t)], TREE_SCHEMA)


def tree_json(nodes: DataFrame, meta: dict) -> str:
    """Nested JSON of one tree (a model of at most 2^depth nodes)."""
    rows = {r["node"]: r for r in nodes.collect()}

    def build(k: int) -> dict:
        r = rows[k]
        if r["is_leaf"]:
            return {"p": list(r["pr"])} if r["pr"] is not None else {}
        return {"t": r["t"], "u": list(r["u"]), "v": list(r["v"]), "l": build(2 * k + 1), "r": build(2 * k + 2)}

    depth = max((k + 1).bit_length() for k in rows)
    return json.dumps({"history": [], "bg_label": 0, "bg_depth": 32.0, **meta, "depth": depth, "root": build(0)})


def tree_binary(tree: dict, flip: list[int] | None = None) -> bytes:
    nodes = {n[0]: n for n in tree_nodes(tree)}
    depth = max((k + 1).bit_length() for k in nodes)
    head = _TREE_HEAD.pack(TREE_TAG, TREE_VERSION, depth, tree["n_labels"], tree.get("bg_label", 0), tree["vertical_fov"], tree.get("bg_depth", 32.0), bytes(flip or range(256)))
    body, tables = b"", []
    for k in range(2**depth - 1):
        _, u, v, t, leaf, pr = nodes.get(k, (k, None, None, None, True, None))
        if leaf and pr is not None:
            tables.append(pr)
            body += _TREE_NODE.pack(0, 0, 0, 0, 0, len(tables))
        elif leaf:
            body += _TREE_NODE.pack(0, 0, 0, 0, 0, 0x7FFFFFFF)
        else:
            body += _TREE_NODE.pack(*u, *v, t, 0)
    return head.ljust(272, b"\0") + body + b"".join(struct.pack(f"<{len(p)}f", *p) for p in tables)


def tree_from_binary(data: bytes) -> dict:
    tag, version, depth, n_labels, bg, fov, bg_depth, _ = _TREE_HEAD.unpack_from(data)
    if tag != TREE_TAG or version != TREE_VERSION:
        raise ValueError("no tree of this version")
    nodes = [_TREE_NODE.unpack_from(data, 272 + 32 * k) for k in range(2**depth - 1)]
    base = 272 + 32 * len(nodes)

    def build(k: int) -> dict:
        ux, uy, vx, vy, t, table = nodes[k]
        if table == 0x7FFFFFFF:
            return {}
        if table:
            return {"p": list(struct.unpack_from(f"<{n_labels}f", data, base + 4 * n_labels * (table - 1)))}
        return {"t": t, "u": [ux, uy], "v": [vx, vy], "l": build(2 * k + 1), "r": build(2 * k + 2)}

    return {"depth": depth, "n_labels": n_labels, "bg_label": bg, "vertical_fov": fov, "bg_depth": bg_depth, "root": build(0)}


def with_labels(tree: dict, names: list[str]) -> dict:
    """Older trees lack label names; they get them."""
    return tree if "labels" in tree else tree | {"labels": [{"name": n} for n in names]}


def flip_map(labels: list[dict]) -> list[int]:
    """Label to its opposite, by name; itself where it has none. A name that does not exist is an error."""
    at = {x["name"]: i for i, x in enumerate(labels)}
    return [at[x["opposite"]] if x.get("opposite") else i for i, x in enumerate(labels)]


# --- joint parameters, maps and targets --------------------------------------------------------------------------
def joint_params(spark: SparkSession, text: str, n_joints: int) -> DataFrame:
    p = json.loads(text)["params"]
    if len(p) != n_joints:
        raise ValueError("the parameters are of another joint map")
    return spark.createDataFrame([(i, float(x["bandwidth"]), float(x["threshold"]), float(x["offset"])) for i, x in enumerate(p)], "joint_id int, bandwidth double, threshold double, offset double")


def joint_params_json(params: DataFrame) -> str:
    rows = params.orderBy("joint_id").collect()  # a row a joint
    return json.dumps({"n_joints": len(rows), "params": [{"bandwidth": r["bandwidth"], "threshold": r["threshold"], "offset": r["offset"]} for r in rows]})


def joint_map(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(joint_id, joint), (joint_id, label) with at most two labels, and symmetric edges (a, b)."""
    joints = json.loads(text)
    at = {j["joint"]: i for i, j in enumerate(joints)}
    if any(len(j["labels"]) > 2 for j in joints):
        raise ValueError("a joint has more than two labels")
    edges = {(at[j["joint"]], at[c]) for j in joints for c in j.get("connections", [])}
    return (
        spark.createDataFrame([(i, n) for n, i in at.items()], "joint_id int, joint string"),
        spark.createDataFrame([(at[j["joint"]], k) for j in joints for k in j["labels"]], "joint_id int, label int"),
        spark.createDataFrame(sorted(edges | {(b, a) for a, b in edges}), "a int, b int"),
    )


def bone_tree(tree: dict) -> list[tuple]:
    """(idx, parent, name, head, tail, min, mean, max length) in pre-order; ends are lists of (joint, weight)."""
    out: list[tuple] = []

    def ends(b: dict, one: str, many: str) -> list[tuple]:
        return [(x["name"], float(x.get("weight", 1 / len(b[many])))) for x in b[many]] if many in b else [(b[one], 1.0)]

    def visit(b: dict, parent: int | None) -> None:
        k = len(out)
        if len(b.get("children", [])) > 4:
            raise ValueError("a bone has more than four children")
        out.append((k, parent, b["name"], ends(b, "head", "heads"), ends(b, "tail", "tails"), b.get("min_length"), b.get("mean_length"), b.get("max_length")))
        for c in b.get("children", []):
            visit(c, k)

    visit(tree, None)
    return out


def annotate_bones(tree: dict, lengths: DataFrame) -> dict:
    """A bone tree with the measured lengths (by name)."""
    found = {r["name"]: r for r in lengths.collect()}  # a row a bone

    def visit(b: dict) -> dict:
        r = found.get(b["name"])
        own = {k: r[k] for k in ("min_length", "mean_length", "max_length")} if r else {}
        return b | own | ({"children": [visit(c) for c in b["children"]]} if b.get("children") else {})

    return visit(tree)


def target_sequence(spark: SparkSession, path: str, n_joints: int) -> DataFrame:
    """(frame_no, timestamp, anchor_joint, joints); a frame with another number of joints is an error."""
    schema = "frames array<struct<timestamp:long,anchor_joint:int,joints:array<struct<x:double,y:double,z:double>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("frames").alias("frame_no", "f"))
    joints = F.when(F.size("f.joints") == n_joints, F.col("f.joints")).otherwise(F.raise_error(F.lit("a target has another number of joints")).cast("array<struct<x:double,y:double,z:double>>"))
    return rows.select("frame_no", "f.timestamp", F.coalesce("f.anchor_joint", F.lit(1)).alias("anchor_joint"), joints.alias("joints"))


# --- recordings and packs ----------------------------------------------------------------------------------------
RECORDING = "frames array<struct<timestamp:long,gravity:array<double>,pose:struct<orientation:array<double>,translation:array<double>,type:int>,depth_file:string,depth_len:long,video_file:string,video_len:long,camera_rotation:int>>"


def recording(spark: SparkSession, top: str, name: str) -> DataFrame:
    """Frames of a recording (its JSON is ``name``) with their depth buffers: frame_no, timestamp, ..., depth."""
    rows = spark.read.schema(RECORDING).option("multiLine", True).json(f"{top}/{name}")
    frames = rows.select(F.posexplode("frames").alias("frame_no", "f")).select("frame_no", "f.*")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(f"{top}/depth").select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("depth"))
    return frames.withColumn("name", F.element_at(F.split("depth_file", "/"), -1)).join(files, "name", "left").drop("name")


def write_pack(frames: DataFrame, path: str) -> None:
    """Append frames to a pack: Parquet, a column a section, snappy pages that are read lazily."""
    frames.write.mode("append").option("compression", "snappy").parquet(path)


def read_pack(spark: SparkSession, path: str, sections: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select("frame", *sections) if sections else rows


def half_floats(data: bytes) -> np.ndarray:
    """16-bit floats of a raw buffer as 32-bit ones."""
    return np.frombuffer(data, "<f2").astype(np.float32)


def decode_depth(data: bytes, kind: str) -> np.ndarray:
    """Metres from the raw formats: 16-bit millimetres, 32- or 16-bit float metres, and x, y, z, c points."""
    if kind == "Z_U16_MM":
        return np.frombuffer(data, "<u2").astype(np.float32) / 1000
    if kind == "Z_F16_M":
        return half_floats(data)
    values = np.frombuffer(data, "<f4")
    return values.reshape(-1, 4)[:, 2].copy() if kind == "POINTS_XYZC_F32" else values.copy()


#: Offsets of red, green and blue, and the bytes of a pixel, in each video format.
VIDEO = {"LUMINANCE_U8": (0, 0, 0, 1), "RGB_U8": (0, 1, 2, 3), "RGBX_U8": (0, 1, 2, 4), "RGBA_U8": (0, 1, 2, 4), "BGR_U8": (2, 1, 0, 3), "BGRX_U8": (2, 1, 0, 4), "BGRA_U8": (2, 1, 0, 4)}


def decode_video(data: bytes, kind: str) -> np.ndarray:
    r, g, b, size = VIDEO[kind]
    return np.frombuffer(data, np.uint8).reshape(-1, size)[:, [r, g, b]]


def field_of_view(pixels: int, focal: float) -> float:
    return 2 * math.atan(pixels / (2 * focal))


def joint_params_binary(params: list[tuple[float, float, float]]) -> bytes:
    """Packed bandwidth, threshold and offset of each joint, after their number."""
    return struct.pack("<I", len(params)) + b"".join(struct.pack("<3f", *p) for p in params)


def joint_params_from_binary(data: bytes) -> list[tuple[float, float, float]]:
    n = struct.unpack_from("<I", data)[0]
    if len(data) != 4 + 12 * n:
        raise ValueError("the parameters are cut short")
    return [struct.unpack_from("<3f", data, 4 + 12 * k) for k in range(n)]
