"""Near duplicates: banded MinHash candidates, sequential Bayesian pruning, exact confirmation.

A document's set holds the hashes of its distinct word shingles (A-Z lower-cased; with fewer words than a shingle,
the whole sequence is one). Documents of equal sets form a class; its smallest id stands for it. Classes that share
a band of their signatures are candidates. The member of most shared bands is the hub of each bucket: every other
member is compared with its hub, which joins most of a group at linear cost. Where members of a hub's group are
still apart, those outside the hub's component are compared with all members of other components, in blocks, so no
candidate pair that could join two components goes untested. A pair is compared a batch of hash values at a time,
and dropped once the posterior probability that its similarity reaches the threshold (uniform prior) falls below
``miss``; survivors are confirmed on full sets.

Null or empty texts have no set and link with nothing. Rows that repeat an id with another text are documents of
their own. Rows without an id link like others: they go if a member of their component has an id; if none has,
component_id is null and one class of equal sets stays. Equal rows are kept or dropped alike. Extra columns are not
read. An empty table gives no rows.

Hot keys: a class's rows meet in one aggregate with map-side combine, and find their component by a broadcast of the
classes that hold over a thousandth of all rows (so a thousand at most), all others by a shuffled join.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, mixed, settle, text_bytes, text_slices, word_hashes
from .graph import connected_components

BANDS, ROWS, BATCH, MISS, BLOCK = 32, 4, 16, 1e-7, 256
_SEEDS = np.random.default_rng(20240229)
_XOR = _SEEDS.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_TIMES = _SEEDS.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_STEP = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts, sorted within each, and len+1 offsets."""
    data, offsets = text_bytes(texts)
    hashes, at = word_hashes(data, offsets)
    sets = []
    if len(hashes) >= words:
        window = mixed(sum(hashes[i : len(hashes) - words + 1 + i] * _STEP[i] for i in range(words)))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            sets.append(np.unique(window[a : b - words + 1]))
        elif b > a:
            sets.append(mixed(np.sum(hashes[a:b] * _STEP[: b - a], keepdims=True) + np.uint64(b - a)))
        else:
            sets.append(hashes[:0])
    return np.concatenate(sets) if sets else hashes[:0], np.cumsum([0, *map(len, sets)])


@lru_cache
def least_matches(num: int, den: int, batch: int, most: int, miss: float) -> list[int]:
    """After each batch of n values, the fewest matches whose posterior of similarity >= num/den is at least ``miss``.

    With a uniform prior the posterior is Beta(m+1, n-m+1), and its upper tail at s is a binomial sum over n+1.
    """
    s, out = num / den, []
    for n in range(batch, most + 1, batch):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def survives(a: np.ndarray, b: np.ndarray, least: list[int], batch: int = BATCH) -> np.ndarray:
    """Rows of the signature pairs that no batch prunes, with their match counts (-1: pruned)."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, fewest in enumerate(least):
        part = slice(i * batch, (i + 1) * batch)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        out = matches[alive] < fewest
        matches[alive[out]] = -1
        alive = alive[~out]
    return matches


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """den * intersection >= num * union, on sorted distinct hashes."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if den * len(small) < num * len(large):
        return False
    spot = np.searchsorted(large, small)
    both = int(np.count_nonzero(large[np.minimum(spot, len(large) - 1)] == small))
    return den * both >= num * (len(x) + len(y) - both)


def _sketches(words: int):
    def sketch(batches):
        for part in text_slices(batches):
            hashes, at = shingle_sets(part.column(1), words)
            full = np.flatnonzero(np.diff(at))
            n = part.num_rows
            signature, keys = np.zeros((n, BANDS * ROWS), np.uint32), np.zeros((2, n), np.uint64)
            if len(full):
                starts, short = at[:-1][full], (hashes >> np.uint64(32)).astype(np.uint32)
                for i in range(BANDS * ROWS):
                    signature[full, i] = np.minimum.reduceat((short ^ _XOR[i]) * _TIMES[i], starts)
                for i in range(2):
                    keys[i, full] = np.add.reduceat(mixed(hashes ^ _STEP[i]), starts)
            bands = mixed((signature.reshape(n, BANDS, ROWS).astype(np.uint64) * _STEP[:ROWS]).sum(axis=2) + _STEP[:BANDS])
            rows = np.arange(0, n + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(np.diff(at).astype(np.int64)), *(pa.array(k.view(np.int64)) for k in keys),
                 pa.array([s.tobytes() for s in signature], pa.binary()), pa.ListArray.from_arrays(pa.array(rows * BANDS), pa.array(bands.view(np.int64).ravel()))],
                names=["doc_id", "own", "n_shingles", "key1", "key2", "signature", "bands"])

    return sketch


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), BANDS * ROWS)


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """What tells documents apart, null-safe: the id and a digest of the text."""
    return [F.coalesce(doc_id.cast("string"), F.lit("")).alias("key_id"), F.xxhash64(text).alias("key_text")]


def _grows(df: DataFrame) -> DataFrame:
    """A side that grows with the documents: sort-merge at every size, as no estimate may make it a broadcast."""
    return df.hint("merge")


def _texts(rows: DataFrame, nodes: DataFrame, wanted: DataFrame, grows: bool = False) -> DataFrame:
    """(node, text) of the ``wanted`` nodes, found once and written, so that no later join moves other texts."""
    keys = settle(nodes.select("node", "rep.*").join(wanted.distinct(), "node"), "wanted")
    keys = _grows(keys) if grows else keys
    found = rows.select(*row_key(F.col("doc_id"), F.col("text")), "text").join(keys, ["key_id", "key_text"])
    return settle(found.groupBy("node").agg(F.first("text").alias("text")), "texts")


def _text_of(texts: DataFrame, node: str, text: str) -> DataFrame:
    return texts.select(F.col("node").alias(node), F.col("text").alias(text))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links of similarity >= num/den), kept."""
    return grouped(docs, **options).select("doc_id", "n_shingles", "component_id", "kept")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100, miss: float = MISS, block: int = BLOCK, keep: list | tuple = ()) -> DataFrame:
    """``keep``, doc_id, n_shingles, component (a number; null: linked with no other row), component_id, kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(F.lit(0), *keep).alias("own"), F.struct(*row_key(F.col(id_col).cast("long"), F.col(text_col).cast("string"))).alias("rep"))
    own = rows.select(F.struct("own", "rep").alias("own")).schema["own"].dataType.simpleString()
    given = rows.select("doc_id", "text", F.struct("own", "rep").alias("own"))
    sketches = settle(given.mapInArrow(_sketches(words), f"doc_id long, own {own}, n_shingles long, key1 long, key2 long, signature binary, bands array<long>").select("doc_id", "own.*", "n_shingles", "key1", "key2", "signature", "bands"), "sketches")
    keys = ["key1", "key2", "n_shingles"]
    # Equal sets have equal signatures; any row of a class can stand for its text.
    classes = sketches.where("n_shingles > 0").groupBy(*keys).agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n_rows"), F.min("rep").alias("rep"), F.first(F.struct("signature", "bands")).alias("s"))
    nodes = settle(classes.select(F.monotonically_increasing_id().alias("node"), *keys, "least_id", "n_rows", "rep", "s.*"), "nodes")

    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    crowded = settle(banded.join(_grows(shared), "bucket"), "buckets")
    degree = crowded.groupBy("node").agg(F.sum("n").alias("degree"))
    hubs = crowded.join(_grows(degree), "node").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("node")).alias("node"))).alias("hub")).select("bucket", (-F.col("hub.node")).alias("hub"))
    pairs = settle(crowded.join(_grows(hubs), "bucket").where("node != hub").select("hub", "node").distinct(), "pairs")

    least = least_matches(num, den, BATCH, BANDS * ROWS, miss)
    signed = nodes.select("node", "signature")
    tested = pairs.join(_grows(signed), "node").join(_grows(signed.select(F.col("node").alias("hub"), F.col("signature").alias("other"))), "hub")

    def prune(batches):
        for batch in batches:
            if batch.num_rows:
                hit = survives(_signatures(batch.column(2)), _signatures(batch.column(3)), least) >= 0
                yield batch.select(["hub", "node"]).filter(pa.array(hit))

    survivors = settle(tested.select("hub", "node", "signature", "other").mapInArrow(prune, "hub long, node long"), "survivors")
    wanted = _texts(rows, nodes, survivors.select(F.explode(F.array("hub", "node")).alias("node")), grows=True)

    def confirm(batches):
        kept: tuple = (None, None)
        for part in text_slices(batches, 2):
            own, at = shingle_sets(part.column(2), words)
            others, good = part.column(3), []
            for i, hub in enumerate(part.column(0).to_pylist()):
                text = others[i].as_py()
                if kept[0] != (hub, text):
                    kept = ((hub, text), shingle_sets(pa.array([text], pa.string()), words)[0])
                good.append(similar(own[at[i] : at[i + 1]], kept[1], num, den))
            yield part.select(["hub", "node"]).filter(pa.array(good, pa.bool_()))

    texts = survivors.join(_grows(_text_of(wanted, "node", "text")), "node").join(_grows(_text_of(wanted, "hub", "other")), "hub").select("hub", "node", "text", "other")
    links = settle(texts.mapInArrow(confirm, "hub long, node long"), "links")
    rest = settle(_rest_links(rows, nodes, pairs, connected_components(links, "hub", "node"), signed, least, words, num, den, block), "rest-links")
    found = connected_components(links.union(rest), "hub", "node")

    discard(crowded, wanted)

    placed = nodes.select("node", *keys, "least_id", "n_rows").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = placed.groupBy("component").agg(F.min("least_id").alias("component_id"), F.sum("n_rows").alias("of_component")).where("of_component > 1")
    placed = settle(placed.join(whole, "component").select(*keys, "n_rows", "component", "component_id", (F.col("node") == F.col("component")).alias("leads")), "placed")
    hot = F.col("n_rows") * 1000 > sketches.count()
    few, placed = F.broadcast(placed.where(hot).drop("n_rows")), placed.where(~hot).drop("n_rows")
    narrow = sketches.select("own", "doc_id", *keys)
    empty = narrow.where("n_shingles = 0").select("*", F.lit(None).cast("long").alias("component"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("leads"))
    filled = narrow.where("n_shingles > 0")
    joined = filled.join(few, keys).unionByName(filled.join(few.select(*keys), keys, "left_anti").join(_grows(placed), keys, "left")).unionByName(empty)
    stays = F.when(F.col("component").isNull(), True).when(F.col("doc_id").isNull(), F.col("component_id").isNull() & F.col("leads")).otherwise(F.col("component_id") == F.col("doc_id"))
    names = [f"own.{x}" for x in sketches.select("own.*").columns[1:]]
    return joined.select(*names, "doc_id", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"), stays.alias("kept"))


def _rest_links(rows, nodes, pairs, components, signed, least, words, num, den, block) -> DataFrame:
    """Links between components that no hub joined: members outside the hub's component against all others of its group."""
    members = pairs.union(pairs.select("hub", F.col("hub").alias("node")).distinct())
    of_node = components.select("node", "component")
    placed = members.join(of_node, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_hub = of_node.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    placed = placed.join(of_hub, "hub", "left").withColumn("core", F.col("component") == F.coalesce("hub_component", "hub")).drop("hub_component")
    counts = placed.groupBy("hub").agg(F.sum(F.col("core").cast("long")).alias("n_core"), F.sum((~F.col("core")).cast("long")).alias("n_apart")).where("n_apart > 0 and n_core + n_apart > 2")
    placed = settle(placed.join(counts, "hub"), "groups")

    # Blocks: a small group is one; else core rows and rows apart have blocks of their own, and each pair of blocks
    # with rows apart on one side at least is compared.
    whole = F.col("n_core") + F.col("n_apart") <= block
    n_a, n_c = F.ceil(F.col("n_apart") / block), F.ceil(F.col("n_core") / block)
    spot = F.pmod(F.xxhash64("node", "hub"), F.when(F.col("core"), n_c).otherwise(n_a))
    to_all = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f)
    cell = lambda x, y, kind: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(kind).alias("kind"))
    cells = F.when(whole, F.array(cell(F.lit(0), F.lit(0), 0))).when(F.col("core"), to_all(n_a, lambda x: cell(x, spot, 1))).otherwise(
        F.concat(to_all(n_a, lambda x: cell(F.least(x, spot), F.greatest(x, spot), 0)), to_all(n_c, lambda y: cell(spot, y, 1))))
    dealt = placed.select("hub", "node", "component", "core", F.explode(F.when(F.col("n_core") >= 0, cells)).alias("cell")).select("hub", "node", "component", "core", "cell.*")
    dealt = dealt.join(signed, "node")

    def candidates(table: pa.Table):
        """Signature pairs of one block or pair of blocks that survive: (i, j, matches), best first."""
        signature, component, core = _signatures(table["signature"].combine_chunks()), table["component"].to_numpy(), table["core"].to_numpy()
        found, across = [], bool(len(core)) and table["kind"][0].as_py() == 1
        for i in np.flatnonzero(~core):
            js = np.flatnonzero((component != component[i]) & (core if across else core | (np.arange(len(core)) > i)))
            if len(js):
                m = survives(np.broadcast_to(signature[i], (len(js), signature.shape[1])), signature[js], least)
                found += [(int(x), int(i), int(j)) for x, j in zip(m[m >= 0], js[m >= 0])]
        return sorted(found, reverse=True)

    def worth(table: pa.Table) -> pa.Table:
        """Rows with a surviving partner in their block."""
        at = sorted({k for _, i, j in candidates(table) for k in (i, j)})
        return table.select(["hub", "node", "component", "core", "x", "y", "kind", "signature"]).take(pa.array(at, pa.int64()))

    def links(table: pa.Table) -> pa.Table:
        """Confirmed links that join rows not yet joined, the likeliest pairs first."""
        hashes, at = shingle_sets(table["text"].combine_chunks(), words)
        component = table["component"].to_pylist()
        root = {c: c for c in component}

        def top(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        found, node = [], table["node"].to_pylist()
        for _, i, j in candidates(table):
            if top(component[i]) != top(component[j]) and similar(hashes[at[i] : at[i + 1]], hashes[at[j] : at[j + 1]], num, den):
                root[top(component[i])] = top(component[j])
                found.append((node[i], node[j]))
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["hub", "node"])

    kind = "hub long, node long, component long, core boolean, x long, y long, kind int, signature binary"
    keep = settle(dealt.select("hub", "node", "component", "core", "x", "y", "kind", "signature").groupBy("hub", "x", "y", "kind").applyInArrow(worth, kind), "worth")
    wanted = _texts(rows, nodes, keep.select("node"))
    return keep.join(_text_of(wanted, "node", "text"), "node").groupBy("hub", "x", "y", "kind").applyInArrow(links, "hub long, node long")
