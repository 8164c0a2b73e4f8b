import random
import zlib

import numpy as np
import pyarrow as pa

from posegrid.llm import harmonic, sst, tokens
from posegrid.llm.tokens import Encoder, encoder, vocabulary


def ids_of(text, end):
    return [*encoder(vocabulary()).library.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


ODD = [" a", "a ", "a  b", "it's fine, isn't it.", "<|endoftext|> b", "  x", "10, 20.5; a.b", "tab\tand\nline", "É.", "a. b.", None, "", "\n", " ", "a\n b", "a \nb", "日本語。\u3000b", "— . –.", "a'.'s", "don't'll 's", "\n's"]
ODD += ["a\x1c b", "x<|endoftext|>. y", "é, ×. ÷, ü'", "word " * 50, "a" * 200 + ".", " <|endoftext|>", "²,½. ª", "x\u00a0 y", "\u2028z"]
SIGNS = [*"abcXYZ019  \n\n.,;'!?-<|>\t éß×÷日—'s", " the", " and", ". ", ", ", "<|endoftext|>", "\x85", "\x1d", "\u00a0", "\r\n", "\x0b", "\x0c", "'re", "\U0001f600", "\u2003"]


def test_pieces_and_whole_texts_agree(rows, monkeypatch):
    rng = random.Random(1)
    texts = [r[1] for r in rows] + ODD + ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(40))) for _ in range(20_000)]
    coder = Encoder(vocabulary())
    monkeypatch.setattr(tokens, "CACHE_PIECES", 5_000)  # the store is emptied some times
    for at in range(0, len(texts), 1_000):
        part = texts[at : at + 1_000]
        ids, cut = coder.encode(pa.array(part, pa.string()))
        want = coder.library.encode_batch([t or "" for t in part], add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])] == [x.ids for x in want]
        assert len(coder.known) <= 5_000 + len(part)


def test_vocabulary_of_another_kind_encodes_whole_texts():
    coder = Encoder(vocabulary("word_bpe_49k.json"))
    texts = ["Some Words, and more.", "", None, "a  b\n"]
    ids, cut = coder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])] == [coder.library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_shards_hold_all_ids(docs, rows, nothing):
    manifest = sst.write_token_shards(docs, vocabulary(), 2, shard_bytes=4_000)
    got = sorted(map(tuple, sst.read_token_shards(manifest).collect()), key=lambda r: r[1])
    start, want = 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(r[1], 2)
        want.append((r[0], start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    assert manifest.count() > 3
    assert sst.read_token_shards(sst.write_token_shards(nothing, vocabulary(), 2)).count() == 0


def test_lookup_finds_keys_and_only_them(docs, rows):
    readers = [sst.ShardReader(r["uri"]) for r in sst.write_token_shards(docs, vocabulary(), 2).collect()]
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(crc(ids_of(r[1], 2)))
    for k, want in by_id.items():
        found = [crc(np.frombuffer(v, f"<u{x.width}")) for x in readers for v in x.lookup(k)]
        assert sorted(found) == sorted(want)
    misses = sum(x.may_hold(k) for x in readers for k in range(1000, 3000))
    assert misses < 0.05 * 2000 * len(readers)
    assert not any(x.lookup(k) for x in readers for k in range(1000, 1100))


def test_keys_sort_as_ids():
    ids = [None, -(2**63), -5, -1, 0, 1, 255, 256, 2**62, 2**63 - 1]
    assert sorted(map(sst.key_of, ids)) == [sst.key_of(i) for i in ids]
    assert [sst.id_of(sst.key_of(i)) for i in ids] == ids


def test_tail_cuts():
    for n, pieces in enumerate(harmonic.tail_cuts(2048, 64, 32)):
        assert sum(x for x, _ in pieces) == n
        for length, k in pieces:
            assert length <= 2048 // k and (k == 64 or length > 2048 // (k + 1) or length == 2048 // (k + 1) or 2048 // k - length <= 32)


def test_first_fit_keeps_within_capacity():
    rng = random.Random(1)
    fills = {k: rng.randrange(1, 2049) for k in range(1, 65)}
    place = harmonic.first_fit(fills, 2048)
    assert set(place) == set(fills)
    assert all(sum(fills[k] for k in place if place[k] == b) <= 2048 for b in place.values())


def test_pack_loses_nothing_and_pads_little(docs, rows, nothing):
    got = [r.asDict() for r in harmonic.pack(docs, vocabulary()).collect()]
    want = {}
    for r in rows:
        ids = ids_of(r[1], 1)
        want.setdefault((r[0], len(ids)), []).append(ids)
    pieces = {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert set(pieces) == set(want)
    for k, docs_ in want.items():
        own = sorted(pieces[k], key=lambda r: r["start"])
        assert sorted(r["ids_crc32"] for r in own) == sorted(crc(ids[r["start"] : r["start"] + r["length"]]) for ids in docs_ for r in own[:: len(docs_)])
        assert sum(r["length"] for r in own) == k[1] * len(docs_)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append(r)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert sum(r["length"] for r in got) / (2048 * len(bins)) > 0.9
    assert sorted(bins) == list(range(len(bins)))
    assert harmonic.pack(nothing, vocabulary()).count() == 0
