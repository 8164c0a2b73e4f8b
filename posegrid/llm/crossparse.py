"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed into the longest phrases that occur
in the language's text (a symbol that it lacks is a phrase of its own); the language that needs the fewest phrases a
symbol wins. Symbols are UTF-8 bytes with letters lower-cased and white space, digits and other ASCII folded
together. A missing transition ends a phrase and starts at the root with the same symbol, so each automaton is one
dense table. Many blocks of a batch are parsed at once, each as if a phrase began with it; then each block that began
within a phrase is parsed again from the state in which the block before it ended, until both parses are in one
state, which takes a phrase or two. The result is that of one parse of the whole text, whatever the blocks.

Model: a bounded sample of labelled rows, at most ``sample_bytes`` of text for each language and ``total_bytes`` for all
(more languages than total_bytes / sample_bytes get equal parts of it), from texts of at most ``part_chars`` characters
each, for the ``most_languages`` with most rows (all parameters; other languages are not learned). So a worker's
automata take at most 8 * N_SYMBOLS bytes for each byte of the total, and about 200 MB with letters of one script.
Counts cover all rows; equal rows and texts of one id are sampled once. Prediction reads whole texts only.

A null text, or one without a letter, is ``und`` with score 0. If no row can be learned from, all texts are ``und``.
Ties go to the language first in order. Repeated rows and null or repeated ids are predicted row by row. Extra
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, text_bytes, text_slices

SAMPLE_BYTES, TOTAL_BYTES, PART_CHARS, DOCS, BLOCK, MOST_LANGUAGES = 32_768, 1 << 20, 1_000, 200, 1_024, 1_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _symbols() -> np.ndarray:
    """Byte to symbol: 1 white space, 2 digits, 3 other ASCII, then letters and the bytes of longer characters."""
    out = np.full(256, 3, np.uint8)
    out[SPACE], out[48:58] = 1, 2
    out[97:123] = np.arange(4, 30)
    out[65:91] = out[97:123]
    out[128:] = np.arange(30, 158)
    return out


SYMBOLS, N_SYMBOLS = _symbols(), 158


def suffix_automaton(symbols: list[int]) -> np.ndarray:
    """Dense transitions (state, symbol) of the suffix automaton; 0, the root, where there is none."""
    link, length, step = [-1], [0], [{}]
    last = 0
    for c in symbols:
        now, p = len(link), last
        link.append(0)
        length.append(length[last] + 1)
        step.append({})
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    out = np.zeros((len(step), N_SYMBOLS), np.int32)
    for i, row in enumerate(step):
        for c, to in row.items():
            out[i, c] = to
    return out


@lru_cache(maxsize=2)
def machines(samples: tuple[tuple[str, bytes], ...]) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """One dense table a language, with breaks resolved: a negative entry is the state after a phrase's end.

    Built once in each worker process from the small samples.
    """
    tables = []
    for _, text in samples:
        symbols = SYMBOLS[np.frombuffer(text, np.uint8)]
        table = suffix_automaton(symbols.tolist())
        table = np.where(table > 0, table, -table[0][None, :] - 1)
        used = np.unique(symbols)
        column = np.full(N_SYMBOLS, len(used), np.uint8)  # symbols never seen share the last column
        column[used] = np.arange(len(used), dtype=np.uint8)
        tables.append((np.ascontiguousarray(table[:, np.append(used, 0)]).ravel(), len(used) + 1, column[SYMBOLS]))
    return tables


def _run(machine, symbols, at: np.ndarray, ends: np.ndarray, state: np.ndarray, trace: np.ndarray, begins: np.ndarray, until_equal: bool) -> np.ndarray:
    """Parse blocks from ``state``, writing each symbol's state and whether a phrase begins there.

    With ``until_equal`` a block stops where its state is the one written before; returns which blocks ran to their
    end. Blocks are sorted by length, longest first.
    """
    table, width, _ = machine
    through = np.zeros(len(at), bool)
    alive = np.arange(len(at))
    at, state = at.copy(), state.copy()
    while len(alive):
        spot = at[alive]
        now = state[alive]
        to = table[now * np.int32(width) + symbols[spot]]
        broke = to < 0
        begins[spot] = broke | (now == 0)  # a phrase begins at a break, and at the root
        to = np.where(broke, -to - 1, to)
        same = trace[spot] == to if until_equal else False
        trace[spot] = state[alive] = to
        at[alive] += 1
        done = at[alive] == ends[alive]
        through[alive[done & ~same] if until_equal else alive[done]] = True
        alive = alive[~(done | same)]
    return through


def phrases(machine, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Phrases of each text ``data[offsets[i]:offsets[i + 1]]``, by the greedy parse of the whole text."""
    symbols = machine[2][data].astype(np.int32)
    lengths = np.diff(offsets)
    blocks = -(-lengths // BLOCK)
    first = np.cumsum(blocks) - blocks
    text = np.repeat(np.arange(len(lengths)), blocks)
    starts = offsets[:-1][text] + (np.arange(len(text)) - first[text]) * BLOCK
    ends = np.minimum(starts + BLOCK, offsets[1:][text])
    trace, begins = np.zeros(len(data), np.int32), np.zeros(len(data), bool)
    order = np.argsort(starts - ends, kind="stable")
    _run(machine, symbols, starts[order], ends[order], np.zeros(len(text), np.int32), trace, begins, False)
    again = np.flatnonzero(starts > offsets[:-1][text])
    while len(again):
        through = _run(machine, symbols, starts[again], ends[again], trace[starts[again] - 1], trace, begins, True)
        again = again[through] + 1
        again = again[(again < len(text))]
        again = again[starts[again] > offsets[:-1][text[again]]]
    sums = np.concatenate([[0], np.cumsum(begins)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def rates(samples, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Phrases a byte of each text (row) in each language (column)."""
    counts = [phrases(machine, data, offsets) for machine in machines(samples)]
    return np.stack(counts, axis=1) / np.maximum(np.diff(offsets), 1)[:, None]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES, part_chars: int = PART_CHARS, most_languages: int = MOST_LANGUAGES) -> tuple[tuple[str, bytes], ...]:
    """Samples of each language from rows that are not held out: about DOCS texts by the smallest hash of id and text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not counts:
        return ()
    unit = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, DOCS / r["n"]))) for r in counts])
    middle = F.substr("text", F.greatest(F.lit(1), ((F.length("text") - part_chars) / 2).cast("int")), F.lit(part_chars))
    picked = rows.withColumn("unit", unit).where(F.col("unit") < share).select("lang", "unit", middle.alias("text")).where("text rlike '\\\\p{L}'").distinct()
    texts: dict[str, list] = {}
    for r in picked.collect():  # about DOCS * part_chars characters a language
        texts.setdefault(r["lang"], []).append((r["unit"], r["text"]))
    most = min(sample_bytes, total_bytes // len(texts)) if texts else 0
    return tuple((k, "\n".join(t for _, t in sorted(v)).encode()[:most]) for k, v in sorted(texts.items()))


def identify(docs: DataFrame, samples, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (1 - phrases of the best over those of the next, 0 to 1)."""
    names = [k for k, _ in samples]
    own = docs.sparkSession.sparkContext.broadcast(samples)  # at most ``total_bytes`` of text

    def run(batches):
        for part in text_slices(batches, most=1 << 21):
            texts = part.column(1)
            data, offsets = text_bytes(texts)
            ascii_letter = (LOWER[data] >= 97) & (LOWER[data] <= 122)
            sums = np.concatenate([[0], np.cumsum(ascii_letter)])
            lettered = (sums[offsets[1:]] > sums[offsets[:-1]]).tolist()
            for i in np.flatnonzero(~np.asarray(lettered, bool)):
                lettered[i] = any(c.isalpha() for c in texts[i].as_py() or "")
            lettered = np.asarray(lettered, bool)
            n = part.num_rows
            best, score = np.full(n, -1), np.zeros(n)
            if names:
                rate = rates(own.value, data, offsets)
                best = np.argmin(rate, axis=1)
                low = rate[np.arange(n), best]
                rate[np.arange(n), best] = np.inf
                after = rate.min(axis=1)
                score = np.where(np.isfinite(after) & (after > 0), 1 - low / np.where(after > 0, after, 1), 1.0)
            score = np.where(lettered, score, 0.0) if names else np.zeros(n)
            lang = [names[b] if ok and b >= 0 else "und" for b, ok in zip(best, lettered)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
