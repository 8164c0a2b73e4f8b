"""Token ids of whole texts by the tokenizers library, with a bounded store of pieces."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa

from .common import SPACE, text_bytes

#: Pieces kept by a worker (about 100 MB at most), and the longest kept, in characters.
CACHE_PIECES, LONGEST_KEPT, JOINED = 300_000, 64, 64
_WHITE = "\\x00-\\x20\\x7f-\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORD = re.compile(f" ?[^{_WHITE}]+")
_ASCII = np.arange(256)
_ALNUM = ((_ASCII >= 48) & (_ASCII < 58)) | ((_ASCII | 32) >= 97) & ((_ASCII | 32) < 123) & (_ASCII < 128)
_PUNCT = (_ASCII > 32) & (_ASCII < 127) & ~_ALNUM
#: First bytes of white space beyond ASCII, and the four separators that only some libraries take for white space.
_RARE = np.isin(_ASCII, [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3])


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _rare_white(data: np.ndarray) -> np.ndarray:
    """Where white space other than the six ASCII bytes begins."""
    at = np.flatnonzero(_RARE[data])
    if not len(at):
        return at
    a = data[at]
    b, c = (data[np.minimum(at + i, len(data) - 1)] for i in (1, 2))
    general = (b == 0x80) & ((c <= 0x8A) | np.isin(c, [0xA8, 0xA9, 0xAF])) | (b == 0x81) & (c == 0x9F)
    return at[(a < 0x20) | (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & general | (a == 0xE3) & (b == 0x80) & (c == 0x80)]


class Encoder:
    """Encodes texts as the library does, a batch at a time.

    A byte-level vocabulary splits a text before every lone space, around every lone line break, and where
    punctuation follows a letter or a digit, and merges nothing across such a cut. So the ids of a text are those of
    its pieces, one after another. The distinct pieces of a batch are looked up in a store; new ones go to the
    library together. A text with doubled or rare white space or with a special token is one piece, and so is every
    text if the vocabulary is of another kind.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.marks = sorted(x.content for x in self.library.get_added_tokens_decoder().values())
        self.type = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = int(self.type[-1])
        shape = json.loads(Path(path).read_text())
        step = shape.get("pre_tokenizer") or {}
        self.plain = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space") and not shape.get("normalizer") and shape["model"]["type"] == "BPE"
        self.leads = np.zeros(max(self.library.get_vocab(with_added_tokens=True).values()) + 1, bool)
        self.leads[[i for token, i in self.library.get_vocab().items() if token[0] == "Ġ"]] = True
        self.line = self._ids(["\n"])[0][0] if self.plain else None
        self._forget()

    def _forget(self) -> None:
        """An empty store, but for the two pieces that are white space. Row i has the ids flat[at[i] : at[i + 1]]."""
        ids, sizes = self._alone(["\n", " "])
        self.known: dict[str, int] = {"\n": 0, " ": 1}
        self.flat, self.at = np.concatenate(ids), np.append(0, np.cumsum(sizes[0]))

    def _is_word(self, piece: str) -> bool:
        return bool(self.plain and _WORD.fullmatch(piece)) and not any(mark in piece for mark in self.marks)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, self.type) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, bool]:
        """Where pieces begin, and whether all are words, lone spaces or lone line breaks."""
        cut = np.zeros(len(data), bool)
        filled = offsets[:-1][np.diff(offsets) > 0]
        cut[filled] = True
        if not self.plain:
            return filled, False
        white, line = SPACE[data], data == 10
        odd = white[1:] & white[:-1] & ~cut[1:]
        bad = [np.flatnonzero(odd), _rare_white(data)]
        raw = data.tobytes()
        for mark in self.marks:
            bad.append(np.array([x.start() for x in re.finditer(re.escape(mark.encode()), raw)], np.int64))
        solid = _ALNUM[data]
        if len(data) > 1:
            solid[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut |= (data == 32) | line
        cut[1:] |= line[:-1] | (_PUNCT[data[1:]] & solid[:-1])
        whole = np.unique(np.searchsorted(offsets, np.concatenate(bad), side="right") - 1)
        for text in whole:
            cut[offsets[text] + 1 : offsets[text + 1]] = False
        return np.flatnonzero(cut), not len(whole) and np.count_nonzero(white) == np.count_nonzero((data == 32) | line)

    def _joined(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of words, and how many each has: many words are one text, told apart by what stands between them."""
        spaced, ids, sizes = words[0][0] == " ", [], []
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, found in zip(groups, self._ids([("" if spaced else "\n").join(g) for g in groups])):
            if spaced:
                size = np.diff(np.append(np.flatnonzero(self.leads[found]), len(found)))
            else:
                lines = found == self.line
                size = np.diff(np.concatenate([[-1], np.flatnonzero(lines), [len(found)]])) - 1
                found = found[~lines]
            if len(size) != len(group) or size.sum() != len(found):
                raise ValueError("the vocabulary merges words across white space")
            ids.append(found)
            sizes.append(size)
        return ids, sizes

    def _alone(self, pieces: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        ids = self._ids(pieces)
        return ids, [np.fromiter(map(len, ids), np.int64, len(ids))]

    def _rows(self, pieces: np.ndarray, words_only: bool) -> np.ndarray:
        """The row of each distinct piece in the store; new ones are encoded and added, long ones for this batch only."""
        found = list(map(self.known.get, pieces))
        new = [p for p, row in zip(pieces, found) if row is None]
        if new:
            if len(self.known) + len(new) > CACHE_PIECES:
                self._forget()
                found = list(map(self.known.get, pieces))
                new = [p for p, row in zip(pieces, found) if row is None]
            spaced, bare, odd, first = [], [], [], len(self.known)
            for p in new:
                (odd if not (words_only or self._is_word(p)) or len(p) > LONGEST_KEPT else spaced if p[0] == " " else bare).append(p)
            odd.sort(key=lambda p: len(p) > LONGEST_KEPT)  # rows past those kept go with the next batch
            ids, sizes = [self.flat[: self.at[first]]], [np.diff(self.at[: first + 1])]
            for kind, how in ((spaced, self._joined), (bare, self._joined), (odd, self._alone)):
                if kind:
                    more, size = how(kind)
                    ids += more
                    sizes += size
            row_of = dict(zip(spaced + bare + odd, range(first, first + len(new))))
            self.flat, self.at = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            self.known.update(row_of if max(map(len, new)) <= LONGEST_KEPT else {p: row for p, row in row_of.items() if len(p) <= LONGEST_KEPT})
            found = [row_of[p] if row is None else row for p, row in zip(pieces, found)]
        return np.asarray(found, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, as integers of ``type``, and len+1 offsets; null counts as empty."""
        data, offsets = text_bytes(texts)
        if not len(data):
            return np.zeros(0, self.type), np.zeros(len(texts) + 1, np.int64)
        cuts, words_only = self._cuts(data, offsets)
        bounds = np.append(cuts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.string(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        rows = self._rows(coded.dictionary.to_numpy(zero_copy_only=False), words_only)
        starts, sizes = self.at[rows], self.at[rows + 1] - self.at[rows]
        code = coded.indices.to_numpy()
        length = sizes[code]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.repeat(starts[code] - ends[:-1], length) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(cuts, offsets)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)
