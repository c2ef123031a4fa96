"""Token ids of whole texts by a public tokenizer, with the work on repeated words done once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

#: Bytes that stand for a visible ASCII character, and first bytes of two-byte letters (none of them is white space).
_GRAPH = np.zeros(256, dtype=bool)
_GRAPH[0x21:0x7F] = True
_TWO = np.zeros(256, dtype=bool)
_TWO[0xC3:0xE0] = True
#: The pieces that a byte-level tokenizer looks at one by one (fixed pattern of this vocabulary).
PIECE = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Letters up to here (Latin, Greek, Cyrillic) are classed alike by the pattern and the tokenizer; others are left to it.
LAST_COMMON = "\u052f"
#: Chunks and pieces that a worker remembers.
REMEMBERED = 200_000


def byte_letters() -> dict[int, str]:
    """The letter a byte-level vocabulary writes for each byte: visible ones themselves, the others from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in set(seen)]
    return {x: chr(x) for x in seen} | {x: chr(256 + k) for k, x in enumerate(hidden)}


def chunk_edges(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions where the bytes may be cut without changing any token: ends of texts, and before lone blanks.

    A byte-level tokenizer never lets a piece run over a single blank that follows a visible character and precedes
    another one; the blank opens the next piece.
    """
    low, own = int(offsets[0]), data[offsets[0] : offsets[-1]]
    at = np.flatnonzero(own == 0x20)
    at = at[(at >= 2) & (at < len(own) - 1)]
    before, after = own[at - 1], own[at + 1]
    lone = (_GRAPH[after] | _TWO[after]) & (_GRAPH[before] | ((before >= 0x80) & _TWO[own[at - 2]]))
    cut = np.zeros(len(own) + 1, dtype=bool)
    cut[at[lone]] = True
    cut[offsets - low] = True
    return np.flatnonzero(cut) + low


def joinable(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Does a chunk open with a lone blank and end in a visible character, so that others like it may follow?"""
    begin, end = edges[:-1], edges[1:]
    after, last, before = data[np.minimum(begin + 1, len(data) - 1)], data[end - 1], data[np.maximum(end - 2, 0)]
    opens = (end - begin >= 2) & (data[begin] == 0x20) & (_GRAPH[after] | _TWO[after])
    return opens & (_GRAPH[last] | ((last >= 0x80) & (end - begin >= 3) & _TWO[before]))


class Encoder:
    """Ids of texts by the byte-level tokenizer in the file `path`; the strings of special tokens are ordinary text.

    Texts are cut at `chunk_edges`. Distinct chunks are cut into the tokenizer's pieces, and its model is asked for every
    distinct piece once. Chunks and pieces are remembered, up to twice `REMEMBERED` of each.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.letters = byte_letters()
        self.chunks: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        known, letters, ask = self.pieces, self.letters, self.tokenizer.model.tokenize
        for piece in pieces:
            if piece in known:
                continue
            written = piece.encode().decode("latin-1").translate(letters)
            known[piece] = np.array([token.id for token in ask(written)], dtype="<u4").tobytes()
        found = [known[piece] for piece in pieces]
        if len(known) > 2 * REMEMBERED:
            self.pieces = {}
        return found

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that may follow one another, cut into pieces together."""
        if not chunks:
            return []
        pieces = PIECE.findall("".join(chunks))
        found = self._of_pieces(pieces)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        last = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks))))
        raw, cut = b"".join(found), np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))[last].tolist()
        return [raw[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts of a column, one after the other. A null text has none."""
        texts = column.cast(pa.string()).fill_null("")
        buffer = texts.buffers()[2] if len(texts) else None
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        if buffer is None or offsets[-1] == offsets[0]:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(buffer, np.uint8)
        edges = chunk_edges(data, offsets)
        coded = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int32)), buffer).dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        follows = np.zeros(len(chunks), dtype=bool)
        follows[coded.indices.to_numpy()] = joinable(data, edges)
        young, old = self.chunks
        found = [young.get(chunk) or old.get(chunk) for chunk in chunks]
        new = [i for i, ids in enumerate(found) if ids is None]
        common = {i for i in new if chunks[i].isascii() or max(chunks[i]) <= LAST_COMMON}
        together = [i for i in new if i in common and follows[i]]
        for i, ids in zip(together, self._learn([chunks[i] for i in together]), strict=True):
            found[i] = ids
        for i in new:
            if found[i] is None:
                found[i] = b"".join(self._of_pieces(PIECE.findall(chunks[i]))) if i in common else self._whole(chunks[i])
        young.update(zip(chunks, found, strict=True))
        if len(young) > REMEMBERED:
            self.chunks = {}, young
        whole = pa.array(found, pa.binary()).take(coded.indices)
        ends = np.frombuffer(whole.buffers()[1], np.int32)[: len(whole) + 1].astype(np.int64) // 4
        return np.frombuffer(whole.buffers()[2], dtype="<u4")[: ends[-1]], ends[np.searchsorted(edges, offsets)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker, so that tasks which share a worker share what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
