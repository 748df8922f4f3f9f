"""SentencePiece encoding and decoding as a shortest path through a composed transducer.

Compiled once from the model file: the normaliser (a blank becomes the word mark, one
mark goes before the text), the pieces (a trie whose final states emit the piece), byte fallback
(a character without a piece emits its bytes' pieces), and the model's grammar of pieces.
Each input is composed with them to a lattice whose arcs are pieces, and the path of least
weight in the tropical semiring (min, +) is the encoding.

* Unigram models: an arc weighs minus the piece's score; a state is a position.
* BPE models: their scores are merge ranks, and the least sum of ranks is *not* the encoding
  that merging gives. There the grammar is over pairs of pieces: an arc weighs 0 if merging the two
  pieces' characters gives just these two, and infinity if not. A state is a position and
  the piece before it. Paths of weight 0 are the results of merging; there is one.

No piece holds the word mark after another character, so no path of weight 0 crosses the begin
of a word: a text is encoded word by word, each distinct word of a block once, and
recent words are remembered per process (at most ``_REMEMBER``). Models that have such
pieces are composed with whole texts.

Rows: one per input row, in place, without a shuffle. Null and empty texts have no pieces.
Models with a character map or user-defined pieces are refused.
"""

from __future__ import annotations

import hashlib
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runtime_insights.llm.arrays import chunks, gather, span_hashes, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_REMEMBER = 200_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        elif kind == 2:
            size = number()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


class Transducer:
    """A model compiled for encoding and decoding."""

    def __init__(self, model: bytes):
        pieces, self.bpe, byte_fallback, prefix, charsmap, tidy = [], False, False, True, b"", True
        for field, value in _fields(model):
            if field == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: _NORMAL} | dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
            elif field == 2:
                trainer = dict(_fields(value))
                self.bpe = trainer.get(3, 1) == 2
                byte_fallback = bool(trainer.get(35, 0))
                if trainer.get(3, 1) not in (1, 2):
                    raise ValueError("neither a unigram nor a BPE model")
            elif field == 3:
                spec = dict(_fields(value))
                charsmap, prefix, tidy = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if charsmap or tidy or any(kind == _USER for _, _, kind in pieces):
            raise ValueError("character maps, removal of blanks and user-defined pieces are not supported")
        self.prefix = prefix
        self.score = {p: s for p, s, kind in pieces if kind == _NORMAL}
        self.id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == _NORMAL}
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == _UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE} if byte_fallback else {}
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.id)
        self.trie: dict = {}
        for p in self.id:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.penalty = 10 - min(self.score.values(), default=0.0)
        self._pairs: dict[tuple[str, str], bool] = {}
        self._words: dict[bytes, tuple[int, ...]] = {}
        # Decoding: the bytes of each id.
        spelled = []
        for p, _, kind in pieces:
            spelled.append(
                bytes([int(p[3:5], 16)]) if kind == _BYTE else b"" if kind == _CONTROL
                else " ⁇ ".encode() if kind == _UNKNOWN else p.replace(MARK, " ").encode()
            )
        self.spelled_at = np.concatenate(([0], np.cumsum([len(s) for s in spelled])))
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    def _merged(self, text: str) -> list[str]:
        """The pieces that merging gives: always the best pair, the leftmost of equals."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, before: str, piece: str) -> bool:
        """The grammar of BPE models: whether the arc ``piece`` after ``before`` weighs 0."""
        key = (before, piece)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 2 * _REMEMBER:
                self._pairs.clear()
            known = self._pairs[key] = self._merged(before + piece) == [before, piece]
        return known

    def _shortest_bpe(self, text: str) -> list[str]:
        end = len(text)
        last: list[str | None] = [None] * (end + 1)  # the piece before each position
        trie, follows, pairs = self.trie, self._follows, self._pairs
        for i in range(end):
            before = last[i] if i else ""
            if before is None:
                continue
            piece, j = text[i], i + 1
            node = trie.get(piece)
            if last[j] is None:  # a single character is always a symbol
                if not before:
                    last[j] = piece
                else:
                    known = pairs.get((before, piece))
                    if known is None:
                        known = follows(before, piece)
                    if known:
                        last[j] = piece
            while node and j < end:
                node = node.get(text[j])
                if not node:
                    break
                j += 1
                if last[j] is None and (piece := node.get("")) is not None:
                    known = pairs.get((before, piece))
                    if known is None:
                        known = follows(before, piece) if before else self._merged(piece) == [piece]
                        pairs[before, piece] = known
                    if known:
                        last[j] = piece
            if last[end] is not None:  # there is one path of weight 0, and this is its last arc
                break
        out, j = [], len(text)
        while j:
            out.append(last[j])
            j -= len(last[j])
        return out[::-1]

    def _shortest_unigram(self, text: str) -> list[str]:
        weight = [0.0] + [float("inf")] * len(text)
        back = [""] * (len(text) + 1)
        for i in range(len(text)):
            node, j = self.trie.get(text[i]), i + 1
            if text[i] not in self.id and weight[i] + self.penalty < weight[j]:
                weight[j], back[j] = weight[i] + self.penalty, text[i]
            while node:
                if "" in node and (w := weight[i] - self.score[node[""]]) < weight[j]:
                    weight[j], back[j] = w, node[""]
                if j == len(text):
                    break
                node = node.get(text[j])
                j += 1
        out, j = [], len(text)
        while j:
            out.append(back[j])
            j -= len(back[j])
        return out[::-1]

    def _emit(self, path: list[str]) -> tuple[int, ...]:
        out, unknown = [], False
        for piece in path:
            number = self.id.get(piece)
            if number is not None:
                out.append(number)
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            elif not unknown:  # characters without a piece in a row are one unknown
                out.append(self.unknown)
            unknown = number is None
        return tuple(out)

    def encode_unit(self, raw: bytes) -> tuple[int, ...]:
        """Ids of a piece of text with its blanks (the prefix is already there)."""
        known = self._words.get(raw)
        if known is None:
            text = raw.decode().replace(" ", MARK)
            known = self._emit(self._shortest_bpe(text) if self.bpe else self._shortest_unigram(text))
            if len(self._words) >= _REMEMBER:
                self._words.clear()
            if len(raw) <= 64:
                self._words[raw] = known
        return known

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (n + 1)."""
        data, offsets = text_bytes(column)
        size = np.diff(offsets)
        if self.prefix:  # one blank before each text that is not empty
            lead = (size > 0).astype(np.int64)
            data, _ = gather(np.concatenate((data, [np.uint8(32)])),
                             *_interleave(offsets[:-1], offsets[1:], len(data), lead))
            offsets = np.concatenate(([0], np.cumsum(size + lead)))
        blank = data == 32
        first = np.zeros(len(data), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        if self.by_word:
            first[1:] |= blank[1:] & ~blank[:-1]
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        _, one, number = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        coded = [self.encode_unit(raw[a:b]) for a, b in zip(starts[one].tolist(), ends[one].tolist())]
        length = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(chain.from_iterable(coded), np.int32, int(length.sum()))
        at = np.concatenate(([0], np.cumsum(length)))
        ids, begin = gather(flat, at[number], at[number] + length[number])
        return ids, begin[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> list[str]:
        """The texts of ids, one after another in ``ids``."""
        data, at = gather(self.spelled, self.spelled_at[ids], self.spelled_at[ids + 1])
        raw, cut = data.tobytes(), at[begin]
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if self.prefix and raw[a : a + 1] == b" " and a < b:
                a += 1
            out.append(raw[a:b].decode("utf-8", "replace"))
        return out


def _interleave(starts, ends, blank_at: int, lead):
    """Spans of a leading blank (where ``lead``) and of each text, in turn."""
    a, b = np.empty(2 * len(starts), np.int64), np.empty(2 * len(starts), np.int64)
    a[0::2], b[0::2] = blank_at, blank_at + lead
    a[1::2], b[1::2] = starts, ends
    return a, b


_COMPILED: dict[str, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """The model's transducer, compiled once per process."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Transducer(model)
    return _COMPILED[key]


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """``doc_id``, ``ids``. The model is read by the driver and sent to the tasks; its size is the file's."""
    model = docs.sparkSession.sparkContext.broadcast(_model_bytes(model_path))

    def run(batches):
        transducer = compiled(model.value)
        for chunk in chunks(batches, "text", 2 << 20):
            ids, begin = transducer.encode(chunk.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(
        run, "doc_id long, ids array<int>"
    )


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """``doc_id``, ``text`` of rows ``doc_id``, ``ids``; null ids give an empty text."""
    model = encoded.sparkSession.sparkContext.broadcast(_model_bytes(model_path))

    def run(batches):
        transducer = compiled(model.value)
        for batch in batches:
            lists = batch.column("ids")
            length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            begin = np.concatenate(([0], np.cumsum(length)))
            texts = transducer.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), begin)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encoding_digests(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """Per row: number of pieces, digest of the ids (32-bit, little-endian), and whether
    decoding gives the text back."""
    model = docs.sparkSession.sparkContext.broadcast(_model_bytes(model_path))

    def run(batches):
        transducer = compiled(model.value)
        for chunk in chunks(batches, "text", 2 << 20):
            ids, begin = transducer.encode(chunk.column("text"))
            raw = ids.astype("<i4").tobytes()
            digests = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
            texts = transducer.decode(ids.astype(np.int64), begin)
            same = [a == (b or "") for a, b in zip(texts, chunk.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(np.diff(begin), pa.int64()), pa.array(digests, pa.string()), pa.array(same)],
                ["doc_id", "n_pieces", "ids_sha256", "round_trip"],
            )

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(
        run, "doc_id long, n_pieces long, ids_sha256 string, round_trip boolean"
    )


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encoding_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
