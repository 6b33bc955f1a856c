"""SentencePiece encoding that keeps offsets, and decoding.

The normaliser of a model file is a compiled character map: a double-array trie of byte strings with their
replacements. ``CharMap`` applies it by longest prefix and records which original bytes each normalised character came
from; every piece is projected through that record to a span of the original's UTF-8 bytes. Ids come from the
sentencepiece library itself. Where the map is empty, the record is the text itself, and a piece's width its own bytes.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, table, texts

SPACE = "▁"


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of a serialised protocol buffer."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, message[at : at + size]
            at += size


class CharMap:
    """Compiled character map: 4 bytes of trie size, the trie's 32-bit units, then replacements that end with NUL."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units, self.made = array("I", blob[4 : 4 + size]), blob[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest key of the trie that ``raw`` has at ``at``: its length and replacement."""
        if not self.units:
            return None
        shift = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node, found = shift(self.units[0]), None
        for end in range(at, len(raw)):
            node ^= raw[end]
            unit = self.units[node]
            if unit & 0x800000FF != raw[end]:
                break
            node ^= shift(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = end + 1 - at, self.made[start : self.made.index(0, start)]
        return found

    def normalise(self, text: str) -> list[tuple[str, int, int]]:
        """Normalised characters, each with the span of original bytes that it stands for."""
        raw, at, out = text.encode("utf-8"), 0, []
        while at < len(raw):
            if hit := self.longest(raw, at):
                size, new = hit[0], hit[1].decode("utf-8")
            else:
                size = 1 if raw[at] < 128 else 2 if raw[at] < 224 else 3 if raw[at] < 240 else 4
                new = raw[at : at + size].decode("utf-8")
            out += [(c, at, at + size) for c in new]
            at += size
        return out


class Model:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            proto = f.read()
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.pieces: list[tuple[str, float, int]] = []
        spec: dict = {}
        for number, value in fields(proto):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append((piece[1].decode("utf-8"), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, 1)))
            elif number == 3:
                spec = dict(fields(value))
        self.map = CharMap(spec.get(2, b""))
        self.dummy, self.trim, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.plain = not (self.map.units or self.trim or any(kind == 4 for *_, kind in self.pieces)) and self.dummy and self.escape
        self.bytes = {i for i, (*_, kind) in enumerate(self.pieces) if kind == 6}
        self.chars = [len(p) for p, *_ in self.pieces]
        self.width = np.array([1 if i in self.bytes else len(p.replace(SPACE, " ").encode()) for i, (p, *_) in enumerate(self.pieces)], "<i8")

    def spans(self, text: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """Begin and end bytes in the original for each id of a whole text."""
        chars = self.map.normalise(text)
        if self.trim:
            kept = []
            for c in chars:
                if c[0] != " " or kept and kept[-1][0] != " ":
                    kept.append(c)
            chars = kept[:-1] if kept and kept[-1][0] == " " else kept
        if self.dummy and chars:
            chars = [(" ", chars[0][1], chars[0][1]), *chars]
        begins, ends, at, left = [], [], 0, 0
        for i in ids:
            if i in self.bytes:  # one byte of a character
                c, a, b = chars[at]
                size = len(c.encode("utf-8"))
                left = left or size
                done = size - left
                begins.append(min(a + done, b))
                left -= 1
                ends.append(min(a + done + 1, b) if left else b)
                at += not left
                continue
            n = self.chars[i]
            if i == self.sp.unk_id():  # a run of unknown characters
                n = 1
            begins.append(chars[at][1])
            at += n
            ends.append(chars[at - 1][2])
        return begins, ends

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, begins and ends. Where the character map is empty, a piece stands for its own bytes: its width is enough."""
        ids = self.sp.encode(text)
        if not self.plain or SPACE in text or "\0" in text or not ids or self.sp.unk_id() in ids:
            begins, ends = self.spans(text, ids)
            return np.array(ids, "<u4"), np.array(begins, "<i8"), np.array(ends, "<i8")
        ids = np.array(ids, "<u4")
        widths = self.width[ids]
        widths[0] -= 1  # the first piece's space is not in the text
        ends = np.cumsum(widths)
        return ids, ends - widths, ends


_loaded: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _loaded:
        _loaded[path] = Model(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, begin: bool = False, end: bool = False) -> DataFrame:
    """Ids of whole texts and the original bytes of each: doc_id, ids, begins, ends (arrays of one length).

    Spans are of the text's UTF-8 bytes, end exclusive; the marks of begin and end have empty spans. A null text
    counts as empty and has no ids but the marks. Only doc_id and text are read; repeated rows give repeated rows.
    """

    def run(batch):
        m, rows = model(path), []
        for text in texts(batch):
            ids, begins, ends = m.encode(text)
            head, tail, size = ([m.sp.bos_id()] if begin else []), ([m.sp.eos_id()] if end else []), len(text.encode("utf-8"))
            rows.append(([*head, *ids.tolist(), *tail], [*[0] * len(head), *begins.tolist(), *[size] * len(tail)], [*[0] * len(head), *ends.tolist(), *[size] * len(tail)]))
        ids, begins, ends = zip(*rows, strict=True)
        return {"doc_id": batch.column("doc_id"), "ids": ids, "begins": begins, "ends": ends}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The texts of (doc_id, ids) by the library's decode: doc_id, text. Null ids count as none."""

    def run(batch):
        return {"doc_id": batch.column("doc_id"), "text": model(path).sp.decode([ids or [] for ids in batch.column("ids").to_pylist()], num_threads=1)}

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """``encode`` with both marks and then ``decode``, by hash: the ids of a corpus are larger than its text.

    doc_id, n_tokens, ids_sha256, decoded_sha256, and spans_sha256: of begin and end of each id in the original bytes, in
    turns, as little-endian unsigned 32-bit integers. A null doc_id stays null, a null text counts as empty; repeated
    rows give repeated rows, an empty table none.
    """

    def run(batch):
        m = model(path)
        n, hashes, spans, lists = [], [], [], []
        for text in texts(batch):
            ids, begins, ends = m.encode(text)
            ids = np.concatenate([[m.sp.bos_id()], ids, [m.sp.eos_id()]]).astype("<u4")
            n.append(len(ids))
            hashes.append(hashlib.sha256(ids.tobytes()).hexdigest())
            size = len(text.encode("utf-8", "replace"))
            both = np.empty(2 * len(ids), "<u4")
            both[::2], both[1::2] = [0, *begins, size], [0, *ends, size]
            spans.append(hashlib.sha256(both.tobytes()).hexdigest())
            lists.append(ids.tolist())
        decoded = [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in m.sp.decode(lists, num_threads=1)]
        return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": hashes, "decoded_sha256": decoded, "spans_sha256": spans}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
