"""Byte-level BPE ids of whole texts, by the library that has the vocabulary's merges as ranks.

Added tokens are found first, as the vocabulary's own library does: they take their own ids, and what stands between
them is encoded by itself. Very long runs of white space are cut out as the pre-token pattern would cut them.
"""

from __future__ import annotations

import json
import re
from array import array

import tiktoken

#: fixed values: the vocabulary's pre-token pattern
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: white space as the pattern has it; the pattern's own search fails on very long runs, so these are cut out before it
RUN = re.compile(r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable bytes stand for themselves, the others for 256, 257, ..."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """A text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        alphabet = byte_alphabet()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that depend on what stands beside them aren't supported")
        special = {t["id"] for t in added}
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if i not in special}
        self.ids = max([*spec["model"]["vocab"].values(), *special]) + 1
        self.core = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.cut and len(parts := self.cut.split(text)) > 1:  # at odd places the added tokens
            return b"".join(self.added[part] if k % 2 else self.between(part) for k, part in enumerate(parts) if part)
        return self.between(text)

    def between(self, text: str) -> bytes:
        """A run of white space is one pre-token but for its last character, which goes with what follows, if anything does."""
        out, at = [], 0
        for run in RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += [self.plain(text[at : run.start()]), array("I", self.core._encode_single_piece(text[run.start() : end])).tobytes()]
            at = end
        return b"".join([*out, self.plain(text[at:])]) if out else self.plain(text)

    def plain(self, text: str) -> bytes:
        return self.core.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
