"""Token ids of whole texts by a public tokenizer file, as little-endian unsigned 32-bit integers.

The library's own ``encode`` re-aligns offsets for every character, which costs more than the merges. Both
``word`` classes of the file cut at white space, so a text is the concatenation of its space-separated chunks;
chunks are remembered, and a new chunk of plain Latin letters goes straight to the library's BPE model. Any
other chunk (and any file of another build) goes through the library's ``encode``.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import regex
from tokenizers import Tokenizer

CACHE_CHUNKS = 600_000
#: Chunks that normalisation only lower-cases, letter by letter, and that hold no special token.
PLAIN = re.compile("[!-;=-~\u00c0-\u012f\u0131-\u024f]*")


def byte_letters() -> dict[int, str]:
    """The published byte-level alphabet: printable bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Remembered(dict):
    """What ``make`` gives for a short key, made once; starts anew at ``most`` keys."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Encoder:
    def __init__(self, path: str, end_id: int | None = 1, remember: int = CACHE_CHUNKS):
        self.tokenizer = Tokenizer.from_file(path)
        self.end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.pattern = self._pattern(spec) if all(s.startswith("<") for s in special) else None
        self.tokenize = self.tokenizer.model.tokenize
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.id_bytes = [i.to_bytes(4, "little") for i in range(size)]
        self.letters = {i: c for i, c in byte_letters().items()}
        self.chunks = Remembered(self._chunk, remember)
        self.marks = {x: self._piece(x) for x in ",.;:!?"} if self.pattern else {}

    @staticmethod
    def _pattern(spec: dict):
        """The pre-tokenizer's pattern, if the file is of the build the short way knows; else None."""
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            return None
        split, level = steps
        if split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or level["use_regex"]:
            return None
        if not split["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+") or spec["model"]["type"] != "BPE" or spec["post_processor"]:
            return None
        return regex.compile(split["pattern"]["Regex"])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
        return b"".join([self.id_bytes[t.id] for t in self.tokenize(mapped)])

    def _chunk(self, chunk: str) -> bytes:
        if not PLAIN.fullmatch(chunk):
            return self._whole(chunk)
        if chunk.isalpha():
            return self._piece(chunk.lower())
        if chunk[-1:] in self.marks and chunk[:-1].isalpha():  # a word and its mark are two pieces
            return self.chunks[chunk[:-1].lower()] + self.marks[chunk[-1]]
        # words inside a chunk are remembered as chunks too
        return b"".join([self.chunks[x] if x.isalpha() else self._piece(x) for x in self.pattern.findall(chunk.lower())])

    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text and the end id. A null text counts as empty."""
        if not text:
            return self.end
        if self.pattern is None:
            return self._whole(text) + self.end
        if text.isascii() and "<" not in text:  # no special token; upper-case letters need not be remembered apart
            text = text.lower()
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" "))) + self.end


def sentence_ends(path: str) -> np.ndarray:
    """For each id, whether it is a mark that ends a sentence."""
    vocab = Tokenizer.from_file(path).get_vocab()
    ends = np.zeros(max(chain([0], vocab.values())) + 1, dtype=bool)
    for word, i in vocab.items():
        ends[i] = word.removesuffix("</w>")[-1:] in {".", "!", "?"}
    return ends
