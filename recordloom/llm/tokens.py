"""Exact token ids of whole texts by the tokenizers library, each distinct pre-token encoded once.

A byte-level BPE model cuts a text with a fixed pattern and encodes each piece by itself, so the ids of
a text are the ids of its pieces in order. Pieces are cut here with the same pattern and their ids are
taken from the library once per piece and worker. A text that holds a special string, or a character
on which two regex engines may differ, is encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(r"[\t-\r -~À-ÿ]*\Z")
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LONG = 1 << 20


class Encoder:
    """encode(texts) -> for each text its ids as little-endian uint32 bytes.

    Pieces are remembered in two generations of at most cache_size each (some 100 MB together): a full
    generation replaces the older one, and a piece met again moves to the newer.
    """

    def __init__(self, path: str, cache_size: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_size = cache_size
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.by_piece = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
            and model.get("type") == "BPE"
            and not model.get("dropout")
        )

    @staticmethod
    def _pack(encoding) -> bytes:
        return array("I", encoding.ids).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Make all the pieces known."""
        if len(self.known) > self.cache_size:
            self.older, self.known = self.known, {}
        new = []
        for p in set(pieces).difference(self.known):
            have = self.older.get(p)
            if have is None:
                new.append(p)
            else:
                self.known[p] = have
        self.known.update(zip(new, map(self._pack, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))

    def _pieces(self, text: str) -> list[str]:
        out: list[str] = []
        at = 0
        while len(text) - at > _LONG:
            cut = _CUT.search(text, at + _LONG)
            if not cut:
                break
            out += _PIECE.findall(text[at : cut.start()])
            at = cut.start()
        return out + _PIECE.findall(text[at:] if at else text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for text in texts:
            if not text:
                out.append(b"")
            elif self.by_piece and _PLAIN.match(text) and not any(s in text for s in self.special):
                pieces = self._pieces(text)
                try:
                    out.append(b"".join(map(self.known.__getitem__, pieces)))
                except KeyError:
                    self._learn(pieces)
                    out.append(b"".join(map(self.known.__getitem__, pieces)))
            else:
                out.append(self._pack(self.tokenizer.encode(text, add_special_tokens=False)))
        return out


CACHE = 350_000
_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache_size: int = CACHE) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if (path, cache_size) not in _encoders:
        _encoders[path, cache_size] = Encoder(path, cache_size)
    return _encoders[path, cache_size]


def release() -> None:
    """Forget this worker's encoders and the pieces they hold."""
    _encoders.clear()
