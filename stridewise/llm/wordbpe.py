"""Fast, exact ids of a public byte-pair vocabulary with word ends.

Most texts are cut into words by one byte-level pattern, and each distinct
word is merged once per worker. Texts with characters for which this would
need Unicode tables go through the tokenizer library as a whole. Strings that
look like special tokens are ordinary text.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np

from stridewise.llm.common import worker_memory

#: Words that a worker remembers the ids of.
REMEMBERED = 150_000

#: Latin-1 bytes of texts that the fast way takes: tab, line ends, printable ASCII and letters.
_SAFE = bytes([9, 10, 13, *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
_LOWER = bytes(b + 32 if 65 <= b <= 90 or (0xC0 <= b <= 0xDE and b != 0xD7) else b for b in range(256))
_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")
_PACK = [struct.Struct(f"<{n}H").pack for n in range(32)]
_END = b"\xff"  # no byte of UTF-8: stands for the end of a word


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that such vocabularies write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in plain):
        chars[chr(256 + n)] = b
    return chars


class WordBpe(dict):
    """Maps a lower-case Latin-1 word to its packed 16-bit ids, made when first asked for."""

    def __init__(self, path: str):
        import tiktoken

        super().__init__()
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        of = _byte_of_char()
        ranks = {}
        for token, number in vocabulary.items():
            ending = token.endswith("</w>")
            ranks[bytes(of[c] for c in (token[:-4] if ending else token)) + (_END if ending else b"")] = number
        self._merge = tiktoken.Encoding("word-ends", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._path, self._whole = path, None

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        packed = _PACK[len(ids)](*ids) if len(ids := self._merge((word if word.isascii() else word.decode("latin-1").encode()) + _END)) < 32 else np.array(ids, "<u2").tobytes()
        self[word] = packed
        return packed

    def _library(self):
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._path)
            self._whole.encode_special_tokens = True
        return self._whole

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text as unsigned 16-bit numbers."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            raw = b"\x00"
        if raw.translate(None, _SAFE):
            return np.array(self._library().encode(text, add_special_tokens=False).ids, "<u2")
        return np.frombuffer(b"".join(map(self.__getitem__, _WORDS.findall(raw.translate(_LOWER)))), "<u2")


def load(path: str) -> WordBpe:
    """The vocabulary at ``path``, read once per worker."""
    memory = worker_memory(f"vocabulary-{path}")
    if "bpe" not in memory:
        memory["bpe"] = WordBpe(path)
    return memory["bpe"]
