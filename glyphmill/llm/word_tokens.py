"""Ids of the tokenizers library, made faster than it makes them.

``ByteTokens``: a byte-level vocabulary whose ids are in the order of its merges is encoded by tiktoken from the same
merges. ``WordTokens``: any vocabulary; a pattern of Python cuts the text into the words that the library cuts, each
word is encoded by the library once and remembered. Both do so only where the text has only characters of which the
pattern tells letters, digits and white space apart as the library does; any other text, and one with the name of a
special token in it, is encoded by the library as a whole.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache, partial

import numpy as np

from glyphmill.llm.remember import Remembered

#: Characters of which letters, digits and white space are told apart below as the library tells them apart:
#: ASCII, and Latin without the no-break space, superscript digits and fractions.
NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: Byte-level pattern: contractions, then letters, digits, other marks with one space before, then white space.
BYTE_LEVEL = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+"
#: Without white space and case: each digit is a word.
WORD_LEVEL = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+"
#: Words of the byte-level pattern for tiktoken, but for white space.
PIECES = r"'(?:[stmd]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
#: Without any of these, white space stands alone in a text of the characters above.
RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\v", "\f")
#: The names that byte-level vocabularies give to bytes: printable ones themselves, others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
NAMES = {b: b for b in _PRINTABLE} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class WordTokens:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        lower = self.lib.normalizer is not None
        self.lower = lower
        self.words = re.compile(WORD_LEVEL if lower else BYTE_LEVEL)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.model = self.lib.model
        self.known = Remembered(self._merge)

    def _merge(self, word: str) -> bytes:
        """A word that the pattern has cut out, by the vocabulary's merges alone."""
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(NAMES))]).tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if NOT_PLAIN.search(text) or ("<|" in text and any(s in text for s in self.special)):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        # Lower case of these characters is made one by one, as the library does; composed forms stay as they are.
        return self.known.join(self.words.findall(text.lower() if self.lower else text))


class ByteTokens:
    """Nothing is remembered, so a worker's memory doesn't grow with the words it meets; the library is loaded when a text asks for it."""

    known = None

    def __init__(self, path: str, spec: dict, merges: list[list[str]]):
        import tiktoken

        bytes_of = {name: b for b, name in NAMES.items()}
        ranks = {bytes(bytes_of[ord(c)] for c in t): i for t, i in spec["model"]["vocab"].items() if i < 256 + len(merges)}
        encoder = partial(tiktoken.Encoding, mergeable_ranks=ranks, special_tokens={})
        self.path, self._lib = path, None
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.full = encoder("bytes", pat_str=PIECES + r"|\s+(?!\S)|\s+").encode_ordinary
        self.single = encoder("bytes-single", pat_str=PIECES + r"|\s").encode_ordinary  # faster; where white space stands alone

    @property
    def lib(self):
        if self._lib is None:
            from tokenizers import Tokenizer

            self._lib = Tokenizer.from_file(self.path)
        return self._lib

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text.isascii() and NOT_PLAIN.search(text) or ("<|" in text and any(s in text for s in self.special)):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return array("I", (self.full if any(map(text.__contains__, RUNS)) else self.single)(text)).tobytes()


def _ordered_merges(spec: dict) -> list[list[str]] | None:
    """The merges of a byte-level vocabulary whose ids from 256 on are in the order of its merges; None for any other."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or model.get("end_of_word_suffix"):
        return None
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return merges if all(model["vocab"].get(a + b) == 256 + k for k, (a, b) in enumerate(merges)) else None


@lru_cache(maxsize=4)
def load(path: str) -> WordTokens | ByteTokens:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = _ordered_merges(spec)
    return WordTokens(path) if merges is None else ByteTokens(path, spec, merges)
