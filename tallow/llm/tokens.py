"""Token ids of the public tokenizer files, word by word.

The file has an NFC and lower-case normalizer, drops white space and merges inside pieces that hold no white
space, so a text's ids are its words' ids in order. Distinct words are encoded once a batch, and a bounded cache keeps
them between batches. Merging itself runs in tiktoken: each piece gets an end byte (0xFF, in no UTF-8 text), pairs of a
byte and the end byte are merged first, as the file's ids 256 to 511 are its bytes with a word end, and the ids
give the order of the other merges. Words with a special token's string or a capital sigma go to the tokenizers library.
"""

from __future__ import annotations

import gc
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa

from .common import Words, ragged

#: Words that a task's cache holds; it starts anew beyond.
CACHE_WORDS = 300_000
END = b"\xff"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        import tiktoken

        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            vocab: dict[str, int] = json.load(f)["model"]["vocab"]
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {}
        for token, i in vocab.items():
            if token.startswith("<|"):
                continue
            end = token.endswith("</w>")
            ranks[bytes(byte_of[c] for c in (token[:-4] if end else token)) + END * end] = i
        ranks.setdefault(END, max(vocab.values()) + 1)
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.single = self.core.encode_single_piece
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+").findall
        self.cache: dict[bytes, list[int]] = {}

    def word(self, w: bytes) -> list[int]:
        if w.isalpha():  # ASCII letters only
            return self.single(w.lower() + END)
        s = w.decode()
        if "Σ" in s or "<|" in s:
            return self.by_library(s)
        if not w.isascii():
            s = unicodedata.normalize("NFC", s)
        s = s.lower()
        if s.isalpha():
            return self.single(s.encode() + END)
        if s[:-1].isalpha() and s[-1] in ".,":
            return self.single(s[:-1].encode() + END) + self.single(s[-1].encode() + END)
        out: list[int] = []
        for p in self.pieces(s):
            out += self.single(p.encode() + END)
        return out

    def by_library(self, s: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(s, add_special_tokens=False).ids

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and each text's number of ids."""
        words = Words(texts)
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        ids: list[int] = []
        lens: list[int] = []
        gc.disable()  # the many small lists hold no cycles
        for w in words.vocab:
            got = cache.get(w)
            if got is None:
                got = cache[w] = self.word(w)
            ids += got
            lens.append(len(got))
        gc.enable()
        lens = np.array(lens, dtype=np.int64)
        flat = np.array(ids, dtype=np.uint32)
        starts = np.cumsum(lens) - lens
        per_word = lens[words.codes]
        out = flat[ragged(starts[words.codes], per_word)] if len(per_word) else np.zeros(0, dtype=np.uint32)
        ends = np.concatenate([[0], np.cumsum(per_word)])
        return out, np.diff(ends[words.offsets])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a file and Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
