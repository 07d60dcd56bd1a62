"""Token ids of whole texts by a tokenizers file that drops white space, with a cache of words.

The pre-tokenizer of such a file never joins text across ASCII white space, so a text's ids are its words' ids in a row
(checked when the file is loaded). A worker keeps the ids of words it has seen and asks the library for new words only.
Words of Latin-1 letters with or without punctuation behind them, which are nearly all, are single pre-tokens of letters
and of punctuation: their letters go to the file's BPE model directly, if that agrees with the whole tokenizer on
PROBES. All other words go through the whole tokenizer, many at a time, set apart by a special token.

Texts are split in Arrow, and of the words of about PORTION bytes each is looked up once; words of letters are looked up and
kept by their letters, without capitals A-Z and the punctuation behind them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tideline.llm.common import run_starts

LETTERS = "".join(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
PLAIN = re.compile(rf"([{LETTERS}]+)([!-/:-@\[-`{{-~]*)")
PUNCTUATION = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())
PROBES = ["The", "a,", "word.", "Éñöß!!", "ÀÉÎõü&&&", "straße);", "zeitung...", "x$$$", "l'", "QUICK", "ÿþýÞ?", "of", "internationalization,", "ôœ"]
#: Bytes of text that are split into words at a time.
PORTION = 8_000_000

_LOADED: dict[str, WordTokenizer] = {}


class WordTokenizer:
    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        added = self.tokenizer.get_added_tokens_decoder().items()
        self.mark = next(((i, t.content) for i, t in added if t.special and not t.normalized and not t.lstrip and not t.rstrip), None)
        self.cache: dict[bytes, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.limit = limit
        whole = self._plain([" ".join(PROBES) + " \n " + PROBES[0]])[0]
        if whole != [i for ids in self._plain([*PROBES, PROBES[0]]) for i in ids]:
            raise ValueError(f"{path} does not encode texts word by word")
        self.model = self.tokenizer.model
        self.packed = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.as_bytes = self._byte_letters()
        if self.as_bytes is not None and any(self._letters(m) != self._pack(self._plain([m[0]])[0]) for m in map(PLAIN.fullmatch, PROBES) if m):
            self.as_bytes = None

    def _byte_letters(self) -> dict[int, str] | None:
        """How the pre-tokenizer writes each lower-case letter; None if it does not split texts so."""
        try:
            written = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c) for c in set(LETTERS.lower())}
        except Exception as why:  # a pre-tokenizer of another kind
            if "pre_tokenize" not in str(why) and not isinstance(why, AttributeError):
                raise
            return None
        plain = all(len(w) == 1 and (w[0][0] == c or not c.isascii()) for c, w in written.items())
        return {ord(c): w[0][0] for c, w in written.items()} if plain else None

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _plain(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, found: re.Match) -> bytes:
        """The ids of a word of letters and trailing punctuation."""
        letters, tail = found.groups()
        if tail not in self.tails:
            self.tails[tail] = self._pack(self._plain([tail])[0])
        letters = letters.lower()
        known = self.cache.get(letters.encode())  # the same letters without capitals and tail
        if known is not None:
            return known + self.tails[tail]
        return self._modelled(letters) + self.tails[tail]

    def _modelled(self, letters: str) -> bytes:
        """The ids of lower-case letters."""
        if not letters.isascii():
            letters = letters.translate(self.as_bytes)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(letters)])

    def _learn(self, words: list[bytes]) -> None:
        others = []
        for word in words:
            found = PLAIN.fullmatch(word.decode()) if self.as_bytes is not None else None
            if found:
                self.cache[word] = self._letters(found)
            else:
                others.append(word)
        texts = [w.decode() for w in others]
        odd = [k for k, t in enumerate(texts) if self.mark is None or "<" in t]
        for k, ids in zip(odd, self._plain([texts[k] for k in odd]), strict=True):
            self.cache[others[k]] = self._pack(ids)
        rest = [k for k, t in enumerate(texts) if self.mark is not None and "<" not in t]
        for at in range(0, len(rest), 256):
            part = rest[at : at + 256]
            ids = np.array(self._plain([self.mark[1].join([texts[k] for k in part])])[0], dtype=np.int64)
            for k, own in zip(part, np.split(ids, np.flatnonzero(ids == self.mark[0])), strict=True):
                self.cache[others[k]] = (own[1:] if len(own) and own[0] == self.mark[0] else own).astype(self.dtype).tobytes()

    def _forget(self, words: list[bytes]) -> None:
        """Keeps the ids of these words only, if there are too many."""
        if len(self.cache) + len(self.tails) > self.limit:
            self.cache = {w: self.cache[w] for w in words if w in self.cache}
            self.tails = {"": b""}

    def _looked_up(self, words: list[bytes]) -> list[bytes]:
        found = list(map(self.cache.get, words))
        new = [k for k, ids in enumerate(found) if ids is None]
        if new:
            self._learn(list(dict.fromkeys([words[k] for k in new])))
            for k in new:
                found[k] = self.cache[words[k]]
        return found

    def word_ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes of self.dtype."""
        self._forget(words)
        return self._looked_up(words)

    def _letters_ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words of nothing but letters."""
        found = list(map(self.cache.get, words))
        for k in [k for k, ids in enumerate(found) if ids is None]:
            found[k] = self.cache[words[k]] = self._modelled(words[k].decode().lower())
        return found

    def _distinct_ids(self, words: pa.Array) -> np.ndarray:
        """The ids of each of some distinct words."""
        if self.as_bytes is None:
            return objects(self.word_ids(byte_words(words)))
        small = pc.ascii_lower(words)
        letters = pc.ascii_rtrim(small, characters=PUNCTUATION)
        coded = letters.dictionary_encode()
        plain = pc.match_substring_regex(coded.dictionary, f"^[{LETTERS}]+$")
        stems = byte_words(coded.dictionary.filter(plain))
        plain, at = plain.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        others = np.flatnonzero(~plain[at])
        other_words = byte_words(words.take(pa.array(others)))
        self._forget(stems + other_words)
        of_stem = np.full(len(plain), None, dtype=object)
        of_stem[plain] = objects(self._letters_ids(stems))
        ids = of_stem[at]
        ids[others] = objects(self._looked_up(other_words))
        cut = pc.binary_length(letters).to_numpy()
        tailed = np.flatnonzero(plain[at] & (pc.binary_length(small).to_numpy() > cut))
        tails = [w[n:] for w, n in zip(byte_words(small.take(pa.array(tailed))), cut[tailed].tolist(), strict=True)]
        distinct = list(dict.fromkeys(tails))
        of_tail = dict(zip(distinct, self._looked_up(distinct), strict=True))
        ids[tailed] = objects([a + of_tail[b] for a, b in zip(ids[tailed].tolist(), tails, strict=True)])
        return ids

    def text_ids(self, texts: pa.Array) -> Iterator[list[bytes]]:
        """Of each text the ids of its words, in order; a null or blank text has one word without ids."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
        for a, b in pairwise([*run_starts(np.cumsum(sizes, dtype=np.int64) // PORTION).tolist(), len(texts)]):
            words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts.slice(a, b - a), "")))
            coded = words.flatten().dictionary_encode()
            found = self._distinct_ids(coded.dictionary)[coded.indices.to_numpy()]
            for first, end in pairwise(words.offsets.to_pylist()):
                yield found[first:end].tolist()

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.word_ids((text or "").encode().split())), self.dtype)


def byte_words(words: pa.Array) -> list[bytes]:
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def objects(values: list) -> np.ndarray:
    return np.array(values, dtype=object)


def tokenizer(path: str, limit: int = 500_000) -> WordTokenizer:
    """One per worker and file; limit is the number of words that it keeps."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path, limit)
    _LOADED[path].limit = limit
    return _LOADED[path]


def vocabulary_size(path: str) -> int:
    return tokenizer(path).tokenizer.get_vocab_size()
