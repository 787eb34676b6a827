"""Tokenizer files as encoders: whole texts, overlapping chunks with offsets, and words kept by value."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LOADED: dict[str, object] = {}
#: Text given to the library in one call; its results take some hundred times as much memory.
CALL_CHARS = 200_000


def load(path: str):
    """The library's tokenizer of a .json (tokenizers) or .model (sentencepiece) file, once for each worker."""
    if path not in _LOADED:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(path)
            made.no_truncation()
            made.no_padding()
        elif path.endswith(".model"):
            import sentencepiece

            made = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            raise ValueError(f"neither .json nor .model: {path}")
        _LOADED[path] = made
    return _LOADED[path]


def count_tokens(path: str, texts: list[str]) -> list[int]:
    """Tokens of each whole text as the library gives them, without added special tokens."""
    made = load(path)
    if path.endswith(".model"):
        return [len(x) for x in made.encode(texts, num_threads=1)]
    return [len(x) for x in made.encode_batch_fast(texts, add_special_tokens=False)]


#: A mark behind an ASCII letter begins a piece of its own; apostrophes and what special tokens hold are left alone.
_MARK = re.compile(rb"[!#-&(-/:;=?@\[-`{}~](?<=[A-Za-z].)")
#: Only a to z and the small letters of Latin-1.
_SMALL = re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch
#: How byte-level tokenizers spell bytes: visible Latin-1 as itself, the others from U+0100 on.
_SEEN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SPELLED = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SEEN)} | {0x20: 0x20}


class _Slots(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space and never joins what white space parts.

    Each different word is encoded by the library once and kept. When the store holds more than
    words words or ids ids, only words that were met again stay, or none if those are too many, so
    its memory is bounded. With lower (for tokenizers that
    lower-case anyway) ASCII letters are lower-cased beforehand, except in texts that may hold a
    special token's string.
    """

    def __init__(self, path: str, lower: bool = False, words: int = 400_000, ids: int = 3_000_000):
        self.made, self.lower, self.words, self.ids = load(path), lower, words, ids
        self.bare = self._bare(path)
        self.special = [x.content.encode() for x in self.made.get_added_tokens_decoder().values()]
        self._empty()

    def _empty(self) -> None:
        self.slot = _Slots()
        self.pool = np.empty(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.again = np.zeros(1 << 14, bool)
        self.used = 0

    def _thin(self) -> None:
        stay = np.flatnonzero(self.again[: len(self.slot)])
        if 2 * len(stay) > self.words:
            return self._empty()
        words, first = list(self.slot), self.start[stay]
        lens = self.start[stay + 1] - first
        ids = self.pool[np.repeat(first - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum())]
        self._empty()
        self._keep([words[i] for i in stay.tolist()], ids, lens)

    def _keep(self, words: list[bytes], ids: np.ndarray, lens: np.ndarray) -> None:
        n, k = self.used + len(ids), len(self.slot)
        if n > len(self.pool):
            self.pool = np.resize(self.pool, 2 * n)
        if k + len(words) + 1 > len(self.start):
            self.start = np.resize(self.start, 2 * (k + len(words) + 1))
            self.again = np.resize(self.again, len(self.start))
        self.pool[self.used : n] = ids
        self.start[k + 1 : k + len(words) + 1] = self.used + np.cumsum(lens)
        self.again[k : k + len(words)] = False
        self.slot.update(zip(words, range(k, k + len(words)), strict=True))
        self.used = n

    def _bare(self, path: str):
        """The same library and model without the steps that leave small Latin letters as they are.

        Words of those letters alone are not changed by NFC or lower-casing, have no white space
        inside and are one piece for any pattern that takes runs of letters; their bytes are spelled
        out by _SPELLED. Needs a model that marks the last token of a piece. A sample is compared
        with the whole tokenizer, and where it differs only that is used.
        """
        from tokenizers import Tokenizer, pre_tokenizers

        suffix = json.loads(self.made.to_str())["model"].get("end_of_word_suffix")
        if not suffix:
            return None
        bare = Tokenizer.from_file(path)
        bare.normalizer, bare.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(bare.get_vocab_size(), bool)
        self.last[[i for t, i in bare.get_vocab().items() if t.endswith(suffix)]] = True
        sample = "a the thnti heitöpf éauxtion ß ÿ ståmenteleouieraux zzzzqqqxjk"
        want = self.made.encode(sample, add_special_tokens=False).ids
        return bare if want == bare.encode(sample.encode().decode("latin-1").translate(_SPELLED), add_special_tokens=False).ids else None

    def _learn(self, new: list[bytes]) -> None:
        """Many words are encoded in one call, parted by spaces, and told apart by last tokens or by offsets."""
        plain, other = [], new
        if self.bare:
            plain, other = [], []
            for w in sorted(new, key=bytes.isascii):  # ASCII ones together
                (plain if _SMALL(w.decode()) else other).append(w)
        for at in range(0, len(plain), 8192):
            part = plain[at : at + 8192]
            text = (joined := b" ".join(part)).decode("latin-1")
            ids = np.array(self.bare.encode_batch_fast([text if joined.isascii() else text.translate(_SPELLED)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):
                self._keep(part, ids, np.diff(np.r_[0, ends]))
            else:
                other += part
        for at in range(0, len(other), 8192):
            part = other[at : at + 8192]
            texts = [w.decode() for w in part]
            got = self.made.encode(" ".join(texts), add_special_tokens=False)
            starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
            of = np.searchsorted(starts, np.array([a for a, _ in got.offsets], np.int64), "right") - 1
            self._keep(part, np.array(got.ids, np.uint32), np.bincount(of, minlength=len(part)))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and how many each text has."""
        own = []
        for text in texts:
            if self.lower:
                low = text.lower()
                if b"<" not in low or not any(x in low for x in self.special):
                    text = low
            own.append(_MARK.sub(rb" \g<0>", text))
        # ASCII white space only; any other is left to the library.
        parts = pc.ascii_split_whitespace(pa.array(own, pa.large_binary()).cast(pa.large_string()))
        ends, coded = parts.offsets.to_numpy(), parts.flatten().cast(pa.large_binary()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.slot) > self.words or self.used > self.ids:
            self._thin()
        known = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
        self.again[known[known >= 0]] = True
        if len(unknown := np.flatnonzero(known < 0)):
            missing = [words[i] for i in unknown.tolist()]
            self._learn(missing)
            known[unknown] = np.fromiter(map(self.slot.__getitem__, missing), np.int64, len(missing))
        at, lens = coded.indices.to_numpy(), (self.start[known + 1] - self.start[known]).astype(np.int32)
        lens, first = lens[at], self.start[known].astype(np.int32)[at]
        after = np.zeros(len(at) + 1, np.int32)
        np.cumsum(lens, out=after[1:])
        place = np.repeat(first - after[:-1], lens)
        place += np.arange(len(place), dtype=np.int32)
        return self.pool[place], np.diff(after[ends])
