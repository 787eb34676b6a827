"""Token counts of whole texts; huge ones by overlapping chunks spliced at proven boundaries."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .encoding import CALL_CHARS, count_tokens, load

CHUNK = 32_768
OVERLAP = 512
#: Tokens at the end of a chunk that the cut may have changed and that prove nothing.
UNSETTLED = 8


class _Json:
    def __init__(self, path: str, text: str):
        self.e = load(path).encode(text, add_special_tokens=False)
        self.ids = self.e.ids

    def before(self, i: int, space: bool) -> int:
        """How many tokens lie before character i; -1: one spans it.

        Tokens may leave out white space that they begin with, so before a space what ends there is
        asked for (its last character is one byte), else what begins there.
        """
        if space:
            k = self.e.char_to_token(i - 1)
            return -1 if k is None or self.e.token_to_chars(k)[1] != i else k + 1
        k = self.e.char_to_token(i)
        return -1 if k is None or self.e.token_to_chars(k)[0] != i else k


class _Model:
    def __init__(self, path: str, text: str):
        got = load(path).encode(text, return_type="proto")
        self.text, self.ids = text, [p.id for p in got.pieces]
        self.ends = np.array([p.end for p in got.pieces], np.int64)  # in bytes

    def before(self, i: int, space: bool) -> int:
        at = len(self.text[:i].encode())
        k = int(np.searchsorted(self.ends, at, "right"))
        return k if k and self.ends[k - 1] == at else -1


@cache
def parts_at_marks(path: str) -> bool:
    """Whether the tokenizer parts letters from the marks behind them before it merges anything: byte-level ones by their pattern."""
    if not path.endswith(".json"):
        return False
    rule = json.loads(load(path).to_str()).get("pre_tokenizer") or {}
    return any(x.get("type") == "ByteLevel" and x.get("use_regex", True) for x in [rule, *rule.get("pretokenizers", [])])


def _stable(text: str, lo: int, hi: int, marks: bool) -> Iterator[tuple[int, bool]]:
    """Positions from lo to hi, from the middle outwards, where text is parted whatever stands around, and whether a space follows.

    A visible ASCII character followed by one space or line end: the tokenizers here part their
    input before such white space, and what follows is parted from there on by what follows alone;
    so both chunks, if they agree on the tokens behind such a place, agree with the whole text.
    With marks also a letter of any script followed by a full stop, comma or bracket of any script
    (category P but no apostrophe): a run of letters ends there, and marks begin a piece. This is
    what scripts without spaces have.
    """
    mid = (lo + hi) // 2
    for i in sorted(range(lo, hi), key=lambda i: abs(i - mid)):
        if text[i] in " \n" and "!" <= text[i - 1] <= "~" and not text[i + 1 : i + 2].isspace():
            yield i, True
        elif marks and text[i] not in "'_" and text[i - 1].isalpha() and category(text[i])[0] == "P" and category(text[i - 1])[0] == "L":
            yield i, False


def _splice(text: str, a: object, a_at: int, b: object, b_at: int, places: list[tuple[int, bool]]) -> tuple[int, int] | None:
    """Tokens of chunk a before, and of chunk b before, a common stable boundary; None: there is none."""
    for i, space in places:
        m, n = a.before(i - a_at, space), b.before(i - b_at, space)
        if m < 0 or n < 0:
            continue
        settled = a.ids[m : len(a.ids) - UNSETTLED]
        if settled and settled == b.ids[n : n + len(settled)]:
            return m, n
    return None


def count_spliced(path: str, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text of any length, from chunks that are longer only where nothing parts the text.

    An overlap without a stable boundary is widened without encoding anything; a chunk without one
    is doubled, so that what is encoded stays in proportion to the text.
    """
    kind, marks = _Json if path.endswith(".json") else _Model, parts_at_marks(path)
    at, end, total, skip, grown = 0, min(chunk, len(text)), 0, 0, chunk
    now = None
    while end < len(text):
        wide, found = overlap, None
        while True:
            start = max(at + 1, end - wide)
            places = list(_stable(text, max(start + 1, at + 1), end - 1, marks))
            if places:
                far = min(len(text), max(start + chunk, end + 1))
                now = now or kind(path, text[at:end])
                after = kind(path, text[start:far])
                found = _splice(text, now, at, after, start, places)
                if found and found[0] >= skip:
                    break
                found = None
            if start == at + 1:
                break
            wide *= 2
        if found:
            total += found[0] - skip
            skip, at, end, now, grown = found[1], start, far, after, chunk
        else:  # no common boundary in the whole chunk
            grown *= 2
            end, now = min(len(text), at + grown), None
    now = now or kind(path, text[at:end])
    return total + len(now.ids) - skip


def count_batch(path: str, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    group: list[int] = []
    size = 0

    def flush() -> None:
        if group:
            out[group] = count_tokens(path, [texts[i] for i in group])
            group.clear()

    for i, text in enumerate(texts):
        if len(text) > chunk:
            out[i] = count_spliced(path, text, chunk, overlap)
        elif text:
            group.append(i)
            size += len(text)
            if size > CALL_CHARS:
                flush()
                size = 0
    flush()
    return out


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs.

    Tokens are those that the library of the tokenizer file gives for the whole text, without
    begin, end or added tokens; strings of special tokens inside texts are handled as its default.
    Texts longer than chunk characters are encoded in overlapping chunks; where no common boundary
    can be proven in an overlap it is doubled, in the end to the whole chunk, which then doubles.
    A null or empty text has 0 bytes and 0 tokens; doc_id may be null or repeated; other columns
    are not read; an empty table gives an empty result. No shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n_bytes = pa.array([len(x.encode()) for x in texts], pa.int64())
            n = count_batch(path, texts, chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(count), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
