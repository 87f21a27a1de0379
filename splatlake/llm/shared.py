"""What the corpus operators share: tables, folds, and vectorised tokenising of Arrow text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, ready  # noqa: F401

#: Texts are tokenised in slices of about so many bytes, whatever the size of an Arrow batch.
SLICE_BYTES = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C55)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_power: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(id_column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % n


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _power.get(name)
    if have is None or len(have) < n:
        seq = np.full(max(n, SLICE_BYTES + (1 << 16)), base, np.uint64)
        seq[0] = 1
        have = _power[name] = np.multiply.accumulate(seq)
    return have


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``most`` bytes of text, one row at least."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, i = np.concatenate([[0], np.cumsum(size)]), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        yield i, j
        i = j


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts together and each text's offset in them; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts: where each starts and ends, its text and a 64-bit hash of it."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.at = raw(column)
        if lower:
            upper = (self.data >= 65) & (self.data <= 90)
            self.data = self.data + (upper * np.uint8(32)).astype(np.uint8)
        self.n = len(self.at) - 1
        blank = _BLANK[self.data]
        before = np.empty(len(blank), bool)
        before[:1] = True
        before[1:] = blank[:-1]
        first = self.at[:-1][self.at[:-1] < len(blank)]
        before[first] = True
        after = np.empty(len(blank), bool)
        after[-1:] = True
        after[:-1] = blank[1:]
        after[first[first > 0] - 1] = True
        self.blank = blank
        self.start = np.flatnonzero(~blank & before)
        self.end = np.flatnonzero(~blank & after) + 1
        self.doc = np.searchsorted(self.at, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.n)
        #: place of each text's first word
        self.word_at = np.concatenate([[0], np.cumsum(self.count)])
        self._sums = None

    def only(self, keep: np.ndarray) -> Words:
        """The words of the texts that ``keep`` marks."""
        out, size = object.__new__(Words), np.diff(self.at)
        before = np.cumsum(np.where(keep, 0, size))
        byte, word = np.repeat(keep, size), keep[self.doc]
        out.data, out.blank, out.n = self.data[byte], self.blank[byte], int(keep.sum())
        out.at = np.concatenate([[0], np.cumsum(size[keep])])
        doc = self.doc[word]
        out.start, out.end = self.start[word] - before[doc], self.end[word] - before[doc]
        out.doc, out.count = (np.cumsum(keep) - 1)[doc], self.count[keep]
        out.word_at, out._sums = np.concatenate([[0], np.cumsum(out.count)]), None
        if hasattr(self, "_hash"):
            out._hash = self._hash[word]
        return out

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span."""
        if self._sums is None:
            n = len(self.data)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers("p", _P, n + 1)[:n], out=self._sums[1:])
        inverse = _powers("i", _P_INV, len(self.data) + 1)
        return mix((self._sums[end] - self._sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            self._hash = self.spans(self.start, self.end)
        return self._hash

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """How many of the marked bytes each text has."""
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return total[self.at[1:]] - total[self.at[:-1]]

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each run of ``k`` words inside one text: the place of its first word, and a hash."""
        h, n = self.hash, len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(0xA24BAED4963EE407) + h[j : j + n]
        inside = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return inside, mix(out[inside])


def repeated(key: np.ndarray) -> np.ndarray:
    """Marks the keys that occur twice or more."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.zeros(len(s), bool)
    out[order] = same
    return out
