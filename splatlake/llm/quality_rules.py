"""Quality rules as a short-circuit cascade.

Each rule rejects a text by one statistic. On a bounded random sample every rule's cost (seconds a text) and selectivity
(share of texts it rejects) are measured; rules then run in the order of rejections per second, and a text that one rule
rejects is not seen by the later ones: it leaves the slice at once, and later statistics are computed without it. A text
is kept if no rule rejects it, so the order changes the cost and never a verdict.

``sift`` is the cascade alone. ``judge`` also returns the base statistics of every text; rules that need no more than
those cost nothing there, and are measured so.

Defined results: a null text has no words, is like an empty one, and fails the base rule; all statistics are 0 for it.
Repeated rows are judged each by itself. Other columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, repeated, slices

#: Texts in the sample on which the rules' costs and selectivities are measured.
SAMPLE = 1000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0x80:] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in "!?"]] = True


class Stats:
    """Statistics of some texts, each computed when a rule first asks for it, over the texts still alive."""

    def __init__(self, texts: pa.Array | Words, got: dict[str, np.ndarray] | None = None):
        self.w = texts if isinstance(texts, Words) else Words(texts)
        self._got: dict[str, np.ndarray] = got or {}

    def only(self, keep: np.ndarray) -> Stats:
        """The texts that ``keep`` marks, with what is known of them."""
        return Stats(self.w.only(keep), {k: v[keep] for k, v in self._got.items()})

    def get(self, name: str) -> np.ndarray:
        if name not in self._got:
            self._got[name] = getattr(self, f"_{name}")()
        return self._got[name]

    def _n_words(self):
        return self.w.count

    def _word_chars(self):
        return self.w.per_text(~self.w.blank & ((self.w.data & 0xC0) != 0x80))

    def _n_symbols(self):
        return self.w.per_text(_SYMBOL[self.w.data])

    def _n_upper(self):
        return self.w.per_text(_UPPER[self.w.data])

    def _n_letters(self):
        return self.w.per_text(_LETTER[self.w.data])

    def _n_cries(self):
        return self.w.per_text(_END[self.w.data])

    def _n_dup_lines(self):
        w = self.w
        breaks = np.flatnonzero(w.data == 10)
        start = np.union1d(w.at[:-1][w.at[:-1] < len(w.data)], breaks + 1)
        start = start[start < len(w.data)]
        # a line ends at its break or where its text ends
        doc = np.searchsorted(w.at, start, "right") - 1
        nxt = np.searchsorted(breaks, start)
        end = np.minimum(np.append(breaks, len(w.data))[nxt], w.at[doc + 1])
        has = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
        start, end, doc = start[has], end[has], doc[has]
        key = np.stack([doc.astype(np.uint64), w.spans(start, end)])
        order = np.lexsort(key)
        again = np.zeros(len(doc), bool)
        if len(doc) > 1:
            again[1:] = (key[:, order][:, 1:] == key[:, order][:, :-1]).all(0)
        out = np.zeros(w.n, np.int64)
        np.add.at(out, doc[order], again)
        return out

    def _n_repeat_words(self):
        w = self.w
        place, h = w.runs(8)
        twice = place[repeated(h + w.doc[place].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))]
        edge = np.zeros(len(w.start) + 9, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + 8, -1)
        inside = np.cumsum(edge)[: len(w.start)] > 0
        return np.bincount(w.doc[inside], minlength=w.n)

    def _n_stutters(self):
        w = self.w
        same = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        return np.bincount(w.doc[1:][same], minlength=w.n)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Stats], np.ndarray]


def _share(top: str, bottom: str, above: float) -> Callable[[Stats], np.ndarray]:
    return lambda s: s.get(top) > above * s.get(bottom)


#: The production rules. The first two are the base rules; the others reject layout debris, shouting and stutter.
RULES = (
    Rule("few_words", lambda s: s.get("n_words") < 20),
    Rule("repeated_windows", lambda s: 100 * s.get("n_repeat_words") > 30 * s.get("n_words")),
    Rule("mean_word_length", lambda s: (s.get("word_chars") < 2 * s.get("n_words")) | (s.get("word_chars") > 15 * s.get("n_words"))),
    Rule("symbols", _share("n_symbols", "n_words", 0.15)),
    Rule("upper_case", _share("n_upper", "n_letters", 0.25)),
    Rule("exclamations", _share("n_cries", "n_words", 0.25)),
    Rule("letters", lambda s: 2 * s.get("n_letters") < s.get("word_chars")),
    Rule("stutter", _share("n_stutters", "n_words", 0.15)),
    Rule("repeated_lines", lambda s: 2 * s.get("n_dup_lines") > 1 + s.get("n_words") // 5),
)


#: The statistics that ``judge`` returns of every text.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(batches: Iterator[pa.RecordBatch], given: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """For each rule: texts seen, rejections and seconds, each rule on its own where the ``given`` statistics are known."""
    for batch in batches:
        texts = batch.column("text")
        for i, j in slices(texts):
            words = Words(texts.slice(i, j - i))
            for rule in RULES:
                stats = Stats(words)
                for name in given:
                    stats.get(name)
                began = time.perf_counter()
                rejected = int(np.sum(rule.rejects(stats)))
                yield pa.RecordBatch.from_pydict({"rule": [rule.name], "seen": [j - i], "rejected": [rejected], "seconds": [time.perf_counter() - began]})


def plan(docs: DataFrame, given: tuple[str, ...] = (), sample: int = SAMPLE) -> list[str]:
    """The rules' names by rejections per second of a random sample, most first; ties and unseen rules in their given order."""
    share = min(1.0, sample / max(1, docs.count()))
    drawn = docs.select("text").sample(withReplacement=False, fraction=share, seed=11)
    rows = drawn.mapInArrow(lambda batches: measure(batches, given), "rule string, seen long, rejected long, seconds double").groupBy("rule").agg(F.sum("rejected").alias("r"), F.sum("seconds").alias("s")).collect()
    gain = {r["rule"]: r["r"] / max(r["s"], 1e-9) for r in rows}
    return sorted((r.name for r in RULES), key=lambda n: -gain.get(n, 0.0))


def cascade(stats: Stats, order: list[str]) -> tuple[np.ndarray, dict[str, int]]:
    """Marks the texts that no rule rejects, and counts the texts that each rule saw."""
    kept, alive, seen = np.ones(stats.w.n, bool), np.arange(stats.w.n), {}
    rules = {r.name: r for r in RULES}
    for name in order:
        seen[name] = len(alive)
        if not len(alive):
            continue
        bad = rules[name].rejects(stats)
        if bad.any():
            kept[alive[bad]] = False
            alive = alive[~bad]
            stats = stats.only(~bad)
    return kept, seen


def sift(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``docs`` without the texts that a rule rejects."""
    order = order or plan(docs)
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns]

    def run(batches):
        for batch in batches:
            texts = batch.column(docs_at)
            for i, j in slices(texts):
                kept, _ = cascade(Stats(texts.slice(i, j - i)), order)
                yield batch.slice(i, j - i).filter(pa.array(kept))

    docs_at = docs.columns.index("text")
    return docs.mapInArrow(run, ", ".join(kinds))


#: The columns that ``judge`` adds.
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def judge(docs: DataFrame, id_column: str = "doc_id", order: list[str] | None = None) -> DataFrame:
    """``id_column``, the base statistics of every text, and whether the cascade keeps it."""
    order = order or plan(docs, BASE)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, all_texts = batch.column(0), batch.column(1)
            for i, j in slices(all_texts):
                s = Stats(all_texts.slice(i, j - i))
                base = [s.get(n).astype(np.int64) for n in BASE]
                failed = (base[0] < 20) | (100 * base[4] > 30 * base[0])
                kept = cascade(s, order)[0] & ~failed
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *map(pa.array, base), pa.array(failed), pa.array(kept)], names=[id_column, *(c.split()[0] for c in SCHEMA.split(", "))])

    return docs.select(id_column, "text").mapInArrow(run, f"{id_column} {kind}, {SCHEMA}")
