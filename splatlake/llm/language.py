"""Language identification: scripts narrow the candidates, Viterbi labels the words.

A model holds, for every language, the log-likelihoods of letter trigrams (hashed to a fixed number of buckets) and the
scripts its letters are in. Scripts are ranges of code points, the runs of letters whose Unicode names begin with one
script's name. Of a text, every run of letters is a word; a word's script leaves only languages written in it, and all
where no language is; a Viterbi path over the words' scores, with a penalty for each switch, gives spans of one language. The prediction is
the language with the most letters on the path, the score its share of the letters.

A path without switch is optimal if no stretch of words gains more than its switches cost. That is tested on running
sums first, so the step-by-step recursion runs only on texts where a switch may pay.

The model is fitted on a Bernoulli sample of labelled rows, of ``SAMPLE`` rows for each language on average.

Defined results: null texts and texts without a letter, or any text where nothing was learned, give ``und``, score 0 and
no spans. Ties go to the language first by code point. Repeated rows get equal results; other columns are passed over;
an empty table gives an empty result. Null languages are not learned. Ids may be null (their fold is that of '').
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mix, slices

#: Labelled rows a language is learned from, on average.
SAMPLE = 400
#: Buckets of letter trigrams.
BUCKETS = 1 << 16
#: What a switch of language costs, in nats.
SWITCH = 15.0
#: A language is written in a script that holds this share of its letters.
WRITTEN = 0.02
_BARRED = -60.0
#: Scripts that a model tells apart, at most; 0 stands for letters of no script of their own.
SCRIPTS = 512
#: First words of character names that say nothing of the script, and those that mean one script.
_FORMS = ("HALFWIDTH", "FULLWIDTH", "SMALL", "VERTICAL", "CIRCLED")
_NO_SCRIPT = ("MODIFIER", "MATHEMATICAL", "MASCULINE", "FEMININE", "MICRO", "KELVIN", "OHM", "ANGSTROM", "SCRIPT", "BLACK-LETTER", "DOUBLE-STRUCK")
_SAME = {"HIRAGANA": "KANA", "KATAKANA": "KANA", "KATAKANA-HIRAGANA": "KANA", "IDEOGRAPHIC": "CJK"}
_tables: list = []


def script_of(letter: str) -> str:
    """The script of a letter by its Unicode name, or ''."""
    words = [w for w in unicodedata.name(letter, "").split(" ") if w not in _FORMS]
    if not words or words[0] in _NO_SCRIPT:
        return ""
    return _SAME.get(words[0], words[0])


def ranges() -> list[tuple[int, int, str]]:
    """Script ranges (first, last, script): the runs of letters of one script."""
    out: list[tuple[int, int, str]] = []
    for i in range(0x110000):
        if chr(i).isalpha():
            name = script_of(chr(i))
            if out and out[-1][1] == i - 1 and out[-1][2] == name:
                out[-1] = (out[-1][0], i, name)
            else:
                out.append((i, i, name))
    return out


def tables() -> list:
    """For each code point: whether it is a letter, its lower case where that is one code point, its script."""
    if not _tables:
        n = 0x110000
        letter, script, names = np.zeros(n, bool), np.zeros(n, np.int16), {"": 0}
        lower = np.arange(n, dtype=np.uint32)
        for first, last, name in ranges():
            letter[first : last + 1] = True
            script[first : last + 1] = names.setdefault(name, len(names))
        for i in np.flatnonzero(letter).tolist():
            x = chr(i).lower()
            if len(x) == 1:
                lower[i] = ord(x)
        _tables.extend((letter, lower, script))
    return _tables


class Letters:
    """The words of some texts, runs of letters, and the trigram bucket of each letter."""

    def __init__(self, texts: list[str]):
        letter, lower, script = tables()
        self.points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        is_letter = letter[self.points]
        cps = np.where(is_letter, lower[self.points], 0).astype(np.uint64)
        left, right = np.zeros(len(cps), np.uint64), np.zeros(len(cps), np.uint64)
        left[1:], right[:-1] = cps[:-1], cps[1:]
        inner = self.at[1:-1]
        inner = inner[(inner > 0) & (inner < len(cps))]
        left[inner], right[inner - 1] = 0, 0
        where = np.flatnonzero(is_letter)
        self.bucket = (mix(left[where] * np.uint64(0x1000003) + cps[where] * np.uint64(0x9E3779B1) + right[where] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)).astype(np.int64)
        opens = left[where] == 0
        #: place among the letters of each word's first letter
        self.word = np.flatnonzero(opens)
        self.first = where[self.word]
        self.last = where[np.append(self.word[1:], len(where))[: len(self.word)] - 1] + 1
        self.size = np.diff(np.append(self.word, len(where)))
        self.doc = np.searchsorted(self.at, self.first, "right") - 1
        self.word_at = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.letter_script = script[self.points[where]]
        # a word is in the script of its first letter that has one
        own = np.where(self.letter_script > 0, np.arange(len(where)), len(where))
        first = np.minimum.reduceat(own, self.word) if len(self.word) else own[:0]
        self.script = np.append(self.letter_script, 0)[first]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # languages x buckets
    written: np.ndarray  # languages x scripts

    def scores(self, x: Letters) -> np.ndarray:
        """Words x languages."""
        if not len(x.word):
            return np.zeros((0, len(self.languages)))
        out = np.stack([np.add.reduceat(w[x.bucket], x.word) for w in self.weights], 1).astype(np.float64)
        allowed = self.written.T[x.script]
        allowed[(x.script == 0) | ~allowed.any(1)] = True
        return np.where(allowed, out, out + _BARRED)


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word; ties stay, then go to the first."""
    total = scores.sum(0)
    best = int(np.argmax(total))
    gain = np.cumsum(scores - scores[:, best : best + 1], 0)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, scores.shape[1])), gain[:-1]]))
    if (gain - low).max() <= switch:
        return np.full(len(scores), best)
    value, back = scores[0].copy(), np.zeros(scores.shape, np.int32)
    stay = np.arange(scores.shape[1], dtype=np.int32)
    for t in range(1, len(scores)):
        top = int(value.argmax())
        moved = value < value[top] - switch
        back[t] = np.where(moved, top, stay)
        value = np.maximum(value, value[top] - switch) + scores[t]
    path = np.empty(len(scores), np.int64)
    path[-1] = value.argmax()
    for t in range(len(scores) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def learn(docs: DataFrame, labelled: Column, sample: int = SAMPLE) -> Model:
    """A model of the rows that ``labelled`` marks and whose text and lang are not null."""
    rows = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, SCRIPTS), bool))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1_000_003)) / 1_000_003.0
    chance = F.lit(sample) / F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, float(n))]), F.col("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).to_pylist()
            for i, j in slices(batch.column(1)):
                texts = batch.column(1).slice(i, j - i).to_pylist()
                for name in sorted(set(lang[i:j])):
                    x = Letters([t for t, of in zip(texts, lang[i:j], strict=True) if of == name])
                    both = np.concatenate([np.bincount(x.bucket, minlength=BUCKETS), np.bincount(x.letter_script, minlength=SCRIPTS)])
                    keys = np.flatnonzero(both)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(keys), pa.string()), "key": keys, "n": both[keys]})

    got = rows.where(draw < chance).select("lang", "text").mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), BUCKETS + SCRIPTS))
    if len(got):
        index = pc.index_in(got["lang"].combine_chunks(), pa.array(languages)).to_numpy(zero_copy_only=False)
        counts[index, got["key"].to_numpy()] = got["n"].to_numpy()
    grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    weights = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BUCKETS))
    return Model(languages, weights.astype(np.float32), scripts >= np.maximum(WRITTEN * scripts.sum(1, keepdims=True), 1))


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", keep: tuple[str, ...] = (), spans: bool = False, text_column: str = "text") -> DataFrame:
    """``id_column``, the ``keep`` columns, lang_pred and score; with ``spans`` also spans of (start, stop, lang) in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [id_column, *keep]
    sent = columns if text_column in columns else [*columns, text_column]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", lang_pred string, score double" + ", spans array<struct<start:long,stop:long,lang:string>>" * spans

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            column = batch.column(sent.index(text_column))
            for i, j in slices(column):
                texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
                x = Letters(texts)
                pick, share, found = np.full(len(texts), len(m.languages)), np.zeros(len(texts)), [[] for _ in texts]
                scores = m.scores(x) if m.languages else None
                for d in range(len(texts) if m.languages else 0):
                    a, b = x.word_at[d], x.word_at[d + 1]
                    if a == b:
                        continue
                    path = viterbi(scores[a:b])
                    letters = np.bincount(path, weights=x.size[a:b], minlength=len(m.languages))
                    pick[d] = letters.argmax()
                    share[d] = letters.max() / letters.sum()
                    if spans:
                        cuts = np.flatnonzero(np.diff(path, prepend=-1, append=-1))
                        found[d] = [{"start": int(x.first[a + p] - x.at[d]), "stop": int(x.last[a + q - 1] - x.at[d]), "lang": m.languages[path[p]]} for p, q in zip(cuts[:-1], cuts[1:], strict=True)]
                out = [c.slice(i, j - i) for c in batch.columns[: len(columns)]] + [pa.array(names[pick], pa.string()), pa.array(share)]
                if spans:
                    out.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(out, names=[*columns, "lang_pred", "score", *(["spans"] * spans)])

    return docs.select(*sent).mapInArrow(run, schema)
