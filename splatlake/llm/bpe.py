"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The corpus, a block of texts at a time, is reduced to its distinct pre-tokens. All of their byte positions lie in one
array of symbols, doubly linked. An inverted index maps each mergeable token pair to the positions where it stands; the
merges are replayed in rank order from a heap of the ranks present, every merge visits only the positions its index entry
lists, and only the two pairs beside a merged one are indexed anew. No task needs the vocabulary of the whole corpus: a
block's index is bounded by the block, and encodings of pre-tokens met before stay in a bounded cache.

Ids are those of the tiktoken library's ``encode_ordinary``: a pre-token that is itself in the vocabulary is one id.

Defined results: a null text is like an empty one (no ids); repeated rows get equal results; an empty table gives an
empty one. Texts are encoded whole, however long. Other columns are passed over.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import slices

#: Pre-tokens whose encodings a worker keeps, about 300 bytes each, and bytes of text in a block.
CACHED, BLOCK_BYTES = 132_000, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file, one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Replay:
    """Encodes sets of pre-tokens together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.text = {i: str(i) for i in ranks.values()}
        #: the id of the merge of each mergeable pair of ids: of each left id by the right one, of each right id by the left one
        self.right, self.left = {}, {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    self.right.setdefault(a, {})[b] = r
                    self.left.setdefault(b, {})[a] = r
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        first = np.full((256, 256), -1, np.int64)
        for t, r in ranks.items():
            if len(t) == 2:
                first[t[0], t[1]] = r
        self.first, self.narrow = first, np.uint16 if max(ranks.values()) < 1 << 16 else np.int64

    def encode(self, words: list[bytes]) -> list[str]:
        """The ids of each word, in decimal, joined by commas."""
        out, todo = [""] * len(words), []
        for w, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is None:
                todo.append(w)
            else:
                out[w] = self.text[whole]
        if not todo:
            return out
        data = np.frombuffer(b"".join([words[w] for w in todo]), np.uint8)
        ends = np.cumsum([len(words[w]) for w in todo])
        n = len(data)
        # doubly linked symbols, -1 where a word ends
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[np.concatenate([[0], ends[:-1]])] = -1
        # the inverted index: rank of a pair to the positions of its left symbols
        rank = np.full(n, -1)
        rank[:-1] = self.first[data[:-1], data[1:]]
        rank[ends - 1] = -1
        order = np.flatnonzero(rank >= 0)
        # numbers of 16 bits are sorted by their digits
        order = order[np.argsort(rank[order].astype(self.narrow), kind="stable")]
        kinds = rank[order]
        starts = np.flatnonzero(np.diff(kinds, prepend=-1)).tolist()
        order = order.tolist()
        index = {r: order[i:j] for r, i, j in zip(kinds[starts].tolist(), starts, [*starts[1:], None], strict=True)} if order else {}
        symbol, after, before = self.single[data].tolist(), after.tolist(), before.tolist()
        # pair: the rank of the pair that stands at each position now, None or -1 if it can't be merged
        heap, pair, listed, none = list(index), rank.tolist(), index.get, {}
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r)
            places.sort()
            right, left = self.right.get(r, none).get, self.left.get(r, none).get
            for i in places:
                # an entry is stale once its pair has changed
                if pair[i] != r:
                    continue
                j = after[i]
                symbol[i] = r
                symbol[j] = pair[j] = -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    x = pair[i] = right(symbol[k])
                    if x is not None:
                        there = listed(x)
                        if there is None:
                            index[x] = [i]
                            heapq.heappush(heap, x)
                        else:
                            there.append(i)
                else:
                    pair[i] = -1
                h = before[i]
                if h >= 0:
                    x = pair[h] = left(symbol[h])
                    if x is not None:
                        there = listed(x)
                        if there is None:
                            index[x] = [h]
                            heapq.heappush(heap, x)
                        else:
                            there.append(h)
        last = np.array(symbol)
        stands = last >= 0
        ids = list(map(self.text.__getitem__, last[stands].tolist()))
        stops = np.cumsum(stands)[ends - 1].tolist()
        at = 0
        for w, stop in zip(todo, stops, strict=True):
            out[w] = ",".join(ids[at:stop])
            at = stop
        return out


class Codec:
    """Encodes and decodes texts; keeps what a worker has learned of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay, self.find = Replay(ranks), regex.compile(pattern).findall
        #: the encodings kept, and which of them a later block had as well
        self.cache: dict[str, str] = {}
        self.again: set[str] = set()
        self.bytes_of = {str(i): b for b, i in ranks.items()}

    def encode(self, texts: list[str]) -> list[tuple[int, str]]:
        """Of each text the number of ids, and the ids in decimal joined by commas."""
        split = [self.find(t) for t in texts]
        vocabulary = set().union(*split)
        met = vocabulary.intersection(self.cache)
        fresh = list(vocabulary.difference(met))
        self.again |= met
        if len(self.cache) + len(fresh) > CACHED:
            # what came again is likely to come once more; where that is too much by itself, what this block also has
            full = len(self.again) + len(fresh) > CACHED
            self.cache = {w: self.cache[w] for w in (met if full else self.again)}
            if full:
                self.again = set()
        self.cache.update(zip(fresh, self.replay.encode([w.encode() for w in fresh]), strict=True))
        get = self.cache.__getitem__
        joined = [",".join(map(get, words)) for words in split]
        return [(s.count(",") + 1 if s else 0, s) for s in joined]

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


_codecs: dict[tuple, Codec] = {}


def _codec(key: tuple, ranks: dict[bytes, int], pattern: str) -> Codec:
    """One codec for each vocabulary and worker."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """``id_column``, n_tokens, ids_sha256 and decoded_sha256 of every text; with ``with_ids`` also the ids themselves.

    ``vocabulary`` is a tiktoken rank file. It is read on the driver and sent to the workers: its size is the
    vocabulary's, whatever the corpus.
    """
    ranks = read_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key = (vocabulary, pattern, len(ranks))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        codec = _codec(key, shared.value, pattern)
        for batch in batches:
            ids, all_texts = batch.column(0), batch.column(1)
            for i, j in slices(all_texts, BLOCK_BYTES):
                coded = codec.encode([t or "" for t in all_texts.slice(i, j - i).to_pylist()])
                columns = [
                    ids.slice(i, j - i),
                    pa.array([n for n, _ in coded], pa.int64()),
                    pa.array([hashlib.sha256(s.encode()).hexdigest() for _, s in coded]),
                    pa.array([hashlib.sha256(codec.decode(s)).hexdigest() for _, s in coded]),
                ]
                names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([np.array(s.split(","), np.int32).tolist() if s else [] for _, s in coded], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(id_column, "text").mapInArrow(run, f"{id_column} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
