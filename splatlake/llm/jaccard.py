"""N-gram Jaccard join with filters under several global orders.

A text's set is its distinct shingles of ``Likeness.words`` words (A-Z lower-cased), as 64-bit hashes. Texts with equal
sets are one class. Two classes link when 100 * |intersection| >= percent * |union|. The result is each row's class of
links: the smallest id reachable. Below, t is percent / 100.

If two sets are that similar, then under every global order of shingles they share one among the first
n - ceil(t n) + 1 of each, and k among the first n - ceil(t n) + k. Four orders are used:

1. Order of hashes, k = ``SHARE`` of n: a class can only have a partner if k of its prefix shingles stand in another
   class too. Shingles are sent in packed blocks; those that two classes of one block hold are counted at once and sent
   no further, so a frequent shingle costs a block one entry. Most classes end here.
2. Among the rest: rarest first, ties by hash. Shingles of one class only can't be shared, so they just use up the prefix.
   Classes that share a prefix shingle are in one list.
3. By another hash, ascending, and 4. descending. A pair of one list is a candidate only if its prefixes meet under both
   of these too; only then whole sets are compared.

Pairs come first as stars: every class of a list with the list's smallest. Links found give components; only lists with
two components or more are looked at again, pairs of different components alone: short lists pair by pair, long lists in
blocks, where members of the list's largest component don't meet each other and only a spanning forest leaves. Nothing
is capped or sampled. Frequent shingles are joined by broadcast: of R rows at most ``HOT`` keys have R / ``HOT`` or more.

Defined results: null and empty texts, and texts without words, have an empty set and link with nothing; with fewer
words than a shingle has, the whole sequence is one shingle; rows with null ids get component null and link with nothing; repeated rows are
in one component; rows with one id are one document with several texts. Other columns are passed over; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import clusters
from .shared import Words, cut, mix, slices

#: Prefix shingles that must be shared in the first filter, as a share of the set.
SHARE = 0.15
#: Shingles in a part of the first filter, classes in a short list, classes and shingles on a side of a block of a long one.
PART, SHORT, BLOCK, WORDS = 500_000, 64, 512, 500_000
#: Keys that may be broadcast as frequent ones.
HOT = 20_000
#: Rows of classes that may be broadcast (two longs each).
BROADCAST = 1_000_000
_I64 = np.int64


@dataclass(frozen=True)
class Likeness:
    """Words in a shingle, and the threshold in percent."""

    words: int = 5
    percent: int = 80

    def links(self, shared, both):
        """Whether sets that share so many link; ``both``: the sum of their sizes."""
        return shared * (100 + self.percent) >= both * self.percent

    def need(self, n: np.ndarray) -> np.ndarray:
        return -(-self.percent * n // 100)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """The first filter's prefix of sets of n."""
        return np.minimum(n, n - self.need(n) + np.maximum(1, (SHARE * n).astype(_I64)))


class Sets:
    """The sets of some texts: all shingles by text, ascending in each."""

    def __init__(self, texts: pa.Array, words: int):
        w = Words(texts, lower=True)
        place, h = w.runs(words)
        doc = w.doc[place]
        short = np.flatnonzero((w.count > 0) & (w.count < words))
        if len(short):
            whole = w.count[short].astype(np.uint64)
            for i in range(words - 1):
                has = w.count[short] > i
                whole = np.where(has, mix(whole + w.hash[np.minimum(w.word_at[short] + i, len(w.hash) - 1)]), whole)
            h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.h, self.doc = h[new], doc[new]
        self.n = np.bincount(self.doc, minlength=w.n)
        self.at = np.concatenate([[0], np.cumsum(self.n)])

    def key(self, salt: int) -> np.ndarray:
        """A 64-bit hash of each set, 0 for an empty one."""
        out = np.zeros(len(self.n), np.uint64)
        full = np.flatnonzero(self.n)
        if len(full):
            out[full] = np.add.reduceat(mix(self.h + np.uint64(salt)), self.at[full])
            out[full] = mix(out[full] + self.n[full].astype(np.uint64))
        return out.view(_I64)


def _describe(docs: DataFrame, id_column: str, like: Likeness, more: tuple[str, ...] = ()) -> DataFrame:
    """(id, n, k1, k2) of every row, and the longs ``more``."""

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(1)):
                s = Sets(batch.column(1).slice(i, j - i), like.words)
                rest = [batch.column(2 + c).slice(i, j - i) for c in range(len(more))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s.n.astype(_I64)), pa.array(s.key(1)), pa.array(s.key(2)), *rest], names=["id", "n", "k1", "k2", *more])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), "text", *more).mapInArrow(run, ", ".join([f"id {kind}, n long, k1 long, k2 long", *[f"{c} long" for c in more]]))


def _packed(group: np.ndarray, x: np.ndarray, y: np.ndarray, names: tuple[str, str, str]) -> dict:
    """Rows (group, bytes of x, bytes of y), one for each value of ``group``."""
    order = np.argsort(group, kind="stable")
    group, x, y = group[order], x[order].astype(_I64), y[order].astype(_I64)
    cuts = np.flatnonzero(np.diff(group)) + 1
    edges = [0, *cuts.tolist(), len(group)] if len(group) else [0]
    spans = list(zip(edges[:-1], edges[1:], strict=True))
    return {names[0]: group[[i for i, _ in spans]], names[1]: pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()), names[2]: pa.array([y[i:j].tobytes() for i, j in spans], pa.binary())}


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), _I64) for x in column])


def _distinct(h: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by (h, k), and whether h stands with another k too."""
    order = np.lexsort((k, h))
    h, k = h[order], k[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
    h, k = h[new], k[new]
    many = np.zeros(len(h), bool)
    many[1:] = h[1:] == h[:-1]
    many[:-1] |= many[1:]
    return h, k, many


def _shared_counts(docs: DataFrame, id_column: str, like: Likeness, parts: int) -> DataFrame:
    """(k1, got): of each class at least as many of its prefix shingles as stand in another class's prefix.

    Shingles meet in parts by hash, counts in buckets by class; both travel packed, a row for each block and part.
    """

    def emit(batches):
        for batch in batches:
            for i, j in slices(batch.column(1)):
                s = Sets(batch.column(1).slice(i, j - i), like.words)
                size = like.prefix(s.n)
                inside = np.arange(len(s.h)) - s.at[s.doc] < size[s.doc]
                h, k, many = _distinct(s.h[inside].view(_I64), s.key(1)[s.doc[inside]])
                # held by two classes here: counted now; one entry, class 0, tells the other blocks
                who, got = np.unique(k[many], return_counts=True)
                told = np.unique(h[many])
                yield pa.RecordBatch.from_pydict(_packed(-1 - who % parts, who, got, ("part", "x", "y")))
                h, k = np.concatenate([h[~many], told]), np.concatenate([k[~many], np.zeros(len(told), _I64)])
                yield pa.RecordBatch.from_pydict(_packed((h.view(np.uint64) % np.uint64(parts)).astype(_I64), h, k, ("part", "x", "y")))

    def meet(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        if part < 0:
            return pa.table({"bucket": pa.array([-1 - part] * len(table), pa.int64()), "k": table["x"], "got": table["y"]})
        h, k, many = _distinct(_numbers(table["x"]), _numbers(table["y"]))
        who, got = np.unique(k[many & (k != 0)], return_counts=True)
        return pa.table(_packed(who % parts, who, got, ("bucket", "k", "got")))

    def total(table: pa.Table) -> pa.Table:
        who, at = np.unique(_numbers(table["k"]), return_inverse=True)
        return pa.table({"k1": who, "got": np.bincount(at, weights=_numbers(table["got"])).astype(_I64)})

    sent = docs.select(F.col(id_column).alias("id"), "text").mapInArrow(emit, "part long, x binary, y binary")
    return sent.groupBy("part").applyInArrow(meet, "bucket long, k binary, got binary").groupBy("bucket").applyInArrow(total, "k1 long, got long")


def _tokens(docs: DataFrame, like: Likeness) -> DataFrame:
    """(k1, n, toks) of rows (id, text)."""

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(1)):
                s = Sets(batch.column(1).slice(i, j - i), like.words)
                toks = pa.LargeListArray.from_arrays(pa.array(s.at), pa.array(s.h.view(_I64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(s.key(1)), pa.array(s.n.astype(_I64)), toks], names=["k1", "n", "toks"])

    return docs.select("id", "text").mapInArrow(run, "k1 long, n long, toks array<long>")


def _lookup(rows: DataFrame, found: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined with ``found``, one row for each ``key``, where ``n`` counts the rows that hold it.

    Of ``total`` rows no more than ``HOT`` keys can stand in more than ``total / HOT`` rows each: these are broadcast, so
    that no frequent key meets in one task; the others go by a shuffle.
    """
    bar = max(64, total // HOT)
    hot = found.where(F.col(n) > bar)
    told = rows.join(F.broadcast(hot.select(key, *[F.col(c).alias(f"__{c}") for c in found.columns if c != key])), key, "left")
    often = told.where(F.col(f"__{n}").isNotNull()).select(*rows.columns, *[F.col(f"__{c}").alias(c) for c in found.columns if c != key])
    rest = told.where(F.col(f"__{n}").isNull()).select(*rows.columns).join(found.where(F.col(n) <= bar), key)
    return often.unionByName(rest.select(*often.columns))


def _similar(a: str, b: str, like: Likeness) -> Column:
    """Whether sizes allow a link, the prefixes under the other orders meet, and the sets are similar enough; in that order."""
    size = F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * like.percent
    meet = F.arrays_overlap(f"{a}.p2", f"{b}.p2") & F.arrays_overlap(f"{a}.p3", f"{b}.p3")
    both = F.size(F.array_intersect(f"{a}.toks", f"{b}.toks"))
    return F.when(size & meet, like.links(both, F.col(f"{a}.n") + F.col(f"{b}.n"))).otherwise(False)


def _verified(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """The ``pairs`` (a, b and more), which share a shingle of the first order's prefix, that link."""
    x = pairs.join(sets.alias("x"), pairs["a"] == F.col("x.k1"))
    return x.join(sets.alias("y"), F.col("b") == F.col("y.k1")).where(_similar("x", "y", like)).select(*pairs.columns)


def _shared(lists: pa.Array, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values the lists ``left`` share with the lists ``right``."""
    size = np.diff(lists.offsets.to_numpy())
    words, col = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    row, at = np.repeat(np.arange(len(lists)), size), np.full((2, len(lists)), -1)
    at[0, left], at[1, right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(words), 4096):
        ok = (col >= lo) & (col < lo + 4096)
        width, sides = min(4096, len(words) - lo), []
        for side, n in ((0, len(left)), (1, len(right))):
            m = np.zeros((n, width), np.float32)
            mine = ok & (at[side, row] >= 0)
            m[at[side, row[mine]], col[mine] - lo] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def block_links(table: pa.Table, like: Likeness) -> pa.Table:
    """A spanning forest of the links between different components (a, b) in one block of a long list.

    Rows marked ``asks`` meet those that aren't; pairs whose prefixes under the other orders don't meet aren't verified.
    """
    comp, n, asks = (table[c].to_numpy() for c in ("comp", "n", "asks"))
    left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
    small, large = np.minimum.outer(n[left], n[right]), np.maximum.outer(n[left], n[right])
    maybe = (comp[left][:, None] != comp[right][None, :]) & (small * 100 >= large * like.percent)
    for p in ("p2", "p3", "toks"):
        if not maybe.any():
            break
        i, j = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
        left, right, maybe = left[i], right[j], maybe[np.ix_(i, j)]
        lists = table[p].combine_chunks()
        used = np.union1d(left, right)
        shared = _shared(lists.take(pa.array(used)), np.searchsorted(used, left), np.searchsorted(used, right)).astype(_I64)
        maybe &= shared > 0 if p != "toks" else like.links(shared, n[left][:, None] + n[right][None, :])
    links, parent = [], {c: c for c in np.unique(comp).tolist()}

    def top(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    for p, q in zip(*(x.tolist() for x in np.nonzero(maybe)), strict=True):
        a, b = top(comp[left[p]].item()), top(comp[right[q]].item())
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((comp[left[p]].item(), comp[right[q]].item()))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def long_blocks(lists: DataFrame) -> DataFrame:
    """The blocks (t, i, j) in which the classes of long lists (t, m, k1, n, comp) meet: rows with ``asks`` or without.

    Members of a list's largest component need not meet each other. All other members ask; every member answers. A list
    with o askers among m members gives about 2 o m / ``BLOCK`` rows, so an outlier beside a large component gives about m.
    """
    per = lists.groupBy("t", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    per = per.groupBy("t").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"), F.max("c").alias("most"), F.sum("s").alias("words"))
    sides = lambda count: F.greatest(F.lit(1), F.ceil(F.greatest(count / BLOCK, F.col("words") * count / F.col("all") / WORDS))).cast("long")
    per = per.select("t", "top", sides(F.col("all") - F.col("most")).alias("g"), sides(F.col("all")).alias("h"))
    d = lists.join(per, "t").withColumns({"i": F.pmod(F.xxhash64("k1", F.lit(1)), F.col("g")), "j": F.pmod(F.xxhash64("k1", F.lit(2)), F.col("h"))})
    asks = d.where("comp <> top").select("t", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - F.lit(1).cast("long"))).alias("j"), "k1", "comp", F.lit(True).alias("asks"))
    answers = d.select("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - F.lit(1).cast("long"))).alias("i"), "j", "k1", "comp", F.lit(False).alias("asks"))
    return asks.unionByName(answers)


def _connected(sets: DataFrame, like: Likeness) -> DataFrame:
    """(k1, comp) of classes: equal ``comp`` where links connect them. ``sets``: k1, rep, n, toks."""
    total = sets.agg(F.sum("n").alias("s")).first()["s"] or 0
    spread = sets.select("k1", F.explode("toks").alias("t"))
    common = cut(spread.groupBy("t").agg(F.count("*").alias("df")).where("df > 1"))
    need = F.ceil(F.col("n") * like.percent / 100)
    met = _lookup(spread, common, "t", "df", total).groupBy("k1").agg(F.collect_list(F.struct("df", "t")).alias("c"))
    # shingles of one class come first under every order, and leave so many places of the prefix
    full = sets.join(met, "k1").withColumn("room", (F.lit(1) - need + F.size("c")).cast("int")).where("room > 0")

    def prefix(*order: Column | str) -> Column:
        by = F.array_sort(F.transform("c", lambda x: F.struct(*[f(x).alias(f"o{i}") for i, f in enumerate(order)], x["t"].alias("t"))))
        return F.transform(F.slice(by, 1, F.col("room")), lambda x: x["t"])

    rarest = prefix(lambda x: x["df"], lambda x: F.xxhash64(x["t"], F.lit(1)))
    up, down = prefix(lambda x: F.xxhash64(x["t"], F.lit(2))), prefix(lambda x: F.bitwise_not(F.xxhash64(x["t"], F.lit(2))))
    full = cut(full.select("k1", "rep", "n", "toks", rarest.alias("p1"), up.alias("p2"), down.alias("p3")))
    member = full.select("k1", "rep", "n", F.explode("p1").alias("t"))
    first = member.groupBy("t").agg(F.min(F.struct("rep", "k1")).alias("f"), F.count("*").alias("m")).where("m > 1").select("t", "m", F.col("f.k1").alias("a"))
    stars = _lookup(member.select("k1", "t"), cut(first), "t", "m", total).where("k1 <> a").select("a", F.col("k1").alias("b")).distinct()
    near = clusters(_verified(stars, full, like)).select(F.col("node").alias("k1"), F.col("root").alias("comp"))
    named = cut(full.select("k1", "n", "p1").join(near, "k1", "left").withColumn("comp", F.coalesce("comp", "k1")))
    member = named.select("k1", "n", "comp", F.explode("p1").alias("t"))
    open_ = cut(member.groupBy("t").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("t", "m"))
    lists = cut(_lookup(member, open_, "t", "m", total))
    x, y = (lists.where(F.col("m") <= SHORT).alias(c) for c in "xy")
    fits = (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * like.percent) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.k1") < F.col("y.k1"))
    pairs = x.join(y, F.col("x.t") == F.col("y.t")).where(fits).select(F.col("x.k1").alias("a"), F.col("y.k1").alias("b"), F.col("x.comp").alias("ca"), F.col("y.comp").alias("cb")).distinct()
    far = _verified(pairs, full, like).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    long = lists.where(F.col("m") > SHORT)
    if not long.isEmpty():
        blocks = long_blocks(long).join(full.select("k1", "n", "p2", "p3", "toks"), "k1")
        far = far.unionByName(blocks.groupBy("t", "i", "j").applyInArrow(lambda t: block_links(t, like), "a long, b long"))
    named = named.select("k1", "comp")
    far = cut(far)
    if far.isEmpty():
        return named
    more = clusters(far).select(F.col("node").alias("comp"), "root")
    return named.join(more, "comp", "left").select("k1", F.coalesce("root", "comp").alias("comp"))


def _solved(docs: DataFrame, rows: DataFrame, id_column: str, like: Likeness, nulls: bool) -> tuple[DataFrame, DataFrame]:
    """Classes (k1, k2, rep, n) of ``rows``, and (k1, comp) of those with links. With ``nulls`` rows with null ids take part."""
    classes = cut(rows.where("n > 0" if nulls else "n > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("n").alias("n")))
    total = classes.agg(F.sum("n").alias("s")).first()["s"] or 0
    parts = max(8, int(total * (1.1 - like.percent / 100 + SHARE)) // PART)
    got = _shared_counts(docs if nulls else docs.where(F.col(id_column).isNotNull()), id_column, like, parts)
    enough = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * like.percent / 100) * SHARE))
    hopeful = cut(classes.join(got, "k1").where(F.col("got") >= enough).select("k1", "rep"))
    every = docs.select(F.col(id_column).alias("id"), "text")
    ids = hopeful.where("rep is not null").select(F.col("rep").alias("id")).distinct()
    texts = every.join(F.broadcast(ids) if hopeful.count() <= BROADCAST else ids, "id", "left_semi")
    if nulls and hopeful.where("rep is null").limit(1).count():
        texts = texts.unionByName(every.where("id is null"))
    sets = cut(_tokens(texts, like).dropDuplicates(["k1"]).join(hopeful, "k1"))
    return classes, cut(_connected(sets, like))


def join(docs: DataFrame, like: Likeness = Likeness(), id_column: str = "doc_id") -> DataFrame:
    """``id_column``, n_shingles and component_id of every row."""
    rows = cut(_describe(docs, id_column, like))
    classes, comp = _solved(docs, rows, id_column, like, False)
    # classes that share an id are linked by it only in name: each keeps its own component
    best = classes.join(comp, "k1").groupBy("comp").agg(F.min("rep").alias("best"))
    named = classes.join(comp, "k1", "left").join(best, "comp", "left").select("k1", "k2", F.coalesce("best", "rep").alias("component"))
    out = rows.join(named, ["k1", "k2"], "left")
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id"))


def dedupe(docs: DataFrame, like: Likeness = Likeness(), id_column: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: of its smallest id, null ids last, ties by hashes of the row.

    Here rows with null ids take part. Components are of texts: unlike texts of one id stay, each once. Rows with empty
    sets have no group: one of each id stays, and all with null ids.
    """
    blank = F.col(id_column).isNull() & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    hashed = [F.col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    marked = docs.where(~blank).withColumns({f"__h{i}": F.xxhash64(F.lit(i), F.col(id_column).isNull(), *hashed) for i in (1, 2)})
    rows = cut(_describe(marked, id_column, like, ("__h1", "__h2")))
    _, comp = _solved(docs.where(~blank), rows, id_column, like, True)
    full = F.col("n") > 0
    group = [F.when(full, F.coalesce("comp", "k1")), F.when(full & F.col("comp").isNull(), F.col("k2")), F.when(~full, F.col("id"))]
    best = F.min(F.struct(F.col("id").isNull(), "id", "__h1", "__h2"))
    keep = rows.join(comp, "k1", "left").groupBy(*[g.alias(f"g{i}") for i, g in enumerate(group)]).agg(best.alias("b")).select("b.__h1", "b.__h2")
    named = marked.join(keep, ["__h1", "__h2"], "left_semi").dropDuplicates(["__h1", "__h2"]).select(docs.columns)
    return named.unionByName(docs.where(blank))
