"""N-gram Jaccard join (operator 7): a prefix-tree join over globally ordered shingle sets.

Exact at any threshold ``num / den``. A set of n shingles has at most ``d = n (den - num) / den`` that a linked set lacks.

1. *Count.* Shingles are 64-bit hashes in numeric order, one order for all sets. Each distinct set gives the first ``q = 2 (d + 1)`` of its
   own. The first k shingles that two linked sets share are among the first ``k + d`` of either, so linked sets share at least ``need`` of what they gave
   (``given``). How many sets gave a shingle is counted with one map-side combined aggregate; sets with fewer than ``need`` shingles that others gave too
   link with nothing. A passage that many documents share is a small part of its documents, and does not make candidates of them.
2. *Gather.* Of what it gave a candidate offers the ``q - need + 1`` rarest: in any common order, linked sets offer one shingle in common. Sizes fall into
   classes such that linked sets have the same or the next one, and a shingle ties within a class and the next. Documents are tied to the smallest that
   offers the same; connected components of the ties hold every link. Components above a block, which passages may still chain together, are gathered anew by the ``d + 1``
   rarest of all their shingles.
3. *Join.* A component's sets are cut into blocks of bounded size. A block's sets go into one prefix tree, ordered by how many
   of the block's sets hold a shingle; the tree is walked once for all sets together, partial overlaps
   are shared along a path, and a branch is left by every set that cannot reach the threshold with what remains.
4. *Close.* Blocks of one component are first joined through one representative of each linked part. What is then still apart is compared
   in full, block against block, skipping blocks that are one linked part already.

No whole set moves before it is a candidate. Lists of shared shingles are sent to the tasks up to ``FEW_KEYS``; beyond that a join, which splits hot keys, does the same.

Words are runs of non-whitespace (ASCII) with A-Z lower-cased; fewer words than ``n`` are one shingle;
without words the set is empty and links with nothing. Null ids get their own component (null) and link
with nothing. Rows that repeat an id are one document and should repeat its text; where they don't, one of the
texts stands for the id in comparisons, and ``n_shingles`` is the smallest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.share import Shared
from ledgerloom.llm.tables import stage
from ledgerloom.llm.text import C1, C2, flat, longs, mix, shingle_sets, slices, word_hashes, words

FEW_IDS = 1 << 20  # candidates up to this many (8 bytes each) are sent to every task
FEW_KEYS = 1 << 22  # shared shingles up to this many (12 bytes each) are sent to every task
BLOCK = 48  # sets in a block of the first rounds
CLOSING_BLOCK = 112  # in a block that is compared with others: larger, as copies per set fall with it
BLOCK_SHINGLES = 1 << 18  # shingles in a block, unless one set alone has more


def given(n, num: int, den: int):
    """How many of a set's ``n`` shingles are counted, and how many of those linked sets have in common with it at least."""

    def both(n):
        lacks = n * (den - num) // den
        q = np.minimum(n, 2 * (lacks + 1))
        return q, np.maximum(q - lacks, 1)

    n = np.asarray(n)
    least = n - n * (den - num) // den  # a linked set has as many shingles, and those it gives may be fewer
    return both(n)[0], both(least)[1]


def _describe(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text"):
            data, offsets = flat(piece.column("text"))
            start, end, first = words(data, offsets)
            count, d1, d2, keys = [], [], [], []
            for own in shingle_sets(word_hashes(data, start, end), first, n):
                count.append(len(own))
                d1.append(int(np.add.reduce(mix(own + C1))) & ((1 << 64) - 1) if len(own) else 0)
                d2.append(int(np.add.reduce(mix(own + C2))) & ((1 << 64) - 1) if len(own) else 0)
                keys.append(own[: int(given(len(own), num, den)[0])])
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
            flat_keys = np.concatenate([np.zeros(0, np.uint64), *keys])
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc"), pa.array(count, pa.int64()),
                    pa.array(longs(np.array(d1, np.uint64))), pa.array(longs(np.array(d2, np.uint64))),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(longs(flat_keys))),
                ],
                ["doc", "n", "d1", "d2", "keys"],
            )


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values, and the row of each."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)


def _held(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value would stand among the ordered ones, and whether it is one of them."""
    at = np.minimum(np.searchsorted(ordered, values), max(len(ordered) - 1, 0))
    return at, ordered[at] == values if len(ordered) else np.zeros(len(values), bool)


def size_classes(num: int, den: int) -> np.ndarray:
    """The smallest size of each class. A class ends at the largest size that links with its smallest one, so linked sizes are no two classes apart."""
    least = [1]
    while least[-1] < 1 << 40:
        least.append(least[-1] * den // num + 1)
    return np.array(least)


def _offers(batches: Iterator[pa.RecordBatch], shared: tuple[np.ndarray, np.ndarray], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """(doc, key) of what candidates offer. The keys that no other set gave are the rarest."""
    for batch in batches:
        values, row = _lists(batch.column("keys"))
        at, held = _held(values, shared[0])
        q, need = given(batch.column("n").to_numpy(), num, den)
        values, row, df = values[held], row[held], shared[1][at[held]]
        common = np.bincount(row, minlength=batch.num_rows)
        order = np.lexsort((values, df, row))
        values, row = values[order], row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        taken = (common >= need)[row] & (place < (common - need + 1)[row])
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(row[taken])) for c in ("doc", "n")] + [pa.array(values[taken])], ["doc", "n", "key"])


def _rarest(batches: Iterator[pa.RecordBatch], shared: tuple[np.ndarray, np.ndarray], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Of each set the shared shingles among its ``d + 1`` rarest; those it has alone come first."""
    for batch in batches:
        values, row = _lists(batch.column("own"))
        at, held = _held(values, shared[0])
        size = np.bincount(row, minlength=batch.num_rows)
        alone = size - np.bincount(row[held], minlength=batch.num_rows)
        values, row, df = values[held], row[held], shared[1][at[held]]
        order = np.lexsort((values, df, row))
        values, row = values[order], row[order]
        taken = np.arange(len(row)) - np.searchsorted(row, row) < (size * (den - num) // den + 1 - alone)[row]
        yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(row[taken])), pa.array(values[taken])], ["doc", "key"])


class Forest:
    """Union-find with the smallest member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


class PrefixTree:
    """A block's sets as paths of shared shingles, the most held first."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        every, held = np.unique(np.concatenate(sets), return_counts=True)
        shared = held > 1  # a shingle of one set alone adds to no overlap
        rank = np.full(len(every), -1)
        order = np.lexsort((every[shared], -held[shared]))
        rank[np.flatnonzero(shared)[order]] = np.arange(len(order))
        self.paths = []
        self.member = np.zeros((len(sets), len(order)), bool)
        for i, s in enumerate(sets):
            path = rank[np.searchsorted(every, s)]
            path = np.sort(path[path >= 0])
            self.member[i, path] = True
            self.paths.append(path)
        self.order = sorted(range(len(sets)), key=lambda i: self.paths[i].astype(">u4").tobytes())
        self.common = [0]
        for a, b in zip(self.order, self.order[1:], strict=False):
            x, y = self.paths[a], self.paths[b]
            m = min(len(x), len(y))
            apart = np.flatnonzero(x[:m] != y[:m])
            self.common.append(int(apart[0]) if len(apart) else m)

    def links(self, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each set those with at least num/den of the union in common, itself included."""
        everyone = np.arange(len(self.order))
        stack = [(0, len(self.order), 0, everyone, np.zeros(len(everyone), np.int64))]
        while stack:
            lo, hi, depth, active, overlap = stack.pop()
            inside = self.order[lo:hi]
            path = self.paths[inside[0]]
            deep = len(path) if hi - lo == 1 else min(self.common[lo + 1 : hi])
            overlap = overlap + self.member[np.ix_(active, path[depth:deep])].sum(1)
            # What can still come, and what the smallest set below needs: c / (x + y - c) >= num / den.
            most = max(len(self.paths[i]) for i in inside) - deep
            reach = overlap + np.minimum(most, self.size[active] - overlap)
            least = min(self.size[i] for i in inside)
            ok = (num + den) * reach >= num * (self.size[active] + least)
            active, overlap = active[ok], overlap[ok]
            if not len(active):
                continue
            at = lo
            while at < hi and len(self.paths[self.order[at]]) == deep:
                i = self.order[at]
                yield i, active[(num + den) * overlap >= num * (self.size[active] + self.size[i])]
                at += 1
            while at < hi:
                to = at + 1
                while to < hi and self.common[to] > deep:
                    to += 1
                stack.append((at, to, deep, active, overlap))
                at = to


def linked_parts(sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """For each set the smallest position that links lead to."""
    forest = Forest(len(sets))
    for i, others in PrefixTree(sets).links(num, den):
        for j in others:
            forest.join(i, int(j))
    return [forest.root(i) for i in range(len(sets))]


def _join_block(key: tuple, group: pa.Table, num: int, den: int) -> pa.Table:
    group = group.sort_by("doc")
    docs = group.column("doc").to_numpy()
    sets = [np.sort(np.asarray(x.values).view(np.uint64)) for x in group.column("own").combine_chunks()]
    root = linked_parts(sets, num, den) if len(sets) > 1 else [0] * len(sets)
    part = pa.array([key[0].as_py()] * len(docs), pa.int64())
    return pa.table({"part": part, "a": pa.array(docs[root]), "b": pa.array(docs)})


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text"):
            data, offsets = flat(piece.column("text"))
            start, end, first = words(data, offsets)
            own = list(shingle_sets(word_hashes(data, start, end), first, n))
            ends = np.concatenate(([0], np.cumsum([len(s) for s in own])))
            values = pa.array(longs(np.concatenate([np.zeros(0, np.uint64), *own])))
            yield pa.RecordBatch.from_arrays([piece.column("doc"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["doc", "own"])


def _in_blocks(rows: DataFrame, *by: str, block: int | None = None) -> DataFrame:
    """``rows`` with ``block``: each ``by`` group dealt by hash into blocks of about BLOCK rows and BLOCK_SHINGLES shingles."""
    block = block or BLOCK
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_n"))
    sizes = stage(sizes, "ngram-sizes")
    many = F.greatest(F.ceil(F.col("_k") / block), F.ceil(F.col("_n") / BLOCK_SHINGLES))
    many = F.least(many, F.col("_k"))
    return rows.join(sizes, list(by)).withColumn("block", F.pmod(F.xxhash64("doc"), many)).drop("_k", "_n")


def _few(keys: DataFrame, *columns: str) -> tuple[np.ndarray, ...] | None:
    """The staged columns as arrays in the order of the first, if they are few."""
    if keys.count() > FEW_KEYS:
        return None
    table = keys.select(*columns).toArrow()
    arrays = [table.column(c).to_numpy() for c in columns]
    order = np.argsort(arrays[0])
    return tuple(a[order] for a in arrays)


def _tied(keys: DataFrame) -> DataFrame:
    """Ties (a, b) between the documents (doc, key) of a key, each with the smallest."""
    least = keys.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a < z").select("key", "a")
    return keys.join(least, "key").where("a <> doc").select("a", F.col("doc").alias("b")).distinct()


def _candidate_ties(keyed: DataFrame, num: int, den: int) -> DataFrame:
    """Ties between candidates, from (doc, n, keys) of distinct sets."""
    keys = keyed.select(F.explode("keys").alias("key"))
    shared = stage(keys.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1"), "ngram-shared-keys")
    few = _few(shared, "key", "df")
    if few is not None:
        sent = Shared(keyed.sparkSession, few)
        offers = keyed.mapInArrow(lambda it: _offers(it, sent.value, num, den), "doc long, n long, key long")
    else:
        least = F.expr(f"n - n * {den - num} div {den}")  # the smallest linked set's size
        need = F.greatest(F.least(least, F.expr(f"2 * (({least_lacks(num, den)}) + 1)")) - F.expr(least_lacks(num, den)), F.lit(1))
        rows = keyed.select("doc", "n", F.explode("keys").alias("key")).join(shared, "key")
        held = rows.groupBy("doc", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("held")).withColumn("need", need)
        held = held.where(F.size("held") >= F.col("need"))
        offers = held.select("doc", "n", F.explode(F.slice("held", F.lit(1), (F.size("held") - F.col("need") + 1).cast("int"))["key"]).alias("key"))
    bounds = F.array(*[F.lit(int(b)) for b in size_classes(num, den)])
    offers = offers.withColumn("class", F.size(F.filter(bounds, lambda b: b <= F.col("n"))))
    routed = offers.select("doc", F.explode(F.array(*[F.xxhash64("key", F.col("class") + k) for k in (0, 1)])).alias("key"))
    return _tied(stage(routed, "ngram-offers"))


def least_lacks(num: int, den: int) -> str:
    """What the smallest set linked with one of ``n`` shingles may lack, in SQL."""
    return f"(n - n * {den - num} div {den}) * {den - num} div {den}"


def _ties(own: DataFrame, num: int, den: int) -> DataFrame:
    """Ties (a, b) between sets (doc, own) that have one of their rarest shingles in common."""
    tokens = own.select("doc", F.size("own").alias("n"), F.explode("own").alias("token"))
    counts = stage(tokens.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1"), "ngram-counts")
    few = _few(counts, "token", "df")
    if few is not None:
        sent = Shared(own.sparkSession, few)
        keys = own.mapInArrow(lambda it: _rarest(it, sent.value, num, den), "doc long, key long")
    else:
        held = tokens.join(counts, "token").groupBy("doc", "n").agg(F.collect_list(F.struct("df", "token")).alias("held"))
        lacks = F.expr(f"n * {den - num} div {den}")
        first = F.slice(F.array_sort("held"), F.lit(1), F.greatest(lacks + 1 - (F.col("n") - F.size("held")), F.lit(0)).cast("int"))
        keys = held.select("doc", F.explode(first["token"]).alias("key"))
    return _tied(stage(keys, "ngram-prefixes"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """(doc, n_shingles, component): one row per document id; component is its smallest linked id."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    seen = stage(texts.mapInArrow(lambda it: _describe(it, n, num, den), "doc long, n long, d1 long, d2 long, keys array<long>"), "ngram-keys")

    # One member per distinct set: exact copies link without looking further.
    facts = seen.where("doc is not null and n > 0").select("doc", "n", "d1", "d2")
    alike = ["n", "d1", "d2"]
    firsts = stage(facts.groupBy(*alike).agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("copies")), "ngram-firsts")
    several = stage(firsts.where("copies > 1").select(*alike, "first"), "ngram-several")
    copies = stage(facts.join(several, alike).select("doc", "d1", "first"), "ngram-copies")
    keyed = seen.where("doc is not null and n > 0").select("doc", "n", "d1", "keys")
    more = stage(copies.where("doc <> first").select("doc", "d1"), "ngram-more") if not several.isEmpty() else None
    if more is not None:
        keyed = keyed.join(F.broadcast(more) if more.count() <= FEW_IDS else more, ["doc", "d1"], "left_anti")
    parts = components(_candidate_ties(keyed.select("doc", "n", "keys"), num, den)).select(F.col("node").alias("doc"), F.col("root").alias("part"))
    parts = stage(parts, "ngram-gathered")
    narrow = parts.select("doc")
    narrow = F.broadcast(narrow) if parts.count() <= FEW_IDS else narrow
    own = texts.join(narrow, "doc").mapInArrow(lambda it: _sets(it, n), "doc long, own array<long>")
    own = stage(own.dropDuplicates(["doc"]), "ngram-sets")
    ids = stage(own.select("doc", F.size("own").cast("long").alias("n")).join(parts, "doc").select("part", "n", "doc"), "ngram-parts")
    chained = stage(ids.groupBy("part").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > BLOCK).select("part"), "ngram-chained")
    if not chained.isEmpty():
        large = stage(ids.join(chained, "part"), "ngram-large-parts")
        few_large = F.broadcast(large.select("doc")) if large.count() <= FEW_IDS else large.select("doc")
        tight = components(_ties(own.join(few_large, "doc"), num, den)).select(F.col("node").alias("doc"), F.col("root").alias("part"))
        large = large.drop("part").join(tight, "doc").select("part", "n", "doc")
        ids = stage(ids.join(chained, "part", "left_anti").select("part", "n", "doc").unionByName(large), "ngram-tight-parts")

    def compare(blocked: DataFrame, *keys: str) -> DataFrame:
        """Links (part, a, b) found in blocks; ``keys`` name a block, the component first."""
        with_sets = blocked.join(own, "doc").select(*keys, "doc", "own")
        found = with_sets.groupBy(*keys).applyInArrow(lambda key, t: _join_block(key, t, num, den), "part long, a long, b long")
        return stage(found.where("a <> b"), "ngram-links")

    blocked = stage(_in_blocks(ids, "part"), "ngram-blocks")
    links = [compare(blocked, "part", "block")]
    links += _close(blocked, links[0], compare)
    found = components(reduce(DataFrame.union, links).select("a", "b"))
    # A document leads to its first copy, and that one to its component.
    merged = copies.select("doc", "first").union(found.select("node", "node"))
    merged = merged.join(found, F.col("first") == F.col("node"), "left").select("doc", F.coalesce("root", "first").alias("component"))
    sizes = seen.groupBy("doc").agg(F.min("n").alias("n_shingles"))
    merged = merged.groupBy(F.col("doc").alias("_doc")).agg(F.min("component").alias("component"))
    return sizes.join(merged, F.col("doc") == F.col("_doc"), "left").select("doc", "n_shingles", F.coalesce("component", "doc").alias("component"))


def _close(blocked: DataFrame, links: DataFrame, compare: Callable[..., DataFrame]) -> list[DataFrame]:
    """Links between blocks of one component: through representatives first, then all that is left apart."""
    large = blocked.groupBy("part").agg(F.max("block").alias("last")).where("last > 0").select("part")
    large = stage(large, "ngram-large")
    if large.isEmpty():
        return []
    rows = stage(blocked.join(large, "part").select("part", "doc", "n"), "ngram-large-rows")
    links = stage(links.join(large, "part").select("part", "a", "b"), "ngram-large-links")
    more: list[DataFrame] = []

    def parted() -> DataFrame:
        known = components(reduce(DataFrame.union, [links, *more]).select("a", "b"))
        out = rows.join(known, F.col("doc") == F.col("node"), "left").select("part", "doc", "n", F.coalesce("root", "doc").alias("sub"))
        return stage(out, "ngram-subs")

    now = parted()
    before = now.where("doc = sub").count()
    while True:
        heads = stage(_in_blocks(now.where("doc = sub").select("part", "doc", "n"), "part"), "ngram-heads")
        whole = heads.agg(F.max("block")).first()[0] == 0  # all heads of a component met in one block
        more.append(compare(heads, "part", "block"))
        now = parted()
        after = now.where("doc = sub").count()
        if whole or after > 0.7 * before:
            break
        before = after
    apart = now.groupBy("part").agg(F.min("sub").alias("lo"), F.max("sub").alias("hi")).where("lo < hi").select("part")
    now = stage(now.join(stage(apart, "ngram-apart"), "part"), "ngram-apart-rows")
    if now.isEmpty():
        return more
    # Large linked parts have blocks of their own, small ones share some; two blocks of one part need no look.
    counts = stage(now.groupBy("part", "sub").agg(F.count(F.lit(1)).alias("k")), "ngram-sub-sizes")
    home = F.when(F.col("k") * 2 >= CLOSING_BLOCK, F.col("sub")).otherwise(F.lit(-1).cast("long"))
    now = stage(now.join(counts, ["part", "sub"]).select("part", "doc", "n", home.alias("home")), "ngram-homes")
    parts = stage(_in_blocks(now, "part", "home", block=CLOSING_BLOCK), "ngram-parts")
    kinds = stage(parts.select("part", "home", "block").distinct(), "ngram-kinds")
    other = kinds.select("part", F.col("home").alias("home2"), F.col("block").alias("block2"))
    ordered = F.struct("home", "block") <= F.struct("home2", "block2")
    pairs = kinds.join(other, "part").where(ordered & ((F.col("home") != F.col("home2")) | (F.col("home") == -1)))
    pairs = stage(pairs.withColumn("pair", F.xxhash64("home", "block", "home2", "block2")), "ngram-pairs")
    left = parts.join(pairs, ["part", "home", "block"]).select("part", "pair", "doc")
    right = parts.select("part", "doc", F.col("home").alias("home2"), F.col("block").alias("block2")).join(pairs, ["part", "home2", "block2"]).select("part", "pair", "doc")
    more.append(compare(left.union(right).distinct(), "part", "pair"))
    return more
