"""Embedding near-dedup (operator 2): spherical k-means cells, blocked cosine products inside them.

Vectors with one label (not null) and one dimension are compared; all links at or above the
threshold are found, none below. Equal vectors of a label are one row with a count from the start.

1. Each label (and dimension) of more than ``CELL`` vectors has cells of its own, one for about ``CELL`` vectors and at most ``FAN``.
   Spherical k-means is fitted to at most about ``SAMPLE`` of its vectors, chosen by hash, in one task per label. Cells that still hold
   more than twice ``CELL`` are split in the same way, ``LEVELS`` times at most. Centres go to the tasks ``CENTRE_BYTES`` at a time.
2. A vector's home is the cell of its nearest centre. It is also copied to each other cell whose
   side it could share with a linked vector: unit vectors with cosine t lie ``r = sqrt(2 - 2t)`` apart, so
   one within ``r`` of the plane between home and the other cell is copied. A home vector therefore meets every vector it
   may link with, whatever the data; well separated cells copy little, unstructured data much.
3. A cell's home vectors are cut into blocks (one, mostly), and so are all its vectors; a task multiplies one block
   pair in double precision, a few rows at a time. It adds up the links of each home vector, and keeps a spanning set of links only.
4. Connected components over those; the smallest id of a component is kept.

Vectors that are null, empty, zero or hold null or non-finite parts link with nothing, as do those without label. Null
ids are left out of links and are their own (null) component. Rows that repeat an id are
one vector if they are equal; otherwise all are compared, their links add up and they share a component. An empty table gives an
empty result; columns beyond the three that are named, whatever they are called, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.share import Shared
from ledgerloom.llm.tables import stage

SAMPLE = 16_384  # vectors of a group that its centres are fitted to
CELL = 2_048
FAN = 256  # cells that a group is split into at once
LEVELS = 6
CENTRE_BYTES = 64 << 20  # centres sent to the tasks at once
ROUNDS = 8
HOMES, OTHERS = 4_096, 8_192  # vectors in a block of homes, in a block of all
ROWS = 512  # home vectors multiplied at once


def fit_cells(vectors: np.ndarray, k: int) -> np.ndarray:
    """Unit centres by spherical k-means; the start is spread over the sample in order."""
    centres = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        home = (vectors @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return np.unique(centres, axis=0)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    # Scaled by the largest part first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centres(group: pa.Table) -> pa.Table:
    """One row with a group's centres, from its sampled vectors."""
    group = group.sort_by("rep")
    dim, k = group.column("dim")[0].as_py(), group.column("k")[0].as_py()
    centres = fit_cells(_unit(group.column("vector").combine_chunks(), dim), min(k, len(group)))
    return group.select(["label", "dim", "cell"]).slice(0, 1).append_column("centres", pa.array([centres.ravel()], pa.list_(pa.float64())))


def _assign(batches: Iterator[pa.RecordBatch], centres: list[np.ndarray], reach: float) -> Iterator[pa.RecordBatch]:
    """Rows placed in the cells of their group ``g``; a copy is nowhere at home."""
    for batch in batches:
        groups = batch.column("g").to_numpy()
        for g in np.unique(groups):
            part = batch.filter(pa.array(groups == g))
            c = centres[g]
            x = _unit(part.column("vector"), c.shape[1])
            near = x @ c.T
            home = near.argmax(1)
            gap = near[np.arange(len(x)), home][:, None] - near
            # No two unit vectors are more than 2 apart, so most cells are out of reach whatever their centre.
            row, cell = np.nonzero(gap <= 2 * reach + 1e-9)
            ok = gap[row, cell] <= reach * np.sqrt(np.maximum(((c**2).sum(1)[home[row]] + (c**2).sum(1)[cell]) - 2 * (c @ c.T)[home[row], cell], 0)) + 1e-7
            row, cell = row[ok], cell[ok]
            taken = part.take(pa.array(row))
            at_home = taken.column("home").to_numpy(zero_copy_only=False) & (cell == home[row])
            below = taken.column("cell").to_numpy() * (FAN + 1) + 1 + cell
            yield pa.RecordBatch.from_arrays(
                [taken.column("label"), taken.column("dim"), pa.array(below), pa.array(at_home), taken.column("rep"), taken.column("copies"), taken.column("vector")],
                ["label", "dim", "cell", "home", "rep", "copies", "vector"],
            )


def _split(rows: DataFrame, groups: DataFrame, reach: float) -> list[DataFrame]:
    """The rows of ``groups`` (label, dim, cell, homes, k) placed in new cells, as stored tables."""
    spark = rows.sparkSession
    kind = rows.schema["label"].dataType.simpleString()
    key = ["label", "dim", "cell"]
    size = groups.agg(F.sum(F.col("k") * F.col("dim") * 8)).first()[0] or 0
    chunks, out = -(-size // CENTRE_BYTES), []
    for chunk in range(chunks):
        own = groups.where(F.pmod(F.xxhash64(*key), F.lit(chunks)) == chunk)
        at = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
        sample = rows.where("home").join(own, key).where(at < F.least(F.lit(1.0), SAMPLE / F.col("homes")) * (1 << 30))
        fitted = sample.select(*key, "k", "rep", "vector").groupBy(*key).applyInArrow(_centres, f"label {kind}, dim int, cell long, centres array<double>")
        fitted = stage(fitted, "vector-centres").orderBy(*key).toArrow()
        # Groups are numbered as they come; a group without a sampled vector keeps its cell.
        centres = [np.array(c.as_py()).reshape(-1, d) for c, d in zip(fitted.column("centres"), fitted.column("dim").to_pylist(), strict=True)]
        numbered = spark.createDataFrame(fitted.select(key).append_column("g", pa.array(np.arange(len(fitted)))))
        numbered = numbered.select(F.col("label").cast(kind).alias("label"), F.col("dim").cast("int").alias("dim"), "cell", "g")
        shared = Shared(spark, centres)
        mine = rows.join(own.select(*key), key, "left_semi").join(numbered, key, "left")
        placed = mine.where("g is not null").select(*key, "home", "rep", "copies", "vector", "g").mapInArrow(
            lambda it, sent=shared: _assign(it, sent.value, reach), f"label {kind}, dim int, cell long, home boolean, rep long, copies long, vector array<double>"
        )
        out.append(stage(placed.unionByName(mine.where("g is null").drop("g")), "vector-cells"))
        shared.close()
    return out


def _cells(rows: DataFrame, reach: float) -> DataFrame:
    """All rows with their cells: (label, dim, cell, home, rep, copies, vector)."""
    key, limit, done = ["label", "dim", "cell"], CELL, []
    rows = rows.withColumn("cell", F.lit(0).cast("long")).withColumn("home", F.lit(True)).select(*key, "home", "rep", "copies", "vector")
    for _ in range(LEVELS):
        groups = rows.groupBy(*key).agg(F.sum(F.col("home").cast("long")).alias("homes")).where(F.col("homes") > limit)
        groups = stage(groups.withColumn("k", F.least(F.lit(FAN), F.ceil(F.col("homes") / CELL))), "vector-full-cells")
        parts = _split(rows, groups, reach)
        if not parts:
            break
        done.append(rows.join(groups.select(*key), key, "left_anti"))
        rows, limit = reduce(DataFrame.unionByName, parts), 2 * CELL
    return reduce(DataFrame.unionByName, [*done, rows])


def _multiply(group: pa.Table, threshold: float) -> pa.Table:
    dim = group.column("dim")[0].as_py()
    group = group.sort_by("rep")
    ids = group.column("rep").to_numpy()
    copies = group.column("copies").to_numpy()
    x = _unit(group.column("vector").combine_chunks(), dim)
    kind = group.column("side").to_numpy()  # 0: a home vector of this block, 1: one of the others
    a, b = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    part = np.searchsorted(ids, ids)  # the first row of each one's component; rows of one id are one
    n = np.zeros(len(a), np.int64)
    for lo in range(0, len(a), ROWS):
        mine = a[lo : lo + ROWS]
        cosine = x[mine] @ x[b].T
        linked = cosine >= threshold
        # Within rounding of the threshold the plain sum of products decides, the same for both directions.
        for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < 1e-12), strict=True):
            linked[i, j] = float(np.sum(x[mine[i]] * x[b[j]])) >= threshold
        linked &= ids[mine][:, None] != ids[b][None, :]
        n[lo : lo + ROWS] = linked @ copies[b]
        for i in np.flatnonzero(linked.any(1)):
            met = part[b[linked[i]]]
            if (met != part[mine[i]]).any():
                met = np.unique(np.append(met, part[mine[i]]))
                part[np.isin(part, met)] = met[0]
    root = ids[part]
    rest = b[root[b] != ids[b]]
    rep, to = np.concatenate([ids[a], ids[rest]]), np.concatenate([root[a], root[rest]])
    return pa.table({"rep": pa.array(rep), "to": pa.array(to), "n": pa.array(np.concatenate([n, np.zeros(len(rest), np.int64)]))})


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``."""
    v = F.col("vector")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    keys = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(7), "vector").alias("h2")]
    keyed = stage(rows.select("id", "label", "usable", *keys, F.when(F.col("usable"), v).alias("vector")), "vectors")
    ids = keyed.select("id", "label", "usable", "h1", "h2")
    alike = ["label", "h1", "h2"]
    groups = keyed.where("usable").groupBy(*alike).agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"))
    groups = stage(groups, "vector-groups")
    member = stage(ids.where("usable").join(groups, alike).select(*alike, "id", "rep", "copies").distinct(), "vector-members")
    # A group's smallest id brings its vector; an id may stand in several groups, so the key is part of the join.
    distinct = keyed.where("usable").join(groups.withColumnRenamed("rep", "id"), [*alike, "id"]).dropDuplicates(alike)
    distinct = stage(distinct.select("label", F.size("vector").alias("dim"), F.col("id").alias("rep"), "copies", "vector"), "vector-distinct")

    placed = _cells(distinct, float(np.sqrt(2 - 2 * threshold)))
    cell = ["label", "dim", "cell"]
    sizes = placed.groupBy(*cell).agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count(F.lit(1)).alias("others"))
    sizes = stage(sizes.select(*cell, F.ceil(F.col("homes") / HOMES).alias("homes"), F.ceil(F.col("others") / OTHERS).alias("others")).where("homes > 0"), "vector-sizes")
    sized = placed.join(sizes, cell)
    h = F.xxhash64("rep")
    every = F.sequence(F.lit(0).cast("long"), F.col("others") - 1)
    left = sized.where("home").withColumn("i", F.pmod(h, F.col("homes"))).withColumn("j", F.explode(every)).withColumn("side", F.lit(0))
    right = sized.withColumn("j", F.pmod(h, F.col("others"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("homes") - 1))).withColumn("side", F.lit(1))
    columns = [*cell, "i", "j", "side", "rep", "copies", "vector"]
    pairs = left.select(*columns).unionByName(right.select(*columns))
    found = pairs.groupBy(*cell, "i", "j").applyInArrow(lambda t: _multiply(t, threshold), "rep long, to long, n long")
    found = stage(found, "vector-links")
    links = stage(found.groupBy("rep").agg(F.sum("n").alias("n")), "vector-link-counts")
    parts = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")).union(member.select(F.col("id").alias("a"), F.col("rep").alias("b"))))
    mine = member.join(links, "rep", "left").select("id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    mine = stage(mine.groupBy("id").agg(F.sum("n").alias("n_links")), "vector-counts")
    out = ids.select("id").join(mine.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    out = out.join(parts, F.col("id") == F.col("node"), "left")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
