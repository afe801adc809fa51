"""S-09: the stored tables as groups of Parquet files, and one manifest that names the files in force.

A table's rows lie in groups: those of one process together, or those whose key has one hash bucket. A commit writes
the files of the groups that it changes, for any number of tables, and then one small manifest; until that stands, readers
see the tables as they were, and the files of groups that nobody touched stay in force as they are. The manifest holds one
entry per group, as a listing of partitions would; it never holds rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from contextlib import nullcontext
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.functions.identity import job_id
from ledgerloom.session import CODEC, released_shuffles, unsorted_groups

# column whose values (or hash buckets) are the groups, and the number of buckets (0: a group per value)
GROUPS: dict[str, tuple[str, int]] = {
    "expenses": ("id", 16),
    "job_runs": ("process_id", 0),
    "job_run_stages": ("process_id", 0),
    "file_process_batches": ("process_id", 0),
    "file_processes": ("process_id", 4),
    "validation_policies": ("name", 1),
    "outcomes": ("process_id", 0),
    "prints": ("fingerprint", 16),
    "delivered": ("delivery", 16),
    "seen": ("lives_until", 0),
    "ttl_state": ("key", 16),
}
ONE = ("", 1)  # a table that is not listed is one group
# Columns that readers look single values up by. Files carry Bloom filters of them, so files without a value are not read; rows lie
# in the order of the first one, in short pages, so of the other files the pages that could hold a value are.
LOOKED_UP = {"expenses": ("id", "job_id"), "prints": ("fingerprint",), "delivered": ("delivery",), "seen": ("fingerprint",)}
FALSE_HITS = "0.000001"
PAGE_ROWS = "500"
PROBES = 4096  # values looked up by name, on the driver; beyond that by a join with the groups they fall into
FAN = 8  # parts of one size that a group collects before they become one of the next size


def _run_id() -> Column:
    return job_id(F.col("process_id"), F.col("batch_index"), F.col("record_index"))


def stage_id(run: Column, order: Column) -> Column:
    return F.concat_ws("-", run, order.cast("string"))


# Ids that follow from other columns of a row: 64 digits that no codec makes shorter than 32 bytes. Files hold null for such an id, and any
# other id as it is; ``ESCAPE`` alone stands for an id that is null, and before one that begins with it.
POSITION = ("process_id", "batch_index", "record_index")
DERIVED: dict[str, dict[str, tuple[Sequence[str], Callable[[], Column]]]] = {
    "job_runs": {"job_id": (POSITION, _run_id)},
    "job_run_stages": {
        "job_id": (POSITION, _run_id),
        "id": ((*POSITION, "stage_order"), lambda: stage_id(_run_id(), F.col("stage_order"))),
    },
    "outcomes": {"job_id": (POSITION, _run_id)},
}
ESCAPE = "="


def _derived(name: str, df: DataFrame) -> dict[str, Column | None]:
    """The derivable ids of ``df``, with how; None where the columns they follow from are not there."""
    texts = {c for c, kind in df.dtypes if kind == "string"}
    ids = {c: how for c, how in DERIVED.get(name, {}).items() if c in texts}
    return {c: make() if set(needs) <= set(df.columns) else None for c, (needs, make) in ids.items()}


def as_filed(name: str, df: DataFrame) -> DataFrame:
    """Rows as files hold them: derivable ids are left out."""

    def code(column: str, same: Column | None) -> Column:
        own = F.col(column)
        kept = F.when(own.isNull(), ESCAPE).when(own.startswith(ESCAPE), F.concat(F.lit(ESCAPE), own)).otherwise(own)
        return kept if same is None else F.when(~own.eqNullSafe(same), kept)

    codes = {c: code(c, same) for c, same in _derived(name, df).items()}
    return df.withColumns(codes) if codes else df


def as_read(name: str, filed: DataFrame) -> DataFrame:
    """The inverse of ``as_filed``."""

    def value(column: str, same: Column | None) -> Column:
        own = F.col(column)
        kept = F.when(own != ESCAPE, F.when(own.startswith(ESCAPE), own.substr(F.lit(2), F.length(own))).otherwise(own))
        return kept if same is None else F.when(own.isNull(), same).otherwise(kept)

    values = {c: value(c, same) for c, same in _derived(name, filed).items()}
    return filed.withColumns(values) if values else filed


def _one_of(column: str, texts: Sequence[str]) -> Column:
    """``column IN (...)``, parsed as one text: thousands of literals would be built one by one."""
    quoted = ("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in texts)
    return F.expr(f"`{column}` IN ({', '.join(quoted)})")


class Changed(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Files:
    """A folder of the shared store, through Hadoop's file system."""

    spark: SparkSession
    root: str

    def _open(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, path: str = "") -> list[str]:
        p, fs = self._open(f"{self.root}/{path}".rstrip("/"))
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def text(self, path: str) -> str:
        p, fs = self._open(f"{self.root}/{path}")
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, path: str, text: str) -> None:
        """Write a new file; readers see all of it or nothing."""
        p, fs = self._open(f"{self.root}/{path}")
        draft, _ = self._open(f"{self.root}/.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        if fs.exists(p) or not (fs.mkdirs(p.getParent()) and fs.rename(draft, p)):
            fs.delete(draft, False)
            raise Changed(path)

    def remove(self, path: str) -> None:
        p, fs = self._open(f"{self.root}/{path}")
        fs.delete(p, True)

    def folder(self, value: str | None) -> str:
        """The folder name of a group."""
        utils = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        return utils.getPartitionPathString("_group", value) if value else "_group=__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Store:
    """Tables under one root folder. ``name`` is a key of ``GROUPS``, or any other for a table of one group."""

    spark: SparkSession
    root: str

    @property
    def files(self) -> Files:
        return Files(self.spark, self.root)

    # ------------------------------------------------------------ manifests
    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names("manifest") if n.endswith(".json"))

    def manifest(self, at: int | None = None) -> dict:
        known = self.versions()
        at = (known[-1] if known else 0) if at is None else at
        return json.loads(self.files.text(f"manifest/{at}.json")) if at else {"version": 0, "tables": {}, "marks": {}}

    def mark(self, name: str):
        """What a commit noted under ``name``: the last epoch of a stream, for example."""
        return self.manifest()["marks"].get(name)

    # ---------------------------------------------------------------- reads
    def exists(self, name: str) -> bool:
        return name in self.manifest()["tables"]

    def read(self, name: str, values: Sequence[str] | None = None, at: int | None = None) -> DataFrame:
        """A table; with ``values`` only the groups in which rows of these process ids or buckets lie."""
        return self._scan(self.manifest(at), name, values)

    def _scan(self, manifest: dict, name: str, values: Sequence[str] | None = None, filed: bool = False) -> DataFrame:
        if name not in manifest["tables"]:
            raise FileNotFoundError(f"{self.root}/{name}")
        table = manifest["tables"][name]
        schema = StructType.fromJson(table["schema"])
        groups = table["groups"] if values is None else {g: table["groups"].get(g, []) for g in {self.files.folder(v) for v in values}}
        paths = [f"{folder}/{name}/{g}" for g, parts in groups.items() for folder, _ in parts]
        reader = self.spark.read.schema(schema)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return reader.parquet(*paths) if filed else as_read(name, reader.parquet(*paths))

    def values(self, name: str) -> list[str]:
        """The folder names of a table's groups, without their prefix."""
        table = self.manifest()["tables"].get(name)
        return sorted(g.removeprefix("_group=") for g in table["groups"]) if table else []

    def lookup(self, name: str, column: str, keys: DataFrame, values: Sequence[str] | None = None, at: int | None = None) -> DataFrame | None:
        """The rows whose ``column`` is one of the distinct ``keys`` (stored rows); None without a table.

        A few keys go to the scan as they are, where the Bloom filters of files that lack them keep those from being read. More
        are joined with the groups that they fall into.
        """
        manifest = self.manifest(at)
        if name not in manifest["tables"]:
            return None
        few = keys.select(column).limit(PROBES + 1).collect()
        if len(few) <= PROBES:
            found = [r[0] for r in few if r[0] is not None]
            return self._scan(manifest, name, values).where(_one_of(column, found)) if found else self._scan(manifest, name, [])
        if values is None and GROUPS.get(name, ONE)[0] == column:
            values = self.touched(name, keys)
        return self._scan(manifest, name, values).join(keys.select(column), column, "left_semi")

    def group_of(self, name: str) -> Column:
        """The group of a row, as text."""
        column, buckets = GROUPS.get(name, ONE)
        if not buckets:
            return F.col(column).cast("string")
        return F.lit("0") if buckets == 1 else F.pmod(F.xxhash64(column), F.lit(buckets)).cast("string")

    def touched(self, name: str, keys: DataFrame) -> list[str]:
        """The groups that hold, or would hold, rows of ``keys``: one value per group comes to the driver."""
        return [r[0] for r in keys.select(self.group_of(name).alias("g")).distinct().collect()]

    # --------------------------------------------------------------- writes
    def commit(self, **marks) -> Commit:
        """Changes that take effect together, at the end of a ``with`` block; ``marks`` are noted beside them."""
        return Commit(self, self.manifest(), marks)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Replace a whole table."""
        with self.commit() as c:
            c.replace(name, df)
        return self.read(name)

    def clone(self, root: str) -> Store:
        """A store of its own that starts from the same files; changes of one don't show in the other."""
        other = Store(self.spark, root)
        other.files.put("manifest/1.json", json.dumps(self.manifest() | {"version": 1}))
        return other

    def compact(self, *names: str) -> None:
        """Merge parts of one size, so that a group has few files however often rows were added; nothing is merged before ``FAN`` parts are there.

        A row is copied once for each power of ``FAN`` that its group grows by.
        """
        known = self.manifest()["tables"]
        full: dict[tuple[str, int], list[str]] = {}
        for name in names:
            for g, parts in known.get(name, {"groups": {}})["groups"].items():
                tiers = [t for _, t in parts]
                for t in {t for t in tiers if tiers.count(t) >= FAN}:
                    full.setdefault((name, t), []).append(g)
        for (name, tier), groups in full.items():
            with self.commit() as c:
                c.merge(name, groups, tier)

    def noted(self, stream: str) -> dict[int, dict]:
        """What the latest epochs of a stream noted before they started."""
        names = self.files.names(f"pins/{stream}")
        return {int(n.removesuffix(".json")): json.loads(self.files.text(f"pins/{stream}/{n}")) for n in names}

    def vacuum(self, keep: int = 2) -> None:
        """Delete manifests but the last ``keep`` and those that epochs of streams have noted, and own files that none of these names."""
        known = self.versions()
        pinned = [note["version"] for stream in self.files.names("pins") for note in self.noted(stream).values()]
        kept = sorted({*known[-keep:], *(v for v in pinned if v in known)})
        live = {f for at in kept for t in self.manifest(at)["tables"].values() for parts in t["groups"].values() for f, _ in parts}
        newest = known[-1] if known else 0
        for at in known:
            if at not in kept:
                self.files.remove(f"manifest/{at}.json")
        for v in self.files.names("data"):
            if f"{self.root}/data/{v}" not in live and int(v.split("-")[0]) <= newest:
                self.files.remove(f"data/{v}")


@dataclass
class Commit:
    """One commit in the making. What it reads is the state that it started from."""

    store: Store
    base: dict
    marks: dict
    name: str = ""
    tables: dict = field(default_factory=dict)

    def __enter__(self) -> Commit:
        self.name = f"{self.base['version'] + 1}-{uuid.uuid4().hex[:8]}"
        self.tables = {k: dict(v, groups={g: list(x) for g, x in v["groups"].items()}) for k, v in self.base["tables"].items()}
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self._finish()
        else:
            self.store.files.remove(f"data/{self.name}")

    @property
    def folder(self) -> str:
        return f"{self.store.root}/data/{self.name}"

    def _finish(self) -> None:
        version = self.base["version"] + 1
        whole = {"version": version, "tables": self.tables, "marks": self.base["marks"] | self.marks}
        try:
            self.store.files.put(f"manifest/{version}.json", json.dumps(whole))
        except Changed:
            self.store.files.remove(f"data/{self.name}")
            raise

    def read(self, name: str, values: Sequence[str] | None = None) -> DataFrame:
        return self.store._scan(self.base, name, values)

    def exists(self, name: str) -> bool:
        return name in self.base["tables"]

    def _write(self, name: str, df: DataFrame, dealt: bool = False, filed: bool = False) -> list[str]:
        path = f"{self.folder}/{name}"
        df = df if filed else as_filed(name, df)
        by = [c for c in LOOKED_UP.get(name, ()) if c in df.columns]
        rows = df.withColumn("_group", self.store.group_of(name))
        if by or not dealt:
            rows = (rows if dealt else rows.hint("rebalance", "_group")).sortWithinPartitions("_group", *by[:1])
        grouped = rows.write.mode("append").option("compression", CODEC).partitionBy("_group")
        for column in by:
            grouped = grouped.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.fpp#{column}", FALSE_HITS)
        if by:
            grouped = grouped.option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.block.size", str(32 << 20))
        if self.store.files.names(f"data/{self.name}/{name}"):
            raise ValueError(f"{name} is written twice in one commit")
        spark = df.sparkSession
        with released_shuffles(spark), nullcontext() if by or not dealt else unsorted_groups(spark):
            grouped.parquet(path)
        return [n for n in self.store.files.names(f"data/{self.name}/{name}") if n.startswith("_group=")]

    def _entry(self, name: str, df: DataFrame) -> dict:
        schema = json.loads(df.schema.json())
        entry = self.tables.setdefault(name, {"schema": schema, "groups": {}})
        wider = {f["name"]: f for f in entry["schema"]["fields"]} | {f["name"]: f for f in schema["fields"]}
        entry["schema"] = {"type": "struct", "fields": [f | {"nullable": True} for f in wider.values()]}
        return entry

    def replace(self, name: str, df: DataFrame, values: Sequence[str] | None = None, dealt: bool = False) -> None:
        """``df`` becomes the whole table, or the whole of the groups ``values``; other groups keep their files.

        With ``dealt`` the rows are written from where they are, and not sorted: their partitions hold few groups each.
        """
        entry = self._entry(name, df)
        new = self._write(name, df, dealt)
        if values is None:
            entry["groups"] = {}
            entry["schema"] = json.loads(df.schema.json())
        else:
            for g in {self.store.files.folder(v) for v in values}:
                entry["groups"].pop(g, None)
            strange = [g for g in new if g in entry["groups"]]
            if strange:
                raise ValueError(f"{name}: rows of groups that are not replaced: {strange}")
        entry["groups"] |= {g: [[self.folder, 0]] for g in new}

    def append(self, name: str, df: DataFrame, dealt: bool = False) -> None:
        """Rows beside those that are there; ``dealt`` as in ``replace``."""
        entry = self._entry(name, df)
        for g in self._write(name, df, dealt):
            entry["groups"].setdefault(g, []).append([self.folder, 0])

    def merge(self, name: str, groups: Sequence[str], tier: int) -> None:
        """The parts of one size in these groups (folder names) become one of the next size each."""
        entry = self.tables[name]
        old = {g: [p for p in entry["groups"][g] if p[1] == tier] for g in groups}
        rows = self.store._scan({"tables": {name: entry | {"groups": old}}}, name, filed=True)
        self._write(name, rows, filed=True)
        for g in groups:
            entry["groups"][g] = [p for p in entry["groups"][g] if p[1] != tier] + [[self.folder, tier + 1]]

    def drop(self, name: str, values: Sequence[str]) -> None:
        """Forget whole groups: no file is read or written."""
        for v in values:
            self.tables.get(name, {"groups": {}})["groups"].pop(self.store.files.folder(v), None)

    def amend(self, name: str, keys: DataFrame, key: str, add: DataFrame | None = None, change=None) -> None:
        """Rewrite the groups that hold rows of ``keys``, and no others.

        Those rows are left out, or replaced by ``change(rows)``; ``add`` are rows to put in. ``key`` must be the column that
        the table is grouped by. Groups that ``add`` alone touches get files beside theirs.
        """
        keys = keys.select(key).distinct()
        there = self.exists(name)
        near = self.store.touched(name, keys) if there else []
        old = self.read(name, near) if there else None
        hit = []
        if near:
            hit = self.store.touched(name, old.select(key).join(keys, key, "left_semi"))
        parts: list[DataFrame] = []
        if hit:
            rows = self.read(name, hit)
            parts.append(rows.join(keys, key, "left_anti"))
            if change is not None:
                parts.append(change(rows.join(keys, key, "left_semi")))
        if add is not None:
            parts.append(add)
        if not parts:
            return
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p, allowMissingColumns=True)
        entry = self._entry(name, whole)
        gone = {self.store.files.folder(v) for v in hit}
        for g in gone:
            entry["groups"].pop(g, None)
        for g in self._write(name, whole):
            entry["groups"].setdefault(g, []).append([self.folder, 0])
