"""Tables with keys on plain Parquet: DDL, DML, partitions and rollups.

A table is a folder of versions.  A statement writes a new version beside the
current one and then the next numbered pointer file, which must not be there
yet: readers see the old state or the new one, a failed statement leaves no
trace, and of two statements at once the later one fails.  Appends share the
files of earlier versions by listing their folders.  With a ``log`` each
statement also appends its changes to a change log, after its commit.  Rows are found and merged
with joins on the key; nothing is collected.
"""

from __future__ import annotations

import json
import posixpath
import re
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lakemill.streaming import changes

#: Pointer files: the one with the highest number holds; the one before it stays for readers that have just looked.
POINTER = re.compile(r"current-(\d{10})\.json")
#: The folder column of tables that are partitioned by ranges or hashes.
PART = "_part"


class DuplicateKey(ValueError):
    """A row with a key that the table has already."""


class Conflict(RuntimeError):
    """Another statement has changed the table meanwhile."""


@dataclass
class Meta:
    """What the pointer file holds."""

    schema: str
    key: list[str]
    unique: list[list[str]] = field(default_factory=list)
    partitions: list[str] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)
    rollups: dict[str, dict] = field(default_factory=dict)
    ttl: list | None = None
    defaults: dict[str, str] = field(default_factory=dict)
    version: int = 0
    scheme: dict | None = None  # kind (range, hash), column, parts: names with upper bounds, or their number


class Tables:
    """The tables below one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, log: str | None = None) -> None:
        """``log`` is a folder for change logs, one for each table with a primary key."""
        self.spark, self.root, self.log = spark, root.rstrip("/"), log

    # Files, through Hadoop so that any store works
    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self, p: str):
        return self._path(p).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self, name: str) -> list[int]:
        """The numbers of a table's pointer files, the highest first."""
        fs, home = self._fs(self.root), self._path(self._home(name))
        if not fs.exists(home):
            return []
        found = (POINTER.fullmatch(f.getPath().getName()) for f in fs.listStatus(home))
        return sorted((int(m[1]) for m in found if m), reverse=True)

    def _pointer(self, name: str, version: int) -> str:
        return posixpath.join(self._home(name), f"current-{version:010d}.json")

    def _home(self, name: str) -> str:
        return posixpath.join(self.root, name)

    def meta(self, name: str) -> Meta:
        for version in self._pointers(name):
            text = "".join(r[0] for r in self.spark.read.text(self._pointer(name, version), wholetext=True).collect())
            if text.endswith("}"):  # whole
                return Meta(**json.loads(text))
        raise KeyError(f"no table {name}")

    def _commit(self, name: str, meta: Meta) -> None:
        meta.version += 1
        fs, path = self._fs(self.root), self._path(self._pointer(name, meta.version))
        try:
            out = fs.create(path, False)
        except Exception as e:
            if fs.exists(path):
                raise Conflict(f"{name} has changed meanwhile") from e
            raise
        out.write(bytearray(json.dumps(asdict(meta)).encode()))
        out.close()
        for old in self._pointers(name):
            if old < meta.version - 1:
                fs.delete(self._path(self._pointer(name, old)), False)

    # DDL
    def create(self, name: str, schema: str, key: list[str], unique: list[list[str]] | None = None, partitions: list[str] | None = None, ttl: tuple[str, int] | None = None, defaults: dict[str, str] | None = None, scheme: dict | None = None) -> None:
        """``schema`` is DDL text; ``ttl`` is a timestamp column and the seconds that a row lives after it.

        ``partitions`` are columns with a folder for each value; ``scheme`` deals rows
        out by ranges or hashes of one column instead.
        """
        if self.exists(name):
            raise ValueError(f"table {name} exists")
        parsed = T.StructType.fromDDL(schema)
        self._commit(name, Meta(parsed.json(), key, unique or [], partitions or [], ttl=list(ttl) if ttl else None, defaults=defaults or {}, scheme=scheme))

    def exists(self, name: str) -> bool:
        return bool(self._pointers(name))

    def names(self) -> list[str]:
        fs, root = self._fs(self.root), self._path(self.root)
        found = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n for n in found if not n.startswith("_dropped-") and self.exists(n))

    def drop(self, name: str) -> None:
        """Rename the folder; :meth:`restore` undoes it."""
        self.meta(name)
        fs = self._fs(self.root)
        fs.delete(self._path(self._home(f"_dropped-{name}")), True)
        fs.rename(self._path(self._home(name)), self._path(self._home(f"_dropped-{name}")))

    def restore(self, name: str) -> None:
        if not self._fs(self.root).rename(self._path(self._home(f"_dropped-{name}")), self._path(self._home(name))):
            raise KeyError(f"no dropped table {name}")

    def rename(self, name: str, new: str) -> None:
        self.meta(name)
        self._fs(self.root).rename(self._path(self._home(name)), self._path(self._home(new)))
        meta = self.meta(new)
        moved = lambda fs: [f.replace(f"{self._home(name)}/", f"{self._home(new)}/") for f in fs]
        meta.folders = moved(meta.folders)
        for rollup in meta.rollups.values():
            rollup["folders"] = moved(rollup["folders"])
            rollup["version"] += rollup["version"] == meta.version
        self._commit(new, meta)

    def swap(self, a: str, b: str) -> None:
        t = f"swap-{uuid.uuid4().hex}"
        for x, y in ((a, t), (b, a), (t, b)):
            self.rename(x, y)

    def add_column(self, name: str, column: str, kind: str, default: str = "NULL") -> None:
        """Old files lack the column and read as null; a default rewrites them."""
        meta = self.meta(name)
        schema = T.StructType.fromJson(json.loads(meta.schema))
        if default == "NULL":
            meta.schema = schema.add(T.StructType.fromDDL(f"`{column}` {kind}").fields[0]).json()
            self._commit(name, meta)
        else:
            self._alter(name, self.read(name).withColumn(column, F.expr(default).cast(kind)), meta)

    def add_unique(self, name: str, columns: list[str]) -> None:
        """From now on rows must differ in these columns; those there are must do so already, nulls aside."""
        meta = self.meta(name)
        rows = self.read(name).select(*columns).dropna()
        if rows.groupBy(*columns).count().where("count > 1").limit(1).count():
            raise DuplicateKey(f"{name}: rows share {columns}")
        meta.unique.append(columns)
        self._commit(name, meta)

    def drop_column(self, name: str, column: str) -> None:
        meta = self.meta(name)
        if column in meta.key or any(column in u for u in meta.unique):
            raise ValueError(f"{column} belongs to a key")
        self._alter(name, self.read(name).drop(column), meta)

    def modify_column(self, name: str, column: str, kind: str, new_name: str | None = None) -> None:
        meta = self.meta(name)
        df = self.read(name).withColumn(column, F.col(column).try_cast(kind)).withColumnRenamed(column, new_name or column)
        swap = lambda xs: [new_name if new_name and x == column else x for x in xs]
        meta.key, meta.unique, meta.partitions = swap(meta.key), [swap(u) for u in meta.unique], swap(meta.partitions)
        self._alter(name, df, meta)

    def _alter(self, name: str, df: DataFrame, meta: Meta) -> None:
        meta.schema = df.schema.json()
        self._replace(name, df, meta)

    # Reading
    def read(self, name: str) -> DataFrame:
        meta = self.meta(name)
        schema = T.StructType.fromJson(json.loads(meta.schema))
        for f in schema:
            f.nullable = True
        if not meta.folders:
            return self.spark.createDataFrame([], schema)
        df = self._files(meta, meta.folders)
        if meta.ttl:
            df = df.where(F.col(meta.ttl[0]).isNull() | (F.col(meta.ttl[0]).cast("timestamp") + F.expr(f"INTERVAL {int(meta.ttl[1])} SECOND") > F.current_timestamp()))
        return df.select(*schema.names)

    def _files(self, meta: Meta, folders: list[str]) -> DataFrame:
        """The rows of some folders, with the folder column of a partitioned table; folders with columns of the path are read apart."""
        schema = T.StructType.fromJson(json.loads(meta.schema))
        for f in schema:
            f.nullable = True
        if meta.scheme:
            schema = schema.add(PART, T.StringType())
        if not (meta.partitions or meta.scheme):
            return self.spark.read.schema(schema).parquet(*folders)
        parts = [self.spark.read.schema(schema).parquet(f) for f in folders]
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        return df

    def part_of(self, meta: Meta) -> Column:
        """The name of the part that a row belongs to: p0, p1, ... for hashes, as declared for ranges."""
        column, parts = F.col(f"`{meta.scheme['column']}`"), meta.scheme["parts"]
        if meta.scheme["kind"] == "hash":
            return F.concat(F.lit("p"), F.coalesce(F.pmod(F.abs(column.cast("bigint")), F.lit(int(parts))), F.lit(0)).cast("string"))
        out = F
        for name, bound in parts:  # a null belongs to the first part
            test = F.lit(True) if bound is None else column.isNull() | (column < F.expr(bound)) if out is F else column < F.expr(bound)
            out = out.when(test, F.lit(name))
        return out.otherwise(F.raise_error(F.lit("no partition for a row")))

    def parts(self, name: str, names: list[str]) -> DataFrame:
        """FROM t PARTITION (p0, p1): the rows of these parts; other folders are not read."""
        meta = self.meta(name)
        if not meta.scheme:
            raise KeyError(f"{name} has no partitions")
        known = {f"p{k}" for k in range(int(meta.scheme["parts"]))} if meta.scheme["kind"] == "hash" else {p for p, _ in meta.scheme["parts"]}
        if set(names) - known:
            raise KeyError(f"{name} has no partition {sorted(set(names) - known)[0]}")
        df = self.read(name)
        return self._files(meta, meta.folders).where(F.col(PART).isin(names)).select(*df.columns) if meta.folders else df

    def partition(self, name: str, **values: object) -> DataFrame:
        """FROM t PARTITION (...): the rows of one partition, pruned by its folder."""
        df = self.read(name)
        for c, v in values.items():
            df = df.where(F.col(c) == F.lit(v))
        return df

    # Writing
    def _store(self, name: str, df: DataFrame, meta: Meta) -> str:
        folder = posixpath.join(self._home(name), f"v{meta.version + 1}-{uuid.uuid4().hex}")
        if meta.scheme:
            df = df.withColumn(PART, self.part_of(meta))
        writer = df.write
        if meta.scheme:
            writer = writer.partitionBy(PART)
        elif meta.partitions:
            writer = writer.partitionBy(*meta.partitions)
        writer.parquet(folder)
        return folder

    def _replace(self, name: str, df: DataFrame, meta: Meta | None = None) -> None:
        altered, meta = meta is not None, meta or self.meta(name)
        before = meta.folders
        meta.folders = [self._store(name, df, meta)]
        self._commit(name, meta)
        if not altered:
            self._logged(name, meta, before, meta.folders)

    def _logged(self, name: str, meta: Meta, before: list[str], after: list[str]) -> None:
        """Append what a statement changed, from the files before and after it, to the table's change log."""
        if self.log and meta.key:
            schema = T.StructType.fromJson(json.loads(meta.schema))
            old, new = (self._files(meta, x).select(*schema.names) if x else self.spark.createDataFrame([], schema) for x in (before, after))
            changes.append(posixpath.join(self.log, name), changes.changes(old, new, meta.key, int(time.time()), meta.version))

    def _replace_checked(self, name: str, df: DataFrame, keys: list[list[str]]) -> None:
        """Write the new state, and make it the table's only if its rows differ in each of these keys."""
        meta = self.meta(name)
        folder = self._store(name, df, meta)
        written = self._files(meta, [folder])
        for key in keys:
            if written.dropna(subset=key).groupBy(*key).count().where("count > 1").limit(1).count():
                self._fs(self.root).delete(self._path(folder), True)
                raise DuplicateKey(f"{name} {key}")
        before, meta.folders = meta.folders, [folder]
        self._commit(name, meta)
        self._logged(name, meta, before, meta.folders)

    def _numbered(self, name: str, df: DataFrame, column: str) -> tuple[DataFrame, str]:
        """Rows with a number each that never changes, as they are written once; and their folder, to be deleted."""
        folder = posixpath.join(self._home(name), f"_rows-{uuid.uuid4().hex}")
        df.withColumn(column, F.monotonically_increasing_id()).write.parquet(folder)
        return self.spark.read.parquet(folder), folder

    def _append(self, name: str, df: DataFrame) -> None:
        meta = self.meta(name)
        folder = self._store(name, df, meta)
        meta.folders.append(folder)
        for rollup in meta.rollups.values():  # rollups that hold so far take the new rows' sums as well
            if rollup["version"] == meta.version:
                rollup["folders"].append(self._rolled(name, self._files(meta, [folder]), rollup["keys"], rollup["sums"]))
                rollup["version"] += 1
        self._commit(name, meta)
        self._logged(name, meta, [], [folder])

    def _fitted(self, name: str, rows: DataFrame) -> DataFrame:
        """The rows with the table's columns and types; missing ones take their defaults."""
        meta = self.meta(name)
        schema = T.StructType.fromJson(json.loads(meta.schema))
        missing = lambda f: F.expr(meta.defaults.get(f.name, "NULL"))
        return rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else missing(f)).cast(f.dataType).alias(f.name) for f in schema])

    def _keys(self, name: str) -> list[list[str]]:
        meta = self.meta(name)
        return ([meta.key] if meta.key else []) + meta.unique

    def _once(self, name: str, rows: DataFrame, last: bool, order: Column | None = None) -> DataFrame:
        """One row of each key: of several the first or the last by ``order``, or else as they come in."""
        rows = rows.withColumn("_nth", F.monotonically_increasing_id() if order is None else order)
        for key in self._keys(name):
            by = F.col("_nth").desc() if last else F.col("_nth").asc()
            null = " OR ".join(f"`{k}` IS NULL" for k in key)
            rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(by))).where(f"_place = 1 OR {null}").drop("_place")
        return rows.drop("_nth")

    def insert(self, name: str, rows: DataFrame) -> None:
        """Fails if a row's key is there already, or twice in ``rows``; writes nothing then."""
        new = self._fitted(name, rows)
        for key in self._keys(name):
            twice = new.dropna(subset=key).groupBy(*key).count().where("count > 1").limit(1).count()
            if twice or new.join(self.read(name), key, "left_semi").limit(1).count():
                raise DuplicateKey(f"{name} {key}")
        self._append(name, new)

    def insert_ignore(self, name: str, rows: DataFrame) -> None:
        new = self._once(name, self._fitted(name, rows), last=False)
        for key in self._keys(name):
            new = new.join(self.read(name).select(*key), key, "left_anti").select(*new.columns)
        self._append(name, new)

    def replace(self, name: str, rows: DataFrame, order: Column | None = None) -> None:
        """New rows drive out every old one that shares any unique key with them."""
        new = self._once(name, self._fitted(name, rows), last=True, order=order)
        old = self.read(name)
        for key in self._keys(name):
            old = old.join(new.select(*key), key, "left_anti").select(*new.columns)
        self._replace(name, old.unionByName(new))

    def upsert(self, name: str, rows: DataFrame, update: dict[str, str]) -> None:
        """INSERT ... ON DUPLICATE KEY UPDATE; expressions see ``target.c`` and, as VALUES(c), ``source.c``."""
        keys = self._keys(name)
        old, held = self._numbered(name, self.read(name), "_row")
        new, more = self._numbered(name, self._once(name, self._fitted(name, rows), last=True), "_src")
        columns = [c for c in old.columns if c != "_row"]
        # A new row meets the old one that shares its first key, in the order primary, unique; of two that meet one old row the last counts.
        met: DataFrame | None = None
        for k, key in enumerate(keys):
            pairs = new.select(*key, "_src").join(old.select(*key, "_row"), key).select("_src", "_row", F.lit(k).alias("_k"))
            met = pairs if met is None else met.unionByName(pairs)
        met = met.groupBy("_src").agg(F.min(F.struct("_k", "_row")).alias("m")).select("_src", F.col("m._row").alias("_row"))
        last = met.groupBy("_row").agg(F.max("_src").alias("_src"))
        both = old.alias("target").join(last.alias("hit"), F.col("target._row") == F.col("hit._row"), "left").join(new.alias("source"), F.col("hit._src") == F.col("source._src"), "left")

        def value(c: str) -> Column:
            kept = F.col(f"target.{c}")
            return F.when(F.col("hit._src").isNotNull(), F.expr(update[c]).cast(old.schema[c].dataType)).otherwise(kept) if c in update else kept

        fresh = new.join(met, "_src", "left_anti").select(*columns)
        changed = [key for key in keys if set(key) & set(update)]
        self._replace_checked(name, both.select(*[value(c).alias(c) for c in columns]).unionByName(fresh), changed)
        for folder in (held, more):
            self._fs(self.root).delete(self._path(folder), True)

    def insert_merge(self, name: str, rows: DataFrame, sums: list[str]) -> None:
        """Merging insert: old and new rows of a key become one, whose ``sums`` add up; other columns take the last value."""
        meta = self.meta(name)
        both = self.read(name).withColumn("_nth", F.lit(-1).cast("long")).unionByName(self._fitted(name, rows).withColumn("_nth", F.monotonically_increasing_id()))
        rest = [c for c in both.columns if c not in meta.key and c not in sums and c != "_nth"]
        merged = both.groupBy(*meta.key).agg(*[F.sum(c).cast(both.schema[c].dataType).alias(c) for c in sums], *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_nth"))).alias(c) for c in rest])
        self._replace(name, merged.select(*both.drop("_nth").columns))

    def _chosen(self, name: str, where: str, order_by: list[Column] | None, limit: int | None) -> tuple[DataFrame, str | None]:
        """The table's rows, those that a statement means marked as ``_hit``; and a folder to be deleted afterwards."""
        df, hit = self.read(name), F.coalesce(F.expr(where).cast("boolean"), F.lit(False))
        if limit is None:
            return df.withColumn("_hit", hit), None
        numbered, folder = self._numbered(name, df, "_row")
        first = numbered.where(hit).orderBy(*(order_by or []), "_row").limit(limit).select("_row", F.lit(True).alias("_top"))
        return numbered.join(first, "_row", "left").withColumn("_hit", F.coalesce("_top", F.lit(False))).drop("_row", "_top"), folder

    def update(self, name: str, assignments: dict[str, str], where: str = "true", order_by: list[Column] | None = None, limit: int | None = None) -> None:
        """Fails, and changes nothing, if rows would share a key."""
        marked, folder = self._chosen(name, where, order_by, limit)
        columns = [c for c in marked.columns if c != "_hit"]
        state = marked.select(*[F.when(F.col("_hit"), F.expr(assignments[c]).cast(marked.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c) for c in columns])
        try:
            self._replace_checked(name, state, [key for key in self._keys(name) if set(key) & set(assignments)])
        finally:
            if folder:
                self._fs(self.root).delete(self._path(folder), True)

    def delete(self, name: str, where: str = "true", order_by: list[Column] | None = None, limit: int | None = None) -> None:
        marked, folder = self._chosen(name, where, order_by, limit)
        self._replace(name, marked.where("NOT _hit").drop("_hit"))
        if folder:
            self._fs(self.root).delete(self._path(folder), True)

    def truncate(self, name: str, **partition: object) -> None:
        """Without arguments the whole table, else one partition."""
        if partition:
            test = " AND ".join(f"`{k}` <=> {json.dumps(v)}" for k, v in partition.items())
            self.delete(name, test)
            return
        meta = self.meta(name)
        before, meta.folders = meta.folders, []
        self._commit(name, meta)
        self._logged(name, meta, before, [])

    # Rollups
    def _rolled(self, name: str, rows: DataFrame, keys: list[str], sums: list[str]) -> str:
        folder = posixpath.join(self._home(name), f"rollup-{uuid.uuid4().hex}")
        rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).write.parquet(folder)
        return folder

    def add_rollup(self, name: str, rollup: str, keys: list[str], sums: list[str]) -> None:
        """A table of sums by some columns, which :meth:`aggregate` uses.

        Inserts add to it; after any other change of the table it is out of use until it
        is added again.
        """
        meta = self.meta(name)
        meta.rollups[rollup] = {"keys": keys, "sums": sums, "folders": [self._rolled(name, self.read(name), keys, sums)], "version": meta.version + 1}
        self._commit(name, meta)

    def rollup_for(self, name: str, keys: list[str], sums: list[str], filtered: list[str]) -> list[str] | None:
        """The folders of the smallest current rollup that answers sums of plain columns, grouped and filtered by its keys."""
        meta = self.meta(name)
        fit = [r for r in meta.rollups.values() if keys and r["version"] == meta.version and {*keys, *filtered} <= {*r["keys"]} and {*sums} <= {*r["sums"]}]
        return min(fit, key=lambda r: len(r["keys"]))["folders"] if fit else None

    def aggregate(self, name: str, keys: list[str], sums: list[str], where: str | None = None, filtered: list[str] | None = None) -> DataFrame:
        """Sums by keys, from a rollup if one fits; ``filtered`` names the columns of ``where``."""
        folders = self.rollup_for(name, keys, sums, filtered or []) if where is None or filtered else None
        df = self.spark.read.parquet(*folders) if folders else self.read(name)
        df = df.where(where) if where else df
        return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
