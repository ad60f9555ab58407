"""A store of versioned Parquet tables, merged on read: a table is a list of parts, and every commit names all parts in one manifest.

Readers see the manifest of the greatest version, so a write that breaks off leaves the old state in place. New rows are a part of their own. Rows
are taken away by a part of keys: it hides the rows of older parts that have these keys, until ``compact`` writes the table anew
without them. A table of over MOST_PARTS parts is compacted by the next commit, and manifests beyond KEPT_VERSIONS are expired together with
the files that only they name, so that what a read lists stays bounded however many commits there were.

A part comes with a filter of its keys: one bitmap per leaf of a key's hash. A lookup meets the filters first and reads only the parts that may hold a key.

A writer claims the next version by a file of its name, so of two writers one waits, reads the new state and tries again: no update is
lost. A claim is a lease: when its writer has not finished within LEASE seconds, another one takes the version over by the next
claim file, and the late writer finds its claim superseded. Meeting ids are checksums of the content: a retried batch writes the same rows, and a
repeated upload is met by a lookup.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources.scratch import written

TABLES = {"meetings": "id", "turns": "id", "chunks": "id", "postings": "id", "briefs": "id", "rejected": "id", "traces": "trace_id"}
#: Folders within a part, for tables whose readers ask for some of them.
FOLDERS = {"postings": "bucket"}
#: Times that a commit is tried against other writers, seconds that a claim holds, parts of a table and versions of the store that are kept.
TRIES, LEASE, MOST_PARTS, KEPT_VERSIONS = 10, 600.0, 32, 20
#: Leaves of a key filter and bits of a leaf.
LEAVES, BITS = 4096, 32768


class Part(NamedTuple):
    """A part of a table: its folder, whether it holds rows or keys that hide rows, the version it came with, and the folder of its key filter."""

    name: str
    at: str
    hides: bool
    version: int
    filter: str | None


Parts = dict[str, list[Part]]
SCHEMA = "name string, at string, hides boolean, version long, filter string"


def newest_first(meetings: DataFrame) -> list:
    """The order of meetings: by date, or by creation where there is none, the newest first."""
    made = F.col("created_at") if "created_at" in meetings.columns else F.lit(None).cast("string")
    return [F.desc(F.coalesce(F.col("date"), made)), F.desc(made), F.col("id")]


def latest(traces: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` traces, 200 at most; payloads that are no JSON are left out."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return traces.where(F.try_parse_json("payload").isNotNull()).orderBy(F.desc("created_at"), "trace_id").limit(min(limit, 200))


def without(table: DataFrame, ids: DataFrame) -> DataFrame:
    """``table`` less the rows of ``ids`` (id)."""
    return table.join(ids.select("id"), "id", "left_anti")


def _leaf(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(LEAVES)).cast("int")


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(BITS))


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """(leaf, bits): a bitmap for each leaf that a key falls into."""
    return keys.groupBy(_leaf(F.col(key)).alias("leaf")).agg(F.bitmap_construct_agg(_bit(F.col(key))).alias("bits"))


def may_hold(filters: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``filters`` (leaf, bits, others) of the leaves and bits that some key of ``keys`` falls on."""
    at = keys.select(_leaf(F.col(key)).alias("leaf"), _bit(F.col(key)).alias("bit")).distinct()
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return filters.join(at, "leaf").where(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _listed(self, folder: str) -> list:
        fs, at = self._files(f"{self.path}/{folder}")
        return list(fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(f.getPath().getName()[1:]) for f in self._listed("_manifest"))

    def _parts(self, version: int) -> Parts:
        found: Parts = {}
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/_manifest/v{version}").collect() if version else []  # MOST_PARTS a table, and what one commit adds
        for r in rows:
            found.setdefault(r.name, []).append(Part(*r))
        return {name: sorted(parts, key=lambda p: (p.version, p.at)) for name, parts in found.items()}

    def current(self) -> tuple[int, Parts]:
        """The version and the parts of each table."""
        version = max(self.versions(), default=0)
        return version, self._parts(version)

    def _read(self, parts: list[Part] | None) -> DataFrame | None:
        """The rows of the parts that no later part hides."""
        rows = [p for p in parts or [] if not p.hides]
        if not rows:
            return None
        key = TABLES[rows[0].name]
        hiding = [p for p in parts if p.hides]
        # parts that no hiding part follows need no test
        last = max((p.version for p in hiding), default=-1)
        plain, tested = [p for p in rows if p.version >= last], [p for p in rows if p.version < last]
        load = lambda some: self.spark.read.option("mergeSchema", "true").parquet(*[p.at for p in some])
        if not tested:
            return load(plain)
        when = lambda some: F.create_map(*[x for p in some for x in (F.lit(p.at.rsplit("/", 1)[-1]), F.lit(p.version))])
        version = lambda some: F.element_at(when(some), F.regexp_extract(F.col("_metadata.file_path"), r"/([0-9a-f]{32})/", 1))
        gone = load(hiding).select(F.col(key).alias("_gone"), version(hiding).alias("_until")).groupBy("_gone").agg(F.max("_until").alias("_until"))
        old = load(tested).withColumn("_version", version(tested))
        left = old.join(gone, (old[key] == gone["_gone"]) & (old["_version"] < gone["_until"]), "left_anti").drop("_version")
        return left.unionByName(load(plain), allowMissingColumns=True) if plain else left

    def table(self, name: str) -> DataFrame | None:
        return self._read(self.current()[1].get(name))

    def _write(self, name: str, df: DataFrame, hides: bool = False) -> Part | None:
        """A new part, its version set when it is committed; none where a table in folders has no rows."""
        at, beside = (f"{self.path}/{kind}/{uuid.uuid4().hex}" for kind in (name, "_filters"))
        folder = None if hides else FOLDERS.get(name)
        (df.repartition(folder).write.partitionBy(folder) if folder else df.write).parquet(at)
        if hides:
            return Part(name, at, hides, 0, None)
        if folder and all(f.isFile() for f in self._listed(at.removeprefix(f"{self.path}/"))):
            return None  # no row, so no folder
        key = TABLES[name]
        key_filter(self.spark.read.schema(df.schema).parquet(at).select(key).where(F.col(key).isNotNull()), key).coalesce(1).write.parquet(beside)
        return Part(name, at, hides, 0, beside)

    def holding(self, parts: list[Part], keys: DataFrame, key: str) -> list[Part]:
        """The parts of rows among ``parts`` whose filter lets some key through; those without a filter too."""
        own = [p for p in parts if not p.hides and p.filter]
        named = F.regexp_extract(F.col("_metadata.file_path"), r"/([0-9a-f]{32})/", 1).alias("part")
        met = may_hold(self.spark.read.parquet(*[p.filter for p in own]).select("leaf", "bits", named), keys, key).select("part").distinct().collect() if own else []  # one row per part
        some = {r.part for r in met}
        return [p for p in parts if not p.hides and (not p.filter or p.filter.rsplit("/", 1)[-1] in some)]

    def _claim(self, version: int) -> str | None:
        """The claim file of a version, if this writer gets it: the first, or the one that follows a claim older than LEASE."""
        claims = sorted((f for f in self._listed("_claims") if f.getPath().getName().split(".")[0] == f"v{version}"), key=lambda f: f.getPath().getName())
        if claims and time.time() - claims[-1].getModificationTime() / 1000 < LEASE:
            return None
        name = f"{self.path}/_claims/v{version}.{len(claims):04}"
        fs, at = self._files(name)
        return name if fs.createNewFile(at) else None

    def _superseded(self, claim: str) -> bool:
        version = claim.rsplit("/", 1)[-1].split(".")[0]
        return max(f.getPath().getName() for f in self._listed("_claims") if f.getPath().getName().split(".")[0] == version) != claim.rsplit("/", 1)[-1]

    def _remove(self, parts: set[Part]) -> None:
        for at in {x for p in parts for x in (p.at, p.filter)} - {None}:
            fs, path = self._files(at)
            fs.delete(path, True)

    def _commit(self, change: Callable[[Parts], Parts], own: tuple[Part, ...] = ()) -> int:
        """change: gets the parts of each table and gives those of the tables that it changes, new ones with version 0. own: new parts that it gives again when it is tried again."""
        for k in range(TRIES):
            version, now = self.current()
            after = now | change(now)
            made = {p for parts in after.values() for p in parts if not p.version}
            after |= {name: self._compacted(name, parts) for name, parts in after.items() if len(parts) > MOST_PARTS}
            left = {p for parts in after.values() for p in parts if not p.version}
            rows = [tuple(p._replace(version=p.version or version + 1)) for parts in after.values() for p in parts]
            aside, target = f"{self.path}/_aside/{uuid.uuid4().hex}", f"{self.path}/_manifest/v{version + 1}"
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(aside)
            if (claim := self._claim(version + 1)) and version + 1 not in self.versions() and not self._superseded(claim):
                fs, source = self._files(aside)
                to = self._files(target)[1]
                fs.mkdirs(to.getParent())
                if fs.rename(source, to):  # whole at once: readers never see half a manifest
                    self._remove((made | set(own)) - left)
                    self._expire(version + 1)
                    return version + 1
            self._remove((made | left) - set(own))
            time.sleep(0.2 * (k + 1))
        raise RuntimeError(f"version {version + 1} is claimed by a writer that has not finished; its lease ends {LEASE:.0f} seconds after the claim")

    def _compacted(self, name: str, parts: list[Part]) -> list[Part]:
        """One part with the rows that are left. It stands for all that it was made of, so only later parts hide its rows."""
        rows = self._read([p._replace(version=p.version or 1 << 40) for p in parts])
        part = None if rows is None else self._write(name, rows)
        return [part] if part else []

    def compact(self, *names: str) -> int:
        """Write tables anew as one part each; all where none is named."""
        return self._commit(lambda now: {n: self._compacted(n, parts) for n, parts in now.items() if (not names or n in names) and len(parts) > 1})

    def _expire(self, version: int) -> None:
        """Remove manifests beyond KEPT_VERSIONS, their claims, and the parts that no manifest left names."""
        old = [v for v in self.versions() if v <= version - KEPT_VERSIONS]
        if not old:
            return
        # a part that a kept version lacks is in no later one
        kept = {p.at for v in self.versions() if v not in old for parts in self._parts(v).values() for p in parts}
        for v in old:
            self._remove({p for parts in self._parts(v).values() for p in parts if p.at not in kept})
            fs, path = self._files(f"{self.path}/_manifest/v{v}")
            fs.delete(path, True)
        for f in self._listed("_claims"):
            if int(f.getPath().getName()[1:].split(".")[0]) in old:
                self._files(self.path)[0].delete(f.getPath(), False)

    def new_only(self, meetings: DataFrame, name: str = "meetings") -> DataFrame:
        """Rows whose id is not stored yet, once each; only parts that may hold one of the ids are read."""
        key, parts = TABLES[name], self.current()[1].get(name, [])
        fresh = meetings.dropDuplicates([key])
        near = self.holding(parts, fresh.select(key), key) if parts else []
        old = self._read([*near, *(p for p in parts if p.hides)]) if near else None
        return fresh if old is None else fresh.join(old.select(key), key, "left_anti")

    def find(self, name: str, ids: DataFrame) -> DataFrame | None:
        """The rows of a table whose key is in ``ids``, from the parts that may hold them."""
        key, parts = TABLES[name], self.current()[1].get(name, [])
        near = self.holding(parts, ids.select(key), key) if parts else []
        return self._read([*near, *(p for p in parts if p.hides)]).join(ids.select(key).distinct(), key, "left_semi") if near else None

    def save(self, **tables: DataFrame) -> int:
        """Replace the rows of the keys in ``tables`` and add the new ones, all tables in one version."""
        parts = {name: part for name, df in tables.items() if (part := self._write(name, df))}
        keys = {name: self.spark.read.parquet(p.at).select(TABLES[name]).distinct() for name, p in parts.items()}

        def change(now: Parts) -> Parts:
            out = {}
            for name, part in parts.items():
                near = self.holding(now.get(name, []), keys[name], TABLES[name])
                held = self._read([*near, *(p for p in now[name] if p.hides)]) if near else None
                met = held.select(TABLES[name]).join(keys[name], TABLES[name], "left_semi").distinct() if held is not None else None
                hiding = [self._write(name, met, hides=True)] if met is not None and met.take(1) else []
                out[name] = [*now.get(name, []), *hiding, part]
            return out

        return self._commit(change, tuple(parts.values()))

    def delete(self, ids: DataFrame) -> int:
        """Take meetings out of every table that has their id: their keys hide what is stored of them so far."""
        keys = written(ids.select("id").distinct(), "gone")
        return self._commit(lambda now: {n: [*parts, self._write(n, keys, hides=True)] for n, parts in now.items() if TABLES[n] == "id"})

    def save_brief(self, briefs: DataFrame) -> int:
        """Set the briefs of meetings (id, brief columns); those of unknown meetings are left out."""
        known = self.find("meetings", briefs)
        return self.save(briefs=briefs if known is None else briefs.join(known.select("id"), "id", "left_semi"))

    def save_traces(self, traces: DataFrame) -> int:
        """Add or replace traces (trace_id, created_at, question, payload)."""
        return self.save(traces=traces)

    def meetings(self) -> DataFrame | None:
        """Newest first, without the bulky columns."""
        m = self.table("meetings")
        return None if m is None else m.orderBy(*newest_first(m)).drop("transcript", "turns", "checksum")

    def latest_traces(self, limit: int = 25) -> DataFrame | None:
        if limit < 0:
            raise ValueError("limit must not be negative")
        t = self.table("traces")
        return None if t is None else latest(t, limit)
