"""A versioned store: immutable folders of versions and commits that list them.

A write resolves versions against the newest state of the resources it names,
writes their versions and index rows into folders of its own, and then makes the
next numbered commit, which lists all folders that count. A commit appears whole,
by renaming a finished file, and never over another one: of two writers that base
on the same commit one fails with Conflict, and what a failed write left behind is
never seen. Folders are merged in tiers, eight of a size at a time, so that a
reader meets few of them: live folders keep only the newest version of each
resource, index folders only the rows of live versions, history keeps all.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .engine import Engine
from .errors import Conflict, Deleted, Duplicate, Invalid, MultipleMatches, NotFound, NotModified, SearchError
from .operators.extract import WIDE, indexes, wide_rows
from .operators.lower import Stored, Tables
from .schemas import HISTORY

CHANGE = "resource_type string, fhir_id string, content string, expected long, fresh boolean"
LIVE, INDEX = f"pid long, {HISTORY}", f"{WIDE}, version_id long"
KINDS = {"history": HISTORY, "live": LIVE, "index": INDEX}
#: Folders of a tier that are merged into one of the next.
TIER = 8
KEYS = ["resource_type", "fhir_id"]


@dataclass(frozen=True)
class Change:
    """content None deletes; expected is the version that must be current; fresh refuses ids used before."""

    type: str
    id: str
    content: str | None
    expected: int | None = None
    fresh: bool = False


@dataclass(frozen=True)
class Staged:
    """What a write is about to commit: the commit's number, its folders, and the versions written."""

    number: int
    folders: dict[str, list[list]]
    versions: DataFrame


def newest(rows: DataFrame) -> DataFrame:
    """The newest version of each resource."""
    last = Window.partitionBy(*KEYS).orderBy(F.desc("version_id"))
    return rows.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


class Store:
    """At the newest commit, or at the folders of a staged one."""

    def __init__(self, spark: SparkSession, path: str, folders: dict[str, list[list]] | None = None, validate_writes: bool = False):
        self.spark, self.path, self.validate_writes = spark, path.rstrip("/"), validate_writes
        self._fixed = folders
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop("commits").getFileSystem(self._conf)

    def _hadoop(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    # commits

    @property
    def commits(self) -> int:
        """The newest commit's number; 0 of an empty store."""
        at = self._hadoop("commits")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _folders(self, number: int) -> dict[str, list[list]]:
        """The folders that count, as [name, tier], of each kind."""
        if not number:
            return {k: [] for k in KINDS}
        return json.loads(self.spark.read.text(f"{self.path}/commits/{number:012d}", wholetext=True).first()[0])

    def commit(self, staged: Staged) -> None:
        """Makes a staged write count; Conflict if another one has taken its place."""
        name = f"making/{uuid.uuid4().hex}"
        out = self._fs.create(self._hadoop(name), False)
        out.write(bytearray(json.dumps(staged.folders).encode()))
        out.close()
        self._fs.mkdirs(self._hadoop("commits"))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._hadoop("commits").toUri(), self._conf)
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        never_over = self.spark.sparkContext._gateway.new_array(rename, 1)
        never_over[0] = rename.NONE
        try:
            context.rename(self._fs.makeQualified(self._hadoop(name)), self._fs.makeQualified(self._hadoop(f"commits/{staged.number:012d}")), never_over)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            self._fs.delete(self._hadoop(name), False)
            raise Conflict("another write was committed first") from None

    def at(self, staged: Staged) -> Store:
        """The store as it will be once staged is committed."""
        return Store(self.spark, self.path, staged.folders, self.validate_writes)

    # tables

    def _table(self, kind: str, folders: dict[str, list[list]] | None = None) -> DataFrame:
        names = [n for n, _ in (folders or self._fixed or self._folders(self.commits))[kind]]
        if not names:
            return self.spark.createDataFrame([], KINDS[kind])
        return self.spark.read.schema(KINDS[kind]).parquet(*[f"{self.path}/{kind}/{n}" for n in names])

    def log(self) -> DataFrame:
        """All versions."""
        return self._table("history")

    def current(self) -> DataFrame:
        """The newest version of each resource with its surrogate key, tombstones included."""
        folders = self._fixed or self._folders(self.commits)
        rows = self._table("live", folders)
        return newest(rows) if len(folders["live"]) > 1 else rows

    def tables(self) -> Tables:
        """Indexes of current versions: rows of older versions drop out in a semi join."""
        current = self.current()
        wide = self._table("index").join(current.where("not deleted").select("pid", "version_id"), ["pid", "version_id"], "left_semi")
        return Stored({"resource": current, **indexes(wide)})

    def engine(self) -> Engine:
        return Engine(self.tables())

    # writes

    def _save(self, kind: str, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{kind}/{name}")
        return name

    def _merged(self, folders: dict[str, list[list]]) -> dict[str, list[list]]:
        """Merges the folders of each full tier."""
        tier = 0
        while sum(t == tier for _, t in folders["live"]) >= TIER:
            old = {k: {"history": [], "live": [], "index": [], k: [f for f in v if f[1] == tier]} for k, v in folders.items()}
            live = self._save("live", newest(self._table("live", old["live"])))
            kept = self.spark.read.schema(LIVE).parquet(f"{self.path}/live/{live}").where("not deleted").select("pid", "version_id")
            made = {"live": live, "history": self._save("history", self._table("history", old["history"])), "index": self._save("index", self._table("index", old["index"]).join(kept, ["pid", "version_id"], "left_semi"))}
            folders = {k: [f for f in v if f[1] != tier] + [[made[k], tier + 1]] for k, v in folders.items()}
            tier += 1
        return folders

    def _keyed(self, rows: DataFrame, have: DataFrame, live: DataFrame) -> DataFrame:
        """rows with surrogate keys: that of a known resource stays; a new one's hash is salted where another resource has it."""
        known = rows.join(have.select("pid", *KEYS), KEYS, "left").withColumn("old", F.col("pid").isNotNull())
        for salt in range(4):
            tried = known.withColumn("pid", F.coalesce("pid", F.xxhash64(*KEYS, *[F.lit(salt)] * bool(salt))))
            others = live.select(F.col("pid"), *[F.col(k).alias(f"other_{k}") for k in KEYS])
            taken = tried.join(others, "pid", "left_semi").join(others, "pid").where("resource_type <> other_resource_type or fhir_id <> other_fhir_id").select(*KEYS)
            twice = tried.where("not old").groupBy("pid").agg(F.count("*").alias("n"), F.min(F.struct(*KEYS)).alias("first")).where("n > 1")
            again = tried.where("not old").join(twice, "pid").where(F.struct(*KEYS) != F.col("first")).select(*KEYS)
            clash = taken.unionByName(again).distinct()
            if clash.isEmpty():
                return tried.drop("old")
            known = tried.join(clash.withColumn("clash", F.lit(True)), KEYS, "left").withColumn("pid", F.when(F.col("clash").isNull(), F.col("pid"))).drop("clash")
        raise Conflict("resources share a surrogate key")

    def stage(self, changes: list[Change] | DataFrame, at: int | None = None) -> Staged:
        """Writes all changes beside what is there; they count once they are committed."""
        number = self.commits
        folders = self._folders(number)
        d = changes if isinstance(changes, DataFrame) else self.spark.createDataFrame([(c.type, c.id, c.content, c.expected, c.fresh) for c in changes], CHANGE)
        if not d.groupBy(*KEYS).count().where("count > 1").isEmpty():
            raise Conflict("a resource is changed twice")
        if self.validate_writes:
            self._validated(d)
        live = self._table("live", folders)
        have = newest(live.join(d.select(*KEYS), KEYS, "left_semi")).select("pid", *KEYS, F.col("version_id").alias("now"), F.col("deleted").alias("gone"))
        both = d.join(have.drop("pid"), KEYS, "left")
        bad = both.select(
            F.coalesce(F.max(F.col("fresh") & F.col("now").isNotNull()), F.lit(False)),
            F.coalesce(F.max(F.col("expected").isNotNull() & (F.coalesce("now", F.lit(0)) != F.col("expected"))), F.lit(False)),
        ).first()
        if bad[0]:
            raise Duplicate("an id was used before")
        if bad[1]:
            raise Conflict("a version is not the expected one")
        # deleting what is absent or deleted changes nothing
        both = both.where(~(F.col("content").isNull() & F.coalesce(F.col("gone"), F.lit(True))))
        micros = int(time.time() * 1e6) // 1000 * 1000 if at is None else at
        version = (F.coalesce("now", F.lit(0)) + 1).cast("long")
        rows = both.select(*KEYS, version.alias("version_id"), F.lit(micros).cast("long").alias("last_updated"), F.col("content").isNull().alias("deleted"), "content")
        history = self._save("history", rows.mapInPandas(_stamp, HISTORY))
        new = self.spark.read.schema(HISTORY).parquet(f"{self.path}/history/{history}")
        saved = self._save("live", self._keyed(new, have, live).select("pid", *new.columns))
        keyed = self.spark.read.schema(LIVE).parquet(f"{self.path}/live/{saved}")
        types = [r[0] for r in keyed.where("not deleted").select("resource_type").distinct().collect()]  # as many as there are resource types
        index = self._save("index", wide_rows(keyed, types or None).join(keyed.select("pid", "version_id"), "pid").select(*[c.split()[0] for c in INDEX.split(", ")]))
        added = {"history": history, "live": saved, "index": index}
        merged = self._merged({k: [*v, [added[k], 0]] for k, v in folders.items()})
        return Staged(number + 1, merged, keyed.select(*KEYS, "version_id", "last_updated", "deleted"))

    def _validated(self, d: DataFrame) -> None:
        from .operators.validate import validate

        found = validate(d.where("content is not null").select(F.xxhash64(*KEYS).alias("pid"), "content")).where("severity in ('fatal', 'error')").orderBy("path").limit(20).collect()
        if found:
            raise Invalid("; ".join(f"{r['path']}: {r['details']}" for r in found))

    def write(self, changes: list[Change] | DataFrame, at: int | None = None) -> DataFrame:
        """Applies all changes or none: rows (resource_type, fhir_id, version_id) written."""
        staged = self.stage(changes, at)
        self.commit(staged)
        return staged.versions.select(*KEYS, "version_id")

    # reads

    def read(self, type_: str, id_: str, none_match: str | None = None) -> dict:
        """The current document; NotModified if none_match (an etag or a number) is its version."""
        rows = newest(self._table("live").where((F.col("resource_type") == type_) & (F.col("fhir_id") == id_))).collect()
        if not rows:
            raise NotFound(f"{type_}/{id_}")
        if rows[0]["deleted"]:
            raise Deleted(f"{type_}/{id_}")
        if none_match and version_of(none_match) == str(rows[0]["version_id"]):
            raise NotModified(f"{type_}/{id_}")
        return json.loads(rows[0]["content"])

    def vread(self, type_: str, id_: str, version: str) -> dict:
        if not str(version).isdigit():
            raise NotFound(f"{type_}/{id_}/_history/{version}")
        rows = self.log().where((F.col("resource_type") == type_) & (F.col("fhir_id") == id_) & (F.col("version_id") == int(version))).limit(1).collect()
        if not rows:
            raise NotFound(f"{type_}/{id_}/_history/{version}")
        if rows[0]["deleted"]:
            raise Deleted(f"{type_}/{id_}/_history/{version}")
        return json.loads(rows[0]["content"])

    def history(self, type_: str | None = None, id_: str | None = None, since: int | None = None, count: int = 100, offset: int = 0) -> DataFrame:
        """Versions of a scope, newest first, with the verb that made them."""
        return history(self.log(), type_, id_, since, count, offset)

    # conditional interactions

    def match_all(self, queries: list[str]) -> list[str | None]:
        """The id of the only match of each query, all in one job; two rows of each are read at most."""
        for q in queries:
            if not q.partition("?")[2]:
                raise SearchError("a condition needs parameters")
        found: list[list[str]] = [[] for _ in queries]
        if queries:
            engine = self.engine()
            parts = [engine.ids(q).limit(2).withColumn("k", F.lit(k)) for k, q in enumerate(queries)]
            while len(parts) > 1:  # a balanced union keeps the plan shallow
                parts = [a.unionByName(*b) if b else a for a, *b in (parts[k : k + 2] for k in range(0, len(parts), 2))]
            for r in parts[0].collect():
                found[r["k"]].append(r["id"])
        for q, ids in zip(queries, found):
            if len(ids) > 1:
                raise MultipleMatches(q)
        return [ids[0] if ids else None for ids in found]

    def match_one(self, query: str) -> str | None:
        return self.match_all([query])[0]

    def create(self, type_: str, content: dict, condition: str | None = None) -> str:
        """The new id, or that of the resource which the condition met already."""
        found = self.match_one(f"{type_}?{condition}") if condition else None
        if found is None:
            found = content.get("id") or uuid.uuid4().hex
            self.write([Change(type_, found, json.dumps({**content, "id": found}), fresh=True)])
        return found

    def update(self, type_: str, id_: str, content: dict, expected: int | None = None) -> None:
        self.write([Change(type_, id_, json.dumps({**content, "id": id_}), expected)])

    def update_where(self, type_: str, condition: str, content: dict) -> str:
        id_ = self.match_one(f"{type_}?{condition}") or content.get("id") or uuid.uuid4().hex
        self.update(type_, id_, content)
        return id_

    def delete(self, type_: str, id_: str) -> None:
        self.write([Change(type_, id_, None)])

    def delete_where(self, type_: str, condition: str) -> None:
        found = self.match_one(f"{type_}?{condition}")
        if found is None:
            raise NotFound(f"{type_}?{condition}")
        self.delete(type_, found)

    def validate(self, type_: str, content: dict | str | None = None, id_: str | None = None, mode: str = "", profiles=()) -> dict:
        """An OperationOutcome for a document, or for the stored one of an id, against its type and profiles (profiles.Profile)."""
        from .functions.fhirpath.values import root
        from .operators.profiles import check
        from .operators.validate import Issue, Validator, outcome

        if mode not in ("", "create", "update", "profile", "delete"):
            raise SearchError(f"mode {mode} is not known")
        if mode == "delete":
            return outcome([Issue("information", "informational", "", "nothing hinders a deletion")])
        if content is None:
            if id_ is None:
                raise SearchError("there is nothing to validate")
            content = self.read(type_, id_)
        validator = Validator()
        kind = root(content, validator.registry).type
        if kind != type_:
            return outcome([Issue("error", "invalid", "", f"a {kind} was given as a {type_}")])
        return outcome([*validator.validate(content), *(i for p in profiles for i in check(content, p))])


def version_of(etag: str) -> str:
    """The version of an etag such as W/"3", or of a bare number."""
    return etag.strip().removeprefix("W/").strip('"')


def _stamp(batches):
    """meta.versionId and meta.lastUpdated go into each document."""
    from datetime import UTC, datetime

    from .functions.fhirpath.values import parse_json
    from .sources.documents import to_json

    for b in batches:
        out = []
        for content, version, micros in zip(b["content"], b["version_id"], b["last_updated"]):
            if content is None:
                out.append(None)
                continue
            doc = parse_json(content)
            stamp = datetime.fromtimestamp(micros // 1_000_000, UTC).strftime("%Y-%m-%dT%H:%M:%S") + f".{micros // 1000 % 1000:03d}Z"
            doc["meta"] = {**(doc.get("meta") or {}), "versionId": str(version), "lastUpdated": stamp}
            out.append(to_json(doc))
        yield b.assign(content=out)


def history(log: DataFrame, type_: str | None = None, id_: str | None = None, since: int | None = None, count: int = 100, offset: int = 0) -> DataFrame:
    d = log
    if type_ is not None:
        d = d.where(F.col("resource_type") == type_)
    if id_ is not None:
        d = d.where(F.col("fhir_id") == id_)
    if since is not None:
        d = d.where(F.col("last_updated") >= since)
    verb = F.when(F.col("deleted"), "DELETE").when(F.col("version_id") == 1, "POST").otherwise("PUT")
    return d.withColumn("verb", verb).orderBy(F.desc("last_updated"), F.desc("version_id"), "resource_type", "fhir_id").offset(offset).limit(count)
