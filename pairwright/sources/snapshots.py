"""Tables under a name, replaced as a whole: files that are never changed, and a small list of them that is written last.

A snapshot is a revision's list: which Parquet folders are its tables, their rows and digests.  New
tables go to folders of their own; only then does a list with the next number appear, by a rename
that fails if the number is taken.  So readers see the old revision or the new one, whatever
breaks in between, and of two writers who read the same revision one is told so.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "name string, revision long, info map<string,string>, tables map<string,struct<path:string,n_rows:long,digest:string>>"


class Conflict(Exception):
    """Someone else has written the next revision."""


@dataclass(frozen=True)
class Snapshot:
    """A revision of a name; one that nothing has been written under has revision 0 and no tables."""

    name: str
    revision: int = 0
    info: dict[str, str] = field(default_factory=dict)
    tables: dict[str, tuple[str, int, str]] = field(default_factory=dict)


def digest(df: DataFrame) -> tuple[int, str]:
    """Rows, and a sum of their hashes: the same whatever their order, found in one pass of partial sums."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    found = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("h")).first()
    return found["n"], str(found["h"] or 0)


def _published(spark: SparkSession, path: str, text: str) -> bool:
    """Whether a file of this text was made; False if there is one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, conf = hadoop.Path(path), spark._jsc.hadoopConfiguration()
    files = target.getFileSystem(conf)
    draft = hadoop.Path(target.getParent(), f".draft-{uuid.uuid4().hex}")  # readers pass over names with a dot
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(target):
        files.delete(draft, False)
        return False
    context = hadoop.FileContext.getFileContext(target.toUri(), conf)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(target), spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Exception as e:  # a Java exception
        if "FileAlreadyExists" not in str(e):
            raise
        files.delete(draft, False)
        return False
    return True


def _there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def listed(spark: SparkSession, base: str) -> DataFrame:
    """The latest revision of every name: name, revision, info and tables."""
    if not _there(spark, f"{base}/lists"):
        return spark.createDataFrame([], _ENTRY)
    entries = spark.read.schema(_ENTRY).json(f"{base}/lists/*/*.json")
    return entries.groupBy("name").agg(F.max_by(F.struct("revision", "info", "tables"), "revision").alias("e")).select("name", "e.*")


def current(spark: SparkSession, base: str, name: str) -> Snapshot:
    """The latest revision of a name, whose lists alone are read."""
    if not _there(spark, f"{base}/lists/{name}"):
        return Snapshot(name)
    row = spark.read.schema(_ENTRY).json(f"{base}/lists/{name}/*.json").orderBy(F.desc("revision")).limit(1).collect()
    return Snapshot(name, row[0].revision, dict(row[0].info or {}), {k: tuple(v) for k, v in (row[0].tables or {}).items()}) if row else Snapshot(name)


def commit(spark: SparkSession, base: str, name: str, tables: dict[str, DataFrame], *, info: dict[str, str] | None = None, after: Snapshot | None = None, keep: tuple[str, ...] | None = None) -> Snapshot:
    """Write ``tables`` and publish the revision that follows ``after`` (unless told, the latest).

    Tables of ``after`` that aren't given stay, or those in ``keep`` alone.  Raises Conflict if that
    revision was written by someone else; what was written here is then part of no list.
    """
    if not name or "/" in name or name.startswith((".", "_")):
        raise ValueError(f"no name for a snapshot: {name!r}")
    before = current(spark, base, name) if after is None else after
    kept = {k: v for k, v in before.tables.items() if keep is None or k in keep}
    for table, df in tables.items():
        path = f"{base}/tables/{name}/{table}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        kept[table] = (path, *digest(spark.read.parquet(path)))
    made = Snapshot(name, before.revision + 1, {**before.info, **(info or {})}, kept)
    entry = {"name": name, "revision": made.revision, "info": made.info, "tables": {k: dict(zip(("path", "n_rows", "digest"), v, strict=True)) for k, v in kept.items()}}
    if not _published(spark, f"{base}/lists/{name}/{made.revision:09d}.json", json.dumps(entry)):
        raise Conflict(f"revision {made.revision} of {name} was written by someone else")
    return made


def read(spark: SparkSession, snapshot: Snapshot, table: str) -> DataFrame:
    if table not in snapshot.tables:
        raise LookupError(f"{snapshot.name} has no {table}")
    return spark.read.parquet(snapshot.tables[table][0])


def modified(spark: SparkSession, snapshot: Snapshot) -> list[str]:
    """Tables that no longer are what was written: other rows, or no longer to be read."""
    found = []
    for table, (_, n_rows, was) in sorted(snapshot.tables.items()):
        try:
            same = digest(read(spark, snapshot, table)) == (n_rows, was)
        except Exception:  # files that are gone or broken
            same = False
        if not same:
            found.append(table)
    return found


def unlisted(spark: SparkSession, base: str) -> list[str]:
    """Folders of tables that no revision names: what broken or refused writers have left.  Writers must be at rest."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    root = hadoop.Path(f"{base}/tables/*/*")
    there = [str(s.getPath().toUri().getPath()) for s in root.getFileSystem(conf).globStatus(root) or ()]
    named = spark.read.schema(_ENTRY).json(f"{base}/lists/*/*.json").select(F.explode(F.map_values("tables")).alias("t")).select("t.path").distinct() if _there(spark, f"{base}/lists") else None
    kept = set() if named is None else {str(hadoop.Path(r.path).toUri().getPath()) for r in named.collect()}
    return sorted(set(there) - kept)
