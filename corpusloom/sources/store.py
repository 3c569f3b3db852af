"""Tables by document that can be written again and again, and from which documents can be deleted.

A store is a folder of Parquet tables. Rows lie in hash buckets of their document, sorted by document. Every write adds
folders of its own and ends with a commit, a small row that names the folders each bucket of each table is made of.
Readers follow the latest commit, so a run that died half-way is invisible, all tables change at once, and a reader keeps
the version it began with. Only buckets that hold rows of a replaced or deleted document are rewritten; new documents are
added beside what is there.

One writer at a time: a second one fails when it commits. Numbers of buckets reach the driver, never documents.
"""

from __future__ import annotations

import json
import uuid
from typing import Any, NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

BUCKETS = 64
KEY = "document_id"
COMMITS = "commit_log"

# Folders of each bucket, as {table: {bucket: [folder]}}.
Parts = dict[str, dict[str, list[str]]]


class Commit(NamedTuple):
    """What a store holds: the number of the commit, of buckets, and per table its schema and folders.

    `note` is the writer's own, for instance how far a stream has come; it changes with the tables, or not at all.
    """

    number: int
    buckets: int
    schemas: dict[str, Any]
    parts: Parts
    note: dict[str, Any] = {}


def bucket(document_id: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(document_id), F.lit(buckets)).cast("int")


def latest(spark: SparkSession, path: str) -> Commit | None:
    """The commit that readers follow; none if nothing was ever committed."""
    try:
        commits = spark.read.schema("content string, number long").parquet(f"{path}/{COMMITS}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    last = commits.agg(F.max("number")).first()[0]
    if last is None:
        return None
    return Commit(last, **json.loads(commits.where(F.col("number") == last).first()["content"]))


def _commit(spark: SparkSession, path: str, commit: Commit) -> None:
    content = json.dumps({k: v for k, v in commit._asdict().items() if k != "number"})
    row = spark.createDataFrame([(content,)], "content string").coalesce(1)
    try:
        row.write.mode("errorifexists").parquet(f"{path}/{COMMITS}/number={commit.number}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        message = f"{path}: commit {commit.number} is there already, by another writer or by one that died; nothing was changed"
        raise RuntimeError(message) from error


def _folders(path: str, name: str, buckets: dict[str, list[str]]) -> list[str]:
    return [f"{path}/{name}/{part}/bucket={b}" for b, parts in sorted(buckets.items(), key=lambda x: int(x[0])) for part in parts]


def _read(spark: SparkSession, path: str, commit: Commit, name: str, only: set[str] | None = None) -> DataFrame:
    """Rows of a table with their `bucket`, of some buckets if `only` is given."""
    schema = StructType.fromJson(commit.schemas[name])
    held = commit.parts.get(name, {})
    folders = _folders(path, name, held if only is None else {b: p for b, p in held.items() if b in only})
    if not folders:
        return spark.createDataFrame([], schema.add("bucket", IntegerType()))
    whole = schema.add("part", StringType()).add("bucket", IntegerType())
    return spark.read.schema(whole).option("basePath", f"{path}/{name}").parquet(*folders).drop("part")


def _write_part(rows: DataFrame, path: str, name: str, buckets: int, schema: StructType) -> dict[str, list[str]]:
    """Write rows as one part; returns the folders by bucket."""
    part = f"part=p{uuid.uuid4().hex}"
    placed = rows.withColumn("bucket", bucket(KEY, buckets)).hint("rebalance", "bucket")
    placed.sortWithinPartitions("bucket", KEY).write.partitionBy("bucket").parquet(f"{path}/{name}/{part}")
    back = rows.sparkSession.read.schema(StructType(list(schema.fields)).add("bucket", IntegerType())).parquet(f"{path}/{name}/{part}")
    return {str(r["bucket"]): [part] for r in back.select("bucket").distinct().collect()}


def _without(spark: SparkSession, path: str, commit: Commit, name: str, ids: DataFrame) -> dict[str, list[str]]:
    """Folders of a table once the rows of `ids` are gone: buckets that hold none stay as they are."""
    held = commit.parts.get(name, {})
    if not held:
        return {}
    old = _read(spark, path, commit, name)
    # Both sides hold one column; a document's rows count once.
    hit = old.select(KEY, "bucket").distinct().join(ids, KEY, "left_semi").select("bucket").distinct()
    touched = {str(r["bucket"]) for r in hit.collect()}
    if not touched:
        return held
    rest = _read(spark, path, commit, name, touched).drop("bucket").join(ids, KEY, "left_anti")
    fresh = _write_part(rest, path, name, commit.buckets, StructType.fromJson(commit.schemas[name]))
    return {b: p for b, p in held.items() if b not in touched} | fresh


def _start(spark: SparkSession, path: str, tables: dict[str, DataFrame], buckets: int | None) -> Commit:
    now = latest(spark, path)
    if now is None:
        now = Commit(0, BUCKETS if buckets is None else buckets, {}, {})
    elif buckets is not None and buckets != now.buckets:
        raise ValueError(f"{path} has {now.buckets} buckets, not {buckets}")
    for name, df in tables.items():
        if KEY not in df.columns or name == COMMITS or {"part", "bucket"} & set(df.columns):
            raise ValueError(f"table {name} needs {KEY}, another name than {COMMITS}, and no columns part or bucket")
        kept = StructType.fromJson(now.schemas[name]).simpleString() if name in now.schemas else df.schema.simpleString()
        if df.schema.simpleString() != kept:
            raise ValueError(f"table {name} is stored as {kept}, not {df.schema.simpleString()}")
    return now._replace(schemas={**{n: json.loads(df.schema.json()) for n, df in tables.items()}, **now.schemas})


def _joined(*parts: dict[str, list[str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for part in parts:
        for b, folders in part.items():
            out[b] = out.get(b, []) + folders
    return out


def append(path: str, buckets: int | None = None, note: dict[str, Any] | None = None, **tables: DataFrame) -> Commit:
    """Add rows to tables; what is there stays. For tables of events."""
    spark = next(iter(tables.values())).sparkSession
    now = _start(spark, path, tables, buckets)
    parts = dict(now.parts)
    for name, df in tables.items():
        parts[name] = _joined(parts.get(name, {}), _write_part(df, path, name, now.buckets, df.schema))
    done = now._replace(number=now.number + 1, parts=parts, note=now.note if note is None else note)
    _commit(spark, path, done)
    return done


def replace(
    path: str,
    ids: DataFrame | None = None,
    buckets: int | None = None,
    note: dict[str, Any] | None = None,
    **tables: DataFrame,
) -> Commit:
    """Put the given rows in the place of all rows that their documents had in these tables.

    `ids(document_id)` names the documents; by default they are those of the given rows. A document that is named and has
    no new rows in a table loses its old ones there.
    """
    spark = next(iter(tables.values())).sparkSession
    now = _start(spark, path, tables, buckets)
    fresh = {name: _write_part(df, path, name, now.buckets, df.schema) for name, df in tables.items()}
    if ids is None:
        # from what was just written, so that nothing is computed twice
        ids = _union([_read(spark, path, now._replace(parts=fresh), name).select(KEY) for name in tables])
    ids = ids.select(KEY).distinct()
    parts = dict(now.parts)
    for name in tables:
        parts[name] = _joined(_without(spark, path, now, name, ids), fresh[name])
    done = now._replace(number=now.number + 1, parts=parts, note=now.note if note is None else note)
    _commit(spark, path, done)
    return done


def delete(spark: SparkSession, path: str, ids: DataFrame) -> Commit | None:
    """Remove documents from all tables of the store."""
    now = latest(spark, path)
    if now is None:
        return None
    ids = ids.select(KEY).distinct()
    parts = {name: _without(spark, path, now, name, ids) for name in now.parts}
    done = now._replace(number=now.number + 1, parts=parts)
    _commit(spark, path, done)
    return done


def compact(spark: SparkSession, path: str, most: int = 8) -> Commit | None:
    """Rewrite buckets made of more than `most` folders as one."""
    now = latest(spark, path)
    if now is None:
        return None
    parts = {}
    for name, held in now.parts.items():
        many = {b for b, folders in held.items() if len(folders) > most}
        parts[name] = held
        if many:
            rows = _read(spark, path, now, name, many).drop("bucket")
            fresh = _write_part(rows, path, name, now.buckets, StructType.fromJson(now.schemas[name]))
            parts[name] = {b: p for b, p in held.items() if b not in many} | fresh
    done = now._replace(number=now.number + 1, parts=parts)
    _commit(spark, path, done)
    return done


def read(spark: SparkSession, path: str, name: str, document_id: str | None = None) -> DataFrame:
    """A table as of the latest commit; with a document, only its bucket is opened."""
    now = latest(spark, path)
    if now is None or name not in now.schemas:
        raise ValueError(f"no table {name} in {path}")
    if document_id is None:
        return _read(spark, path, now, name).drop("bucket")
    place = spark.range(1).select(bucket(F.lit(document_id), now.buckets)).first()[0]
    return _read(spark, path, now, name, {str(place)}).where(F.col(KEY) == document_id).drop("bucket")


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete folders and commits that the latest commit does not need; returns how many folders went.

    Deleted documents are only gone from the disk after this. Readers of older commits must be done.
    """
    now = latest(spark, path)
    if now is None:
        return 0
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    wanted = {folder for name, held in now.parts.items() for folder in _folders(path, name, held)}
    parts = {folder.rsplit("/", 1)[0] for folder in wanted}
    gone = 0
    for table in fs.listStatus(root):
        name = table.getPath().getName()
        for part in fs.listStatus(table.getPath()) if table.isDirectory() else []:
            at = f"{path}/{name}/{part.getPath().getName()}"
            if name == COMMITS:
                if part.getPath().getName() != f"number={now.number}":
                    fs.delete(part.getPath(), True)
            elif at not in parts:
                gone += fs.delete(part.getPath(), True)
            else:
                for held in fs.listStatus(part.getPath()):
                    if held.isDirectory() and f"{at}/{held.getPath().getName()}" not in wanted:
                        gone += fs.delete(held.getPath(), True)
    return gone


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
