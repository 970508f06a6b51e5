"""Immutable snapshots, on any file system that Spark writes to.

A write goes to new folders, one for each bucket of keys that changes; then a numbered manifest
that lists the folders is published by one rename. A failed write publishes none, so the readers
stay where they were."""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.lineage import cut

LOG, BUCKETS = "manifests", 64
#: Columns that rows are looked up by, beside the key.
LOOKUPS = ("doi", "filename", "item_id")
#: What a snapshot is marked with and its successors inherit.
MARKS = ("encoder",)
#: Columns whose distinct values are estimated, beside the key.
SKETCHED = ("paper_id", *LOOKUPS)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file by writing another one and renaming it."""
    jvm = spark._jvm
    target, fs = _path(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(part), fs.makeQualified(target), options)


def read_text(spark: SparkSession, path: str) -> str | None:
    target, fs = _path(spark, path)
    if not fs.exists(target):
        return None
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""


class Conflict(RuntimeError):
    """Another writer published since the state was read."""


def _numbers(spark: SparkSession, root: str) -> list[int]:
    folder, fs = _path(spark, f"{root}/{LOG}")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]


def manifest(spark: SparkSession, root: str) -> dict:
    """The state that readers see: number, generation, key, schema and the folder of each bucket.
    Its file names the generation; number 0 is the state before the first."""
    number = max(_numbers(spark, root), default=0)
    if not number:
        return {"number": 0, "generation": "0", "parts": {}}
    return json.loads(read_text(spark, f"{root}/{LOG}/{number:012}.json") or "{}") | {"number": number}


def generation(spark: SparkSession, root: str) -> str:
    """Name of the current snapshot, '0' before the first."""
    return manifest(spark, root)["generation"]


def _commit(spark: SparkSession, root: str, base: dict, state: dict) -> str:
    """Publish the successor of base. Its file is made by a rename that fails if the file is
    there, so of two writers with one base only one gets through."""
    jvm = spark._jvm
    target, fs = _path(spark, f"{root}/{LOG}/{base['number'] + 1:012}.json")
    part = jvm.org.apache.hadoop.fs.Path(f"{root}/{LOG}/part-{uuid.uuid4().hex}")
    out = fs.create(part, True)
    try:
        out.write(bytearray(json.dumps(state).encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(part), fs.makeQualified(target), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        fs.delete(part, False)
        if fs.exists(target):
            raise Conflict(f"{root} has changed since {base['generation']}") from e
        raise
    return state["generation"]


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _write(df: DataFrame, root: str, key: str) -> tuple[str, dict[str, str]]:
    """Write df in folders by a hash of the key; their places by bucket."""
    spark, name = df.sparkSession, f"{time.time_ns()}-{uuid.uuid4().hex[:8]}"
    placed = df.withColumn("_bucket", _bucket(key))
    writer = placed.repartition("_bucket", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(16))).sortWithinPartitions("_bucket", key).write.partitionBy("_bucket")
    # a scan by one of these passes over row groups whose Bloom filter has no such value
    for column in LOOKUPS:
        if column in df.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(f"{root}/{name}")
    folder, fs = _path(spark, f"{root}/{name}")
    found = [s.getPath().getName() for s in fs.listStatus(folder)]
    parts = {n.removeprefix("_bucket="): f"{name}/{n}" for n in found if n.startswith("_bucket=")}
    if parts:
        _summarize(spark, f"{root}/{name}", placed.schema, key)
    return name, parts


def _summarize(spark: SparkSession, folder: str, schema: StructType, key: str) -> None:
    """Write, beside the buckets of a folder, the rows of each and sketches of their values; of
    the buckets only these columns are read."""
    columns = [c for c in dict.fromkeys((key, *SKETCHED)) if c in schema.names]
    rows = spark.read.schema(schema).parquet(folder)
    sketches = (F.hll_sketch_agg(F.col(c).cast("string"), F.lit(12)).alias(c) for c in columns)
    rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("rows"), *sketches).coalesce(1).write.parquet(f"{folder}/_stats")


def statistics(spark: SparkSession, root: str, state: dict) -> DataFrame:
    """One row: rows, counted, and for the key and each of SKETCHED that there is the estimated
    number of distinct values. Only what was written beside the buckets is read."""
    schema = StructType.fromJson(state["schema"])
    columns = [c for c in dict.fromkeys((state["key"], *SKETCHED)) if c in schema.names]
    fields = "_bucket int, rows long, " + ", ".join(f"`{c}` binary" for c in columns)
    merged = [F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c) for c in columns)]
    if not state["parts"]:
        return spark.createDataFrame([], fields).agg(*merged)
    folders = sorted({p.split("/")[0] for p in state["parts"].values()})
    live = F.array(*(F.lit(p.replace("/_bucket=", "/")) for p in state["parts"].values()))
    found = spark.read.schema(fields).parquet(*(f"{root}/{f}/_stats" for f in folders))
    place = F.concat(F.regexp_extract(F.input_file_name(), "([^/]+)/_stats/[^/]+$", 1), F.lit("/"), F.col("_bucket"))
    return found.withColumn("_place", place).filter(F.array_contains(live, F.col("_place"))).agg(*merged)


def _state(base: dict, df: DataFrame, name: str, key: str, parts: dict[str, str], **marks: str) -> dict:
    return {m: base[m] for m in MARKS if m in base} | marks | {"generation": name, "key": key, "schema": df.schema.jsonValue(), "parts": parts}


def publish(df: DataFrame, root: str, key: str | None = None, base: dict | None = None, **marks: str) -> str:
    """Make df the whole content. With base, the manifest that df was made from, another writer's
    publication since then is a Conflict. marks are those of MARKS that change."""
    spark = df.sparkSession
    base = base or manifest(spark, root)
    key = key or base.get("key") or df.columns[0]
    name, parts = _write(df, root, key)
    return _commit(spark, root, base, _state(base, df, name, key, parts, **marks))


def read(spark: SparkSession, root: str, state: dict, buckets: list[int] | None = None) -> DataFrame | None:
    """The rows of a manifest, or of some of its buckets."""
    if not state["number"]:
        return None
    schema = StructType.fromJson(state["schema"])
    paths = [f"{root}/{p}" for b, p in state["parts"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def of_keys(spark: SparkSession, root: str, state: dict, keys: DataFrame) -> DataFrame:
    """The rows of some keys, from the buckets that hold them."""
    key = state["key"]
    touched = [r[0] for r in keys.select(_bucket(key).alias("b")).distinct().collect()]
    return read(spark, root, state, touched).join(keys.select(key), key, "left_semi")


def of_value(spark: SparkSession, root: str, state: dict, column: str, value: object) -> DataFrame:
    """The rows where a column equals a value: of the key, its bucket is read alone; of others,
    the row groups whose statistics and Bloom filters allow it."""
    rows = read(spark, root, state)
    wanted = F.lit(value).cast(rows.schema[column].dataType)
    if column == state["key"] and value is not None:
        bucket = spark.range(1).select(F.pmod(F.xxhash64(wanted), F.lit(BUCKETS)).cast("int")).first()[0]
        rows = read(spark, root, state, [bucket])
    return rows.filter(F.col(column) == wanted)


def last(spark: SparkSession, root: str, n: int) -> list[dict]:
    """The last n states that were published."""
    return [json.loads(read_text(spark, f"{root}/{LOG}/{i:012}.json") or "{}") | {"number": i} for i in sorted(_numbers(spark, root))[-n:]]


def vacuum(spark: SparkSession, root: str, states: list[dict]) -> int:
    """Delete the folders of rows that none of the states has, but for those written since the
    last of them; their number."""
    used = {p.split("/")[0] for s in states for p in s["parts"].values()}
    folder, fs = _path(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
    # a folder begins with the time of its writing
    newest = max((int(s["generation"].split("-")[0]) for s in states), default=0)
    old = [n for n in names if re.fullmatch(r"\d+-[0-9a-f]{8}", n) and n not in used and int(n.split("-")[0]) < newest]
    for n in old:
        fs.delete(_path(spark, f"{root}/{n}")[0], True)
    return len(old)


def current(spark: SparkSession, root: str) -> DataFrame | None:
    return read(spark, root, manifest(spark, root))


def update(new: DataFrame, gone: DataFrame, root: str, base: dict) -> str:
    """Replace all rows of the keys in new by new's and drop those of the keys in gone(key). Only
    the buckets that hold such keys are read and written; the others stay where they are."""
    spark, key = new.sparkSession, base["key"]
    new, gone = cut(new), cut(gone.select(key).distinct())
    touched = [r[0] for r in new.select(key).unionByName(gone).select(_bucket(key).alias("b")).distinct().collect()]
    old = read(spark, root, base, touched)
    rows = replaced(old.join(gone, key, "left_anti").select(*old.columns), new, key)
    name, parts = _write(rows, root, key)
    kept = {b: p for b, p in base["parts"].items() if int(b) not in touched}
    return _commit(spark, root, base, _state(base, rows, name, key, kept | parts))


def replaced(old: DataFrame, new: DataFrame, key: str = "paper_id") -> DataFrame:
    """old with all rows of the keys in new replaced by new's."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def without(old: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """old without the deleted keys; a null deletion date deletes nothing."""
    gone = deleted.filter("dateDeleted is not null") if "dateDeleted" in deleted.columns else deleted
    return old.join(gone.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def removed_papers(old: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """(key, papers): distinct papers that each deletion removes."""
    gone = deleted.filter("dateDeleted is not null").select(key).distinct()
    return old.join(gone, key).groupBy(key).agg(F.count_distinct("paper_id").alias("papers"))


# The state before the first sync.
EMPTY_STATE = {"last_item_id": 0, "last_version": 0, "pending": "", "last_sync_time": ""}


def load_state(spark: SparkSession, root: str) -> dict:
    """The sync state; defaults where it is missing or damaged."""
    try:
        found = json.loads(read_text(spark, f"{root}/STATE") or "{}")
        return EMPTY_STATE | {k: found[k] for k in EMPTY_STATE if k in found}
    except ValueError:
        return dict(EMPTY_STATE)


def save_state(spark: SparkSession, root: str, state: dict) -> None:
    write_text(spark, f"{root}/STATE", json.dumps(EMPTY_STATE | state))
