"""Rewrites Parquet files whose schema has drifted, by field ids.

The evolved schema gives each field an id; files of older versions keep the
ids but have other names, orders and types, or lack fields.  Spark's own reader
matches by id and reads all files under the evolved schema; a null of it may be
a null of the file or a field that the file lacks, which a map of the files'
footers tells apart.  `_metadata.row_index` restores the order of rows in a
file, and one task writes each file, as a stream.

A rewritten file takes the place of the old one by an atomic rename.  What a
run that ended halfway has done stays valid, and the next run leaves it alone,
for a file is rewritten only if its footer is not that of the evolved schema.
Files are written by Spark's committer into a folder beside, so a lost task or
executor leaves nothing in the table.

Rows never meet in one task by the thousands of files: a file's rows are dealt
by the file's name, files have the sizes they had.  The driver has the names of
files, as it has them to list a folder, and no row.

Defined results: a field that a file lacks gets its default, null if it has
none; nulls stay nulls; a field of no known id is dropped; a float read as
double, and an int read as long, keep their values; repeated rows are kept, a
tie of the order of ranks is broken by all other fields; null ids sort first;
an empty table gives no files and no rows; columns beside the schema's are left
out, whatever their names.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import urllib.parse
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, types
from pyspark.sql import functions as F

from . import common

FIELD_ID = "parquet.field.id"
#: Bytes of input in a partition of a range shuffle.
PART = 64 << 20


def with_ids(fields: list[tuple[str, types.DataType]], first: int = 1) -> types.StructType:
    """A nullable schema whose fields have the ids first, first + 1, ..."""
    return types.StructType([types.StructField(name, kind, True, {FIELD_ID: i}) for i, (name, kind) in enumerate(fields, first)])


@contextlib.contextmanager
def by_field_id(spark: SparkSession) -> Iterator[None]:
    """Within, Parquet is read and written by field ids."""
    wanted = {"spark.sql.parquet.fieldId.read.enabled": "true", "spark.sql.parquet.fieldId.read.ignoreMissing": "true", "spark.sql.parquet.fieldId.write.enabled": "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def ranked(df: DataFrame, *order: Column) -> tuple[DataFrame, int]:
    """df with `rank`, from 0, in a global order; and its number of rows.

    A range shuffle sorts over many tasks, and rows are numbered as zipWithIndex
    does: by a count for each task and the place within it.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(max(common.parts_for(df, PART), int(spark.conf.get("spark.sql.shuffle.partitions"))), *order)
    done = common.stored(ranged.sortWithinPartitions(*order).select(F.struct(*df.columns).alias("r"), F.monotonically_increasing_id().alias("mark")), "ranked")
    part = F.shiftright("mark", 33)
    sizes = dict(done.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each task
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    starts = F.broadcast(spark.createDataFrame(before, "p long, before long"))
    rank = F.col("before") + F.col("mark").bitwiseAND(F.lit((1 << 33) - 1))
    return done.join(starts, part == F.col("p")).select("r.*", rank.alias("rank")), total


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _moved(spark: SparkSession, staged: str, folder: str, name) -> None:
    """Moves the one file of each `file=<key>` below `staged` to folder/name(key), over what is there."""
    fs, root = _fs(spark, staged)
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(folder))
    for entry in fs.listStatus(root):
        if "=" not in entry.getPath().getName():
            continue
        files = [f.getPath() for f in fs.listStatus(entry.getPath())]
        if len(files) != 1:
            raise ValueError(f"{entry.getPath()} holds {len(files)} files")
        context.rename(files[0], jvm.org.apache.hadoop.fs.Path(folder, name(urllib.parse.unquote(entry.getPath().getName().split("=", 1)[1]))), options)
    fs.delete(root, True)


def write_files(df: DataFrame, file: str, at: str, schema: types.StructType, staged: str) -> None:
    """Writes the rows of each value of `file`, in the order of `at`, as one Parquet file of that schema below staged/file=<value>.

    Files are dealt to tasks by their name; the sort within a task spills, and
    the writer is a stream.
    """
    spark = df.sparkSession
    fields = [F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema.fields]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(n, file).sortWithinPartitions(file, at).select(F.col(file).alias("file"), *fields)
    rows.write.option("maxRecordsPerFile", 0).partitionBy("file").parquet(staged)


def footers(spark: SparkSession, folder: str) -> DataFrame:
    """path, names, ids (null if a field has none) and kinds of the columns of each file, from footers read in the tasks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path", F.col("length").alias("size"))

    def run(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs

        schema = pa.schema([("path", pa.string()), ("names", pa.list_(pa.string())), ("ids", pa.list_(pa.int32())), ("kinds", pa.list_(pa.string())), ("n_rows", pa.int64())])
        for b in batches:
            out = []
            for path in b.column("path").to_pylist():
                store, where = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
                with store.open_input_file(where) as f:
                    meta = pq.read_metadata(f)
                fields = meta.schema.to_arrow_schema()
                ids = [int(i) if (i := (f.metadata or {}).get(b"PARQUET:field_id")) is not None else None for f in fields]
                out.append((path, fields.names, ids, [str(f.type) for f in fields], meta.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)

    return files.mapInArrow(run, "path string, names array<string>, ids array<int>, kinds array<string>, n_rows long")


def footer_map(spark: SparkSession, folder: str, schema: types.StructType) -> DataFrame:
    """footers() with `missing`, the ids that a file lacks, and `drifted`, whether its columns are not those of the schema.  Stored: a row for each file."""
    from pyspark.sql.pandas.types import to_arrow_type

    ids = [f.metadata[FIELD_ID] for f in schema.fields]
    kinds = [str(to_arrow_type(f.dataType)) for f in schema.fields]
    own = F.coalesce("ids", F.array().cast("array<int>"))
    same = (F.col("names") == F.lit([f.name for f in schema.fields])) & (own == F.lit(ids)) & (F.col("kinds") == F.lit(kinds))
    missing = F.filter(F.lit(ids), lambda i: ~F.exists(own, lambda o: F.coalesce(o == i, F.lit(False))))
    return common.stored(footers(spark, folder).select("*", missing.alias("missing"), (~F.coalesce(same, F.lit(False))).alias("drifted")), "footers")


def scan(spark: SparkSession, paths: str | list[str], schema: types.StructType, names: tuple[str | None, ...] | None = None) -> DataFrame:
    """Rows under the schema, matched by field id (run within by_field_id), with `file_path` and `row_index`.

    names: what the files call the fields, None for those that they lack.
    """
    called = schema.names if names is None else [n or f"_lacks{i}" for i, n in enumerate(names)]
    under = types.StructType([types.StructField(n, f.dataType, True, f.metadata) for n, f in zip(called, schema.fields, strict=True)])
    rows = spark.read.schema(under).parquet(*([paths] if isinstance(paths, str) else paths))
    own = F.struct(*[F.col(n).alias(f.name) for n, f in zip(called, schema.fields, strict=True)])
    return rows.select(own.alias("r"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))


def _clashing(schema: types.StructType) -> tuple[Column, Column]:
    """Of a footer: whether a field has the name of another field of the schema with another type; and its names of the schema's fields.

    The reader takes a field's type by its name even where it finds it by its
    id, so such files are read under their own names.
    """
    kind_of_id = F.create_map(*[x for f in schema.fields for x in (F.lit(f.metadata[FIELD_ID]), F.lit(f.dataType.simpleString()))])
    kind_of_name = F.create_map(*[x for f in schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    each = F.arrays_zip("names", F.col("ids"))
    clash = F.exists(each, lambda x: F.coalesce(F.try_element_at(kind_of_id, x["ids"]) != F.try_element_at(kind_of_name, x["names"]), F.lit(False)))
    names = F.array(*[F.try_element_at(F.transform(F.filter(each, lambda x, i=f.metadata[FIELD_ID]: x["ids"] == i), lambda x: x["names"]), F.lit(1)) for f in schema.fields])
    return clash, names


def rewrite(spark: SparkSession, folder: str, schema: types.StructType, defaults: dict[str, object]) -> DataFrame:
    """Rewrites the drifted files of a folder in place; returns the footer map of before."""
    found = footer_map(spark, folder, schema)
    clash, own = _clashing(schema)
    drifted: dict[tuple | None, list[str]] = {}
    for r in found.where("drifted and n_rows > 0").select("path", F.when(clash, own).alias("own")).collect():  # names, as a listing of the folder has them
        drifted.setdefault(r["own"] and tuple(r["own"]), []).append(r["path"])
    if not drifted:
        return found
    staged = common.new_path(spark, "rewritten")
    with by_field_id(spark):
        name = F.element_at(F.split("file_path", "/"), -1)
        lacks = common.near(common.stored(found.where("drifted").select(F.element_at(F.split("path", "/"), -1).alias("file"), F.transform("missing", lambda i: i.cast("string")).alias("missing")), "lacks"))
        rows = functools.reduce(DataFrame.union, [scan(spark, paths, schema, names) for names, paths in drifted.items()]).withColumn("name", name).join(lacks, F.col("name") == F.col("file"))
        filled = [F.when(F.array_contains("missing", str(f.metadata[FIELD_ID])), F.lit(defaults.get(f.name)).cast(f.dataType)).otherwise(F.col(f"r.{f.name}")).alias(f.name) for f in schema.fields]
        write_files(rows.select(F.col("name").alias("_file"), F.col("row_index").alias("_at"), *filled), "_file", "_at", schema, staged)
    _moved(spark, staged, folder, lambda key: key)
    return found


def digests(spark: SparkSession, folder: str, schema: types.StructType, line: Column, key: Column) -> DataFrame:
    """path, n_rows, n_nulls, keys_sha256 (`key` of each row, joined by commas) and rows_sha256 (`line` of each row, by line ends).

    One task hashes a file's rows as they come, in their order; it holds none.
    """
    rows = scan(spark, folder, schema)
    nulls = sum((F.col(f"r.{f.name}").isNull().cast("long") for f in schema.fields), F.lit(0))
    each = rows.select("file_path", "row_index", nulls.alias("nulls"), key.alias("key"), line.alias("line"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = each.repartition(n, "file_path").sortWithinPartitions("file_path", "row_index").select("file_path", "nulls", "key", "line")

    def run(batches):
        schema = pa.schema([("path", pa.string()), ("n_rows", pa.int64()), ("n_nulls", pa.int64()), ("keys_sha256", pa.string()), ("rows_sha256", pa.string())])

        def told(now):
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now[:3], now[3].hexdigest(), now[4].hexdigest())], schema=schema)

        now = None
        for b in batches:
            paths = b.column("file_path").to_pylist()
            for path, n, k, text in zip(paths, b.column("nulls").to_pylist(), b.column("key").to_pylist(), b.column("line").to_pylist(), strict=True):
                if now is None or now[0] != path:
                    if now:
                        yield told(now)
                    now = [path, 0, 0, hashlib.sha256(), hashlib.sha256()]
                for h, x, between in ((now[3], k, b","), (now[4], text, b"\n")):
                    if now[1]:
                        h.update(between)
                    h.update(x.encode())
                now[1] += 1
                now[2] += n
        if now:
            yield told(now)

    return ordered.mapInArrow(run, "path string, n_rows long, n_nulls long, keys_sha256 string, rows_sha256 string")


# ---- files that drift by the bits of a version


def drifted_schema(schema: types.StructType, version: int, swap: tuple[str, str], lacking: tuple[str, ...], narrow: dict[str, types.DataType]) -> tuple[types.StructType, dict[str, str]]:
    """The schema of a version, and which evolved field each of its names holds.

    Bits: 1, two fields swap their names; 2, the fields after the first stand
    in reverse; 4, some fields are missing; 8, some have narrower types.
    """
    other = {swap[0]: swap[1], swap[1]: swap[0]} if version & 1 else {}
    fields = [f for f in schema.fields if not (version & 4 and f.name in lacking)]
    if version & 2:
        fields = fields[:1] + fields[:0:-1]
    own = [types.StructField(other.get(f.name, f.name), narrow.get(f.name, f.dataType) if version & 8 else f.dataType, True, f.metadata) for f in fields]
    return types.StructType(own), {o.name: f.name for o, f in zip(own, fields, strict=True)}


def write_drifted(rows: DataFrame, folder: str, schema: types.StructType, version: str, name, **drift) -> None:
    """rows(schema's fields, file_no, rank and a version below 16) as one file each file_no, of its version's schema, in the order of rank; name(file_no) names it."""
    spark = rows.sparkSession
    table = common.new_path(spark, "versions")
    rows.select(*schema.names, "file_no", "rank", F.col(version).alias("_version")).write.partitionBy("_version").parquet(table)  # each version then reads its own rows only
    kinds = types.StructType([types.StructField(f.name, f.dataType) for f in schema.fields]).add("file_no", "long").add("rank", "long").add("_version", "integer")
    fs, p = _fs(spark, table)
    fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    there = sorted(int(e.getPath().getName().split("=")[1]) for e in fs.listStatus(p) if "=" in e.getPath().getName())

    def write(v: int) -> None:
        own, holds = drifted_schema(schema, v, **drift)
        some = spark.read.schema(kinds).parquet(table).where(F.col("_version") == v)
        some = some.select(F.col("file_no").alias("_file"), F.col("rank").alias("_at"), *[F.col(holds[f.name]).alias(f.name) for f in own.fields])
        staged = common.new_path(spark, f"version{v}")
        write_files(some, "_file", "_at", own, staged)
        _moved(spark, staged, folder, name)

    with by_field_id(spark), ThreadPoolExecutor(4) as pool:  # a job for each version, some at a time
        list(pool.map(write, there))
    fs.delete(p, True)


def version_of(file_no: Column) -> Column:
    """crc32 of `42:` and the number, modulo 24; above 15 it is 0."""
    v = F.crc32(F.concat(F.lit("42:"), file_no.cast("string")).cast("binary")) % 24
    return F.when(v > 15, 0).otherwise(v).cast("int")
