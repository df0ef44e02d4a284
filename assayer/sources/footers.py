"""What Parquet footers tell of a source: schemas and row counts, read in one distributed pass and kept per file.

Files are listed by the driver, as Spark itself lists them. Footers of files that the index does not know (by path, size and time of change) are
read by the tasks of one job, whatever the number of tables, and added to the index; the next run reads new files' footers
only. Schemas of one table are merged and row counts added up, so counts are exact and no data is scanned. Where a file
system or a type is unknown to the footer reader, Spark's own schema inference and a count without columns stand in.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Worker code travels with the query, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

INDEX_DDL = "path string, size bigint, changed bigint, row_count bigint, schema_json string"
SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"
FILES_A_TASK = 64


@dataclass(frozen=True, order=True)
class FileRef:
    path: str
    size: int
    changed: int  # milliseconds


def list_folder(jvm, fs, folder) -> tuple[list[FileRef], list[str]]:
    """Data files and inner folders of a folder (or the file itself), without hidden ones."""
    files, folders = [], []
    for status in fs.listStatus(folder):
        path = status.getPath().toString()
        if path.rsplit("/", 1)[-1].startswith(("_", ".")):
            continue
        if status.isDirectory():
            folders.append(path)
        elif path.endswith(".parquet"):
            files.append(FileRef(path, status.getLen(), status.getModificationTime()))
    return files, folders


def list_files(spark: SparkSession, location: str) -> list[FileRef]:
    """The Parquet files of a table, at any depth, sorted by path."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(location)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, todo = [], [location]
    while todo:
        files, folders = list_folder(jvm, fs, jvm.org.apache.hadoop.fs.Path(todo.pop()))
        out += files
        todo += folders
    return sorted(out)


# ---- footers ----

def spark_type(kind: pa.DataType) -> T.DataType:
    """The type that Spark's reader gives a Parquet column of this Arrow type."""
    is_ = pa.types
    if is_.is_dictionary(kind):
        return spark_type(kind.value_type)
    for test, result in (
        (is_.is_boolean, T.BooleanType()), (is_.is_int8, T.ByteType()), (is_.is_int16, T.ShortType()), (is_.is_uint8, T.ShortType()),
        (is_.is_int32, T.IntegerType()), (is_.is_uint16, T.IntegerType()), (is_.is_int64, T.LongType()), (is_.is_uint32, T.LongType()),
        (is_.is_uint64, T.DecimalType(20, 0)), (is_.is_float32, T.FloatType()), (is_.is_float64, T.DoubleType()), (is_.is_date32, T.DateType()),
        (is_.is_string, T.StringType()), (is_.is_large_string, T.StringType()), (is_.is_binary, T.BinaryType()),
        (is_.is_large_binary, T.BinaryType()), (is_.is_fixed_size_binary, T.BinaryType()),
    ):
        if test(kind):
            return result
    if is_.is_decimal(kind):
        return T.DecimalType(kind.precision, kind.scale)
    if is_.is_timestamp(kind) and kind.unit in ("ms", "us"):
        return T.TimestampType() if kind.tz else T.TimestampNTZType()
    if is_.is_list(kind) or is_.is_large_list(kind):
        return T.ArrayType(spark_type(kind.value_type))
    if is_.is_map(kind):
        return T.MapType(spark_type(kind.key_type), spark_type(kind.item_type))
    if is_.is_struct(kind):
        return T.StructType([T.StructField(f.name, spark_type(f.type)) for f in kind])
    raise TypeError(f"no Spark type for {kind}")


def nullable(kind: T.DataType) -> T.DataType:
    """The type with every part nullable, as files are read."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True, f.metadata) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType), True)
    return kind


def read_footer(path: str) -> tuple[int, str]:
    """Row count and Spark schema (as JSON) of one file."""
    import pyarrow.fs
    import pyarrow.parquet

    uri = re.sub("^file:/+", "file:///", path)
    system, inner = pyarrow.fs.FileSystem.from_uri(uri)
    with system.open_input_file(inner) as file:
        footer = pyarrow.parquet.read_metadata(file)
    written = (footer.metadata or {}).get(SPARK_SCHEMA)
    if written:
        schema = T.StructType.fromJson(json.loads(written))
    else:
        schema = T.StructType([T.StructField(f.name, spark_type(f.type)) for f in footer.schema.to_arrow_schema()])
    return footer.num_rows, nullable(schema).json()


def read_footers(spark: SparkSession, files: list[FileRef]) -> DataFrame:
    """INDEX_DDL of the files; row_count and schema_json are null where a footer could not be read here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, schemas = [], []
            for path in batch.column("path").to_pylist():
                try:
                    n, schema = read_footer(path)
                except (OSError, TypeError, ValueError, KeyError):  # unknown file system, type or layout: left to Spark
                    n, schema = None, None
                counts.append(n)
                schemas.append(schema)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()), pa.array(schemas, pa.string())],
                names=["path", "size", "changed", "row_count", "schema_json"])

    rows = spark.createDataFrame([(f.path, f.size, f.changed) for f in files], "path string, size bigint, changed bigint")
    return rows.repartition(max(1, -(-len(files) // FILES_A_TASK))).mapInArrow(run, INDEX_DDL)


# ---- merging ----

class SchemaConflict(ValueError):
    pass


WIDER = [(T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType)]


def merged_type(a: T.DataType, b: T.DataType, place: str) -> T.DataType:
    if a == b:
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merged_schema(a, b, place)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged_type(a.elementType, b.elementType, place))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(merged_type(a.keyType, b.keyType, place), merged_type(a.valueType, b.valueType, place))
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType) and a.scale == b.scale:
        return a if a.precision >= b.precision else b
    for order in WIDER:
        if isinstance(a, order) and isinstance(b, order):
            return max(a, b, key=lambda t: order.index(type(t)))
    raise SchemaConflict(f"{place} is {a.simpleString()} in one file and {b.simpleString()} in another")


def merged_schema(a: T.StructType, b: T.StructType, place: str) -> T.StructType:
    """All fields of both, those of the first one first; one field's types are widened where one holds the other."""
    inside = {f.name: f for f in b.fields}
    fields = [
        T.StructField(f.name, merged_type(f.dataType, inside[f.name].dataType, f"{place}.{f.name}"), True, f.metadata or inside[f.name].metadata)
        if f.name in inside else f for f in a.fields
    ]
    known = {f.name for f in a.fields}
    return T.StructType(fields + [f for f in b.fields if f.name not in known])


@dataclass(frozen=True)
class TableFooters:
    schema: T.StructType
    row_count: int | None  # None: a footer could not be read


class FooterIndex:
    """Schemas and exact row counts of tables, given as folders or files by name.

    `index` is a folder that keeps what was read; without it every new object reads every footer once.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, str], index: str | None = None):
        self.spark, self.tables, self.index = spark, tables, index
        self.files = {name: list_files(spark, path) for name, path in tables.items()}
        self._found: dict[str, TableFooters] | None = None

    def digest(self, names: list[str]) -> str:
        """Changes if and only if a file of these tables appears, goes, or is written anew."""
        lines = [[n, [(f.path, f.size, f.changed) for f in self.files[n]]] for n in sorted(names)]
        return hashlib.sha256(json.dumps(lines).encode()).hexdigest()

    def _known(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.index}/file_footers")
        exists = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
        return self.spark.read.schema(INDEX_DDL).parquet(f"{self.index}/file_footers") if exists else None

    def _load(self) -> dict[str, TableFooters]:
        listed = [(name, f) for name, files in self.files.items() for f in files]
        known = self._known() if self.index else None
        new = [f for _, f in listed]
        if known is not None:
            seen = self.spark.createDataFrame([(f.path, f.size, f.changed) for f in new], "path string, size bigint, changed bigint").join(
                known, ["path", "size", "changed"], "left_semi").collect()
            seen = {tuple(r) for r in seen}
            new = [f for f in new if (f.path, f.size, f.changed) not in seen]
        read = read_footers(self.spark, new) if new else None
        if self.index and new:
            read.write.mode("append").parquet(f"{self.index}/file_footers")
            read, known = None, self._known()
        rows = known if read is None else read if known is None else known.unionByName(read)
        owner = self.spark.createDataFrame([(n, f.path, f.size, f.changed) for n, f in listed], "name string, path string, size bigint, changed bigint")
        # a row per table and distinct schema, not per file; an index may hold a file twice after a repeated run.
        # Columns stand in the order in which the files came.
        facts = owner.join(rows.dropDuplicates(["path", "size", "changed"]), ["path", "size", "changed"]) if rows is not None else None
        grouped = [] if facts is None else facts.groupBy("name", "schema_json").agg(
            F.sum("row_count").alias("n"), F.min(F.struct("changed", "path")).alias("first")).orderBy("name", "first").collect()
        found: dict[str, TableFooters] = {}
        for name, path in self.tables.items():
            mine = [r for r in grouped if r.name == name]
            if not mine or any(r.schema_json is None for r in mine):
                found[name] = TableFooters(self.spark.read.option("mergeSchema", "true").parquet(path).schema, None)
                continue
            schema = T.StructType.fromJson(json.loads(mine[0].schema_json))
            for other in mine[1:]:
                schema = merged_schema(schema, T.StructType.fromJson(json.loads(other.schema_json)), name)
            found[name] = TableFooters(schema, sum(r.n for r in mine))
        return found

    def __getitem__(self, name: str) -> TableFooters:
        if self._found is None:
            self._found = self._load()
        return self._found[name]
