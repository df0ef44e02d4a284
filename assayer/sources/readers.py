"""Where tables come from: a registry of readers, each giving a list of tables and a way to read one."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from assayer.sources.footers import FooterIndex
from assayer.vocab import SYSTEM_SCHEMAS


class UnsupportedSource(ValueError):
    pass


class TableNotFound(LookupError):
    pass


@dataclass(frozen=True, order=True)
class TableRef:
    database: str
    schema: str
    name: str

    @property
    def qualified(self) -> str:
        return f"{self.database}.{self.schema}.{self.name}"


@dataclass(frozen=True)
class Source:
    """Tables of one warehouse. Listing touches metadata only; `read` is lazy.

    `native_columns` and `primary_keys` are set where the warehouse has its own
    catalogue of them (JDBC); files have neither.
    """

    kind: str
    database: str
    tables: list[TableRef]
    reader: Callable[[TableRef], DataFrame]
    comments: dict[TableRef, str] = field(default_factory=dict)
    native_columns: DataFrame | None = None
    primary_keys: DataFrame | None = None
    row_estimates: DataFrame | None = None
    footers: FooterIndex | None = None
    schemas: Callable[[TableRef], StructType] | None = None
    # row counts that a catalogue keeps from its last ANALYZE TABLE
    statistics: dict[TableRef, int] = field(default_factory=dict)

    def row_count(self, ref: TableRef) -> int | None:
        """The exact number of rows where the source's metadata tells it without a scan."""
        return self.footers[ref.qualified].row_count if self.footers else None

    def schema(self, ref: TableRef) -> StructType:
        return self.schemas(ref) if self.schemas else self.read(ref).schema

    def listing(self) -> str | None:
        """A digest of the files behind the tables, or None for sources without files."""
        return self.footers.digest([t.qualified for t in self.tables]) if self.footers else None

    def read(self, ref: TableRef) -> DataFrame:
        if ref not in self.tables:
            raise TableNotFound(f"Table {ref.qualified} does not exist or is not a base table")
        return self.reader(ref)


def _visible(refs: list[TableRef]) -> list[TableRef]:
    return sorted((r for r in refs if r.schema not in SYSTEM_SCHEMAS), key=lambda r: (r.schema, r.name))


def parquet_source(spark: SparkSession, location: str, database: str = "files", schema: str = "public",
                   index: str | None = None) -> Source:
    """`<location>/<table>[.parquet]`, or `<location>/<schema>/<table>[.parquet]`, in any Hadoop file system.

    Schemas of a table's files of several generations are merged. `index` is a folder that keeps what footers told, so
    that another run reads those of new files only.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(location)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        raise TableNotFound(f"{location} does not exist")

    def entries(path):
        return [s for s in fs.listStatus(path) if not s.getPath().getName().startswith(("_", "."))]

    def is_table(status):
        if status.isFile():
            return status.getPath().getName().endswith(".parquet")
        inside = entries(status.getPath())
        # stray files, such as a README, make no table
        return any(s.getPath().getName().endswith(".parquet") if s.isFile() else "=" in s.getPath().getName() for s in inside)

    paths: dict[TableRef, str] = {}
    for status in entries(root):
        name = status.getPath().getName()
        if is_table(status):
            paths[TableRef(database, schema, name.removesuffix(".parquet"))] = status.getPath().toString()
        elif status.isDirectory():
            for inner in entries(status.getPath()):
                if is_table(inner):
                    ref = TableRef(database, name, inner.getPath().getName().removesuffix(".parquet"))
                    paths[ref] = inner.getPath().toString()
    footers = FooterIndex(spark, {ref.qualified: path for ref, path in paths.items()}, index)

    def read(ref: TableRef) -> DataFrame:
        return spark.read.schema(footers[ref.qualified].schema).parquet(paths[ref])

    def schema_of(ref: TableRef) -> StructType:
        # folders named key=value add columns that no footer has
        partitioned = any("=" in f.path.removeprefix(paths[ref]) for f in footers.files[ref.qualified])
        return read(ref).schema if partitioned else footers[ref.qualified].schema

    return Source("parquet", database, _visible(list(paths)), read, footers=footers, schemas=schema_of)


def catalog_source(spark: SparkSession, location: str) -> Source:
    """Base tables of every database of a Spark catalogue whose name matches `location` (a pattern)."""
    refs, comments, statistics = [], {}, {}
    catalog = spark.catalog.currentCatalog()
    for db in spark.catalog.listDatabases(location):
        for table in spark.catalog.listTables(db.name):
            if table.tableType in ("VIEW", "TEMPORARY") or table.isTemporary:
                continue
            ref = TableRef(catalog, db.name, table.name)
            refs.append(ref)
            if table.description:
                comments[ref] = table.description
            kept = spark.sql(f"describe extended `{ref.schema}`.`{ref.name}`").where("col_name = 'Statistics'").first()
            counted = re.search(r"(\d+) rows", kept["data_type"]) if kept else None
            if counted:
                statistics[ref] = int(counted[1])
    return Source(
        "catalog", catalog, _visible(refs), lambda ref: spark.table(f"`{ref.schema}`.`{ref.name}`"), comments, statistics=statistics
    )


def _jdbc_query(excluded: list[str], body: str, alias: str) -> str:
    hidden = ", ".join(f"'{s}'" for s in excluded)
    return f"{body} where {alias}.table_schema not in ({hidden})"


def jdbc_queries() -> dict[str, str]:
    """Catalogue queries, run inside the warehouse so that only metadata travels."""
    tables = _jdbc_query(
        SYSTEM_SCHEMAS,
        "select t.table_catalog as database_name, t.table_schema as schema_name, t.table_name "
        "from information_schema.tables t",
        "t",
    ) + " and t.table_type = 'BASE TABLE'"
    columns = _jdbc_query(
        SYSTEM_SCHEMAS,
        "select c.table_schema as schema_name, c.table_name, c.column_name, c.data_type as native_type, "
        "case when c.is_nullable = 'YES' then 1 else 0 end as nullable_flag, "
        "c.ordinal_position, cast(null as varchar(1)) as comment from information_schema.columns c",
        "c",
    )
    keys = _jdbc_query(
        SYSTEM_SCHEMAS,
        "select k.table_schema as schema_name, k.table_name, k.column_name, k.ordinal_position as key_position "
        "from information_schema.table_constraints n join information_schema.key_column_usage k "
        "on k.constraint_name = n.constraint_name and k.table_schema = n.table_schema "
        "and n.constraint_type = 'PRIMARY KEY'",
        "k",
    )
    return {"tables": tables, "columns": columns, "keys": keys}


# Postgres keeps comments and row statistics outside the standard catalogue.
POSTGRES_QUERIES = {
    "columns": (
        "select c.table_schema as schema_name, c.table_name, c.column_name, c.data_type as native_type, "
        "case when c.is_nullable = 'YES' then 1 else 0 end as nullable_flag, c.ordinal_position, "
        "col_description(to_regclass(quote_ident(c.table_schema) || '.' || quote_ident(c.table_name)), "
        "c.ordinal_position::int) as comment from information_schema.columns c "
        "where c.table_schema not in ('pg_catalog', 'information_schema', 'pg_toast')"
    ),
    "statistics": (
        "select n.nspname as schema_name, r.relname as table_name, "
        "case when r.reltuples < 0 then null else cast(r.reltuples as bigint) end as row_count_estimate, "
        "obj_description(r.oid) as comment from pg_class r join pg_namespace n on n.oid = r.relnamespace "
        "where r.relkind = 'r' and n.nspname not in ('pg_catalog', 'information_schema', 'pg_toast')"
    ),
}


def jdbc_source(
    spark: SparkSession,
    location: str,
    properties: dict[str, str] | None = None,
    split: dict[str, dict[str, str]] | None = None,
) -> Source:
    """Any JDBC warehouse. `split` maps `schema.table` to Spark's partitioned-read options
    (partitionColumn, lowerBound, upperBound, numPartitions); without it one task reads the table."""
    options = {"url": location, **(properties or {})}
    queries = jdbc_queries()
    postgres = location.startswith("jdbc:postgresql:")
    if postgres:
        queries = {**queries, **POSTGRES_QUERIES}

    def run(query: str) -> DataFrame:
        return spark.read.format("jdbc").options(**options).option("query", query).load()

    # the list of tables is metadata and drives one lazy reader per table
    refs = [TableRef(r[0], r[1], r[2]) for r in run(queries["tables"]).collect()]

    def read(ref: TableRef) -> DataFrame:
        extra = (split or {}).get(f"{ref.schema}.{ref.name}", {})
        table = f'"{ref.schema}"."{ref.name}"'
        return spark.read.format("jdbc").options(**options, **extra).option("dbtable", table).load()

    statistics = run(queries["statistics"]) if postgres else None
    comments = {}
    if statistics is not None:
        described = statistics.where("comment is not null").collect()
        comments = {TableRef(refs[0].database, r.schema_name, r.table_name): r.comment for r in described}
    return Source(
        "jdbc",
        refs[0].database if refs else "",
        _visible(refs),
        read,
        comments,
        run(queries["columns"]),
        run(queries["keys"]),
        statistics.select("schema_name", "table_name", "row_count_estimate") if postgres else None,
    )


READERS: dict[str, Callable[..., Source]] = {
    "parquet": parquet_source,
    "catalog": catalog_source,
    "jdbc": jdbc_source,
}


def open_source(spark: SparkSession, kind: str, location: str, **options) -> Source:
    if kind not in READERS:
        raise UnsupportedSource(f"unsupported warehouse type {kind!r}; known: {sorted(READERS)}")
    return READERS[kind](spark, location, **options)
