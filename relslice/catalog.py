"""The catalog: tables, columns, keys and foreign keys, and the data behind them.

The catalog is declared by the user or read off DataFrames; it never comes from scanning data. Its three frames
(tables, columns, foreign keys) make selection ordinary set algebra.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def qualify(schema: str, name: str) -> str:
    """schema.name, with parts that hold dots or quotes in double quotes."""

    def part(s: str) -> str:
        return '"' + s.replace('"', '""') + '"' if "." in s or '"' in s else s

    return f"{part(schema)}.{part(name)}"


@dataclass(frozen=True)
class ColumnDef:
    """One column; ``type`` is a PostgreSQL type name, ``generated`` a Spark SQL expression, ``identity`` ALWAYS or BY DEFAULT."""

    name: str
    type: str
    nullable: bool = True
    primary_key: bool = False
    generated: str | None = None
    identity: str | None = None


@dataclass(frozen=True)
class FkDef:
    """A foreign key with its columns in order; ``parent`` is a qualified table name."""

    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    name: str = ""


@dataclass(frozen=True)
class UniqueDef:
    """A candidate key; partial and expression indexes are not ``eligible``."""

    name: str
    columns: tuple[str, ...]
    eligible: bool = True


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[ColumnDef, ...]
    schema: str = "public"
    fks: tuple[FkDef, ...] = ()
    uniques: tuple[UniqueDef, ...] = ()
    partition_of: str | None = None
    kind: str = "table"

    @property
    def key(self) -> str:
        return qualify(self.schema, self.name)

    @property
    def pk(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns if c.primary_key)

    @property
    def single_pk(self) -> str | None:
        """The primary key if it is one column; only such tables are traversed."""
        return self.pk[0] if len(self.pk) == 1 else None

    def column(self, name: str) -> ColumnDef | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def writable(self) -> tuple[str, ...]:
        """Columns that a load writes: all but generated ones; identity values are kept."""
        return tuple(c.name for c in self.columns if c.generated is None)


#: PostgreSQL type names by Spark type; the first is used when a catalog is read off a DataFrame.
SPARK_TYPES: dict[T.DataType, tuple[str, ...]] = {
    T.ShortType(): ("smallint", "int2", "smallserial"),
    T.IntegerType(): ("integer", "int", "int4", "serial"),
    T.LongType(): ("bigint", "int8", "bigserial"),
    T.FloatType(): ("real", "float4"),
    T.DoubleType(): ("double precision", "float8"),
    T.BooleanType(): ("boolean", "bool"),
    T.DateType(): ("date",),
    T.TimestampNTZType(): ("timestamp without time zone", "timestamp"),
    T.TimestampType(): ("timestamp with time zone", "timestamptz"),
    T.BinaryType(): ("bytea",),
    T.StringType(): ("text", "varchar", "character varying", "char", "character", "bpchar", "citext", "name", "uuid", "json", "jsonb", "interval"),
}
_BY_NAME = {name: kind for kind, names in SPARK_TYPES.items() for name in names}
INTEGERS = tuple(n for k in (T.ShortType(), T.IntegerType(), T.LongType()) for n in SPARK_TYPES[k])
NUMBERS = (*INTEGERS, "numeric", "decimal", "real", "double precision", "float4", "float8")


def base_type(pg: str) -> str:
    """A type name in lower case without its length or precision."""
    head, _, rest = pg.lower().partition("(")
    return (head.strip() + rest.partition(")")[2]).strip()


def spark_type(pg: str) -> T.DataType:
    """The Spark type that carries a PostgreSQL type; unknown types are carried as text."""
    name = base_type(pg)
    if name in ("numeric", "decimal"):
        inside = pg.partition("(")[2].partition(")")[0]
        precision, scale = ([int(x) for x in inside.split(",")] + [0])[:2] if inside else (38, 10)
        return T.DecimalType(min(precision, 38), min(scale, 38))
    return _BY_NAME.get(name, T.StringType())


def pg_type(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return f"numeric({kind.precision},{kind.scale})"
    return SPARK_TYPES.get(kind, ("text",))[0]


def is_text(pg: str) -> bool:
    """Whether a type holds text for redaction: text, citext, and all whose name contains char."""
    name = pg.lower()
    return name == "text" or "char" in name or "citext" in name


def describe(df: DataFrame, name: str, pk: Iterable[str] = (), fks: Iterable[FkDef] = (), schema: str = "public", **more) -> TableDef:
    """A table definition read off a DataFrame's schema; key columns count as not null."""
    pk = tuple(pk)
    missing = [c for c in pk if c not in df.columns]
    if missing:
        raise ValueError(f"key columns {missing} are not in table {name!r}")
    columns = tuple(ColumnDef(f.name, pg_type(f.dataType), f.nullable and f.name not in pk, f.name in pk) for f in df.schema.fields)
    return TableDef(name, columns, schema, tuple(fks), **more)


@dataclass
class Database:
    """Table definitions and a DataFrame for each."""

    tables: dict[str, TableDef] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def of(cls, *pairs: tuple[TableDef, DataFrame]) -> Database:
        return cls({t.key: t for t, _ in pairs}, {t.key: df for t, df in pairs})

    def resolve(self, name: str) -> TableDef:
        """A table by qualified name, or by a bare name that only one table has."""
        if name in self.tables:
            return self.tables[name]
        found = [t for t in self.tables.values() if t.name == name]
        if len(found) == 1:
            return found[0]
        if found:
            raise ValueError(f"table {name!r} is ambiguous: {', '.join(sorted(t.key for t in found))}")
        raise ValueError(f"unknown table {name!r}")

    def only(self, keys: Iterable[str]) -> Database:
        keys = list(keys)
        return Database({k: self.tables[k] for k in keys}, {k: self.frames[k] for k in keys if k in self.frames})

    def tables_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t.key, t.schema, t.name, t.kind, t.partition_of) for t in self.tables.values()]
        return spark.createDataFrame(rows, "key string, schema string, name string, kind string, partition_of string")

    def columns_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t.key, c.name, i, c.type, c.nullable, c.primary_key, c.generated, c.identity) for t in self.tables.values() for i, c in enumerate(t.columns, 1)]
        return spark.createDataFrame(rows, "key string, column string, ordinal int, type string, nullable boolean, primary_key boolean, generated string, identity string")

    def fks_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(f.name, t.key, list(f.columns), f.parent, list(f.parent_columns)) for t in self.tables.values() for f in t.fks]
        return spark.createDataFrame(rows, "name string, child string, columns array<string>, parent string, parent_columns array<string>").orderBy("child", "parent", "columns", "name")


# Keys ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class KeyChoice:
    """How a table's rows are ordered and found again: by primary key, unique index or physical row."""

    strategy: str
    columns: tuple[str, ...]


def choose_key(table: TableDef) -> KeyChoice | None:
    """The primary key if all its columns are not null; else the shortest eligible unique key over columns that
    are not null, ties by index name; else none."""

    def solid(columns: Iterable[str]) -> bool:
        found = [table.column(c) for c in columns]
        return bool(found) and all(c is not None and not c.nullable for c in found)

    if solid(table.pk):
        return KeyChoice("primary_key", table.pk)
    fit = [u for u in table.uniques if u.eligible and solid(u.columns)]
    if fit:
        return KeyChoice("unique_index", min(fit, key=lambda u: (len(u.columns), u.name)).columns)
    return None


#: Columns that identify a physical Parquet row.
ROW_ID = ("__file", "__row")


def with_row_id(df: DataFrame) -> DataFrame:
    """``df`` (a Parquet scan) with the physical row id."""
    return df.select("*", F.col("_metadata.file_path").alias(ROW_ID[0]), F.col("_metadata.row_index").alias(ROW_ID[1]))


def key_or_row_id(table: TableDef, require_safe_key: bool = False) -> KeyChoice:
    """:func:`choose_key`, or the physical row id where there is no safe key, unless one is required."""
    found = choose_key(table)
    if found is None and require_safe_key:
        raise ValueError(f"table {table.key} has no safe key")
    return found or KeyChoice("row_id", ROW_ID)


def key_violations(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Key values that are null or repeat, with their number of rows; empty for a valid key."""
    columns = list(columns)
    some_null = F.lit(False)
    for c in columns:
        some_null = some_null | F.col(c).isNull()
    return df.groupBy(*columns).agg(F.count("*").alias("n_rows")).where((F.col("n_rows") > 1) | some_null)


# Schema comparison and objects --------------------------------------------------------------------------------


def schema_violations(spark: SparkSession, source: Database, target: Database) -> DataFrame:
    """A row (key, column, problem) for everything that the target lacks or has otherwise of a source column.

    Compared are ordinal, type (without case), nullability, primary key, identity and generation. Further target
    columns are allowed.
    """
    s, t = source.columns_frame(spark), target.columns_frame(spark)
    t = t.select(*[F.col(c).alias(f"t_{c}") for c in t.columns])
    known = target.tables_frame(spark).select(F.col("key").alias("t_table"))
    both = s.join(known, s["key"] == known["t_table"], "left").join(t, (F.col("key") == F.col("t_key")) & (F.col("column") == F.col("t_column")), "left")
    differs = {
        "ordinal": F.col("ordinal") != F.col("t_ordinal"),
        "type": F.lower("type") != F.lower("t_type"),
        "nullability": F.col("nullable") != F.col("t_nullable"),
        "primary key": F.col("primary_key") != F.col("t_primary_key"),
        "identity": ~F.col("identity").eqNullSafe(F.col("t_identity")),
        "generation": F.col("generated").isNull() != F.col("t_generated").isNull(),
    }
    missing = F.when(F.col("t_table").isNull(), F.array(F.lit("missing table"))).when(F.col("t_column").isNull(), F.array(F.lit("missing column")))
    problems = F.coalesce(missing, F.array_compact(F.array(*[F.when(d, F.lit(name)) for name, d in differs.items()])))
    return both.select("key", "column", F.explode(problems).alias("problem"))


def profile(db: Database) -> DataFrame:
    """Kind, rows and bytes of each object, the largest first, with the totals of all objects in every row.

    Rows of an object that is just Parquet files come from the files' footers, bytes from their listing: no data
    page is read, so the work grows with the files, not with the rows. Others are counted.
    """
    spark = next(iter(db.frames.values())).sparkSession
    told = []
    for key, df in db.frames.items():
        t, files = db.tables[key], [unquote(f) for f in df.inputFiles()]
        n_bytes = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] if files else None
        told.append((t.schema, t.name, t.kind, footer_count(spark, files) if _whole_files(df) else df.count(), n_bytes))
    totals = (len(told), sum(x[3] for x in told), sum(x[4] or 0 for x in told))
    kinds = "schema string, name string, kind string, n_rows long, n_bytes long, n_objects long, total_rows long, total_bytes long"
    return spark.createDataFrame([(*x, *totals) for x in told], kinds).orderBy(F.desc("n_bytes"), "schema", "name")


def _whole_files(df: DataFrame) -> bool:
    """Whether a frame has all rows of some Parquet files: its plan is one scan, perhaps of fewer columns."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        plan = plan.children().head()
    return plan.nodeName().startswith("LogicalRelation") and bool(df.inputFiles()) and all(f.endswith(".parquet") for f in df.inputFiles())


def footer_count(spark: SparkSession, files: list[str]) -> int:
    """Rows of Parquet files by their footers: the count is pushed into the scan, which reads nothing else."""
    return _footers(spark, files).first()[0]


def _footers(spark: SparkSession, files: list[str]) -> DataFrame:
    session = spark.newSession()  # the way of reading is a setting of the session
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session.read.parquet(*files).agg(F.count("*").alias("n"))


#: What a user's transform gives for a table: its changed rows, or columns by name.
Transformed = DataFrame | Mapping[str, Column]


def apply_transform(table: TableDef, df: DataFrame, transform: Callable[[TableDef, DataFrame], Transformed] | None) -> DataFrame:
    """``df`` after a user's transform, with exactly its columns: added ones are dropped, removed ones restored.

    The transform returns either a mapping of names to columns of its frame, as a ``select`` would take them (the
    columns it doesn't name stay), or a frame made by ``withColumn``, ``drop`` and the like. For the latter every
    column is also there under a hidden name, so removed columns come back from the same row; a ``select`` that
    leaves out both a column and its hidden original is an error that says so.
    """
    if transform is None:
        return df
    hidden = {c: f"__was_{i}" for i, c in enumerate(df.columns)}
    given = df.select("*", *[F.col(f"`{c}`").alias(h) for c, h in hidden.items()])
    out = transform(table, given)
    if isinstance(out, Mapping):
        return given.select(*[(out[c] if c in out else F.col(f"`{c}`")).cast(df.schema[c].dataType).alias(c) for c in df.columns])
    if out is None:
        raise ValueError(f"the transform of table {table.key} returned nothing")
    lost = [c for c, h in hidden.items() if c not in out.columns and h not in out.columns]
    if lost:
        raise ValueError(f"the transform of table {table.key} has lost columns {', '.join(lost)} and what it was given of them under __was_ names: return a mapping {{name: column}} instead of select")
    return out.select(*[F.col(f"`{c}`").cast(df.schema[c].dataType).alias(c) if c in out.columns else F.col(h).alias(c) for c, h in hidden.items()])


def without(table: TableDef, columns: Iterable[str]) -> TableDef:
    gone = set(columns)
    return replace(table, columns=tuple(c for c in table.columns if c.name not in gone))
