"""Loading and exporting sets of versioned tables: CSV, Parquet, JDBC, and DDL text."""

from __future__ import annotations

import inspect
import os
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .one_file import write_csv_file

VERSION_COLUMN = "schema_version"
# The columns of the four tables.
SCHEMAS = {
    "folders_hierarchy": "folder_id string, folder_name string, relative_path string, depth long, layer string, file_count long, subfolder_count long, weight_score double, entropy_contribution double, nesting_chain string, path_length long, schema_version string",
    "files_identity": "file_id string, file_name string, relative_path string, extension string, depth long, layer string, size_bytes long, parent_folder_id string, impact_ratio double, direct_impact long, transitive_impact long, is_entry_point boolean, is_god_file boolean, schema_version string",
    "import_dependencies": "source_id string, target_id string, line_number long, is_resolved boolean, caller_count long, called_count long, schema_version string",
    "impact_metrics": "file_id string, direct_impact long, transitive_impact long, impact_ratio double, is_entry_point boolean, is_god_file boolean, schema_version string",
}


@dataclass
class Report:
    success: bool = True
    stats: dict[str, int] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    version: str | None = None


def _stem(path: str) -> str:
    return os.path.basename(path.rstrip("/")).split(".")[0].removesuffix("_schema")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    schema = SCHEMAS.get(_stem(path))
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    raw = raw.select(*[F.when(F.col(f"`{c}`").isin("", "NULL", "null", "None"), None).otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if not schema:
        return raw
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(schema).fields}
    return raw.select(*[F.col(f"`{c}`").cast(kinds.get(c, T.StringType())).alias(c) for c in raw.columns])


#: The format where none is named.
DEFAULTS = {"loader": "csv", "exporter": "csv"}
LOADERS: dict[str, tuple[str, Callable[[SparkSession, str], DataFrame]]] = {"csv": (".csv", _csv), "parquet": (".parquet", lambda spark, path: spark.read.parquet(path))}


def _quoted(value: object) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _ranges(spark: SparkSession, source: str, table: str, key: str, parts: int, properties: Mapping[str, str]) -> list[str]:
    """Conditions that share the rows out by ranges of a key of text or numbers, null with the first.

    The database itself tells the keys at even steps in its own order, one value a part, so that the ranges are even
    whatever the key's values and no row is read for it.
    """
    ask = lambda query: spark.read.jdbc(source, f"({query}) q", properties=dict(properties)).first()
    column = '"' + key.replace('"', '""') + '"'
    rows = int(ask(f"SELECT COUNT({column}) AS n FROM {table}")[0])
    steps = sorted({rows * i // parts for i in range(1, parts)} - {0})
    found = [ask(f"SELECT {column} AS k FROM {table} WHERE {column} IS NOT NULL ORDER BY {column} OFFSET {at} ROWS FETCH NEXT 1 ROWS ONLY") for at in steps]
    ends = [_quoted(v) for v in dict.fromkeys(r[0] for r in found if r)]
    if not ends:
        return ["1 = 1"]
    between = [f"{column} >= {low} AND {column} < {high}" for low, high in zip(ends, ends[1:])]
    return [f"{column} < {ends[0]} OR {column} IS NULL", *between, f"{column} >= {ends[-1]}"]


def _jdbc(spark: SparkSession, source: str, schema: str = "public", names: Iterable[str] = tuple(SCHEMAS), parts: int = 8, keys: Mapping[str, str] | None = None, **properties: str) -> Report:
    """The named tables of a database, by its driver on the class path, each in up to parts reads by ranges of its key.

    keys names the keys, by default each table's first column; further options are properties of the connection.
    """
    out = Report()
    for name in names:
        table = f"{schema}.{name}" if schema else name
        try:
            columns = spark.read.jdbc(source, table, properties=properties).columns
            key = (keys or {}).get(name, columns[0])
            shares = _ranges(spark, source, table, key, parts, properties)
            out.tables[name] = spark.read.jdbc(source, table, predicates=shares, properties=properties)
        except Exception as e:
            out.success = False
            out.warnings.append(f"{name}: {e}")
    return out


def load(spark: SparkSession, source: str, fmt: str | None = None, **options) -> Report:
    """One table for each entry of a folder that ends in the format's suffix, or the one that source names.

    With format postgresql or psql source is a JDBC address and the four tables are read from it.
    """
    fmt = (fmt or DEFAULTS["loader"]).strip().lower()
    if fmt in ("postgresql", "psql"):
        out = _jdbc(spark, source, **options)
    elif fmt not in LOADERS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(sorted([*LOADERS, 'postgresql', 'psql']))}")
    else:
        suffix, read = LOADERS[fmt]
        single = source.rstrip("/").endswith(suffix)
        found = [source] if single else [os.path.join(source, n) for n in sorted(os.listdir(source)) if n.endswith(suffix)]
        out = Report()
        for path in found:
            try:
                out.tables[_stem(path)] = read(spark, path)
            except Exception as e:
                out.success = False
                out.warnings.append(f"{path}: {e}")
    out.version = next((v for df in out.tables.values() if (v := version_of(df))), None)
    return out


def version_of(df: DataFrame) -> str | None:
    return df.agg(F.min(VERSION_COLUMN)).first()[0] if VERSION_COLUMN in df.columns else None


def ddl(table: str, df: DataFrame, schema: str = "public") -> str:
    kinds = {"bigint": "BIGINT", "int": "BIGINT", "smallint": "BIGINT", "double": "DOUBLE PRECISION", "float": "DOUBLE PRECISION", "boolean": "BOOLEAN"}
    columns = ",\n".join(f'    "{f.name}" {kinds.get(f.dataType.simpleString(), "TEXT")}' for f in df.schema.fields if f.name != VERSION_COLUMN)
    return f"CREATE TABLE IF NOT EXISTS {schema}.{table} (\n{columns}\n);"


def _write_csv(df: DataFrame, path: str, parts: bool = False, **_) -> None:
    """One file with a byte order mark; with parts a folder of part files without one, for large tables."""
    if not parts:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return write_csv_file(df, path + ".csv")
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", "NULL").csv(path + ".csv")


def _write_sql(df: DataFrame, path: str, db_uri: str | None = None, schema: str = "public", if_exists: str = "replace", parts: int = 8, key_type: str | None = None, **properties) -> None:
    """JDBC where an address is given (its driver must be on the class path), else the table's DDL as text.

    At most parts tasks write at a time, in batches (property batchsize). key_type is the first column's type where the
    database does not compare its type for texts. A task that is run again writes its rows in a transaction of its own.
    """
    table = os.path.basename(path)
    if db_uri:
        writer = df.write.option("numPartitions", parts)
        if key_type:
            writer = writer.option("createTableColumnTypes", f"`{df.columns[0]}` {key_type}")
        writer.jdbc(db_uri, f"{schema}.{table}" if schema else table, mode={"replace": "overwrite", "append": "append"}.get(if_exists, "error"), properties=properties)
    else:
        df.sparkSession.createDataFrame([(ddl(table, df, schema),)], "ddl string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path + ".sql")


def _write_hdf5(df: DataFrame, path: str, **_) -> None:
    raise RuntimeError("HDF5 needs a library that is not installed")


EXPORTERS: dict[str, Callable[..., None]] = {"csv": _write_csv, "hdf5": _write_hdf5, "parquet": lambda df, path, **_: df.write.mode("overwrite").parquet(path + ".parquet"), "postgresql": _write_sql, "psql": _write_sql}


def export(tables: Mapping[str, DataFrame], folder: str, fmt: str | None = None, **options) -> Report:
    """Writes each valid table, CSV as one file, others as folders of part files; what fails becomes a warning and success=False."""
    fmt = (fmt or DEFAULTS["exporter"]).strip().lower()
    if fmt not in EXPORTERS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(sorted(EXPORTERS))}")
    out = Report()
    for name, df in tables.items():
        if VERSION_COLUMN not in df.columns or len(df.columns) < 2 or df.isEmpty():
            out.warnings.append(f"{name}: empty, or without {VERSION_COLUMN}")
            continue
        try:
            EXPORTERS[fmt](df, os.path.join(folder, name), **options)
            out.stats[name] = df.count()
        except Exception as e:
            out.success = False
            out.warnings.append(f"{name}: {e}")
    return out


def _checked(what: str, fmt: str, strategy: Callable, takes: int, default: bool) -> str:
    """The format's key; TypeError unless strategy can be called with takes arguments and the options of its kind."""
    if not callable(strategy):
        raise TypeError(f"{what} of {fmt!r} is not callable")
    try:
        inspect.signature(strategy).bind(*range(takes))
    except TypeError as e:
        raise TypeError(f"{what} of {fmt!r}: {e}") from e
    key = fmt.strip().lower()
    if default:
        DEFAULTS[what] = key
    return key


def register_loader(fmt: str, suffix: str, read: Callable[[SparkSession, str], DataFrame], default: bool = False) -> None:
    LOADERS[_checked("loader", fmt, read, 2, default)] = (suffix, read)


def register_exporter(fmt: str, write: Callable[..., None], default: bool = False) -> None:
    EXPORTERS[_checked("exporter", fmt, write, 2, default)] = write
