"""Table, column and index descriptors, and the system catalogue built from them."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loomshift.functions.types import is_serial, spark_type


@dataclass
class Column:
    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    unique: bool = False

    @property
    def serial(self) -> bool:
        return is_serial(self.type)


@dataclass
class Table:
    name: str
    columns: list[Column]
    keys: list[str] = field(default_factory=list)
    indexes: dict[str, dict] = field(default_factory=dict)
    next_serial: int = 1
    next_batch: int = 1
    batches: list[list] = field(default_factory=list)
    folder: str = ""

    #: A table without a primary key gets this hidden one, so that equal rows are kept.
    ROW_ID = "__rowid"

    def schema(self) -> T.StructType:
        fields = [T.StructField(c.name, spark_type(c.type), True) for c in self.columns]
        return T.StructType(fields if self.keys else [*fields, T.StructField(self.ROW_ID, T.StringType())])

    def log_keys(self) -> list[str]:
        return self.keys or [self.ROW_ID]

    def dump(self) -> dict:
        return asdict(self)

    @classmethod
    def load(cls, data: dict) -> Table:
        return cls(**{**data, "columns": [Column(**c) for c in data["columns"]]})


#: Wire numbers of the types.
OIDS = {"boolean": 16, "bigint": 20, "int": 23, "string": 25, "float": 700, "double": 701, "timestamp": 1184}


def system_views(spark: SparkSession, tables: list[Table], database: str, user: str) -> dict[str, DataFrame]:
    """The catalogue's views by name; descriptors are few, so they are made on the driver."""
    oid = {t.name: 16384 + i for i, t in enumerate(sorted(tables, key=lambda t: t.name))}
    columns = [(t.name, i, c, c.name in t.keys) for t in tables for i, c in enumerate(t.columns, 1)]

    def frame(schema: str, rows: list[tuple]) -> DataFrame:
        return spark.createDataFrame(rows, schema)

    return {
        "information_schema_tables": frame("table_catalog string, table_schema string, table_name string, table_type string", [(database, "public", t.name, "BASE TABLE") for t in tables]),
        "information_schema_columns": frame(
            "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, column_default string, is_nullable string, data_type string",
            [(database, "public", t, c.name, i, c.default, "NO" if pk or not c.nullable else "YES", spark_type(c.type).simpleString()) for t, i, c, pk in columns],
        ),
        "information_schema_schemata": frame("catalog_name string, schema_name string", [(database, "public"), (database, "information_schema"), (database, "pg_catalog")]),
        "pg_namespace": frame("oid int, nspname string", [(11, "pg_catalog"), (2200, "public")]),
        "pg_class": frame("oid int, relname string, relnamespace int, relkind string", [(oid[t.name], t.name, 2200, "r") for t in tables]),
        "pg_attribute": frame(
            "attrelid int, attname string, atttypid int, attnum int, attnotnull boolean",
            [(oid[t], c.name, OIDS.get(spark_type(c.type).simpleString(), 25), i, pk or not c.nullable) for t, i, c, pk in columns],
        ),
        "pg_type": frame("oid int, typname string", [(n, name) for name, n in OIDS.items()]),
        "pg_index": frame("indexrelid int, indrelid int, indisunique boolean, indname string", [(32768 + 16 * oid[t.name] + i, oid[t.name], x["unique"], n) for t in tables for i, (n, x) in enumerate(t.indexes.items())]),
        "pg_constraint": frame("conname string, conrelid int, contype string", [(f"{t.name}_pkey", oid[t.name], "p") for t in tables if t.keys]),
        "pg_tables": frame("schemaname string, tablename string, tableowner string", [("public", t.name, user) for t in tables]),
        "pg_user": frame("usename string, usesysid int, usesuper boolean", [(user, 10, True)]),
        "pg_roles": frame("rolname string, oid int, rolsuper boolean", [(user, 10, True)]),
    }
