"""Relational targets of a database: rows come in through a staging table and one set-based insert."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.filters import PARTITION

#: Characters of a key column of text, which databases index only with a bound.
KEY_LENGTH = 255


def _run(df: DataFrame, url: str, properties: dict[str, str], *statements: str) -> int:
    """Statements as one transaction; the rows that the last one changed."""
    jvm = df.sparkSession._jvm
    own = jvm.java.util.Properties()
    for k, v in properties.items():
        own.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, own)
    try:
        connection.setAutoCommit(False)
        statement, changed = connection.createStatement(), 0
        for s in statements:
            changed = statement.executeUpdate(s)
        connection.commit()
        return changed
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def insert_absent(df: DataFrame, url: str, table: str, keys: Sequence[str], properties: dict[str, str] | None = None, batch: int = 500) -> int:
    """Insert the rows whose keys the table does not have yet; how many there were.

    The table is made with the columns of df if it is not there. Tasks write to a staging table of this load, in batches;
    one statement then moves what is new, so a load that is repeated, after it failed half way too, changes nothing twice.
    Of rows of df with the same key none may be twice, as in a shaped relational entity.
    """
    properties, rows = properties or {}, df.drop(PARTITION)
    texts = [f for f in rows.schema.fields if f.name in keys and isinstance(f.dataType, StringType)]
    types = ", ".join(f"`{f.name}` VARCHAR({KEY_LENGTH})" for f in texts)
    staging = f"{table}_{uuid.uuid4().hex[:12]}"
    declared = lambda d: d.write.option("batchsize", batch).option("createTableColumnTypes", types) if types else d.write.option("batchsize", batch)
    declared(rows.where(F.lit(False))).jdbc(url, table, mode="append", properties=properties)
    columns = ", ".join(f'"{c}"' for c in rows.columns)
    same = " AND ".join(f't."{k}" = s."{k}"' for k in keys)
    try:
        declared(rows).jdbc(url, staging, mode="errorifexists", properties=properties)
        return _run(df, url, properties, f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {staging} s WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE {same})")
    finally:
        _run(df, url, properties, f"DROP TABLE {staging}")
