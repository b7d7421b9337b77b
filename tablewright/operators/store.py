"""Reference tables and the history of validations as Parquet tables under one folder.

Reference tables are small and written whole, in versions; the history only grows, so a validation is a file of its own.
"""

from __future__ import annotations

import secrets
import time
from dataclasses import dataclass
from datetime import datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.sources import files

# The tables' schemas and sample rows.
TABLES = {
    "proveedores": "razon_social string, nit string, contacto string, email string, telefono string",
    "aplicaciones": "nombre string, version string, entorno string, responsable string",
    "usuarios": "nombre string, email string, area string, cargo string",
    "historico_validaciones": "id long, esquema string, archivo_anterior string, archivo_nuevo string, fecha_validacion timestamp, score_calidad double, total_registros long, errores_encontrados long, advertencias long, detalles string",
    "resultados_validacion": "id long, historico_id long, tipo_validacion string, registro_id string, campo string, error string",
}
HISTORY = "historico_validaciones"
KEYS = {"proveedores": "razon_social", "aplicaciones": "nombre", "usuarios": "nombre"}
SAMPLES = {
    "proveedores": [("Proveedor Uno S.A.", "900000001", "Contacto Uno", "uno@example.com", "6010000001"), ("Proveedor Dos S.A.", "900000002", "Contacto Dos", "dos@example.com", "6010000002"), ("Proveedor Tres S.A.", "900000003", "Contacto Tres", "tres@example.com", "6010000003"), ("Proveedor Cuatro S.A.", "900000004", "Contacto Cuatro", "cuatro@example.com", "6010000004")],
    "aplicaciones": [("Aplicación Uno", "1.0", "Producción", "Equipo Uno"), ("Aplicación Dos", "2.0", "Pruebas", "Equipo Dos"), ("Aplicación Tres", "3.0", "Producción", "Equipo Tres")],
    "usuarios": [("Usuario Uno", "usuario.uno@example.com", "TI", "Analista"), ("Usuario Dos", "usuario.dos@example.com", "Finanzas", "Gerente"), ("Usuario Tres", "usuario.tres@example.com", "Seguridad", "Líder")],
}


def latest_wins(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row for each key: the last of the new rows that bear it (they have ``__at``), else the current row."""
    rows = current.withColumn("__at", F.lit(-1).cast("long")).unionByName(new)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__at")))).where("__n = 1").drop("__n", "__at")


@dataclass
class Store:
    """Tables in versions: a write makes a new version and then points to it, so readers always see a whole table."""

    spark: SparkSession
    path: str

    def _pointer(self, table: str) -> str:
        return f"{self.path}/{table}/_current"

    def _version(self, table: str) -> str | None:
        pointer = self._pointer(table)
        return files.head(self.spark, pointer, files.size(self.spark, pointer)).decode() if files.exists(self.spark, pointer) else None

    def _write(self, table: str, df: DataFrame) -> None:
        version = f"{self.path}/{table}/v-{uuid4().hex}"
        df.write.parquet(version)
        files.replace(self.spark, self._pointer(table), version.encode())

    def create(self) -> None:
        """Make the tables that don't exist."""
        for table, schema in TABLES.items():
            if table == HISTORY:
                self.spark.createDataFrame([], schema).write.mode("append").parquet(self._rows())
            elif self._version(table) is None:
                self._write(table, self.spark.createDataFrame([], schema))

    def _rows(self) -> str:
        return f"{self.path}/{HISTORY}/rows"

    def table(self, table: str) -> DataFrame:
        if table == HISTORY:
            return self.spark.read.schema(TABLES[table]).parquet(self._rows())
        version = self._version(table)
        if version is None:
            raise ValueError(f"table {table} was never made in {self.path}; create() makes it")
        return self.spark.read.schema(TABLES[table]).parquet(version)

    def names(self, table: str) -> DataFrame:
        """A reference table's rows by name."""
        return self.table(table).orderBy(KEYS[table])

    def upsert(self, table: str, rows: list[tuple]) -> None:
        """Insert or replace reference rows by name; of rows with one name the last counts."""
        schema = TABLES[table]
        new = self.spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{schema}, __at long")
        self._write(table, latest_wins(self.table(table), new, KEYS[table]))

    def add_history(self, esquema: str, archivo_anterior: str | None, archivo_nuevo: str | None, score: float, total: int, errors: int, warnings: int, details: str = "") -> int:
        """Append a validation; its number is later than all that were given before."""
        return self.add_histories([(esquema, archivo_anterior, archivo_nuevo, None, score, total, errors, warnings, details)])[0]

    def add_histories(self, rows: list[tuple]) -> list[int]:
        """Append validations (the fields of the history after its number; no moment: now) as one file.

        Numbers are the microsecond and random low bits, so writers need not know of each other.
        """
        now = time.time_ns() // 1000
        numbers = [((now + i) << 11) | secrets.randbelow(1 << 11) for i in range(len(rows))]
        moment = datetime.now()
        whole = [(n, *r[:3], r[3] or moment, *r[4:]) for n, r in zip(numbers, rows, strict=True)]
        self.spark.createDataFrame(whole, TABLES[HISTORY]).coalesce(1).write.mode("append").parquet(self._rows())
        return numbers

    def history(self, n: int = 5) -> DataFrame:
        """The latest validations."""
        return self.table(HISTORY).orderBy(F.desc("fecha_validacion"), F.desc("id")).limit(n)

    def clear(self) -> None:
        """Empty the suppliers and applications."""
        for table in ("proveedores", "aplicaciones"):
            self._write(table, self.spark.createDataFrame([], TABLES[table]))

    def seed(self) -> None:
        """Put sample rows into the reference tables."""
        for table, rows in SAMPLES.items():
            self.upsert(table, rows)

    def references(self) -> dict[str, DataFrame]:
        """The tables that rule sets look things up in."""
        return {t: self.table(t) for t in KEYS}


_stores: dict[str, Store] = {}


def open_store(spark: SparkSession, path: str) -> Store:
    """The store of a folder, one object for each."""
    if path not in _stores or _stores[path].spark is not spark:
        _stores[path] = Store(spark, path)
        _stores[path].create()
    return _stores[path]
