"""Results as files: CSV with a byte-order mark, reports of several sheets."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.compare import Comparison
from tablewright.operators.fuzzy import suggestions
from tablewright.sources.csv_text import MARK
from tablewright.sources.xlsx import to_excel, write_workbooks


def csv_bytes(df: DataFrame, most: int = 1_000_000) -> bytes:
    """A small frame as CSV in UTF-8 with a byte-order mark; larger ones are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; use write_csv")
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows([["" if v is None else v for v in r] for r in rows])
    return out.getvalue().encode("utf-8-sig")


def write_csv(df: DataFrame, path: str) -> None:
    """A frame of any size as a folder of CSV files; lists become texts."""
    flat = [F.array_join(F.col(f"`{c}`").cast("array<string>"), ", ").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _csv_line(df: DataFrame) -> Column:
    """A row as a line of CSV; values with separators, quotes, line ends or outer blanks stand in quotes, lists become texts."""
    cells = []
    for c, t in df.dtypes:
        own = F.array_join(F.col(f"`{c}`").cast("array<string>"), ", ") if t.startswith("array") else F.col(f"`{c}`").cast("string")
        text = F.coalesce(own, F.lit(""))
        quoted = text.rlike(r'[",\n\r]|^ | \z') | (F.lit(len(df.columns) == 1) & (text == ""))  # an empty line would be no record
        cells.append(F.when(quoted, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text))
    return F.concat_ws(",", *cells)


def write_whole_csv(df: DataFrame, path: str) -> None:
    """A frame of any size as one CSV file in parts (a folder whose files follow each other by name): ``csv_bytes`` in the frame's order.

    Only the first part has the byte-order mark and the header.
    """
    head = io.StringIO()
    csv.writer(head, lineterminator="").writerow(df.columns)
    first = df.sparkSession.createDataFrame([(MARK + head.getvalue(),)], "line string").coalesce(1)
    first.unionAll(df.select(_csv_line(df).alias("line"))).write.text(path)


def report_frames(comparison: Comparison, issues: DataFrame | None = None) -> dict[str, DataFrame]:
    """The sheets of a comparison report by name."""
    plain = lambda df: df.drop(*[c for c in df.columns if c.startswith("__")])
    frames = {
        "Resumen": comparison.summary(),
        "Consolidado": plain(comparison.consolidated().orderBy("__orden", "__fila")),
        "Detalle diferencias": comparison.details(),
        "Modificaciones": plain(comparison.changed()),
        "Altas": comparison.added(),
        "Bajas": comparison.removed(),
        "Repeticiones": comparison.frequencies(),
    }
    if issues is not None:
        frames["Problemas validacion"] = issues
    found, _ = suggestions(comparison)
    if found is not None and found.head(1):
        frames["Coincidencias sugeridas"] = found
    return frames


def write_report(comparison: Comparison, path: str, issues: DataFrame | None = None) -> None:
    """A report of any size: one CSV folder for each sheet."""
    for name, df in report_frames(comparison, issues).items():
        write_csv(df, f"{path}/{name}")


def excel_report(comparison: Comparison, issues: DataFrame | None = None) -> bytes:
    """A report as a workbook."""
    return to_excel(report_frames(comparison, issues))


def cleaned_files(df: DataFrame, file_name: str) -> dict[str, bytes]:
    """A cleaned table as a workbook and as CSV, by the names under which they are handed out."""
    base = file_name.rsplit(".", 1)[0]
    return {f"{base}_limpio.xlsx": to_excel({"Datos": df}), f"{base}_limpio.csv": csv_bytes(df)}


def write_whole_cleaned(df: DataFrame, folder: str, file_name: str) -> dict[str, str]:
    """``cleaned_files`` of a table of any size, in parts: the paths of its workbooks and of its CSV by their names."""
    base = file_name.rsplit(".", 1)[0]
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in (f"{base}_limpio.xlsx", f"{base}_limpio.csv")}
    write_workbooks(df, paths[f"{base}_limpio.xlsx"], "Datos")
    write_whole_csv(df, paths[f"{base}_limpio.csv"])
    return paths


def write_cleaned(df: DataFrame, folder: str, file_name: str) -> str:
    """A cleaned table of any size as a folder of CSV files; its path."""
    path = f"{folder.rstrip('/')}/{file_name.rsplit('.', 1)[0]}_limpio.csv"
    write_csv(df, path)
    return path


def section_files(comparison: Comparison, issues: DataFrame | None = None, positions: DataFrame | None = None) -> dict[str, bytes]:
    """Every section of a comparison as CSV by its file's name; positions: the detail of an alignment."""
    names = {"Detalle diferencias": "diferencias", "Modificaciones": "modificaciones", "Altas": "altas", "Bajas": "bajas", "Repeticiones": "repeticiones", "Problemas validacion": "problemas"}
    frames = {names[k]: v for k, v in report_frames(comparison, issues).items() if k in names}
    if positions is not None:
        frames["orden"] = positions
    return {f"{name}.csv": csv_bytes(df) for name, df in frames.items()}
