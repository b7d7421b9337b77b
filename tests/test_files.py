"""Large CSV files with and without quotes, late headers, wide sheets, and the store's pointers."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators.store import Store
from tablewright.sources import tables, writers, xlsx
from tablewright.sources.errors import FileLoadError

NOTES = "".join(f"nota {i}; sin datos\n" for i in range(400))
LATE = [
    (NOTES + "\nid;texto;c\n" + "".join(f" {i}; á{i} ;x\n" for i in range(300)) + "9;corta\n").encode("cp1252"),  # no quote: parsed by the JVM
    ("﻿" + NOTES.replace("\n", "\r\n") + "id;texto\r\n\r\n" + "".join(f"{i};ñ{i}\r\n" for i in range(300))).encode(),
    (NOTES + 'id;"texto\nlargo"\n' + "".join(f'{i};"á {i}\n""fin"""\n' for i in range(300))).encode(),
    (NOTES + "id;t\n" + "".join(f"{i};\x0b{i}\x85 z\rw\n" for i in range(300))).encode(),
]


@pytest.mark.parametrize("raw", LATE, ids=range(len(LATE)))
def test_a_header_beyond_the_beginning_is_found_by_its_line(spark, tmp_path, monkeypatch, raw):
    (tmp_path / "g.csv").write_bytes(raw)
    options = tables.ReadOptions(header_row=401)
    small, said = tables.load_table(spark, str(tmp_path / "g.csv"), options)
    monkeypatch.setattr(tables, "DRIVER_BYTES", 0)
    monkeypatch.setattr(tables, "PREFIX", 1000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        large, again = tables.load_table(spark, str(tmp_path / "g.csv"), options)
        with pytest.raises(FileLoadError, match="No hay encabezado en la fila 9000"):
            tables.load_table(spark, str(tmp_path / "g.csv"), tables.ReadOptions(header_row=9000))
        python = "ArrowEvalPython" in (plan := large._jdf.queryExecution().executedPlan().toString()) or "MapInArrow" in plan
        assert python == (b'"' in raw)
        assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert small.columns == large.columns and said == again and small.count() >= 300


def test_sheets_keep_all_their_columns(spark, tmp_path):
    wide = spark.createDataFrame([tuple(f"v{i}" for i in range(20))], [f"c{i}" for i in range(20)])
    (tmp_path / "wide.xlsx").write_bytes(xlsx.to_excel({"Datos": wide}))
    spark.dataSource.register(xlsx.XlsxDataSource)
    read = spark.read.format("tablewright_xlsx").option("path", str(tmp_path / "wide.xlsx"))
    got = read.load()
    assert len(got.columns) == 21 and got.where("fila = 2").first()["c20"] == "v19"
    with pytest.raises(Exception, match="more than the 16 columns"):
        read.option("columns", "16").load().collect()


def test_a_reader_finds_the_old_table_or_the_new(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError, match="never made"):
        store.table("aplicaciones")
    store.create()
    before = store.table("aplicaciones")
    store.upsert("aplicaciones", [("Uno", "1", "p", "r")])
    assert before.count() == 0 and store.table("aplicaciones").count() == 1
    assert [p.name for p in (tmp_path / "store" / "aplicaciones").iterdir() if p.name.startswith("_current")] == ["_current"]


def test_a_file_in_parts_is_one_file(spark, tmp_path, monkeypatch):
    """Twelve parts, of which some begin inside quotes, in the order of their numbers, whatever splits a task reads together."""
    text = "﻿id,texto\n" + "".join(f'{i},"línea {i}\nsegue ""así""\n, fin"\n' if i % 3 else f"{i},corta\n" for i in range(200))
    (tmp_path / "uno.csv").write_bytes(text.encode())
    lines, folder = text.splitlines(keepends=True), tmp_path / "partes.csv"
    folder.mkdir()
    for k in range(12):
        (folder / f"part-{k}.txt").write_bytes("".join(lines[k * len(lines) // 12 : (k + 1) * len(lines) // 12]).encode())
    want = sorted(map(tuple, tables.load_table(spark, str(tmp_path / "uno.csv"))[0].collect()))
    assert sorted(map(tuple, tables.load_table(spark, str(folder))[0].collect())) == want and len(want) == 200
    monkeypatch.setattr(tables, "DRIVER_BYTES", 0)
    for split in ("200", "100000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            assert sorted(map(tuple, tables.load_table(spark, str(folder))[0].collect())) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tables_of_any_size_as_workbooks_and_csv(spark, tmp_path, monkeypatch):
    """Written and read by tasks they give what one workbook and one text give; none but the header is made by the driver."""
    rows = [(i, None if i % 5 == 0 else f'á "{i}", x\ny', i / 4, i % 2 == 0) if i % 7 else (None, None, None, None) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "n long, t string, x double, b boolean").repartition(3).orderBy("n")
    whole = spark.createDataFrame([r for r in df.collect()], df.schema).coalesce(1)
    monkeypatch.setattr(xlsx, "PART_ROWS", 4)
    paths = writers.write_whole_cleaned(df, str(tmp_path), "datos.xlsx")
    want = tables.load_bytes(spark, "d.xlsx", xlsx.to_excel({"Datos": whole}))[0]
    got = tables.load_workbooks(spark, paths["datos_limpio.xlsx"])[0]
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert spark.read.parquet(paths["datos_limpio.xlsx"]).agg(F.max("n"), F.count("*")).first()[:] == (4, spark.read.parquet(paths["datos_limpio.xlsx"]).where("n > 0").count() + 1)
    texts = df.select(F.col("n").cast("string").alias("n"), "t")
    writers.write_whole_csv(texts, str(tmp_path / "t.csv"))
    want = tables.load_bytes(spark, "t.csv", writers.csv_bytes(texts))[0].collect()
    assert sorted(map(tuple, tables.load_table(spark, str(tmp_path / "t.csv"))[0].collect()), key=str) == sorted(map(tuple, want), key=str)
    writers.write_whole_csv(texts.limit(0), str(tmp_path / "none.csv"))
    assert tables.load_table(spark, str(tmp_path / "none.csv"))[0].columns == ["fila", "n", "t"]
