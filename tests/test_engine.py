"""Small tables with known results: comparison, typing, cleaning, rules, loading, positions, store."""

import pytest
from pyspark.sql import functions as F

from tablewright.functions import dates, numbers, similarity, text
from tablewright.operators import clean, fuzzy, positional, quality, rules, schema
from tablewright.operators.compare import CompareOptions, Comparison, cosmetic
from tablewright.operators.store import Store
from tablewright.sources import csv_text, tables, writers, xlsx
from tablewright.sources.errors import FileLoadError, friendly_message, to_friendly_error

HEAD = "ID;Nombre;Responsable / Correo;Cantidad Total;Fecha Compra;Pais;Auditoria"
CSV_A = "\n".join([HEAD, "L-1;Camión rojo;ana@empresa.com;100,50;15/01/2024;Chile;2024-01-01 10:00", "L-1;Camión azul;ana@empresa.com;200;2024-02-01;Chile;2024-01-01 10:00", "L-1;Camión gris;ana@empresa.com;300;2024-03-01;Chile;2024-01-01 10:00", "L-2;Hola;ana@empresa.com;50;2024-04-01;Perú;2024-01-01 10:00", "L-4;Servidor A;ana@empresa.com;7;2024-06-01;Chile;2024-01-01 10:00"])
CSV_B = "\n".join([HEAD, "L-1;Camion rojo;ana@empresa.com;100,505;15/01/2024;Chile;2025-09-01 08:30", "L-1;Camión  azul;ana@empresa.com;200;01/02/2024;Chile;2025-09-01 08:30", "L-2;hola;ana@empresa.com;50;2024-04-01;Peru;2025-09-01 08:30", "L-5;Servidor B;ana@empresa.com;9;2024-07-01;Chile;2025-09-01 08:30"])


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pair")
    (folder / "a.csv").write_bytes(CSV_A.encode("cp1252"))
    (folder / "b.csv").write_bytes(CSV_B.encode())
    loaded = [tables.load_table(spark, str(folder / n)) for n in ("a.csv", "b.csv")]
    raw = [df for df, _ in loaded]
    kinds = {r["Columna"]: r["Tipo de dato"] for r in schema.infer_schema(*raw)}
    styles = schema.decimal_styles(kinds, *raw)
    typed = [schema.apply_schema(clean.clean_data(df), kinds, styles)[0] for df in raw]
    return loaded, kinds, typed


def compared(pair, **options):
    old, new = pair[2]
    columns = [c for c in old.columns if c not in ("fila", "ID")]
    return Comparison(old, new, ["ID"], columns, CompareOptions(excluded=("Auditoria",), **options))


def test_csv_is_recognised(pair):
    (df, warnings), _ = pair[0]
    assert [r.fila for r in df.orderBy("fila").collect()] == [2, 3, 4, 5, 6]
    assert "punto y coma" in warnings[0]["detalle"] and "Windows-1252" in warnings[0]["detalle"]


def test_types_are_inferred(pair):
    assert pair[1] == {"ID": schema.ID, "Nombre": schema.TEXT, "Responsable / Correo": schema.EMAIL, "Cantidad Total": schema.DECIMAL, "Fecha Compra": schema.DATE, "Pais": schema.TEXT, "Auditoria": schema.DATE}


def test_comparison_counts(pair):
    c = compared(pair)
    t = c.totals().first()
    assert (t.altas, t.bajas, t.modificaciones, t.sin_cambios, t.total_keys) == (1, 2, 2, 1, 6)
    assert tuple(c.orphans().first()) == (1, 0)
    assert [(r["Clave"], r["Veces en Archivo 1"], r["Veces en Archivo 2"]) for r in c.frequencies().collect()] == [("L-1", 3, 2)]
    assert c.consolidated().count() == 6 and c.repeated


def test_tolerances_remove_all_details(pair):
    c = compared(pair, ignore_case=True, ignore_accents=True, numeric_tolerance=0.01)
    assert c.details().count() == 0 and c.unchanged().count() == 3


def test_strict_spaces_show_kinds(pair):
    kinds = {r[0] for r in compared(pair, ignore_spaces=False).histogram().collect()}
    assert {similarity.ACCENTS, similarity.CASE, similarity.NUMBER_OTHER} <= kinds
    assert cosmetic(compared(pair).details(False)).count() >= 2


def test_inclusion(pair):
    r = compared(pair).inclusion().first()
    assert (r.contenido, r.faltantes, r.veredicto) == (False, 2, "NO")
    old = pair[2][0]
    whole = Comparison(old, old, ["ID"], ["Nombre"]).inclusion().first()
    assert whole.contenido and whole.cobertura_exacta == 100.0 and whole.veredicto == "SÍ"


def test_empty_tables_compare(pair):
    old, new = pair[2]
    t = Comparison(old.limit(0), new, ["ID"], ["Nombre"]).totals().first()
    assert (t.altas, t.bajas, t.total_keys) == (4, 0, 4)
    assert Comparison(old.limit(0), new.limit(0), ["ID"], ["Nombre"]).inclusion().first().cobertura_clave == 0.0


@pytest.mark.parametrize(
    ("values", "style", "expected"),
    [
        (["1.234,56", "12,5", "7", "100,505"], "coma", [1234.56, 12.5, 7.0, 100.505]),
        (["1,234.56", "9.99", "7", "0.125"], "punto", [1234.56, 9.99, 7.0, 0.125]),
        (["1.234", "2.500", "12", "1.000.000"], "coma", [1234.0, 2500.0, 12.0, 1000000.0]),
        (["1,234", "2,500", "12", "1,000,000"], "punto", [1234.0, 2500.0, 12.0, 1000000.0]),
        (["$ 1 234", "15%", "12 meses", ""], "coma", [1234.0, 0.15, None, None]),
    ],
)
def test_numbers(spark, values, style, expected):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    assert numbers.style_of(df.agg(*numbers.evidence(F.col("v"))).first().asDict()) == style
    assert [r[0] for r in df.orderBy("i").select(numbers.parse_number(F.col("v"), style)).collect()] == expected


def test_dates(spark):
    values = ["2024-01-15", "15/01/2024", "15.1.24", "20240115", "2024-01-15T10:30:05Z", "45306", "31/02/2024", "10:30", "x", None, "2024"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(values)), "i int, v string").orderBy("i").select(dates.parse_date(F.col("v")).cast("string")).collect()]
    day = "2024-01-15 00:00:00"
    assert got == [day, day, day, day, "2024-01-15 10:30:05", day, None, None, None, None, "2024-01-01 00:00:00"]


def test_kinds_of_difference(spark):
    pairs = [("Hola", "hola", similarity.CASE), ("Perú", "Peru", similarity.ACCENTS), ("Perú", "PERU", similarity.CASE_ACCENTS), ("a  b", "a b", similarity.SPACES), ("100,5", "x", similarity.TEXT_OTHER), ("1.0", "1.005", similarity.NUMBER_NEAR), ("1", "2", similarity.NUMBER_OTHER), ("2024-01-15", "15/01/2024", similarity.DATE_FORM), ("2024-01-15", "16/01/2024", similarity.DATE_OTHER), (None, "x", similarity.MISSING), (None, None, similarity.SAME), ("007", "7", similarity.SAME)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = [r.kind for r in similarity.with_difference(df, "a", "b", tolerance=0.01).orderBy("i").collect()]
    assert got == [k for *_, k in pairs]


def test_similarity():
    assert similarity.jaro_winkler_of("Servidor A", "Servidor B") > 0.9
    assert similarity.jaro_of("", "a") == 0 and similarity.jaro_of("", "") == 1
    assert round(similarity.jaro_of("MARTHA", "MARHTA"), 4) == 0.9444
    a, b = similarity.marked("Camión rojo", "Camion Rojo")
    assert "diff-del" in a and "diff-ins" in b and similarity.marked("<b>", "x")[0].count("&lt;b&gt;") == 1 and similarity.marked(None, "x")[0] == similarity.EMPTY


def test_cleaning(spark):
    df = spark.createDataFrame([(2, " 007 ", "Juan.Perez+ti @EMPRESA.com", " José  Pérez ", " "), (3, "007", "Juan.Perez+ti @EMPRESA.com", "José  Pérez", ""), (4, None, "", None, " ")], "fila long, ` ID` string, Correo string, Nombre string, `Vacío` string")
    rows = clean.clean_data(df)
    assert [r.fila for r in rows.collect()] == [2]
    r = clean.normalize_text_data(rows).first()
    assert (r["ID"], r["Correo"], r["Nombre"], r["Vacío"]) == ("007", "Juan.Perez+ti@empresa.com", "Jose Perez", None)
    assert spark.createDataFrame([("3com",)], "a string").select(text.title("a")).first()[0] == "3Com"


def test_positions(spark):
    frame = lambda rows: spark.createDataFrame([(i + 2, *r) for i, r in enumerate(rows)], "fila long, id string, v string")
    a, b = frame([("1", "a"), ("2", "b"), ("3", "c"), ("4", "d")]), frame([("1", "a"), ("9", "z"), ("2", "b"), ("3", "C")])
    r = positional.aligned(a, b, ["id", "v"])
    assert (r.iguales, r.desplazadas, r.distintas, r.solo_en_a, r.solo_en_b, r.mismo_orden) == (1, 1, 1, 1, 1, False)
    assert positional.aligned(a, a, ["id", "v"]).iguales == 4 and positional.aligned(a, b, []).mismo_orden
    assert tuple(positional.strict(a, b, ["id"]).first()) == (1, 3, 0, 0)
    with pytest.raises(ValueError, match="strict"):
        positional.aligned_rows(a, b, ["id"], most_rows=2)


def test_fuzzy_limits(spark, pair):
    found, note = fuzzy.suggestions(compared(pair, fuzzy_enabled=True, fuzzy_threshold=0.7))
    assert found.first()["Baja en Archivo 1"] in ("L-1", "L-4") and note == ""
    assert fuzzy.suggestions(compared(pair))[0] is None
    assert "superan" in fuzzy.suggestions(compared(pair, fuzzy_enabled=True), most_pairs=1)[1]


SERVER = ["Nombre Servidor", "Marca", "Modelo", "Sistema Operativo", "Firmware UEFI", "IP Relacionada", "Serial", "Ambiente", "DataCenter", "Servicios", "Estado", "Descripcion"]


def test_rules_find_columns(spark):
    row = dict.fromkeys(SERVER, "X") | {"IP Relacionada": "2001:db8::1", "Ambiente": "PRODUCCION", "Estado": "ACTIVO"}
    df = spark.createDataFrame([(2, *row.values())], "fila long, " + ", ".join(f"`{c}` string" for c in row))
    assert rules.validate("Infraestructura", df).where("severidad = 'error'").count() == 0
    assert "Modelo" in rules.validate("Infraestructura", df.drop("Modelo")).first().mensaje
    assert rules.validate("Infraestructura", df.withColumn("IP Relacionada", F.lit("10.0.0.256"))).where("regla = 'INF5'").count() == 1
    assert rules.score("Infraestructura", df).first().score == 50.0 and rules.score("Dominios", df) is None


def test_rule_contract(spark):
    df = spark.createDataFrame([(2, "x", None)], "fila long, Estado string, Pais string")
    refs = {"aplicaciones": spark.createDataFrame([("App Uno",)], "nombre string"), "usuarios": spark.createDataFrame([("ana@empresa.com",)], "email string")}
    for name in [*rules.RULE_SETS, "General"]:
        for r in rules.validate(name, df, refs).collect():
            assert r.mensaje.startswith(("Fila 2:", "Columna ", "Nivel ")) and r.severidad in (rules.ERROR, rules.WARNING)
    assert rules.validate("General", df).count() == 0


def test_verdicts(spark):
    df = spark.createDataFrame([(90.0,), (75.0,), (0.0,)], "s double")
    assert [tuple(r) for r in df.select(quality.verdict(F.col("s")), quality.light(F.col("s")), quality.effective_score(F.col("s"), F.lit(50.0))).collect()] == [("Conforme", "verde", 90.0), ("Advertencia", "amarillo", 75.0), ("Rechazado", "rojo", 50.0)]


def workbook() -> bytes:
    rows = [["Reporte"], ["Serial", "Responsable", "Costo", "Grupo", None], ["00123", "a@b.com", 10.5, "Red"], ["00124", "c@d.com", 3, None]]
    raw = xlsx.write_workbook({"Datos": (["Reporte"], [tuple(r) for r in rows[1:]]), "Otra": (["a"], [(True,)])})
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as src, zipfile.ZipFile(out, "w") as dst:
        for name in src.namelist():
            data = src.read(name).decode()
            if name == "xl/worksheets/sheet1.xml":
                data = data.replace("<sheetData>", '<cols><col min="3" max="3" hidden="1"/></cols><sheetData>').replace('<row r="4">', '<row r="4" hidden="1">').replace("</sheetData>", '</sheetData><autoFilter ref="A2:D4"/><mergeCells><mergeCell ref="A1:D1"/><mergeCell ref="D3:D4"/></mergeCells>')
            if name == "xl/workbook.xml":
                data = data.replace('name="Otra"', 'name="Otra" state="hidden"')
            dst.writestr(name, data)
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    path = str(tmp_path / "libro.xlsx")
    (tmp_path / "libro.xlsx").write_bytes(workbook())
    info = tables.sheet_info(spark, path)
    assert [(s["nombre"], s["visible"]) for s in info] == [("Datos", True), ("Otra", False)] and tables.default_sheet(info) == "Datos"
    df, warnings = tables.load_table(spark, path, tables.ReadOptions(header_row=2))
    assert [(r.fila, r.Serial, r.Costo) for r in df.orderBy("fila").collect()] == [(3, "00123", "10.5"), (4, "00124", "3")]
    assert {"Celdas combinadas", "Columnas ocultas o colapsadas", "Filas ocultas, filtradas o colapsadas", "Filtro activo"} <= {w["titulo"] for w in warnings}
    df, _ = tables.load_table(spark, path, tables.ReadOptions(header_row=2, fill_merged=True))
    assert [r.Grupo for r in df.orderBy("fila").collect()] == ["Red", "Red"]
    df, _ = tables.load_table(spark, path, tables.ReadOptions(header_row=2, skip_hidden_rows=True, skip_hidden_cols=True))
    assert df.count() == 1 and "Costo" not in df.columns
    df, _ = tables.load_table(spark, path, tables.ReadOptions(sheet="Otra"))
    assert df.first().a == "Sí"
    with pytest.raises(FileLoadError, match="no existe"):
        tables.load_table(spark, path, tables.ReadOptions(sheet="Nada"))
    spark.dataSource.register(xlsx.XlsxDataSource)
    assert spark.read.format("tablewright_xlsx").option("path", path).option("sheet", "Datos").option("columns", "4").load().count() == 4


def test_friendly_errors(spark, tmp_path):
    for name, data, words in (("informe.pdf", b"x", "formato no soportado"), ("malo.xlsx", b"x", "no es un libro de Excel"), ("vacio.csv", b"", "está vacío"), ("roto.csv", b"a,b\n1,2\n1,2,3,4\n", "línea 3 .*columnas"), ("viejo.xls", b"x", "no es un libro de Excel")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(FileLoadError, match=words) as e:
            tables.load_table(spark, str(tmp_path / name))
        assert e.value.suggestion
    assert "dañado" in to_friendly_error(ValueError("x")).suggestion and "columna a" in friendly_message(KeyError("a"), "comparar")[0]
    with pytest.raises(FileLoadError, match="No se encuentra") as e:
        tables.load_table(spark, str(tmp_path / "nada.csv"))
    assert e.value.technical
    try:
        spark.range(1).select("nada").collect()
    except Exception as exc:
        assert "falta la columna" in friendly_message(exc, "comparar")[0]


ODD_CSV = [
    "\n".join(["id,texto", *[f'{i},"valor, {i} ñ"' for i in range(500)], "", "x,"]).encode("cp1252"),
    b'\xef\xbb\xbfa;b\r\n1;"x\r\ny ""z"""\r\n\r\n2;"p;q"\r\n3;5" pipe\r\n4\r\n5; "s"t\r\n6;\xc3\xb1',
    "\n".join(["a,b", *[f'{i},"line\n\nof {i}, ""quoted"" \n end"' for i in range(300)], "9,x"]).encode(),
    b"\n\na|b\n1|2\n" + b"\n".join(b"%d|plain" % i for i in range(400)) + b"\n7|late \xe9\n",  # the only byte that isn't UTF-8
    b"a\tb\n1\t\x81\xe9\n",
    b"a;b\r1;2\r3;\"4\r5\"\r",
    ("id,t\n" + '1,"' + "long\n" * 2000 + '"\n2,b\n').encode(),
]


@pytest.mark.parametrize("raw", ODD_CSV, ids=range(len(ODD_CSV)))
def test_csv_is_read_alike_at_every_size(spark, tmp_path, monkeypatch, raw):
    (tmp_path / "g.csv").write_bytes(raw)
    small, said = tables.load_table(spark, str(tmp_path / "g.csv"))
    monkeypatch.setattr(tables, "DRIVER_BYTES", 0)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # records cross partitions
    try:
        large, again = tables.load_table(spark, str(tmp_path / "g.csv"))
        assert large.rdd.getNumPartitions() > 1 or len(raw) < 2000
        assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert small.columns == large.columns and said == again and small.count() > 0
    uploaded, _ = tables.load_bytes(spark, "g.csv", raw)
    assert sorted(map(tuple, uploaded.collect()), key=str) == sorted(map(tuple, small.collect()), key=str)


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_faulty_csv_names_the_line(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(tables, "DRIVER_BYTES", limit)
    (tmp_path / "r.csv").write_text('a,b\n1,"x\ny"\n1,2,3\n')
    with pytest.raises(FileLoadError, match="línea 4 trae 3"):
        tables.load_table(spark, str(tmp_path / "r.csv"))
    (tmp_path / "q.csv").write_text('a,b\n1,2\n1,"never\nclosed\n')
    with pytest.raises(FileLoadError, match="línea 3"):
        tables.load_table(spark, str(tmp_path / "q.csv"))[0].collect()


def test_headers_and_lists():
    assert tables.unique_headers(["a", "", "a", None])[0] == ["a", "Columna_2", "a (2)", "Columna_4"]
    assert tables.unique_headers(["a", "a (2)", "a", "a"])[0] == ["a", "a (2)", "a (3)", "a (4)"]
    assert tables.ranges([1, 2, 3, 7, 8]) == ["1-3", "7-8"] and tables.listed(range(8)) == "0, 1, 2, 3, 4, 5 y 2 más"
    assert csv_text.separator("a;b\n1;2") == ";" and xlsx.letters(28) == "AB" and xlsx.place("AB3") == (3, 28)
    assert csv_text.separator("a;b;c\n1,5;2,5;3,5\n1,5;2;3") == ";" and csv_text.separator("sola\nuna") == ","
    assert csv_text.separator('a,b\n"x;y;z",2\n"p;q;r",3') == "," and csv_text.charset(b"\x81") == "latin-1"


def test_reports(pair, tmp_path):
    c = compared(pair)
    assert writers.csv_bytes(c.states()).startswith(b"\xef\xbb\xbfestado,n")
    book = writers.excel_report(c)
    assert [s["nombre"] for s in xlsx.catalogue(book)][:3] == ["Resumen", "Consolidado", "Detalle diferencias"]
    writers.write_report(c, str(tmp_path / "r"))
    assert (tmp_path / "r" / "Altas").is_dir()


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.create()
    s.seed()
    s.upsert("aplicaciones", [("Aplicación Uno", "1.1", "Pruebas", "X"), ("Aplicación Uno", "1.2", "Pruebas", "X")])
    assert {r.nombre: r.version for r in s.names("aplicaciones").collect()} == {"Aplicación Dos": "2.0", "Aplicación Tres": "3.0", "Aplicación Uno": "1.2"}
    ids = [s.add_history("Cuentas", None, "b.csv", 91.5, 10, 0, 1) for _ in range(2)]
    assert ids[0] < ids[1] and s.history(1).first().id == ids[1] and s.history().count() == 2
    s.create()
    assert s.history().count() == 2
    s.clear()
    assert s.table("aplicaciones").count() == 0 and s.table("usuarios").count() == 3 and s.table("proveedores").count() == 0


def test_hot_keys_are_numbered_in_slices(spark, monkeypatch):
    from tablewright.operators import occurrence

    monkeypatch.setattr(occurrence, "CALM", 50)
    rows = [("hot", i * 3) for i in range(500)] + [(f"k{i % 20}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, at long").repartition(5)
    got = {(r.k, r.at): r.occ for r in occurrence.number_within(df, ["k"], "at", "occ").collect()}
    for k in {k for k, _ in rows}:
        assert [got[k, at] for at in sorted(a for x, a in rows if x == k)] == list(range(1, sum(x == k for x, _ in rows) + 1))


def test_roles_are_disjoint(pair):
    from tablewright.operators.compare import column_sets, disjoint

    assert disjoint(["a", "a"], ["a", "b", "c", "b"], ("c", "a")) == (["a"], ["b"], ["c"], {"a": "clave", "c": "excluida"})
    old, new = pair[2]
    c = Comparison(old, new, ["ID"], ["ID", "Nombre", "Auditoria"], CompareOptions(excluded=("Auditoria",)))
    assert c.columns == ["Nombre"] and c.moved == {"ID": "clave", "Auditoria": "excluida"}
    assert column_sets(old, new.drop("Pais").withColumnRenamed("Nombre", "Otro"))[1:] == (["Nombre", "Pais"], ["Otro"])
    said = CompareOptions(ignore_case=True, numeric_tolerance=0.5, excluded=("x",)).describe()
    assert "mayúsculas" in said and "0.5" in said and "x" in said and "cada signo" in CompareOptions(ignore_spaces=False).describe()


def test_views_of_states_and_kinds(pair):
    from tablewright.operators.compare import of_kinds

    c = compared(pair)
    assert {r.Estado for r in c.shown().collect()} == {"Alta", "Baja", "Modificación"} and c.shown(["Alta"]).count() == 1
    old = pair[2][0]
    assert Comparison(old, old, ["ID"], ["Nombre"]).shown().count() == 5  # nothing but the unchanged
    assert of_kinds(c.details()).count() == c.details().count() > of_kinds(c.details(), [similarity.ACCENTS]).count()


def test_exports(pair, tmp_path):
    from tablewright.sources.writers import cleaned_files, section_files, write_cleaned

    df = pair[2][0]
    found = cleaned_files(df, "inventario.v2.csv")
    assert list(found) == ["inventario.v2_limpio.xlsx", "inventario.v2_limpio.csv"] and xlsx.catalogue(found["inventario.v2_limpio.xlsx"])[0]["nombre"] == "Datos"
    assert write_cleaned(df, str(tmp_path), "a.xlsx").endswith("/a_limpio.csv") and (tmp_path / "a_limpio.csv").is_dir()
    c = compared(pair)
    detail = positional.aligned(pair[2][0], pair[2][1], ["Nombre"]).detalle
    assert {"altas.csv", "bajas.csv", "modificaciones.csv", "diferencias.csv", "repeticiones.csv", "orden.csv"} <= set(section_files(c, positions=detail))


def test_workspace_follows_its_files(spark, tmp_path, monkeypatch):
    from tablewright.sources import cache

    path = tmp_path / "a.csv"
    path.write_text("id,v\n1,x\n")
    w = cache.Workspace(spark)
    first = w.load(str(path))[0]
    assert w.load(str(path))[0] is first and w.clean(str(path)) is w.clean(str(path)) and first.is_cached
    assert w.load(str(path), tables.ReadOptions(header_row=2))[0] is not first
    path.write_text("id,v\n1,x\n2,y\n")
    assert w.load(str(path))[0].count() == 2
    kinds = {"id": schema.ID, "v": schema.TEXT}
    (tmp_path / "b.csv").write_text("id,v\n1,X\n2,y\n")
    one = w.compare(str(path), str(tmp_path / "b.csv"), kinds, ["id"], ["v"])
    assert w.compare(str(path), str(tmp_path / "b.csv"), kinds, ["id"], ["v"]) is one
    other = w.compare(str(path), str(tmp_path / "b.csv"), kinds, ["id"], ["v"], CompareOptions(ignore_case=True))
    assert one.totals().first().modificaciones == 1 and other.totals().first().modificaciones == 0
    kept = cache.Kept(2)
    frames = [spark.range(i + 1) for i in range(3)]
    for i, f in enumerate(frames):
        kept.get(i, lambda f=f: (f, f))
    assert not frames[0].is_cached and frames[2].is_cached
    for x in (kept, w.tables, w.comparisons):
        x.clear()
    assert not frames[2].is_cached


def test_messages_name_columns():
    assert rules.plain("País ÑANDÚ ≥ 1") == "pais nandu  1" and rules.mentions("Fila 2: País 'X' no permitido", "pais")
    assert not rules.mentions("Fila 2: Paisaje", "País") and rules.mentions("Columna Cantidad Total: 5%", "cantidad total")


def test_inference_over_files_and_overrides(spark):
    a = spark.createDataFrame([(i, f"{i},5", " ", "0012") for i in range(2, 9)], "fila long, monto string, vacio string, nota string")
    b = spark.createDataFrame([(i, "n/d", None, "x") for i in range(2, 4)], "fila long, monto string, nuevo string, nota string")
    got = {r["Columna"]: r for r in schema.infer_schema(a, b, overrides={"vacio": schema.DATE})}
    assert list(got) == ["monto", "vacio", "nota", "nuevo"] and got["monto"]["Ejemplos"] == "2,5 | 3,5 | 4,5"
    assert got["nota"]["Tipo detectado"] == schema.ID and got["vacio"]["Tipo detectado"] == schema.TEXT and got["vacio"]["Tipo de dato"] == schema.DATE and got["nuevo"]["Vacíos"] == 2
    with pytest.raises(ValueError, match="otra"):
        schema.infer_schema(a, overrides={"otra": schema.TEXT})
    wide = spark.range(2000).selectExpr("id + 2 AS fila", "CASE WHEN id < 500 THEN '7' ELSE 'texto' END AS c")
    assert schema.infer_schema(wide.repartition(6))[0]["Tipo detectado"] == schema.INTEGER  # of the first 500 values


def test_unfit_cells_and_preview(spark):
    df = spark.createDataFrame([(2, "1", "si"), (3, "x", "quizás"), (4, None, "no")], "fila long, n string, b string")
    kinds = {"n": schema.INTEGER, "b": schema.BOOLEAN}
    assert sorted(map(tuple, schema.unfit_cells(df, kinds).collect())) == [(3, "b", schema.BOOLEAN, "quizás"), (3, "n", schema.INTEGER, "x")]
    assert [sorted(r["__no_validas"]) for r in schema.cast_preview(df, kinds, n=2).orderBy("fila").collect()] == [[], ["b", "n"]]
    assert schema.unfit_cells(df, {}).count() == 0 and schema.apply_schema(df, {})[1].count() == 0


def test_fuzzy_blocks_give_the_same(spark):
    words = spark.createDataFrame([(i, str(i), f"servidor {i % 37} zona {i % 11}") for i in range(90)], "fila long, clave string, registro string")
    old, new = (words.where(f"fila % 2 = {k}").toDF(*[f"{t}_{c}" for c in words.columns]) for k, t in ((0, "a"), (1, "b")))
    whole = sorted(map(tuple, fuzzy.best_matches(old, new, similarity.LEVENSHTEIN, 0.8).collect()))
    assert sorted(map(tuple, fuzzy.best_matches(old, new, similarity.LEVENSHTEIN, 0.8, block=7).collect())) == whole and len(whole) > 20


def test_positions_by_any_order(spark):
    df = spark.range(300).selectExpr("id * 7 % 300 AS fila", "concat('k', lpad(id * 7 % 300, 4, '0')) AS s", "CAST(NULL AS INT) AS nada").repartition(5)
    for order in ("fila", "s"):
        got = positional.numbered(df, order).collect()
        assert [r.pos for r in sorted(got, key=lambda r: r[order])] == list(range(1, 301))
    assert sorted(r.pos for r in positional.numbered(df, "nada").collect()) == list(range(1, 301)) and positional.numbered(df.limit(0), "fila").count() == 0


def test_repeated_users_may_be_mostly_null(spark):
    rows = [(i, None) for i in range(50)] + [(60, "a"), (61, "a "), (62, "b"), (63, "#1")]
    df = spark.createDataFrame([(i, "Cuenta uno", u, "ACTIVO") for i, u in rows], "fila long, `Nombre cuenta` string, Usuario string, Estado string")
    again = sorted(r.fila for r in rules.validate("Cuentas", df).where("regla = 'CUE2'").collect())
    assert again == [*range(50), 60, 61]
    assert rules.validate("Cuentas", df.where("fila >= 49")).where("regla = 'CUE2'").count() == 2


def test_repeated_keys_may_be_hot(spark, monkeypatch):
    rows = [(None, 1)] * 300 + [("a", 1)] * 2 + [("b", 1), ("b", 2), ("c", None), ("c", None)]
    df = spark.createDataFrame(rows, "k string, n int").repartition(4)
    whole = sorted(map(str, quality.repeated_keys(df, ["k", "n"]).collect()))
    monkeypatch.setattr(quality, "CALM", 10)
    assert sorted(map(str, quality.repeated_keys(df, ["k", "n"]).collect())) == whole and len(whole) == 304


def old_workbook(sheets, texts, small=False):
    """A compound file with a BIFF8 workbook: sheets are (name, state, records), texts the shared ones, cut every 50 bytes."""
    import struct

    record = lambda kind, data: struct.pack("<HH", kind, len(data)) + data
    bof = record(0x809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
    parts, own = [], struct.pack("<II", len(texts), len(texts))
    for t in texts:
        wide = any(ord(c) > 255 for c in t)
        if len(own) + 3 > 50:
            parts.append(own)
            own = b""
        own += struct.pack("<HB", len(t), wide)
        for k, c in enumerate(t):
            if len(own) + 2 > 50 and k:
                parts.append(own)
                wide = any(ord(x) > 255 for x in t[k:])  # each piece says its own width
                own = bytes([wide])
            own += c.encode("utf-16-le") if wide else c.encode("latin-1")
    parts.append(own)
    head = bof + record(0x41E, struct.pack("<HHB", 164, 10, 0) + b"yyyy-mm-dd") + b"".join(record(0xE0, struct.pack("<HH", 0, f) + bytes(16)) for f in (0, 164, 14))
    head += record(0xFC, parts[0]) + b"".join(record(0x3C, p) for p in parts[1:])
    names = [struct.pack("<BBBB", state, 0, len(name), 0) + name.encode("latin-1") for name, state, _ in sheets]
    at = len(head) + sum(8 + len(n) for n in names) + 4
    table, bodies = b"", b""
    for n, (_, _, rows) in zip(names, sheets, strict=True):
        table += record(0x85, struct.pack("<I", at + len(bodies)) + n)
        bodies += bof + b"".join(record(k, d) for k, d in rows) + record(0x0A, b"")
    stream = head + table + record(0x0A, b"") + bodies
    if not small:
        stream = stream.ljust(5000, b"\0")
    sectors = [stream[k : k + 512].ljust(512, b"\0") for k in range(0, len(stream), 512)]
    n = len(sectors)
    links = [*range(1, n), 0xFFFFFFFE]
    entry = lambda name, kind, start, size: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + bytes(36) + struct.pack("<III", start, size, 0)
    root = entry("Root Entry", 5, 0 if small else 0xFFFFFFFE, n * 512 if small else 0)
    folder = (root + entry("Workbook", 2, 0, len(stream))).ljust(512, b"\0")
    chain = struct.pack(f"<{8 * n}I", *range(1, 8 * n), 0xFFFFFFFE).ljust(512, b"\xff") if small else b""
    links += [0xFFFFFFFE, *([0xFFFFFFFE] if small else []), 0xFFFFFFFD]
    fat = struct.pack(f"<{len(links)}I", *links).ljust(512, b"\xff")
    place = n + 1 + small
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIII", 0, 1, n, 0, 4096) + struct.pack("<IIII", n + 1 if small else 0xFFFFFFFE, int(small), 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", place, *[0xFFFFFFFF] * 108) + b"".join(sectors) + folder + chain + fat


@pytest.mark.parametrize("small", [False, True])
def test_old_workbooks(spark, tmp_path, small):
    import struct

    texts = ["Código", "Nombre", "Costo", "Alta", "00123", "Camión ≥ " + "largo " * 30, "Ñandú " * 20, "fin", "x" * 47, "日本語" * 20]
    label = lambda r, c, k: (0xFD, struct.pack("<HHHI", r, c, 0, k))
    rows = [label(0, c, c) for c in range(4)]
    rows += [label(1, 0, 4), label(1, 1, 5), (0x203, struct.pack("<HHHd", 1, 2, 0, 10.5)), (0x203, struct.pack("<HHHd", 1, 3, 1, 45306.0))]
    rows += [label(2, 0, 6), label(2, 1, 9), (0xBD, struct.pack("<HHHIHIH", 2, 2, 0, (1234 << 2) | 3, 2, (45306 << 2) | 2, 3))]
    rows += [(0x205, struct.pack("<HHHBB", 4, 0, 0, 1, 0)), (0x06, struct.pack("<HHH", 4, 1, 0) + b"\0" * 6 + b"\xff\xff" + bytes(6)), (0x207, struct.pack("<HB", 6, 0) + b"Hecho!"), (0x27E, struct.pack("<HHHI", 4, 2, 0, (0xFFFFFFFF << 2 & 0xFFFFFFFF) | 2)), (0x205, struct.pack("<HHHBB", 4, 3, 0, 7, 1))]
    rows += [(0x06, struct.pack("<HHHd", 5, 2, 0, 7.25) + bytes(6)), (0x204, struct.pack("<HHHHB", 5, 0, 0, 3, 0) + b"abc")]
    raw = old_workbook([("Datos", 0, rows), ("Oculta", 1, [label(0, 0, 7), label(1, 0, 8)])], texts, small)
    (tmp_path / "v.xls").write_bytes(raw)
    path = str(tmp_path / "v.xls")
    assert [(s["nombre"], s["visible"]) for s in tables.sheet_info(spark, path)] == [("Datos", True), ("Oculta", False)]
    df, said = tables.load_table(spark, path)
    assert df.columns == ["fila", *texts[:4]] and "Formato Excel antiguo (.xls)" in {w["titulo"] for w in said}
    assert sorted(map(tuple, df.collect())) == [
        (2, "00123", texts[5].strip() + " ", "10.5", "2024-01-15 00:00:00"), (3, texts[6], texts[9], "12.34", "2024-01-15 00:00:00"), (4, None, None, None, None), (5, "True", "Hecho!", "-1", None), (6, "abc", None, "7.25", None),
    ]
    other, _ = tables.load_bytes(spark, "v.xls", raw, tables.ReadOptions(sheet="Oculta"))
    assert [r.fin for r in other.collect()] == ["x" * 47]
    with pytest.raises(FileLoadError, match="hoja"):
        tables.load_table(spark, path, tables.ReadOptions(sheet="Nada"))
