"""Pairs of snapshots and views with every kind of defect, made from whole tables.

Views are SQL that Spark and DuckDB both read, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The result of a statement over tables of a folder; table names are replaced, no view is registered."""
    frames = {f"t_{t}": spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        sql = sql.replace(f"FROM {t}", "FROM {t_" + t + "}")
    return spark.sql(sql, **frames)


# Orders: a twentieth goes, another comes; prices move by half a cent or five, priorities change their form.
ORDERS_OLD = "SELECT o_orderkey AS fila, o_orderkey, o_totalprice, o_orderpriority, o_orderdate FROM orders WHERE o_orderkey % 20 <> 0"
ORDERS_NEW = """SELECT o_orderkey AS fila, o_orderkey,
 CASE WHEN o_orderkey % 10 = 3 THEN o_totalprice + CAST(0.005 AS DOUBLE) WHEN o_orderkey % 10 = 4 THEN o_totalprice + CAST(5 AS DOUBLE) ELSE o_totalprice END AS o_totalprice,
 CASE WHEN o_orderkey % 15 = 7 THEN lower(o_orderpriority) WHEN o_orderkey % 15 = 8 THEN replace(o_orderpriority, '-', '  - ') WHEN o_orderkey % 15 = 9 THEN replace(o_orderpriority, 'E', 'É') ELSE o_orderpriority END AS o_orderpriority,
 o_orderdate FROM orders WHERE o_orderkey % 20 <> 1"""
# Events: keys repeat, so rows meet by occurrence.
EVENTS_OLD = "SELECT event_id AS fila, user_id, event_type, value FROM events WHERE event_id % 20 <> 0"
EVENTS_NEW = "SELECT event_id AS fila, user_id, event_type, CASE WHEN event_id % 10 = 3 THEN value + CAST(0.005 AS DOUBLE) WHEN event_id % 10 = 4 THEN value + CAST(5 AS DOUBLE) ELSE value END AS value FROM events WHERE event_id % 20 <> 1"
# Customers: removed and added ones resemble each other.
CUSTOMERS_OLD = "SELECT c_custkey AS fila, c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 20 <> 0"
CUSTOMERS_NEW = "SELECT c_custkey AS fila, c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 20 <> 1"

# Orders with blanks, an empty row in each hundred, and every seventh row twice.
DIRTY = """SELECT o_orderkey * 2 AS fila, CASE WHEN o_orderkey % 100 = 99 THEN NULL ELSE ' ' || o_orderstatus || ' ' END AS estado, CASE WHEN o_orderkey % 100 = 99 THEN '  ' WHEN o_orderkey % 5 = 1 THEN '' ELSE o_orderpriority || '  ' END AS prioridad, CASE WHEN o_orderkey % 100 = 99 THEN NULL ELSE CAST(o_orderkey AS VARCHAR(20)) END AS codigo FROM orders
UNION ALL SELECT o_orderkey * 2 + 1 AS fila, CASE WHEN o_orderkey % 100 = 99 THEN NULL ELSE o_orderstatus END AS estado, CASE WHEN o_orderkey % 100 = 99 THEN '' WHEN o_orderkey % 5 = 1 THEN ' ' ELSE o_orderpriority END AS prioridad, CASE WHEN o_orderkey % 100 = 99 THEN NULL ELSE CAST(o_orderkey AS VARCHAR(20)) END AS codigo FROM orders WHERE o_orderkey % 7 = 0"""

_WHOLE = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(20))"
_CENTS = "lpad(CAST(CAST(floor(o_totalprice * 100) AS BIGINT) % 100 AS VARCHAR(2)), 2, '0')"
#: Prices as people write them: by decimal comma and by decimal point, with signs, units and nonsense between.
PRICES = f"""SELECT o_orderkey AS fila,
 CASE o_orderkey % 9 WHEN 0 THEN '$ ' || {_WHOLE} WHEN 1 THEN {_WHOLE} || '%' WHEN 2 THEN '12 meses' WHEN 3 THEN '1.' || lpad({_WHOLE}, 6, '0') || ',5' WHEN 4 THEN '' WHEN 5 THEN '1.234.567' WHEN 6 THEN '12.345' WHEN 7 THEN '0.125' ELSE {_WHOLE} || ',' || {_CENTS} END AS coma,
 CASE o_orderkey % 9 WHEN 0 THEN '$ ' || {_WHOLE} WHEN 1 THEN {_WHOLE} || '%' WHEN 2 THEN 'n/d' WHEN 3 THEN '1,234,567.5' WHEN 4 THEN NULL WHEN 5 THEN '1,234,567' WHEN 6 THEN '12,345' WHEN 7 THEN '-0.125' ELSE {_WHOLE} || '.' || {_CENTS} END AS punto FROM orders"""

_Y, _M, _D = ("CAST(year(o_orderdate) AS VARCHAR(4))", "lpad(CAST(month(o_orderdate) AS VARCHAR(2)), 2, '0')", "lpad(CAST(day(o_orderdate) AS VARCHAR(2)), 2, '0')")
#: Dates as people write them.
DATES = f"""SELECT o_orderkey AS fila, CASE o_orderkey % 8 WHEN 0 THEN {_Y} || '-' || {_M} || '-' || {_D} WHEN 1 THEN {_D} || '/' || {_M} || '/' || {_Y} WHEN 2 THEN {_D} || '-' || {_M} || '-' || {_Y} || ' 10:30' WHEN 3 THEN {_Y} || {_M} || {_D} WHEN 4 THEN {_Y} || '-' || {_M} || '-' || {_D} || 'T08:05:09' WHEN 5 THEN '45123' WHEN 6 THEN 'sin fecha' ELSE {_D} || '.' || {_M} || '.' || {_Y} END AS fecha FROM orders"""
DATED_OLD = f"SELECT o_orderkey AS fila, o_orderkey, {_Y} || '-' || {_M} || '-' || {_D} AS fecha FROM orders"
DATED_NEW = f"SELECT o_orderkey AS fila, o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN '01/01/1980' ELSE {_D} || '/' || {_M} || '/' || {_Y} END AS fecha FROM orders"

#: Customers as a text table of every type.
TYPED = """SELECT c_custkey AS fila, CAST(c_custkey AS VARCHAR(20)) AS id, c_name AS nombre, CASE WHEN c_custkey % 9 = 4 THEN 'sin correo' ELSE 'Mailto:user' || CAST(c_custkey AS VARCHAR(20)) || '@Example.COM' END AS correo,
 CASE WHEN c_custkey % 11 = 5 THEN 'n/d' ELSE CAST(c_nationkey AS VARCHAR(20)) END AS pais_num, CASE WHEN c_custkey % 13 = 6 THEN '' ELSE CAST(c_nationkey AS VARCHAR(20)) || ',5' END AS saldo, CASE WHEN c_custkey % 7 = 3 THEN 'quizás' WHEN c_custkey % 2 = 0 THEN 'Sí' ELSE 'no' END AS activo FROM customer"""
SCHEMA = {"id": "Identificador / Código", "nombre": "Texto", "correo": "Email", "pais_num": "Entero", "saldo": "Decimal (Float)", "activo": "Booleano (Sí/No)"}

# ---------------------------------------------------------------- views for the rule sets

LICENCES = """SELECT o_orderkey AS fila, CASE o_orderkey % 5 WHEN 0 THEN 'App Dos' WHEN 1 THEN NULL ELSE 'App Uno' END AS `Producto asociado`,
 CASE o_orderkey % 7 WHEN 0 THEN 'mal correo' WHEN 1 THEN NULL WHEN 2 THEN 'otro@empresa.com' ELSE 'Ana@Empresa.com' END AS `Responsable / Correo`,
 CASE o_orderkey % 6 WHEN 0 THEN 'Brasil' WHEN 1 THEN 'tranversal' WHEN 2 THEN NULL ELSE 'Perú' END AS `Pais`,
 CAST(o_orderkey % 11 - 1 AS DOUBLE) AS `Cantidad Total`, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 9 - 1 AS DOUBLE) END AS `Cantidad Asignadas`, CAST(o_orderkey % 4 AS DOUBLE) AS `Cantidad Disponible`,
 CASE o_orderkey % 8 WHEN 0 THEN 'ayer' WHEN 1 THEN NULL WHEN 2 THEN '2031-01-01' ELSE '2024-01-15' END AS `Fecha Compra`, '2030-06-30' AS `Fecha Vencimiento`,
 CASE o_orderkey % 3 WHEN 0 THEN 'ftp://x' WHEN 1 THEN 'https://example.com/a' ELSE NULL END AS `Enlace Contrato` FROM orders"""
DOMAINS = """SELECT o_orderkey AS fila, CASE o_orderkey % 4 WHEN 0 THEN 'sin punto' WHEN 1 THEN 'a.example.com' WHEN 2 THEN NULL ELSE 'x_y.com' END AS `Dominio`, CASE o_orderkey % 3 WHEN 0 THEN 'App Uno' WHEN 1 THEN 'app uno' ELSE NULL END AS `Activo Asociado`,
 CASE o_orderkey % 5 WHEN 0 THEN 'ana@empresa.com' WHEN 1 THEN NULL ELSE 'Ana@empresa.com' END AS `Responsable TI`, CASE o_orderkey % 6 WHEN 0 THEN 'tranversal' ELSE 'Chile' END AS `Pais`,
 CASE o_orderkey % 7 WHEN 0 THEN 'nunca' WHEN 1 THEN '31/12/2030' ELSE '01/02/2024' END AS `Fecha Inicio / Vencimiento`, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE '15/06/2030' END AS `Fecha Vencimiento` FROM orders"""
CERTIFICATES = """SELECT o_orderkey AS fila, CASE o_orderkey % 3 WHEN 0 THEN 'App Uno' WHEN 1 THEN 'Nada' ELSE NULL END AS `Activo asociado`, CASE o_orderkey % 5 WHEN 0 THEN 'DV' WHEN 1 THEN NULL ELSE 'OV' END AS `Tipo de Certificado`, CASE o_orderkey % 4 WHEN 0 THEN 'activo' ELSE 'Activo' END AS `Estado`,
 CASE o_orderkey % 6 WHEN 0 THEN 'pronto' WHEN 1 THEN NULL ELSE '2024-12-31' END AS `Fecha Vencimiento`, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(359 + o_orderkey % 9 AS DOUBLE) END AS `Dias Restantes`, CASE o_orderkey % 8 WHEN 0 THEN 'www.example.com' ELSE 'http://example.com' END AS `Enlace Certificado` FROM orders"""
ACCOUNTS = """SELECT o_orderkey AS fila, CASE o_orderkey % 6 WHEN 0 THEN 'ab' WHEN 1 THEN '-abc' WHEN 2 THEN NULL ELSE 'Cuenta Ñandú' END AS `Nombre cuenta`, CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'con espacio' || CAST(o_orderkey AS VARCHAR(20)) ELSE 'u' || CAST(o_orderkey - o_orderkey % 10 % 2 AS VARCHAR(20)) END AS `Usuario`,
 CASE o_orderkey % 5 WHEN 0 THEN 'Retirado' WHEN 1 THEN '' WHEN 2 THEN 'otro' ELSE 'activo' END AS `Estado`, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'TK-12' ELSE 'tk-123456' END AS `Ticket de Creacion de Usuario`, CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'X' ELSE 'TK-1234567' END AS `Ticket de Retiro de usuario`,
 CASE o_orderkey % 3 WHEN 0 THEN 'nueva' ELSE 'Retiro' END AS `Novedad`, CASE o_orderkey % 8 WHEN 0 THEN 'ALTO' WHEN 1 THEN NULL ELSE 'alta' END AS `Criticidad SI`, CASE o_orderkey % 9 WHEN 0 THEN 'a b' ELSE 'Sí' END AS `Datos Personales`, CASE o_orderkey % 11 WHEN 0 THEN 'AR' ELSE 'perú' END AS `Pais`,
 CASE o_orderkey % 12 WHEN 0 THEN 'corta' ELSE 'largalarga' END AS `Password Inicial`, CASE o_orderkey % 13 WHEN 0 THEN repeat('x', 501) WHEN 1 THEN NULL ELSE 'd' END AS `Descripcion`, CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE 'u' END AS `usuario 2026`, CASE o_orderkey % 14 WHEN 0 THEN '4' ELSE 'alto' END AS `Disponibilidad`, '2' AS `Integridad` FROM orders"""
USERS = """SELECT c_custkey AS fila, c_name AS `Nombre`, CASE c_custkey % 5 WHEN 0 THEN 'Activo' WHEN 1 THEN 'RETIRADO' WHEN 2 THEN 'otro' WHEN 3 THEN NULL ELSE 'suspendido' END AS `Estado`, CASE c_custkey % 4 WHEN 0 THEN 'x@y' ELSE 'a.b@example.com' END AS `Correo`, CASE c_custkey % 6 WHEN 0 THEN '12-3' ELSE '123' END AS `Documento`,
 CASE c_custkey % 7 WHEN 0 THEN 'TI' ELSE 'cc' END AS `Tipo Documento`, CASE c_custkey % 8 WHEN 0 THEN ' ' ELSE 'E' END AS `Empresa`, CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'TK1' ELSE 'TK-000001' END AS `Ticket Ingreso`, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'mal' ELSE 'tk-9999999' END AS `Ticket Retiro`,
 CASE c_custkey % 10 WHEN 0 THEN '57 1' WHEN 1 THEN NULL ELSE '+571' END AS `Telefono`, CASE c_custkey % 2 WHEN 0 THEN NULL ELSE 'G' END AS `Gerencia`, 'C' AS `Cargo`, CASE c_custkey % 11 WHEN 0 THEN 'a b' WHEN 1 THEN NULL ELSE '110' END AS `ZIP`, CASE c_custkey % 12 WHEN 0 THEN 'x' WHEN 1 THEN '1' ELSE NULL END AS `Telefono Alternativo` FROM customer"""
SERVERS = """SELECT c_custkey AS fila, CASE c_custkey % 9 WHEN 0 THEN 'srv 1' ELSE 'srv-1' END AS `Hostname`, 'M' AS `Marca`, CASE c_custkey % 10 WHEN 0 THEN NULL ELSE 'X' END AS `Modelo`, 'L' AS `SO`, 'F' AS `Firmware`, CASE c_custkey % 5 WHEN 0 THEN '10.0.0.256' WHEN 1 THEN '10.0.0.01' WHEN 2 THEN '2001:db8::1' WHEN 3 THEN '2001:db8::g' ELSE '10.0.0.1' END AS `IP`, 'S' AS `Serial`,
 CASE c_custkey % 4 WHEN 0 THEN 'QA' ELSE 'produccion' END AS `Ambiente`, 'D' AS `Data Center`, 'W' AS `Servicios`, CASE c_custkey % 6 WHEN 0 THEN 'SUSPENDIDO' ELSE 'Activo' END AS `Estado`, 'd' AS `Descripcion`, CASE c_custkey % 7 WHEN 0 THEN '0' WHEN 1 THEN 'dos' WHEN 2 THEN NULL ELSE '4' END AS `CPU`, CASE c_custkey % 3 WHEN 0 THEN '00:1A:2b:3c:4d' ELSE '00:1A:2b:3c:4d:5e' END AS `MAC`,
 CASE c_custkey % 8 WHEN 0 THEN NULL ELSE 'A' END AS `Antivirus`, CASE c_custkey % 2 WHEN 0 THEN 'sí' ELSE 'no' END AS `Tiene Soporte`, CASE c_custkey % 3 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '2024-02-28' ELSE NULL END AS `Vencimiento Soporte`, 'SI' AS `SO Parchable`, CASE c_custkey % 11 WHEN 0 THEN 'ALTO' ELSE 'Alta' END AS `Integridad`,
 CASE c_custkey % 12 WHEN 0 THEN ' ' ELSE 'P' END AS `Proveedor`, CASE c_custkey % 3 WHEN 0 THEN 'FISICO' WHEN 1 THEN 'Virtual' ELSE NULL END AS `Tipo Servidor`, CASE c_custkey % 4 WHEN 0 THEN 'SF_a' WHEN 1 THEN 'sv_b' WHEN 2 THEN 'otro' ELSE NULL END AS `Nombre CMDB`, CASE c_custkey % 13 WHEN 0 THEN 'r#1' ELSE 'R-1' END AS `Rack` FROM customer"""
APPLICATIONS = [("App Uno", "1", "Producción", "TI")]
PEOPLE = [("Ana", "ana@empresa.com", "TI", "Analista")]

#: Pairs of texts that differ in every way, with the kind of their difference.
DIFFERENCES = [
    ("Hola", "hola", "Mayúsculas/minúsculas"), ("Perú", "Peru", "Tildes/acentos"), ("Perú", "PERU", "Mayúsculas y tildes"), ("a  b", "a b", "Espacios en blanco"), ("Perú ", "peru", "Mayúsculas y tildes"), ("100,5", "x", "Texto distinto"),
    ("1.0", "1.005", "Numérico dentro de tolerancia"), ("1", "2", "Numérico distinto"), ("2024-01-15", "15/01/2024", "Formato de fecha/hora"), ("2024-01-15", "16/01/2024", "Fecha distinta"), (None, "x", "Valor faltante en un archivo"), (None, None, "Sin diferencia"), ("007", "7", "Sin diferencia"),
]
