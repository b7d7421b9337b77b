"""Business rules: six rule sets over one table, each a single scan, and three weighted scores.

Every rule is a predicate over a row; what it finds is a structured issue (fila, severidad, regla, columna, mensaje).  Shares
of blank cells over whole columns are observed while the issues of rows are written, so they cost no scan of their own.
Messages keep the form "Fila N: ...", "Columna ...: ..." or "Nivel ...: ...".
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.dates import in_iso_order, moment, parse_date
from tablewright.functions.numbers import to_double
from tablewright.functions.text import EMAIL, present, strip
from tablewright.operators.quality import repeated_keys
from tablewright.sources.files import stored

ERROR, WARNING = "error", "advertencia"
SCHEMA = "fila long, severidad string, regla string, columna string, mensaje string"

# Permitted values and patterns.
LICENCE_COUNTRIES = ["Colombia", "Perú", "Chile", "tranversal"]
DOMAIN_COUNTRIES = ["Colombia", "Perú", "Chile"]
CERTIFICATE_KINDS = ["OV", "EV", "Firma Digital", "Interno"]
CERTIFICATE_STATES = ["Activo", "Por Renovar", "Por vencer", "Vencido", "Inactivo"]
ACCOUNT_STATES = ["ACTIVO", "INACTIVO", "SUSPENDIDO", "RETIRADO"]
ACCOUNT_NEWS = ["CREACION", "MODIFICACION", "RETIRO", "SIN NOVEDAD"]
CRITICALITY = ["ALTA", "MEDIA", "BAJA", "CRITICA"]
ACCOUNT_CIA = ["ALTO", "MEDIO", "BAJO", "1", "2", "3"]
TRUTH = ["TRUE", "FALSE", "VERDADERO", "FALSO", "SI", "SÍ", "NO", "1", "0"]
ACCOUNT_COUNTRIES = ["CO", "COL", "COLOMBIA", "PA", "PANAMA", "PE", "PER", "PERU", "PERÚ", "CL", "CHL", "CHILE", "MX", "MEX", "MEXICO", "MÉXICO", "US", "USA", "ESTADOS UNIDOS"]
ID_KINDS = ["CC", "CE", "PASAPORTE", "NIT", "PEP"]
ENVIRONMENTS = ["PRODUCCION", "DESARROLLO", "PRUEBAS", "STAGING"]
SERVER_STATES = ["ACTIVO", "INACTIVO", "MANTENIMIENTO", "RETIRADO"]
SERVER_CIA = ["ALTA", "MEDIA", "BAJA", "CRITICA", "SI", "NO"]
YES = ["SI", "SÍ"]
URL = r"^https?://([-\w.]|%[\da-fA-F]{2})"
DOMAIN = r"^([a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}\z"
TICKET = r"(?i)^TK-[0-9]{6,}\z"
LOGIN = r"^[a-zA-Z0-9_.-]+\z"
MASK = r"^[A-Za-z0-9_./-]+\z"
PHONE = r"^\+?[0-9]+\z"
ALNUM = r"^[A-Za-z0-9]+\z"
CODE = r"^[A-Za-z0-9._/-]+\z"
HOST = r"^[A-Za-z0-9._-]+\z"
MAC = r"^[0-9A-Fa-f]{2}(:[0-9A-Fa-f]{2}){5}\z"
DAY = r"^\d{4}-\d{2}-\d{2}\z"
CMDB = r"(?i)^(SV|SF)_[A-Za-z0-9._-]+\z"
LABEL = r"^[A-Za-z0-9ÁÉÍÓÚáéíóúÑñ ._:/-]+\z"
IPV4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\z"

# Fields, the label first, then other names (accents, case and punctuation don't matter).
ACCOUNT_FIELDS = {
    "nombre": ("Nombre cuenta", "Nombre de cuenta", "Cuenta"),
    "usuario": ("Usuario", "Username", "Nombre usuario"),
    "estado": ("Estado",),
    "ticket_creacion": ("Ticket de Creación de Usuario", "Ticket Creacion Usuario"),
    "ticket_retiro": ("Ticket de Retiro de usuario", "Ticket Retiro Usuario", "Ticket de Retiro Usuario"),
    "novedad": ("Novedad",),
    "criticidad": ("Criticidad SI", "Criticidad"),
    "datos_personales": ("Datos Personales",),
    "pais": ("País",),
    "password": ("Password Inicial", "Contraseña Inicial"),
    "descripcion": ("Descripción",),
    "usuario_2026": ("usuario 2026",),
    "disponibilidad": ("Disponibilidad",),
    "confidencialidad": ("Confidencialidad",),
    "integridad": ("Integridad",),
}
ACCOUNT_LEVELS = {
    "alto": ["nombre", "usuario", "estado"],
    "medio": ["ticket_creacion", "ticket_retiro", "novedad", "criticidad", "datos_personales"],
    "bajo": ["pais", "password", "descripcion", "usuario_2026", "disponibilidad", "confidencialidad", "integridad"],
}
#: Share of nulls that a column may have; others none.
ACCOUNT_TOLERANCE = {"criticidad": 0.02, "datos_personales": 0.05, "pais": 0.10, "password": 1.0, "descripcion": 0.20, "usuario_2026": 0.15, "disponibilidad": 0.10, "confidencialidad": 0.10, "integridad": 0.10}
USER_FIELDS = {
    "nombre": ("Nombre", "Nombre usuario", "Nombre completo"),
    "estado": ("Estado",),
    "email": ("Correo Email", "Correo electrónico", "Email", "Correo"),
    "identificacion": ("Identificación", "Documento", "Número de identificación"),
    "tipo_identificacion": ("Tipo de Identificación", "Tipo Documento"),
    "empresa": ("Empresa Propietaria", "Empresa"),
    "ticket_ingreso": ("Ticket de Ingreso", "Ticket Ingreso", "Ticket de Creación", "Ticket Creacion"),
    "ticket_retiro": ("Ticket de Retiro", "Ticket Retiro"),
    "telefono": ("Teléfono Principal", "Teléfono"),
    "gerencia": ("Gerencia",),
    "cargo": ("Cargo",),
    "tipo_cargo": ("Tipo Cargo",),
    "lider": ("Líder Inmediato",),
    "grupo": ("Grupo",),
    "grupo_jira": ("Grupo Jira",),
    "tipo_usuario": ("Tipo Usuario",),
    "critico": ("Crítico",),
    "pais": ("País",),
    "direccion": ("Dirección",),
    "zip": ("ZIP", "Código Postal"),
    "telefono_alternativo": ("Teléfono Alternativo",),
    "nombre_contacto": ("Nombre Contacto",),
    "notificacion": ("Notificación",),
    "segmentacion": ("Segmentación",),
    "nivel": ("Nivel",),
    "id_sistema": ("ID de Sistema", "Id Sistema"),
    "id_cmdb": ("ID CMDB",),
    "notas_contacto": ("Notas de Contacto", "Notas Contacto"),
    "descripcion": ("Descripción",),
}
USER_LEVELS = {
    "alto": ["nombre", "estado", "email", "identificacion", "tipo_identificacion", "empresa"],
    "medio": ["ticket_ingreso", "ticket_retiro", "telefono", "gerencia", "cargo", "tipo_cargo", "lider", "grupo", "grupo_jira", "tipo_usuario", "critico"],
    "bajo": ["pais", "direccion", "zip", "telefono_alternativo", "nombre_contacto", "notificacion", "segmentacion", "nivel", "id_sistema", "id_cmdb", "notas_contacto", "descripcion"],
}
USER_ACTIVE = USER_LEVELS["medio"][3:]
SERVER_FIELDS = {
    "hostname": ("Nombre Servidor", "Hostname", "Nombre del Servidor"),
    "marca": ("Marca",),
    "modelo": ("Modelo",),
    "so": ("Sistema Operativo", "SO"),
    "firmware": ("Firmware UEFI", "Firmware"),
    "ip": ("IP Relacionada", "IP", "Dirección IP"),
    "serial": ("Serial", "Número de Serie", "UUID"),
    "ambiente": ("Ambiente", "Entorno"),
    "datacenter": ("DataCenter",),
    "servicios": ("Servicios", "Servicio"),
    "estado": ("Estado",),
    "descripcion": ("Descripción",),
    "cpu": ("CPU", "Procesadores", "Cantidad CPU"),
    "discos": ("Discos", "Cantidad Discos"),
    "espacio": ("Espacio Discos", "Espacio Disco", "Almacenamiento"),
    "ram": ("Memoria RAM", "RAM", "Memoria"),
    "mac": ("Dirección MAC", "MAC"),
    "antivirus": ("Antivirus",),
    "agentes": ("Agentes Instalados", "Agentes"),
    "soporte": ("Cuenta con Soporte", "Tiene Soporte"),
    "vencimiento_soporte": ("Fecha Vencimiento Soporte", "Vencimiento Soporte"),
    "parchable": ("SO Parchable", "Sistema Operativo Parchable"),
    "ultimo_parchado": ("Fecha Último Parchado", "Último Parchado"),
    "integridad": ("Integridad",),
    "disponibilidad": ("Disponibilidad",),
    "confidencialidad": ("Confidencialidad",),
    "criticidad": ("Criticidad SI", "Criticidad"),
    "obsolescencia": ("Obsolescencia",),
    "proveedor": ("Proveedor",),
    "area": ("Área Responsable",),
    "custodio": ("Custodio",),
    "empresa": ("Empresa Propietaria", "Empresa"),
    "tipo_servidor": ("Tipo Servidor", "Tipo de Servidor"),
    "segmento": ("Segmento Red", "Segmento de Red"),
    "aplicacion": ("Aplicación",),
    "lider": ("Líder Responsable",),
    "novedad": ("Novedad",),
    "os_build": ("OS Build", "Build SO"),
    "tickets": ("Tickets", "Ticket"),
    "nombre_cmdb": ("Nombre CMDB",),
    "rack": ("Rack",),
    "ubicacion": ("Ubicación Física", "Ubicación"),
    "dns": ("Nombre DNS", "DNS"),
    "rol": ("Rol del Servidor", "Rol Servidor"),
    "servicios_negocio": ("Servicios de Negocio",),
    "cluster": ("Cluster",),
    "virtualizador": ("Virtualizador",),
    "cambio": ("Control de Cambios", "Control Cambios"),
    "servidor_fisico": ("Servidor Físico Relacionado",),
    "licencia": ("Licencia",),
    "certificados": ("Certificados",),
}
SERVER_TEXT = ["proveedor", "area", "custodio", "empresa", "tipo_servidor", "segmento", "aplicacion", "lider", "novedad", "os_build", "tickets"]
SERVER_LEVELS = {
    "alto": ["hostname", "marca", "modelo", "so", "firmware", "ip", "serial", "ambiente", "datacenter", "servicios", "estado", "descripcion"],
    "medio": [
        "cpu", "discos", "espacio", "ram", "mac", "antivirus", "agentes", "vencimiento_soporte", "ultimo_parchado", "integridad", "disponibilidad", "confidencialidad", "criticidad", "obsolescencia",
        "proveedor", "area", "custodio", "empresa", "tipo_servidor", "segmento", "aplicacion", "lider", "novedad", "os_build", "tickets",
    ],
    "bajo": ["nombre_cmdb", "rack", "ubicacion", "dns", "rol", "servicios_negocio", "cluster", "virtualizador", "cambio", "servidor_fisico", "licencia", "certificados"],
}

# What the rules say ({}: the value or values in question).
SAYS = {
    "unknown_application": "Producto asociado '{}' no existe en aplicaciones", "bad_mail": "Formato de correo inválido: {}", "unknown_user": "Responsable '{}' no existe en usuarios", "country": "País '{}' no permitido",
    "negative": "{} no puede ser negativa", "over_total": "Cantidad Asignadas (%s) > Cantidad Total (%s)", "not_free": "Cantidad Disponible (%s) no coincide con cálculo (%s)", "late": "{} es posterior a Fecha Vencimiento", "bad_date": "Formato de fecha inválido",
    "bad_url": "URL inválida: {}", "bad_domain": "Formato de dominio inválido: {}", "unknown": "{} '{}' no existe", "not_permitted": "{} '{}' no permitido", "certificate_url": "URL inválida en Enlace Certificado",
    "days": "Días Restantes (%s) no coincide con cálculo (%s)", "certificate_date": "Formato de fecha inválido en Fecha Vencimiento", "again": "Usuario '{}' está repetido; debe ser único", "account_needs": "{} es obligatorio para el esquema Cuentas",
    "account_length": "Nombre cuenta debe tener entre 3 y 100 caracteres", "account_ends": "Nombre cuenta no puede iniciar ni terminar con caracteres especiales", "login": "Usuario debe ser alfanumérico y no contener espacios", "state_needs": "{} es obligatorio para el estado ",
    "ticket": "{} debe cumplir el patrón TK-000000", "news": "Novedad no está permitida", "criticality": "Criticidad SI no está permitida", "personal": "Datos Personales debe ser lógico o una máscara de protección válida", "account_country": "País no corresponde a un código o catálogo válido",
    "password": "Password Inicial debe tener al menos 8 caracteres", "long": "Descripción no puede superar 500 caracteres", "cia": "{} debe ser ALTO, MEDIO, BAJO o 1, 2, 3", "nulls": "Columna {}: porcentaje de nulos ", "tolerance": " supera la tolerancia de {}", "most": " supera el máximo permitido de {}",
    "missing": "Columna obligatoria ausente{}: {}", "high_needs": "{} es obligatorio (Nivel Alto)", "state": "Estado no permitido", "mail": "Correo Email no tiene un formato válido", "number": "Identificación debe ser alfanumérica", "id_kind": "Tipo de Identificación no permitido",
    "user_state_needs": "{} es obligatorio para el estado del usuario", "phone": "Teléfono Principal solo puede contener números y el signo +", "active_needs": "{} es obligatorio para usuarios ACTIVO", "form": "{} tiene un formato no válido", "all_nulls": "porcentaje global de nulos", "some_nulls": "porcentaje de nulos",
    "host": "Nombre Servidor debe ser alfanumérico y no contener espacios", "environment": "Ambiente no permitido", "ip": "IP Relacionada no tiene un formato IPv4 o IPv6 válido", "above_zero": "{} debe ser numérico y mayor que cero", "mac": "Dirección MAC no tiene formato válido", "empty": "{} no puede estar vacío",
    "support": "Fecha Vencimiento Soporte es obligatoria y debe usar YYYY-MM-DD", "patched": "Fecha Último Parchado debe usar YYYY-MM-DD cuando SO Parchable es SÍ", "value": "{} tiene un valor no permitido", "cmdb_kind": "Nombre CMDB debe iniciar con {} para el tipo de servidor indicado", "cmdb": "Nombre CMDB debe iniciar con SV_ o SF_", "text_form": "{} tiene un formato de texto no válido",
}


# ---------------------------------------------------------------- helpers


def canonical(name: str) -> str:
    """A column name without accents, case and punctuation."""
    return re.sub(r"[^a-z0-9]+", "", unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower())


def plain(text: str) -> str:
    """Lower case without accents; what ASCII doesn't have goes."""
    return "".join(c for c in unicodedata.normalize("NFKD", text).lower() if c.isascii())


def mentions(message: str, column: str) -> bool:
    """Whether a message names a column as a word of its own, accents and case apart."""
    return bool(re.search(r"(?<!\w)" + re.escape(plain(column)) + r"(?!\w)", plain(message)))


def resolve(columns: Iterable[str], fields: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """The table's column for each field that it has: the field's first name that any column bears."""
    have = {canonical(c): c for c in columns}
    return {key: next(have[canonical(n)] for n in names if canonical(n) in have) for key, names in fields.items() if any(canonical(n) in have for n in names)}


@F.pandas_udf(T.BooleanType())
def _valid_ip(s: pd.Series) -> pd.Series:
    def ok(v: str | None) -> bool:
        try:
            return bool(v) and bool(ipaddress.ip_address(v))
        except ValueError:
            return False

    return s.map(ok).astype(bool)


class RuleScan:
    """Collects rules and finds all their issues in one scan."""

    def __init__(self, df: DataFrame, order: str) -> None:
        self.df, self.order, self.items, self.made = df, order, [], 0

    def add(self, rule: str, severity: str, column: str, when: Column, text: Column | str) -> None:
        said = F.concat(F.lit("Fila "), F.col(self.order).cast("string"), F.lit(": "), F.lit(text) if isinstance(text, str) else text)
        issue = F.struct(F.lit(severity).alias("severidad"), F.lit(rule).alias("regla"), F.lit(column).alias("columna"), said.alias("mensaje"))
        self.items.append(F.when(F.coalesce(when, F.lit(False)), issue))

    def once(self, value: Column) -> Column:
        """A value that several rules use, as a column of its own: computed once a row, in code short enough to be compiled."""
        self.made += 1
        self.df = self.df.withColumn(f"__v{self.made}", value)
        return F.col(f"__v{self.made}")

    def rows(self) -> DataFrame:
        """The table with each row's issues beside it, as an array in ``__issues``.

        A filter on the issues would be moved to the rows they are made from, and all rules computed again for it; none passes a generator.
        """
        return self.df.withColumn("__issues", F.explode_outer(F.array(F.array_compact(F.array(*self.items)))))

    def issues(self) -> DataFrame:
        if not self.items:
            return self.df.sparkSession.createDataFrame([], SCHEMA)
        return self.rows().select(F.col(self.order).cast("long").alias("fila"), F.explode_outer("__issues").alias("x")).where("x IS NOT NULL").select("fila", "x.*")

    def with_levels(self, found: list[Level]) -> DataFrame:
        """Issues of rows and of whole columns from one pass: the issues are written, the shares of whole columns observed meanwhile."""
        if not found:
            return self.issues()
        spark, seen = self.df.sparkSession, Observation()
        whole = RuleScan(self.df.observe(seen, *[level[4].alias(f"s{i}") for i, level in enumerate(found)]), self.order)
        whole.items = self.items
        rows, shares = stored(whole.issues(), "issues"), seen.get
        above = [(None, severity, rule, column, f"{before}{shares[f's{i}'] * 100:.1f}%{after}") for i, (rule, severity, column, before, _, limit, after) in enumerate(found) if (shares[f"s{i}"] or 0) > limit]
        return rows.unionByName(spark.createDataFrame(above, SCHEMA))


#: An issue of whole columns: rule, severity, column, text before the share, share, tolerance, text after it.
Level = tuple[str, str, str, str, Column, float, str]


def _value(df: DataFrame, column: str) -> Column:
    return F.col(f"`{column}`").cast("string")


def _raw(text: str, *values: Column) -> Column:
    """A text with values in place of its marks ({} or %s)."""
    parts = re.split(r"\{\}|%s", text)
    return F.concat(F.lit(parts[0]), *[x for v, part in zip(values, parts[1:], strict=True) for x in (F.coalesce(v, F.lit("null")), F.lit(part))])


def _blank_share(columns: list[str]) -> Column:
    """Share of blank cells over several columns."""
    return F.avg(reduce(lambda a, b: a + b, [(~present(F.col(f"`{c}`"))).cast("double") for c in columns]) / len(columns))


def _missing(df: DataFrame, rule: str, absent: list[str], of: str = "") -> DataFrame:
    return df.sparkSession.createDataFrame([(None, ERROR, rule, c, SAYS["missing"].format(of, c)) for c in absent], SCHEMA)


def known(df: DataFrame, column: str, reference: DataFrame, name: str, flag: str, *, lower: bool = False) -> DataFrame:
    """The table with a flag that says whether a value stands in a reference table; the engine picks the join by size."""
    key = lambda c: F.lower(c) if lower else c
    names = reference.select(key(F.col(name).cast("string")).alias(f"{flag}_key")).where(f"{flag}_key IS NOT NULL").distinct().withColumn(flag, F.lit(True))
    return df.join(names, key(strip(_value(df, column)) if lower else _value(df, column)) == F.col(f"{flag}_key"), "left").drop(f"{flag}_key")


def _moment(scan: RuleScan, df: DataFrame, column: str) -> Column:
    """A date that rules compare: each step of reading it is computed once."""
    if dict(df.dtypes)[column].startswith(("timestamp", "date")):
        return F.col(f"`{column}`").cast("timestamp_ntz")
    text = scan.once(strip(_value(df, column)))
    return scan.once(moment(text, scan.once(in_iso_order(text))))


def _number(df: DataFrame, column: str) -> Column:
    return to_double(strip(_value(df, column))) if dict(df.dtypes)[column] == "string" else F.col(f"`{column}`").cast("double")


def _figure(c: Column) -> Column:
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15) & (c != 0)  # of 0 the sign shows
    return F.when(whole, c.cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.6f", c), r"\.?0+\z", ""))


def _dates_in_order(scan: RuleScan, df: DataFrame, rule: str, first: str, last: str, name: str) -> None:
    if first in df.columns and last in df.columns:
        a, b = _moment(scan, df, first), _moment(scan, df, last)
        both = F.col(f"`{first}`").isNotNull() & F.col(f"`{last}`").isNotNull()
        scan.add(rule, ERROR, first, both & (a > b), SAYS["late"].format(name))
        scan.add(rule, WARNING, first, both & (a.isNull() | b.isNull()), SAYS["bad_date"])


# ---------------------------------------------------------------- rule sets


def _scan_licences(df: DataFrame, references: dict[str, DataFrame], *, order: str = "fila") -> RuleScan:
    """Licencias TI."""
    has = set(df.columns)
    if "Producto asociado" in has:
        df = known(df, "Producto asociado", references["aplicaciones"], "nombre", "__app")
    if "Responsable / Correo" in has:
        df = known(df, "Responsable / Correo", references["usuarios"], "email", "__user", lower=True)
    scan = RuleScan(df, order)
    if "Producto asociado" in has:
        v = _value(df, "Producto asociado")
        scan.add("LIC1", WARNING, "Producto asociado", v.isNotNull() & F.col("__app").isNull(), _raw(SAYS["unknown_application"], v))
    if "Responsable / Correo" in has:
        v = strip(_value(df, "Responsable / Correo"))
        valid = v.rlike(EMAIL)
        scan.add("LIC2", WARNING, "Responsable / Correo", ~valid, _raw(SAYS["bad_mail"], v))
        scan.add("LIC3", WARNING, "Responsable / Correo", valid & F.col("__user").isNull(), _raw(SAYS["unknown_user"], v))
    if "Pais" in has:
        v = _value(df, "Pais")
        scan.add("LIC4", ERROR, "Pais", ~v.isin(LICENCE_COUNTRIES), _raw(SAYS["country"], v))
    n = {c: _number(df, c) if c in has else F.lit(None).cast("double") for c in ("Cantidad Total", "Cantidad Asignadas", "Cantidad Disponible")}
    total, used, free = n.values()
    scan.add("LIC5", ERROR, "Cantidad Total", total < 0, SAYS["negative"].format("Cantidad Total"))
    scan.add("LIC6", ERROR, "Cantidad Asignadas", used < 0, SAYS["negative"].format("Cantidad Asignadas"))
    scan.add("LIC7", ERROR, "Cantidad Asignadas", used > total, _raw(SAYS["over_total"], _figure(used), _figure(total)))
    scan.add("LIC8", WARNING, "Cantidad Disponible", F.abs(free - (total - used)) > 0.01, _raw(SAYS["not_free"], _figure(free), _figure(total - used)))
    _dates_in_order(scan, df, "LIC9", "Fecha Compra", "Fecha Vencimiento", "Fecha Compra")
    if "Enlace Contrato" in has:
        v = _value(df, "Enlace Contrato")
        scan.add("LIC10", WARNING, "Enlace Contrato", ~v.rlike(URL), _raw(SAYS["bad_url"], v))
    return scan


def _scan_domains(df: DataFrame, references: dict[str, DataFrame], *, order: str = "fila") -> RuleScan:
    """Dominios."""
    has = set(df.columns)
    if "Activo Asociado" in has:
        df = known(df, "Activo Asociado", references["aplicaciones"], "nombre", "__app")
    if "Responsable TI" in has:
        df = known(df, "Responsable TI", references["usuarios"], "email", "__user")
    scan = RuleScan(df, order)
    for column, rule, severity, text, bad in (
        ("Dominio", "DOM1", ERROR, SAYS["bad_domain"], lambda v: ~v.rlike(DOMAIN)),
        ("Activo Asociado", "DOM2", WARNING, SAYS["unknown"].replace("{}", "Activo Asociado", 1), lambda v: v.isNotNull() & F.col("__app").isNull()),
        ("Responsable TI", "DOM3", WARNING, SAYS["unknown"].replace("{}", "Responsable TI", 1), lambda v: v.isNotNull() & F.col("__user").isNull()),
        ("Pais", "DOM4", ERROR, SAYS["country"], lambda v: ~v.isin(DOMAIN_COUNTRIES)),
    ):
        if column in has:
            v = _value(df, column)
            scan.add(rule, severity, column, bad(v), _raw(text, v))
    _dates_in_order(scan, df, "DOM5", "Fecha Inicio / Vencimiento", "Fecha Vencimiento", "Fecha Inicio")
    return scan


def _scan_certificates(df: DataFrame, references: dict[str, DataFrame], *, order: str = "fila", today: str | None = None) -> RuleScan:
    """Certificados; ``today`` (yyyy-mm-dd) fixes the day that remaining days count from."""
    has = set(df.columns)
    if "Activo asociado" in has:
        df = known(df, "Activo asociado", references["aplicaciones"], "nombre", "__app")
    scan = RuleScan(df, order)
    for column, rule, severity, text, bad in (
        ("Activo asociado", "CER1", WARNING, SAYS["unknown"].replace("{}", "Activo asociado", 1), lambda v: v.isNotNull() & F.col("__app").isNull()),
        ("Tipo de Certificado", "CER2", ERROR, SAYS["not_permitted"].replace("{}", "Tipo de Certificado", 1), lambda v: ~v.isin(CERTIFICATE_KINDS)),
        ("Estado", "CER3", ERROR, SAYS["not_permitted"].replace("{}", "Estado", 1), lambda v: ~v.isin(CERTIFICATE_STATES)),
        ("Enlace Certificado", "CER5", WARNING, SAYS["certificate_url"], lambda v: ~v.rlike(URL)),
    ):
        if column in has:
            v = _value(df, column)
            scan.add(rule, severity, column, bad(v), _raw(text, v) if "{}" in text else text)
    if "Fecha Vencimiento" in has:
        ends = _moment(scan, df, "Fecha Vencimiento")
        left = F.date_diff(F.to_date(ends), F.lit(today).cast("date") if today else F.current_date())
        if "Dias Restantes" in has:
            said = _number(df, "Dias Restantes")
            scan.add("CER4", WARNING, "Dias Restantes", F.abs(said - left) > 1, _raw(SAYS["days"], _figure(said), left.cast("string")))
        scan.add("CER4", WARNING, "Fecha Vencimiento", F.col("`Fecha Vencimiento`").isNotNull() & ends.isNull(), SAYS["certificate_date"])
    return scan


def validate_licences(df: DataFrame, references: dict[str, DataFrame], *, order: str = "fila") -> DataFrame:
    """Licencias TI."""
    return _scan_licences(df, references, order=order).issues()


def validate_domains(df: DataFrame, references: dict[str, DataFrame], *, order: str = "fila") -> DataFrame:
    """Dominios."""
    return _scan_domains(df, references, order=order).issues()


def validate_certificates(df: DataFrame, references: dict[str, DataFrame], *, order: str = "fila", today: str | None = None) -> DataFrame:
    """Certificados; ``today`` (yyyy-mm-dd) fixes the day that remaining days count from."""
    return _scan_certificates(df, references, order=order, today=today).issues()


class _Fields:
    """Text, presence and upper case of a rule set's fields in a table."""

    def __init__(self, df: DataFrame, fields: dict[str, tuple[str, ...]]) -> None:
        self.df, self.fields, self.at = df, fields, resolve(df.columns, fields)
        self.scan: RuleScan | None = None  # which computes each text once
        self.texts: dict[str, Column] = {}

    def __contains__(self, key: str) -> bool:
        return key in self.at

    def has(self, key: str) -> Column:
        text = self.text(key)
        return text.isNotNull() & (text != "")

    def text(self, key: str) -> Column:
        if key not in self.texts:
            text = strip(_value(self.df, self.at[key]))
            self.texts[key] = self.scan.once(text) if self.scan else text
        return self.texts[key]

    def upper(self, key: str) -> Column:
        return F.when(self.has(key), F.upper(self.text(key))).otherwise("")

    def label(self, key: str) -> str:
        return self.fields[key][0]

    def columns(self, keys: Iterable[str]) -> list[str]:
        return [self.at[k] for k in keys if k in self.at]


def validate_accounts(df: DataFrame, references: dict | None = None, *, order: str = "fila") -> DataFrame:
    """Cuentas."""
    f = _Fields(df, ACCOUNT_FIELDS)
    if absent := [f.label(k) for k in ACCOUNT_LEVELS["alto"] if k not in f]:
        return _missing(df, "CUE1", absent)
    scan = f.scan = RuleScan(df, order)
    state = f.upper("estado")

    def add(rule: str, severity: str, key: str, bad: Column, text: str) -> None:
        scan.add(rule, severity, f.at[key], bad, text)

    for rule, key in (("CUE3", "nombre"), ("CUE4", "usuario"), ("CUE5", "estado")):
        add(rule, ERROR, key, ~f.has(key), SAYS["account_needs"].format(f.label(key)))
    name = f.text("nombre")
    add("CUE3", ERROR, "nombre", f.has("nombre") & ~F.length(name).between(3, 100), SAYS["account_length"])
    add("CUE3", ERROR, "nombre", f.has("nombre") & ~(name.rlike(r"(?U)^[\wÀ-ÿ]") & name.rlike(r"(?U)^.*[\wÀ-ÿ]\z")), SAYS["account_ends"])
    add("CUE4", ERROR, "usuario", f.has("usuario") & ~f.text("usuario").rlike(LOGIN), SAYS["login"])
    scan.add("CUE5", ERROR, f.at["estado"], f.has("estado") & ~state.isin(ACCOUNT_STATES), _raw(SAYS["not_permitted"].replace("{}", "Estado", 1), F.coalesce(_value(df, f.at["estado"]), F.lit(""))))
    for key, needed in (("ticket_creacion", state != "RETIRADO"), ("ticket_retiro", state == "RETIRADO")):
        if key in f:
            scan.add("CUE6", ERROR, f.at[key], needed & ~f.has(key), F.concat(F.lit(SAYS["state_needs"].format(f.label(key))), state))
            add("CUE6", ERROR, key, f.has(key) & ~f.text(key).rlike(TICKET), SAYS["ticket"].format(f.label(key)))
    for rule, key, good, text in (
        ("CUE7", "novedad", lambda: f.upper("novedad").isin(ACCOUNT_NEWS), SAYS["news"]),
        ("CUE7", "criticidad", lambda: f.upper("criticidad").isin(CRITICALITY), SAYS["criticality"]),
        ("CUE8", "datos_personales", lambda: f.upper("datos_personales").isin(TRUTH) | f.text("datos_personales").rlike(MASK), SAYS["personal"]),
        ("CUE9", "pais", lambda: f.upper("pais").isin(ACCOUNT_COUNTRIES), SAYS["account_country"]),
        ("CUE10", "password", lambda: F.length(f.text("password")) >= 8, SAYS["password"]),
        ("CUE11", "descripcion", lambda: F.length(f.text("descripcion")) <= 500, SAYS["long"]),
        *[("CUE12", k, lambda k=k: f.upper(k).isin(ACCOUNT_CIA), SAYS["cia"].format(ACCOUNT_FIELDS[k][0])) for k in ("disponibilidad", "confidencialidad", "integridad")],
    ):
        if key in f:
            add(rule, WARNING, key, f.has(key) & ~good(), text)
    whole = []
    for level, keys in ACCOUNT_LEVELS.items():
        for key in keys:
            if key in f:
                limit = ACCOUNT_TOLERANCE.get(key, 0.0)
                severe = level == "alto" or key.startswith("ticket")
                whole.append(("CUE13", ERROR if severe else WARNING, f.at[key], SAYS["nulls"].format(f.at[key]), _blank_share([f.at[key]]), limit, SAYS["tolerance"].format(f"{limit:.0%}")))
    return scan.with_levels(whole).unionByName(_repeated_users(df, f.at["usuario"], order))


def _repeated_users(df: DataFrame, column: str, order: str) -> DataFrame:
    """CUE2, of which only row and user are shuffled: nulls are equal to each other, and may be most rows."""
    own = df.select(F.col(order).alias("fila"), _value(df, column).alias("shown"), strip(_value(df, column)).alias("user"))
    scan = RuleScan(repeated_keys(own, ["user"]), "fila")
    scan.add("CUE2", ERROR, column, F.lit(True), _raw(SAYS["again"], F.coalesce("shown", F.lit(""))))
    return scan.issues()


def _levels(f: _Fields, levels: dict[str, list[str]], rules: tuple[str, str], texts: tuple[str, str]) -> list[Level]:
    found = []
    for rule, level, limit, text in ((rules[0], "medio", 0.05, texts[0]), (rules[1], "bajo", 0.20, texts[1])):
        if columns := f.columns(levels[level]):
            found.append((rule, WARNING, f"Nivel {level}", f"Nivel {level.capitalize()}: {text} ", _blank_share(columns), limit, SAYS["most"].format(f"{limit:.0%}")))
    return found


def _user_optional(f: _Fields, key: str) -> Column:
    """Whether an optional field of a user is empty or well formed."""
    if key in ("zip", "id_sistema", "id_cmdb"):
        return ~f.has(key) | f.text(key).rlike(CODE)
    if key == "telefono_alternativo":
        return ~f.has(key) | f.text(key).rlike(PHONE)
    return F.lit(True)


def validate_users(df: DataFrame, references: dict | None = None, *, order: str = "fila") -> DataFrame:
    """Usuario."""
    f = _Fields(df, USER_FIELDS)
    if absent := [f.label(k) for k in USER_LEVELS["alto"] if k not in f]:
        return _missing(df, "USU1", absent, " para Usuario")
    scan = f.scan = RuleScan(df, order)
    state = f.upper("estado")

    def add(rule: str, severity: str, key: str, bad: Column, text: str) -> None:
        if key in f:
            scan.add(rule, severity, f.at[key], bad, text)

    for key in USER_LEVELS["alto"]:
        add("USU2", ERROR, key, ~f.has(key), SAYS["high_needs"].format(f.label(key)))
    add("USU3", ERROR, "estado", f.has("estado") & ~state.isin(ACCOUNT_STATES), SAYS["state"])
    add("USU3", ERROR, "email", f.has("email") & ~f.text("email").rlike(EMAIL), SAYS["mail"])
    add("USU3", ERROR, "identificacion", f.has("identificacion") & ~f.text("identificacion").rlike(ALNUM), SAYS["number"])
    add("USU3", ERROR, "tipo_identificacion", f.has("tipo_identificacion") & ~f.upper("tipo_identificacion").isin(ID_KINDS), SAYS["id_kind"])
    for rule, key, needed in (("USU4", "ticket_ingreso", state.isin("ACTIVO", "INACTIVO", "SUSPENDIDO")), ("USU5", "ticket_retiro", state == "RETIRADO")):
        if key in f:
            add(rule, WARNING, key, needed & ~f.has(key), SAYS["user_state_needs"].format(f.label(key)))
            add(rule, WARNING, key, f.has(key) & ~f.text(key).rlike(TICKET), SAYS["ticket"].format(f.label(key)))
    if "telefono" in f:
        add("USU6", WARNING, "telefono", f.has("telefono") & ~f.text("telefono").rlike(PHONE), SAYS["phone"])
    for key in USER_ACTIVE:
        if key in f:
            add("USU7", WARNING, key, (state == "ACTIVO") & ~f.has(key), SAYS["active_needs"].format(f.label(key)))
    for key in USER_LEVELS["bajo"]:
        if key in f:
            add("USU10", WARNING, key, ~_user_optional(f, key), SAYS["form"].format(f.label(key)))
    return scan.with_levels(_levels(f, USER_LEVELS, ("USU8", "USU9"), (SAYS["all_nulls"], SAYS["all_nulls"])))


def _strict_day(f: _Fields, key: str) -> Column:
    """Whether a field holds a day: YYYY-MM-DD text that exists, or a typed date."""
    if key not in f:
        return F.lit(False)
    if dict(f.df.dtypes)[f.at[key]].startswith(("date", "timestamp")):
        return F.col(f"`{f.at[key]}`").isNotNull()
    return F.coalesce(f.text(key).rlike(DAY) & parse_date(f.text(key)).isNotNull(), F.lit(False))


def validate_servers(df: DataFrame, references: dict | None = None, *, order: str = "fila") -> DataFrame:
    """Infraestructura."""
    f = _Fields(df, SERVER_FIELDS)
    if absent := [f.label(k) for k in SERVER_LEVELS["alto"] if k not in f]:
        return _missing(df, "INF1", absent, " para Infraestructura")
    # Only addresses that aren't plain IPv4 go to Python.
    ip = strip(_value(df, f.at["ip"]))
    df = df.withColumn("__odd_ip", F.when(~ip.rlike(IPV4), ip)).withColumn("__ip", _valid_ip("__odd_ip"))
    f.df = df
    scan = RuleScan(df, order)

    def add(rule: str, severity: str, key: str, bad: Column, text: Column | str) -> None:
        scan.add(rule, severity, f.at[key], bad, text)

    for key in SERVER_LEVELS["alto"]:
        add("INF2", ERROR, key, ~f.has(key), SAYS["high_needs"].format(f.label(key)))
    add("INF3", ERROR, "hostname", f.has("hostname") & ~f.text("hostname").rlike(HOST), SAYS["host"])
    add("INF4", ERROR, "ambiente", f.has("ambiente") & ~f.upper("ambiente").isin(ENVIRONMENTS), SAYS["environment"])
    add("INF4", ERROR, "estado", f.has("estado") & ~f.upper("estado").isin(SERVER_STATES), SAYS["state"])
    add("INF5", ERROR, "ip", f.has("ip") & ~f.text("ip").rlike(IPV4) & ~F.col("__ip"), SAYS["ip"])
    for key in ("cpu", "discos", "espacio", "ram"):
        if key in f:
            add("INF6", WARNING, key, ~F.coalesce(_number(df, f.at[key]) > 0, F.lit(False)), SAYS["above_zero"].format(f.label(key)))
    if "mac" in f:
        add("INF7", WARNING, "mac", f.has("mac") & ~f.text("mac").rlike(MAC), SAYS["mac"])
    for key in ("antivirus", "agentes"):
        if key in f:
            add("INF8", WARNING, key, ~f.has(key), SAYS["empty"].format(f.label(key)))
    for rule, key, day, text in (
        ("INF9", "soporte", "vencimiento_soporte", SAYS["support"]),
        ("INF10", "parchable", "ultimo_parchado", SAYS["patched"]),
    ):
        if key in f:
            yes = F.lit(True) == F.col(f"`{f.at[key]}`") if dict(df.dtypes)[f.at[key]] == "boolean" else f.upper(key).isin(YES)
            add(rule, WARNING, key, yes & ~_strict_day(f, day), text)
    for key in ("integridad", "disponibilidad", "confidencialidad", "criticidad", "obsolescencia"):
        if key in f:
            add("INF11", WARNING, key, f.has(key) & ~f.upper(key).isin(SERVER_CIA), SAYS["value"].format(f.label(key)))
    for key in SERVER_TEXT:
        if key in f:
            add("INF12", WARNING, key, ~f.has(key), SAYS["empty"].format(f.label(key)))
    if "nombre_cmdb" in f:
        kind = f.upper("tipo_servidor") if "tipo_servidor" in f else F.lit("")
        prefix = F.when(kind.contains("FIS"), "SF_").when(kind.contains("VIR"), "SV_")
        off = prefix.isNotNull() & ~F.startswith(f.upper("nombre_cmdb"), prefix)
        add("INF13", WARNING, "nombre_cmdb", f.has("nombre_cmdb") & off, _raw(SAYS["cmdb_kind"], prefix))
        add("INF13", WARNING, "nombre_cmdb", f.has("nombre_cmdb") & ~F.coalesce(off, F.lit(False)) & ~f.text("nombre_cmdb").rlike(CMDB), SAYS["cmdb"])
    for key in SERVER_LEVELS["bajo"][1:]:
        if key in f:
            add("INF14", WARNING, key, f.has(key) & ~f.text(key).rlike(LABEL), SAYS["text_form"].format(f.label(key)))
    return scan.with_levels(_levels(f, SERVER_LEVELS, ("INF15", "INF15"), (SAYS["all_nulls"], SAYS["some_nulls"])))


RULE_SETS = {"Licencias TI": validate_licences, "Dominios": validate_domains, "Certificados": validate_certificates, "Cuentas": validate_accounts, "Usuario": validate_users, "Infraestructura": validate_servers}

#: Rule sets whose every issue belongs to a row and needs no other.
SCANS = {"Licencias TI": _scan_licences, "Dominios": _scan_domains, "Certificados": _scan_certificates}


def validate(schema: str, df: DataFrame, references: dict[str, DataFrame] | None = None, *, order: str = "fila") -> DataFrame:
    """Issues of a rule set by name; an unknown one has none."""
    if schema not in RULE_SETS:
        return df.sparkSession.createDataFrame([], SCHEMA)
    return RULE_SETS[schema](df, references or {}, order=order)


# ---------------------------------------------------------------- scores


def _weighted(df: DataFrame, groups: list[tuple[float, list[Column]]]) -> DataFrame:
    """One row: the weighted mean share of good cells in percent; groups without columns add nothing."""
    total = F.lit(0.0)
    for weight, cells in groups:
        if cells:
            total = total + weight * 100 * F.avg(reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("double") for c in cells]) / len(cells))
    return df.agg(F.coalesce(F.round(total, 2), F.lit(0.0)).alias("score"))


def accounts_score(df: DataFrame) -> DataFrame:
    """Presence of the fields of Cuentas, weighted 40/35/25."""
    f = _Fields(df, ACCOUNT_FIELDS)
    return _weighted(df, [(w, [f.has(k) for k in ACCOUNT_LEVELS[g] if k in f]) for g, w in (("alto", 0.40), ("medio", 0.35), ("bajo", 0.25))])


def users_score(df: DataFrame) -> DataFrame:
    """Validity of the fields of Usuario, weighted 40/35/25."""
    f = _Fields(df, USER_FIELDS)
    state = f.upper("estado") if "estado" in f else F.lit("")

    def valid(key: str) -> Column:
        has, text = f.has(key), f.text(key)
        if key in ("estado", "tipo_identificacion"):
            return has & f.upper(key).isin(ACCOUNT_STATES if key == "estado" else ID_KINDS)
        if key in ("email", "identificacion"):
            return has & text.rlike(EMAIL if key == "email" else ALNUM)
        if key in USER_LEVELS["alto"]:
            return has
        if key in ("ticket_ingreso", "ticket_retiro"):
            needed = state.isin("ACTIVO", "INACTIVO", "SUSPENDIDO") if key == "ticket_ingreso" else state == "RETIRADO"
            return F.when(has, text.rlike(TICKET)).otherwise(~needed)
        if key == "telefono":
            return has & text.rlike(PHONE)
        if key in USER_ACTIVE:
            return has | (state != "ACTIVO")
        return _user_optional(f, key)

    return _weighted(df, [(w, [valid(k) for k in USER_LEVELS[g] if k in f]) for g, w in (("alto", 0.40), ("medio", 0.35), ("bajo", 0.25))])


def servers_score(df: DataFrame) -> DataFrame:
    """Presence of the fields of Infraestructura, weighted 50/35/15."""
    f = _Fields(df, SERVER_FIELDS)
    return _weighted(df, [(w, [f.has(k) for k in SERVER_LEVELS[g] if k in f]) for g, w in (("alto", 0.50), ("medio", 0.35), ("bajo", 0.15))])


SCORES = {"Cuentas": accounts_score, "Usuario": users_score, "Infraestructura": servers_score}


def score(schema: str, df: DataFrame) -> DataFrame | None:
    """The rule set's score, or None where it has none."""
    return SCORES[schema](df) if schema in SCORES else None


# ---------------------------------------------------------------- views of issues


def issues_table(issues: DataFrame) -> DataFrame:
    """Tipo and Mensaje, errors first."""
    return issues.select(F.when(F.col("severidad") == ERROR, "Error").otherwise("Advertencia").alias("Tipo"), F.col("mensaje").alias("Mensaje")).orderBy(F.desc("Tipo"), "Mensaje")


def _problems(found: Column) -> tuple[Column, Column]:
    """Worst severity and all messages, errors first, of an array of issues."""
    rank = lambda x: F.when(x["severidad"] == ERROR, 0).otherwise(1)
    ranked = F.array_sort(F.transform(found, lambda x: F.struct(rank(x).alias("r"), x["regla"].alias("regla"), x["mensaje"].alias("mensaje"))))
    return F.when(ranked[0]["r"] == 0, ERROR).otherwise(WARNING), F.array_join(ranked["mensaje"], "; ")


def problem_rows(df: DataFrame, issues: DataFrame, *, order: str = "fila") -> DataFrame:
    """The rows with issues, their worst severity and all their problems, errors first."""
    each = issues.where("fila IS NOT NULL").groupBy(F.col("fila").alias("__fila")).agg(F.collect_list(F.struct("severidad", "regla", "mensaje")).alias("__issues"))
    worst, text = _problems(F.col("__issues"))
    return df.join(each, F.col(order) == F.col("__fila")).withColumns({"severidad": worst, "Problemas": text}).drop("__fila", "__issues")


def problems(schema: str, df: DataFrame, references: dict[str, DataFrame] | None = None, *, order: str = "fila") -> DataFrame:
    """``problem_rows`` of a rule set; without a join where all of its issues belong to one row (``SCANS``): they never leave it."""
    if schema in SCANS:
        scan = SCANS[schema](df, references or {}, order=order)
        worst, text = _problems(F.col("__issues"))
        rows = scan.rows().where(F.size("__issues") > 0).withColumns({"severidad": worst, "Problemas": text})
        return rows.select(*df.columns, "severidad", "Problemas")
    return problem_rows(df, validate(schema, df, references, order=order), order=order)
