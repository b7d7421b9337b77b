"""What went wrong, told by kind: each kind of trouble has one text and one way out, wherever it was met."""

from __future__ import annotations

import zipfile

# Words that reports of these troubles hold.
UNSUPPORTED, NO_WORKBOOK, EMPTY, COLUMNS = "formato no soportado", "no es un libro de Excel", "está vacío", "columnas"

#: Kind of trouble: text ({file}: the file, {doing}: what was being done, {what}: the error's own words) and advice.
TROUBLES: dict[str, tuple[str, str]] = {
    "archive": (f"{{file}} {NO_WORKBOOK} que se pueda abrir.", "Si lleva contraseña, guarde una copia sin ella; si viene de otro programa, expórtelo como .xlsx."),
    "old": (f"{{file}} {NO_WORKBOOK} que se pueda leer: {{what}}.", "Guárdelo como «Libro de Excel (.xlsx)», sin contraseña."),
    "sheet": ("{file} no tiene la hoja pedida: la hoja {what} no existe.", "Pida la lista de hojas y elija una de ellas."),
    "line": (f"{{file}}: {{what}}; el número de {COLUMNS} debe ser el mismo en todo el archivo.", "Ponga entre comillas los valores que llevan el separador dentro."),
    "quote": ("{file}: {what}.", "Cierre las comillas de ese valor o duplique las que son parte de él."),
    "characters": ("{file} mezcla caracteres de varias codificaciones.", "Expórtelo de nuevo, entero, en UTF-8."),
    "missing": ("No se encuentra {file}.", "Compruebe la ruta y que el clúster tenga permiso para leerla."),
    "memory": ("No hay memoria bastante para {doing}.", "Use una fuente que se lea por partes, como CSV, o dé más memoria al proceso."),
    "component": ("Para {doing} hace falta un componente que no está instalado.", "Convierta el archivo a .xlsx o .csv, o instale el componente que nombra el detalle técnico."),
    "column": ("Para {doing} falta la columna {what}.", "Compare los nombres de las columnas con los del esquema elegido."),
    "type": ("Hay valores que no son del tipo que hace falta para {doing}.", "Revise en el esquema el tipo asignado a cada columna."),
    "unknown": ("Algo impidió {doing}.", "El detalle técnico dice qué fue; revise también que el archivo no esté dañado ni abierto en otro programa."),
}
#: Kinds by the class of an error, the nearest class first, and by Spark's error conditions, the longest name first.
BY_CLASS: dict[type, str] = {
    zipfile.BadZipFile: "archive", UnicodeError: "characters", MemoryError: "memory", ImportError: "component", FileNotFoundError: "missing", PermissionError: "missing", KeyError: "column", TypeError: "type",
}
BY_CONDITION = {
    "PATH_NOT_FOUND": "missing", "FAILED_READ_FILE.FILE_NOT_EXIST": "missing", "UNRESOLVED_COLUMN": "column", "FIELD_NOT_FOUND": "column", "COLUMN_NOT_FOUND": "column", "CAST_INVALID_INPUT": "type", "DATATYPE_MISMATCH": "type",
    "CAST_OVERFLOW": "type", "NUMERIC_VALUE_OUT_OF_RANGE": "type", "DATA_SOURCE_NOT_FOUND": "component", "UNABLE_TO_ACQUIRE_MEMORY": "memory",
}
#: Kinds by the class of an error that the JVM raised.
BY_JAVA = {"FileNotFoundException": "missing", "AccessControlException": "missing", "AccessDeniedException": "missing", "OutOfMemoryError": "memory", "ClassNotFoundException": "component"}


class FileLoadError(Exception):
    """What went wrong, what to do about it, and the technical cause."""

    def __init__(self, message: str, suggestion: str | None = None, technical: str | None = None) -> None:
        super().__init__(message)
        self.message, self.suggestion, self.technical = message, suggestion, technical


class RaggedLine(ValueError):
    """A line with more fields than the header."""

    def __init__(self, line: int, seen: int, expected: int) -> None:
        super().__init__(f"la línea {line} trae {seen} valores y el encabezado {expected}")


class OpenQuote(ValueError):
    """A quoted value that is never closed."""

    def __init__(self, line: int) -> None:
        super().__init__(f"las comillas que se abren en la línea {line} no se cierran")


class MissingSheet(KeyError):
    """A sheet that the workbook doesn't have."""


class OldBook(ValueError):
    """A file that is no workbook of Excel 97 to 2003, or a locked one."""


BY_CLASS |= {OldBook: "old", RaggedLine: "line", OpenQuote: "quote", MissingSheet: "sheet"}


def kind_of(exc: BaseException) -> str:
    """The kind of trouble of an error, or of the first of its causes that has one."""
    seen: BaseException | None = exc
    while seen is not None:
        for parent in type(seen).__mro__:
            if parent in BY_CLASS:
                return BY_CLASS[parent]
        if hasattr(seen, "java_exception") and (name := seen.java_exception.getClass().getSimpleName()) in BY_JAVA:
            return BY_JAVA[name]
        condition = (seen.getCondition() or "") if hasattr(seen, "getCondition") else ""
        for name in sorted(BY_CONDITION, key=len, reverse=True):
            if condition.startswith(name):
                return BY_CONDITION[name]
        seen = seen.__cause__
    return "unknown"


def _told(exc: BaseException, file: str, doing: str) -> tuple[str, str]:
    text, advice = TROUBLES[kind_of(exc)]
    what = exc.args[0] if exc.args else type(exc).__name__
    return text.format(file=file, doing=doing, what=what), advice


def to_friendly_error(exc: Exception, file_name: str = "el archivo") -> FileLoadError:
    """An error of loading as one that tells the trouble and a way out."""
    if isinstance(exc, FileLoadError):
        return exc
    message, advice = _told(exc, f"«{file_name}»", f"leer «{file_name}»")
    return FileLoadError(message, advice, f"{type(exc).__name__}: {exc}")


def friendly_message(exc: Exception, context: str = "procesar la información") -> tuple[str, str]:
    """Text and advice for an error met while doing something."""
    if isinstance(exc, FileLoadError):
        return exc.message, exc.suggestion or ""
    return _told(exc, "el archivo", context)
