"""Text expressions: strip, collapse, fold accents, title case, e-mail forms.  All but title case stay in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Plain e-mail pattern, and the wider one of typed columns, which allows an apostrophe.
EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\z"
EMAIL_TYPED = r"^[A-Za-z0-9._%+\-']+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\z"


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it, and that keeps generated code short."""
    return F.transform(F.array(value), use)[0]


#: White space of any script, as Unicode's property of that name has it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


@cache
def _folds() -> tuple[str, str]:
    """Characters whose compatibility decomposition without marks is one other character, and that character."""
    source, target = [], []
    for code in range(0xA0, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xF8FF or code > 0x1FFFF:
            continue
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c and code <= 0xFFFF:
            source.append(c)
            target.append(plain)
    return "".join(source), "".join(target)


def fold(c: Column) -> Column:
    """Without accents: decomposed characters lose their marks (those that unfold into several stay)."""
    return F.translate(F.regexp_replace(c, r"\p{M}", ""), *_folds())


@F.pandas_udf(T.StringType())
def title(s: pd.Series) -> pd.Series:
    """Title case in which a letter after anything but a letter is large (3com: 3Com)."""
    return s.str.title()


def plain_title(c: Column) -> Column:
    """Free text as unaccented alphanumeric words in title case."""
    return title(collapse(F.regexp_replace(fold(strip(c)), r"(?U)[^A-Za-z0-9\s]", " ")))


def typed_email(c: Column) -> Column:
    """Without blanks and mailto:, the domain in lower case."""
    s = F.regexp_replace(F.replace(strip(c), F.lit(" "), F.lit("")), r"(?i)^mailto:", "")
    at = F.length(s) - F.length(F.substring_index(s, "@", -1))
    return F.when(s.contains("@"), F.concat(F.substring(s, F.lit(1), at), F.lower(F.substring_index(s, "@", -1)))).otherwise(s)


def tidy_email(c: Column) -> Column:
    """An address rid of stray characters if that makes it valid, else only of blanks."""
    s = F.replace(strip(c), F.lit(" "), F.lit(""))
    local = F.regexp_replace(F.substring_index(s, "@", 1), r"[^A-Za-z0-9._%+\-]", "")
    rest = F.substring(s, F.length(F.substring_index(s, "@", 1)) + 2, F.length(s))
    domain = F.lower(F.regexp_replace(F.regexp_replace(rest, r"[^A-Za-z0-9.\-]", ""), r"^\.+|\.+\z", ""))
    made = F.concat(local, F.lit("@"), domain)
    return F.when(s.contains("@") & made.rlike(EMAIL), made).otherwise(s)


def present(c: Column) -> Column:
    """Neither null nor blank."""
    return c.isNotNull() & (strip(c.cast("string")) != "")
