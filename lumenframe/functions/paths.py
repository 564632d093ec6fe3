"""One spelling for file paths that are written in several ways."""

from __future__ import annotations

import posixpath
import re
import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SCHEME = re.compile(r"^file:/+", re.I)
_SLASHES = re.compile(r"/+")
#: Spellings that are canonical but for letter case: absolute, of ASCII parts that neither begin nor end with a dot or space.
_PLAIN = r"\A(?:/[\w-]++(?:[ .]++[\w-]++)*+)++\z"


def normal_path(path: str | None) -> str | None:
    """The canonical spelling of ``path``: no surrounding white space, forward slashes, no ``.``, ``..`` or doubled
    slashes, file URIs decoded, NFC and case-folded. Null stays null; an empty path becomes an empty string."""
    if path is None:
        return None
    text = path.strip().replace("\\", "/")
    if _SCHEME.match(text):
        text = unquote(_SCHEME.sub("/", text))
    text = _SLASHES.sub("/", text)
    return unicodedata.normalize("NFC", posixpath.normpath(text) if text else "").casefold()


@F.pandas_udf(StringType())
def normal_path_udf(paths: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(paths)
    known = [normal_path(x) for x in distinct]
    return pd.Series([known[c] if c >= 0 else None for c in codes], dtype=object)


def normalized(path: Column) -> Column:
    """``normal_path`` of a column: plain spellings are lower-cased in the JVM, and only the others are sent to Python.

    The outer form says that the result is null exactly where ``path`` is, so a join's filter on null keys doesn't evaluate it again.
    """
    plain = path.rlike(_PLAIN)
    settled = F.when(plain, F.lower(path)).otherwise(normal_path_udf(F.when(~plain, path)))
    return F.when(path.isNotNull(), F.coalesce(settled, F.lit("")))
