"""F1 slugify: lower, NFD, drop diacritics, & -> ' and ', non-alnum runs -> '-'.

Spark has no Unicode normalisation function, so the one step that needs it
(NFD + removing characters with the Unicode ``Diacritic`` property) is an
Arrow-batched pandas UDF; everything else stays in JVM expressions.
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
import regex
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DIACRITIC = regex.compile(r"\p{Diacritic}")

# The UDF's code travels with the task (by value): Python workers need pandas
# and regex, but not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def strip_diacritics_py(text: str | None) -> str | None:
    if text is None:
        return None
    return _DIACRITIC.sub("", unicodedata.normalize("NFD", text))


@F.pandas_udf(T.StringType())
def strip_diacritics(s: pd.Series) -> pd.Series:
    return s.map(strip_diacritics_py)


def slugify(name: Column) -> Column:
    x = strip_diacritics(F.lower(name))
    x = F.regexp_replace(x, "&", " and ")
    x = F.regexp_replace(x, "[^a-z0-9]+", "-")
    return F.regexp_replace(x, "^-+|-+$", "")


def slugify_py(name: str) -> str:
    """Driver-side twin, for a single requested slug."""
    x = strip_diacritics_py(name.lower()).replace("&", " and ")
    x = regex.sub("[^a-z0-9]+", "-", x)
    return regex.sub("^-+|-+$", "", x)
