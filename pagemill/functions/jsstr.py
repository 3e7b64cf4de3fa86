"""String rules of the web platform on Spark columns: white space, trimming, rounding, word boundaries.

Lengths count code points, which differ from UTF-16 units only beyond the basic plane.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the white space of ECMAScript
SPACE = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


SPACES = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(text: Column) -> Column:
    """Without white space at either end; looks at the ends only."""
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, without outer ones."""
    return js_trim(F.regexp_replace(text, f"{SPACE}+", " "))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def js_round(number: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(number + F.lit(0.5))


def lookup(value: Column, names: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for key, name in names.items():
        out = F.when(value == key, F.lit(name)).otherwise(out)
    return out
