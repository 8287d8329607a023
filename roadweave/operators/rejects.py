"""Delimited text lines: separate the rows that fail to parse, with the reason.

One anchored pattern per schema accepts whole valid rows inside the scan.  A line it refuses
goes through prefix patterns that grow by one field each: the first that fails names the
broken field, and what follows the longest valid prefix decides the reason.  If the rest
isn't a sequence of well-formed fields the quoting is broken, else if it doesn't complete the
number of columns that is the reason, else the broken field's value.  Everything is a JVM
expression, so a load is one pass without a shuffle; all patterns are possessive and so
linear in the line.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A column of the row schema: its name, the pattern of its bare value and its type."""

    name: str
    pattern: str
    type: str = "string"


def digits(low: int, high: int) -> str:
    """Pattern of ``low`` to ``high`` digits 0-9."""
    return f"[0-9]{{{low},{high}}}"


#: Digits 0-9 with at most one decimal comma and at least one digit.
DECIMAL_COMMA = "(?:[0-9]++(?:,[0-9]*+)?|,[0-9]++)"


def field_pattern(field: Field) -> str:
    """A field with optional outer blanks and optional enclosing quotes."""
    p = f"(?:{field.pattern})"
    return f'[ \\t]*+(?:"{p}"|{p})[ \\t]*+'


def row_pattern(fields: list[Field], sep: str = ";") -> str:
    """Anchored pattern of a whole valid row."""
    return "\\A" + re.escape(sep).join(field_pattern(f) for f in fields) + "\\z"


def prefix_patterns(fields: list[Field], sep: str = ";") -> list[str]:
    """For k = 1..n the anchored pattern of a row whose first k fields are valid."""
    s = re.escape(sep)
    parts = [field_pattern(f) for f in fields]
    return ["\\A" + s.join(parts[:k]) + f"(?={s}|\\z)" for k in range(1, len(parts) + 1)]


def formed_pattern(sep: str = ";") -> str:
    """A field that is well formed whatever its value: quoted, with doubled quotes inside, or free of quotes."""
    return f'[ \\t]*+(?:"(?:[^"]++|"")*+"[ \\t]*+|[^"{re.escape(sep)}]*+)'


def rest_pattern(sep: str = ";", count: int | None = None) -> str:
    """Anchored pattern of ``count`` well-formed fields, or of any number."""
    f, s = formed_pattern(sep), re.escape(sep)
    return f"\\A{f}(?:{s}{f})" + ("*+" if count is None else f"{{{count - 1}}}+") + "\\z"


def _bare(line: Column, index: int, sep: str) -> Column:
    """Value of one field of a line that the row pattern accepted."""
    return F.regexp_replace(F.split(line, re.escape(sep), -1)[index], '[ \\t"]', "")


def parse_rows(df: DataFrame, line: str, fields: list[Field], sep: str = ";", prefix: str = "") -> DataFrame:
    """All rows of ``df`` with the typed fields, ``reject_reason`` and ``broken_field``.

    A valid row has a null reason and its values under the schema's names (with
    ``prefix``); a rejected row has null values and one of ``quoting``, ``column_count``,
    ``invalid_value`` (the first that applies) and the number, from 1, of the first field
    at which the growing prefix patterns fail (n + 1: all fields hold and something
    follows).  A null or empty line is one empty field.  One carriage return at the end is part of the line
    end.  Values of type double may have a decimal comma.  Existing columns stay; a schema
    name that is already a column raises ValueError.
    """
    names = [prefix + f.name for f in fields]
    clash = {c.lower() for c in df.columns} & {n.lower() for n in [*names, "reject_reason", "broken_field"]}
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}; give a prefix")
    text = F.regexp_replace(F.coalesce(F.col(line), F.lit("")), "\\r\\z", "")
    valid = text.rlike(row_pattern(fields, sep))
    broken = reason = None
    prefixes = prefix_patterns(fields, sep)
    for k in range(len(fields), -1, -1):
        # k fields hold: the rest begins after the k-th separator, or is empty after the last field.
        rest = text if k == 0 else F.regexp_replace(text, prefixes[k - 1] + re.escape(sep), "")
        if k == len(fields):  # what follows a whole row is one field too many, or broken
            over = F.regexp_replace(text, prefixes[k - 1], "")
            why = F.when(over.substr(F.lit(2), F.length(over)).rlike(rest_pattern(sep)), "column_count").otherwise("quoting")
        else:
            why = (
                F.when(~rest.rlike(rest_pattern(sep)), "quoting")
                .when(~rest.rlike(rest_pattern(sep, len(fields) - k)), "column_count")
                .otherwise("invalid_value")
            )
            if k:  # a line that ends with its k-th field has no rest to judge
                why = F.when(~text.rlike(prefixes[k - 1] + re.escape(sep)), "column_count").otherwise(why)
        fails = F.lit(True) if k == len(fields) else ~text.rlike(prefixes[k])
        broken = F.when(fails, F.lit(k + 1)) if broken is None else F.when(fails, F.lit(k + 1)).otherwise(broken)
        reason = F.when(fails, why) if reason is None else F.when(fails, why).otherwise(reason)
    out = df.withColumns({"reject_reason": F.when(~valid, reason), "broken_field": F.when(~valid, broken)})
    values = {}
    for i, (f, n) in enumerate(zip(fields, names)):
        bare = _bare(text, i, sep)
        typed = F.replace(bare, F.lit(","), F.lit(".")).cast(f.type) if f.type == "double" else bare.cast(f.type)
        values[n] = F.when(valid, typed)
    return out.withColumns(values)


def split_rows(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows) of ``parse_rows``."""
    return (
        parsed.where(F.col("reject_reason").isNull()).drop("reject_reason", "broken_field"),
        parsed.where(F.col("reject_reason").isNotNull()),
    )


#: The nine columns of a travel-time matrix file.
TRAVEL_MATRIX = [
    *[Field(f"{end}_{part}", digits(1, n)) for end in ("OR", "DEST") for part, n in (("REG", 2), ("PROV", 3), ("PROCOM", 6))],
    *[Field(m, DECIMAL_COMMA, "double") for m in ("TEP_TOT", "KM_TOT", "TTP_TOT")],
]
