"""Column names, families of types, and one meaning of "missing"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)
TEXT = (T.StringType, T.VarcharType, T.CharType)


class UnknownColumn(ValueError):
    """A column name that the frame does not have."""


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col(quoted(name))


def resolve(df: DataFrame, name: str) -> str:
    """The frame's own spelling of ``name``: exact, else the only one that differs in case."""
    if name in df.columns:
        return name
    close = [c for c in df.columns if c.lower() == name.strip().lower()]
    if len(close) == 1:
        return close[0]
    raise UnknownColumn(f"no column {name!r}; the frame has {df.columns}")


def resolve_all(df: DataFrame, names: list[str] | None) -> list[str]:
    return list(df.columns) if names is None else [resolve(df, n) for n in names]


def family(data_type: T.DataType) -> str:
    """integral, fractional, decimal, boolean, datetime, text or other."""
    if isinstance(data_type, INTEGRAL):
        return "integral"
    if isinstance(data_type, FRACTIONAL):
        return "fractional"
    if isinstance(data_type, T.DecimalType):
        return "decimal"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, DATETIME):
        return "datetime"
    if isinstance(data_type, TEXT):
        return "text"
    return "other"


def families(df: DataFrame) -> dict[str, str]:
    return {f.name: family(f.dataType) for f in df.schema.fields}


def is_numeric(df: DataFrame, name: str) -> bool:
    return family(df.schema[name].dataType) in ("integral", "fractional", "decimal")


def numeric_columns(df: DataFrame, names: list[str] | None = None) -> list[str]:
    """The numeric ones among ``names`` (all columns when None). Booleans are categories."""
    return [c for c in resolve_all(df, names) if is_numeric(df, c)]


def require_numeric(df: DataFrame, name: str) -> str:
    found = resolve(df, name)
    if not is_numeric(df, found):
        raise TypeError(f"column {found!r} is not numeric")
    return found


def sql_text(value: str) -> str:
    """``value`` as a SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_double(value: float | None) -> str:
    """``value`` as a SQL double, exact to the last bit."""
    return "CAST(NULL AS DOUBLE)" if value is None else f"CAST('{float(value)!r}' AS DOUBLE)"


def drawn(names: list[str], seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the values alone, for seeded samples."""
    texts = [F.coalesce(col(n).cast("string"), F.lit("-")) for n in names]
    digest = F.md5(F.concat_ws(":", F.lit(str(int(seed))), *texts))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def number(name: str) -> str:
    """SQL text for the column as a double."""
    return f"CAST({quoted(name)} AS DOUBLE)"


def present(df: DataFrame) -> DataFrame:
    """The frame with NaN turned to NULL, so that both count as missing.

    A frame without float or double columns comes back as it is.
    """
    fields = df.schema.fields
    if not any(isinstance(f.dataType, FRACTIONAL) for f in fields):
        return df
    texts = []
    for f in fields:
        name = quoted(f.name)
        if isinstance(f.dataType, FRACTIONAL):
            texts.append(f"nanvl({name}, CAST(NULL AS {f.dataType.simpleString()})) AS {name}")
        else:
            texts.append(name)
    return df.selectExpr(*texts)
