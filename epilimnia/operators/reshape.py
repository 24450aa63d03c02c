"""Wide to long and long to wide."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(
    df: DataFrame,
    ids: Sequence[str],
    name: str | Sequence[str] = "variable",
    value: str = "observation",
    cols: Sequence[str] | None = None,
    prefix: str | None = None,
    sep: str | None = None,
) -> DataFrame:
    """Unpivot; NULLs are kept.

    ``prefix`` is cut from the names (I2). With ``sep`` the name is split into the columns listed in
    ``name`` (I3). Names are known when the plan is built, so both become constants of the plan.
    """
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in ids]
    names = [name] if isinstance(name, str) else list(name)
    pieces = {}
    for c in cols:
        text = c[len(prefix):] if prefix and c.startswith(prefix) else c
        pieces[c] = text.split(sep) if sep else [text]
        if len(pieces[c]) != len(names):
            raise ValueError(f"{c!r} does not split into {names}")
    if len(names) == 1:
        shown = {c: pieces[c][0] for c in cols}
        renamed = df.select(*ids, *[F.col(c).alias(shown[c]) for c in cols])
        return renamed.unpivot(list(ids), list(shown.values()), names[0], value)
    cells = [
        F.struct(*[F.lit(p).alias(n) for n, p in zip(names, pieces[c])], F.col(c).alias(value)) for c in cols
    ]
    return df.select(*ids, F.explode(F.array(*cells)).alias("__c")).select(*ids, "__c.*")


def to_long_pairs(
    df: DataFrame, ids: Sequence[str], pairs: dict[str, str], name: str = "variable",
    value: str = "observation", flag: str = "flag_value",
) -> DataFrame:
    """Unpivot value columns together with their flag columns: no join of two long tables needed."""
    cells = [
        F.struct(F.lit(v).alias(name), F.col(v).cast("double").alias(value), F.col(f).cast("int").alias(flag))
        for v, f in pairs.items()
    ]
    return df.select(*ids, F.explode(F.array(*cells)).alias("__c")).select(*ids, "__c.*")


def split_name(df: DataFrame, col: str, names: Sequence[str], delim: str = "_") -> DataFrame:
    """Split a text column into exactly ``len(names)`` columns; another count is an error."""
    pieces = F.split(F.col(col), f"\\Q{delim}\\E")
    checked = F.when(F.size(pieces) == len(names), pieces).otherwise(
        F.raise_error(F.concat(F.lit("wrong number of name parts: "), F.col(col)))
    )
    keep = [c for c in df.columns if c != col]
    parts = df.select(*keep, F.when(F.col(col).isNotNull(), checked).alias("__p"))
    return parts.select(*keep, *[F.col("__p").getItem(i).alias(n) for i, n in enumerate(names)])


def to_wide(
    df: DataFrame,
    ids: Sequence[str],
    name: str | Sequence[str],
    value: str | Sequence[str],
    values: Sequence,
    sep: str = "_",
    fill: object = None,
) -> DataFrame:
    """Pivot to one column per entry of ``values``.

    ``values`` is explicit, so no extra job looks for it. With several name columns it lists tuples;
    with several value columns the results are called ``<value><sep><name>``. One value per cell is
    expected; of several, the largest is taken.
    """
    value = [value] if isinstance(value, str) else list(value)
    names = [name] if isinstance(name, str) else list(name)
    cells = [v if isinstance(v, tuple) else (v,) for v in values]
    aggs, out = [], []
    for i, cell in enumerate(cells):
        here = None
        for n, v in zip(names, cell):
            test = F.col(n) == v
            here = test if here is None else here & test
        label = sep.join(str(v) for v in cell)
        for v in value:
            final = label if len(value) == 1 else f"{v}{sep}{label}"
            aggs.append(F.max(F.when(here, F.col(v))).alias(final))
            out.append(final)
    wide = df.groupBy(*ids).agg(*aggs)
    return wide if fill is None else wide.fillna(fill, subset=out)


def cell_names(*levels: Sequence) -> list[tuple]:
    """All combinations of name parts, for ``to_wide`` with several name columns."""
    return list(product(*levels))
