"""Column selection, renaming, labelling and relational stacking."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cols(
    df: DataFrame,
    any_of: Sequence[str] = (),
    contains: Sequence[str] = (),
    starts: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> list[str]:
    """Column names picked by pattern, in table order (B2).

    A column is taken when it is in ``any_of``, or when it passes ``contains`` or ``starts`` (if both
    are given, either will do) and holds none of ``exclude``. Patterns ignore case.
    """
    low = lambda words: [w.lower() for w in words]
    inside, heads, out = low(contains), low(starts), low(exclude)

    def wanted(name: str) -> bool:
        n = name.lower()
        if name in any_of:
            return True
        hit = any(w in n for w in inside) or any(n.startswith(w) for w in heads)
        return hit and not any(w in n for w in out)

    return [c for c in df.columns if wanted(c)]


def cols_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Column range first..last, both included."""
    a, b = df.columns.index(first), df.columns.index(last)
    return df.columns[a : b + 1]


def cols_at(df: DataFrame, *positions: int) -> list[str]:
    """Columns by 1-based position."""
    return [df.columns[p - 1] for p in positions]


def rename(df: DataFrame, names: dict[str, str], missing_ok: bool = False) -> DataFrame:
    """Rename old -> new (B4); a missing column is an error unless ``missing_ok``."""
    missing = [c for c in names if c not in df.columns]
    if missing and not missing_ok:
        raise ValueError(f"no such column: {missing}")
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def rename_matching(df: DataFrame, new: str, contains: str) -> DataFrame:
    """Rename the only column whose name holds a text."""
    found = cols(df, contains=[contains])
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns hold {contains!r}: {found}")
    return df.withColumnRenamed(found[0], new)


def apply_to(df: DataFrame, names: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Same transform over many columns."""
    return df.withColumns({c: fn(F.col(c)) for c in names})


def label_rules(df: DataFrame, col: str, rules: Sequence[tuple[Column, object]], default: object = None) -> DataFrame:
    """Sequential labelling where the last rule that holds wins."""
    out = F.lit(default)
    for condition, value in rules:
        out = F.when(condition, F.lit(value)).otherwise(out)
    return df.withColumn(col, out)


def layer_of(
    df: DataFrame, site: str, depth: str, boundaries: dict[str, float], out: str = "Layer",
    upper: str = "Epilimnion", lower: str = "Hypolimnion",
) -> DataFrame:
    """Layer by a boundary depth per site; the boundary itself is the lower layer."""
    rules = []
    for name, z in boundaries.items():
        here = F.col(site) == name
        rules += [(here & (F.col(depth) <= z), upper), (here & (F.col(depth) >= z), lower)]
    return label_rules(df, out, rules)


def layer_at(depth: str, boundary: float, upper: str = "Epilimnion", lower: str = "Hypolimnion") -> Column:
    """Layer by one boundary that belongs to the upper layer (B8, trap rule)."""
    return F.when(F.col(depth) <= boundary, F.lit(upper)).when(F.col(depth) > boundary, F.lit(lower))


def relabel(df: DataFrame, col: str, labels: dict[str, str], order: bool = False) -> DataFrame:
    """Level -> label; other values become NULL; optionally a ``<col>_order`` column."""
    source = F.col(col)
    label, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (level, text) in reversed(list(enumerate(labels.items(), 1))):
        label = F.when(source == level, F.lit(text)).otherwise(label)
        rank = F.when(source == level, F.lit(i)).otherwise(rank)
    new = {col: label}
    if order:
        new[f"{col}_order"] = rank
    return df.withColumns(new)


def swap_where(df: DataFrame, a: str, b: str, condition: Column) -> DataFrame:
    """Exchange two columns where a condition holds (B11); both read the old values."""
    return df.withColumns(
        {
            a: F.when(condition, F.col(b)).otherwise(F.col(a)),
            b: F.when(condition, F.col(a)).otherwise(F.col(b)),
        }
    )


def unswap(df: DataFrame, pairs: dict[str, tuple[str, str]], mode: str = "each", keep_zero: bool = False) -> DataFrame:
    """Repair total/soluble pairs entered the wrong way round.

    ``pairs``: difference column -> (total, soluble). A negative difference means swapped. ``each``
    repairs every pair on its own; ``both`` needs all pairs to agree and drops mixed signs. Exact ties
    and NULL differences are dropped unless ``keep_zero`` keeps the ties.
    """
    diffs = [F.col(d) for d in pairs]
    positive = reduce(lambda x, y: x & y, [(d >= 0 if keep_zero else d > 0) for d in diffs])
    negative = reduce(lambda x, y: x & y, [d < 0 for d in diffs])
    if mode == "both":
        df = df.where(positive | negative)
    elif mode == "each":
        df = df.where(reduce(lambda x, y: x & y, [(d.isNotNull() if keep_zero else d != 0) for d in diffs]))
    else:
        raise ValueError(mode)
    new = {}
    for d, (total, soluble) in pairs.items():
        wrong = negative if mode == "both" else F.col(d) < 0
        new[total] = F.when(wrong, F.col(soluble)).otherwise(F.col(total))
        new[soluble] = F.when(wrong, F.col(total)).otherwise(F.col(soluble))
        new[d] = F.when(wrong, F.col(soluble) - F.col(total)).otherwise(F.col(d))
    return df.withColumns(new)


def select_like(df: DataFrame, other: DataFrame) -> DataFrame:
    """Restore the column order of another table."""
    return df.select(*other.columns)


def patch(df: DataFrame, condition: Column, col: str, value: object) -> DataFrame:
    """Overwrite a column where a condition is true."""
    new = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(col, F.when(condition, new).otherwise(F.col(col)))


def add_time_parts(df: DataFrame, ts: str, date: str = "Date", year: str = "Year", doy: str = "DOY") -> DataFrame:
    """Date, year and day-of-year columns."""
    return df.withColumns({date: F.to_date(ts), year: F.year(ts), doy: F.dayofyear(ts)})


def stack(*dfs: DataFrame) -> DataFrame:
    """Append tables by column name, missing columns become NULL (H1)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def stack_strict(*dfs: DataFrame) -> DataFrame:
    """Append tables that must have the same columns (H2)."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def add_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Append literal rows; columns they lack are NULL (H3)."""
    unknown = [c for c in rows.columns if c not in df.columns]
    if unknown:
        raise ValueError(f"no such column: {unknown}")
    return df.unionByName(rows, allowMissingColumns=True).select(*df.columns)
