"""What all families share: columns from names, IEEE arithmetic, ordered folds, accessors for `summary >> accessor`."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str
NAN, INF = float("nan"), float("inf")


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def value(c) -> Column:
    """A column as it is, anything else as a literal."""
    return c if isinstance(c, Column) else F.lit(c)


def null(kind: str = "double") -> Column:
    return F.lit(None).cast(kind)


def ieee_div(a: Column, b: Column) -> Column:
    """a / b as in IEEE 754: dividing by zero gives an infinity or NaN, never an error."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def fold(rows: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(rows, zero, step)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it; without it nested formulas double at every level."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def let2(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda r: f(r["a"], r["b"]))


def sum_of(rows: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda acc, s: acc + f(s).cast("double"))


def need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


class Accessor:
    """The right side of `summary >> accessor`: a function of the summary with its other arguments bound."""

    def __init__(self, function: Callable, *args, **options):
        self.function, self.args, self.options = function, args, options

    def __call__(self, summary: ColumnLike) -> Column:
        return self.function(col(summary), *self.args, **self.options)

    def __rrshift__(self, summary: ColumnLike) -> Column:
        return self(summary)

    def __repr__(self) -> str:
        return f"{self.function.__name__}({', '.join(map(repr, self.args))})"


class Accessors:
    """Each of some functions as a constructor of accessors: acc.rate() for rate(summary)."""

    def __init__(self, *functions: Callable):
        for f in functions:
            setattr(self, f.__name__, lambda *a, _f=f, **o: Accessor(_f, *a, **o))
        self.names = [f.__name__ for f in functions]


def own_keys(f: Callable) -> Callable:
    """For functions of (frame, keys, ...): keys get names that cannot clash with the function's own columns."""

    @wraps(f)
    def run(df: DataFrame, keys: list[str], *args, **options) -> DataFrame:
        inner = {f"__key{i}": k for i, k in enumerate(keys)}
        out = f(df.withColumns({n: F.col(k) for n, k in inner.items()}) if inner else df, list(inner), *args, **options)
        rest = [c for c in out.columns if c not in inner]
        return out.select(*(F.col(n).alias(k) for n, k in inner.items()), *rest)

    return run


def salted_rollup(df: DataFrame, keys: list[str], column: str, rollup: Callable[[Column], Column], parts: int = 32) -> DataFrame:
    """Roll up summaries whose order does not matter in two steps, so that a key with very many of them is first
    merged in `parts` parts."""
    salt = F.pmod(F.xxhash64(column), F.lit(parts)).alias("__part")  # of what the row holds: a task that runs again deals alike
    first = df.select(*keys, column, salt).groupBy(*keys, "__part").agg(rollup(F.col(column)).alias(column))
    return first.groupBy(*keys).agg(rollup(F.col(column)).alias(column))
