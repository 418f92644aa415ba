"""Column expressions.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` so the
expressions stay inside whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------- P1/P2
def null_as_zero_sum(cols) -> Column:
    """Sum of a column group with nulls counted as 0 (never null)."""
    cols = list(cols)
    if not cols:
        return F.lit(0.0)
    return reduce(lambda a, b: a + b, [F.coalesce(_col(c).cast("double"), F.lit(0.0)) for c in cols])


def guarded_pct(part, total) -> Column:
    """``part / total * 100`` when ``total > 0`` else 0."""
    return F.when(_col(total) > 0, _col(part) / _col(total) * 100.0).otherwise(F.lit(0.0))


def with_generation_groups(df: DataFrame, spec: C.GroupSpec) -> DataFrame:
    """Add renewable / fossil / nuclear / other / total_gen (+ renewable_pct)."""
    present = set(df.columns)
    pick = lambda cols: [c for c in cols if c in present]  # noqa: E731 - missing members count as 0
    out = df.withColumn("renewable", null_as_zero_sum(pick(spec.renewable))) \
            .withColumn("fossil", null_as_zero_sum(pick(spec.fossil)))
    parts = ["renewable", "fossil"]
    if spec.nuclear:
        out = out.withColumn("nuclear", null_as_zero_sum(pick(spec.nuclear)))
        parts.append("nuclear")
    if spec.other:
        out = out.withColumn("other", null_as_zero_sum(pick(spec.other)))
        parts.append("other")
    if spec.with_pct:
        out = out.withColumn("total_gen", reduce(lambda a, b: a + b, [F.col(p) for p in parts]))
        out = out.withColumn("renewable_pct", guarded_pct("renewable", "total_gen"))
    return out


# --------------------------------------------------------------------- F1-F3
def hour_of(ts) -> Column:
    return F.hour(_col(ts))


def day_of_week(ts) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_col(ts))


def is_weekend(ts) -> Column:
    """1 on Saturday / Sunday."""
    return (F.weekday(_col(ts)) >= 5).cast("int")


def cyclic(x, period: float, fn: str = "sin") -> Column:
    """``sin/cos(2*pi*x/period)``."""
    arg = F.lit(2.0 * math.pi) * _col(x).cast("double") / F.lit(float(period))
    return F.sin(arg) if fn == "sin" else F.cos(arg)


def with_calendar(df: DataFrame, ts: str = "ts", month_offset: int = 0) -> DataFrame:
    """F1-F3 calendar and cyclic encodings of ``ts``."""
    m = F.month(F.col(ts)) - F.lit(month_offset)
    return (df.withColumn("hour", F.hour(ts))
              .withColumn("day_of_week", day_of_week(ts))
              .withColumn("month", F.month(ts))
              .withColumn("is_weekend", is_weekend(ts))
              .withColumn("hour_sin", cyclic(F.hour(ts), 24, "sin"))
              .withColumn("hour_cos", cyclic(F.hour(ts), 24, "cos"))
              .withColumn("month_sin", cyclic(m, 12, "sin"))
              .withColumn("month_cos", cyclic(m, 12, "cos")))


# --------------------------------------------------------------------- F4-F8
def part_of_day(hour) -> Column:
    """<6 night, <12 morning, <18 afternoon, else evening."""
    h = _col(hour)
    return (F.when(h < 6, C.TIME_PERIODS[0]).when(h < 12, C.TIME_PERIODS[1])
             .when(h < 18, C.TIME_PERIODS[2]).otherwise(C.TIME_PERIODS[3]))


def season(month) -> Column:
    """meteorological season of a month number."""
    m = _col(month)
    return (F.when(m.isin(12, 1, 2), C.SEASONS[0]).when(m.isin(3, 4, 5), C.SEASONS[1])
             .when(m.isin(6, 7, 8), C.SEASONS[2]).otherwise(C.SEASONS[3]))


def weekend_label(flag) -> Column:
    """1 -> is_WEEKEND, 0 -> is_WEEKDAY."""
    f = _col(flag)
    return F.when(f == 1, C.WEEKEND_LABELS[1]).when(f == 0, C.WEEKEND_LABELS[0])


def three_class(x, t1, t2, labels=C.CLASS_LABELS) -> Column:
    """inclusive upper bounds; null input stays null."""
    x = _col(x)
    t1 = t1 if isinstance(t1, Column) else F.lit(t1)
    t2 = t2 if isinstance(t2, Column) else F.lit(t2)
    return (F.when(x.isNull(), F.lit(None).cast("string"))
             .when(x <= t1, labels[0]).when(x <= t2, labels[1]).otherwise(labels[2]))


def class_code(label) -> Column:
    """One ordinal code Low=0, Medium=1, High=2 (unknown -> 1)."""
    lab = _col(label)
    return (F.when(lab == "Low", 0).when(lab == "Medium", 1).when(lab == "High", 2)
             .otherwise(F.lit(1))).cast("int")


def class_label(code) -> Column:
    """J4 inverse: 0/1/2 -> Low/Medium/High."""
    c = _col(code)
    return F.when(c == 0, "Low").when(c == 1, "Medium").when(c == 2, "High")


def regime_label(x, q33, q66) -> Column:
    """F8: strict bounds on two quantiles."""
    x = _col(x)
    return (F.when(x < q33, "Low Demand Regime").when(x < q66, "Medium Demand Regime")
             .otherwise("High Demand Regime"))


# ------------------------------------------------------------------- F10-F14
def sorted_set_text(arr) -> Column:
    """``', '.join(sorted(x))``."""
    return F.array_join(F.array_sort(_col(arr)), ", ")


def rule_sentence(antecedents, consequents, confidence, lift) -> Column:
    """``When [..], then [..] with c% confidence (lift=x.xx)``."""
    return F.format_string(
        "When [%s], then [%s] with %s%% confidence (lift=%s)",
        sorted_set_text(antecedents), sorted_set_text(consequents),
        F.bround(_col(confidence) * 100.0, 1).cast("string"),
        F.format_string("%.2f", _col(lift)),
    )


def slugify(text) -> Column:
    """lower case, space and '/' -> '_'."""
    return F.translate(F.lower(_col(text)), " /", "__")


def py_round(x, digits: int) -> Column:
    """half-to-even rounding, as Python's ``round``."""
    return F.bround(_col(x), digits)


def fmt_number(x, digits: int = 2) -> Column:
    """thousands separators, fixed decimals."""
    return F.format_number(_col(x), digits)


def fmt_datetime(ts, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """timestamp text."""
    return F.date_format(_col(ts), pattern)


def parse_item_list(text, sort: bool = True) -> Column:
    """Items of a rule cell, whatever its notation.

    A bracketed list literal yields its quoted items whole.  Any other cell
    is a separated text (``, ; / \\ |`` or line ends) whose outer brackets,
    quotes and blanks don't belong to the items.  Blank items are dropped;
    with ``sort`` the items are de-duplicated and sorted.
    """
    cell = _col(text)
    edges, quotes = F.lit("[]{}()'\" \t\n"), F.lit("'\" ")
    literal = F.transform(F.regexp_extract_all(cell, F.lit("'[^']*'|\"[^\"]*\""), F.lit(0)), lambda q: F.btrim(q, quotes))
    separated = F.transform(F.split(F.btrim(cell, edges), r"[,;/\\|\n]"), lambda q: F.btrim(q, quotes))
    parts = F.filter(F.when(cell.rlike(r"^\s*[\[({]") & (F.size(literal) > 0), literal).otherwise(separated), lambda q: q != "")
    if sort:
        parts = F.array_sort(F.array_distinct(parts))
    return F.when(_col(text).isNull(), F.array().cast("array<string>")).otherwise(parts)


def clean_rule_text(text) -> Column:
    """newline/pipe -> comma, trim parts, drop blanks, keep order."""
    return F.array_join(parse_item_list(text, sort=False), ", ")


def feature_row(df: DataFrame, features) -> DataFrame:
    """Exactly ``features`` in order; missing or null -> 0.0."""
    present = set(df.columns)
    return df.select(*[
        F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) if f in present
        else F.lit(0.0).alias(f) for f in features])
