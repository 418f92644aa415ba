"""Association-rule mining (R1-R7, F9) as Spark aggregations.

Every transaction holds exactly one item per category (7 items), so its
itemsets of size <= 3 are the 63 index combinations of its own items:
exploding them and counting with a partial aggregation is the exact
Apriori result (a hot itemset is combined map-side).  The itemset table is
bounded by the item vocabulary (22 items -> at most 2,024 itemsets of size
<= 3), which is the proven bound that lets it be broadcast to the rule
step.  Every antecedent/consequent split is generated - not only
single-item consequents.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as col
from . import windows as win
from .profile import quantile_row, scalars

TRANSACTION_COLS = ("demand_level", "price_level", "renewable_level", "fossil_level",
                    "time_period", "season", "weekend_flag")


_PROBS = (0.0, 1 / 3, 2 / 3, 1.0)


def _edges(df: DataFrame, cols) -> dict:
    """Exact quartile-style edges (0, 1/3, 2/3, 1) of several columns in one job."""
    row = quantile_row(df, {f"{c}__{i}": (c, p) for c in cols for i, p in enumerate(_PROBS)}).first()
    edges = {c: [row[f"{c}__{i}"] for i in range(len(_PROBS))] for c in cols}
    return {c: None if e[0] is None else e for c, e in edges.items()}


def tercile_levels(df: DataFrame, x: str, prefix: str, out: str, edges=None) -> tuple[DataFrame, str]:
    """``qcut(q=3)`` labels ``{prefix}_LOW/MED/HIGH``.

    Edges are exact quantiles (0, 1/3, 2/3, 1); bins are right-closed with
    the lowest edge included.  Tied edges fall back to average ranks; if
    the rank edges still tie, the bins collapse to the distinct edges and
    the returned mode says so.
    """
    labels = [f"{prefix}_{s}" for s in C.LEVEL_SUFFIXES]
    e = edges if edges is not None else _edges(df, [x])[x]
    mode, src = "values", x
    if e is None or len(set(e)) < 4:
        df = win.average_rank(df, x, f"_rk_{x}")
        src, mode = f"_rk_{x}", "ranks"
        e = _edges(df, [src])[src]
        if e is None or len(set(e)) < 4:
            mode = "collapsed"
    v = F.col(src)
    if mode == "collapsed":
        uniq = sorted(set(e or []))
        lvl = F.lit(labels[0]) if len(uniq) < 2 else None
        for k in range(1, len(uniq)):
            cond = v <= F.lit(uniq[k])
            lvl = F.when(cond, labels[k - 1]) if lvl is None else lvl.when(cond, labels[k - 1])
        lvl = F.when(v.isNull(), F.lit(None).cast("string")).otherwise(lvl)
    else:
        lvl = (F.when(v.isNull(), F.lit(None).cast("string"))
                .when(v <= F.lit(e[1]), labels[0]).when(v <= F.lit(e[2]), labels[1]).otherwise(labels[2]))
    out_df = df.withColumn(out, lvl)
    if src != x:
        out_df = out_df.drop(src)
    return out_df, mode


def transactions(df: DataFrame, ts: str = "ts", demand: str = "load", price: str = "price",
                 groups: C.GroupSpec = C.GRID_GROUPS) -> DataFrame:
    """Discretise each hour into 7 items; incomplete rows dropped."""
    d = col.with_generation_groups(df, groups)
    d = (d.withColumn("hour", F.hour(ts)).withColumn("month", F.month(ts)).withColumn("is_weekend", col.is_weekend(ts)))
    d = d.where(F.col(demand).isNotNull())
    e = _edges(d, [demand, price, "renewable_pct", "fossil"])
    d, _ = tercile_levels(d, demand, "demand", "demand_level", e[demand])
    d, _ = tercile_levels(d, price, "price", "price_level", e[price])
    d, _ = tercile_levels(d, "renewable_pct", "renewable", "renewable_level", e["renewable_pct"])
    d, _ = tercile_levels(d, "fossil", "fossil", "fossil_level", e["fossil"])
    d = (d.withColumn("time_period", col.part_of_day("hour")).withColumn("season", col.season("month"))
          .withColumn("weekend_flag", col.weekend_label("is_weekend")))
    d = d.dropna(subset=list(TRANSACTION_COLS))
    return d.select(ts, F.array(*[F.col(c) for c in TRANSACTION_COLS]).alias("items"))


def _subsets(items: Column, n_items: int, max_len: int) -> Column:
    combos = [c for k in range(1, max_len + 1) for c in combinations(range(n_items), k)]
    return F.array(*[F.array_sort(F.array(*[items[i] for i in c])) for c in combos])


def frequent_itemsets(tx: DataFrame, min_support: float = C.RULE_MIN_SUPPORT, max_len: int = C.RULE_MAX_LEN,
                      n_items: int = len(TRANSACTION_COLS)) -> DataFrame:
    """R2: itemsets with support >= ``min_support`` and size <= ``max_len``."""
    n = tx.agg(F.count(F.lit(1)).alias("n"))
    from .profile import scalars
    total = scalars(n)["n"]
    c = tx.select(F.explode(_subsets(F.col("items"), n_items, max_len)).alias("itemset")) \
          .groupBy("itemset").agg(F.count(F.lit(1)).alias("cnt"))
    return c.select("itemset", (F.col("cnt") / total).alias("support"), F.size("itemset").alias("length")) \
            .where(F.col("support") >= min_support)


def _splits(itemset: Column) -> Column:
    """All (antecedent, consequent) splits of a size-2 or size-3 itemset."""
    def pair(a, c):
        return F.struct(F.array(*[itemset[i] for i in a]).alias("ant"), F.array(*[itemset[i] for i in c]).alias("con"))
    two = F.array(pair([0], [1]), pair([1], [0]))
    three = F.array(*[pair(list(a), [i for i in range(3) if i not in a])
                      for k in (1, 2) for a in combinations(range(3), k)])
    return F.when(F.size(itemset) == 2, two).otherwise(three)


def association_rules(itemsets: DataFrame, min_lift: float = C.RULE_MIN_LIFT,
                      min_confidence: float = C.RULE_MIN_CONFIDENCE) -> DataFrame:
    """R3 + R4: every split of every frequent itemset, with support,
    confidence, lift, leverage, conviction (inf at confidence 1) and
    Zhang's metric; kept when lift and confidence pass."""
    big = itemsets.where(F.col("length") >= 2).select(F.col("support").alias("s_ac"),
                                                      F.explode(_splits(F.col("itemset"))).alias("r"))
    sup = F.broadcast(itemsets.select("itemset", "support"))
    r = (big.join(sup.withColumnRenamed("itemset", "_a").withColumnRenamed("support", "s_a"), F.col("r.ant") == F.col("_a"))
            .join(sup.withColumnRenamed("itemset", "_c").withColumnRenamed("support", "s_c"), F.col("r.con") == F.col("_c")))
    conf = F.col("s_ac") / F.col("s_a")
    lev = F.col("s_ac") - F.col("s_a") * F.col("s_c")
    den = F.greatest(F.col("s_ac") * (1 - F.col("s_a")), F.col("s_a") * (F.col("s_c") - F.col("s_ac")))
    out = r.select(F.array_sort("r.ant").alias("antecedents"), F.array_sort("r.con").alias("consequents"),
                   F.col("s_a").alias("antecedent_support"), F.col("s_c").alias("consequent_support"),
                   F.col("s_ac").alias("support"), conf.alias("confidence"),
                   (conf / F.col("s_c")).alias("lift"), lev.alias("leverage"),
                   F.when(conf < 1.0, (1 - F.col("s_c")) / (1 - conf)).otherwise(F.lit(float("inf"))).alias("conviction"),
                   F.when(den == 0, F.lit(0.0)).otherwise(lev / den).alias("zhangs_metric"))
    return out.where((F.col("lift") >= min_lift) & (F.col("confidence") >= min_confidence))


def rules_text(rules: DataFrame) -> DataFrame:
    """Arrays as sorted ', '-joined text (CSV form)."""
    return rules.withColumn("antecedents", col.sorted_set_text("antecedents")) \
                .withColumn("consequents", col.sorted_set_text("consequents"))


def top_rules(rules: DataFrame, n: int = 10) -> DataFrame:
    """Highest lift first, ties broken by the rule text."""
    return rules.orderBy(F.col("lift").desc(), col.sorted_set_text("antecedents"),
                         col.sorted_set_text("consequents")).limit(n)


def query_rules(rules: DataFrame, demand_level=None, price_level=None, renewable_level=None,
                top_n: int = 5) -> DataFrame:
    """Rules whose antecedents contain every requested level item,
    ranked by lift, with the rounded measures and the sentence (F10)."""
    wanted = [f"demand_{demand_level}" if demand_level else None, f"price_{price_level}" if price_level else None,
              f"renewable_{renewable_level}" if renewable_level else None]
    wanted = [w for w in wanted if w]
    r = rules
    for w in wanted:
        r = r.where(F.array_contains("antecedents", w))
    r = top_rules(r, top_n)
    return r.select(F.array_sort("antecedents").alias("antecedents"), F.array_sort("consequents").alias("consequents"),
                    F.bround("support", 4).alias("support"), F.bround("confidence", 4).alias("confidence"),
                    F.bround("lift", 4).alias("lift"),
                    col.rule_sentence("antecedents", "consequents", "confidence", "lift").alias("interpretation"))


def rules_diagnostics(rules: DataFrame) -> DataFrame:
    """Row count and column count of the rule table."""
    return rules.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(rules.columns)))


def rules_sample(rules: DataFrame) -> DataFrame:
    """Schema and sample row of the rule table: position, name and type of each
    column with its value in the first rule (highest lift) as text or number, and
    the number of rules; no row for an empty table."""
    n = rules.agg(F.count(F.lit(1)).alias("rows"))
    cells = []
    for i, f in enumerate(rules.schema.fields):
        number = f.dataType.typeName() in ("double", "float", "long", "integer")
        text = F.concat_ws(", ", F.array_sort(f.name)) if f.dataType.typeName() == "array" else F.col(f.name).cast("string")
        cells.append(F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("column_name"),
                              F.lit(f.dataType.simpleString()).alias("type"),
                              (F.lit(None).cast("string") if number else text).alias("text_value"),
                              (F.col(f.name).cast("double") if number else F.lit(None).cast("double")).alias("number_value")))
    return top_rules(rules, 1).select(F.inline(F.array(*cells))).withColumn("rows", scalars(n)["rows"])
