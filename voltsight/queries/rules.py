"""Association-rule queries."""

from pyspark.sql import functions as F

from ..catalog import GRID1_SQL, R, register, ts_text
from ..functions import columns as col
from ..operators import rules as ru
from ..sources import tables as src


def _tx(spark, sf_dir):
    return ru.transactions(src.grid_hourly(spark, sf_dir, n_series=1))


def _levels(x, prefix, e):
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {e}[2] THEN '{prefix}_LOW' "
            f"WHEN {x} <= {e}[3] THEN '{prefix}_MED' ELSE '{prefix}_HIGH' END")


Q = "[0, 1/3, 2/3, 1]"
TX_SQL = f"""
WITH g AS ({GRID1_SQL}),
b AS (SELECT ts, load, price, coalesce(solar, 0) + coalesce(wind, 0) AS renewable,
             coalesce(gas, 0) + coalesce(coal, 0) AS fossil, coalesce(nuclear, 0) AS nuclear
      FROM g WHERE load IS NOT NULL),
b2 AS (SELECT *, CASE WHEN renewable + fossil + nuclear > 0
                      THEN renewable / (renewable + fossil + nuclear) * 100 ELSE 0 END AS renewable_pct FROM b),
e AS (SELECT quantile_cont(load, {Q}) AS el, quantile_cont(price, {Q}) AS ep,
             quantile_cont(renewable_pct, {Q}) AS er, quantile_cont(fossil, {Q}) AS ef FROM b2),
t AS (SELECT ts, {_levels('load', 'demand', 'el')} AS demand_level, {_levels('price', 'price', 'ep')} AS price_level,
        {_levels('renewable_pct', 'renewable', 'er')} AS renewable_level, {_levels('fossil', 'fossil', 'ef')} AS fossil_level,
        CASE WHEN hour(ts) < 6 THEN 'time_NIGHT' WHEN hour(ts) < 12 THEN 'time_MORNING'
             WHEN hour(ts) < 18 THEN 'time_AFTERNOON' ELSE 'time_EVENING' END AS time_period,
        CASE WHEN month(ts) IN (12, 1, 2) THEN 'season_WINTER' WHEN month(ts) IN (3, 4, 5) THEN 'season_SPRING'
             WHEN month(ts) IN (6, 7, 8) THEN 'season_SUMMER' ELSE 'season_AUTUMN' END AS season,
        CASE WHEN isodow(ts) >= 6 THEN 'is_WEEKEND' ELSE 'is_WEEKDAY' END AS weekend_flag
      FROM b2, e),
tx AS (SELECT * FROM t WHERE demand_level IS NOT NULL AND price_level IS NOT NULL AND renewable_level IS NOT NULL
                         AND fossil_level IS NOT NULL),
it AS (SELECT ts, unnest([demand_level, price_level, renewable_level, fossil_level, time_period, season, weekend_flag]) AS item FROM tx),
n AS (SELECT count(*) AS n FROM tx),
s AS (SELECT [item] AS itemset, count(*) AS cnt FROM it GROUP BY item
      UNION ALL SELECT [a.item, b.item], count(*) FROM it a JOIN it b ON a.ts = b.ts AND a.item < b.item GROUP BY a.item, b.item
      UNION ALL SELECT [a.item, b.item, c.item], count(*) FROM it a JOIN it b ON a.ts = b.ts AND a.item < b.item
                JOIN it c ON b.ts = c.ts AND b.item < c.item GROUP BY a.item, b.item, c.item),
fi AS (SELECT itemset, cnt / n AS support, len(itemset) AS length FROM s, n WHERE cnt / n >= 0.05),
sp AS (SELECT support AS s_ac, [itemset[1]] AS ant, [itemset[2]] AS con FROM fi WHERE length = 2
       UNION ALL SELECT support, [itemset[2]], [itemset[1]] FROM fi WHERE length = 2
       UNION ALL SELECT support, [itemset[1]], [itemset[2], itemset[3]] FROM fi WHERE length = 3
       UNION ALL SELECT support, [itemset[2]], [itemset[1], itemset[3]] FROM fi WHERE length = 3
       UNION ALL SELECT support, [itemset[3]], [itemset[1], itemset[2]] FROM fi WHERE length = 3
       UNION ALL SELECT support, [itemset[1], itemset[2]], [itemset[3]] FROM fi WHERE length = 3
       UNION ALL SELECT support, [itemset[1], itemset[3]], [itemset[2]] FROM fi WHERE length = 3
       UNION ALL SELECT support, [itemset[2], itemset[3]], [itemset[1]] FROM fi WHERE length = 3),
r0 AS (SELECT sp.ant, sp.con, fa.support AS s_a, fc.support AS s_c, s_ac
       FROM sp JOIN fi fa ON fa.itemset = sp.ant JOIN fi fc ON fc.itemset = sp.con),
rl AS (SELECT ant, con, s_a, s_c, s_ac, s_ac / s_a AS confidence, (s_ac / s_a) / s_c AS lift,
              s_ac - s_a * s_c AS leverage,
              CASE WHEN s_ac / s_a < 1.0 THEN (1 - s_c) / (1 - s_ac / s_a) ELSE 'inf'::DOUBLE END AS conviction,
              CASE WHEN greatest(s_ac * (1 - s_a), s_a * (s_c - s_ac)) = 0 THEN 0.0
                   ELSE (s_ac - s_a * s_c) / greatest(s_ac * (1 - s_a), s_a * (s_c - s_ac)) END AS zhangs_metric
       FROM r0),
rules AS (SELECT * FROM rl WHERE lift >= 1.2 AND confidence >= 0.5)
"""


@register("r1_transactions", TX_SQL + f"""
SELECT {ts_text('ts')} AS ts, array_to_string([demand_level, price_level, renewable_level, fossil_level,
       time_period, season, weekend_flag], '|') AS items FROM tx
""")
def q_transactions(spark, sf_dir):
    """R1 (+F4-F6, F9): seven items per hour."""
    return _tx(spark, sf_dir).select("ts", F.array_join("items", "|").alias("items"))


@register("r2_frequent_itemsets", TX_SQL + f"""
SELECT array_to_string(itemset, ', ') AS itemset, {R('support')} AS support, CAST(length AS BIGINT) AS length FROM fi
""")
def q_itemsets(spark, sf_dir):
    """R2: frequent itemsets (support >= 0.05, size <= 3)."""
    fi = ru.frequent_itemsets(_tx(spark, sf_dir))
    return fi.select(F.array_join("itemset", ", ").alias("itemset"), "support", "length")


_RULE_COLS = f"""array_to_string(ant, ', ') AS antecedents, array_to_string(con, ', ') AS consequents,
  {R('s_a')} AS antecedent_support, {R('s_c')} AS consequent_support, {R('s_ac')} AS support,
  {R('confidence')} AS confidence, {R('lift')} AS lift, {R('leverage')} AS leverage,
  {R('conviction')} AS conviction, {R('zhangs_metric')} AS zhangs_metric"""


@register("r3_association_rules", TX_SQL + f"SELECT {_RULE_COLS} FROM rules")
def q_rules(spark, sf_dir):
    """R3 + R4: every antecedent/consequent split, lift >= 1.2, confidence >= 0.5."""
    return ru.rules_text(ru.association_rules(ru.frequent_itemsets(_tx(spark, sf_dir))))


@register("r5_top_rules", TX_SQL + f"""
SELECT {_RULE_COLS} FROM rules
ORDER BY lift DESC, array_to_string(ant, ', '), array_to_string(con, ', ') LIMIT 10
""")
def q_top_rules(spark, sf_dir):
    """Top 10 rules by lift (rule text breaks ties)."""
    r = ru.association_rules(ru.frequent_itemsets(_tx(spark, sf_dir)))
    return ru.rules_text(ru.top_rules(r, 10))


@register("r6_rule_query", TX_SQL + f"""
, q AS (SELECT * FROM rules WHERE list_contains(ant, 'demand_HIGH')
        ORDER BY lift DESC, array_to_string(ant, ', '), array_to_string(con, ', ') LIMIT 5)
SELECT array_to_string(ant, ', ') AS antecedents, array_to_string(con, ', ') AS consequents,
  {R('round_even(s_ac, 4)')} AS support, {R('round_even(confidence, 4)')} AS confidence, {R('round_even(lift, 4)')} AS lift,
  'When [' || array_to_string(ant, ', ') || '], then [' || array_to_string(con, ', ') || '] with '
    || CAST(round_even(confidence * 100, 1) AS VARCHAR) || '% confidence (lift=' || printf('%.2f', lift) || ')' AS interpretation
FROM q
""")
def q_rule_query(spark, sf_dir):
    """R6 + F10: rules whose antecedents hold demand_HIGH, top 5 with their sentence."""
    r = ru.association_rules(ru.frequent_itemsets(_tx(spark, sf_dir)))
    out = ru.query_rules(r, demand_level="HIGH", top_n=5)
    return out.withColumn("antecedents", F.array_join("antecedents", ", ")).withColumn(
        "consequents", F.array_join("consequents", ", "))


@register("r7_rules_diagnostics", TX_SQL + "SELECT count(*) AS rows, CAST(10 AS BIGINT) AS columns FROM rules")
def q_rules_diag(spark, sf_dir):
    """Rule-table diagnostics (rows, columns)."""
    return ru.rules_diagnostics(ru.association_rules(ru.frequent_itemsets(_tx(spark, sf_dir))))


_EDGES, _QUOTES = """'[]{}()''" ' || chr(9) || chr(10)""", """'''" '"""


def _items_sql(cell: str) -> str:
    literal = (f"""list_transform(regexp_extract_all({cell}, '''[^'']*''|"[^"]*"'), lambda q: trim(q, {_QUOTES}))""")
    separated = (f"""list_transform(string_split_regex(trim({cell}, {_EDGES}), """
                 r"""'[,;/\\|\n]'), lambda q: trim(q, """ + f"{_QUOTES}))")
    bracketed = rf"""regexp_matches({cell}, '^\s*[\[({{]') AND len({literal}) > 0"""
    both = f"CASE WHEN {bracketed} THEN {literal} ELSE {separated} END"
    return f"array_to_string(list_sort(list_distinct(list_filter({both}, lambda q: q <> ''))), ' & ')"


@register("s10_rule_text_parse", TX_SQL + f"""
, t2 AS (SELECT '[' || array_to_string(list_transform(con, lambda x: '''' || x || ''''), ' | ') || ']' AS raw,
                '[''' || array_to_string(con, '/') || ''', "c, d"]' AS quoted, array_to_string(con, ' ; ') AS plain FROM rules)
SELECT raw, quoted, plain, {_items_sql('raw')} AS parsed, {_items_sql('quoted')} AS parsed_quoted, {_items_sql('plain')} AS parsed_plain
FROM t2
""")
def q_rule_text_parse(spark, sf_dir):
    """Tolerant parsing of rule cells written as list text."""
    r = ru.association_rules(ru.frequent_itemsets(_tx(spark, sf_dir)))
    raw = F.concat(F.lit("["), F.array_join(F.transform("consequents", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), " | "),
                   F.lit("]"))
    t = r.select(raw.alias("raw"), F.concat(F.lit("['"), F.array_join("consequents", "/"), F.lit("', \"c, d\"]")).alias("quoted"),
                 F.array_join("consequents", " ; ").alias("plain"))
    parsed = {"raw": "parsed", "quoted": "parsed_quoted", "plain": "parsed_plain"}
    return t.select("*", *[F.array_join(col.parse_item_list(c), " & ").alias(n) for c, n in parsed.items()])


_MEASURES = ("antecedent_support", "consequent_support", "support", "confidence", "lift", "leverage", "conviction", "zhangs_metric")


@register("r7_rules_sample", TX_SQL + f"""
, top AS (SELECT {_RULE_COLS} FROM rules ORDER BY lift DESC, array_to_string(ant, ', '), array_to_string(con, ', ') LIMIT 1),
c AS (SELECT 1 AS position, 'antecedents' AS column_name, 'array<string>' AS type, antecedents AS text_value, CAST(NULL AS DOUBLE) AS number_value FROM top
  UNION ALL SELECT 2, 'consequents', 'array<string>', consequents, NULL FROM top
""" + "".join(f"  UNION ALL SELECT {i}, '{m}', 'double', NULL, {m} FROM top\n" for i, m in enumerate(_MEASURES, 3)) + """)
SELECT CAST(position AS BIGINT) AS position, column_name, type, text_value, number_value, (SELECT count(*) FROM rules) AS rows FROM c
""")
def q_rules_sample(spark, sf_dir):
    """Columns, types and first row of the rule table."""
    return ru.rules_sample(ru.association_rules(ru.frequent_itemsets(_tx(spark, sf_dir))))


_F9 = {"quantity": "l_quantity", "from_four": "greatest(l_linenumber, 4)", "constant": "l_linenumber * 0"}


@register("f9_tercile_levels", "WITH x AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS input, CAST({v} AS DOUBLE) AS v FROM lineitem" for n, v in _F9.items()) + """),
w AS (SELECT input, v, rank() OVER (PARTITION BY input ORDER BY v) + (count(*) OVER (PARTITION BY input, v) - 1) / 2.0 AS r FROM x WHERE v IS NOT NULL),
e AS (SELECT input, list_sort(list_distinct(quantile_cont(v, [0.0, 1.0 / 3, 2.0 / 3, 1.0]))) AS ev,
             list_sort(list_distinct(quantile_cont(r, [0.0, 1.0 / 3, 2.0 / 3, 1.0]))) AS er FROM w GROUP BY 1),
m AS (SELECT *, CASE WHEN len(ev) = 4 THEN 'values' WHEN len(er) = 4 THEN 'ranks' ELSE 'collapsed' END AS mode FROM e),
l AS (SELECT input, mode, CASE WHEN mode = 'values' THEN len(list_filter(ev[2:], lambda q: q < v)) ELSE len(list_filter(er[2:], lambda q: q < r)) END AS i
      FROM w JOIN m USING (input))
SELECT input, mode, input || '_' || CASE i WHEN 0 THEN 'LOW' WHEN 1 THEN 'MED' ELSE 'HIGH' END AS level, count(*) AS rows FROM l GROUP BY ALL
""")
def q_tercile_levels(spark, sf_dir):
    """tercile levels of a column with distinct edges, one with tied edges and a
    constant one, with the way the levels were cut."""
    li = src.read_table(spark, sf_dir, "lineitem").select("l_quantity", "l_linenumber")
    out = None
    for name, value in _F9.items():
        rows, mode = ru.tercile_levels(li.select(F.expr(value).cast("double").alias("v")), "v", name, "level")
        part = rows.where("level IS NOT NULL").groupBy("level").agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("input"), F.lit(mode).alias("mode"), "level", "rows")
        out = part if out is None else out.unionByName(part)
    return out
