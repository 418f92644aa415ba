"""Lookups and joins.

* J1 as-of: requests and history are unioned and ordered inside
  ``(series, day, salt)`` partitions; the last history struct at or before
  each probe comes from ``last(ignorenulls)``, and probes whose day holds no
  earlier history take the carry from the small per-day table.  History rows
  are copied to every salt so a hot series-day of requests is spread over
  ``salts`` tasks.  No pairs are emitted.
* J2 interval mean: a range join on an equi-key (series, day): each request
  is exploded to the days its window touches (two for 24 h).  History
  has one row per series-hour (the grain of the hourly table), so each
  request meets at most 25 history rows.
* ``by_slot``: against an hourly history all requests of one series and hour
  (those on the hour apart from those within it) have the same answer, so the
  lookups run once per distinct slot - at most 48 a series-day, however many
  requests there are - and the requests take one equi-join on their slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..session import cut_lineage


def _bucket(col: Column, unit: str) -> Column:
    return F.date_trunc(unit, col).cast("timestamp_ntz")


def asof_backward(probes: DataFrame, history: DataFrame, keys, probe_ts: str, hist_ts: str, values,
                  probe_cols, bucket_unit: str = "day", salts: int = 8, out: str = "_match") -> DataFrame:
    """For each probe, the struct of ``values`` from the last history row
    with ``hist_ts <= probe_ts`` (same keys), or null when none exists.

    A matched row whose values are null is returned as is (the struct itself
    is non-null), matching a positional lookup of that row.
    """
    keys = list(keys)
    vstruct = F.struct(*[F.col(v) for v in values])
    h = history.select(*keys, F.col(hist_ts).alias("_t"), vstruct.alias("_v"))
    h = h.withColumn("_b", _bucket(F.col("_t"), bucket_unit))
    # per-bucket carry: last history struct of all earlier buckets
    hb = h.groupBy(*keys, "_b").agg(F.max_by("_v", "_t").alias("_lv"))
    p = probes.select(*keys, F.col(probe_ts).alias("_t"), F.struct(*[F.col(c) for c in probe_cols]).alias("_p"))
    p = p.withColumn("_b", _bucket(F.col("_t"), bucket_unit))
    pb = p.select(*keys, "_b").distinct().withColumn("_lv", F.lit(None).cast(hb.schema["_lv"].dataType))
    allb = hb.unionByName(pb).groupBy(*keys, "_b").agg(F.first("_lv", ignorenulls=True).alias("_lv"))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = allb.select(*keys, "_b", F.last("_lv", ignorenulls=True).over(wb).alias("_cv"))
    # in-bucket match: history copied to every salt, probes hashed to one
    hs = h.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))) \
          .select(*keys, "_b", "_s", "_t", F.lit(0).alias("_side"), "_v",
                  F.lit(None).cast(p.schema["_p"].dataType).alias("_p"))
    ps = p.withColumn("_s", F.pmod(F.xxhash64("_p"), F.lit(salts)).cast("int")) \
          .select(*keys, "_b", "_s", "_t", F.lit(1).alias("_side"),
                  F.lit(None).cast(h.schema["_v"].dataType).alias("_v"), "_p")
    u = hs.unionByName(ps)
    w = Window.partitionBy(*keys, "_b", "_s").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_m", F.last("_v", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    u = u.join(carry, on=keys + ["_b"], how="left")
    return u.select("_p.*", F.coalesce("_m", "_cv").alias(out))


def asof_values(requests: DataFrame, history: DataFrame, keys, req_ts: str, hist_ts: str, lookups: dict,
                id_col: str, **kw) -> DataFrame:
    """J1 for several offsets: ``lookups = {out_col: (value_col, hours, default)}``.

    Every (request, offset) becomes one probe row; one as-of pass serves
    all offsets; a final pivot-style aggregation puts them back in columns.
    """
    keys = list(keys)
    offs = sorted({h for _, h, _ in lookups.values()})
    vals = sorted({v for v, _, _ in lookups.values()})
    pr = requests.select(id_col, *keys, F.col(req_ts).alias("_rt"),
                         F.explode(F.array(*[F.lit(o) for o in offs])).alias("_k"))
    pr = pr.withColumn("_pt", F.col("_rt") - F.make_dt_interval(hours=F.col("_k")))
    m = asof_backward(pr, history, keys, "_pt", hist_ts, vals, [id_col, "_k"], **kw)
    aggs = []
    for out, (v, hrs, default) in lookups.items():
        hit = F.col("_k") == hrs
        val = F.max(F.when(hit, F.col(f"_match.{v}")))
        matched = F.max(F.when(hit, F.col("_match").isNotNull()))
        aggs.append(F.when(matched, val).otherwise(F.lit(float(default))).alias(out))
    return m.groupBy(id_col).agg(*aggs)


def interval_mean(requests: DataFrame, history: DataFrame, keys, req_ts: str, hist_ts: str, values,
                  id_col: str, start_hours: int = 24, end_hours: int = 1) -> DataFrame:
    """Mean of history in ``[ts - start_hours, ts - end_hours]`` (both
    inclusive, nulls skipped) plus the number of rows in the range."""
    keys = list(keys)
    lo = F.col(req_ts) - F.make_dt_interval(hours=F.lit(start_hours))
    hi = F.col(req_ts) - F.make_dt_interval(hours=F.lit(end_hours))
    r = requests.select(id_col, *keys, lo.alias("_lo"), hi.alias("_hi"))
    # every day the window touches (two for a 24 h window)
    r = r.withColumn("_b", F.explode(F.sequence(_bucket(F.col("_lo"), "day"), _bucket(F.col("_hi"), "day"),
                                                F.expr("INTERVAL 1 DAY"))))
    h = history.select(*keys, F.col(hist_ts).alias("_t"), *values).withColumn("_b", _bucket(F.col("_t"), "day"))
    j = r.join(h, on=keys + ["_b"], how="inner").where(F.col("_t").between(F.col("_lo"), F.col("_hi")))
    return j.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_hist"), *[F.avg(v).alias(f"avg_{v}") for v in values])


def by_slot(requests: DataFrame, keys, req_ts: str, *lookups) -> DataFrame:
    """``requests`` with the columns of every lookup, for a history whose rows
    all lie on whole hours.

    A lookup takes ``(slots, id_col)`` and returns ``id_col`` and its values;
    ``slots`` has ``keys`` and ``req_ts``, one row per series and either an hour
    or the half hour that stands for all times within it.  A request with a null
    key or time keeps its row, with whatever the lookup says of such a slot.
    """
    keys = list(keys)
    hour = _bucket(F.col(req_ts), "hour")
    slot = F.when(F.col(req_ts) == hour, hour).otherwise(hour + F.make_dt_interval(mins=F.lit(30)))
    tagged = requests.withColumn("_slot", F.struct(*keys, slot.alias(req_ts)))
    slots = cut_lineage(tagged.select("_slot").distinct().select("_slot", "_slot.*"))     # read by every lookup
    for n, lookup in enumerate(lookups):
        id_col = f"_slot{n}"
        found = lookup(slots.withColumnRenamed("_slot", id_col), id_col)
        tagged = tagged.join(found, F.col("_slot").eqNullSafe(F.col(id_col)), "left").drop(id_col)
    return tagged.drop("_slot")


def recommendation_table(spark) -> DataFrame:
    """The 9-row (demand_class, price_class) -> text table."""
    rows = [(d, p, t) for (d, p), t in C.REC_TABLE.items()]
    return spark.createDataFrame(rows, "demand_class string, price_class string, recommendation string")


def recommend_text(df: DataFrame, demand_col: str, price_col: str) -> DataFrame:
    """Lookup with default text; the table has 9 rows (broadcast)."""
    rec = recommendation_table(df.sparkSession).withColumnRenamed("demand_class", "_d").withColumnRenamed("price_class", "_p")
    j = df.join(F.broadcast(rec), (F.col(demand_col) == F.col("_d")) & (F.col(price_col) == F.col("_p")), "left")
    return j.withColumn("recommendation", F.coalesce(F.col("recommendation"), F.lit(C.REC_DEFAULT))).drop("_d", "_p")


def scenario_expand(df: DataFrame, ts: str, steps: int = 12, out: str = "step_ts") -> DataFrame:
    """Each request x the next ``steps`` hourly steps (starting at ts)."""
    seq = F.sequence(F.col(ts), F.col(ts) + F.make_dt_interval(hours=F.lit(steps - 1)), F.expr("INTERVAL 1 HOUR"))
    return df.select("*", F.posexplode(seq).alias("step", out))
