"""Recommendation plans (M27-M29): profile vectors, exact cosine top-k,
neighbour vote and advice lookup - all DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as col
from ..operators import lookup as lk
from ..operators import similarity as sim

PROFILE_COLS = ("pred_demand", "pred_price", "demand_class_enc", "price_class_enc", "cluster",
                "hour_sin", "hour_cos", "month_sin", "month_cos", "renewable_pct", "is_weekend")


def profile_vector(df: DataFrame, out: str = "vec") -> DataFrame:
    """The 11-value profile as ``array<double>`` (normalised where scored)."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in PROFILE_COLS]))


def vote(neighbors: DataFrame, profiles: DataFrame, qid: str, pid: str, k: int) -> DataFrame:
    """Mode of neighbour classes (smallest code on ties), agreement share and
    advice text; ``neighbors`` is (qid, rank, neighbor_pid, score)."""
    p = profiles.select(F.col(pid).alias(f"neighbor_{pid}"), "demand_class_enc", "price_class_enc",
                        F.col("ts").alias("_nts"))
    j = neighbors.join(p, on=f"neighbor_{pid}", how="inner")
    modes = j.groupBy(qid).agg(F.mode("demand_class_enc", True).alias("_dm"), F.mode("price_class_enc", True).alias("_pm"))  # k rows a query
    j = j.join(modes, on=qid, how="inner")
    agree = (F.col("demand_class_enc") == F.col("_dm")) & (F.col("price_class_enc") == F.col("_pm"))
    out = j.groupBy(qid, "_dm", "_pm").agg(
        (F.count_if(agree) / F.lit(float(k))).alias("confidence"),
        F.array_sort(F.collect_list(F.struct("rank", F.date_format("_nts", "yyyy-MM-dd HH:mm:ss").alias("t")))).alias("_nb"),
        F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("_sc"))
    out = out.select(qid, col.class_label("_dm").alias("demand_class"), col.class_label("_pm").alias("price_class"),
                     F.bround("confidence", 2).alias("confidence"),
                     F.array_join(F.transform("_nb", lambda s: s["t"]), ", ").alias("similar_hours"),
                     F.transform("_sc", lambda s: F.bround(s["score"], 4)).alias("top_similarities"))
    return lk.recommend_text(out, "demand_class", "price_class")


def recommend_by_index(profiles: DataFrame, pid: str = "profile_id", k: int = 5, index: int | None = None) -> DataFrame:
    """The k most similar other profiles of the stored profile ``index``
    (of every stored profile, if none is given); an index that isn't stored
    raises ``IndexError``.  The vote's classes choose the advice and come as
    ``voted_...``; the row's own classes are its profile's."""
    asked = profiles if index is None else profiles.where(F.col(pid) == index)
    if index is not None and asked.isEmpty():
        raise IndexError(f"no stored profile {index}")
    nb = sim.topk_similar(profile_vector(asked), profile_vector(profiles), pid, pid, "vec", "vec", k=k, exclude_self=True)
    voted = vote(nb, profiles, pid, pid, k).withColumnsRenamed(
        {"demand_class": "voted_demand_class", "price_class": "voted_price_class"})
    own = asked.select(pid, "ts", "pred_demand", "pred_price", "cluster",
                       col.class_label("demand_class_enc").alias("demand_class"),
                       col.class_label("price_class_enc").alias("price_class"))
    return voted.join(own, pid)


def recommend_from_queries(queries: DataFrame, profiles: DataFrame, qid: str, pid: str = "profile_id",
                           k: int = 5) -> DataFrame:
    """New rows (already predicted / classified) against stored profiles."""
    q = profile_vector(queries)
    p = profile_vector(profiles)
    nb = sim.topk_similar(q, p, qid, pid, "vec", "vec", k=k)
    return vote(nb, profiles, qid, pid, k)
