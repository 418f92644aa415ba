"""Similarity queries on ``embeddings``."""

from pyspark.sql import functions as F

from ..catalog import R, register
from ..operators import ml
from ..operators import similarity as sim
from ..sources import tables as src

CENTROID_SQL = """
c0 AS (SELECT label, pos, avg(v) AS v FROM (
         SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
       GROUP BY label, pos),
c AS (SELECT label, list(v ORDER BY pos) AS v FROM c0 GROUP BY label)
"""


def _emb(spark, sf_dir):
    return src.read_table(spark, sf_dir, "embeddings")


def label_centroids(emb):
    """Mean embedding per label (element-wise), built with posexplode + avg."""
    e = emb.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v"))
    a = e.groupBy("label", "pos").agg(F.avg("v").alias("v"))
    return a.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_s")) \
            .select("label", F.transform("_s", lambda s: s["v"]).alias("v"))


@register("j5_similarity_topk", f"""
WITH {CENTROID_SQL},
s AS (SELECT c.label, e.vec_id, list_cosine_similarity(c.v, CAST(e.embedding AS DOUBLE[])) AS score
      FROM c, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT CAST(label AS BIGINT) AS label, rank, vec_id AS neighbor_vec_id, {R('score')} AS score FROM r WHERE rank <= 5
""")
def q_similarity_topk(spark, sf_dir):
    """J5 + L3: top-5 embeddings by cosine similarity to each label centroid."""
    emb = _emb(spark, sf_dir)
    return sim.topk_similar(label_centroids(emb), emb, "label", "vec_id", "v", "embedding", k=5)


@register("j6_similar_by_index", f"""
WITH s AS (SELECT a.vec_id, b.vec_id AS nb,
                  list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
           FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, nb) AS rank FROM s)
SELECT vec_id, rank, nb AS neighbor_vec_id, {R('score')} AS score FROM r WHERE rank <= 5
""")
def q_similar_by_index(spark, sf_dir):
    """Top-5 most similar other embeddings for every stored one (self excluded)."""
    emb = _emb(spark, sf_dir)
    return sim.topk_similar(emb, emb, "vec_id", "vec_id", "embedding", "embedding", k=5, exclude_self=True)


@register("m10_knn_regression", f"""
WITH s AS (SELECT a.vec_id, b.label AS y,
                  list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d, b.vec_id AS nb
           FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, nb) AS rank FROM s)
SELECT vec_id, {R('avg(y)')} AS prediction FROM r WHERE rank <= 5 GROUP BY vec_id
""")
def q_knn_regression(spark, sf_dir):
    """k=5 uniform kNN regression of the label on Euclidean distance (leave-self-out)."""
    emb = _emb(spark, sf_dir)
    return sim.knn_regress(emb, emb, "vec_id", "vec_id", "embedding", "label", k=5, exclude_self=True)


@register("m24_nearest_centre", f"""
WITH {CENTROID_SQL},
d AS (SELECT e.vec_id, c.label AS cluster,
             list_distance(CAST(e.embedding AS DOUBLE[]), c.v) AS dist FROM embeddings e, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster) AS rn FROM d)
SELECT vec_id, CAST(cluster AS BIGINT) AS cluster FROM r WHERE rn = 1
""")
def q_nearest_centre(spark, sf_dir):
    """Assignment of each embedding to its nearest centre (label centroids)."""
    emb = _emb(spark, sf_dir)
    cents = label_centroids(emb)
    rows = sorted(cents.collect(), key=lambda r: r["label"])   # k centres: the model's size
    if not rows:                                               # no centre, hence no row to assign
        return emb.select("vec_id", F.lit(None).cast("bigint").alias("cluster")).limit(0)
    dim = len(rows[0]["v"])
    e = emb.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(dim)])
    out = ml.assign_nearest(e, [r["v"] for r in rows], [f"f{i}" for i in range(dim)])
    labels = F.array(*[F.lit(int(r["label"])) for r in rows])
    return out.select("vec_id", labels[F.col("cluster")].alias("cluster"))


@register("m10_knn_weighted", f"""
WITH s AS (SELECT a.vec_id, b.label AS y,
                  list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d, b.vec_id AS nb
           FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, nb) AS rank FROM s)
SELECT vec_id, {R('CASE WHEN max(CAST(d = 0 AS INTEGER)) = 1 THEN avg(y) FILTER (WHERE d = 0) '
                  'ELSE sum(y / d) FILTER (WHERE d > 0) / sum(1.0 / d) FILTER (WHERE d > 0) END', 4)} AS prediction
FROM r WHERE rank <= 20 GROUP BY vec_id
""", digits=4)
def q_knn_weighted(spark, sf_dir):
    """k=20 inverse-distance weighted kNN regression (a zero distance takes all weight)."""
    emb = _emb(spark, sf_dir)
    return sim.knn_regress(emb, emb, "vec_id", "vec_id", "embedding", "label", k=20, weighted=True, exclude_self=True)


@register("m21_euclidean_silhouette", f"""
WITH d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS total
           FROM embeddings a, embeddings b GROUP BY 1, 2, 3),
n AS (SELECT label AS other, count(*) AS size FROM embeddings GROUP BY 1),
ab AS (SELECT vec_id, label, max(size) FILTER (WHERE label = other) AS own,
              max(total / nullif(size - 1, 0)) FILTER (WHERE label = other) AS a,
              min(total / size) FILTER (WHERE label <> other) AS b FROM d JOIN n USING (other) GROUP BY 1, 2)
SELECT vec_id, CAST(label AS BIGINT) AS label, {R('CASE WHEN own = 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END')} AS silhouette FROM ab
""")
def q_euclidean_silhouette(spark, sf_dir):
    """Exact Euclidean silhouette of every embedding, its label as the cluster."""
    return sim.silhouette_rows(_emb(spark, sf_dir), "vec_id", "embedding", "label")
