"""The row tier: assigning, coding and table lookups as plain joins and aggregations, against which the block kernels are held."""

from pyspark.sql import functions as F

from lodeseek.functions import vectors as V
from lodeseek.operators import quantize as Z
from lodeseek.operators import scoring


def assign_nearest(tokens, centroids):
    pairs = tokens.select("token_id", "vec").crossJoin(F.broadcast(centroids.select("cluster_id", "cvec")))
    d = F.round(V.sq_l2(F.col("vec"), F.col("cvec")), V.TIE_DIGITS)
    return pairs.groupBy("token_id").agg(F.min(F.struct(d.alias("d"), "cluster_id")).alias("b")).select("token_id", "b.cluster_id")


def pq_encode(tokens, codebooks, m, dim):
    pairs = Z.parts(tokens, m, dim).join(F.broadcast(codebooks.select("m", "k", "cvec")), "m")
    d = F.round(V.sq_l2(F.col("part"), F.col("cvec")), V.TIE_DIGITS)
    best = pairs.groupBy("token_id", "m").agg(F.min(F.struct(d.alias("d"), "k")).alias("b"))
    return best.select("token_id", "m", F.col("b.k").alias("k"), F.col("b.d").alias("d"))


def lookup_scores(codes, queries, codebooks, m, dim):
    """codes (token_id, doc_id, m, k) -> (query_id, q_tok, doc_id, token_id, s)."""
    size = V.check_parts(dim, m)
    rows = queries.select("query_id", "q_tok", "qvec", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("m")).withColumn("part", V.subvector(F.col("qvec"), F.col("m"), size))
    table = rows.join(codebooks.select("m", "k", "cvec"), "m").select("query_id", "q_tok", "m", "k", V.dot(F.col("part"), F.col("cvec")).alias("s"))
    return codes.join(table, ["m", "k"]).groupBy("query_id", "q_tok", "doc_id", "token_id").agg(F.sum("s").alias("s"))


def similarities(tokens, queries):
    rows = tokens.select("doc_id", "token_id", "vec").crossJoin(F.broadcast(queries))
    return rows.select("query_id", "q_tok", "doc_id", "token_id", V.dot(F.col("qvec"), F.col("vec")).alias("s"))


def probed(queries, centroids, nprobe):
    from pyspark.sql import Window

    rows = queries.crossJoin(centroids).withColumn("c", F.round(V.dot(F.col("qvec"), F.col("cvec")), V.TIE_DIGITS))
    order = Window.partitionBy("query_id", "q_tok").orderBy(F.desc("c"), "cluster_id")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= nprobe).select("query_id", "cluster_id").distinct()


def maxsim(scores):
    return scoring.maxsim(scores)
