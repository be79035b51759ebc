"""Layered duplicate analysis: exact hash, perceptual hash, vectors, metadata, final vector groups."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.geo import spatial_proximity, temporal_proximity
from ..functions.similarity import vector_stage_overall
from ..operators.activity import layer_metrics
from ..operators.neighbors import candidate_rows
from ..operators.pairs import hash_groups, text_groups, union_all, vector_groups
from ..session import materialize, observed


@dataclass(frozen=True)
class Layers:
    exact: bool = True
    perceptual: bool = True
    vectors: bool = True
    metadata: bool = True
    metadata_prunes: bool = False
    hash_threshold: float = 0.85
    candidate_threshold: float = 0.999
    similarity_threshold: float = 0.98
    fallback_threshold: float = 0.7
    fallback_rows: int | None = None


@dataclass
class Analysis:
    members: DataFrame      # layer, group_id, member_id, is_leader, score
    headers: DataFrame      # layer, group_id, type, size, six scores, confidence
    matrix: DataFrame       # id_a, id_b and scores of the final layer's leader-member pairs
    metrics: DataFrame      # layer, n_in, n_out, filtered_pct


HEADER = ["layer", "group_id", "type", "size", "overall", "visual", "content", "temporal", "spatial", "semantic", "confidence"]


def exact_groups(df: DataFrame, hash_col: str = "content_hash", id_col: str = "id") -> DataFrame:
    """Rows that share a content hash, in long form. Missing hashes never match.

    Headers come from a partial aggregate that is written first: only then is the join back to the rows
    of a hot hash split at run time.
    """
    known = df.filter(F.length(hash_col) > 0)
    heads = known.groupBy(hash_col).agg(F.min(id_col).alias("group_id"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    heads = materialize(heads, "heads")
    return known.select(hash_col, F.col(id_col).alias("member_id")).join(heads, hash_col).select(
        "group_id", "member_id", (F.col("group_id") == F.col("member_id")).alias("is_leader"), F.lit(1.0).alias("score"))


def _rest(df: DataFrame, groups: DataFrame) -> DataFrame:
    return df.join(groups.select(F.col("member_id").alias("id")), "id", "left_anti")


def _headers(layer: str, type_: str, groups: DataFrame, overall, visual, content, semantic, confidence,
             temporal=0.0, spatial=0.0) -> DataFrame:
    mean = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"),
                                          F.avg(F.when(~F.col("is_leader"), F.col("score"))).alias("m"))
    value = lambda x: F.col("m") if x == "mean" else F.lit(float(x))
    return mean.select(F.lit(layer).alias("layer"), "group_id", F.lit(type_).alias("type"), "size",
                       value(overall).alias("overall"), value(visual).alias("visual"), value(content).alias("content"),
                       F.lit(temporal).alias("temporal"), F.lit(spatial).alias("spatial"),
                       value(semantic).alias("semantic"), value(confidence).alias("confidence"))


def _pair_matrix(groups: DataFrame, df: DataFrame) -> DataFrame:
    side = lambda p: df.select(F.col("id").alias(f"{p}id"), *[F.col(c).alias(f"{p}{c}") for c in
                                                             ("captured_at", "latitude", "longitude", "project_id")])
    pairs = groups.filter(~F.col("is_leader")).select(F.col("group_id").alias("a_id"), F.col("member_id").alias("b_id"), "score")
    t = temporal_proximity(F.col("a_captured_at"), F.col("b_captured_at"))
    s = spatial_proximity(F.col("a_latitude"), F.col("a_longitude"), F.col("b_latitude"), F.col("b_longitude"))
    return pairs.join(side("a_"), "a_id").join(side("b_"), "b_id").select(
        F.col("a_id").alias("id_a"), F.col("b_id").alias("id_b"), F.col("score").alias("visual"),
        F.when(F.col("a_project_id") == F.col("b_project_id"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("content"),
        t.alias("temporal"), s.alias("spatial"), F.col("score").alias("semantic"),
        vector_stage_overall(F.col("score"), t, s).alias("overall"))


def _vector_headers(groups: DataFrame, matrix: DataFrame) -> DataFrame:
    """Means over the leader-member scores; time and place of the leader and its first member."""
    first = matrix.groupBy(F.col("id_a").alias("group_id")).agg(
        F.min_by(F.struct("temporal", "spatial"), "id_b").alias("f"))
    base = _headers("vector", "retry_shots", groups, "mean", "mean", 1, "mean", "mean").drop("temporal", "spatial")
    return base.join(first, "group_id").select(
        *[F.col(f"f.{c}").alias(c) if c in ("temporal", "spatial") else F.col(c) for c in HEADER])


def analyse(df: DataFrame, layers: Layers = Layers(), dim: int | None = None) -> Analysis:
    """Run the layers over ``df(id, content_hash, hash, features, project_id, creator_id, captured_at,
    latitude, longitude, description)``. Rows are taken in id order.

    Each layer removes its groups from the next. Without vectors the final layer has no scores and so
    no groups; a ``vectors off`` row in the metrics says so. Without any candidate the descriptions of
    all rows are grouped instead, or of the first ``fallback_rows`` if that is asked for.
    """
    spark = df.sparkSession
    if len(df.select("id").take(2)) < 2:
        raise ValueError("Need at least 2 photos for similarity analysis")
    rows, groups_of = F.count(F.lit(1)).alias("n"), F.count_if("is_leader").alias("n")
    own = ["id", "content_hash", "hash", "features", "project_id", "creator_id", "captured_at", "latitude", "longitude"]
    found, heads, counts = [], [], []
    # every layer reads these rows; descriptions are read by the fallback alone
    rest, seen = observed(df.select(*own), "rows", rows)
    all_rows, n_rest = rest, seen["n"]

    if layers.exact:
        exact, seen = observed(exact_groups(rest), "exact", groups_of)
        counts.append(("exact", n_rest, seen["n"]))
        found.append(exact.withColumn("layer", F.lit("exact")))
        heads.append(_headers("exact", "exact_duplicates", exact, 1, 1, 1, 1, 1))
        rest, seen = observed(_rest(rest, exact), "rest", rows)
        n_rest = seen["n"]
    if layers.perceptual and n_rest > 1:
        near, seen = observed(hash_groups(rest, threshold=layers.hash_threshold), "near", groups_of)
        counts.append(("perceptual", n_rest, seen["n"]))
        found.append(near.withColumn("layer", F.lit("perceptual")))
        heads.append(_headers("perceptual", "retry_shots", near, "mean", "mean", "mean", 0.8, "mean"))
        rest, seen = observed(_rest(rest, near), "rest", rows)
        n_rest = seen["n"]
    candidates, n = rest, n_rest
    if layers.vectors:
        close = vector_groups(rest, threshold=layers.candidate_threshold, dim=dim)
        candidates, seen = observed(rest.join(close.select(F.col("member_id").alias("id")), "id", "left_semi"), "candidates", rows)
        counts.append(("vector candidates", n_rest, n := seen["n"]))
    final = candidates
    if layers.metadata:
        likely, seen = observed(candidate_rows(candidates, "permissive"), "likely", rows)
        counts.append(("metadata", n, seen["n"]))
        # by default a row stays if either layer wants it, so the layer only reports
        if layers.metadata_prunes:
            final, n = likely, seen["n"]
    if not n:
        sample = df.select("id", "description")
        if layers.fallback_rows is not None:
            sample = sample.orderBy("id").limit(layers.fallback_rows)
        sample, given = observed(sample, "descriptions", rows)
        text, seen = observed(text_groups(sample, threshold=layers.fallback_threshold), "text", groups_of)
        counts.append(("text fallback", given["n"], seen["n"]))
        found.append(text.withColumn("layer", F.lit("text")))
        heads.append(_headers("text", "redundant_documentation", text, 0.7, 0.7, 1, 0.7, 0.7, 0.1, 0.1))
        matrix = _pair_matrix(text.limit(0), all_rows)
    else:
        if layers.vectors:
            groups, seen = observed(vector_groups(final, threshold=layers.similarity_threshold, dim=dim), "vector", groups_of)
            counts.append(("vector", n, seen["n"]))
        else:
            counts.append(("vectors off", n, 0))
            groups = materialize(text_groups(df.limit(0)), "vector")
        matrix = materialize(_pair_matrix(groups, all_rows), "matrix")
        found.append(groups.withColumn("layer", F.lit("vector")))
        heads.append(_vector_headers(groups, matrix))
    cols = ["layer", "group_id", "member_id", "is_leader", "score"]
    metrics = spark.createDataFrame(counts or [("none", 0, 0)], "layer string, n_in bigint, n_out bigint")
    return Analysis(union_all([f.select(*cols) for f in found]), union_all([h.select(*HEADER) for h in heads]),
                    matrix, layer_metrics(metrics))
