"""Judged answers: is each claim's evidence in a cited source, and does the answer hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions.text import squash

# fixed values: verdicts of a claim, and the shortest piece of evidence that counts, in squashed characters
VERDICTS = ("supported", "not_supported", "contradicted")
SHORTEST_PIECE = 20


def evidence_pieces(evidence: Column) -> Column:
    """Pieces between omissions, squashed, without those too short to say anything; ``evidence`` is in compatibility form (``functions.text.compatible``)."""
    pieces = F.transform(F.split(F.coalesce(evidence, F.lit("")), r"\.\.\.|…"), squash)
    return F.filter(pieces, lambda p: F.length(p) >= SHORTEST_PIECE)


def evidence_found(evidence: Column, sources: Column) -> Column:
    """Whether all pieces stand in one of the squashed ``sources``; evidence without pieces is not found."""
    pieces = evidence_pieces(evidence)
    held = F.exists(sources, lambda s: F.forall(pieces, lambda p: F.contains(s, p)))
    return (F.size(pieces) > 0) & F.coalesce(held, F.lit(False))


def checked_verdict(verdict: Column, found: Column) -> Column:
    """Support without evidence in the sources does not count."""
    return F.when((verdict == "supported") & ~found, "not_supported").otherwise(verdict)


def score_answers(claims: DataFrame, key: str = "id") -> DataFrame:
    """``key, n_claims, support, grounded, contradicted`` from claims ``key, verdict``; claims of other verdicts are passed over.

    Keys without a valid claim come out with support 0 and not grounded.
    """
    valid = F.col("verdict").isin(*VERDICTS)
    n = F.count_if(valid)
    supported = F.count_if(F.col("verdict") == "supported")
    return claims.groupBy(key).agg(
        n.alias("n_claims"),
        F.round(F.when(n > 0, supported / n).otherwise(0.0), 3).alias("support"),
        ((n > 0) & (supported == n)).alias("grounded"),
        (F.count_if(F.col("verdict") == "contradicted") > 0).alias("contradicted"),
    )


def evaluation_report(scored: DataFrame, claims: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """One row: answers, in per cent how many are grounded, contradicted and need both authors, mean support, and the final set's size.

    With ``claims`` (``verdict, judged, found``) also the claims by verdict and those the judge called supported without
    evidence; with ``failed`` how many answers could not be judged. Mean support is summed in thousandths.
    """
    n = F.count(F.lit(1))
    share = lambda c: F.floor(F.coalesce((2000 * F.count_if(c) + n) / F.nullif(2 * n, F.lit(0)), F.lit(0.0))) / 10
    support = F.sum(F.round(F.col("support") * 1000).cast("bigint"))
    final = F.col("grounded") & F.col("needs_both")
    row = scored.agg(n.alias("answers"), share(F.col("grounded")).alias("grounded_pct"), share(F.col("contradicted")).alias("contradicted_pct"), share(F.col("needs_both")).alias("needs_both_pct"), (F.floor(F.coalesce((2 * support + n) / F.nullif(2 * n, F.lit(0)), F.lit(0.0))) / 1000).alias("mean_support"), F.count_if(final).alias("final_questions"))
    if claims is not None:
        counts = claims.where(F.col("verdict").isin(*VERDICTS)).agg(F.count(F.lit(1)).alias("claims"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS], F.count_if((F.col("judged") == "supported") & ~F.col("found")).alias("yes_without_evidence"))
        row = beside(row, counts)
    return row if failed is None else beside(row, failed.agg(F.count(F.lit(1)).alias("judge_failed")))


def beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two tables of one row each as one row."""
    return one.withColumn("_k", F.lit(0)).join(other.withColumn("_k", F.lit(0)), "_k").drop("_k")


def verdicts_by_author(claims: DataFrame) -> DataFrame:
    """``author`` and one column a verdict."""
    return claims.groupBy("author").pivot("verdict", list(VERDICTS)).agg(F.count(F.lit(1))).fillna(0, list(VERDICTS))


def final_set(questions: DataFrame, scored: DataFrame, key: str = "id") -> DataFrame:
    """Questions whose answers are grounded and need both authors (``needs_both``)."""
    return questions.join(scored.where("grounded AND needs_both").select(key), key, "left_semi")


def worst(scored: DataFrame, most: int = 3, key: str = "id") -> DataFrame:
    return scored.orderBy("support", key).limit(most)
