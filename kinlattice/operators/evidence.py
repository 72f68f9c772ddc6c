"""Evidence rules and the aggregation of their weights, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the aggregation.
PENALTY, PENALTY_CAP, FLOOR = 0.1, 0.5, 0.05
#: Fixed values of the DNA rule: cM bands and weights by hypothesis; weights are divided by the multiplier.
DNA_NOISE = 7.0
MULTIPLIERS = {"general": 1.0, "ashkenazi": 1.6, "sephardi": 1.4, "amish": 2.0, "lds_pioneer": 1.5}


def noisy_or(evidence: DataFrame, key: str, rule: str, direction: str, weight: str) -> DataFrame:
    """(key, score, n_rules, penalty): 1 - prod(1 - mean weight of each supporting rule), less the penalty.

    Every contradicting row costs PENALTY up to PENALTY_CAP. Keys with any evidence score at least FLOOR.
    Two aggregates with map-side partials; no window, no collect.
    """
    support, against = F.col(direction) == "supports", F.col(direction) == "contradicts"
    by_rule = evidence.groupBy(key, rule).agg(
        F.avg(F.when(support, F.col(weight))).alias("_w"), F.count_if(against).alias("_no")
    )
    out = by_rule.groupBy(key).agg(
        F.coalesce(F.product(1 - F.col("_w")), F.lit(1.0)).alias("_p"), F.count("_w").alias("n_rules"), F.sum("_no").alias("_no")
    )
    penalty = F.least(F.lit(PENALTY) * F.col("_no"), F.lit(PENALTY_CAP))
    score = F.greatest(F.least(1 - F.col("_p") - penalty, F.lit(1.0)), F.lit(FLOOR))
    return out.select(key, score.alias("score"), "n_rules", penalty.alias("penalty"))


def with_unsupported(keys: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """All keys; those without any evidence score 0."""
    return keys.select(key).distinct().join(scores, key, "left").na.fill({"score": 0.0, "n_rules": 0, "penalty": 0.0})


def score_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row: mean and largest absolute change, and how many keys."""
    both = old.select(key, F.col("score").alias("_a")).join(new.select(key, F.col("score").alias("_b")), key)
    delta = F.abs(F.col("_a") - F.col("_b"))
    return both.agg(F.round(F.avg(delta), 6).alias("mean_delta"), F.round(F.max(delta), 6).alias("max_delta"), F.count(F.lit(1)).alias("n"))


def report_score(pieces: DataFrame, key: str, direction: str, weight: str, certainty: str) -> DataFrame:
    """Weight times certainty, supporting less contradicting, not below 0, with the method that it came by."""
    part = lambda d: F.coalesce(F.sum(F.when(F.col(direction) == d, F.col(weight) * F.col(certainty))), F.lit(0.0))
    score = F.greatest(part("supports") - part("contradicts"), F.lit(0.0))
    method = F.when(F.bool_or(F.col(direction) == "contradicts"), "conflicting").when(F.count(F.lit(1)) > 1, "combined").otherwise("single")
    return pieces.groupBy(key).agg(score.alias("score"), method.alias("method"))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Mean over the components that are not null, their weights renormalised; 0 without any."""
    total = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    value = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return F.when(total > 0, value / total).otherwise(0.0)


def _found(rule: str, direction: Column | str, weight: Column, when: Column) -> Column:
    direction = F.lit(direction) if isinstance(direction, str) else direction
    return F.when(when, F.struct(F.lit(rule).alias("rule"), direction.alias("direction"), weight.cast("double").alias("weight")))


def surname_rule(codes_a: Column, codes_b: Column) -> Column:
    return _found("surname", "supports", F.lit(0.5), F.coalesce(F.arrays_overlap(codes_a, codes_b), F.lit(False)))


def birth_year_rule(a: Column, b: Column, kind: Column) -> Column:
    gap = F.abs(a - b)
    far = (gap >= 10) & (kind == "same_person")
    weight = F.when(gap == 0, 0.4).when(gap <= 2, 0.25).when(far, 0.3)
    return _found("birth_year", F.when(gap <= 2, "supports").otherwise("contradicts"), weight, weight.isNotNull())


def place_rule(score: Column) -> Column:
    weight = F.when(score >= 0.8, 0.4 * score).when(score < 0.3, 0.3)
    return _found("place", F.when(score >= 0.8, "supports").otherwise("contradicts"), weight, weight.isNotNull())


def sex_rule(a: Column, b: Column, kind: Column) -> Column:
    differ = a.isin("M", "F") & b.isin("M", "F") & (a != b) & (kind == "same_person")
    return _found("sex", "contradicts", F.lit(0.95), F.coalesce(differ, F.lit(False)))


def population_multiplier(a: Column, b: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MULTIPLIERS.items() for x in kv])
    return F.greatest(*(F.coalesce(F.element_at(table, p), F.lit(1.0)) for p in (a, b)))


def dna_rule(cm: Column, kind: Column, multiplier: Column) -> Column:
    """Total shared cM against the bands of the hypothesis; below the noise floor the rule is silent."""
    support = (
        F.when((kind == "same_person") & (cm >= 3400), 0.85)
        .when((kind == "parent_child") & cm.between(2376, 3720), 0.8)
        .when((kind == "siblings") & cm.between(1613, 3488), 0.65)
    )
    against = (
        F.when((kind == "same_person") & (cm < 1500), 0.85)
        .when((kind == "parent_child") & ((cm > 3800) | (cm < 1500)), 0.7)
        .when((kind == "siblings") & (cm < 1000), 0.6)
    )
    direction = F.when(support.isNotNull(), "supports").otherwise("contradicts")
    weight = F.coalesce(support, against) / multiplier
    return _found("dna", direction, weight, (cm >= DNA_NOISE) & weight.isNotNull())


def compose(pairs: DataFrame, key: list[str], rules: list[Column]) -> DataFrame:
    """One row for each finding of each rule (a rule is a struct column, null when silent)."""
    return pairs.select(*key, F.explode(F.array_compact(F.array(*rules))).alias("_e")).select(*key, "_e.*")
