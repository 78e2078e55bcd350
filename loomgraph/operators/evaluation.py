"""Scoring of generated edge types and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers of a refusal, and the blended price per million tokens
# (70 % input at 5, 30 % output at 15).
REFUSAL_MARKERS = ("지원", "찾을 수 없", "unsupported")
INPUT_PRICE, OUTPUT_PRICE, INPUT_SHARE = 5.0, 15.0, 0.7
BLENDED_PRICE = INPUT_PRICE * INPUT_SHARE + OUTPUT_PRICE * (1 - INPUT_SHARE)

EDGE_KEY = ["name", "source", "target"]


def evaluate_edges(
    generated_nodes: DataFrame, golden_nodes: DataFrame, generated: DataFrame, golden: DataFrame
) -> DataFrame:
    """Compare generated labels and edge types with golden ones, as one row.

    Nodes have ``name``; edges have ``name``, ``source``, ``target`` and, when
    generated, ``derivation``.  Both sides are tagged and folded per key, so
    missing, matched and surplus counts come from one aggregation each.
    """

    def presence(gen: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
        both = gen.select(*keys, F.lit(1).alias("_g"), F.lit(0).alias("_o")).unionByName(
            gold.select(*keys, F.lit(0).alias("_g"), F.lit(1).alias("_o"))
        )
        return both.groupBy(*keys).agg(F.max("_g").alias("g"), F.max("_o").alias("o"))

    nodes = presence(generated_nodes, golden_nodes, ["name"]).agg(
        F.sum("g").alias("node_count_generated"),
        F.sum("o").alias("node_count_golden"),
        F.count_if((F.col("o") == 1) & (F.col("g") == 0)).alias("missing_nodes"),
    )
    edges = presence(generated, golden, EDGE_KEY)
    rels = edges.agg(
        F.sum("o").alias("relationship_count_golden"),
        F.count_if((F.col("o") == 1) & (F.col("g") == 0)).alias("missing_rels"),
        F.count_if((F.col("o") == 1) & (F.col("g") == 1)).alias("matched_rels"),
    )
    # a golden name that was generated at all counts for direction
    by_name = edges.groupBy("name").agg(
        F.sum("o").alias("gold"), F.max("g").alias("known"), F.sum(F.col("o") * F.col("g")).alias("right")
    )
    direction = by_name.agg(
        F.sum(F.col("gold") * F.col("known")).alias("direction_total"), F.sum("right").alias("direction_right")
    )
    adoption = generated.agg(
        F.count(F.lit(1)).alias("relationship_count_generated"),
        F.count_if(F.col("derivation") == "llm_suggested").alias("suggested"),
    )
    one = F.lit(1).alias("_one")
    row = nodes.select("*", one)
    for part in (rels, direction, adoption):
        row = row.join(part.select("*", one), "_one")  # single rows

    def ratio(top: Column, bottom: Column, empty: float) -> Column:
        return F.when(bottom > 0, F.round(top / bottom, 4)).otherwise(F.lit(empty))

    total_golden = F.col("node_count_golden") + F.col("relationship_count_golden")
    return row.select(
        ratio(F.col("missing_nodes") + F.col("missing_rels"), total_golden, 0.0).alias("critical_error_rate"),
        ratio(F.col("matched_rels"), F.col("relationship_count_golden"), 1.0).alias("fk_relationship_coverage"),
        ratio(F.col("direction_right"), F.col("direction_total"), 1.0).alias("direction_accuracy"),
        F.when(F.col("suggested") > 0, F.round(F.col("suggested") / F.col("relationship_count_generated"), 4)).alias(
            "adoption_rate"
        ),
        "node_count_generated",
        "node_count_golden",
        "relationship_count_generated",
        "relationship_count_golden",
    )


def hit_fraction(words: Column, text: Column, when_empty: float) -> Column:
    n = F.size(F.coalesce(words, F.array().cast("array<string>")))
    hits = F.size(F.filter(words, lambda k: text.contains(F.lower(k))))
    return F.when(n == 0, F.lit(when_empty)).otherwise(hits / n)


def score_answers(answers: DataFrame, golden: DataFrame) -> DataFrame:
    """Score every answer against its golden row, by ``qa_id``.

    ``golden``: qa_id, category, expected_keywords, expected_entities.
    ``answers``: qa_id, mode, answer, error, latency_ms, tokens.
    """
    joined = answers.join(golden, "qa_id")
    text = F.lower(F.coalesce("answer", F.lit("")))
    refused = F.col("error").isNotNull()
    for marker in REFUSAL_MARKERS:
        refused = refused | text.contains(marker)
    unsupported = F.col("category") == "unsupported"
    keyword = hit_fraction(F.col("expected_keywords"), text, 0.0)
    entity = hit_fraction(F.col("expected_entities"), text, 1.0)
    wanted = F.size(F.coalesce("expected_keywords", F.array().cast("array<string>"))) > 0
    success = F.when(unsupported, refused).otherwise(
        (~wanted | (keyword > 0)) & (F.col("error").isNull() | (F.col("error") == ""))
    )
    flag = refused.cast("double")
    return joined.select(
        "qa_id",
        "mode",
        F.when(unsupported, flag).otherwise(keyword).alias("keyword_score"),
        F.when(unsupported, flag).otherwise(entity).alias("entity_score"),
        success.alias("success"),
        F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
    )


def compare_modes(scored: DataFrame) -> DataFrame:
    """Mode ``a`` against mode ``b``, as one row with a recommendation."""

    def of(mode: str, value: Column) -> Column:
        return F.when(F.col("mode") == mode, value)

    def mean(mode: str, value: Column, digits: int) -> Column:
        return F.coalesce(F.round(F.avg(of(mode, value)), digits), F.lit(0.0))

    success = F.col("success").cast("int")
    row = scored.agg(
        F.greatest(F.count_if(F.col("mode") == "a"), F.count_if(F.col("mode") == "b")).alias("total_pairs"),
        F.coalesce(F.sum(of("a", success)), F.lit(0)).alias("a_success_count"),
        F.coalesce(F.sum(of("b", success)), F.lit(0)).alias("b_success_count"),
        mean("a", F.col("latency_ms"), 1).alias("a_avg_latency_ms"),
        mean("b", F.col("latency_ms"), 1).alias("b_avg_latency_ms"),
        mean("a", F.col("keyword_score"), 3).alias("a_avg_keyword_score"),
        mean("b", F.col("keyword_score"), 3).alias("b_avg_keyword_score"),
        F.coalesce(F.sum(of("b", F.col("tokens"))), F.lit(0)).alias("b_total_tokens"),
    )
    a, b = F.col("a_success_count"), F.col("b_success_count")
    ka, kb = F.col("a_avg_keyword_score"), F.col("b_avg_keyword_score")
    return row.select(
        "*",
        F.round(F.col("b_total_tokens") * BLENDED_PRICE / 1_000_000, 4).alias("b_estimated_cost_usd"),
        F.when(a > b, "a_only").when(b > a, "b_preferred").when(kb > ka, "b_preferred").when(ka > kb, "a_only")
        .otherwise("hybrid").alias("recommendation"),
    )
