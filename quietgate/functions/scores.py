"""Column expressions over three-way decision scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The labels, in the order that settles ties.
LABELS = ["match", "no_match", "insufficient"]
P = {label: f"p_{label}" for label in LABELS}

# A gate above 1 can never be met: the automatic action is off.
DISABLED = 1.0001


def best_label() -> Column:
    """Label of the highest score; the earlier label wins a tie."""
    m, n, i = (F.col(P[label]) for label in LABELS)
    return (
        F.when((m >= n) & (m >= i), "match").when(n >= i, "no_match").otherwise("insufficient")
    )


def best_score() -> Column:
    return F.greatest(*[F.col(P[label]) for label in LABELS])


def score_of(label: Column) -> Column:
    out = F.lit(None).cast("double")
    for name in LABELS:
        out = F.when(label == name, F.col(P[name])).otherwise(out)
    return out


def routed(allow: Column, block: Column) -> Column:
    """Automatic action: the best label must reach its gate, otherwise a person reviews."""
    return (
        F.when((best_label() == "match") & (F.col("p_match") >= block), "block")
        .when((best_label() == "no_match") & (F.col("p_no_match") >= allow), "allow")
        .otherwise("review")
    )


def gate(gates: DataFrame | dict, name: str) -> Column:
    """A gate as a scalar: a one-row frame is read as a scalar subquery, never joined."""
    if isinstance(gates, dict):
        return F.lit(float(gates[name]))
    return gates.select(name).scalar()


def softmax(logits: list[Column], temperature: float = 1.0) -> list[Column]:
    top = F.greatest(*logits)
    powers = [F.exp((x - top) / temperature) for x in logits]
    total = powers[0]
    for p in powers[1:]:
        total = total + p
    return [p / total for p in powers]
