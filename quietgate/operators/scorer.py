"""Three-way document scorer: train on one split, choose on another, report on a third."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.scores import LABELS, P, best_label, softmax
from .evaluation import fine_gates

CONTENT = "_content"


def _label_index() -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("gold")) - 1).cast(
        "double"
    )


def _content(text: str, question: str | None) -> Column:
    parts = [F.coalesce(F.col(text), F.lit(""))]
    if question:
        parts.append(F.coalesce(F.col(question), F.lit("")))
    return F.concat_ws("\n", *parts)


def score_documents(
    df: DataFrame,
    model: PipelineModel,
    text: str = "text",
    question: str | None = None,
    temperature: float = 1.0,
) -> DataFrame:
    """Add ``p_match``, ``p_no_match``, ``p_insufficient`` and ``prediction``.

    Rows are scored where they are: shuffling texts to score equal ones once costs more than the
    model does. Any model with a ``rawPrediction`` over the three labels will do.
    """
    keyed = df.select(F.struct(*df.columns).alias("_row"), _content(text, question).alias(CONTENT))
    raw = model.transform(keyed).select("_row", vector_to_array("rawPrediction").alias("_raw"))
    logits = [F.get("_raw", F.lit(i)) for i in range(len(LABELS))]
    scored = raw.select("_row.*", *[p.alias(P[x]) for p, x in zip(softmax(logits, temperature), LABELS)])
    return scored.withColumn("prediction", best_label())


def fit_scorer(
    train: DataFrame,
    text: str = "text",
    question: str | None = None,
    reg: float = 0.01,
    features: int = 1 << 16,
    iterations: int = 20,
) -> PipelineModel:
    """Hashed TF-IDF into multinomial logistic regression; no vocabulary is collected."""
    rows = train.withColumn(CONTENT, _content(text, question)).withColumn("label", _label_index())
    stages = [
        RegexTokenizer(inputCol=CONTENT, outputCol="_words", pattern=r"(?U)\W+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="features"),
        LogisticRegression(family="multinomial", maxIter=iterations, regParam=reg),
    ]
    return Pipeline(stages=stages).fit(rows.select(CONTENT, "label"))


def train_scorer(
    corpus: DataFrame,
    text: str = "text",
    question: str | None = None,
    regs: Sequence[float] = (0.01, 0.1),
    features: int = 1 << 16,
    iterations: int = 20,
) -> dict[str, object]:
    """Fit on train, choose on dev (the earlier candidate on ties), set gates on calibration.

    Test rows are only scored, never used to choose. The loop is over candidates; one accuracy
    per candidate reaches the driver. Fitting reads the corpus many times, so it is stored once.
    """
    corpus = cut(corpus)
    part = lambda name: corpus.filter(F.col("split") == name)
    best, best_accuracy, best_reg = None, -1.0, None
    for reg in regs:
        model = fit_scorer(part("train"), text, question, reg, features, iterations)
        dev = score_documents(part("dev"), model, text, question)
        accuracy = dev.agg(
            F.avg((F.col("gold") == F.col("prediction")).cast("double")).alias("a")
        ).first()["a"]
        if accuracy is not None and accuracy > best_accuracy:
            best, best_accuracy, best_reg = model, accuracy, reg
    if best is None:
        raise ValueError("the dev split is empty")
    calibration = score_documents(part("calibration"), best, text, question)
    return {
        "model": best,
        "reg": best_reg,
        "dev_accuracy": best_accuracy,
        "gates": fine_gates(calibration),
        "test": score_documents(part("test"), best, text, question),
    }
