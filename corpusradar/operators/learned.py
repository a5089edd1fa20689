"""A learned score: TF-IDF features and logistic regression, followed by the calibration rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusradar import constants as C
from corpusradar.functions import scoring as S


def learned_score(
    train: DataFrame,
    apply_to: DataFrame,
    known_domains: Sequence[str] = C.KNOWN_DOMAINS,
    lexicons: S.Lexicons = S.Lexicons(),
    features: int = 1 << 14,
) -> DataFrame:
    """Fit on ``train(text, label)``, score ``apply_to(paper_id, text, domain)`` and calibrate the result."""
    pipeline = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features", minDocFreq=2),
        LogisticRegression(featuresCol="_features", labelCol="label", maxIter=20, regParam=0.01),
    ])
    model = pipeline.fit(train.select("text", F.col("label").cast("double").alias("label")))
    scored = model.transform(apply_to)
    raw = F.round(vector_to_array("probability")[1] * 9 + 1, 1)
    signals = S.extract_signals(F.col("text"), None, lexicons)
    return scored.select(
        "paper_id", raw.alias("learned_raw"),
        S.calibrate_score(raw, F.col("domain"), signals, known_domains).alias("overall_score"),
        S.correct_hype(raw, signals).alias("hype_score"),
    )
