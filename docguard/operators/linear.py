"""Linear text models as lookups: a weight per token bucket, summed per word and per window inside the text's row.

A fitted pipeline (hashed counts, IDF, logistic regression) is linear in its counts, so a text's margin is the sum of its
tokens' weights.  Each word is weighed once, windows add up words, and nothing leaves the row: the same expressions
serve batches and streams.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from docguard.functions import text as T
from docguard.functions.numbers import num

#: What separates tokens, and the bucket of a token {t} among {n}.
SEPARATOR = r"[^\p{L}\p{N}_]+"
BUCKET = "pmod(xxhash64({t}), {n})"

_SCHEMA = "weights array<double>, intercept double, bucket string"


@dataclass(frozen=True)
class LinearTextModel:
    """Weights per bucket, an intercept, and the SQL that deals a token {t} to one of {n} buckets."""
    weights: Sequence[float]
    intercept: float
    bucket: str = BUCKET

    def frame(self, spark: SparkSession) -> DataFrame:
        """The model as one row; plans read it as a scalar, so its weights are no literals of the plan."""
        return spark.createDataFrame([([float(w) for w in self.weights], float(self.intercept), self.bucket)], _SCHEMA)


def compiled(model: PipelineModel) -> LinearTextModel:
    """The lookup of a pipeline fitted by fit_text_model: the IDF and the coefficient of a bucket are one weight."""
    idf, regression = model.stages[-2].idf.toArray(), model.stages[-1]
    return LinearTextModel([float(w) for w in idf * regression.coefficients.toArray()], float(regression.intercept))


def save_text_model(spark: SparkSession, model: LinearTextModel, path: str) -> None:
    model.frame(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_text_model(spark: SparkSession, path: str) -> LinearTextModel:
    row = spark.read.schema(_SCHEMA).parquet(path).first()
    return LinearTextModel(list(row["weights"]), row["intercept"], row["bucket"])


def with_window_scores(df: DataFrame, model: LinearTextModel, text: str = "text", size: int = 510, stride: int = 256) -> DataFrame:
    """Add _scores, the probability of each window: the whole text where it has at most `size` words, else windows of
    `size` words at every `stride`-th.  NULL counts as ''; a text without words has the intercept's probability."""
    columns = df.columns
    pattern = SEPARATOR.replace("\\", "\\\\")
    bucket = model.bucket.format(t="t", n=len(model.weights))
    weight = f"if(t = '', 0.0D, get(_weights, int({bucket})))"
    add = "0.0D, (total, x) -> total + x"
    worded = df.withColumn("_weights", model.frame(df.sparkSession).select("weights").scalar()).selectExpr(
        "*", f"{T.tokens(f"lower(coalesce({text}, ''))")} AS _words")
    # a word holds no space; a pattern given to split would be compiled for every word, the one of regexp_replace is kept
    weighed = worded.selectExpr(
        *columns, f"transform(_words, w -> aggregate(transform(split(regexp_replace(w, '{pattern}', ' '), ' '), t -> {weight}), {add})) AS _sums")
    starts = f"if(size(_sums) <= {size}, array(0), sequence(0, greatest(size(_sums) - 1, 0), {stride}))"
    margin = f"{num(model.intercept)} + aggregate(slice(_sums, s + 1, {size}), {add})"
    return weighed.selectExpr(*columns, f"transform({starts}, s -> 1.0D / (1.0D + exp(-({margin})))) AS _scores")


def windowed_probability(stop_above: float = 0.99) -> str:
    """Of _scores: the first above the stop value, else the largest."""
    return f"coalesce(try_element_at(filter(_scores, score -> score > {num(stop_above)}), 1), array_max(_scores))"
