"""Feature vectors and the flow classifier."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from flowquery.functions import scalar
from flowquery.operators.windows import bucket, markov

#: Classes of packet lengths and of gaps, and their widths in bytes and milliseconds; bytes that must have been seen for their shares to count.
STATES, LENGTH, GAP, ENOUGH = 10, 150, 50, 100


def metadata(dp: Column, sp: Column, pkts_in: Column, pkts_out: Column, bytes_in: Column, bytes_out: Column, duration: Column) -> Column:
    """The seven plain figures of a flow; missing ones count 0."""
    return F.array(*(F.coalesce(x.cast("double"), F.lit(0.0)) for x in (dp, sp, pkts_in, pkts_out, bytes_in, bytes_out, duration)))


def markov_vectors(df: DataFrame, key: str, value: Column, width: int, states: int, *order: str) -> DataFrame:
    """(key, vector): the transition matrix of bucketed values as states * states shares, row by row."""
    shares = markov(df, [key], bucket(value, width, states), *order)
    cells = F.map_from_entries(F.collect_list(F.struct((F.col("prev") * states + F.col("cur")).alias("i"), "p")))
    spread = F.transform(F.sequence(F.lit(0), F.lit(states * states - 1)), lambda i: F.coalesce(F.try_element_at(F.col("cells"), i), F.lit(0.0)))
    return shares.groupBy(key).agg(cells.alias("cells")).select(key, spread.alias("vector"))


def _transitions(values: pd.Series, width: int) -> np.ndarray:
    """A transition matrix of the classed values of each row, row by row; a single value goes over into its own class."""
    held = [np.asarray(x if x is not None else (), dtype="float64") for x in values]
    sizes = np.array([len(x) for x in held], dtype="int64")
    flat = np.concatenate([*held, np.empty(0)])
    states = np.clip(flat // width, 0, STATES - 1).astype("int64")
    row = np.repeat(np.arange(len(held)), sizes)
    goes_on = row[1:] == row[:-1]
    cells = row[1:][goes_on] * STATES**2 + states[:-1][goes_on] * STATES + states[1:][goes_on]
    alone = sizes[row] == 1
    cells = np.concatenate([cells, row[alone] * STATES**2 + states[alone] * (STATES + 1)])
    counts = np.bincount(cells, minlength=len(held) * STATES**2).reshape(len(held), STATES, STATES).astype("float64")
    totals = counts.sum(axis=2, keepdims=True)
    return np.divide(counts, totals, out=np.zeros_like(counts), where=totals > 0).reshape(len(held), STATES**2)


@F.pandas_udf(ArrayType(DoubleType()))
def _two_chains(lengths: pd.Series, gaps: pd.Series) -> pd.Series:
    return pd.Series(list(np.hstack([_transitions(lengths, LENGTH), _transitions(gaps, GAP)])), dtype=object)


def flow_vector(packets: Column, dp: Column, sp: Column, pkts_in: Column, pkts_out: Column, bytes_in: Column, bytes_out: Column) -> Column:
    """The 207 figures of a flow record: seven plain ones and the transition matrices of lengths and gaps of ``packets`` (array of b, ipt in ms); with the constant before them, 208.

    The duration is that of the listed packets, the sum of their gaps. What is missing counts 0.
    """
    listed = lambda name: F.transform(packets, lambda x: F.coalesce(x[name].cast("double"), F.lit(0.0)))
    gaps = listed("ipt")
    duration = F.reduce(F.coalesce(gaps, F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)
    return F.concat(metadata(dp, sp, pkts_in, pkts_out, bytes_in, bytes_out, duration), _two_chains(listed("b"), gaps))


def byte_shares(counts: Column, bytes_in: Column, bytes_out: Column) -> Column:
    """256 counters of both directions' bytes as shares of all bytes; null where there are no counters, or no more than ``ENOUGH`` bytes were seen."""
    total = F.coalesce(bytes_in, F.lit(0)) + F.coalesce(bytes_out, F.lit(0))
    return F.when(total > ENOUGH, F.transform(counts, lambda n: n / total))


def p_malware(vector: Column, shares: Column, plain: Sequence[float], with_bytes: Sequence[float] | None = None) -> Column:
    """The score of a ``flow_vector``: by the 464 weights over vector and ``shares`` where there are shares, else by the 208; the constant comes first."""
    width = 7 + 2 * STATES**2
    for weights, wanted in ((plain, 1 + width), (with_bytes, 1 + width + 256)):
        if weights is not None and len(weights) != wanted:
            raise ValueError(f"a model of {wanted} weights is wanted, this one has {len(weights)}")
    by_plain = scalar.logistic(vector, list(plain))
    return by_plain if with_bytes is None else F.when(shares.isNotNull(), scalar.logistic(F.concat(vector, shares), list(with_bytes))).otherwise(by_plain)


def normalized(counts: Column) -> Column:
    total = F.reduce(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def assemble(df: DataFrame, parts: Sequence[str], width: int) -> DataFrame:
    """``df`` with ``features``, the parts in a row; rows of another width in total go."""
    return df.withColumn("features", F.flatten(F.array(*parts))).where(F.size("features") == width)


def folds(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """``df`` with ``fold`` from 1 to k, evenly by a hash; each row's fold follows from its own hash (of the values as text) alone."""
    digest = F.md5(F.concat_ws(",", *(x.cast("string") for x in order)).cast("binary"))
    return df.withColumn("fold", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % k + 1).cast("int"))


def train(df: DataFrame, c: float = 1.0, standardize: bool = False) -> LogisticRegressionModel:
    """L1 logistic regression over (features array<double>, label); ``c``: the inverse of the penalty."""
    n = max(1, df.count())
    model = LogisticRegression(elasticNetParam=1.0, regParam=1 / (c * n), standardization=standardize, maxIter=100)
    return model.fit(df.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label")))


def score(model: LogisticRegressionModel, df: DataFrame) -> DataFrame:
    """``df`` with ``p``, the probability of label 1."""
    scored = model.transform(df.withColumn("_v", array_to_vector("features")).drop("features").withColumnRenamed("_v", "features"))
    return scored.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def accuracy(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Right answers and their share, of ``p`` against ``label``."""
    right = (F.col("p") >= 0.5).cast("int") == F.col("label")
    return df.groupBy(*groups).agg(F.count_if(right).alias("correct"), F.avg(right.cast("double")).alias("accuracy"))


def parameter_lines(model: LogisticRegressionModel) -> list[float]:
    """The constant, then the weights, as a parameter file has them."""
    return [float(model.intercept), *map(float, model.coefficients)]


__all__ = ["accuracy", "assemble", "byte_shares", "flow_vector", "folds", "markov_vectors", "metadata", "normalized", "p_malware", "parameter_lines", "score", "train"]
