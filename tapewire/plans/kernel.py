"""A radial-kernel classifier from linear parts: random Fourier features in front of a linear one."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Maps a vector to ``sqrt(2 / D) * cos(Wx + b)``, whose inner products approach the kernel exp(-gamma |x - y|^2).

    W and b follow from the parameters alone, so a saved one gives the same features when loaded.  ``gamma`` 0 means
    one over the number of inputs, which suits scaled inputs.  A batch of rows is one product of matrices, in an Arrow function.
    """

    inputs = Param(Params._dummy(), "inputs", "length of the input vectors", TypeConverters.toInt)
    features = Param(Params._dummy(), "features", "number of cosine features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "width of the kernel; 0 for one over the inputs", TypeConverters.toFloat)

    def __init__(self, inputs: int = 1, features: int = 256, gamma: float = 0.0, seed: int = 42, inputCol: str = "features", outputCol: str = "kernel"):
        super().__init__()
        self._set(inputs=inputs, features=features, gamma=gamma, seed=seed, inputCol=inputCol, outputCol=outputCol)

    def _weights(self) -> np.ndarray:
        """One row a feature: its weights and, last, its shift."""
        d, n = self.getOrDefault(self.inputs), self.getOrDefault(self.features)
        gamma = self.getOrDefault(self.gamma) or 1.0 / d
        rng = np.random.default_rng(self.getSeed())
        return np.hstack([rng.normal(0.0, math.sqrt(2.0 * gamma), (n, d)), rng.uniform(0.0, 2.0 * math.pi, (n, 1))])

    def _transform(self, df: DataFrame) -> DataFrame:
        weights, scale = self._weights(), math.sqrt(2.0 / self.getOrDefault(self.features))

        @F.arrow_udf("array<double>")
        def mapped(x: pa.Array) -> pa.Array:
            z = scale * np.cos(x.flatten().to_numpy().reshape(len(x), -1) @ weights[:, :-1].T + weights[:, -1]) if len(x) else np.empty((0, 1))
            return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * z.shape[1], z.ravel())

        return df.withColumn(self.getOutputCol(), array_to_vector(mapped(vector_to_array(self.getInputCol()))))


def kernel_svc(inputs: int, label: str, features: int = 256, gamma: float = 0.0, steps: int = 100, seed: int = 42) -> Pipeline:
    """An estimator over a scaled ``features`` vector of ``inputs`` numbers."""
    linear = LinearSVC(maxIter=steps, featuresCol="kernel", labelCol=label, weightCol="weight")
    return Pipeline(stages=[RandomFourierFeatures(inputs, features, gamma, seed), linear])
