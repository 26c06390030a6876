"""respscore: response-vs-prompt text analytics on Spark DataFrames.

Sub-packages
------------
functions   Column -> Column expressions (cleaning, counts, n-grams, vectors).
operators   DataFrame -> DataFrame operators (joins, TF-IDF, scaling, sampling,
            batching, pooling, metrics, plateau detection, models).
sources     fixture views over the given tables, readers and writers.
plans       composite pipelines (feature tables, training set, screening).
streaming   the stateless features and plateau detection on a stream.
"""

__all__ = ["functions", "operators", "sources", "plans", "streaming"]
