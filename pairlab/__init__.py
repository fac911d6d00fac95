"""pairlab: pool-based active learning over embedded sequence pairs, on Spark DataFrames.

Sub-packages
------------
sources    readers/writers for sequence, pair, embedding, feature and result tables
functions  column expressions (vector arithmetic, scores, hashing) that stay in the JVM
operators  DataFrame -> DataFrame operators (lookups, features, sampling, metrics, acquisition, models)
plans      compositions of operators: the flagship acquisition query, the round loop, the
           experiment grid, and the query catalog used by ``__spark_entry__``
"""

__version__ = "0.1.0"
