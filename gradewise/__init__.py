"""gradewise: score free-form responses and analyse the scores on Spark.

Cases, rules, reference texts and responses are DataFrames. Scoring is
joins, higher-order array expressions and aggregations over them; the two
alignment kernels that SQL cannot express run as Arrow-batched pandas UDFs.
"""

from gradewise.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
