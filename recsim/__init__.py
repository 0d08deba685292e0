"""recsim: item-to-item similarity and collaborative-filtering analytics on Spark.

Every operator is a function from DataFrames to a DataFrame.  Operators run no
Spark action, so Catalyst sees one plan per query and can push filters and
prune columns all the way to the Parquet scan.  Documented exceptions: the
dense index (per-partition offsets), the blocked Gram product (writes its
per-item statistics and block layout) and the plan runners (lineage cuts).
"""

from recsim.params import Params

__all__ = ["Params"]
