"""rankloom: score, rank and digest listings for many profiles at once, on Spark.

Every public function takes DataFrames (plus plain parameters) and returns a
DataFrame; rows stay on the executors. A few functions write a table that
several branches read (``session.materialize``) before they return.
"""

__all__ = ["session"]
