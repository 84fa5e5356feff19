"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; it may be removed without harm.
Every operator takes and returns DataFrames, keeps wide text out of shuffles
where it can, and writes intermediate tables only below the cluster's shared
folder (``spark.checkpoint.dir``).
"""
