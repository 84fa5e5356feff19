"""Keyed, ordered folds over append-only logs, as DataFrames and streams.

A log is a DataFrame of (topic, partition, offset, timestamp, key, value ...).
Records are filtered and re-keyed, folded per key into an optional state, and
the states, journals and keys are kept in tables from which a run recovers;
the offset that is safe to commit is computed as data.
"""
