"""Procurement, goods-receipt and run-log tables on Spark.

Every operator is a function from DataFrames to a DataFrame, or from columns to
a column; nothing runs until the caller writes or collects the result, except
the skew probes in :mod:`dockledger.operators.skew`.
"""
