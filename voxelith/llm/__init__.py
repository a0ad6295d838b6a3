"""Operators for large training-text corpora.

Every operator takes DataFrames, names its columns by parameter, selects only
the columns it needs (so extra or clashing columns in the input do no harm) and
never gathers an unbounded group on the driver or in one task.
"""
