"""Operations of a training-data pipeline: one module per operator.

Operators take and return DataFrames; ``queries`` registers one query per
operator.  Nothing outside this folder imports it.
"""
