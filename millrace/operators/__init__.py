"""Operators over DataFrames that Spark's own vocabulary doesn't spell out."""
