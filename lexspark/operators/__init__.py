"""Operators over DataFrames: index, search, corpus statistics, evaluation, repository."""
