"""Operators over event and report tables. All take DataFrames and explicit ``now`` and ``seed`` values."""
