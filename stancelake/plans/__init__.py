"""Registered queries: operators applied to the benchmark tables, with their SQL oracles."""
