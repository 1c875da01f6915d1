"""Layered analytics on Spark: rules, survivorship, upserts, gold aggregates and reconciliation over DataFrames."""
