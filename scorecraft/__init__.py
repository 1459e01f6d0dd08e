"""Scorecard analytics as Spark DataFrame functions.

functions/  column expressions: guarded ratios, fixed-point rounding, bands
operators/  DataFrame building blocks: normalisation, ranking, snapshots, trends
plans/      the reports built from them
sources/    table readers, input adapters, named views and the report writer
"""
