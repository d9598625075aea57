"""Person-year record analytics on Spark.

The package standardises yearly payroll extracts into one record schema, links
the records of a person across years, and computes turnover, spells and
survival curves.  Functions take DataFrames and column names and return
DataFrames; they compose with ``DataFrame.transform``.
"""
