"""tidemark: as-of tables, panels, documents, postings and matches on Spark.

Every operator takes DataFrames and returns a DataFrame.  The plan is declared
with native column expressions, windows, joins and aggregates, so Catalyst
chooses the physical strategy.
"""
