"""filelake: a file and document catalogue kept as Spark DataFrames.

Every operator is a plain function ``DataFrame -> DataFrame`` (or ``Column -> Column``), so Catalyst sees
one declarative plan from the Parquet scan to the result.
"""
