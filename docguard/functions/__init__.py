"""Building blocks as Spark SQL expressions: text in, text out, no UDF.

An argument is a column name or any SQL expression.  The text of a whole expression
reaches the JVM in one call, and Catalyst sees exactly what is written here.
"""
