"""Spark SQL expressions, as text.

Every function here takes and returns expression text, so that expressions nest freely and
a whole projection is handed to Spark in one call (`selectExpr`, `filter`, `F.expr`).
Building the same trees Column by Column costs a driver round trip per node.
"""
