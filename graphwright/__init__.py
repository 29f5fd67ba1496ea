"""graphwright: text-to-knowledge-graph and table-question operators on Spark.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from Spark SQL
expressions, joins, aggregates and windows, so Catalyst plans it and the work is
partitioned across executors.  Model calls and page fetching stay outside: their
results arrive as input tables.
"""

__version__ = "0.1.0"
