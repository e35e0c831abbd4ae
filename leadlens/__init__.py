"""leadlens — news-to-lead analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from
``pyspark.sql`` expressions, so Catalyst plans, prunes and pushes down
as it would for any hand-written query.  Parameters that the dashboard
read from widgets or from ``now()`` (prompt version, score threshold,
``as_of`` time, page size) are explicit arguments.
"""

__version__ = "0.1.0"
