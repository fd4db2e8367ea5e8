"""Leafmill: tabular machine-learning data jobs over hierarchically keyed measurements, on Spark.

Every operator is a plain function from DataFrame to DataFrame, so jobs compose with
``df.transform`` and Catalyst sees one declarative plan.
"""

DEFAULT_KEYS = ("source", "hierarchy_1", "hierarchy_2")
