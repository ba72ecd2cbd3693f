"""civicflow: Spark-native service-ticket analytics.

Every operator is a ``DataFrame -> DataFrame`` transformation (or a small
fitted dictionary plus such a transformation) that Catalyst plans and Spark
executes in parallel.  Sub-packages:

* ``functions``  column expressions (parsing, cleaning, rounding, dates)
* ``sources``    readers and sinks (CSV tickets, dimensions, block reports, JSON)
* ``operators``  cleaning, enrichment, profiling, categories, splits,
                 scaling, models, evaluation, fairness
* ``plans``      composite flows and the query catalogue with SQL oracles
* ``streaming``  Structured Streaming scoring
"""

__version__ = "0.1.0"
