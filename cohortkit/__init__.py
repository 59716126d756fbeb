"""cohortkit: cohort analytics as composable Spark DataFrame operators.

Members (students) take part in activities (course enrollments) drawn from
a catalog (courses).  The package offers browsing queries, roll-ups and
key indicators over those three tables, a per-member feature table with a
success label, distributed training / tuning / evaluation with
``pyspark.ml``, and batch scoring with risk tiers and recommendations.

Layout:

* ``sources``   -- table readers, role views over the driver tables, sinks
* ``functions`` -- fixed values and reusable column expressions
* ``operators`` -- DataFrame -> DataFrame operators (quality, browse,
                   rollups, features, training, evaluation, scoring)
* ``plans``     -- the registered queries and their SQL oracles
* ``streaming`` -- incremental refresh of the dashboard indicators
"""

__version__ = "0.1.0"
