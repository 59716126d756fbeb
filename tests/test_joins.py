from pyspark.sql import functions as F

from cohortkit.functions.joins import salted_join
from cohortkit.operators import features as X
from cohortkit.operators import rollups as A


def _sorted(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def test_salted_join_equals_plain_join_with_a_hot_key(spark):
    fact = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50)).alias("k"),
                                    F.col("id").alias("v"))
    dim = spark.createDataFrame([(k, f"d{k}") for k in range(0, 40)] + [(1, "dup")], "k long, name string")
    for how in ("left", "inner"):
        assert _sorted(salted_join(fact, dim, "k", 8, how)) == _sorted(fact.join(dim, "k", how))


def test_salted_feature_and_navigation_results_unchanged(spark, tiny):
    s, c, e = tiny
    assert _sorted(X.student_features_base(s, e, c, salts=4)) == _sorted(X.student_features_base(s, e, c))
    assert _sorted(A.enrollment_navigation(s, e, c, salts=3)) == _sorted(A.enrollment_navigation(s, e, c))
