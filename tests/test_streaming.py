from datetime import datetime

from cohortkit.streaming import refresh
from tests.conftest import STUDENT_DDL


def test_indicators_refresh_incrementally(spark, tmp_path):
    src = str(tmp_path / "students")
    d = datetime(2024, 1, 1)
    batch1 = spark.createDataFrame([(1, "A", "B", "a@x", "Math", 1, 2.0, d, True), (2, "C", "D", "c@x", "Art", 2, 3.5, d, False)],
                                   STUDENT_DDL)
    batch1.write.mode("append").parquet(src)
    stream = refresh.student_stream(spark, src)
    q1 = refresh.start_refresh(refresh.kpi_stream(stream), str(tmp_path / "kpi"), str(tmp_path / "ck1"), once=True)
    q1.awaitTermination()
    r = spark.read.parquet(str(tmp_path / "kpi")).first()
    assert (r.total_students, r.active_students, r.at_risk_count) == (2, 1, 1)

    spark.createDataFrame([(3, "E", "F", "e@x", "Math", 3, 1.0, d, True)], STUDENT_DDL).write.mode("append").parquet(src)
    q2 = refresh.start_refresh(refresh.at_risk_by_major_stream(refresh.student_stream(spark, src)),
                               str(tmp_path / "risk"), str(tmp_path / "ck2"), once=True)
    q2.awaitTermination()
    got = {row.major: row["count"] for row in spark.read.parquet(str(tmp_path / "risk")).collect()}
    assert got == {"Math": 2}
