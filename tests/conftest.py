import os
import sys
import tempfile
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cohortkit.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app_name="cohortkit-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="cohortkit-test-ckpt-")})
    yield s
    s.stop()


STUDENT_DDL = ("student_id long, first_name string, last_name string, email string, major string, year_level int, "
               "gpa double, enrollment_date timestamp_ntz, is_active boolean")
COURSE_DDL = ("course_id long, course_name string, department string, credits int, course_type string, "
              "max_enrollment int, semester string, year int")
ENROLLMENT_DDL = ("enrollment_id string, student_id long, course_id long, enrollment_date timestamp_ntz, "
                  "grade string, status string")

D0 = datetime(2024, 1, 1)


@pytest.fixture
def tiny(spark):
    """Three small entity tables with the edge cases the operators must handle."""
    students = spark.createDataFrame([
        (1, "Ann", "Lee", "a@x", "Math", 1, 3.6, D0, True),        # strong student
        (2, "Bob", "Ray", "b@x", None, 2, 2.2, D0, True),          # null major, low gpa
        (3, "Cat", "Fox", "c@x", "Art", None, None, D0, True),     # null year and gpa
        (4, "Dan", "Oak", None, "Art", 4, 3.0, D0, False),        # inactive
        (5, "Eve", "Elm", "e@x", "Math", 3, 3.9, D0, True),        # no enrollments
    ], STUDENT_DDL)
    courses = spark.createDataFrame([
        (10, "Algebra", "MATH", 4, "Lecture", 30, "Fall", 2024),
        (11, "Drawing", None, 2, "Lab", 20, "Spring", 2024),
        (12, "Empty", "MATH", 3, "Seminar", 15, None, 2024),  # no enrollments
    ], COURSE_DDL)
    enrollments = spark.createDataFrame([
        ("E1", 1, 10, D0, "A", "Completed"),
        ("E2", 1, 11, D0, "A-", "Completed"),
        ("E3", 1, 11, D0, "B", "Dropped"),        # repeated (student, course) pair
        ("E4", 2, 10, D0, "F", "Dropped"),
        ("E5", 2, 11, D0, None, "Enrolled"),
        ("E6", 3, 10, D0, "C", "Completed"),
        ("E7", 4, 10, D0, "B+", "Completed"),
        ("E7", 4, 11, D0, "D", "Withdrawn"),      # repeated enrollment id
        ("E9", 9, 99, D0, "A", "Completed"),      # orphan on both keys
    ], ENROLLMENT_DDL)
    return students, courses, enrollments
