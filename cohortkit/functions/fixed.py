"""Fixed values.

These values must equal the ones the reference application uses, so they
are stated here plainly, in their natural order, in one place.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference application's)
# ---------------------------------------------------------------------------

ENROLLMENT_STATUSES = ["Enrolled", "Completed", "Dropped", "Withdrawn"]

GRADES = ["A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D", "F"]

# Grade points per letter grade.
GRADE_POINTS = {
    "A": 4.0, "A-": 3.7,
    "B+": 3.3, "B": 3.0, "B-": 2.7,
    "C+": 2.3, "C": 2.0, "C-": 1.7,
    "D": 1.0, "F": 0.0,
}

# Grade bands used by the feature table.
GRADE_BANDS = {
    "excellent": ["A", "A-"],
    "good": ["B+", "B", "B-"],
    "average": ["C+", "C", "C-"],
    "poor": ["D", "F"],
}

# Success label: gpa >= 3.0 and completion rate >= 70.
SUCCESS_MIN_GPA = 3.0
SUCCESS_MIN_COMPLETION = 70.0
# Indicators: high performer gpa >= 3.5 and excellence >= 30;
# at risk gpa < 2.5 or drop rate > 20.
HIGH_PERFORMER_MIN_GPA = 3.5
HIGH_PERFORMER_MIN_EXCELLENCE = 30.0
AT_RISK_MAX_GPA = 2.5
AT_RISK_MIN_DROP_RATE = 20.0
# About 120 days per semester.
DAYS_PER_SEMESTER = 120.0
# Engagement = total/10*0.3 + completion/100*0.4 + (100-drop)/100*0.3.
ENGAGEMENT_WEIGHTS = (0.3, 0.4, 0.3)

# Default at-risk gpa threshold of the browsing queries and dashboard.
DEFAULT_GPA_THRESHOLD = 2.5

# Ordered feature list of the model input.
FEATURE_COLUMNS = [
    "gpa",
    "year_level",
    "total_enrollments",
    "completed_courses",
    "dropped_courses",
    "current_enrollments",
    "excellent_grades",
    "good_grades",
    "average_grades",
    "poor_grades",
    "avg_course_credits",
    "total_credits_attempted",
    "days_enrolled",
    "semesters_enrolled",
    "completion_rate",
    "drop_rate",
    "excellence_rate",
    "good_grade_rate",
    "struggle_rate",
    "courses_per_semester",
    "credits_per_semester",
    "engagement_score",
    "grade_diversity",
    "high_performer",
    "at_risk",
    "major_encoded",
]

FEATURE_DESCRIPTIONS = {
    "gpa": "Student cumulative GPA",
    "year_level": "Current year in program (1-4)",
    "total_enrollments": "Total courses enrolled in",
    "completed_courses": "Number of courses completed",
    "dropped_courses": "Number of courses dropped",
    "current_enrollments": "Currently enrolled courses",
    "excellent_grades": "Count of A/A- grades",
    "good_grades": "Count of B+/B/B- grades",
    "average_grades": "Count of C+/C/C- grades",
    "poor_grades": "Count of D/F grades",
    "avg_course_credits": "Average credits per course",
    "total_credits_attempted": "Total credits attempted",
    "days_enrolled": "Days since enrollment",
    "semesters_enrolled": "Approximate semesters enrolled",
    "completion_rate": "Percentage of courses completed",
    "drop_rate": "Percentage of courses dropped",
    "excellence_rate": "Percentage of excellent grades",
    "good_grade_rate": "Percentage of good grades",
    "struggle_rate": "Percentage of poor grades",
    "courses_per_semester": "Average courses per semester",
    "credits_per_semester": "Average credits per semester",
    "engagement_score": "Composite engagement metric",
    "grade_diversity": "Variation in grade distribution",
    "high_performer": "Binary indicator of high performance",
    "at_risk": "Binary indicator of at-risk status",
    "major_encoded": "Encoded student major",
}

FEATURE_CATEGORIES = {
    "basic": ["gpa", "year_level"],
    "enrollment": ["total_enrollments", "completed_courses", "dropped_courses", "current_enrollments"],
    "grades": ["excellent_grades", "good_grades", "average_grades", "poor_grades"],
    "rates": ["completion_rate", "drop_rate", "excellence_rate", "struggle_rate"],
    "composite": ["engagement_score", "grade_diversity", "courses_per_semester"],
}

# Risk tiers by success probability: >= .8 Low, >= .6 Medium, >= .4 High,
# else Critical; each with its icon and recommendation list.
RISK_TIERS = [
    (0.8, "Low", "🟢", [
        "Continue current academic trajectory",
        "Consider taking on leadership roles or advanced coursework",
        "Explore research or internship opportunities",
        "Mentor other students who may be struggling",
    ]),
    (0.6, "Medium", "🟡", [
        "Schedule quarterly check-ins with academic advisor",
        "Join study groups for challenging courses",
        "Consider tutoring for specific subjects if needed",
        "Monitor course load and adjust if feeling overwhelmed",
        "Utilize campus academic support resources",
    ]),
    (0.4, "High", "🟠", [
        "Schedule immediate meeting with academic advisor",
        "Enroll in tutoring services for struggling courses",
        "Consider reducing course load next semester",
        "Attend academic skills workshops",
        "Connect with student success center",
        "Explore time management resources",
    ]),
    (None, "Critical", "🔴", [
        "URGENT: Meet with academic advisor immediately",
        "Consider academic intervention programs",
        "Evaluate if academic probation support is needed",
        "Reassess major and career goals with counselor",
        "Explore comprehensive support services",
        "Consider taking lighter course load or academic break",
    ]),
]

# Context recommendations put in front of the tier list: drop rate > 15
# first, then gpa < 2.0 in front of it.
HIGH_DROP_RATE = 15.0
HIGH_DROP_TEXT = "⚠️ High drop rate detected - investigate reasons for course withdrawals"
LOW_GPA = 2.0
LOW_GPA_TEXT = "⚠️ GPA below 2.0 - immediate academic intervention recommended"

# Confidence from max(p, 1 - p): > .85 Very High, > .7 High, > .6 Medium, else Low.
CONFIDENCE_LEVELS = [(0.85, "Very High"), (0.7, "High"), (0.6, "Medium"), (None, "Low")]

# Interpretation sentences by tier; {p} is the probability as a percent with one decimal.
INTERPRETATIONS = [
    (0.8, "This student shows strong indicators of academic success with a {p} probability. "
          "Their academic performance and engagement are excellent."),
    (0.6, "This student has a {p} probability of success. While generally on track, "
          "some areas may benefit from additional support."),
    (0.4, "This student has a {p} probability of success and may be at risk. "
          "Proactive intervention is recommended."),
    (None, "This student has only a {p} probability of success and is at high risk. "
           "Immediate intervention is strongly recommended."),
]

# Dashboard heuristic score p = min(gpa / 4 + 0.1, 1); tier < .6 High,
# < .8 Medium, else Low.
HEURISTIC_OFFSET = 0.1
HEURISTIC_TIERS = [(0.6, "High"), (0.8, "Medium"), (None, "Low")]

# GPA histogram of the dashboard: 20 bins over [0, 4].
GPA_HISTOGRAM_BINS = 20
GPA_RANGE = (0.0, 4.0)

# Value constraints of the input records.
YEAR_LEVEL_RANGE = (1, 4)
GPA_BOUNDS = (0.0, 4.0)
RATE_BOUNDS = (0.0, 100.0)

# Null defaults of the roll-ups.
UNDECLARED_MAJOR = "Undeclared"
UNKNOWN_LABEL = "Unknown"

# Split sizes and cross-validation defaults.
DEFAULT_TEST_SIZE = 0.2
DEFAULT_VAL_SIZE = 0.2
DEFAULT_CV_FOLDS = 5
DEFAULT_RANDOM_STATE = 42

# Parameter grids of the model search (4 / 162 / 72 points); an unlimited depth is 30.
FULL_GRIDS = {
    "logistic_regression": {"C": [0.01, 0.1, 1, 10]},
    "random_forest": {
        "numTrees": [100, 200, 300],
        "maxDepth": [10, 20, 30],
        "minInstancesPerNode": [1, 2, 4],
        "minSamplesSplit": [2, 5, 10],
        "featureSubsetStrategy": ["sqrt", "log2"],
    },
    "gradient_boosting": {
        "maxIter": [100, 200],
        "stepSize": [0.01, 0.1, 0.2],
        "maxDepth": [3, 5, 7],
        "minSamplesSplit": [2, 5],
        "subsamplingRate": [0.8, 1.0],
    },
}
REFERENCE_GRID_SIZES = {"logistic_regression": 4, "random_forest": 162, "gradient_boosting": 72}
