"""Fixed values. Those in the first block define results; the rest only choose a plan."""

from __future__ import annotations

# Fixed values that results depend on.
IQR_FENCE = 1.5
Z_LIMIT = 3.0
HIGH_MISSING = 0.3  # a column above this is reported as highly missing
READINESS_HIGH_MISSING = 0.4  # a column above this lowers the readiness score
NUMERIC_CATEGORY_MAX = 20
NUMERIC_CATEGORY_SHARE = 0.05
TEXT_CATEGORY_MAX = 50
TEXT_CATEGORY_SHARE = 0.1
READINESS_PENALTY = {
    "missingness": 120.0,
    "duplicates": 150.0,
    "constants": 200.0,
    "high_missing_columns": 250.0,
    "outliers": 80.0,
}
READINESS_BANDS = [(90.0, "Ready"), (75.0, "Minor fixes needed"), (50.0, "Needs work")]
READINESS_LOWEST_BAND = "Not ready"
READY_SCORE = 85.0
HIGH_OUTLIER_SHARE = 0.15
COMPARE_OUTLIER_SHARE = 0.10
PREVIEW_OUTLIERS = 20
SAMPLE_ROWS = 20
EXAMPLE_VALUES = 5
PREVIEW_MEANS = 50

# Sketches: how sure brackets are, and how finely values are cut.
SKETCH_SIZE = 4000  # ranks of sketched quartiles are off by about a thousandth
RANK_MARGIN = 0.006  # a bracket reaches this share of the ranks to either side
BRACKET_VALUES = 5_000_000  # brackets that hold more are narrowed by another sketch
RANK_BUCKETS = 32  # least number of buckets that order statistics are looked up in
SKETCH_GROUPS = 512  # tasks whose sketches are merged together first

# Groups: what may be broadcast.
GROUPS_AT_HAND = 8192  # groups with more than one part in so many of all rows

# Samples of an exact size.
DRAW_MARGIN = 8.0  # standard deviations to either side in which a threshold is looked for
