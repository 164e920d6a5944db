"""Mann-Kendall p-values of all cells against brute force."""

import itertools
import math

from gridloom.operators import trends
from gridloom.plans.catalog import QUERIES
from gridloom.sources.driver_tables import observations
from tests.conftest import SF


def brute_p(y):
    """Two-sided p: over all orders without ties, else by the normal with the variance corrected for ties."""
    of = lambda x: sum((b > a) - (b < a) for a, b in itertools.combinations(x, 2))
    n, s = len(y), abs(of(y))
    if len(set(y)) == n:
        return min(1.0, sum(abs(of(x)) >= s for x in itertools.permutations(range(n))) / math.factorial(n))
    ties = [y.count(v) for v in set(y)]
    variance = (n * (n - 1) * (2 * n + 5) - sum(t * (t - 1) * (2 * t + 5) for t in ties)) / 18
    return math.erfc(s / math.sqrt(2 * variance)) if variance else 1.0


def test_p_values_with_ties_and_other_lengths(spark):
    series = {0: [1, 3, 2, 5, 4], 1: [1, 2, 3, 4, 5, 6, 7], 2: [1, 1, 2, 3, 5], 3: [4, 4, 4, 2, 1, 1, 0, 2], 4: [2, 2, 2, 2, 2], 5: [8, 7, 6, 5, 4, 3]}
    rows = [("a", 0, k, 2000 + i, float(v)) for k, y in series.items() for i, v in enumerate(y)]
    made = trends.pixel_trends(spark.createDataFrame(rows, "dataset_id string, lat_idx int, lon_idx int, year int, value double")).collect()
    assert len(made) == len(series)
    for r in made:
        assert math.isclose(r["p_value"], brute_p(series[r["lon_idx"]]), abs_tol=1e-9)


def test_all_cells_are_returned(spark):
    cells = observations(spark, SF).select("dataset_id", "lat_idx", "lon_idx").distinct().count()
    assert QUERIES["mann_kendall_p"](spark, SF).count() == cells
