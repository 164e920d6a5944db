"""All touching pairs of the grid hash join."""

from gridloom.plans.catalog import QUERIES
from tests.conftest import SF


def test_all_pairs_are_returned(spark):
    boxes = {r[0]: (r[0] % 37 * 0.5, r[0] % 23 * 0.5) for r in spark.read.parquet(f"{SF}/supplier.parquet").select("s_suppkey").collect()}
    want = {(i, j) for i, a in boxes.items() for j, b in boxes.items() if abs(a[0] - b[0]) <= 0.75 and abs(a[1] - b[1]) <= 0.75}
    made = [(r["left_id"], r["right_id"]) for r in QUERIES["grid_hash_join"](spark, SF).collect()]
    assert len(made) == len(want) and set(made) == want
