"""Seats by a scaled threshold against the loops that hand out single seats."""

import pytest

from meridia.plans import QUERIES


def loops(w):
    total = lambda s: {k: min(60, max(1, int(x * s + 0.5))) for k, x in w.items()}
    lo, hi = 0.0, 6000 / sum(w.values())
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(total(mid).values()) < 300 else (lo, mid)
    n = total(hi)
    while sum(n.values()) < 300 and any(x < 60 for x in n.values()):
        n[min((k for k in n if n[k] < 60), key=lambda k: (-w[k] / (n[k] + 1), k))] += 1
    while sum(n.values()) > 300 and any(x > 1 for x in n.values()):
        n[min((k for k in n if n[k] > 1), key=lambda k: (-n[k] / w[k], k))] -= 1
    return n


@pytest.mark.parametrize("weights", [[5.0] * 7, [3.0] * 13 + [6.0] * 4, [1.0, 2.0, 3.0, 4.0, 5.0, 9e6], [2.0] * 4, [1.0] * 301])
def test_seats_sum_to_the_target(spark, tmp_path, weights):
    rows = [(k, f"c{k}", k, x, "A") for k, x in enumerate(weights)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.home_unit_id: r.seats for r in QUERIES["e12_scaled_threshold"](spark, str(tmp_path)).collect()}
    assert got == loops({k: x * 1000 for k, x in enumerate(weights)})
    assert sum(got.values()) == min(60 * len(weights), max(300, len(weights)))
