"""Queries whose work must not grow with rows that say the same: their rows between operators are counted."""

import pytest

from latticeworks.plans import catalogue


@pytest.fixture
def flow(spark):
    """Runs a query; its rows, and how many rows all operators of all its plans gave on."""

    def run(name, data):
        store = spark._jsparkSession.sharedState().statusStore()
        before = store.executionsList().size()
        rows = [tuple(r) for r in catalogue.QUERIES[name](spark, str(data)).collect()]
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        total = 0
        for k in range(before, store.executionsList().size()):
            e = store.executionsList().apply(k)
            values = store.executionMetrics(e.executionId())
            for m in (e.metrics().apply(n) for n in range(e.metrics().size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    total += int(values.apply(m.accumulatorId()).replace(",", ""))
        return rows, total

    return run


def test_changes_write_a_path_once(spark, flow, tmp_path):
    rows = [(k, "LARGE", "Brand#1") for k in range(1, 3000)] + [(12_000 + k, None, "Brand#2") for k in (1, 2)]
    spark.createDataFrame(rows, "p_partkey long, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got, rows_made = flow("change_conflicts", tmp_path)
    changes = sorted(f"change{k}" for k in range(12))
    assert sorted(got) == sorted((a, b, s) for a in changes for b in changes if a < b for s in ("LARGE", "LARGE/Brand#1"))  # no path, no conflict
    assert rows_made < 100_000


CUSTOMER = "c_custkey long, c_mktsegment string, c_acctbal double, c_nationkey int"


def square(a, b):
    return (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2


def spot(k):
    return k * 7919 % 256_000, k * 104729 % 256_000


def site(k):
    return k * 48611 % 256_000, k * 15485863 % 256_000


def crowded(spark, path, copies):
    """Customers, most of them at places of others, in whose order ids and weights go against each other."""
    rows = [(k + 256_000 * c, "BUILDING", float(-(k * 37 + c * 11) % 50), k % 3) for k in range(0, 2000, 10) for c in range(copies)]
    spark.createDataFrame(rows, CUSTOMER).write.parquet(f"{path}/customer.parquet")
    return rows


def in_order(rows, order, radius, among=None):
    kept = []
    for r in sorted(rows, key=order):
        if all((among and among(k) != among(r)) or square(spot(k[0]), spot(r[0])) > radius * radius for k in kept):
            kept.append(r)
    return sorted(r[0] for r in kept)


def test_rows_at_one_place_give_way_once(spark, flow, tmp_path):
    rows = crowded(spark, tmp_path, 40)
    got, rows_made = flow("give_way", tmp_path)
    want = in_order(rows, lambda r: (-r[2], r[0]), 4000)
    assert sorted(r[0] for r in got) == want and len(want) < 200
    assert rows_made < 200_000


def test_rows_give_way_whose_weight_or_place_is_unknown(spark, tmp_path):
    rows = [(10, "A", None, 1), (256_010, "A", 1.0, 1), (20, "A", None, 1), (256_020, "A", float("nan"), 1), (512_020, "A", 5.0, 1), (None, "A", 2.0, 1)]
    spark.createDataFrame(rows, CUSTOMER).write.parquet(f"{tmp_path}/customer.parquet")
    got = [r[0] for r in catalogue.QUERIES["give_way"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == [256_010, 256_020, None]


def test_members_at_one_place_are_met_once(spark, flow, tmp_path):
    rows = crowded(spark, tmp_path, 40)
    got, rows_made = flow("clump_order", tmp_path)
    want = in_order(rows, lambda r: r[0], 12_000, lambda r: r[3])
    assert sorted(r[0] for r in got) == want and len(want) < 200
    assert rows_made < 200_000


@pytest.mark.parametrize("radius", [700, 6000, 90_000])
def test_thinned_is_the_sequence(spark, radius):
    """Over many tiles, in an order that hangs together over all of them."""
    from latticeworks.operators import spatial

    rows = [(k, k % 256_000 * 131 % 40_009 - 20_000, k % 7 * 300) for k in range(600)]
    kept = []
    for r in sorted(rows, key=lambda r: (r[1], r[0])):  # from left to right
        if all(square(r[1:], k[1:]) > radius * radius for k in kept):
            kept.append(r)
    points = spark.createDataFrame(rows, "id long, x_mm long, y_mm long").withColumn("left", spatial.F.col("x_mm"))
    assert sorted(r[0] for r in spatial.thinned(points, radius, ["left"]).collect()) == sorted(r[0] for r in kept)


def test_sites_at_one_place_are_met_once(spark, flow, tmp_path):
    rows = crowded(spark, tmp_path, 40)
    ids = [k + 256_000 * c for k in (1, 2, 3, 4) for c in range(100)]
    spark.createDataFrame([(k,) for k in ids], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got, rows_made = flow("nearest_site", tmp_path)
    want = {r[0]: min((square(spot(r[0]), site(s)), s) for s in (1, 2, 3, 4)) for r in rows}
    assert {r[0]: (r[2], r[1]) for r in got} == want and len(got) == len(rows)
    assert rows_made < 400_000


def test_selections_of_sites_with_long_ids(spark, tmp_path):
    """By d2 * 1000 + id, as SQL has it, an id can weigh more than a distance."""
    p, nearer, lower = 1072, 810_700, 544_278
    gap = square(spot(p), site(lower)) - square(spot(p), site(nearer))
    assert 0 < gap * 1000 < nearer - lower and lower % 6 == 0 and nearer % 6
    spark.createDataFrame([(p, "A", 0.0, 1)], CUSTOMER).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(s,) for s in (nearer, lower, 7)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    assert [tuple(r) for r in catalogue.QUERIES["reselection"](spark, str(tmp_path)).collect()] == [(p, lower, nearer)]
