"""Pools of near widths, against brute force."""

from neumes.operators import assemble


def test_pools_at_the_ends_of_bands(spark):
    """Cents, so that many widths lie exactly at the end of another one's band, where sums and differences are rounded differently."""
    widths = [c / 100 for c in range(-120, 500)]
    items = spark.createDataFrame(list(enumerate(widths)), "id long, w double")
    sizes = assemble.pool_sizes(items, "id", "w", 0.15)
    found = {r.id: r.pool for r in sizes.collect()}
    assert found == {i: sum(abs(v - w) <= 0.15 * max(w, 1.0) for v in widths) for i, w in enumerate(widths)}
    pairs = {r.id: r["count"] for r in assemble.width_pool(items, "id", "w", 0.15).groupBy("id").count().collect()}
    assert pairs == found
