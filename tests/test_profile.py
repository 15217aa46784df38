import math

from tessera.operators import profile as R


def test_spread_of_lengths_beyond_64_bits(spark):
    k = [(3_000, 400_000), (4_000, 300_000), (120_000, 50_000)]
    counted = spark.createDataFrame([("address", "chars", x, n) for x, n in k], "field string, unit string, len int, k long")
    (r,) = R.length_summary(counted).collect()
    n, s, s2 = sum(c for _, c in k), sum(x * c for x, c in k), sum(x * x * c for x, c in k)
    assert s2 * n > 1 << 63
    assert (r.n, r.least, r.most, r.mean, r.p25, r.median, r.p75) == (n, 3_000, 120_000, round(s / n, 2), 3_000, 3_000, 4_000)
    assert r["std"] == round(math.sqrt((s2 * n - s * s) / (n * n)), 2)
