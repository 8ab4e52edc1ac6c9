"""The scale of a panel from counts alone, against the sorted values."""

from __future__ import annotations

import random

from stratanet.operators.panel import detect_scale


def percentile(sizes, q):
    sizes = sorted(sizes)
    place = (len(sizes) - 1) * q
    low = int(place)
    high = min(low + 1, len(sizes) - 1)
    return (low + 1 - place) * sizes[low] + (place - low) * sizes[high]


def test_scale_equals_that_of_the_sorted_values(spark):
    rng = random.Random(1)
    panels = [[0.4] * 9 + [2.0], [0.4] * 9 + [1.0] * 2, [0.5] * 5, [0.51], [0.1], [-3.0, 0.2], [0.5, 0.5000001], [0.2] * 10 + [0.6]]
    panels += [[rng.choice([-1, 1]) * rng.choice([0.1, 0.3, 0.5, 0.6, 0.9, 4.0]) for _ in range(rng.randint(1, 25))] for _ in range(40)]
    rows = [(k, v) for k, values in enumerate(panels) for v in [*values, None]]
    table = spark.createDataFrame(rows, "k int, rate double").cache()
    for k, values in enumerate(panels):
        want = 0.01 if percentile(map(abs, values), 0.9) > 0.5 else 1.0
        assert detect_scale(table.where(f"k = {k}")).first()[0] == want, values
    assert detect_scale(table.where("k < 0")).first()[0] == 1.0
