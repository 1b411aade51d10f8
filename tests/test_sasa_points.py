"""q51 against the operator's own number of sphere points."""

from __future__ import annotations

from compare import SF
from pyspark.sql import functions as F

from corvane.functions import geom
from corvane.operators import kernels
from corvane.plans.catalogue import QUERIES
from corvane.plans.registry import conformers


def test_sasa_uses_the_default_points(spark):
    flags = F.array(*(F.lit(k % 3 == 0) for k in range(21)))
    rows = conformers(spark, SF).select("vec_id", geom.scale(F.col("xyz"), 10.0).alias("xyz"), F.array_repeat(F.lit(1.7), 21).alias("radii"), flags.alias("polar"))
    want = {r.vec_id: (round(r.area, 3), round(r.polar_area, 3)) for r in kernels.polar_surface(rows, "vec_id", n=960).collect()}
    got = {r.vec_id: (round(r.area, 3), round(r.polar_area, 3)) for r in QUERIES["q51_sasa"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(x - y) < 0.01 for k in got for x, y in zip(got[k], want[k], strict=True))
