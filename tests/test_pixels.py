import numpy as np
from pyspark.sql import functions as F

from neumes.functions import pixels


def test_operations(spark):
    x = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    rows = spark.createDataFrame([((3, 4, bytearray(x.tobytes())),), (None,)], f"i {pixels.IMAGE}")

    def out(column):
        got = [r.y for r in rows.select(column.alias("y")).collect()]
        assert got[1] is None
        return pixels.unpacked(got[0].asDict())

    i, n = F.col("i"), F.lit
    assert (out(pixels.inverted(i)) == 255 - x).all()
    assert (out(pixels.brightened(i, n(50))) == np.minimum(x.astype(int) + 50, 255)).all()
    assert (out(pixels.contrasted(i, n(1.0))) == x).all()
    assert out(pixels.eroded(i))[1, 1] == x[:3, :3].min() and out(pixels.dilated(i))[1, 1] == x[:3, :3].max()
    assert (out(pixels.cropped(i, n(1), n(9))) == x[1:]).all()
    big = out(pixels.padded(i, n(5), n(4)))
    assert big.shape == (5, 4) and (big[3:] == 255).all()
    assert (out(pixels.resized(i, n(3), n(4))) == x).all() and out(pixels.resized(i, n(6), n(2))).shape == (6, 2)
    both = rows.where("i IS NOT NULL").select(pixels.stacked(F.array("i", pixels.cropped(F.col("i"), n(0), n(1)))).alias("y")).first().y
    assert (both.height, both.width) == (4, 4)
