import numpy as np
import pandas as pd

from rasterloom.operators import kmeans
from rasterloom.plans import codecs


def _image(w=128, h=96):
    r, pos = np.random.default_rng(2), np.arange(w * h)
    rgb = r.integers(0, 256, (w * h, 3))
    return pd.DataFrame({"img_id": 0, "pos": pos, "x": pos % w, "y": pos // w, "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2]})


def test_ends_at_a_fixed_point_in_five_dimensions():
    x = _image()[kmeans.PLACE].to_numpy(np.int64)
    one = np.ones(len(x))
    assert not kmeans.lloyd(x, one, 16, 50)[3]
    own, d2, c, ok = kmeans.lloyd(x, one, 16)
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    assert ok and (d[np.arange(len(x)), own] == d.min(1)).all()


def test_codecs_run_to_the_end_and_say_so(spark):
    px = spark.createDataFrame(_image(), codecs.PIXELS)
    whole, cut = codecs.Voronoi(16).encode(px).first(), codecs.Voronoi(16, 2).encode(px).first()
    assert (whole.converged, cut.converged) == (True, False) and whole.encoded != cut.encoded
    assert codecs.ClusterColours(4).encode(px).first().converged
    assert not codecs.ClusterColours(4, 1).encode(px).first().converged
