import numpy as np

from tidemill.llm import sketch
from tidemill.llm.textvec import U, mix


def test_keys_that_occur_twice_are_held(spark, monkeypatch):
    monkeypatch.setattr(sketch, "FAN_IN", 2)  # several rounds of merging

    def keys_of(values):
        yield mix(values.to_numpy().astype(U))

    rows = [(i,) for i in range(20_000)] + [(i,) for i in range(0, 20_000, 7)]
    found = sketch.shared_places(spark.createDataFrame(rows, "v long").repartition(9), keys_of)
    held = found.held(mix(np.arange(20_000).astype(U)))
    assert held[::7].all() and held.mean() < 1 / 7 + 0.01
    none = sketch.shared_places(spark.createDataFrame([], "v long"), keys_of)
    assert not none.held(mix(np.arange(10).astype(U))).any()
