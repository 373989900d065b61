import numpy as np
import pytest

from rasterloom.errors import ProcessParameterInvalid
from rasterloom.operators import imagery
from rasterloom.operators.imagery import gradients


@pytest.mark.parametrize("block", [3, 4, 128])
def test_gradients_of_blocks_are_those_of_the_whole(make, monkeypatch, block):
    monkeypatch.setattr(imagery, "BLOCK", block)
    rng = np.random.default_rng(0)
    z = rng.normal(size=(9, 8))
    z[4, 5] = np.nan
    values = [[None if np.isnan(v) else float(v) for v in row] for row in z]
    cube = make({"2024-01-01": {"b1": values}, "2024-01-02": {"b1": [[float(10 * y + x) for x in range(8)] for y in range(9)]}})
    got = gradients(cube, cube.band("b1")).collect()
    assert len(got) == 2 * 72
    down, right = np.gradient(z)
    for r in got:
        want = (down[r["y"], r["x"]], right[r["y"], r["x"]]) if r["t"].day == 1 else (10.0, 1.0)
        assert [r["_r"], r["_c"]] == [None if np.isnan(w) else pytest.approx(w, abs=1e-12) for w in want]


def test_one_row_has_no_gradient(make):
    cube = make({"2024-01-01": {"b1": [[1.0, 2.0]]}})
    with pytest.raises(ProcessParameterInvalid):
        gradients(cube, cube.band("b1"))
