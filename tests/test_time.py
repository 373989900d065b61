from datetime import datetime

import pytest

from rasterloom import errors
from rasterloom.functions import arrays, reducers
from rasterloom.operators import pixels, temporal

DAYS = {"2024-01-01": {"a": [[1, None], [3, 4]]}, "2024-01-02": {"a": [[5, 6], [None, 8]]}, "2024-01-03": {"a": [[9, 2], [7, None]]}}


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("max", [[9, 6], [7, 8]]), ("min", [[1, 2], [3, 4]]), ("mean", [[5, 4], [5, 6]]), ("median", [[5, 4], [5, 6]]), ("count", [[3, 2], [2, 2]]),
        ("first", [[1, None], [3, 4]]), ("last", [[9, 2], [7, None]]), ("firstpixel", [[1, 6], [3, 4]]), ("variance", [[16, 8], [8, 8]]),
    ],
)
def test_reducers(make, image, name, expected):
    out = temporal.reduce_dimension(make(DAYS), lambda s, _: reducers.PROCESSES[name](s), "time")
    assert image(out)["a"] == expected
    assert not out.has_t


def test_strict_reducer(make, image):
    out = temporal.reduce_dimension(make(DAYS), lambda s, _: reducers.max_(s, ignore_nodata=False), "t")
    assert image(out)["a"] == [[9, None], [None, None]]
    with pytest.raises(errors.ProcessParameterInvalid):
        temporal.reduce_dimension(make(DAYS), lambda s, _: reducers.max_(s, ignore_nodata=1), "t")


def test_half_open_extent(make):
    c = make(DAYS)
    assert temporal.filter_temporal(c, ["2024-01-01", "2024-01-03"]).labels() == [datetime(2024, 1, 1), datetime(2024, 1, 2)]
    assert temporal.filter_temporal(c, [None, "2024-01-02T01:00:00+01:00"]).labels() == [datetime(2024, 1, 1)]
    assert temporal.filter_temporal(c, ["2030", None]).labels() == []
    with pytest.raises(errors.TemporalExtentEmpty):
        temporal.filter_temporal(c, ["2024-01-02", "2024-01-02"])
    with pytest.raises(errors.ProcessParameterInvalid):
        temporal.filter_temporal(c, [None, None])
    with pytest.raises(errors.DimensionNotAvailable):
        temporal.filter_temporal(c, ["2024", None], "depth")


def test_intervals_overlap_and_empty(make, image):
    out = temporal.aggregate_temporal(make(DAYS), [["2024-01-01", "2024-01-03"], ["2024-01-02", None], ["2023-01-01", "2023-02-01"]], lambda s, _: reducers.max_(s))
    assert image(out, "2024-01-01")["a"] == [[5, 6], [3, 8]]
    assert image(out, "2024-01-02")["a"] == [[9, 6], [7, 8]]
    assert image(out, "2023-01-01")["a"] == [[None, None], [None, None]]


def test_interval_labels():
    two = [["2024-01-01", "2024-01-02"], ["2024-01-02", "2024-01-03"]]
    assert temporal.interval_labels(two, ["a", "b"]) == [datetime(1970, 1, 1), datetime(1970, 1, 2)]
    assert temporal.interval_labels(two, [10, "2020"]) == [datetime(1970, 1, 11), datetime(2020, 1, 1)]
    with pytest.raises(errors.DistinctDimensionLabelsRequired):
        temporal.interval_labels([two[0], two[0]], None)
    with pytest.raises(errors.LabelMismatch):
        temporal.interval_labels(two, ["a"])


def test_pixel_selection_keeps_whole_pixels(make, image):
    c = make({"2024-01-01": {"a": [[1, 2]], "q": [[3, None]]}, "2024-01-02": {"a": [[10, 20]], "q": [[3, 5]]}, "2024-01-03": {"a": [[100, 200]], "q": [[1, 9]]}})
    assert image(temporal.apply_pixel_selection(c, "lastbandlow")) == {"a": [[100, 20]], "q": [[1, 5]]}
    assert image(temporal.apply_pixel_selection(c, "lastbandhight")) == {"a": [[1, 200]], "q": [[3, 9]]}
    with pytest.raises(errors.ProcessParameterInvalid):
        temporal.apply_pixel_selection(c, "best")


def test_along_time(make, image):
    out = pixels.apply_dimension(make(DAYS), lambda d, _: arrays.array_apply(d, lambda v, i: v + i), "t")
    assert image(out, "2024-01-03")["a"] == [[11, 4], [9, None]]
    folded = pixels.apply_dimension(make(DAYS), lambda d, _: d, "t", target_dimension="bands")
    assert folded.bands == ("2024-01-01T00:00:00", "2024-01-02T00:00:00", "2024-01-03T00:00:00")
    assert image(folded)["2024-01-02T00:00:00"] == [[5, 6], [None, 8]]
    with pytest.raises(Exception, match="number of values"):
        image(pixels.apply_dimension(make(DAYS), lambda d, _: arrays.array_create([1.0]), "t"), "2024-01-01")


def test_unknown_dimension(make):
    with pytest.raises(errors.DimensionNotAvailable):
        temporal.reduce_dimension(make(DAYS), lambda s, _: reducers.max_(s), "x")
