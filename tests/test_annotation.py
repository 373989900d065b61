import numpy as np
import pytest

from rasterloom import errors
from rasterloom.operators.imagery import sar_backscatter
from rasterloom.sources import annotation

LINES, PIXELS = [0, 10, 25], [0, 4, 8, 15]
SIGMA = [[300.0 + 7 * i + k * k for k in range(4)] for i in range(3)]
RANGE = [[50.0 + i + 2 * k for k in range(4)] for i in range(3)]


def joined(values):
    return " ".join(map(str, values))


def calibration_xml(own=None):
    out = []
    for i, line in enumerate(LINES):
        px, v = (own[i] if own else (PIXELS, SIGMA[i]))
        numbers = "".join(f'<{n} count="{len(px)}">{joined(v)}</{n}>' for n in ("sigmaNought", "betaNought", "gamma", "dn"))
        out.append(f'<calibrationVector><azimuthTime>2020-01-01T00:00:00</azimuthTime><line>{line}</line><pixel count="{len(px)}">{joined(px)}</pixel>{numbers}</calibrationVector>')
    return f'<calibration><calibrationInformation><absoluteCalibrationConstant>1.0</absoluteCalibrationConstant></calibrationInformation><calibrationVectorList count="3">{"".join(out)}</calibrationVectorList></calibration>'


def noise_xml(modern):
    name, value = ("noiseRangeVector", "noiseRangeLut") if modern else ("noiseVector", "noiseLut")
    rows = "".join(f"<{name}><line>{line}</line><pixel>{joined(PIXELS)}</pixel><{value}>{joined(RANGE[i])}</{value}></{name}>" for i, line in enumerate(LINES))
    blocks = ""
    for first, last, left, right, factors in ((0, 12, 0, 7, (1.0, 2.0)), (13, 25, 0, 15, (3.0, 4.0))):
        blocks += f"<noiseAzimuthVector><swath>A</swath><firstAzimuthLine>{first}</firstAzimuthLine><firstRangeSample>{left}</firstRangeSample><lastAzimuthLine>{last}</lastAzimuthLine><lastRangeSample>{right}</lastRangeSample><line count=\"2\">{first} {last}</line><noiseAzimuthLut count=\"2\">{joined(factors)}</noiseAzimuthLut></noiseAzimuthVector>"
    extra = f"<noiseAzimuthVectorList>{blocks}</noiseAzimuthVectorList>" if modern else ""
    return f"<noise><{name}List>{rows}</{name}List>{extra}</noise>"


def documents(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def grid(values, line, pixel):
    rows = np.array([np.interp(pixel, PIXELS, v) for v in values])
    return float(np.interp(line, LINES, rows))


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(float(a), float(b)) for a in (0, 3, 10, 17, 25, 40) for b in (0, 2, 4, 9, 15, 30)], "line double, pixel double")


def test_calibration(spark, points):
    out = annotation.evaluate(points, annotation.calibration(documents(spark, calibration_xml()), "sigma0_lut"), "v").collect()
    assert len(out) == 36
    for r in out:
        assert abs(r["v"] - grid(SIGMA, r["line"], r["pixel"])) < 1e-9


def test_vectors_of_other_nodes_are_brought_to_the_first_ones(spark, points):
    own = [(PIXELS, SIGMA[0]), ([0, 15], [1.0, 16.0]), (PIXELS, SIGMA[2])]
    out = annotation.evaluate(points, annotation.calibration(documents(spark, calibration_xml(own)), "gamma0_lut"), "v").collect()
    for r in out:
        assert abs(r["v"] - grid([SIGMA[0], [p + 1.0 for p in PIXELS], SIGMA[2]], r["line"], r["pixel"])) < 1e-9


@pytest.mark.parametrize("modern", [True, False])
def test_noise_of_both_generations(spark, points, modern):
    for r in annotation.noise_of(points, documents(spark, noise_xml(modern)), "n").collect():
        want = grid(RANGE, r["line"], r["pixel"])
        if modern and r["line"] <= 12 and r["pixel"] <= 7:
            want *= np.interp(r["line"], [0, 12], [1, 2])
        elif modern and 13 <= r["line"] <= 25 and r["pixel"] <= 15:
            want *= np.interp(r["line"], [13, 25], [3, 4])
        assert abs(r["n"] - want) < 1e-9


def test_chain_from_documents_to_backscatter(spark, make, tmp_path):
    (tmp_path / "cal.xml").write_text(calibration_xml())
    (tmp_path / "noise.xml").write_text(noise_xml(True))
    cube = make({"2024-01-01": {"vv": [[10.0 * (y + 1) + x for x in range(5)] for y in range(4)]}})
    read = lambda n: annotation.read_documents(spark, str(tmp_path / n))
    out = sar_backscatter(annotation.with_annotations(cube, {"vv": read("cal.xml")}, {"vv": read("noise.xml")}), "sigma0-ellipsoid")
    for r in out.df.collect():
        y, x = r["y"], r["x"]
        noise = grid(RANGE, y, x) * np.interp(y, [0, 12], [1, 2])
        want = max((10.0 * (y + 1) + x) ** 2 - noise, 0) / grid(SIGMA, y, x) ** 2
        assert abs(r["vv"] - want) < 1e-12
    with pytest.raises(errors.ProcessParameterInvalid):
        annotation.evaluate(cube.df, annotation.calibration(documents(spark, "<calibration/>"), "sigma0_lut"), "v", "y", "x")
