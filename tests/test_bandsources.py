from datetime import datetime

import numpy as np
import pytest

from rasterloom.cube import Grid
from rasterloom.plans.graph import bind, execute
from rasterloom.plans.requirements import requirements, with_requirements
from rasterloom.sources.bandsources import ASSETS, SENTINEL_1, BandSource, Radar, derived_bands, offered, read_hrefs, stac_assets
from rasterloom.sources.catalog import load_collection
from tests.test_annotation import calibration_xml, grid, noise_xml, RANGE, SIGMA  # noqa: I001

NOISE = BandSource("my-collection", "noise-(?P<pol>[a-z]{2})", (("{pol}_noise_lut", "noise"),))


@pytest.mark.parametrize(
    ("row", "rules", "want"),
    [
        (("my-collection", "noise-vv", "application/xml", ["metadata"]), (NOISE,), ["vv_noise_lut"]),
        (("my-collection-v2", "noise-vv", "application/xml", ["x", "metadata"]), (NOISE,), ["vv_noise_lut"]),
        (("my-collection", "noise-vv", "application/json", ["metadata"]), (NOISE,), []),
        (("my-collection", "noise-vv", "application/xml", ["data"]), (NOISE,), []),
        (("my-collection", "noise-vv", "application/xml", None), (NOISE,), []),
        (("my-collection", "noise-vv-extra", "application/xml", ["metadata"]), (NOISE,), []),
        (("other", "noise-vv", "application/xml", ["metadata"]), (NOISE,), []),
        (("sentinel-1-grd", "schema-calibration-vh", "application/xml", ["metadata"]), SENTINEL_1, ["vh_beta0_lut", "vh_dn_lut", "vh_ellipsoid_incidence_angle", "vh_gamma0_lut", "vh_sigma0_lut"]),
        (("sentinel-1-grd", "schema-product-vh", "application/xml", ["metadata"]), SENTINEL_1, []),
    ],
)
def test_rules(spark, row, rules, want):
    collection, asset, media, roles = row
    assert derived_bands(spark.createDataFrame([("i", collection, asset, media, roles, "h")], ASSETS), rules) == want


def test_siblings_and_doubles(spark):
    rows = [("i", "sentinel-1-grd", f"schema-noise-{p}", "application/xml", ["metadata"], f"{p}.xml") for p in ("vv", "vh")]
    got = {r["band"]: r for r in offered(spark.createDataFrame(rows + rows[:1], ASSETS)).collect()}
    assert set(got) == {"vv_noise_lut", "vh_noise_lut"} and got["vh_noise_lut"]["sibling"] == "vh" and got["vh_noise_lut"]["href"] == "vh.xml"
    assert offered(spark.createDataFrame([], ASSETS)).count() == 0


def graph(**arguments):
    return {
        "load": {"process_id": "load_collection", "arguments": {"id": "s1", "bands": ["vv"], "temporal_extent": ["2024-01-01", "2024-01-03"]}},
        "other": {"process_id": "load_collection", "arguments": {"id": "s1", "bands": ["vv"]}},
        "sar": {"process_id": "sar_backscatter", "arguments": {"data": {"from_node": "load"}, "coefficient": "sigma0-ellipsoid", **arguments}},
        "twice": {"process_id": "apply", "arguments": {"data": {"from_node": "sar"}, "process": {"process_graph": {"m": {"process_id": "multiply", "arguments": {"x": {"from_parameter": "x"}, "y": 2}, "result": True}}}}, "result": True},
    }


def test_needs_reach_only_what_feeds_a_process():
    assert requirements(graph()) == {"load": {"vv_sigma0_lut", "vv_noise_lut"}}
    assert requirements(graph(noise_removal=False, ellipsoid_incidence_angle=True)) == {"load": {"vv_sigma0_lut", "vv_ellipsoid_incidence_angle"}}
    g = graph()
    g["load"]["arguments"]["bands"] = ["vv", "vv_sigma0_lut", "vv_noise_lut"]
    assert requirements(g) == {} and with_requirements(g) is g
    g["load"]["arguments"]["bands"] = {"from_parameter": "bands"}
    assert requirements(g) == {} and requirements(g, {"bands": ["vh"]}) == {"load": {"vh_sigma0_lut", "vh_noise_lut"}}
    planned = with_requirements(g, {"bands": ["vh"]})
    assert planned["load"]["arguments"]["bands"] == ["vh", "vh_noise_lut", "vh_sigma0_lut"] and planned["other"] is g["other"]
    g["sar"]["arguments"]["coefficient"] = None
    assert requirements(g, {"bands": ["vh"]}) == {"load": {"vh_noise_lut"}}
    assert requirements({"load": graph()["load"]}) == {}
    extra = {"apply": lambda own, loading: {"dem"}}
    assert requirements(graph(), needs=extra) == {"load": {"dem"}}


def radar(spark, tmp_path):
    """Two images of 6 by 6, side by side on the map, with annotations in files that item documents name."""
    import json

    names = {"a": (0.0, datetime(2024, 1, 1)), "b": (4.0, datetime(2024, 1, 1)), "c": (1.0, datetime(2024, 1, 2))}
    for k in names:
        (tmp_path / k).mkdir()
        (tmp_path / k / "cal.xml").write_text(calibration_xml())
        (tmp_path / k / "noise.xml").write_text(noise_xml(k != "b"))
        entry = lambda f: {"href": f"./{f}", "type": "application/xml", "roles": ["metadata"]}
        item = {"type": "Feature", "id": k, "collection": "sentinel-1-grd", "assets": {"schema-calibration-vv": entry("cal.xml"), "schema-noise-vv": entry("noise.xml"), "vv": {"href": "vv.tif", "type": "image/tiff", "roles": ["data"]}}}
        (tmp_path / k / "item.json").write_text(json.dumps(item))
    items = spark.createDataFrame([(k, "sentinel-1-grd", when, west, 0.0, west + 6, 6.0, {}) for k, (west, when) in names.items()], "id string, collection string, datetime timestamp_ntz, west double, south double, east double, north double, properties map<string,string>")
    points = [(k, line, pixel, west + pixel, 6.0 - line) for k, (west, _) in names.items() for line in (0.0, 3.0, 6.0) for pixel in (0.0, 3.0, 6.0)]
    pixels = [(k, i, j, 0 if (i, j) == (2, 2) else 40 + 10 * i + j) for k in names for i in range(6) for j in range(6)]
    r = Radar(
        spark.createDataFrame(pixels, "item_id string, line int, pixel int, vv int"), spark.createDataFrame(points, "item_id string, line double, pixel double, x double, y double"),
        stac_assets(spark, str(tmp_path)), read_hrefs(spark, str(tmp_path)),
    )
    return r.collection("s1", items, Grid(10, 6, (0.0, 0.0, 10.0, 6.0)), ["vv"])


def test_a_graph_names_backscatter_only(spark, tmp_path):
    s1 = radar(spark, tmp_path)
    assert {"vv", "vv_noise_lut", "vv_sigma0_lut", "vv_ellipsoid_incidence_angle"} <= set(s1.bands)
    g = {n: v for n, v in graph().items() if n != "other"}
    g["load"]["arguments"]["spatial_extent"] = {"west": 0, "south": 0, "east": 10, "north": 6}
    cube = execute(g, loaders={"load_collection": bind(load_collection, {"s1": s1})})
    assert cube.bands == ("vv",)
    got = {(r["t"].day, r["y"], r["x"]): r["vv"] for r in cube.df.collect()}
    assert len(got) == 2 * 60
    for (day, y, x), v in got.items():
        want = None
        for k, west in (("a", 0), ("b", 4)) if day == 1 else (("c", 1),):
            line, pixel = y + 0.5, x - west + 0.5
            if want is None and 0 < pixel < 6 and (int(line), int(pixel)) != (2, 2):
                noise = grid(RANGE, line, pixel) * (np.interp(line, [0, 12], [1, 2]) if k != "b" else 1)
                want = 2 * max((40 + 10 * int(line) + int(pixel)) ** 2 - noise, 0) / grid(SIGMA, line, pixel) ** 2
        assert v == (None if want is None else pytest.approx(want, rel=1e-9)), (day, y, x)


def test_angle_and_missing_documents(spark, tmp_path):
    s1 = radar(spark, tmp_path)
    out = load_collection(s1, bands=["vv_ellipsoid_incidence_angle"]).df.collect()
    # the constants of both coefficients are equal in these documents: their ratio is 1, the angle 0
    assert {r["vv_ellipsoid_incidence_angle"] for r in out} == {0.0, None}
    assert sum(r["vv_ellipsoid_incidence_angle"] is None for r in out) > 20
