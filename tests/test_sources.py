"""Files are written, loaded and compared."""

import json
import sqlite3

import pytest

from stridewise.enums import TrajectoryUnit
from stridewise.errors import ArgumentValueError, LoadError, UnavailableError
from stridewise.sources import files


def rows(t):
    return sorted((r.id, r.frame, round(r.x, 9), round(r.y, 9)) for r in t.data.collect())


def test_text(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("﻿# framerate: 25.0 fps\n# ID FR x/cm y/cm z\n1 0 100 200 0\n\n1 1\t110 200 9 # remark\n2 0 -50 1e2 0\n")
    t = files.load_trajectory(path, spark=spark)
    assert t.frame_rate == 25.0 and rows(t) == [(1, 0, 1.0, 2.0), (1, 1, 1.1, 2.0), (2, 0, -0.5, 1.0)]
    with pytest.raises(ArgumentValueError, match="differs"):
        files.load_trajectory(path, default_frame_rate=10.0, spark=spark)
    with pytest.raises(ArgumentValueError, match="differs"):
        files.load_trajectory(path, default_unit=TrajectoryUnit.METER, spark=spark)


def test_text_errors(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("1 0 1 2\n")
    with pytest.raises(ArgumentValueError, match="frame rate"):
        files.load_trajectory(path, default_unit=TrajectoryUnit.METER, spark=spark)
    with pytest.raises(ArgumentValueError, match="unit"):
        files.load_trajectory(path, default_frame_rate=1.0, spark=spark)
    with pytest.raises(ArgumentValueError, match="positive"):
        files.load_trajectory(path, default_frame_rate=-1.0, default_unit=TrajectoryUnit.METER, spark=spark)
    path.write_text("1 0.5 1 2\n")
    with pytest.raises(ArgumentValueError, match="parse"):
        files.load_trajectory(path, 1.0, TrajectoryUnit.METER, spark=spark)
    with pytest.raises(LoadError, match="exist"):
        files.load_trajectory(tmp_path / "none", spark=spark)
    with pytest.raises(LoadError, match="not a file"):
        files.load_trajectory(tmp_path, spark=spark)


@pytest.mark.parametrize("version", [1, 2])
def test_sqlite(spark, tmp_path, version):
    path = tmp_path / "t.sqlite"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE trajectory_data (frame INT, id INT, pos_x REAL, pos_y REAL, ori_x REAL, ori_y REAL)")
        db.execute("CREATE TABLE metadata (key TEXT, value TEXT)")
        db.execute("CREATE TABLE geometry (hash INT, wkt TEXT)")
        db.executemany("INSERT INTO trajectory_data VALUES (?, ?, ?, ?, 0, 0)", [(f, i, f + 0.5, float(i)) for f in range(40) for i in (1, 2)])
        db.executemany("INSERT INTO metadata VALUES (?, ?)", [("version", str(version)), ("fps", "10")])
        db.executemany("INSERT INTO geometry VALUES (?, ?)", [(1, "POLYGON((0 0, 2 0, 2 2, 0 2))"), (2, "POLYGON((1 0, 3 0, 3 2, 1 2))")])
    t = files.load_trajectory_from_sqlite(path, spark=spark)
    assert t.frame_rate == 10 and rows(t)[:2] == [(1, 0, 0.5, 1.0), (1, 1, 1.5, 1.0)] and t.data.count() == 80
    assert files.load_walkable_area_from_sqlite(path).area == pytest.approx(4 if version == 1 else 6)
    with sqlite3.connect(path) as db:
        db.execute("DELETE FROM trajectory_data")
    with pytest.raises(LoadError):
        files.load_trajectory_from_sqlite(path, spark=spark)


def test_hdf5_needs_its_library(tmp_path):
    path = tmp_path / "t.h5"
    path.write_bytes(b"x")
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(UnavailableError):
            files.load_trajectory_from_hdf5(path)


def test_viswalk(spark, tmp_path):
    path = tmp_path / "t.pp"
    path.write_text("$VISION\n* made by hand\n$PEDESTRIAN:NO;SIMSEC;COORDCENTX;COORDCENTY;Z\n1;0.0;1.0;2.0;0\n1;0.1;1.5;2.0;0\n2;0.1;3.0;4.0;0\n2;0.2;3.0;5.0;0\n")
    t = files.load_trajectory_from_viswalk(path, spark=spark)
    assert t.frame_rate == 10 and rows(t) == [(1, 0, 1, 2), (1, 1, 1.5, 2), (2, 1, 3, 4), (2, 2, 3, 5)]
    path.write_text("$VISION\nNO;SIMSEC\n1;2\n")
    with pytest.raises(LoadError, match="COORDCENTX"):
        files.load_trajectory_from_viswalk(path, spark=spark)


def test_pathfinder(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,t,x,y,name\n,s,m,m,\n1,0.0,1,2,a\n1,0.5,2,2,a\n1,-1.0,9,9,a\n1,1e3,9,9,a\n")
    assert rows(files.load_trajectory_from_pathfinder_csv(path, spark=spark)) == [(1, 0, 1, 2), (1, 1, 2, 2)]
    path = tmp_path / "t.json"
    state = lambda x: {"position": {"x": x, "y": 1.0, "z": 0}}
    path.write_text(json.dumps({"2": {"0.0": state(1.0), "0.5": state(2.0), "1.0": 7}, "3": {"0.5": state(4.0), "1.0": {"speed": 1}}}, indent=1))
    t = files.load_trajectory_from_pathfinder_json(path, spark=spark)
    assert t.frame_rate == 2 and rows(t) == [(2, 0, 1, 1), (2, 1, 2, 1), (3, 1, 4, 1)]


def test_crowdit(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("pedID,time,posX,posY,extra\n1,0.0,1,2,a\n1,0.2,2,2,b\n2,0.2,3,3,\n")
    assert rows(files.load_trajectory_from_crowdit(path, spark=spark)) == [(1, 0, 1, 2), (1, 1, 2, 2)]
    path = tmp_path / "g.floor"
    wall = lambda *p: "<wall>" + "".join(f'<point x="{x}" y="{y}"/>' for x, y in p) + "</wall>"
    path.write_text(f"<floor><layer>{wall((0, 0), (2, 0), (2, 2), (0, 2))}</layer></floor>")
    assert files.load_walkable_area_from_crowdit(path).area == pytest.approx(4)
    path.write_text(f"<floor><layer>{wall((0, 0), (4, 0), (4, 1), (0, 1))}{wall((0, 3), (4, 3), (4, 4), (0, 4))}</layer></floor>")
    assert files.load_walkable_area_from_crowdit(path, buffer=0.5).area == pytest.approx(25 - 8)
    path.write_text("<floor/>")
    with pytest.raises(LoadError):
        files.load_walkable_area_from_crowdit(path)


def test_vadere(spark, tmp_path):
    path = tmp_path / "t.traj"
    path.write_text("#IDXCOL=2\npedestrianId simTime endTime-PID1 startX-PID1 startY-PID1\n1 0.25 1 0.0 0.0\n1 1.25 2 0.1 0.2\n2 0.5 1 1.0 1.0\n2 1.0 1 1.0 1.1\n")
    t = files.load_trajectory_from_vadere(path, 2.0, spark=spark)
    assert rows(t) == [(1, 1, 0.025, 0.05), (1, 2, 0.075, 0.15), (2, 1, 1.0, 1.0), (2, 2, 1.0, 1.1)]
    path.write_text("pedestrianId simTime startX-PID1 startY-PID1\n1 0.0 0 0\n1 1.0 1 1\n2 0.5 0 0\n")
    with pytest.raises(LoadError, match="too short"):
        files.load_trajectory_from_vadere(path, 2.0, spark=spark)
    assert rows(files.load_trajectory_from_vadere(path, 2.0, ignore_too_short_trajectories=True, spark=spark)) == [(1, 0, 0, 0), (1, 1, 0.5, 0.5), (1, 2, 1, 1)]
    path.write_text("pedestrianId simTime startX-PID1 startX-PID2 startY\n")
    with pytest.raises(LoadError, match="startX"):
        files.load_trajectory_from_vadere(path, 2.0, spark=spark)


def test_vadere_scenario(spark, tmp_path):
    path = tmp_path / "s.scenario"
    shape = {"type": "RECTANGLE", "x": 2.0, "y": 2.0, "width": 1.0, "height": 1.0}
    data = {"scenario": {"topography": {"attributes": {"bounds": {"x": 0.0, "y": 0.0, "width": 6.0, "height": 6.0}, "boundingBoxWidth": 0.5}, "obstacles": [{"id": 4, "shape": shape}]}}}
    path.write_text(json.dumps(data))
    assert files.load_walkable_area_from_vadere(path).area == pytest.approx(24)
    assert files.load_walkable_area_from_vadere(path, margin=0.1).area == pytest.approx(5.2**2 - 1)
    shape["x"] = 0.5
    path.write_text(json.dumps(data))
    with pytest.raises(LoadError, match="4"):
        files.load_walkable_area_from_vadere(path)


def test_header_behind_many_comments(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("".join(f"# remark {i}\n" for i in range(1500)) + "# framerate: 8\n# ID FR x/m y/m\n1 0 1 2\n")
    assert files.load_trajectory(path, spark=spark).frame_rate == 8.0


@pytest.mark.parametrize("split", [61, 200, 1 << 20])
def test_one_json_document_in_many_tasks(spark, tmp_path, split):
    from stridewise.sources import nested

    odd = {'a"b}{': {"0": {"note": '}}{{ \\ " }'}}, "x\\\\": {"1": {}}}
    whole = {str(i): {str(k / 10): {"position": {"x": i + k / 10, "y": -k}, "note": '{"}' * (k % 3)} for k in range(1 + i % 5)} for i in range(40)} | odd | {"99": {}}
    for indent in (None, 2):
        path = tmp_path / f"d{split}{indent}.json"
        path.write_text("\ufeff" * (indent is None) + json.dumps(whole, indent=indent, ensure_ascii=False) + "\n", encoding="utf-8")
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        found = nested.members(spark, str(path))
        values = [r.value for r in found.collect()]
        tasks = spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions()
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
        got = {}
        for value in values:
            one = json.loads(value)
            assert len(one) == 1 and not set(one) & set(got)
            got |= one
        assert got == whole and (split > 1000 or tasks > 3)
    track = files.load_trajectory_from_pathfinder_json(path, spark=spark)
    assert track.data.count() == sum(len(v) for k, v in whole.items() if k.isdigit())
