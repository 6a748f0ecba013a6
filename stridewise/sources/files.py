"""Trajectories and areas from files of experiments and simulations.

Text, CSV, JSON and XML files are found and read through Spark's file systems,
so they can lie in any store that Spark reads; a folder that Spark has written
counts as a file. SQLite and HDF5 files are opened by their own libraries, on
paths that all machines see.
"""

from __future__ import annotations

import json
import logging
import os
import sqlite3
import xml.etree.ElementTree as ElementTree
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stridewise.enums import TrajectoryUnit
from stridewise.errors import ArgumentValueError, LoadError, UnavailableError
from stridewise.geometry import shapes
from stridewise.geometry.shapes import Polygon
from stridewise.model import TrajectoryData, WalkableArea
from stridewise.sources.nested import members

_log = logging.getLogger(__name__)
#: Lines that a header is looked for in first.
HEADER_LINES = 200
_MARK = "\ufeff"


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.builder.getOrCreate()


def locate(path: str | os.PathLike, spark: SparkSession) -> str:
    """The path of an existing file, as Spark takes it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(os.fspath(path))
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        raise LoadError(f"{path} does not exist")
    if store.getFileStatus(at).isDirectory() and not store.exists(jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")):
        raise LoadError(f"{path} is not a file")
    return os.fspath(path)


def check_file(path: str | os.PathLike) -> Path:
    """The path of an existing file that this machine opens itself."""
    path = Path(path)
    if not path.exists():
        raise LoadError(f"{path} does not exist")
    if not path.is_file():
        raise LoadError(f"{path} is not a file")
    return path


def _head(spark: SparkSession, path: str) -> list[str]:
    """The first lines, without a byte order mark; as many as it takes to see one that is no comment."""
    many = HEADER_LINES
    while True:
        lines = [r.value.removeprefix(_MARK) for r in spark.read.text(path).take(many)]
        if len(lines) < many or any(line.strip() and line.strip()[0] not in "#*" for line in lines[1:]):
            return lines
        many *= 4


def _text(spark: SparkSession, path: str) -> str:
    """A small file as a whole."""
    return spark.read.text(path, wholetext=True).first().value.removeprefix(_MARK)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines without a byte order mark."""
    return spark.read.text(path).select(F.ltrim("value", F.lit(_MARK)).alias("value")).where(F.trim("value") != "")


def _whole(columns: DataFrame, names: list[str], what: str) -> DataFrame:
    """The rows, after a look that none failed to parse and that there is one."""
    broken = F.lit(False)
    for name in names:
        broken = broken | F.col(name).isNull()
    row = columns.agg(F.count("*").alias("n"), F.count_if(broken).alias("broken")).first()
    if not row.n:
        raise LoadError(f"{what} is empty or incorrect")
    if row.broken:
        raise LoadError(f"{what} has {row.broken} rows that do not parse")
    return columns


def frame_rate_of(times: DataFrame) -> float:
    """Frames per second: the inverse of the mean step in time of a pedestrian, rounded half to even."""
    step = F.col("time") - F.lag("time").over(Window.partitionBy("id").orderBy("time"))
    mean = times.select(step.alias("step")).agg(F.avg("step").alias("mean")).first().mean
    if not mean:
        raise LoadError("the frame rate cannot be told: no pedestrian has two frames")
    return float(round(1 / mean))


def _timed(times: DataFrame) -> TrajectoryData:
    """id, time, x, y as a trajectory; frames are rounded half to even."""
    rate = frame_rate_of(times)
    return TrajectoryData(times.select("id", F.bround(F.col("time") * F.lit(rate)).cast("long").alias("frame"), "x", "y"), rate)


# ---------------------------------------------------------------- text archives


def text_header(lines: list[str], path: str, default_frame_rate: float | None, default_unit: TrajectoryUnit | None) -> tuple[float, TrajectoryUnit]:
    """Frame rate and unit from the leading comment lines, held against the defaults."""
    rate = unit = None
    for line in lines:
        if not line.startswith("#"):
            break
        low = line.lower()
        if "framerate" in line and rate is None:
            for word in line.split():
                try:
                    rate = float(word)
                    break
                except ValueError:
                    continue
        if "x/cm" in low or "in cm" in low:
            unit = TrajectoryUnit.CENTIMETER
        if "x/m" in low or "in m" in low:
            unit = TrajectoryUnit.METER
    found = []
    for name, own, default in (("frame rate", rate, default_frame_rate), ("unit", unit, default_unit)):
        if own is None and default is None:
            raise ArgumentValueError(f"{path} names no {name}; give a default")
        if own is not None and default is not None and own != default:
            raise ArgumentValueError(f"the default {name} differs from that of {path}: {default} != {own}")
        found.append(default if own is None else own)
    if found[0] <= 0:
        raise ArgumentValueError(f"the frame rate must be positive, not {found[0]}")
    return found[0], found[1]


def load_trajectory_from_txt(trajectory_file, default_frame_rate: float | None = None, default_unit: TrajectoryUnit | None = None, spark: SparkSession | None = None) -> TrajectoryData:
    """White-space separated id, frame, x, y (further columns are ignored); ``#`` starts a comment; centimetres become metres."""
    spark = _session(spark)
    path = locate(trajectory_file, spark)
    rate, unit = text_header(_head(spark, path), path, default_frame_rate, default_unit)
    text = F.trim(F.regexp_replace("value", "#.*", ""))
    parts = _lines(spark, path).select(F.split(text, r"\s+").alias("p")).where("p[0] != ''")
    cell = lambda i, kind: F.expr(f"try_cast(get(p, {i}) AS {kind})")
    scale = F.lit(float(unit.value))
    rows = parts.select(cell(0, "bigint").alias("id"), cell(1, "bigint").alias("frame"), (cell(2, "double") / scale).alias("x"), (cell(3, "double") / scale).alias("y"))
    try:
        return TrajectoryData(_whole(rows, ["id", "frame", "x", "y"], str(path)), rate)
    except LoadError as error:
        raise ArgumentValueError(str(error)) from error


load_trajectory = load_trajectory_from_txt


def write_trajectory_txt(traj_data: TrajectoryData, path: str) -> None:
    """Tab-separated text with a frame rate header, one file per partition."""
    header = f"#framerate: {traj_data.frame_rate}\n#ID\tFR\tX/m\tY/m"
    rows = traj_data.data.select(F.concat_ws("\t", "id", "frame", "x", "y").alias("value"))
    rows.mapInArrow(with_header(header), "value string").write.text(path)


def with_header(header: str):
    """mapInArrow of lines: each task's come behind the header."""
    import pyarrow as pa

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([header])], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    return run


# ---------------------------------------------------------------- HDF5 and SQLite


def _h5py():
    try:
        import h5py
    except ImportError as error:
        raise UnavailableError("HDF5 files need the library h5py") from error
    return h5py


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class Hdf5Reader(DataSourceReader):
    ROWS = 1_000_000

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        with _h5py().File(self.path) as file:
            n = file["trajectory"].shape[0]
        return [_Range(lo, min(n, lo + self.ROWS)) for lo in range(0, n, self.ROWS)] or [_Range(0, 0)]

    def read(self, partition):
        import pyarrow as pa

        with _h5py().File(self.path) as file:
            rows = file["trajectory"][partition.low : partition.high]
        kinds = {"i": "int64", "u": "int64", "f": "float64"}
        columns = {n: pa.array(rows[n].astype(kinds.get(rows.dtype[n].kind, str))) for n in rows.dtype.names}
        yield pa.RecordBatch.from_pydict(columns)


class Hdf5Source(DataSource):
    """Rows of the dataset ``trajectory`` of an HDF5 file that all machines see."""

    @classmethod
    def name(cls):
        return "trajectory_hdf5"

    def schema(self):
        kinds = {"i": "bigint", "u": "bigint", "f": "double"}
        with _h5py().File(self.options["path"]) as file:
            return ", ".join(f"`{n}` {kinds.get(t[0].kind, 'string')}" for n, t in file["trajectory"].dtype.fields.items())

    def reader(self, schema):
        return Hdf5Reader(self.options["path"])


def load_trajectory_from_hdf5(trajectory_file, spark: SparkSession | None = None) -> TrajectoryData:
    """Dataset ``trajectory`` with id, frame, x, y (all its columns are kept) and attribute fps."""
    path = check_file(trajectory_file)
    h5py = _h5py()
    with h5py.File(path) as file:
        if "trajectory" not in file:
            raise LoadError(f"{path} has no dataset 'trajectory'")
        names, attributes = file["trajectory"].dtype.names or (), dict(file["trajectory"].attrs)
    missing = [c for c in ("id", "frame", "x", "y") if c not in names]
    if missing or "fps" not in attributes:
        raise LoadError(f"{path}: the dataset lacks {missing or 'the attribute fps'}")
    session = _session(spark)
    session.dataSource.register(Hdf5Source)
    return TrajectoryData(session.read.format("trajectory_hdf5").load(str(path)), float(attributes["fps"]))


def load_walkable_area_from_hdf5(trajectory_file) -> WalkableArea:
    path = check_file(trajectory_file)
    with _h5py().File(path) as file:
        if "wkt_geometry" not in file.attrs:
            raise LoadError(f"{path} has no attribute 'wkt_geometry'")
        return WalkableArea(str(file.attrs["wkt_geometry"]))


class SqliteReader(DataSourceReader):
    """Ranges of row numbers, by which the file is ordered."""

    ROWS = 1_000_000

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute("SELECT min(rowid), max(rowid) FROM trajectory_data").fetchone()
        if low is None:
            return [_Range(0, 0)]
        return [_Range(at, min(high + 1, at + self.ROWS)) for at in range(low, high + 1, self.ROWS)]

    def read(self, partition):
        import pyarrow as pa

        kinds = {"id": pa.int64(), "frame": pa.int64(), "x": pa.float64(), "y": pa.float64()}
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            rows = db.execute("SELECT id, frame, pos_x, pos_y FROM trajectory_data WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))
            while some := rows.fetchmany(50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds.values(), strict=True)], names=list(kinds))


class SqliteSource(DataSource):
    """Positions of a simulator's SQLite file that all machines see, a range of rows per task."""

    @classmethod
    def name(cls):
        return "trajectory_sqlite"

    def schema(self):
        return "id bigint, frame bigint, x double, y double"

    def reader(self, schema):
        return SqliteReader(self.options["path"])


def _sqlite(path: Path, query: str) -> list[tuple]:
    try:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            return db.execute(query).fetchall()
    except sqlite3.DatabaseError as error:
        raise LoadError(f"{path} is not a trajectory database: {error}") from error


def load_trajectory_from_sqlite(trajectory_file, spark: SparkSession | None = None) -> TrajectoryData:
    path = check_file(trajectory_file)
    if not _sqlite(path, "SELECT count(*) FROM trajectory_data")[0][0]:
        raise LoadError(f"{path} has no positions")
    rate = _sqlite(path, "SELECT value FROM metadata WHERE key = 'fps'")
    if not rate:
        raise LoadError(f"{path} names no fps")
    session = _session(spark)
    session.dataSource.register(SqliteSource)
    return TrajectoryData(session.read.format("trajectory_sqlite").load(str(path.resolve())), float(rate[0][0]))


def load_walkable_area_from_sqlite(trajectory_file) -> WalkableArea:
    """Version 1: the first geometry; version 2: the union of all."""
    path = check_file(trajectory_file)
    version = _sqlite(path, "SELECT value FROM metadata WHERE key = 'version'")
    number = int(version[0][0]) if version else None
    wkts = [r[0] for r in _sqlite(path, "SELECT wkt FROM geometry")] if number in (1, 2) else []
    if number not in (1, 2):
        raise LoadError(f"{path}: database version {number} is not supported")
    if not wkts:
        raise LoadError(f"{path} has no geometry")
    parts = [p for w in (wkts[:1] if number == 1 else wkts) for p in shapes.polygons_of_wkt(w)]
    return WalkableArea(list(dict.fromkeys(parts)))


# ---------------------------------------------------------------- CSV and JSON of simulators


def load_trajectory_from_viswalk(trajectory_file, spark: SparkSession | None = None) -> TrajectoryData:
    """``;``-separated, a first line to skip, ``*`` starts a comment; NO, SIMSEC, COORDCENTX, COORDCENTY."""
    spark = _session(spark)
    path = locate(trajectory_file, spark)
    head = _head(spark, path)
    first = head[0].split("*")[0].strip() if head else ""
    header = next((t for line in head[1:] if (t := line.split("*")[0].strip())), "")
    names = [n.replace("$PEDESTRIAN:", "").strip() for n in header.split(";")]
    wanted = {"NO": ("id", "bigint"), "SIMSEC": ("time", "double"), "COORDCENTX": ("x", "double"), "COORDCENTY": ("y", "double")}
    missing = [n for n in wanted if n not in names]
    if missing:
        raise LoadError(f"{path} lacks the columns {', '.join(missing)}; it should be separated by ';'")
    lines = _lines(spark, path).select(F.trim(F.regexp_replace("value", r"\*.*", "")).alias("value"))
    cells = lines.where((F.col("value") != "") & (F.col("value") != F.lit(header)) & (F.col("value") != F.lit(first))).select(F.split("value", ";").alias("p"))
    rows = cells.select(*[F.expr(f"try_cast(trim(get(p, {names.index(n)})) AS {kind})").alias(to) for n, (to, kind) in wanted.items()])
    return _timed(_whole(rows, ["id", "time", "x", "y"], str(path)))


def load_trajectory_from_pathfinder_csv(trajectory_file, spark: SparkSession | None = None) -> TrajectoryData:
    """id, t, x, y; rows whose t is not plain digits with at most one dot (as the row of units) are left out."""
    spark = _session(spark)
    path = locate(trajectory_file, spark)
    data = spark.read.csv(path, header=True)
    data = data.toDF(*[c.strip().lstrip("﻿") for c in data.columns])
    missing = [c for c in ("id", "t", "x", "y") if c not in data.columns]
    if missing:
        raise LoadError(f"{path} lacks the columns {', '.join(missing)}")
    t = F.trim("t")
    data = data.where(t.rlike(r"^[0-9]*\.?[0-9]*$") & t.rlike("[0-9]"))
    rows = data.select(*[F.expr(f"try_cast(trim(`{n}`) AS {kind})").alias(to) for n, to, kind in (("id", "id", "bigint"), ("t", "time", "double"), ("x", "x", "double"), ("y", "y", "double"))])
    return _timed(_whole(rows, ["id", "time", "x", "y"], str(path)))


def load_trajectory_from_pathfinder_json(trajectory_file, spark: SparkSession | None = None) -> TrajectoryData:
    """{agent: {time: {position: {x, y}}}}; branches of another shape are left out. Many tasks read one document."""
    spark = _session(spark)
    path = locate(trajectory_file, spark)
    agents = members(spark, path).select(F.explode(F.from_json("value", "map<string,string>")).alias("agent", "times"))
    times = agents.select("agent", F.explode(F.from_json("times", "map<string,string>")).alias("time", "state"))
    point = F.from_json("state", "position struct<x:double,y:double>")
    rows = times.select(F.expr("try_cast(agent AS bigint)").alias("id"), F.expr("try_cast(time AS double)").alias("time"), point["position"]["x"].alias("x"), point["position"]["y"].alias("y"))
    rows = rows.where("id is not null and time is not null and x is not null and y is not null")
    return _timed(_whole(rows, ["id"], str(path)))


def load_trajectory_from_crowdit(trajectory_file, spark: SparkSession | None = None) -> TrajectoryData:
    """pedID, time, posX, posY; rows with an empty cell in any column are left out."""
    spark = _session(spark)
    path = locate(trajectory_file, spark)
    data = spark.read.csv(path, header=True)
    data = data.toDF(*[c.strip().lstrip("﻿") for c in data.columns])
    wanted = (("pedID", "id", "bigint"), ("time", "time", "double"), ("posX", "x", "double"), ("posY", "y", "double"))
    missing = [n for n, _, _ in wanted if n not in data.columns]
    if missing:
        raise LoadError(f"{path} lacks the columns {', '.join(missing)}")
    rows = data.dropna().select(*[F.expr(f"try_cast(trim(`{n}`) AS {kind})").alias(to) for n, to, kind in wanted])
    return _timed(_whole(rows, ["id", "time", "x", "y"], str(path)))


def load_walkable_area_from_crowdit(geometry_file, buffer: float = 1e-3, spark: SparkSession | None = None) -> WalkableArea:
    """One wall is the area; of several, the padded box around all without them."""
    spark = _session(spark)
    path = locate(geometry_file, spark)
    try:
        root = ElementTree.fromstring(_text(spark, path))
    except ElementTree.ParseError as error:
        raise LoadError(f"{path} does not parse: {error}") from error
    try:
        walls = [[(float(p.attrib["x"]), float(p.attrib["y"])) for p in wall.findall("point")] for layer in root.findall("layer") for wall in layer.findall("wall")]
    except KeyError as error:
        raise LoadError(f"{path} has a point without {error}") from error
    walls = [w for w in walls if w]
    if not walls:
        raise LoadError(f"{path} has no walls")
    if len(walls) == 1:
        return WalkableArea(walls[0])
    xs, ys = [x for w in walls for x, _ in w], [y for w in walls for _, y in w]
    low_x, high_x, low_y, high_y = min(xs) - buffer, max(xs) + buffer, min(ys) - buffer, max(ys) + buffer
    return WalkableArea([(low_x, low_y), (high_x, low_y), (high_x, high_y), (low_x, high_y)], walls)


# ---------------------------------------------------------------- event-driven simulations


def load_trajectory_from_vadere(trajectory_file, frame_rate: float, ignore_too_short_trajectories: bool = False, spark: SparkSession | None = None) -> TrajectoryData:
    """Space-separated events (pedestrianId, simTime, startX, startY, found by unique parts of column names), resampled to a constant rate."""
    spark = _session(spark)
    path = locate(trajectory_file, spark)
    header = next((t for line in _head(spark, path) if (t := line.split("#")[0].strip())), "")
    names = header.split(" ")
    places = {}
    for part, to in (("pedestrianId", "id"), ("simTime", "time"), ("startX", "x"), ("startY", "y")):
        found = [i for i, n in enumerate(names) if part in n]
        if len(found) != 1:
            raise LoadError(f"{path}: the identifier '{part}' is in {len(found)} columns, not in one")
        places[to] = found[0]
    lines = _lines(spark, path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("value")).where((F.col("value") != "") & (F.col("value") != F.lit(header)))
    cells = lines.select(F.split("value", " ").alias("p"))
    rows = cells.select(*[F.expr(f"try_cast(get(p, {i}) AS {'bigint' if to == 'id' else 'double'})").alias(to) for to, i in places.items()])
    rows = _whole(rows, ["id", "time", "x", "y"], str(path))
    return TrajectoryData(resampled(rows, frame_rate, ignore_too_short_trajectories), float(frame_rate))


def fastest_step(events: DataFrame, frame_rate: float) -> float:
    """The longest way between two frames that any event's speed allows."""
    order = Window.partitionBy("id").orderBy("time")
    lag = lambda c: F.col(c) - F.lag(c).over(order)
    speed = F.sqrt(lag("x") * lag("x") + lag("y") * lag("y")) / F.nullif(lag("time"), F.lit(0.0))
    return (events.select(speed.alias("v")).agg(F.max("v")).first()[0] or 0.0) / frame_rate


def resampled(events: DataFrame, frame_rate: float, ignore_too_short: bool = False, warn: bool = True) -> DataFrame:
    """id, frame, x, y at a constant rate by linear interpolation in time between events (id, time, x, y).

    An as-of join without a range condition: frames and events are sorted
    together, and each frame takes the events before and after it.
    """
    rate = F.lit(float(frame_rate))
    if warn and (step := fastest_step(events, frame_rate)) > 0.1:
        _log.warning("pedestrians move up to %.2f m between frames; a higher frame rate may be needed", step)
    spans = events.groupBy("id").agg(F.min("time").alias("t0"), F.max("time").alias("t1"))
    short = spans.where("t0 = t1").agg(F.count("*").alias("n"), F.min("id").alias("first")).first()
    if short.n and not ignore_too_short:
        raise LoadError(f"trajectories of {short.n} pedestrians, the first {short.first}, are too short for {frame_rate} frames per second")
    if short.n:
        _log.warning("trajectories of %d pedestrians, the first %s, are too short and left out", short.n, short.first)
    inside = spans.where("t0 < t1").select("id", F.ceil(F.round(F.col("t0") * rate, 14)).alias("f0"), F.floor(F.round(F.col("t1") * rate, 14)).alias("f1")).where("f0 <= f1")
    grid = inside.select("id", F.explode(F.sequence("f0", "f1")).alias("frame")).withColumn("time", F.col("frame") / rate)
    both = events.select("id", "time", "x", "y", F.lit(None).cast("long").alias("frame")).unionByName(grid.select("id", "time", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), "frame"))
    order = Window.partitionBy("id").orderBy("time", F.col("frame").asc_nulls_first())
    past, future = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    event_time = F.when(F.col("frame").isNull(), F.col("time"))
    last = lambda c: F.last(c, ignorenulls=True).over(past)
    following = lambda c: F.first(c, ignorenulls=True).over(future)
    joined = both.withColumn("at", event_time)
    joined = joined.select("id", "frame", "time", *[last(c).alias(f"{c}0") for c in ("at", "x", "y")], *[following(c).alias(f"{c}1") for c in ("at", "x", "y")]).where("frame is not null")

    def between(c: str) -> Column:
        # at an event's own time, or after the last one (by rounding), the event's place
        part = (F.col("time") - F.col("at0")) / F.nullif(F.col("at1") - F.col("at0"), F.lit(0.0))
        return F.coalesce(F.col(f"{c}0") + part * (F.col(f"{c}1") - F.col(f"{c}0")), F.col(f"{c}0"), F.col(f"{c}1"))

    return joined.select("id", "frame", between("x").alias("x"), between("y").alias("y"))


def load_walkable_area_from_vadere(scenario_file, margin: float = 0, decimals: int = 6, spark: SparkSession | None = None) -> WalkableArea:
    """Bounds less the bounding box's width (plus a margin), without the obstacles, which must lie properly inside."""
    spark = _session(spark)
    path = locate(scenario_file, spark)
    if margin != 0 and margin < 10**-decimals:
        raise LoadError(f"the margin {margin} must be over 10 ** -{decimals}")
    topography = json.loads(_text(spark, path))["scenario"]["topography"]
    inset = topography["attributes"]["boundingBoxWidth"] - margin
    box = topography["attributes"]["bounds"]

    def outline(shape: dict) -> list[tuple[float, float]]:
        if shape["type"] == "RECTANGLE":
            x, y, w, h = (shape[k] for k in ("x", "y", "width", "height"))
            points = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        elif shape["type"] == "POLYGON":
            points = [(p["x"], p["y"]) for p in shape["points"]]
        else:
            raise LoadError(f"{path}: obstacles of type {shape['type']} are not supported")
        return [(round(x, decimals), round(y, decimals)) for x, y in points]

    area = Polygon.of(outline({"type": "RECTANGLE", "x": box["x"] + inset, "y": box["y"] + inset, "width": box["width"] - 2 * inset, "height": box["height"] - 2 * inset}))
    obstacles, touching = [], []
    for obstacle in topography["obstacles"]:
        body = Polygon.of(outline(obstacle["shape"]))
        proper = area.covers(body) and not any(area.on_boundary(p) for p in body.outline)
        (obstacles if proper else touching).append(body if proper else str(obstacle["id"]))
    if touching:
        raise LoadError(f"{path}: the obstacles {', '.join(touching)} touch the bounds; enlarge the area by a margin")
    return WalkableArea(area, obstacles)
