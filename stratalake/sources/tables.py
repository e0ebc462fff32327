"""Text tables: acquisitions, pairs, baselines, weights, stations, points, processing files."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _split(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, f): the blank-separated fields of every line that isn't a comment, numbered within its file."""
    text = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    kept = text.where(~F.col("line").rlike(r"^\s*(#|$)"))
    return kept.select("file", "n", F.split(F.trim(F.regexp_replace("line", r"[\s,]+", " ")), " ").alias("f"))


def _field(i: int, kind: str) -> Column:
    return F.get("f", F.lit(i)).try_cast(kind)


def read_acquisitions(spark: SparkSession, path: str, datasets: int = 1) -> DataFrame:
    """idx, date, dec, bt and one baseline column a data set, by position: number, date, -, decimal, bt, bperp..."""
    more = [_field(5 + i, "double").alias("bperp" if i == 0 else f"bperp{i + 1}") for i in range(datasets)]
    return _split(spark, path).select(_field(0, "int").alias("nb"), _field(1, "int").alias("date"), _field(3, "double").alias("dec"), _field(4, "double").alias("bt"), *more)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """date1, date2 and sigma (null where the list has two columns)."""
    return _split(spark, path).select(_field(0, "int").alias("date1"), _field(1, "int").alias("date2"), _field(2, "double").alias("sigma"))


def read_baselines(spark: SparkSession, path: str, layout: str = "baseline") -> DataFrame:
    """date, bperp, bt, dec of a baseline table, or of a list_dates one with its other order."""
    order = {"baseline": {"date": 0, "bperp": 1, "bt": 2, "dec": 4}, "list_dates": {"date": 0, "dec": 1, "bt": 2, "bperp": 3}}[layout]
    return _split(spark, path).select(*[_field(i, "int" if n == "date" else "double").alias(n) for n, i in order.items()])


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """One weight a line: the third field where there are three, else the only one -> idx, weight."""
    lines = _split(spark, path)
    return lines.select(F.col("n").alias("idx"), F.coalesce(_field(2, "double"), _field(0, "double")).alias("weight"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, value): one value a date."""
    return _split(spark, path).select("file", F.col("n").alias("idx"), _field(0, "double").alias("value"))


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Velocities and sigmas of stations."""
    names = ("lon", "lat", "ve", "dve", "vn", "dvn", "vup", "dvup")
    return _split(spark, path).select(F.get("f", F.lit(0)).alias("station"), *[_field(i, "double").alias(n) for i, n in enumerate(names, 1)])


def read_station_series(spark: SparkSession, path: str, dimensions: int = 3) -> DataFrame:
    """Series of station files (named by the station) in metres -> millimetres, one row a component."""
    parts = ("east", "north", "up")[:dimensions]
    rows = F.array(*[F.struct(F.lit(p).alias("component"), (_field(1 + i, "double") * 1000).alias("d"), (_field(1 + dimensions + i, "double") * 1000).alias("sigma")) for i, p in enumerate(parts)])
    station = F.regexp_extract("file", r"([^/]+?)(?:\.[^/.]*)?$", 1)
    return _split(spark, path).select(station.alias("station"), _field(0, "double").alias("dec"), F.explode(rows).alias("r")).select("station", "dec", "r.*")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return _split(spark, path).select(*[_field(i, "double").alias(n) for i, n in enumerate(("lat", "lon", "value", "coh"))])


class Processing:
    """A `key = value` processing file; a key that repeats holds a list."""

    def __init__(self, text: str, defaults: dict[str, str] | None = None):
        self.values: dict[str, list[str]] = {k: [v] for k, v in (defaults or {}).items()}
        seen = set()
        for line in text.splitlines():
            line = line.split("#", 1)[0].strip()
            if "=" not in line:
                continue
            key, value = (x.strip() for x in line.split("=", 1))
            if key not in seen:
                self.values[key] = []
            seen.add(key)
            self.values[key].append(value)

    def get(self, key: str, kind=str):
        """The value, or the list of values, converted; yes, true and 1 are true."""
        convert = (lambda v: v.lower() in ("yes", "true", "1")) if kind is bool else kind
        found = [convert(v) for v in self.values[key]]
        return found[0] if len(found) == 1 else found


@dataclass(frozen=True)
class TieSettings:
    """What a tie of a map to stations is told: a plain record, where scripts of the field run their input file as code.

    `bounds` are (west, east, south, north); `components` names what the stations give.
    """

    stations: str
    maps: tuple[str, ...]
    bounds: tuple[float, float, float, float] | None = None
    components: tuple[str, ...] = ("east", "north", "up")
    quadratic: bool = False

    @classmethod
    def read(cls, values: dict[str, object]) -> TieSettings:
        """From a dict, such as parsed JSON; a name that is no setting is an error, a value may be a list or one item."""
        known = {f.name for f in fields(cls)}
        if wrong := sorted(set(values) - known):
            raise ValueError(f"no such settings: {', '.join(wrong)}")
        listed = lambda v: tuple(v) if isinstance(v, (list, tuple)) else (v,)
        found = {k: listed(v) if k in ("maps", "bounds", "components") and v is not None else v for k, v in values.items()}
        settings = cls(**found)
        if settings.bounds is not None and len(settings.bounds) != 4:
            raise ValueError("bounds are west, east, south, north")
        return settings
