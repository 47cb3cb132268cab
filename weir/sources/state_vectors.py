"""Aircraft state vectors: snapshot files as a data source, positional arrays as typed rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from weir.functions.fixed_values import REGION_BOXES
from weir.functions.numbers import finite
from weir.operators.geo import region_filter

DEFAULT_REGION = "NORTH_AMERICA"
FIELDS = 17                        # a usable vector has at least this many entries


def parse_state_vectors(df: DataFrame, states: str = "state", taken: str = "time") -> DataFrame:
    """Typed rows from ``ARRAY<STRING>`` vectors; vectors without id or position are left out.

    A value that cannot be read becomes NULL.  Runs in the JVM, no Python per row.
    """
    at = lambda i: F.get(F.col("_v"), F.lit(i))
    instant = lambda c: F.timestamp_seconds(c.try_cast("double"))

    def usable(v: Column) -> Column:
        entry = lambda i: F.get(v, F.lit(i))
        return (F.size(v) >= FIELDS) & entry(0).isNotNull() & entry(5).isNotNull() & entry(6).isNotNull()

    columns: dict[str, Column] = {
        "time_ingest": F.timestamp_seconds(F.col(taken)),
        "icao24": at(0), "callsign": at(1), "origin_country": at(2),
        "time_position": instant(at(3)), "last_contact": instant(at(4)),
        "longitude": finite(at(5)), "latitude": finite(at(6)),
        "geo_altitude": finite(at(13)), "on_ground": at(8).try_cast("boolean"),
        "velocity": finite(at(9)), "true_track": finite(at(10)), "vertical_rate": finite(at(11)),
        "sensors": F.from_json(at(12), "array<int>"), "baro_altitude": finite(at(7)),
        "squawk": at(14), "spi": at(15).try_cast("boolean"), "category": at(17).try_cast("int"),
    }
    # a list of at most one vector: an expression that makes it is evaluated once, not per test
    kept = df.withColumn("_v", F.explode(F.filter(F.array(states), usable)))
    return kept.select(*[c.alias(n) for n, c in columns.items()])


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:") and "://" not in path:
        path = path[len("file:"):]
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _snapshots(path: str) -> list[str]:
    """The names of all snapshot files."""
    from pyarrow import fs

    store, root = _open(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith((".json", ".txt")))


class TakenNames:
    """Which names each batch of a stream took in: one small file per batch, in a shared folder."""

    def __init__(self, path: str):
        self.path = path

    def _place(self, batch: int) -> str:
        return f"{_open(self.path)[1].rstrip('/')}/{batch:012d}.names"

    def batches(self) -> list[int]:
        from pyarrow import fs

        store, root = _open(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(int(f.base_name.split(".")[0]) for f in found if f.base_name.endswith(".names"))

    def names(self, batch: int) -> list[str]:
        store, _ = _open(self.path)
        with store.open_input_stream(self._place(batch)) as stream:
            return json.loads(stream.read())

    def add(self, batch: int, names: list[str]) -> None:
        """Written beside its place first, so that a batch's file is whole or not there."""
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        beside = f"{self._place(batch)}.part"
        with store.open_output_stream(beside) as stream:
            stream.write(json.dumps(names).encode())
        store.move(beside, self._place(batch))


def _vectors(path: str, file: str):
    """The vectors of one snapshot file: one JSON document per line, or one in all."""
    store, _ = _open(path)
    with store.open_input_stream(file) as stream:
        text = stream.read().decode("utf-8")
    for line in text.splitlines():
        if line.strip():
            snapshot = json.loads(line)
            for state in snapshot.get("states") or []:
                yield snapshot["time"], [
                    v if v is None or isinstance(v, str) else json.dumps(v) for v in state]


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class SnapshotReader(DataSourceReader):
    """Batch: every snapshot file is its own partition."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_Files([f]) for f in _snapshots(self.path)] or [_Files([])]

    def read(self, partition):
        for file in partition.files:
            yield from _vectors(self.path, file)


class SnapshotStreamReader(DataSourceStreamReader):
    """Stream: the offset is the number of the last batch of names that the manifest holds.

    A file is new if no batch has taken its name, whatever its time of change: copies that keep their
    time, late uploads and clocks that differ lose nothing.  A batch of names is stored before its
    number is given out and never changes, so it can be replayed after a failure; one whose number was
    not yet known to the query when it stopped comes with the next run.  The manifest belongs to one
    checkpoint.  A folder that cannot be listed just now means no new data; right after a start it fails
    the query, which starts again from its checkpoint.
    """

    def __init__(self, path: str, manifest: str):
        self.path, self.manifest = path, TakenNames(manifest)
        self.batch: int | None = None
        self.taken: set[str] = set()

    def initialOffset(self):
        return {"batch": 0}

    def _catch_up(self) -> None:
        for batch in self.manifest.batches():
            if batch > (self.batch or 0):
                self.taken.update(self.manifest.names(batch))
                self.batch = batch
        self.batch = self.batch or 0

    def latestOffset(self):
        try:
            names = _snapshots(self.path)
        except OSError:
            if self.batch is None:
                raise
            return {"batch": self.batch}
        self._catch_up()
        fresh = [n for n in names if n not in self.taken]
        if fresh:
            self.manifest.add(self.batch + 1, fresh)
            self._catch_up()
        return {"batch": self.batch}

    def partitions(self, start, end):
        found = [n for b in range(start["batch"] + 1, end["batch"] + 1) for n in self.manifest.names(b)]
        return [_Files([f]) for f in found] or [_Files([])]

    def read(self, partition):
        for file in partition.files:
            yield from _vectors(self.path, file)


class StateVectorDataSource(DataSource):
    """``spark.read.format("state_vectors").option("path", …)`` and the same for streams."""

    def __init__(self, options):
        super().__init__(options)
        if not options.get("path"):
            raise ValueError("option 'path' is required")
        if bool(options.get("client_id")) != bool(options.get("client_secret")):
            raise ValueError("give both client_id and client_secret, or neither")
        region_option(options.get("region"))

    @classmethod
    def name(cls):
        return "state_vectors"

    def schema(self):
        return "time BIGINT, state ARRAY<STRING>"

    def reader(self, schema):
        return SnapshotReader(self.options["path"])

    def streamReader(self, schema):
        if not self.options.get("manifest"):
            raise ValueError("option 'manifest', a shared folder of the stream's own, is required")
        return SnapshotStreamReader(self.options["path"], self.options["manifest"])


def region_option(region: str | None) -> str:
    name = (region or DEFAULT_REGION).upper()
    if name not in REGION_BOXES:
        raise ValueError(f"region must be one of {', '.join(REGION_BOXES)}")
    return name


def read_state_vectors(
    spark: SparkSession, path: str, region: str | None = None, stream: bool = False, manifest: str | None = None,
) -> DataFrame:
    """Typed state vectors inside a region's box, as a batch or a stream.  A stream keeps the names it has
    taken in the folder ``manifest``, one per checkpoint."""
    spark.dataSource.register(StateVectorDataSource)
    reader = spark.readStream if stream else spark.read
    name = region_option(region)
    reader = reader.format("state_vectors").option("path", path).option("region", name)
    raw = (reader.option("manifest", manifest) if manifest else reader).load()
    return region_filter(parse_state_vectors(raw), name)
