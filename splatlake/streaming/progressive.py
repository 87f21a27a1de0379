"""Streams: progressive records as a source, poses that select tiles, a tile cache with a byte budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.packed import MGS_FLOATS, MGS_HEADER, SCHEMA, MgsReader, batch
from ..sources.ply import Rows


class ProgressiveReader(DataSourceStreamReader):
    """Whole records of a growing progressive file; the offset is the record index, so a restart goes on where it was."""

    def __init__(self, path: str, step: int):
        self.path, self.step, self.at = path, step, 0

    def initialOffset(self):
        return {"record": 0}

    def latestOffset(self):
        self.at = min(MgsReader(self.path, None).n, self.at + self.step)
        return {"record": self.at}

    def partitions(self, start, end):
        self.at = max(self.at, end["record"])
        return [Rows(start["record"], end["record"])]

    def read(self, part):
        n = part.stop - part.start
        got = np.fromfile(self.path, "<f4", n * MGS_FLOATS, offset=MGS_HEADER.size + part.start * 4 * MGS_FLOATS)
        yield from map(tuple, batch(part.start, list(got.reshape(-1, MGS_FLOATS).T)).to_pandas().itertuples(index=False))

    def commit(self, end):
        pass


class ProgressiveSource(DataSource):
    """``spark.readStream.format("splat_progressive").option("recordsPerBatch", n).load(path)``"""

    @classmethod
    def name(cls):
        return "splat_progressive"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return ProgressiveReader(self.options["path"], int(self.options.get("recordsPerBatch", "100000")))


def pose_tiles(poses: DataFrame, tiles: DataFrame, height: float = 1080.0, fov: float = 1.0, most: float = 16.0) -> DataFrame:
    """Poses (session, ts, ex, ey, ez) joined to static tiles (tile, geometric_error, box, bytes) whose screen-space error
    asks for them. Stateless: the tile table is broadcast by Spark where it is small."""
    gap = F.sqrt(sum(F.pow(F.greatest(F.col(f"lo_{c}") - F.col(f"e{c}"), F.lit(0.0), F.col(f"e{c}") - F.col(f"hi_{c}")), 2) for c in "xyz"))
    error = F.col("geometric_error") * height / (F.greatest(gap, F.lit(1e-6)) * 2 * float(np.tan(fov / 2)))
    return poses.crossJoin(tiles).withColumn("sse", error).where(F.col("sse") > most)


def cache(wanted: DataFrame, budget: int) -> DataFrame:
    """(session, tile, event): hits, loads and evictions of a least-recently-used cache of ``budget`` bytes per session.

    ``wanted``: session, ts, tile, bytes. Tiles of the newest time of a batch are never evicted by it. State is a list of
    (tile, bytes, last use), bounded by the budget.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {t: (b, u) for t, b, u in zip(*state.get, strict=True)} if state.exists else {}
        out = []
        rows = pd.concat(list(frames)).sort_values(["ts", "tile"])
        for ts, group in rows.groupby("ts", sort=True):
            now = ts.value
            for tile, size in zip(group["tile"].tolist(), group["bytes"].tolist(), strict=True):
                out.append((key[0], tile, "hit" if tile in held else "load"))
                held[tile] = (size, now)
            total = sum(b for b, _ in held.values())
            for tile, (size, used) in sorted(held.items(), key=lambda x: (x[1][1], x[0])):
                if total <= budget:
                    break
                if used < now:
                    total -= size
                    del held[tile]
                    out.append((key[0], tile, "evict"))
        items = sorted(held.items())
        state.update(([t for t, _ in items], [b for _, (b, _) in items], [u for _, (_, u) in items]))
        yield pd.DataFrame(out, columns=["session", "tile", "event"])

    return wanted.groupBy("session").applyInPandasWithState(step, "session long, tile long, event string", "tiles array<long>, sizes array<long>, used array<long>", "append", GroupStateTimeout.NoTimeout)


def windows(events: DataFrame, length: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event-time window, tumbling or sliding; rows later than ``late`` are dropped by the watermark."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
