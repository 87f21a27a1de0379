"""Scene catalogues and bench cells: lookups, upserts, gates, pages, recommendations."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a preset's quality may fall before the new value is rejected.
TOLERANCE = 0.3


def list_scenes(scenes: DataFrame, kind: str | None = None, licence: str | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    out = scenes
    for ok, c in ((kind, F.col("class") == kind), (licence, F.col("license") == licence), (least, F.col("splats") >= (least or 0)), (most, F.col("splats") <= (most or 0))):
        if ok is not None:
            out = out.where(c)
    return out


def facets(scenes: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of each value of each column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return scenes.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def page(scenes: DataFrame, order: list[Column], start: int, size: int) -> DataFrame:
    return scenes.orderBy(*order).offset(start).limit(size)


def cursor(start: int, filters: dict) -> str:
    """A page token: the offset and a digest of the filters it belongs to."""
    return f"{start}.{hashlib.sha256(repr(sorted(filters.items())).encode()).hexdigest()[:16]}"


def similar(scenes: DataFrame, splats: int, degree: int, kind: str | None, k: int = 3) -> DataFrame:
    """The k scenes nearest in log count, degree (0.5 a step) and class (0.75 if another)."""
    d = F.abs(F.ln(F.col("splats").cast("double")) - F.ln(F.lit(float(splats)))) + F.abs(F.col("degree") - degree) * 0.5
    if kind is not None:
        d = d + F.when(F.col("class") == kind, 0.0).otherwise(0.75)
    return scenes.withColumn("distance", d).orderBy("distance", "id").limit(k)


def recommend(predictions: DataFrame, max_bytes: float | None = None, max_error: float | None = None, min_score: float | None = None) -> DataFrame:
    """The best and second-best presets that fit: score descending, then bytes."""
    fits = F.lit(True)
    for bound, c in ((max_bytes, F.col("bytes") <= (max_bytes or 0)), (max_error, F.col("error") <= (max_error or 0)), (min_score, F.col("score").isNull() | (F.col("score") >= (min_score or 0)))):
        if bound is not None:
            fits = fits & c
    return predictions.where(fits).orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "bytes", "preset").limit(2)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old rows of their key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def latest(cells: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The last row of each key: an aggregate, so no key's history is sorted."""
    rest = [c for c in cells.columns if c not in keys]
    top = cells.groupBy(*keys).agg(F.max(F.struct(time, tie, *[c for c in rest if c not in (time, tie)])).alias("r"))
    return top.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def gate(before: DataFrame, now: DataFrame, keys: list[str], value: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Accepted values: the new one, unless it failed (null) or fell more than ``tolerance`` under the previous."""
    p = before.select(*keys, F.col(value).alias("prev"))
    j = now.select(*keys, F.col(value).alias("cur")).join(p, keys, "full_outer")
    keep = F.col("cur").isNull() | F.coalesce(F.col("cur") < F.col("prev") - tolerance, F.lit(False))
    return j.select(*keys, F.when(keep, F.col("prev")).otherwise(F.col("cur")).alias(value), keep.alias("rejected"))


def last_commits(cells: DataFrame, time: str, n: int = 90) -> DataFrame:
    """Rows of the last n distinct times."""
    kept = cells.select(time).distinct().orderBy(F.desc(time)).limit(n)
    return cells.join(F.broadcast(kept), time, "left_semi")


def profile(kind: Column) -> Column:
    """A class's coarse bucket: the first word list that holds a part of it."""
    #: Bucket and the parts that lead to it, in order.
    table = {"indoor": ["indoor"], "outdoor": ["outdoor"], "foliage": ["foliage", "translucency"], "portrait": ["portrait"], "product-scan": ["product"], "synthetic-probe": ["specular", "lowlight", "texture", "depth", "motion", "banding", "transparency", "noisy", "dense"]}
    out = F.lit("other")
    for bucket, parts in reversed(table.items()):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(kind, F.lit(p))
        out = F.when(hit, bucket).otherwise(out)
    return out


def licence_bucket(text: Column) -> Column:
    #: Bucket and the parts that lead to it, in order.
    table = {"CC0": ["cc0"], "CC-BY-SA": ["cc-by-sa", "cc by-sa"], "CC-BY": ["cc-by", "cc by"], "Apache-2.0": ["apache"], "MIT": ["mit"], "research-open": ["mip-nerf", "deep blending", "research"]}
    low, out = F.lower(text), F.lit("other")
    for bucket, parts in reversed(table.items()):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(low, F.lit(p))
        out = F.when(hit, bucket).otherwise(out)
    return F.when(F.coalesce(text, F.lit("")) == "", "unknown").otherwise(out)


def rolling(cells: DataFrame, keys: list[str], time: str, value: str, n: int) -> DataFrame:
    """``cells`` with the mean of the last n values of the key."""
    w = Window.partitionBy(*keys).orderBy(*([time] if isinstance(time, str) else time)).rowsBetween(-(n - 1), 0)
    return cells.withColumn("rolling", F.avg(value).over(w))


def jobs(table: DataFrame, status: str = "all", batch: str | int | None = None, since: str | None = None, start: int = 0, size: int = 20) -> DataFrame:
    """A page of jobs (job_id, status, batch_id, created_at), newest first, ties by id; filters reach the scan."""
    out = table if status == "all" else table.where(F.col("status") == status)
    if batch is not None:
        out = out.where(F.col("batch_id") == batch)
    if since is not None:
        out = out.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    return page(out, [F.desc("created_at"), F.col("job_id")], start, size)


def pair_sidecars(files: DataFrame, tile: str = "glb", sidecar: str = "shpal") -> DataFrame:
    """(path, sidecar) of each tile file of ``files`` (path): its sidecar has the tile's name and one extension more; null
    where there is none. Repeated paths count once."""
    paths = files.select("path").distinct()
    sides = paths.where(F.endswith("path", F.lit(f".{tile}.{sidecar}"))).select(F.col("path").alias("sidecar"))
    return paths.where(F.endswith("path", F.lit(f".{tile}"))).join(sides, F.concat("path", F.lit(f".{sidecar}")) == F.col("sidecar"), "left")
