"""Named chains of operators, and the runner that reports what each did."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import cluster, codec, order, prune, quantize
from ..runtime import cut

Step = tuple[str, dict]
#: Operators that presets may name.
OPERATORS: dict[str, Callable[..., DataFrame]] = {
    "remove_invalid": prune.remove_invalid,
    "opacity": prune.opacity,
    "aspect_ratio": prune.aspect_ratio,
    "floaters": prune.floaters,
    "rate_distortion": prune.rate_distortion,
    "bundle": lambda df, **k: cluster.merge_bundles(cluster.bundle(df, **k)),
    "position": quantize.position,
    "scale": quantize.scale,
    "rotation": quantize.rotation,
    "rotation_packed": quantize.rotation_packed,
    "rotation_smallest3": lambda df, **k: quantize.rotation_smallest3(df, **k).drop("packed"),
    "dc": quantize.dc_packed,
    "rest": quantize.rest,
    "rest_dct": quantize.rest_dct,
    "degree": quantize.reduce_degree,
    "morton": lambda df, **k: order.morton_sort(df.drop("code", "rank"), **k),
    "levels": order.with_levels,
    "delta": lambda df, **k: codec.splat_delta(df, **k).drop("delta_error"),
    "palette": cluster.with_palette,
    "lod_merge": cluster.lod_merge,
}


def step(name: str, **options) -> Step:
    return name, options


VALID, SORT, HALVES = step("remove_invalid"), step("morton"), step("levels", fractions=(0.5, 0.25))


def _grids(position: int = 15, scale: int = 12, rotation: int = 12, log: bool = False) -> list[Step]:
    return [step("position", bits=position), step("scale", bits=scale, log=log), step("rotation", bits=rotation)]


def _pruned(opacity: float, ratio: float | None = None, sigma: float | None = 3.0) -> list[Step]:
    out = [VALID, step("opacity", threshold=opacity)]
    out += [step("aspect_ratio", most=ratio)] if ratio else []
    return out + ([step("floaters", k=8, sigma=sigma)] if sigma else [])


def _flat(*tail: Step) -> list[Step]:
    """Constant colour, Morton order, and what comes after."""
    return [step("degree", degree=0), SORT, *tail]


def _palette(k: int, *tail: Step, first: list[Step] | None = None) -> list[Step]:
    return [*(first or [VALID]), *_grids(log=True), SORT, HALVES, step("palette", k=k), *tail]


_DELTA = lambda bits: [*_pruned(0.01, 50.0), *_flat(step("delta", stride=64, k=2, bits=bits, percentile=0.995), HALVES)]
_TIGHT = (step("rotation_packed", bits=8), step("dc", bits=8))
_REST = lambda bits: step("rest", bits=bits, percentile=0.995)
_OLD = _pruned(0.02, 10.0)

#: The chains of the named presets.
PRESETS: dict[str, list[Step]] = {
    "lossless-repack": [VALID, SORT],
    "quality-max": [VALID, SORT],
    "web-mobile": [*_pruned(0.01, 50.0, None), *_grids(), *_flat(HALVES)],
    "web-desktop": [*_pruned(0.005, 50.0), *_grids(16), step("degree", degree=1), step("rest_dct", bits=(7,) * 16), SORT],
    "quest-browser": [*_pruned(0.02, 30.0), *_grids(14), *_flat(step("levels", fractions=(0.3,)))],
    "visionos-preview": [*_pruned(0.02, None, None), *_grids(15, 8, 8), *_flat()],
    "thumbnail-preview": [*_pruned(0.05, 10.0), *_grids(12), *_flat()],
    "size-min": [*_pruned(0.05, 10.0), step("bundle", radius=0.1, attributes=0.6), *_grids(12), *_flat(step("levels", fractions=(0.25, 0.1)))],
    "geospatial": [*_pruned(0.02), *_grids(15, 8, 8), *_flat(step("levels", fractions=(0.5, 0.25, 0.125)))],
    "hero": [VALID, step("floaters", k=8, sigma=3.0), *_grids(16, 16, 16), *_flat()],
    "wmv-no-shred": [*_OLD, *_grids(), *_flat(HALVES)],
    "wmv-no-lod": [*_OLD, *_grids(), *_flat()],
    "wmv-no-posq": [*_OLD, *_grids()[1:], *_flat(HALVES)],
    "wmv-no-quant": [*_OLD, *_flat(HALVES)],
    "wmv-no-prune": [VALID, *_grids(), *_flat(HALVES)],
    "wm-recovery": [*_pruned(0.005, 200.0), *_grids(), *_flat(HALVES)],
    **{f"wm-floater-{s}": [*_pruned(0.01, 50.0, float(s)), *_grids(), *_flat(HALVES)] for s in (3, 6, 8, 12)},
    "wm-floater-off": [*_pruned(0.01, 50.0, None), *_grids(), *_flat(HALVES)],
    "web-mobile-delta": _DELTA(6),
    **{f"wmd-b{b}": _DELTA(b) for b in (6, 8, 10, 12)},
    "web-mobile-sh3": [*_pruned(0.01, 50.0), *_grids(), SORT, HALVES],
    "web-mobile-sh3-floater6": [*_pruned(0.01, 50.0, 6.0), *_grids(), SORT, HALVES],
    "wmd-sh3-nofloater": [*_pruned(0.01, 50.0, None), SORT, step("delta"), HALVES],
    "wmv-sh3-q8": [VALID, *_grids(), SORT, HALVES, _REST(8)],
    "wmv-sh3-q6": [VALID, *_grids(), SORT, HALVES, _REST(6)],
    "wmv-sh3-q8-zstd": [VALID, *_grids(), SORT, HALVES, _REST(8)],
    "web-mobile-sh3-q8": [*_pruned(0.01, 50.0), *_grids(), SORT, HALVES, _REST(8)],
    "web-mobile-sog-clone": [VALID, *_grids(16, 8, 8), SORT, _REST(8)],
    "wmd-sog-clone": [VALID, SORT, step("delta"), _REST(8)],
    "web-mobile-vq45": _palette(65_536, first=_pruned(0.01, 50.0)),
    "wmv-vq45-no-prune": _palette(65_536),
    "wmv-vq45-no-prune-tight": _palette(65_536, *_TIGHT),
    "wmv-vq45-no-prune-tight-smallest3": _palette(65_536, step("rotation_smallest3", bits=10), step("dc", bits=8)),
    **{f"wmv-vq45k{k}-no-prune-tight": _palette(k, *_TIGHT) for k in (1024, 4096, 16_384)},
    "wmv-vq45k4096-posthac-no-prune-tight": _palette(4096, *_TIGHT),
    "wmv-vq45-posthac-no-prune-tight": _palette(65_536, *_TIGHT),
    "wmv-vq45-tight-v2": _palette(65_536, *_TIGHT, first=[VALID, step("lod_merge")]),
    "sog-render-weighted": [VALID, SORT, step("palette", k=4096)],
}


@dataclass
class Report:
    """What each step removed and how long it took."""

    before: int = 0
    after: int = 0
    steps: list[dict] = field(default_factory=list)


def with_rate_distortion(steps: list[Step], keep: float) -> list[Step]:
    """The only rewrite of a chain: the opacity prune gives way to a rate-distortion prune; without one it goes after the
    validity filter."""
    rd = step("rate_distortion", keep=keep)
    if any(n == "opacity" for n, _ in steps):
        return [rd if n == "opacity" else (n, o) for n, o in steps]
    return [steps[0], rd, *steps[1:]]


#: Operators that read their input several times.
SEVERAL_PASSES = {"morton", "rate_distortion", "floaters", "bundle", "rest", "rest_dct", "delta", "palette", "lod_merge"}


def run(df: DataFrame, steps: list[Step]) -> DataFrame:
    """The steps in order; narrow steps fuse into one stage. What several passes read is computed once and cut."""
    for name, options in steps:
        if name in SEVERAL_PASSES:
            df = cut(df)
        df = OPERATORS[name](df, **options)
    return df


def run_reported(df: DataFrame, steps: list[Step], progress: Callable[[float, str], None] = lambda f, s: None) -> tuple[DataFrame, Report]:
    """The steps one by one, each cut and counted, so the report holds for what was written."""
    report = Report(before=df.count())
    n = report.before
    for i, (name, options) in enumerate(steps):
        began = time.monotonic()
        df = cut(OPERATORS[name](df, **options))
        m = df.count()
        report.steps.append({"name": name, "removed": n - m, "duration_ms": round(1000 * (time.monotonic() - began))})
        n = m
        progress((i + 1) / len(steps), name)
    report.after = n
    return df, report
