"""Effects: named steps from frame to frame, a registry, and chains of them. Decision tables that choose a path are here too."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@runtime_checkable
class Effect(Protocol):
    """What a step must offer. ``slug`` goes into names; ``check_strength`` raises ValueError."""

    name: str
    slug: str

    def check_strength(self, strength: float) -> None: ...

    def apply(self, df: DataFrame) -> DataFrame: ...


@runtime_checkable
class Tunable(Protocol):
    def with_strength(self, strength: float) -> Effect: ...


@runtime_checkable
class Available(Protocol):
    def check_available(self) -> None: ...


@runtime_checkable
class Reencodes(Protocol):
    reencodes: bool


@runtime_checkable
class DropsTracks(Protocol):
    """Of an effect whose output keeps picture and sound only."""

    drops_tracks: bool


_REGISTRY: dict[str, Callable[[], Effect]] = {}


def register(name: str, make: Callable[[], Effect]) -> None:
    if name in _REGISTRY:
        raise ValueError(f"effect {name!r} is registered twice")
    _REGISTRY[name] = make


def names() -> list[str]:
    return sorted(_REGISTRY)


def get(name: str) -> Effect:
    if name not in _REGISTRY:
        raise KeyError(f"unknown effect {name!r}; there are: {', '.join(names())}")
    return _REGISTRY[name]()


def unit_strength(strength: float) -> None:
    if not 0 <= strength <= 1:
        raise ValueError(f"strength {strength} isn't within 0 and 1")


def resolve(wanted: Iterable[str], implied: dict[str, str] | None = None, last: tuple[str, ...] = ()) -> list[Effect]:
    """The effects by name, in order: none twice, with what each implies after it, those of ``last`` at the end of the chain only."""
    chain = list(wanted)
    if twice := sorted({n for n in chain if chain.count(n) > 1}):
        raise ValueError(f"given more than once: {', '.join(twice)}")
    for n in list(chain):
        if (more := (implied or {}).get(n)) and more not in chain:
            chain.append(more)
    for n in last:
        if n in chain and chain[-1] != n and any(x not in last for x in chain[chain.index(n) :]):
            raise ValueError(f"{n} must come last")
    return [get(n) for n in chain]


def chain(df: DataFrame, effects: Iterable[Effect]) -> DataFrame:
    """Left to right; Catalyst sees one plan."""
    return reduce(lambda d, e: d.transform(e.apply), effects, df)


def slugs(effects: Iterable[Effect]) -> list[str]:
    return [e.slug for e in effects]


def layout(mode: Column, portrait: Column, has_power: Column) -> Column:
    """The layout of a display by what is asked for, orientation and whether there is power; ``auto``, and anything unknown, lets these two decide."""
    auto = F.when(portrait, "vertical").when(has_power, "default").otherwise("default-no-power")
    return F.when(mode.isin("vertical", "default", "default-no-power", "time"), mode).otherwise(auto)


def without(rows: Column, name: str) -> Column:
    return F.filter(rows, lambda x: x != name)


def falls_back(mode: Column, custom: Column) -> Column:
    """Whether a clip outside coverage may be shown with time alone."""
    return ~custom & ~mode.isin("default", "default-no-power", "vertical")


def anchored(anchor: Column, width: Column, height: Column, margin: Column) -> Column:
    """Struct (x, y) of an anchor such as top-left, middle or bottom-right, ``margin`` in from the edges."""
    x = F.when(anchor.endswith("left"), margin).when(anchor.endswith("right"), width - margin).otherwise(width / 2)
    y = F.when(anchor.startswith("top"), margin).when(anchor.startswith("bottom"), height - margin).otherwise(height / 2)
    return F.struct(x.alias("x"), y.alias("y"))


def readout(forced: Column, measured: Column, reliable: Column) -> Column:
    """A forced ratio within 0 and 1, else the measured one if reliable, else 0."""
    return F.coalesce(F.when(forced.between(0, 1), forced), F.when(reliable, measured), F.lit(0.0))


def embeds_subtitle(container: Column, wanted: Column) -> Column:
    return wanted & container.isin(".mp4", ".mov", ".m4v")


def trim_extension(path: Column) -> Column:
    """Trims need a container with edit lists; others go to .mp4."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.when(ext.isin(".mp4", ".mov", ".m4v"), ext).otherwise(".mp4")


def start_survives(start: Column, reencoded: Column, container: Column) -> Column:
    """A trim's exact start outlives the output unless it is copied into a container without edit lists."""
    return (start <= 0) | reencoded | container.isin(".mp4", ".mov", ".m4v")


def yaw_check(slope: Column, implied: Column, calibrated: Column) -> Column:
    """error for a slope of the wrong sign, warning for a focal length out of half to twice, else ok."""
    return F.when(slope <= 0, "error").when(~(implied / calibrated).between(0.5, 2.0), "warning").otherwise("ok")


#: What is taken where a setting isn't given.
MESH_STRENGTH, PERSPECTIVE_MARGIN, MESH_MARGIN, LEAST_CENTRE = 0.5, 0.02, 0.02, 15.0


def render_options(model: str, settings: dict, rectifiers: bool = False, ratio: float = 0.0, lens_reliable: bool = False) -> dict:
    """What a render is told, from an effect's settings and the model its analysis was made with: similarity, homography, rotation or mesh.

    A perspective strength of 0 or less is all of it; a negative mesh strength is the default, one over 1 is 1; rotations are used with a reliable lens only, and then take the readout ratio
    itself in place of the rectifiers of rows.
    """
    out = {k: settings.get(k) for k in ("edge_mode", "fixed_zoom", "max_zoom", "quality", "zoom_transition")} | {"rectifiers": rectifiers}
    if model == "homography":
        strength = settings.get("perspective") or 0.0
        out |= {"perspective": strength if strength > 0 else 1.0, "perspective_margin": PERSPECTIVE_MARGIN}
    elif model == "rotation":
        out["rotation"] = lens_reliable
        if lens_reliable:
            out |= {"readout_ratio": ratio, "rectifiers": False}
    elif model == "mesh":
        strength = settings.get("mesh", -1.0)
        out |= {"mesh": True, "mesh_strength": min(1.0, strength if strength >= 0 else MESH_STRENGTH), "mesh_margin": MESH_MARGIN}
    return out


def lag_query(window: float, centre: float | None = None, centre_width: float = 20.0, interval: float = 10.0) -> dict:
    """The checked settings of an estimate, in seconds: ``ValueError`` for a negative length, or a window about a centre of under ``LEAST_CENTRE`` seconds, too little of a turn to trust."""
    for name, value in (("window", window), ("centre", centre or 0.0), ("interval", interval)):
        if not value >= 0:
            raise ValueError(f"{name} {value} isn't a length of time")
    if not centre_width >= LEAST_CENTRE:
        raise ValueError(f"a window of {centre_width:g} s about the centre is too narrow: {LEAST_CENTRE:g} s at least")
    return {"window": window, "centre": centre, "centre_width": centre_width, "interval": interval}


def round_trip_problems(files: DataFrame) -> DataFrame:
    """(file, problem) of outputs that don't hold what was put in: rows (file, width, height, out_width, out_height, frames, out_frames, counted, audio, out_audio).

    Sizes must be equal; a reported number of frames (0: unknown) may be two off, an exact count (null: not made) not at all; sound that was there must be there.
    """
    c = F.col
    checks = {
        "size": (c("width") != c("out_width")) | (c("height") != c("out_height")), "frames": (c("out_frames") > 0) & (F.abs(c("out_frames") - c("frames")) > 2),
        "count": c("counted") != c("frames"), "audio": c("audio") & ~c("out_audio"),
    }
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]), lambda x: x.isNotNull())
    return files.select("file", F.explode(found).alias("problem"))
