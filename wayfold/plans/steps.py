"""The library's own effects: steps from frame to frame, registered by name."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import maths, text
from ..operators import governance, trajectory
from . import effects


@dataclass(frozen=True)
class Stabilize:
    """Motion (series_id, frame, dx, dy, rotation, scale, ok) to corrections; strength 0 to 1 is a smoothing of 10 to 24 frames."""

    strength: float = 0.5
    name: str = "stabilize"
    slug: str = "stabilized"
    reencodes: bool = True

    def check_strength(self, strength: float) -> None:
        effects.unit_strength(strength)

    def with_strength(self, strength: float) -> Stabilize:
        self.check_strength(strength)
        return replace(self, strength=strength)

    def apply(self, df: DataFrame) -> DataFrame:
        return trajectory.corrections(trajectory.trajectory(df), 10 + 14 * self.strength)


@dataclass(frozen=True)
class Offset:
    """Shifts the times (``t``, microseconds) of a series; it has no strength and needs an offset that isn't 0."""

    seconds: float = 0.0
    name: str = "offset"

    @property
    def slug(self) -> str:
        return f"offset {self.seconds:+g}s"

    def check_strength(self, strength: float) -> None:
        return None

    def apply(self, df: DataFrame) -> DataFrame:
        if not self.seconds:
            raise ValueError("an offset of 0 changes nothing")
        return df.withColumn("t", F.col("t") + round(self.seconds * 1_000_000))


@dataclass(frozen=True)
class StripMetadata:
    """Takes what identifies out of tags (file, stream, key, value): tags that tell something go, a language becomes undetermined, and a handler's name the one that a muxer gives to its kind of
    stream (``kind``: video, audio, subtitle, timecode or data, where there is that column; without it a name that no muxer gives goes). What else describes the container stays as it is."""

    name: str = "strip-metadata"
    slug: str = "stripped"
    drops_tracks: bool = True

    def check_strength(self, strength: float) -> None:
        return None

    def apply(self, df: DataFrame) -> DataFrame:
        kept = df.filter((F.col("value") == "") | F.col("key").isin(*governance.TECHNICAL_KEYS))
        handler, own = F.col("key") == "handler_name", F.col("value").isin(*governance.HANDLERS)
        given = F.lit(None).cast("string")
        if "kind" in df.columns:
            for kind, value in governance.HANDLER_OF.items():
                given = F.when(F.col("kind") == kind, value).otherwise(given)
        else:
            given = F.when(own, F.col("value"))
        kept = kept.withColumn("value", F.when(F.col("key") == "language", "und").when(handler, given).otherwise(F.col("value")))
        return kept.filter("value IS NOT NULL")


@dataclass(frozen=True)
class Rotate:
    """Turns files by quarter turns clockwise: ``rotation`` (degrees, counted the other way round) gets less by as much."""

    degrees: int = 90
    name: str = "rotate"
    slug: str = "rotated"

    def check_strength(self, strength: float) -> None:
        return None

    def apply(self, df: DataFrame) -> DataFrame:
        if self.degrees % 90:
            raise ValueError(f"{self.degrees} degrees aren't quarter turns")
        return df.withColumn("rotation", maths.compose_rotation(F.col("rotation"), F.lit(self.degrees)))


for _make in (Stabilize, Offset, StripMetadata, Rotate):
    effects.register(_make().name, _make)


def output_names(files: DataFrame, chain: list[effects.Effect]) -> DataFrame:
    """``files`` (stem, extension) with the name that a chain's slugs give its output."""
    return files.withColumn("name", text.output_name(F.col("stem"), F.array(*[F.lit(s) for s in effects.slugs(chain)]), F.col("extension")))
