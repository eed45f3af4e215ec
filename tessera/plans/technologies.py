"""Technologies as pipelines of DataFrame steps, and the settings of a run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

Step = Callable[[DataFrame, "Settings"], DataFrame]


@dataclass(frozen=True)
class Settings:
    """A run's settings; a run never changes them."""

    sample: str
    markers: tuple[str, ...]
    technology: str
    image_type: str = "svs"
    resolution: str = "20x"
    tile: int = 1000
    registration_buffer: int = 150
    segmentation_buffer: int = 10
    noise_px: float = 5.0
    consensus_percent: float = 40.0
    tissue_percent: float = 15.0
    erosion_um: float = 20.0
    rbc_threshold: float = 0.30
    k: int = 7
    variance: float = 0.90

    def as_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, str(v)) for k, v in vars(self).items()], "name string, value string")


class Technology(Protocol):
    """What a technology provides: its steps from raw tables to cell metrics."""

    name: str
    chromogenic: bool  # stained with dyes: red blood cells go, intensities are shares of 255
    matched: bool  # cells are those found again in other stains (or cycles), not one image's

    def steps(self, settings: Settings) -> list[Step]: ...


@dataclass(frozen=True)
class StainTechnology:
    name: str
    chromogenic: bool
    matched: bool

    def steps(self, settings: Settings) -> list[Step]:
        from tessera.operators import aggregates

        def nucleated(px: DataFrame, s: Settings) -> DataFrame:
            return px.join(aggregates.keep_nucleated(px.where("comp = 'nuc'"), s.rbc_threshold).select("cell_id"), "cell_id", "left_semi")

        def profiled(px: DataFrame, s: Settings) -> DataFrame:
            return aggregates.profile(px, ["cell_id", "stain", "comp"], "v_aec", scale=255.0 if self.chromogenic else 1.0)

        return [nucleated, profiled] if self.chromogenic else [profiled]


TECHNOLOGIES: dict[str, Callable[[], Technology]] = {}
REVIEWS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def technology(name: str):
    """Register a technology's factory; it is called only when asked for."""

    def register(factory: Callable[[], Technology]):
        TECHNOLOGIES[name] = factory
        return factory

    return register


def review(name: str):
    """Register a review query (L4)."""

    def register(f: Callable[[DataFrame], DataFrame]):
        REVIEWS[name] = f
        return f

    return register


def run(settings: Settings, df: DataFrame) -> DataFrame:
    for step in TECHNOLOGIES[settings.technology]().steps(settings):
        df = step(df, settings)
    return df


#: Cyclic fluorescence matches the DNA channels of its cycles.
for _technology in (
    StainTechnology("micsss", chromogenic=True, matched=True),
    StainTechnology("tma", chromogenic=True, matched=True),
    StainTechnology("singleplex", chromogenic=True, matched=False),
    StainTechnology("if", chromogenic=False, matched=False),
    StainTechnology("cycif", chromogenic=False, matched=True),
):
    technology(_technology.name)(lambda t=_technology: t)
