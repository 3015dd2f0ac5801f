"""The ordered pixel passes that turn supersampled frames into sprites, as DataFrame transforms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.functions import color
from framequarry.operators import palette as PAL
from framequarry.operators import pixels as P
from framequarry.session import staged

DEFAULT_ORDER = ("downscale", "alphaThreshold", "posterize", "palette", "outline", "cleanup", "bleed")


@dataclass(frozen=True)
class Outline:
    colour: int
    side: str = "outside"
    width: int = 1
    connectivity: int = 8
    snap: bool = False


@dataclass(frozen=True)
class PixelSettings:
    supersample: int = 2
    downscale: str = "box"
    alpha_threshold: int = 128
    posterize: int | None = None
    palette: list[int] | int | None = None
    """A list is a fixed palette, a number the size of an automatic one."""
    palette_scope: str = "asset"
    dither: str = "none"
    dither_strength: float = 1.0
    outline: Outline | None = None
    orphans: str = "off"
    min_neighbours: int = 1
    bleed: bool = False
    order: tuple[str, ...] = DEFAULT_ORDER

    def __post_init__(self):
        size = len(self.palette) if isinstance(self.palette, list) else self.palette
        if size is not None and not 1 <= size <= color.MAX_PALETTE:
            raise ValueError(f"a palette holds 1 to {color.MAX_PALETTE} colours, got {size}")


@dataclass
class Sprites:
    """Frames on their way through the passes, and the palettes made for them."""

    pixels: DataFrame
    settings: PixelSettings
    palettes: DataFrame | None = None
    changed: DataFrame | None = None
    colours: list[int] | None = None
    scope: str = field(default="__all")


@dataclass(frozen=True)
class Pass:
    version: int
    description: str
    enabled: Callable[[PixelSettings], bool]
    run: Callable[[Sprites], Sprites]


PASSES: dict[str, Pass] = {}


def register_pass(name: str, version: int, description: str, enabled: Callable[[PixelSettings], bool] = lambda s: True):
    """Register a pass; it must keep frames dense and rows keyed by (frame, x, y)."""

    def add(fn):
        PASSES[name] = Pass(version, description, enabled, fn)
        return fn

    return add


def _with(sprites: Sprites, pixels: DataFrame) -> Sprites:
    return replace(sprites, pixels=pixels)


@register_pass("downscale", 2, "One pixel from every block of the supersampled frame.")
def _(s: Sprites) -> Sprites:
    shrink = P.mode_downscale if s.settings.downscale == "mode" else P.box_downscale
    return _with(s, shrink(s.pixels, s.settings.supersample))


@register_pass("alphaThreshold", 1, "Alpha becomes either clear or opaque.")
def _(s: Sprites) -> Sprites:
    return _with(s, P.threshold_alpha(s.pixels, s.settings.alpha_threshold))


@register_pass("posterize", 1, "Fewer levels for each channel.", lambda s: s.posterize is not None)
def _(s: Sprites) -> Sprites:
    return _with(s, P.posterize(s.pixels, s.settings.posterize))


@register_pass("palette", 1, "Every colour becomes its nearest in a given or computed palette.", lambda s: s.palette is not None)
def _(s: Sprites) -> Sprites:
    t = s.settings
    if isinstance(t.palette, list):
        return _with(s, PAL.map_to_palette(s.pixels, t.palette, t.dither, t.dither_strength))
    # An automatic palette reads every frame before the first is mapped. Only the palettes are staged; the passes before run once more.
    if t.palette_scope == "clip":
        palettes = staged(PAL.auto_palette(s.pixels, t.palette, "clip"))
        mapped = PAL.map_to_palettes(s.pixels, palettes, "clip", t.dither, t.dither_strength)
        return replace(s, pixels=mapped, palettes=palettes, scope="clip")
    palettes = staged(PAL.auto_palette(s.pixels.withColumn("__all", F.lit(0)), t.palette, "__all"))
    # One palette of at most 256 colours: as constants it needs no join.
    colours = [r.rgb for r in palettes.orderBy("idx").take(t.palette)]
    mapped = PAL.map_to_palette(s.pixels, colours, t.dither, t.dither_strength)
    return replace(s, pixels=mapped, palettes=palettes, colours=colours)


@register_pass("outline", 1, "A contour around the shape or on its rim.", lambda s: s.outline is not None)
def _(s: Sprites) -> Sprites:
    o, t = s.settings.outline, s.settings
    pixels, colour = s.pixels, o.colour
    fixed = t.palette if isinstance(t.palette, list) else s.colours
    if o.snap and fixed:
        colour = PAL.snap_colour(o.colour, fixed).cast("bigint")
    elif o.snap and s.palettes is not None:
        arrays = PAL.palette_arrays(s.palettes, s.scope)
        ink = arrays.select(s.scope, color.nearest_in(color.constant_oklab(o.colour), F.col("__pal"))["rgb"].alias("__ink"))
        if ink.limit(PAL.MAX_BROADCAST + 1).count() <= PAL.MAX_BROADCAST:
            ink = F.broadcast(ink)
        pixels = pixels.join(ink, s.scope, "left")
        colour = F.col("__ink")
    return _with(s, P.outline(pixels, o.side, o.width, o.connectivity, colour).drop("__ink"))


@register_pass("cleanup", 1, "Lone pixels go or take a neighbouring colour.", lambda s: s.orphans != "off")
def _(s: Sprites) -> Sprites:
    out = P.cleanup_orphans(s.pixels, s.settings.orphans, s.settings.min_neighbours, counts=True)
    return replace(s, pixels=out.drop("removed", "recoloured"), changed=out)


@register_pass("bleed", 1, "Colour under transparency, taken from the closest visible pixel.", lambda s: s.bleed)
def _(s: Sprites) -> Sprites:
    return _with(s, P.bleed_edges(s.pixels))


def pass_order(settings: PixelSettings) -> tuple[str, ...]:
    order = settings.order
    if not order or order[0] != "downscale" or "alphaThreshold" not in order:
        raise ValueError('passes must start with "downscale" and include "alphaThreshold"')
    if len(set(order)) != len(order):
        raise ValueError("a pass may appear once")
    unknown = [p for p in order if p not in PASSES]
    if unknown:
        raise ValueError(f"unknown passes: {', '.join(unknown)}")
    return tuple(p for p in order if PASSES[p].enabled(settings))


def pass_signature(settings: PixelSettings) -> list[str]:
    """The passes these settings run, as id@version; part of the stage's lineage key."""
    return [f"{p}@{PASSES[p].version}" for p in pass_order(settings)]


def process_frames(pixels: DataFrame, settings: PixelSettings) -> Sprites:
    """Run the enabled passes in order. A pass that is off is not in the plan.

    ``pixels`` should come partitioned by frame; only an automatic palette adds another exchange.
    """
    sprites = Sprites(pixels, settings)
    for name in pass_order(settings):
        sprites = PASSES[name].run(sprites)
    return sprites
