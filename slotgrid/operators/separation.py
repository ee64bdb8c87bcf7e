"""The widest separation of an entity's places without comparing all pairs: bounds on cells of space rule out nearly all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from .joins import lookup

RADIUS_KM = 6371.0088
#: Cells per radius of an entity's ball at each level, and the levels after which the rest is compared place by place.
SPLIT, MOST_LEVELS = 8, 6
#: Pairs of places left, for each place or in all, from which they are compared without further levels.
PAIRS, ALL_PAIRS = 4, 2_000_000
#: Slack of all bounds, in radii of the sphere: some micrometres.
SLACK = 1e-12


def distance_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance on a sphere of 6371.0088 km."""
    a = F.sin(F.radians(lat_b - lat_a) / 2) ** 2 + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.sin(F.radians(lon_b - lon_a) / 2) ** 2
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _apart(a: list[Column], b: list[Column]) -> Column:
    """Straight distance of two points."""
    return F.sqrt(sum((p - q) ** 2 for p, q in zip(a, b)))


def _columns(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def _cells(points: DataFrame, entity: str, level: int, parent: str | None) -> DataFrame:
    """`points` with `cell`, its cell of the given level; the hash of two cells may agree, which only widens their common box."""
    width = F.greatest(F.col("r"), F.lit(1e-300)) / SPLIT**level
    where = [F.floor((F.col(a) - F.col(f"c{a}")) / width) for a in "xyz"]
    return points.withColumn("cell", F.xxhash64(*where, *([parent] if parent else [])))


def _boxes(points: DataFrame, entity: str, keep: list[str]) -> DataFrame:
    """One row per cell: its number of places, the bounds of their coordinates, and one place in it."""
    bounds = [f(a).alias(f"{n}{a}") for a in "xyz" for f, n in ((F.min, "lo_"), (F.max, "hi_"))]
    return points.groupBy(entity, "cell", *keep).agg(F.count(F.lit(1)).alias("k"), *bounds, F.min(F.struct("x", "y", "z")).alias("one"))


def _side(boxes: DataFrame, entity: str, end: str, on: str) -> DataFrame:
    fields = [c for c in boxes.columns if c not in (entity, "cell", on)]
    return boxes.select(entity, *([F.col(on).alias(f"{on}_{end}")] if on else []), F.col("cell").alias(f"cell_{end}"), F.struct(*fields).alias(end))


def _reach() -> Column:
    """The largest distance that two places in the boxes `a` and `b` can have."""
    return F.sqrt(sum(F.greatest(F.abs(F.col(f"a.hi_{x}") - F.col(f"b.lo_{x}")), F.abs(F.col(f"b.hi_{x}") - F.col(f"a.lo_{x}"))) ** 2 for x in "xyz"))


def widest_separation(places: DataFrame, entity: str, lat: str, lon: str) -> DataFrame:
    """(entity, places, km): distinct coordinates of each entity and the largest great-circle distance between two; 0 for a single place.

    Places are points on a unit sphere, where a longer chord is a longer way. Two sweeps, from the middle of an entity's box and from the place
    farthest from it, give a distance that some pair has. Places too near to the middle to be in a wider pair go. The others are put
    into cells, and pairs of cells stay that could hold a wider pair; the surviving cells are split again, with the distance of a place of each as a new bound, until
    few pairs of places are left. The number of cells does not depend on that of the places, and nothing is left out that could be the
    widest pair. Rows without a coordinate take no part.
    """
    scratch = Scratch(places.sparkSession, "separation")
    phi, lam = F.radians(lat), F.radians(lon)
    known = places.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(entity, lat, lon).distinct()
    each = scratch.keep(known.withColumns({"x": F.cos(phi) * F.cos(lam), "y": F.cos(phi) * F.sin(lam), "z": F.sin(phi)}))
    point, middle = _columns("x", "y", "z"), _columns("cx", "cy", "cz")
    centres = scratch.keep(each.groupBy(entity).agg(F.count(F.lit(1)).alias("places"), *[((F.min(a) + F.max(a)) / 2).alias(f"c{a}") for a in "xyz"]))
    from_middle = lookup(each, centres, [entity], "inner").withColumn("d", _apart(point, middle))
    balls = scratch.keep(from_middle.groupBy(entity, "places", "cx", "cy", "cz").agg(F.max("d").alias("r"), F.max_by(F.struct("x", "y", "z"), "d").alias("f")))
    swept = lookup(each, balls, [entity], "inner").groupBy(entity).agg(F.max(_apart(point, _columns("f.x", "f.y", "f.z"))).alias("least"))
    balls = scratch.keep(balls.drop("f").join(swept, entity))
    outer = lookup(each, balls, [entity], "inner").where(_apart(point, middle) >= F.col("least") - F.col("r") - SLACK).drop("places")

    points = scratch.keep(_cells(outer, entity, 1, None))
    bounds = balls.select(entity, "least")
    boxes = scratch.keep(_boxes(points, entity, []))
    pairs = _side(boxes, entity, "a", "").join(_side(boxes, entity, "b", ""), entity).where("cell_a <= cell_b").join(bounds, entity)
    for level in range(2, MOST_LEVELS + 2):
        pairs = scratch.keep(pairs.where(_reach() >= F.col("least") - SLACK).drop("least"))
        # a place of each cell is a pair that exists
        seen = pairs.groupBy(entity).agg(F.max(_apart(_columns("a.one.x", "a.one.y", "a.one.z"), _columns("b.one.x", "b.one.y", "b.one.z"))).alias("seen"))
        bounds = scratch.keep(bounds.join(seen, entity).select(entity, F.greatest("least", "seen").alias("least")))
        pairs = scratch.keep(pairs.join(bounds, entity).where(_reach() >= F.col("least") - SLACK).select(entity, "cell_a", "cell_b", (F.col("a.k") * F.col("b.k")).alias("n")))
        todo = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        cells = pairs.select(entity, F.explode(F.array("cell_a", "cell_b")).alias("cell")).distinct()
        points = scratch.keep(points.join(cells, [entity, "cell"], "left_semi"))
        if level > MOST_LEVELS or todo <= max(ALL_PAIRS, PAIRS * points.count()):
            break
        points = _cells(points.withColumnRenamed("cell", "parent"), entity, level, "parent")
        boxes = scratch.keep(_boxes(points, entity, ["parent"]))
        points = points.drop("parent")
        split = pairs.select(entity, F.col("cell_a").alias("parent_a"), F.col("cell_b").alias("parent_b"))
        for end in "ab":
            split = split.join(_side(boxes, entity, end, "parent"), [entity, f"parent_{end}"])
        pairs = split.where("parent_a <> parent_b OR cell_a <= cell_b").join(bounds, entity)
    ends = [points.select(entity, F.col("cell").alias(f"cell_{n}"), F.col(lat).alias(f"lat_{n}"), F.col(lon).alias(f"lon_{n}")) for n in "ab"]
    met = pairs.join(ends[0], [entity, "cell_a"]).join(ends[1], [entity, "cell_b"])
    far = met.groupBy(entity).agg(F.max(distance_km(*_columns("lat_a", "lon_a", "lat_b", "lon_b"))).alias("km"))
    return centres.select(entity, "places").join(far, entity)
