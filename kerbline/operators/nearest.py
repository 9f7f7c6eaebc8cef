"""Exact k nearest points inside a radius, over cells sized by local density."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kerbline.functions import geo
from kerbline.session import written

KM_PER_DEGREE = geo.EARTH_RADIUS_KM * math.pi / 180
USUAL_LEVEL = 7  # density is read down to this level, deeper only where points crowd
DEEPEST_LEVEL = 20
CELL_STEPS = 2  # request cells are this many levels finer than the density level they fall under
NEIGHBOURS = tuple((dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1))


class Grid:
    """Nested cells. A level-0 cell is at least the radius wide both ways; each level halves the side.

    Longitude cells divide the full circle evenly, so blocks wrap at the date line.
    """

    def __init__(self, radius_km: float, max_abs_lat: float):
        margin = 1.001
        step = radius_km / KM_PER_DEGREE * margin
        top = min(89.0, max_abs_lat + step)
        shrink = math.cos(math.radians(top))
        self.lat_step = step
        self.columns = max(3, int(360.0 * shrink / (step * margin)))
        self.lng_step = 360.0 / self.columns
        self.widest = self.lng_step / step
        self.side_km = radius_km * margin
        # The far corner of a 3x3 block lies at most this many cells away from any point of its middle cell.
        self.corner = math.ceil(2 * math.sqrt(1 + self.widest ** 2) * margin)

    def half_diagonal(self, level: Column) -> Column:
        return F.lit(self.side_km * math.sqrt(1 + self.widest ** 2) / 2 * 1.001) / self._scale(level)

    def reach(self, level: Column) -> Column:
        """Cells to look at on each side: up to the far corner, or to the radius where that is nearer."""
        return F.least(F.lit(self.corner), self._scale(level).cast("int"))

    def middle(self, row: Column, col: Column, level: Column) -> tuple[Column, Column]:
        scale = self._scale(level)
        return ((row + 0.5) * self.lat_step / scale - 90.0, (col + 0.5) * self.lng_step / scale - 180.0)

    def row(self, lat: Column, level: Column | int) -> Column:
        return F.floor((lat + 90.0) / F.lit(self.lat_step) * self._scale(level)).cast("bigint")

    def col(self, lng: Column, level: Column | int) -> Column:
        return F.pmod(F.floor((lng + 180.0) / F.lit(self.lng_step) * self._scale(level)).cast("bigint"), self._width(level))

    def wrap(self, col: Column, level: Column) -> Column:
        return F.pmod(col, self._width(level))

    @staticmethod
    def _scale(level: Column | int) -> Column:
        return F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)

    def _width(self, level: Column | int) -> Column:
        return (F.lit(self.columns) * self._scale(level)).cast("bigint")


def max_abs_latitude(*sides: tuple[DataFrame, str]) -> float:
    """Largest absolute latitude over the sides, as one small aggregate."""
    stacked = None
    for df, column in sides:
        part = df.select(F.abs(F.col(column)).alias("v"))
        stacked = part if stacked is None else stacked.union(part)
    return float(stacked.agg(F.coalesce(F.max("v"), F.lit(0.0))).first()[0])


def parent(index: Column, steps: Column) -> Column:
    return F.floor(index / F.pow(F.lit(2.0), steps)).cast("bigint")


def density_level(spots: DataFrame, grid: Grid, k: int) -> int:
    """Level at which no cell holds more than a few times ``k`` points: one small aggregate over the points."""
    placed = spots.select("lat", "lng", F.explode(F.sequence(F.lit(USUAL_LEVEL), F.lit(DEEPEST_LEVEL))).alias("level"))
    crowd = (placed.groupBy("level", grid.row(F.col("lat"), F.col("level")).alias("row"), grid.col(F.col("lng"), F.col("level")).alias("col"))
             .count().groupBy("level").agg(F.max("count").alias("most")))
    found = crowd.filter(F.col("most") <= 4 * k).agg(F.min("level")).first()[0]
    return DEEPEST_LEVEL if found is None else found


def nearest(requests: DataFrame, points: DataFrame, radius_km: float, k: int, request_id: str = "trip_id",
            point_id: str = "driver_id", lat: str = "pickup_lat", lng: str = "pickup_lng",
            max_abs_lat: float | None = None) -> DataFrame:
    """The ``k`` nearest points (``lat``, ``lng``, ``point_id``) of each request, ties by id: (ids, km, geo_rank).

    Work is done per request *cell*, then per request:

    * density: the finest level whose 3x3 cells around a place hold ``k`` points bounds the k-th distance there;
    * shortlist: a small cell keeps the points not farther from its middle than its k-th one plus the cell's
      diagonal. By the triangle inequality nothing else can be among the ``k`` nearest of any request in it;
    * answer: each request is compared with its cell's shortlist only, about ``k`` points.

    The cells and shortlists are written once, so their sizes are known when Spark picks the joins.
    Points on the same spot are first cut to the ``k`` smallest ids, which no answer can miss.
    """
    if max_abs_lat is None:
        max_abs_lat = max_abs_latitude((requests, lat), (points, "lat"))
    grid = Grid(radius_km, max_abs_lat)
    spot = W.partitionBy("lat", "lng").orderBy(point_id)
    spots = (points.select(point_id, "lat", "lng").withColumn("_n", F.row_number().over(spot))
             .filter(F.col("_n") <= k).drop("_n"))
    deepest = density_level(spots, grid, k)
    finest = deepest + CELL_STEPS
    levels = F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("level")
    placed = spots.select("*", levels).select(point_id, "lat", "lng", "level", grid.row(F.col("lat"), F.col("level")).alias("row"),
                          grid.col(F.col("lng"), F.col("level")).alias("col"))
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in NEIGHBOURS]))
    dense = (placed.groupBy("level", "row", "col").agg(F.count(F.lit(1)).alias("n"))
             .select("level", "row", "col", "n", steps.alias("s"))
             .groupBy("level", (F.col("row") + F.col("s.dy")).alias("row"),
                      grid.wrap(F.col("col") + F.col("s.dx"), F.col("level")).alias("col"))
             .agg(F.sum("n").alias("n")).filter(F.col("n") >= k).select("level", "row", "col", F.lit(True).alias("_dense")))

    asked = requests.select(request_id, F.col(lat).alias("_lat"), F.col(lng).alias("_lng"),
                            grid.row(F.col(lat), finest).alias("_r"), grid.col(F.col(lng), finest).alias("_c"))
    up = F.lit(finest) - F.col("level")
    cell = ["cell_level", "cell_row", "cell_col"]
    cell_up = F.lit(finest - CELL_STEPS) - F.col("density")
    placed_cells = (asked.select("_r", "_c").distinct().select("*", levels)
                    .select("_r", "_c", "level", parent(F.col("_r"), up).alias("row"), parent(F.col("_c"), up).alias("col"))
                    .join(dense, ["level", "row", "col"], "left")
                    .groupBy("_r", "_c").agg(F.coalesce(F.max(F.when(F.col("_dense"), F.col("level"))), F.lit(0)).alias("density"))
                    .select("_r", "_c", (F.col("density") + CELL_STEPS).alias("cell_level"),
                            parent(F.col("_r"), cell_up).alias("cell_row"), parent(F.col("_c"), cell_up).alias("cell_col")))

    placed_cells = written(placed_cells, "request-cells")

    density = F.col("cell_level") - CELL_STEPS
    span = grid.reach(F.col("level"))
    window = (placed_cells.select(*cell).distinct()
              .select(*cell, density.alias("level"), parent(F.col("cell_row"), F.lit(CELL_STEPS)).alias("_br"),
                      parent(F.col("cell_col"), F.lit(CELL_STEPS)).alias("_bc"))
              .select("*", F.explode(F.sequence(-span, span)).alias("_dy"))
              .select("*", F.explode(F.sequence(-span, span)).alias("_dx"))
              .select(*cell, "level", (F.col("_br") + F.col("_dy")).alias("row"),
                      grid.wrap(F.col("_bc") + F.col("_dx"), F.col("level")).alias("col"))
              .distinct())
    mid_lat, mid_lng = grid.middle(F.col("cell_row"), F.col("cell_col"), F.col("cell_level"))
    half = grid.half_diagonal(F.col("cell_level"))
    met = (window.join(placed, ["level", "row", "col"])
           .select(*cell, point_id, "lat", "lng",
                   geo.haversine_km(mid_lat, mid_lng, F.col("lat"), F.col("lng"), clamp=True).alias("_mid_km"))
           .filter(F.col("_mid_km") <= F.lit(radius_km) + half))
    # The k-th middle distance of a cell: the rank bound lets Spark cut each cell to k rows before the shuffle.
    ranked = met.select(*cell, "_mid_km").withColumn("_n", F.row_number().over(W.partitionBy(*cell).orderBy("_mid_km")))
    kth = (ranked.filter(F.col("_n") <= k).groupBy(*cell)
           .agg(F.max(F.when(F.col("_n") == k, F.col("_mid_km"))).alias("_kth")))
    shortlist = (met.join(kth, cell)
                 .filter(F.col("_kth").isNull() | (F.col("_mid_km") <= F.col("_kth") + 2 * half))
                 .select(*cell, point_id, "lat", "lng"))

    km = geo.haversine_km(F.col("_lat"), F.col("_lng"), F.col("lat"), F.col("lng"))
    answers = (asked.join(placed_cells, ["_r", "_c"]).join(written(shortlist, "shortlist"), cell)
               .select(request_id, point_id, km.alias("km")).filter(F.col("km") <= radius_km))
    order = W.partitionBy(request_id).orderBy("km", point_id)
    return answers.withColumn("geo_rank", F.row_number().over(order)).filter(F.col("geo_rank") <= k)
