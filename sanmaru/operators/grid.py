"""Grids: least squares between coordinate systems, places of bins, and reconciliation of grid sums with region totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sanmaru.functions.geo import bin_center, bin_key
from sanmaru.functions.numeric import half_up
from sanmaru.operators.cover import assign_regions
from sanmaru.session import written

#: A pivot under this share of its variance counts as none: the regressors hang together.
SINGULAR = 1e-12
#: Bounds of a fitting ratio, and how many of the worst are reported.
LOW, HIGH, WORST = 0.9, 1.1, 8


def least_squares(rows: DataFrame, regressors: list[str], targets: list[str]) -> DataFrame:
    """One row with ``n`` and, for each target t, ``t_0`` (constant) and ``t_x`` for each regressor x.

    One aggregation gathers means and centred moments; the normal equations are eliminated as expressions of that row.
    Rows that lack a finite value of any column are passed over. Coefficients are null if the regressors are linearly
    dependent or there are fewer rows than coefficients.
    """
    columns = [*regressors, *targets]
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    whole = rows.filter(F.forall(F.array(*map(finite, columns)), lambda f: f)).select(*[F.col(c).cast("double").alias(c) for c in columns])
    k = len(regressors)
    moments = {(i, j): F.covar_pop(x, y) for i, x in enumerate(regressors) for j, y in enumerate(columns) if j >= i}
    row = whole.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{i}") for i, c in enumerate(columns)], *[m.alias(f"m_{i}_{j}") for (i, j), m in moments.items()])
    variance = [F.col(f"v_{i}") for i in range(k)]
    row = row.select("*", *[F.col(f"m_{i}_{i}").alias(f"v_{i}") for i in range(k)])
    for p in range(k):  # the matrix stays symmetric below the pivot, so its upper half is kept
        sound = F.when(F.col(f"m_{p}_{p}") > SINGULAR * variance[p], F.col(f"m_{p}_{p}"))
        less = {(i, j): F.col(f"m_{i}_{j}") - F.col(f"m_{p}_{i}") * F.col(f"m_{p}_{j}") / sound for i, j in moments if i > p}
        row = row.withColumns({f"m_{i}_{j}": c for (i, j), c in less.items()} | {f"m_{p}_{p}": sound})
    for t in range(len(targets)):
        for p in reversed(range(k)):
            right = sum((F.col(f"m_{p}_{q}") * F.col(f"c_{t}_{q}") for q in range(p + 1, k)), F.lit(0.0))
            row = row.withColumn(f"c_{t}_{p}", F.when(F.col("n") > k, (F.col(f"m_{p}_{k + t}") - right) / F.col(f"m_{p}_{p}")))
    out = [F.col("n")]
    for t, target in enumerate(targets):
        out.append((F.col(f"mean_{k + t}") - sum(F.col(f"c_{t}_{p}") * F.col(f"mean_{p}") for p in range(k))).alias(f"{target}_0"))
        out += [F.col(f"c_{t}_{p}").alias(f"{target}_{x}") for p, x in enumerate(regressors)]
    return row.select(*out)


def affine_fit(points: DataFrame) -> DataFrame:
    """``n, lon_0, lon_x, lon_y, lat_0, lat_x, lat_y``: longitude and latitude of ``points(x, y, lon, lat)`` as affine functions of x and y."""
    return least_squares(points, ["x", "y"], ["lon", "lat"])


def bin_anchors(points: DataFrame, size: float, *values: str) -> DataFrame:
    """``bin, id, x, y, values``: of each bin of ``points(id, x, y, values)`` the member nearest to the bin's centre, ties to the smaller id."""
    binned = points.withColumn("bin", bin_key(F.col("x"), F.col("y"), size))
    cx, cy = bin_center(F.col("bin"), size)
    far = half_up(F.pow(F.col("x") - cx, F.lit(2)) + F.pow(F.col("y") - cy, F.lit(2)), 6)
    first = F.min_by(F.struct("id", "x", "y", *values), F.struct(far, F.col("id")))
    return binned.groupBy("bin").agg(first.alias("a")).select("bin", "a.*")


def shifted(anchor: dict[str, Column], x: Column, y: Column, axis: str) -> Column:
    """``axis`` (lon or lat) of a place from a near ``anchor`` and the fit's slopes, which are columns of the row."""
    return anchor[axis] + F.col(f"{axis}_x") * (x - anchor["x"]) + F.col(f"{axis}_y") * (y - anchor["y"])


def bin_places(points: DataFrame, size: float) -> DataFrame:
    """``bin, anchor, lon, lat``: the centre of each bin of ``points(id, x, y, lon, lat)``, from its anchor and the slopes of the affine fit.

    One affine function of the whole area is off at its ends; near an anchor only its slopes matter.
    """
    rows = bin_anchors(points, size, "lon", "lat").crossJoin(F.broadcast(affine_fit(points)))  # one row
    cx, cy = bin_center(F.col("bin"), size)
    anchor = {c: F.col(c) for c in ("x", "y", "lon", "lat")}
    return rows.select("bin", F.col("id").alias("anchor"), shifted(anchor, cx, cy, "lon").alias("lon"), shifted(anchor, cx, cy, "lat").alias("lat"))


def place_errors(points: DataFrame, size: float) -> DataFrame:
    """``n, worst_lon, worst_lat``: how far places from anchors are off for the members of all bins."""
    anchors = bin_anchors(points, size, "lon", "lat").select("bin", *[F.col(c).alias(f"a_{c}") for c in ("x", "y", "lon", "lat")])
    rows = points.withColumn("bin", bin_key(F.col("x"), F.col("y"), size)).join(anchors, "bin").crossJoin(F.broadcast(affine_fit(points)))
    anchor = {c: F.col(f"a_{c}") for c in ("x", "y", "lon", "lat")}
    off = lambda axis: F.max(F.abs(shifted(anchor, F.col("x"), F.col("y"), axis) - F.col(axis)))
    return rows.agg(F.count(F.lit(1)).alias("n"), off("lon").alias("worst_lon"), off("lat").alias("worst_lat"))


def grid_sums(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """``gid, value, lat, lng``: sums of ``rows(gid, value)`` with the place of their grid; no place if the grid isn't known. Null values count 0."""
    sums = rows.groupBy("gid").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"), F.count(F.lit(1)).alias("rows"))
    return sums.join(centroids.select("gid", "lat", "lng"), "gid", "left")


def reconcile(grids: DataFrame, totals: DataFrame, regions: DataFrame) -> DataFrame:
    """``code, grid, total, ratio, fits``: grid sums carried to regions by their places beside the regions' own totals.

    A full outer join: regions without grids or without a total (or a total of 0) have no ratio. The row with a null code
    holds what lies in no region.
    """
    placed = assign_regions(grids.filter("lat is not null").select(F.col("gid").alias("id"), "lat", "lng", "value"), regions)
    by_region = placed.groupBy(F.col("region_code").alias("code")).agg(F.sum("value").alias("grid"), F.count(F.lit(1)).alias("grids"))
    both = by_region.join(totals.select("code", "total"), "code", "full_outer")
    ratio = F.col("grid") / F.nullif(F.col("total").cast("double"), F.lit(0.0))
    return both.select("code", "grid", "grids", "total", ratio.alias("ratio"), ((ratio > LOW) & (ratio < HIGH)).alias("fits"))


def worst(reconciled: DataFrame, n: int = WORST) -> DataFrame:
    """The regions that fit least, worst first, ties by code."""
    return reconciled.filter("fits = false").orderBy(F.desc(F.abs(1 - F.col("ratio"))), "code").limit(n)


def reconciliation(grids: DataFrame, totals: DataFrame, regions: DataFrame) -> DataFrame:
    """One row: ``compared, fitting, share, outside_grids, outside_value, unplaced_rows, grid_total, region_total, ratio``."""
    rows = written(reconcile(grids, totals, regions))
    known = F.col("code").isNotNull()
    lost = grids.filter("lat is null").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("unplaced_rows"))
    sums = rows.agg(
        F.count("ratio").alias("compared"), F.count_if("fits").alias("fitting"), F.coalesce(F.sum(F.when(~known, F.col("grids"))), F.lit(0)).alias("outside_grids"),
        F.coalesce(F.sum(F.when(~known, F.col("grid"))), F.lit(0)).alias("outside_value"), F.sum(F.when(known, F.col("grid"))).alias("grid_total"), F.sum("total").alias("region_total"),
    )
    share = F.col("fitting") / F.nullif(F.col("compared"), F.lit(0))
    return sums.crossJoin(F.broadcast(lost)).withColumn("share", share).withColumn("ratio", F.col("grid_total") / F.nullif(F.col("region_total").cast("double"), F.lit(0.0)))
