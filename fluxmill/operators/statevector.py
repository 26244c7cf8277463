"""State vectors: numbering of cells, regions of interest, and clustering of elements."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: radius in metres of the sphere of clustering features.
RADIUS = 6378137.0


def number_cells(cells: DataFrame, descending: bool = True) -> DataFrame:
    """Labels 1..n by row and column; ``descending`` gives the first cell the last label.

    Counts by row give each row's start, so cells are numbered within rows and
    not in one sorted partition.
    """
    rows = cells.groupBy("j").agg(F.count("*").alias("n"))
    start = F.sum("n").over(Window.orderBy("j").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.select("j", F.coalesce(start, F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    order = F.col("before") + F.row_number().over(Window.partitionBy("j").orderBy("i"))
    return cells.join(starts, "j").withColumn("label", (F.col("all") + 1 - order if descending else order).cast("long")).drop("before", "all")


#: A cell below the threshold, and the latitudes that a global state vector keeps.
UNUSED, GLOBAL_LATITUDES = -9999.0, (-60.0, 88.0)


def threshold_cells(cells: DataFrame, emission: float, land: float) -> DataFrame:
    """Cells with enough emissions or land; others have no label."""
    return cells.withColumn("used", (F.coalesce("flux", F.lit(0.0)) >= emission) | (F.coalesce("land", F.lit(0.0)) >= land))


def masked_emissions(cells: DataFrame, threshold: float, whole_globe: bool = False) -> DataFrame:
    """Emissions below the threshold set to ``UNUSED``; on the whole globe only cells of the kept latitudes stay."""
    rows = cells.filter(F.col("lat").between(*GLOBAL_LATITUDES)) if whole_globe else cells
    return rows.withColumn("flux", F.when(F.col("flux") < threshold, UNUSED).otherwise(F.col("flux")))


def contained(region: tuple[float, float, float, float], cells: DataFrame) -> None:
    """Raises unless the region (west, east, south, north) lies within the cells' extent."""
    e = cells.agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n")).first()
    if e["w"] is None or region[0] < e["w"] or region[1] > e["e"] or region[2] < e["s"] or region[3] > e["n"]:
        raise ValueError(f"the region {region} reaches beyond the land cover's {tuple(e)}")


def aligned(cells: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """``cells`` with columns of another grid's cells at the same place; places are equal to 4 digits."""
    key = lambda df: df.withColumns({"_y": F.bround("lat", 4), "_x": F.bround("lon", 4)})
    return key(cells).join(key(other).select("_y", "_x", *columns), ["_y", "_x"]).drop("_y", "_x")


def subset(labels: DataFrame, grid: DataFrame, value: str) -> DataFrame:
    """``labels`` with the value of ``grid`` at each of their places; a place that the grid lacks raises."""
    out = labels.join(grid.select("lat", "lon", F.col(value).alias("_v"), F.lit(True).alias("_there")), ["lat", "lon"], "left")
    known = F.when(F.col("_there"), F.col("_v")).otherwise(F.raise_error(F.lit("the grid lacks a cell of the state vector")).cast("double"))
    return out.withColumn(value, known).drop("_v", "_there")


#: The most cells of one element, by resolution in degrees or cells of a cube's edge.
LARGEST = {"0.125x0.15625": 128, "0.25x0.3125": 64, "0.5x0.625": 32, "2.0x2.5": 16, "4.0x5.0": 8, "720": 128, "360": 64, "180": 32, "90": 16, "48": 8, "24": 4}
#: Steps of latitude and longitude.
STEPS = {name: tuple(map(float, name.split("x"))) for name in LARGEST if "x" in name}


def largest_cluster(resolution: str, n_cells: int, wanted: int, largest: int | None = None) -> int:
    """The most cells of one element; raises if ``wanted`` elements of that size can't hold all cells."""
    size = largest or LARGEST[resolution]
    if -(-n_cells // size) > wanted:
        raise ValueError(f"{wanted} elements of {size} cells can't hold {n_cells} cells: more elements or larger clusters are needed")
    return size


def forced_coordinates(points: DataFrame, n_elements: int) -> DataFrame:
    """Distinct (lat, lon), the greatest first; all but the last n_elements - 1 are left out where there are more than elements."""
    distinct = points.select("lat", "lon").distinct()
    if distinct.count() > n_elements:
        return distinct.orderBy(F.desc("lat"), F.desc("lon")).limit(n_elements - 1)
    return distinct


def force_native(cells: DataFrame, points: DataFrame, resolution: str, threshold: float | None = None) -> DataFrame:
    """Sensitivities of cells that hold a point, raised over the threshold (1 by default) so that they stay alone."""
    dlat, dlon = STEPS[resolution]
    index = lambda c, step: F.floor(F.col(c) / step + 1e-9).alias(f"_{c}")
    held = points.select(index("lat", dlat), index("lon", dlon)).distinct().withColumn("_forced", F.lit(True))
    out = cells.select("*", index("lat", dlat), index("lon", dlon)).join(held, ["_lat", "_lon"], "left")
    value = 1.0 if threshold is None else threshold
    return out.withColumn("sensitivity", F.when(F.col("_forced"), value + 0.1).otherwise(F.col("sensitivity"))).drop("_lat", "_lon", "_forced")


def split_buffer(cells: DataFrame, n_buffer: int) -> DataFrame:
    """roi_label and buffer_label of ``cells(label)``: the last ``n_buffer`` labels are the buffer's; 0 where a cell is not of the kind."""
    edge = cells.agg((F.max("label") - n_buffer).alias("_edge"))
    inside = F.col("label") <= F.col("_edge")
    return cells.join(F.broadcast(edge)).withColumns({"roi_label": F.when(inside, F.col("label")).otherwise(0), "buffer_label": F.when(inside, 0).otherwise(F.col("label"))}).drop("_edge")


def shift_buffer(cells: DataFrame, by: int) -> DataFrame:
    """Buffer labels lowered by ``by``; 0 stays."""
    return cells.withColumn("buffer_label", F.when(F.col("buffer_label") != 0, F.col("buffer_label") - by).otherwise(0))


def top_clusters(cells: DataFrame, threshold: float, n: int | None = None) -> DataFrame:
    """(label, sensitivity, n_cells) of the clusters whose sensitivities sum to the threshold; with ``n`` only the most sensitive n, the least label on ties."""
    out = cells.filter("label >= 1").groupBy("label").agg(F.sum("sensitivity").alias("sensitivity"), F.count("*").alias("n_cells")).filter(F.col("sensitivity") >= threshold)
    return out if n is None else out.orderBy(F.desc("sensitivity"), "label").limit(n)


def last_roi_element(cells: DataFrame, rings: int, extra: int = 4) -> DataFrame:
    """The largest label within the grid less ``rings + extra`` cells on each side."""
    edge = cells.agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))
    k = rings + extra
    inner = F.col("i").between(F.col("i0") + k, F.col("i1") - k) & F.col("j").between(F.col("j0") + k, F.col("j1") - k)
    return cells.join(F.broadcast(edge)).filter(inner).agg(F.max("label").alias("last"))


def cluster_buffer(cells: DataFrame, offset: int, divisor: int = 4, clusters: int | None = None, seed: int = 0) -> DataFrame:
    """Buffer cells in n // divisor clusters by place, numbered after ``offset``."""
    k = max(2, clusters or cells.count() // divisor)
    rows = VectorAssembler(inputCols=["lon", "lat"], outputCol="_f").transform(cells)
    model = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="_c").fit(rows)
    return model.transform(rows).withColumn("label", F.col("_c") + 1 + offset).drop("_f", "_c")


def make_state_vector(cells: DataFrame, emission: DataFrame, region: tuple[float, float, float, float] | None, buffer: tuple[float, float] = (0.0, 0.0), trim: tuple[float, float] = (0.0, 0.0), threshold: float = 0.0, divisor: int = 4, seed: int = 0) -> DataFrame:
    """(cell_id, i, j, lat, lon, label, kind): the native state vector of a region (west, east, south, north), or of the whole globe for None.

    ``cells(cell_id, i, j, lat, lon)`` is the land cover's grid and ``emission(
    cell_id, flux)`` the mean emissions with the soil sink's magnitude. The
    domain is the region and ``buffer`` degrees of longitude and latitude around
    it, as far as there are cells. Cells within ``trim`` of its edge, which are
    not advected, and those below the threshold are ``unused``, without a label;
    missing emissions are below nothing. The region's other cells are numbered
    from the last, and what is left around it is clustered by place into a
    ``divisor``-th as many elements, whose labels follow. On the whole globe
    there is no buffer, and cells beyond the kept latitudes are left out.
    """
    rows = cells.join(emission.select("cell_id", "flux"), "cell_id", "left")
    low = F.coalesce(F.col("flux") < threshold, F.lit(False))
    if region is None:
        rows = rows.filter(F.col("lat").between(*GLOBAL_LATITUDES)).withColumn("kind", F.when(low, "unused").otherwise("roi"))
    else:
        contained(region, cells)
        west, east, south, north = region
        e = cells.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
        x0, x1 = max(west - buffer[0], e[0]), min(east + buffer[0], e[1])
        y0, y1 = max(south - buffer[1], e[2]), min(north + buffer[1], e[3])
        edge = (F.col("lon") < x0 + trim[0]) | (F.col("lon") > x1 - trim[0]) | (F.col("lat") < y0 + trim[1]) | (F.col("lat") > y1 - trim[1])
        inside = F.col("lon").between(west, east) & F.col("lat").between(south, north)
        rows = rows.filter(F.col("lon").between(x0, x1) & F.col("lat").between(y0, y1))
        rows = rows.withColumn("kind", F.when(edge | low, "unused").when(inside, "roi").otherwise("buffer"))
    names = ["cell_id", "i", "j", "lat", "lon"]
    roi = number_cells(rows.filter("kind = 'roi'").select(*names)).select(*names, F.col("label").cast("long").alias("label"), F.lit("roi").alias("kind"))
    unused = rows.filter("kind = 'unused'").select(*names, F.lit(None).cast("long").alias("label"), "kind")
    around = rows.filter("kind = 'buffer'").select(*names)
    n = around.count()
    if not n:
        return roi.unionByName(unused)
    k, last = n // divisor, roi.count()
    grouped = cluster_buffer(around, last, divisor, seed=seed) if k > 1 else around.withColumn("label", F.lit(last + 1))
    return roi.unionByName(unused).unionByName(grouped.select(*names, F.col("label").cast("long").alias("label"), F.lit("buffer").alias("kind")))
