"""Feature ids, geometry measures, binned spatial joins and semantic classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order

ID_BASE = 30_000_000
CHUNK = 4096
PRIORITY = ("sea", "lake", "glacier", "reservoir", "dock", "river", "stream")
LEAST_LENGTH, LEAST_SHARE = 20.0, 0.2


def normalize_id(x: Column) -> Column:
    t = F.trim(x.cast("string"))
    return F.when(t != "", t)


def missing_ids(features: DataFrame, idx: str = "idx") -> DataFrame:
    """Ids for a table without any: the base and the row's ordinal."""
    return order.numbered(features, idx, "__n").withColumn("featureid", (F.lit(ID_BASE - 1) + F.col("__n")).cast("string")).drop("__n")


def repair_ids(features: DataFrame, idx: str = "idx", fid: str = "fid") -> DataFrame:
    """``features`` with ``featureid``: the first row of an id keeps it; the others take, in row order, the next numbers from the base whose text is no row's id.

    Ids are compared as text, so "030000000" does not use up 30000000. Positions come from bucketed sums (:mod:`.order`);
    the used ids at or above the base are joined, not collected.
    """
    f = features.withColumn("__id", normalize_id(F.col(fid)))
    least = f.filter("__id IS NOT NULL").groupBy("__id").agg(F.min(idx).alias("__first"))
    f = f.join(least, "__id", "left").withColumn("__keep", F.coalesce(F.col("__first") == F.col(idx), F.lit(False)))
    k = order.numbered(f.filter(~F.col("__keep")).select(idx), idx, "at").withColumn("n", F.lit(0).cast("long"))
    number = F.expr("try_cast(__id AS bigint)")
    used = least.select(number.alias("u"), "__id").filter((F.col("u") >= ID_BASE) & (F.col("u").cast("string") == F.col("__id"))).select("u")
    # the k-th unused number is base + k - 1 + (used numbers before it): used number u_i shifts those from rank u_i - base - i + 1 on
    used = order.numbered(used, "u", "__i")
    shift = used.groupBy((F.col("u") - ID_BASE - F.col("__i") + 2).alias("at")).agg(F.count("*").alias("n"))
    marks = k.select("at", idx, "n").unionByName(shift.select("at", F.lit(None).cast(features.schema[idx].dataType).alias(idx), "n"))
    new = order.running(marks, "at", [F.col(idx).isNotNull()], F.col("n"), "s").filter(F.col(idx).isNotNull())
    out = f.join(new.select(idx, (F.col("at") + ID_BASE - 1 + F.col("s")).cast("string").alias("__new")), idx, "left")
    return out.withColumn("featureid", F.coalesce("__new", "__id")).drop("__id", "__first", "__keep", "__new")


def measures(rings: DataFrame) -> DataFrame:
    """(poly, minx, miny, maxx, maxy, area, cx, cy) of single closed rings, by the shoelace sums."""
    e = rings.select("poly", F.posexplode("ring").alias("k", "p")).select("poly", "k", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    w = Window.partitionBy("poly").orderBy("k")
    e = e.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)}).withColumn("q", F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))
    g = e.groupBy("poly").agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"), (F.sum("q") / 2).alias("a"), F.sum((F.col("x") + F.col("x2")) * F.col("q")).alias("sx"), F.sum((F.col("y") + F.col("y2")) * F.col("q")).alias("sy"))
    return g.select("poly", "minx", "miny", "maxx", "maxy", F.abs("a").alias("area"), (F.col("sx") / (6 * F.col("a"))).alias("cx"), (F.col("sy") / (6 * F.col("a"))).alias("cy"))


def alike(rows: DataFrame, *by: str) -> DataFrame:
    """Rows with equal ``by`` as one: those columns and ``ids``, the array of their ids, at most ``CHUNK`` in a row.

    What holds for one of them is then worked out once; :func:`apart` gives each id its row again.
    """
    return _lists(rows, *by).drop("__n")


def _lists(rows: DataFrame, *by: str) -> DataFrame:
    """(by, __n, ids): as :func:`alike`, the lists of equal ``by`` numbered from 0; null ids stand apart under the number of a list."""
    w = Window.partitionBy(*by).orderBy("id")
    d = rows.select("id", *by).withColumn("__n", F.floor((F.row_number().over(w) - 1) / CHUNK))
    # a list leaves nulls out, so they are counted
    d = d.groupBy(*by, "__n", F.col("id").isNull().alias("__none")).agg(F.collect_list("id").alias("ids"), F.count("*").cast("int").alias("__c"))
    none = F.array_repeat(F.lit(None).cast(rows.schema["id"].dataType), F.col("__c"))
    return d.select(*by, "__n", F.when(F.col("__none"), none).otherwise(F.col("ids")).alias("ids"))


def apart(pairs: DataFrame, left: str, right: str, *values: str) -> DataFrame:
    """(left, right, values) of every pair of ids that rows (l_ids, r_ids, values) stand for."""
    return pairs.select(F.explode("r_ids").alias(right), "l_ids", *values).select(F.explode("l_ids").alias(left), right, *values)


def paired(pairs: DataFrame, left_rows: DataFrame, right_rows: DataFrame, left: str, right: str, *values: str) -> DataFrame:
    """(left, right, values) of every two ids of rows (id, shape) whose shapes are one of the pairs (l_shape, r_shape, values).

    The pairs are of different shapes and meet the ids only here. Work is spread by lists of the right side, so that a shape
    of very many rows is no single task. The lambda keeps the outer explode out of generated code: nested there, both
    would hold all pairs of two lists in memory before a row goes on.
    """
    spark = pairs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    lists = lambda d, p: _lists(d, "shape").select(F.col("shape").alias(p + "shape"), F.col("__n").alias(p + "n"), F.col("ids").alias(p + "ids"))
    numbers = F.sequence(F.lit(0).cast("long"), F.floor((F.count("*") - 1) / CHUNK))
    numbers = right_rows.groupBy(F.col("shape").alias("r_shape")).agg(F.explode(numbers).alias("r_n"))
    p = pairs.join(numbers, "r_shape").join(lists(left_rows, "l_"), "l_shape").repartition(tasks, "r_shape", "r_n")
    p = p.join(lists(right_rows, "r_").repartition(tasks, "r_shape", "r_n"), ["r_shape", "r_n"])
    return p.select(F.explode(F.transform("l_ids", lambda x: x)).alias(left), "r_ids", *values).select(left, F.explode("r_ids").alias(right), *values)


def contains(rings: DataFrame, points: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(poly, id) pairs already matched by box, as (poly, id, x, y), that lie inside: crossings to the right are odd. ``carry`` names more columns of ``points`` to keep."""
    e = F.transform(F.sequence(F.lit(1), F.size("ring") - 1), lambda k: F.struct(F.element_at("ring", k).alias("a"), F.element_at("ring", k + 1).alias("b")))
    j = points.join(rings, "poly")
    crosses = lambda q: ((q["a"]["y"] <= F.col("y")) != (q["b"]["y"] <= F.col("y"))) & (F.col("x") < q["a"]["x"] + (F.col("y") - q["a"]["y"]) * (q["b"]["x"] - q["a"]["x"]) / (q["b"]["y"] - q["a"]["y"]))
    return j.filter(F.size(F.filter(e, crosses)) % 2 == 1).select("poly", "id", *carry)


def box_join(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs (both boxes and all other columns, as l_* and r_*) of closed boxes (minx, miny, maxx, maxy and any others) that meet.

    Each box has a level: cells of ``cell`` times a power of two, no smaller than the box, so it lies in four of them at most,
    however large it is. It is filed at its level and, to meet larger boxes of the other side, at each coarser level that
    these have. A pair is taken at the coarser of its levels in the one cell that holds its common lower corner, so there
    is nothing to dedupe, and two small boxes never meet in a coarse cell. Cells are spread over a fixed number of tasks:
    few boxes may stand for very many pairs.
    """
    names = [list(d.columns) for d in (left, right)]
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    extent = lambda: F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"), F.lit(cell))
    own_level = lambda d: d.withColumn("level", F.ceil(F.log2(extent() / cell)).cast("int"))
    left, right = own_level(left), own_level(right)
    levels = [sorted(r[0] for r in d.select("level").distinct().collect() if r[0] is not None) for d in (left, right)]  # a few dozen numbers

    def filed(d, p, at):
        size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("at"))
        d = d.withColumn("at", at).select(*[F.col(c).alias(p + c) for c in names[p == "r_"]], "at", size.alias(p + "size"))
        span = lambda a, b: F.explode(F.sequence(F.floor(F.col(p + a) / F.col(p + "size")), F.floor(F.col(p + b) / F.col(p + "size"))))
        return d.withColumn("bx", span("minx", "maxx")).withColumn("by", span("miny", "maxy")).repartition(tasks, "at", "bx", "by")

    def above(d, p, others):
        coarser = F.explode(F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > F.col("level")))
        return filed(d, p, coarser)

    lo = lambda c: F.greatest("l_" + c, "r_" + c)
    meets = (lo("minx") <= F.least("l_maxx", "r_maxx")) & (lo("miny") <= F.least("l_maxy", "r_maxy"))
    own = (F.floor(lo("minx") / F.col("l_size")) == F.col("bx")) & (F.floor(lo("miny") / F.col("l_size")) == F.col("by"))
    l_own, r_own = filed(left, "l_", F.col("level")), filed(right, "r_", F.col("level"))
    out = None
    for a, b in ((l_own, r_own), (l_own, above(right, "r_", levels[0])), (above(left, "l_", levels[1]), r_own)):
        j = a.join(b, ["at", "bx", "by"]).filter(meets & own).drop("at", "bx", "by", "l_size", "r_size")
        out = j if out is None else out.unionByName(j)
    return out


def classify(boxes: DataFrame, areas: DataFrame, lines: DataFrame, cell: float = 16.0, least_length: float = LEAST_LENGTH, least_share: float = LEAST_SHARE) -> DataFrame:
    """(id, fclass, reason) of boxes by reference boxes (layer) and axis-parallel reference segments (layer, as flat boxes).

    An area hits if it holds the centre or covers ``least_share`` of the box by itself; a line if ``least_length``
    of it lies inside. The first class in priority order wins; none: ``water``.
    """
    box = ("minx", "miny", "maxx", "maxy")
    w, h = F.least("l_maxx", "r_maxx") - F.greatest("l_minx", "r_minx"), F.least("l_maxy", "r_maxy") - F.greatest("l_miny", "r_miny")
    # what hits a box depends on nothing else, so equal boxes are joined as one
    boxes = boxes.select("id", F.struct(*box).alias("box"))
    own_boxes, areas, lines = boxes.select("box").distinct().select("box", "box.*"), areas.select("layer", *box).distinct(), lines.select("layer", *box).distinct()
    hit = lambda j, how: j.select(F.col("l_box").alias("box"), ranked(F.col("r_layer"), how).alias("p"))
    a = box_join(own_boxes, areas, cell)
    cx, cy = (F.col("l_minx") + F.col("l_maxx")) / 2, (F.col("l_miny") + F.col("l_maxy")) / 2
    centre = (cx > F.col("r_minx")) & (cx < F.col("r_maxx")) & (cy > F.col("r_miny")) & (cy < F.col("r_maxy"))
    own = (F.col("l_maxx") - F.col("l_minx")) * (F.col("l_maxy") - F.col("l_miny"))
    a = hit(a.filter((own > 0) & (centre | (w * h / own >= least_share))), "_polygon")
    li = hit(box_join(own_boxes, lines, cell).filter(F.greatest(w, h) >= least_length), "_line")
    return decided(boxes, a.unionByName(li), "box")


def ranked(layer: Column, how: str) -> Column:
    """The rank of a hit: by class, then lines before polygons; null for other classes."""
    at = F.array_position(F.array(*map(F.lit, PRIORITY)), layer)
    return F.when(at > 0, 2 * at + (1 if how == "_polygon" else 0)).cast("int")


def decided(rows: DataFrame, hits: DataFrame, by: str) -> DataFrame:
    """(id, fclass, reason) of rows (id, by) by the least rank ``p`` of the hits (by, p) of their shape."""
    best = rows.join(hits.groupBy(by).agg(F.min("p").alias("p")), by).groupBy("id").agg(F.min("p").alias("p"))
    layer = F.get(F.array(*map(F.lit, PRIORITY)), F.floor(F.col("p") / 2).cast("int") - 1)
    reason = F.concat(layer, F.when(F.col("p") % 2 == 1, "_polygon").otherwise("_line"))
    return rows.select("id").join(best, "id", "left").select("id", F.coalesce(layer, F.lit("water")).alias("fclass"), F.coalesce(reason, F.lit("fallback")).alias("reason"))
