"""Feature layers: collections taken apart, polygons of features, attributes, validation, output columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classes
from ..sources import geojson
from . import features as feats


def attribute(properties: Column, name: str) -> Column:
    """The value of the first key, in key order, that equals ``name`` whatever its case."""
    hits = F.filter(F.array_sort(F.map_keys(properties)), lambda k: F.lower(k) == name.lower())
    return F.when(F.size(hits) > 0, F.element_at(properties, F.element_at(hits, 1)))


def simple(layer: DataFrame) -> DataFrame:
    """``layer`` (with type, geometry, kind, parts) with collections replaced by their members, to any depth, in order; other rows as they are."""
    done, rest = [], layer
    while True:
        nested = F.coalesce(F.col("type") == "GeometryCollection", F.lit(False))
        done.append(rest.filter(~nested))
        rest = rest.filter(nested)
        if rest.isEmpty():
            break
        member = F.explode(F.from_json(F.get_json_object("geometry", "$.geometries"), "array<string>"))
        kept = [c for c in layer.columns if c not in ("type", "geometry", "kind", "parts")]
        rest = rest.select(*kept, member.alias("geometry"))
        rest = rest.select(*kept, F.get_json_object("geometry", "$.type").alias("type"), "geometry", *geojson.parts_of("geometry")).select(*layer.columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def polygons_of(parts: Column) -> Column:
    """array of polygons (arrays of rings) of the rings of a polygon feature in file order: a ring that runs the other way than the first is a hole of the polygon before it."""
    turn = lambda r: F.signum(F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0.0), lambda s, k: s + F.element_at(r, k)["x"] * F.element_at(r, k + 1)["y"] - F.element_at(r, k + 1)["x"] * F.element_at(r, k)["y"]))
    none = F.slice(F.array(parts), 1, 0)
    first = turn(F.element_at(parts, 1))
    last = lambda acc, r: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.array(r))))
    return F.aggregate(parts, none, lambda acc, r: F.when((F.size(acc) > 0) & (turn(r) != first), last(acc, r)).otherwise(F.concat(acc, F.array(F.array(r)))))


def flatten(layer: DataFrame, class_col: Column | None = None) -> DataFrame:
    """(feature_idx, part, rings, fclass): each polygon of a feature with the feature's class (normalised, aliases not read); other shapes are dropped."""
    label = attribute(F.col("properties"), "fclass") if class_col is None else class_col
    areal = layer.filter(F.col("kind") == "polygon").select("feature_idx", classes.normalize(label).alias("fclass"), F.posexplode(polygons_of(F.col("parts"))).alias("part", "rings"))
    return areal.select("feature_idx", "part", "rings", "fclass")


def segments(layer: DataFrame) -> DataFrame:
    """(feature_idx, line, k, segment): the segments of each line of a feature, collections taken apart first."""
    lines = simple(layer).filter(F.col("kind") == "line").select("feature_idx", F.posexplode("parts").alias("line", "p"))
    return lines.select("feature_idx", "line", F.posexplode(F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("a"), F.slice("p", F.lit(2), F.size("p") - 1).alias("b"))).alias("k", "segment"))


def require_areal(layer: DataFrame) -> DataFrame:
    """``layer``, or an error if a feature is neither polygon nor multipolygon."""
    other = layer.filter(~F.coalesce(F.col("kind") == "polygon", F.lit(False))).select("feature_idx").limit(5).collect()
    if other:
        raise ValueError("features without an area: " + ", ".join(str(r[0]) for r in other))
    return layer


def require_water(layer: DataFrame) -> DataFrame:
    """``layer``, or an error if it has no feature or no feature has a class attribute."""
    known = layer.agg(F.count("*"), F.count_if(F.exists(F.map_keys("properties"), lambda k: F.lower(k) == "fclass"))).first()
    if not known[0]:
        raise ValueError("the water layer has no features")
    if not known[1]:
        raise ValueError("no feature of the water layer has an attribute fclass")
    return layer


def classified(layer: DataFrame, found: DataFrame, idx: str = "feature_idx") -> DataFrame:
    """``layer`` as the classification writes it: its columns but ``fclass``, a unique ``featureid`` (added if missing), the class of ``found`` (idx, fclass) last."""
    names = [c for c in layer.columns if c.lower() != "fclass"]
    d = layer.select(*[F.col(f"`{c}`") for c in names])
    if "featureid" in names:
        ids = feats.repair_ids(d.select(idx, F.col("featureid").alias("fid")), idx).select(idx, "featureid")
        d = d.drop("featureid").join(ids, idx)
    else:
        d, names = feats.missing_ids(d, idx), [*names, "featureid"]
    return d.join(found.select(idx, "fclass"), idx).select(*names, "fclass")
