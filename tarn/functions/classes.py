"""Class names: normalisation, aliases, still water, edge and depth parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: class, spellings, default edge and depth, recommended ranges of both
TABLE = [
    ("stream", ("stream", "stream (溪流)", "溪流"), 1.0, 1.5, (0.5, 1.5), (0.2, 0.5)),
    ("dock", ("dock", "dock (船坞/码头)", "船坞", "码头"), 3.0, 5.0, (15.0, 75.0), (5.0, 18.0)),
    ("water", ("water", "water (通用水体)", "通用水体"), 5.0, 3.0, (5.0, 20.0), (1.0, 3.0)),
    ("river", ("river", "river (河流)", "河流"), 10.0, 2.8, (3.0, 20.0), (1.0, 3.0)),
    ("lake", ("lake", "lake (湖泊)", "湖泊"), 15.0, 4.5, (20.0, 200.0), (2.0, 10.0)),
    ("reservoir", ("reservoir", "reservoir (水库)", "水库"), 3.0, 6.0, (20.0, 100.0), (3.0, 8.0)),
    ("glacier", ("glacier", "glacier (冰川)", "冰川"), 10.0, 6.0, (10.0, 50.0), (5.0, 15.0)),
    ("sea", ("sea", "sea (海洋)", "海洋"), 15.0, 8.0, (500.0, float("inf")), (20.0, float("inf"))),
]
STILL_WATER = ("water", "lake", "reservoir", "glacier", "sea", "dock", "pond", "basin", "lagoon", "wetland")
MISSING = ("", "nan", "none")


def normalize(raw: Column) -> Column:
    """Trimmed lower case; empty, "nan" and "none" are null."""
    x = F.lower(F.trim(raw))
    return F.when(~x.isin(*MISSING), x)


def normalize_alias(raw: Column) -> Column:
    """The class that a spelling names, else null: trimmed, lower case, full-width brackets read as plain ones, nothing else forgiven."""
    x = F.translate(F.lower(F.trim(raw)), "（）", "()")
    out = F.lit(None).cast("string")
    for name, spellings, *_ in TABLE:
        out = F.when(x.isin(*spellings), name).otherwise(out)
    return out


def alias_of(text: str) -> str | None:
    """:func:`normalize_alias` of one Python string."""
    x = text.strip().lower().replace("（", "(").replace("）", ")")
    return next((name for name, spellings, *_ in TABLE if x in spellings), None)


def is_still_water(label: Column) -> Column:
    return F.coalesce(F.lower(F.trim(label)).isin(*STILL_WATER), F.lit(False))


def guidance(spark: SparkSession) -> DataFrame:
    """Defaults and recommended ranges of the eight classes; some defaults lie outside their range, as given."""
    rows = [(i, c, e, *er, d, *dr) for i, (c, _, e, d, er, dr) in enumerate(TABLE)]
    return spark.createDataFrame(rows, "ordinal int, fclass string, edgeexpand double, edge_least double, edge_most double, depth double, depth_least double, depth_most double")


def parameters(spark: SparkSession, overrides: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(fclass, edgeexpand, depth): eight rows. Overrides go by any spelling and are not held to the ranges; of an unknown class they are an error."""
    over = {}
    for name, pair in (overrides or {}).items():
        known = alias_of(name)
        if known is None:
            raise ValueError(f"unsupported class: {name}")
        over[known] = pair
    return spark.createDataFrame([(c, *over.get(c, (e, d))) for c, _, e, d, *_ in TABLE], "fclass string, edgeexpand double, depth double")


def parse_override(argument: str) -> tuple[str, float, float]:
    """``class:edge:depth`` of a command line."""
    parts = argument.split(":")
    if len(parts) != 3:
        raise ValueError(f"expected class:edge:depth, got {argument!r}")
    try:
        return parts[0], float(parts[1]), float(parts[2])
    except ValueError:
        raise ValueError(f"edge and depth must be numbers: {argument!r}") from None


def enrich(features: DataFrame, class_col: str = "fclass", overrides: dict | None = None) -> DataFrame:
    """``features`` with edgeexpand and depth of their class, replacing such columns."""
    f = features.drop("edgeexpand", "depth")
    p = F.broadcast(parameters(f.sparkSession, overrides)).withColumnRenamed("fclass", "__class")
    return f.join(p, normalize_alias(F.col(class_col)) == F.col("__class"), "left").drop("__class")


def unsupported(features: DataFrame, class_col: str = "fclass") -> DataFrame:
    """Distinct class texts that name no class."""
    return features.filter(normalize_alias(F.col(class_col)).isNull()).select(F.col(class_col).alias("fclass")).distinct()


def require_supported(features: DataFrame, class_col: str = "fclass") -> DataFrame:
    """``features``, or an error that lists the class texts that name no class, sorted."""
    found = sorted("<null>" if r[0] is None else r[0] for r in unsupported(features, class_col).limit(1000).collect())
    if found:
        raise ValueError("unsupported classes: " + ", ".join(found))
    return features
