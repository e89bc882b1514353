"""Operators on 1-D series (grp, seq, v); gaps are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill(s: DataFrame) -> DataFrame:
    """Forward, then backward fill."""
    w = Window.partitionBy("grp").orderBy("seq")
    return s.withColumn("v", F.coalesce(F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing))))


def median_filter(s: DataFrame, size: int) -> DataFrame:
    """Rank size // 2 of each window, reflected at the ends; series without gaps."""
    w = Window.partitionBy("grp")
    lo, hi = -(size // 2), size - 1 - size // 2
    n = F.count("*").over(w).cast("int")
    x = s.withColumn("n", n)
    k = F.explode(F.array_distinct(F.filter(F.flatten(F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda k: F.array(*[F.struct(t.alias("t"), k.alias("k")) for t in (F.col("seq") - k, -1 - F.col("seq") - k, 2 * F.col("n") - 1 - F.col("seq") - k)]))), lambda q: q["t"].between(0, F.col("n") - 1))))
    x = x.select("grp", "v", k.alias("q")).select("grp", F.col("q.t").alias("seq"), "v")
    return x.groupBy("grp", "seq").agg(F.element_at(F.array_sort(F.collect_list("v")), size // 2 + 1).alias("v"))


def _tops() -> Column:
    """Whether a sample is higher than both its neighbours; never beside a gap."""
    w = Window.partitionBy("grp").orderBy("seq")
    return F.coalesce((F.col("v") > F.lag("v").over(w)) & (F.col("v") > F.lead("v").over(w)), F.lit(False))


def local_maxima(s: DataFrame, plateaus: bool = True) -> DataFrame:
    """(grp, seq) of interior peaks; a plateau's is the floor of its middle. Gaps are left out.

    Without ``plateaus`` a peak is one sample higher than both its neighbours, and gaps stay in their place.
    """
    if not plateaus:
        return s.withColumn("__top", _tops()).filter("__top").select("grp", "seq", "v")
    w = Window.partitionBy("grp").orderBy("seq")
    x = s.filter("v IS NOT NULL").withColumn("new", F.coalesce((F.col("v") != F.lag("v").over(w)).cast("int"), F.lit(1)))
    x = x.withColumn("run", F.sum("new").over(w))
    runs = x.groupBy("grp", "run").agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.first("v").alias("v"))
    by = Window.partitionBy("grp").orderBy("run")
    runs = runs.withColumns({"before": F.lag("v").over(by), "after": F.lead("v").over(by)})
    return runs.filter("v > before AND v > after").select("grp", F.floor((F.col("a") + F.col("b")) / 2).cast("int").alias("seq"), "v")


def prominence(s: DataFrame, plateaus: bool = True) -> DataFrame:
    """(grp, seq, v, prominence): height over the higher of the two lowest points on the way to a higher sample or an end.

    Gaps are left out; one pass over each series. ``plateaus`` as for :func:`local_maxima`.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from tarn.operators.kernels import prominences

        pdf = pdf.sort_values("seq")
        seq, v = pdf["seq"].to_numpy(), pdf["v"].to_numpy(dtype=float)
        first, last, height = prominences(v)
        kept = pdf["top"].to_numpy(dtype=bool)[first]
        first, last, height = first[kept], last[kept], height[kept]
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "seq": (seq[first] + seq[last]) // 2, "v": v[first], "prominence": height})

    x = s.select("grp", "seq", "v", (F.lit(True) if plateaus else _tops()).alias("top"))
    return x.filter("v IS NOT NULL").groupBy("grp").applyInPandas(run, "grp long, seq int, v double, prominence double")


def isotonic(s: DataFrame, increasing: bool = False) -> DataFrame:
    """Least-squares monotone fit of each series (pool adjacent violators), gaps left as they are."""
    import pandas as pd

    sign = 1.0 if increasing else -1.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from tarn.operators.kernels import pava

        pdf = pdf.sort_values("seq")
        ok = pdf["v"].notna().to_numpy()
        v = pdf["v"].to_numpy(dtype=float, na_value=float("nan"), copy=True)
        if ok.sum() > 1:
            v[ok] = sign * pava(sign * v[ok])
        return pdf.assign(v=v)[["grp", "seq", "v"]]

    return s.select("grp", "seq", "v").groupBy("grp").applyInPandas(run, "grp long, seq int, v double")


def multi_peak(s: DataFrame) -> DataFrame:
    """Monotone between anchors (ends and prominent peaks); see ``kernels.multi_peak``."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from tarn.operators.kernels import multi_peak as fit

        pdf = pdf.sort_values("seq")
        return pdf.assign(v=fit(pdf["v"].to_numpy(dtype=float, na_value=float("nan"))))[["grp", "seq", "v"]]

    return s.select("grp", "seq", "v").groupBy("grp").applyInPandas(run, "grp long, seq int, v double")


def first_occurrences(s: DataFrame) -> DataFrame:
    """(grp, seq, key): the first row of each key in a series."""
    return s.groupBy("grp", "key").agg(F.min("seq").alias("seq")).select("grp", "seq", "key")


def finite_mean(s: DataFrame) -> DataFrame:
    """(grp, mean) over finite values; null without any."""
    finite = F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v"))
    return s.groupBy("grp").agg(F.avg(finite).alias("mean"))
