"""Periodogram of series of any length, as grouped transforms of square-root size.

The transform of length n is a convolution with a chirp (Bluestein). The
convolution uses transforms of a power-of-two length M, each done as two rounds
of about sqrt(M) independent transforms of about sqrt(M) points, so no task
holds a whole series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions import columns as C
from lodestat.functions import ordering as O
from lodestat.operators import series as S
from lodestat.operators.describe import top_values


def _spec(df: DataFrame, keys: list[str], tail: str) -> str:
    parts = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys]
    return ", ".join([*parts, tail])


def _rounds(df: DataFrame, keys: list[str], combine: bool) -> DataFrame:
    """Transform rows ``(keys, n, m, j, ar, ai, br, bi)`` over index j.

    Index j = j1 * N2 + j2 becomes k = k1 + N1 * k2. With ``combine`` the two
    transforms are multiplied and conjugated, ready for the inverse.
    """
    tail = "n long, m int, j long, ar double, ai double, br double, bi double"
    mid = tail + ", k1 long, j2 long"

    def sizes(m):
        return 2 ** (m // 2), 2 ** (m - m // 2)

    def first(pdf):
        m = int(pdf["m"].iloc[0])
        n1, n2 = sizes(m)
        j2, n = int(pdf["j2"].iloc[0]), int(pdf["n"].iloc[0])
        j1 = (pdf["j"].to_numpy() // n2).astype("int64")
        out = {c: [pdf[c].iloc[0]] * n1 for c in keys}
        k1 = np.arange(n1)
        turn = np.exp(-2j * np.pi * j2 * k1 / (n1 * n2))
        res = pd.DataFrame({**out, "n": n, "m": m, "j": k1, "k1": k1, "j2": j2})
        for re, im in (("ar", "ai"), ("br", "bi")):
            v = np.zeros(n1, complex)
            np.add.at(v, j1, pdf[re].to_numpy() + 1j * pdf[im].to_numpy())
            t = np.fft.fft(v) * turn
            res[re], res[im] = t.real, t.imag
        return res

    def second(pdf):
        m = int(pdf["m"].iloc[0])
        n1, n2 = sizes(m)
        k1, n = int(pdf["k1"].iloc[0]), int(pdf["n"].iloc[0])
        j2 = pdf["j2"].to_numpy().astype("int64")
        k2 = np.arange(n2)
        got = []
        for re, im in (("ar", "ai"), ("br", "bi")):
            v = np.zeros(n2, complex)
            v[j2] = pdf[re].to_numpy() + 1j * pdf[im].to_numpy()
            got.append(np.fft.fft(v))
        if combine:
            got = [np.conj(got[0] * got[1]), np.zeros(n2, complex)]
        res = pd.DataFrame({**{c: [pdf[c].iloc[0]] * n2 for c in keys}, "n": n, "m": m, "j": k1 + n1 * k2})
        res["ar"], res["ai"], res["br"], res["bi"] = got[0].real, got[0].imag, got[1].real, got[1].imag
        return res

    half = F.shiftright(F.col("m") + 1, 1)
    cut = df.withColumn("j2", F.col("j") % F.pow(F.lit(2.0), half).cast("long"))
    one = cut.groupBy(*keys, "j2").applyInPandas(first, _spec(df, keys, mid))
    return one.groupBy(*keys, "k1").applyInPandas(second, _spec(df, keys, tail))


def power_spectrum(s: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., k, n, frequency, period, power)`` for the positive frequencies of the centred series."""
    mean = s.groupBy(*keys).agg(F.avg("y").alias("_m")) if keys else s.agg(F.avg("y").alias("_m"))
    rows = O.join_small(s, mean, keys, bounded=not keys).where("n_rows >= 4")
    n = F.col("n_rows")
    m = F.ceil(F.log2(2.0 * n - 1)).cast("int")
    angle = F.pi() * ((F.col("pos") * F.col("pos")) % (2 * n)) / n
    y = F.col("y") - F.col("_m")
    size = F.pow(F.lit(2.0), F.col("m")).cast("long")
    base = rows.select(*keys, n.alias("n"), m.alias("m"), F.col("pos").alias("p"), y.alias("y"), F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    zero = F.lit(0.0)
    signal = F.struct(
        F.col("p").alias("j"), (F.col("y") * F.col("c")).alias("ar"), (-F.col("y") * F.col("s")).alias("ai"), F.col("c").alias("br"), F.col("s").alias("bi")
    )
    mirror = F.struct((size - F.col("p")).alias("j"), zero.alias("ar"), zero.alias("ai"), F.col("c").alias("br"), F.col("s").alias("bi"))
    both = F.when(F.col("p") == 0, F.array(signal)).otherwise(F.array(signal, mirror))
    points = base.select(*keys, "n", "m", F.inline(both))
    back = _rounds(_rounds(points, keys, combine=True), keys, combine=False)
    # the final chirp has modulus one and the inverse divides by M: power needs no phase
    k = F.col("j")
    scale = F.pow(F.lit(2.0), F.col("m"))
    power = (F.col("ar") ** 2 + F.col("ai") ** 2) / (scale * scale)
    kept = back.where((k >= 1) & (2 * k < F.col("n")))
    return kept.select(*keys, k.alias("k"), "n", (k / F.col("n")).alias("frequency"), (F.col("n") / k).alias("period"), power.alias("power"))


def periodogram_peaks(s: DataFrame, keys: list[str], top: int = 5, chunk: int = O.CHUNK) -> DataFrame:
    """Local peaks of at least a tenth of the largest power, strongest first."""
    spec = power_spectrum(s, keys)
    spec = spec.withColumns({"pos": F.col("k") - 1, "n_rows": F.floor((F.col("n") - 1) / 2)})
    top_power = spec.groupBy(*keys).agg(F.max("power").alias("_max")) if keys else spec.agg(F.max("power").alias("_max"))
    h, w = O.with_halo(spec, keys, 1, 1, chunk=chunk)
    h = h.withColumns({"_before": F.lag("power").over(w), "_after": F.lead("power").over(w)})
    rows = O.join_small(O.drop_halo(h), top_power, keys, bounded=not keys)
    peak = (F.col("power") > F.col("_before")) & (F.col("power") > F.col("_after")) & (F.col("power") >= 0.1 * F.col("_max"))
    peaks = rows.where(peak).select(*keys, "k", "frequency", "period", "power", (F.col("power") / F.col("_max")).alias("relative_power"))
    return top_values(peaks, keys, top, [F.desc("power"), F.asc("k")])


def seasonality_strength(s: DataFrame, keys: list[str], period: int | None = None) -> DataFrame:
    """Larger of seasonal variance share and strongest relative peak, with level and type."""
    d = S.decompose(s, keys, period)
    share = (d.groupBy(*keys) if keys else d).agg(C.or_zero(C.ratio(F.var_pop("seasonal"), F.var_pop("y"))).alias("variance_ratio"))
    best = periodogram_peaks(s, keys, 1).select(*keys, F.col("relative_power").alias("_rel"), F.col("period").alias("dominant_period"))
    if keys:
        out = share.alias("l").join(best.alias("r"), O.same_keys("l", "r", keys), "left").select("l.*", "r._rel", "r.dominant_period")
    else:
        out = share.join(F.broadcast(best), F.lit(True), "left")
    rel = F.coalesce("_rel", F.lit(0.0))
    overall = F.greatest(F.col("variance_ratio"), rel)
    p = F.col("dominant_period")
    kind = (
        F.when(p.isNull(), "none").when(p.between(11, 13), "yearly").when(p.between(6, 8), "weekly").when(p.between(3, 5), "short_cycle").otherwise("custom")
    )
    level = C.bands(overall, [(0.6, "very_strong"), (0.4, "strong"), (0.2, "moderate"), (0.1, "weak")], "very_weak")
    return out.select(
        *keys, "variance_ratio", rel.alias("frequency_strength"), "dominant_period", overall.alias("overall"), level.alias("level"), kind.alias("type")
    )
