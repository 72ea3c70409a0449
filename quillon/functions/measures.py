"""Association and keyness measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cell(o: Column, e: Column) -> Column:
    return F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0)


def association(name: str, o: Column, f: Column, g: Column, n: Column) -> Column:
    """o: seen together; f: size of the window; g: corpus frequency; n: size of the corpus. Unknown names are logdice."""
    o, f, g, n = (c.cast("double") for c in (o, f, g, n))
    e = f * g / n
    dice = 2 * o / (f + g)
    if name == "ll":
        b, c = F.greatest(f - o, F.lit(0.0)), F.greatest(g - o, F.lit(0.0))
        d = F.greatest(n - f - g + o, F.lit(0.0))
        return 2 * (_cell(o, e) + _cell(b, f * (n - g) / n) + _cell(c, (n - f) * g / n) + _cell(d, (n - f) * (n - g) / n))
    return {"mi": F.log2(o / e), "mi3": F.log2(o * o * o / e), "t": (o - e) / F.sqrt(o), "tscore": (o - e) / F.sqrt(o), "dice": dice}.get(name, 14 + F.log2(dice))


def keyness(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Two-cell log-likelihood; negative where the word is rarer in the focus than in the reference."""
    a, b, na, nb = (c.cast("double") for c in (a, b, na, nb))
    ea, eb = na * (a + b) / (na + nb), nb * (a + b) / (na + nb)
    g = 2 * (_cell(a, ea) + _cell(b, eb))
    return F.when(a / na < b / nb, -g).otherwise(g)
