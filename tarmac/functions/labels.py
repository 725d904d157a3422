"""Text labels of the summary cards, built from built-in expressions.

The cards print numbers with one decimal the way Python's float formatting
does: the exact binary value is rounded to the nearest tenth, ties to even.
Spark's ``format_string`` rounds half up on the shortest decimal text instead
(12.35 is stored as 12.3499999..., Python prints "12.3", ``format_string``
"12.4"), so the rounding is done here with plain double arithmetic:

* ``m = floor(10a)`` is a first guess of the tenths (it may be off by one);
* splitting ``a`` into ``hi + lo`` (each half short enough that ``hi * 10`` and
  ``lo * 10`` are exact) gives the exact sign of ``10a - (m + 0.5)``;
* the sign picks ``m`` or ``m + 1`` (an exact tie goes to the even one), and
  the integer is printed as ``k div 10 "." k mod 10``.

Valid for |x| < 2^49, far beyond flight counts and percentages.  The steps
are added as short-lived columns (one projection per step for all labels), so
the plan stays small instead of repeating every intermediate value where it is
used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2^27 + 1


def with_fixed1(df: DataFrame, specs) -> DataFrame:
    """Add Python's ``f"{src:.1f}"`` (``f"{src:+.1f}"`` when ``plus``) for each
    ``(src, out, plus)`` in ``specs``; NULL stays NULL.  Every step adds its
    column for all specs at once."""
    specs = [(src, out, plus) for src, out, plus in specs]

    def tmp(out, name):
        return F.col(f"__{out}_{name}")

    df = df.withColumns({**{f"__{o}_a": F.abs(F.col(s).cast("double")) for s, o, _ in specs},
                         # -0.0 counts as negative, as Python prints "-0.0"
                         **{f"__{o}_neg": F.col(s).cast("double").cast("string").startswith("-")
                            for s, o, _ in specs}})
    df = df.withColumns({**{f"__{o}_c": tmp(o, "a") * F.lit(_SPLIT) for _, o, _ in specs},
                         **{f"__{o}_m": F.floor(tmp(o, "a") * F.lit(10.0)) for _, o, _ in specs}})
    df = df.withColumns({f"__{o}_hi": tmp(o, "c") - (tmp(o, "c") - tmp(o, "a")) for _, o, _ in specs})
    df = df.withColumns({
        f"__{o}_d": (tmp(o, "hi") * F.lit(10.0) - (tmp(o, "m") + F.lit(0.5)))
        + (tmp(o, "a") - tmp(o, "hi")) * F.lit(10.0) for _, o, _ in specs})
    df = df.withColumns({
        f"__{o}_k": F.when(tmp(o, "d") > 0, tmp(o, "m") + 1).when(tmp(o, "d") < 0, tmp(o, "m"))
        .when(tmp(o, "m") % 2 == 0, tmp(o, "m")).otherwise(tmp(o, "m") + 1) for _, o, _ in specs})
    out_cols = {}
    for src, out, plus in specs:
        k = tmp(out, "k")
        sign = F.when(tmp(out, "neg"), F.lit("-")).otherwise(F.lit("+" if plus else ""))
        whole = ((k - k % 10) / 10).cast("bigint")  # exact: k - k % 10 is a multiple of 10
        text = F.concat(sign, whole.cast("string"), F.lit("."), (k % 10).cast("string"))
        out_cols[out] = F.when(F.col(src).isNotNull(), text)
    df = df.withColumns(out_cols)
    return df.drop(*[f"__{o}_{n}" for _, o, _ in specs
                     for n in ("a", "neg", "c", "m", "hi", "d", "k")])


def with_labels(df: DataFrame, compact: dict[str, str] | None = None,
                signed_percent: dict[str, str] | None = None) -> DataFrame:
    """Add card texts: ``compact`` maps a count column to its output
    (1234567 -> "1.2M", 3456 -> "3.5K", 999 -> "999"); ``signed_percent`` maps
    a percent column to its output (12.345 -> "+12.3%", NULL -> "-")."""
    compact, signed_percent = compact or {}, signed_percent or {}

    def n(src):
        return F.col(src).cast("bigint")

    df = df.withColumns({f"__{out}_scaled": F.when(F.abs(n(src)) >= 1_000_000, n(src) / F.lit(1e6))
                         .when(F.abs(n(src)) >= 1_000, n(src) / F.lit(1e3))
                         for src, out in compact.items()})
    specs = ([(f"__{out}_scaled", f"__{out}_text", False) for out in compact.values()]
             + [(src, f"__{out}_text", True) for src, out in signed_percent.items()])
    df = with_fixed1(df, specs)
    cols = {}
    for src, out in compact.items():
        text = F.col(f"__{out}_text")
        cols[out] = (F.when(n(src).isNull(), F.lit(None).cast("string"))
                     .when(F.abs(n(src)) >= 1_000_000, F.concat(text, F.lit("M")))
                     .when(F.abs(n(src)) >= 1_000, F.concat(text, F.lit("K")))
                     .otherwise(n(src).cast("string")))
    for src, out in signed_percent.items():
        cols[out] = F.coalesce(F.concat(F.col(f"__{out}_text"), F.lit("%")), F.lit("-"))
    df = df.withColumns(cols)
    return df.drop(*[f"__{o}_scaled" for o in compact.values()],
                   *[f"__{o}_text" for o in list(compact.values()) + list(signed_percent.values())])


def with_compact(df: DataFrame, src: str, out: str) -> DataFrame:
    return with_labels(df, compact={src: out})


def with_signed_percent(df: DataFrame, src: str, out: str) -> DataFrame:
    return with_labels(df, signed_percent={src: out})


def change_class(pct: Column) -> Column:
    """Style class of the change card."""
    return (F.when(pct > 0, "kpi-change-positive")
            .when(pct < 0, "kpi-change-negative")
            .otherwise("kpi-change-neutral"))


def airport_label(icao: Column, country: Column) -> Column:
    """"EDDF (Germany)", or the bare code of an airport without country."""
    return F.coalesce(F.concat(icao, F.lit(" ("), country, F.lit(")")), icao)
