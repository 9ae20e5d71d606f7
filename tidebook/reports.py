"""Texts and drawings of report rows (a few rows, collected)."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _shown(value) -> str:
    if value is None:
        return "n/a"
    if isinstance(value, bool):
        return "yes" if value else "no"
    return f"{value:.6f}".rstrip("0").rstrip(".") if isinstance(value, float) else str(value)


def facts(title: str, df: DataFrame) -> str:
    """A one-row report as ``name: value`` lines."""
    row = df.head()
    lines = [title, "-" * len(title)]
    return "\n".join(lines + [f"{k}: {_shown(v)}" for k, v in (row.asDict() if row else {}).items()])


def table(title: str, df: DataFrame, most: int = 200) -> str:
    """Rows in aligned columns."""
    rows = [[_shown(v) for v in r] for r in df.take(most)]
    widths = [max(len(x) for x in column) for column in zip(df.columns, *rows, strict=True)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)).rstrip()
    return "\n".join([title, "-" * len(title), line(df.columns), *map(line, rows)])


def verdict(df: DataFrame) -> str:
    """The text of a validation row, with PASS or NO PASS."""
    return facts("Validation", df) + f"\nresult: {'PASS' if df.head()['passed'] else 'NO PASS'}"


def line_svg(df: DataFrame, y: str, title: str, x: str = "timestamp", stretches: int = 800, width: int = 960, height: int = 320) -> str:
    """``y`` over the time ``x`` as an SVG line.  Rows are first grouped into
    ``stretches`` of time, of which the least and largest value are drawn, so
    that what is collected doesn't grow with the table."""
    rows = df.select(F.unix_micros(x).alias("us"), F.col(y).cast("double").alias("value")).dropna()
    low, high = rows.agg(F.min("us"), F.max("us")).head()
    values = []
    if low is not None:
        step = (high - low) // stretches + 1
        at = F.floor((F.col("us") - low) / F.lit(step)).cast("int").alias("at")
        values = rows.groupBy(at).agg(F.min("value"), F.max("value")).orderBy("at").collect()
    bottom, top = min((r[1] for r in values), default=0.0), max((r[2] for r in values), default=1.0)
    across = lambda i: 60 + (width - 80) * i / max(1, stretches)
    up = lambda v: height - 30 - (height - 70) * (v - bottom) / ((top - bottom) or 1.0)
    points = " ".join(f"{across(i):.1f},{up(v):.1f}" for i, least, most in values for v in (least, most))
    label = lambda px, py, text: f'<text x="{px}" y="{py:.0f}" font-size="12">{escape(text)}</text>'
    return "\n".join(
        [
            f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif">',
            label(60, 20, title),
            label(4, up(top) + 4, _shown(top)),
            label(4, up(bottom) + 4, _shown(bottom)),
            f'<polyline fill="none" stroke="#1f6feb" points="{points}"/>',
            "</svg>",
        ]
    )
