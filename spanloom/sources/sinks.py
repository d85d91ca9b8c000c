"""Aligned text tables, JSON payloads and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def share(name: str) -> Column:
    """Three decimals, ties to the even one."""
    return F.format_string("%5.3f", F.bround(F.col(name).cast("double"), 3))


def aligned(frame: DataFrame, keys: list[str], columns: list[tuple[str, str]]) -> DataFrame:
    """``frame`` with ``line``: the columns side by side, each as wide as its widest value within the key; numbers to the right, names to the
    left, shares with three decimals. A width never cuts a value."""
    own = W.partitionBy(*keys)

    def cell(name: str, side: str) -> Column:
        if side == "share":
            return share(name)
        text = F.col(name).cast("string")
        width = F.max(F.length(text)).over(own)
        space = F.repeat(F.lit(" "), (width - F.length(text)).cast("int"))
        return F.concat(space, text) if side == "right" else F.concat(text, space)

    return frame.withColumn("line", F.concat_ws(" ", *(cell(n, s) for n, s in columns)))


ANNOTATION = [
    ("target_name", "left"), ("target_start", "right"), ("target_end", "right"), ("query_name", "left"), ("query_start", "right"), ("query_end", "right"),
    ("strand", "left"), ("confidence", "share"), ("join_id", "right"), ("region_id", "right"),
]


def displayed(annotations: DataFrame) -> DataFrame:
    """``annotations`` with ``line``: one by itself, its columns apart by a space and no wider than they are; a strand that is not set is a question mark."""
    values = {"share": share, "strand": lambda n: F.coalesce(F.col(n), F.lit("?"))}
    cell = lambda n, side: values.get(n if n in values else side, lambda x: F.col(x).cast("string"))(n)
    return annotations.withColumn("line", F.concat_ws(" ", *(cell(n, s) for n, s in ANNOTATION)))


def text_lines(annotations: DataFrame) -> DataFrame:
    """One aligned line for each annotation, regions in order; widths are those of a region."""
    return aligned(annotations, ["region_id"], ANNOTATION).orderBy("region_id", "target_start", "join_id").select("line")


def write_text(annotations: DataFrame, path: str) -> None:
    text_lines(annotations).write.text(path)


PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{title}</title></head>
<body><pre id="view"></pre><script id="data" type="application/json">{data}</script>
<script>{script}</script></body></html>
"""
SCRIPT = "const d = JSON.parse(document.getElementById('data').textContent); document.getElementById('view').textContent = JSON.stringify(d, null, 1);"


def pages(payloads: DataFrame, title: str = "title", payload: str = "payload", template: str = PAGE, script: str = SCRIPT) -> DataFrame:
    """``payloads`` with ``html``: the template with title, JSON and script put in. Closing tags within the JSON are escaped."""
    safe = F.replace(F.col(payload), F.lit("</"), F.lit("<\\/"))
    out = F.replace(F.lit(template), F.lit("{script}"), F.lit(script))
    return payloads.withColumn("html", F.replace(F.replace(out, F.lit("{title}"), F.col(title)), F.lit("{data}"), safe))
