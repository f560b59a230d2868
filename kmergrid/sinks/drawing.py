"""SVG drawings of trees and label bars.

Geometry comes from the operators as DataFrames with one row per node, box or
bar segment, i.e. the size of the picture; only turning rows into SVG elements
happens here.  Lines are streamed to the file, never held together.
"""

from __future__ import annotations

from collections.abc import Iterable
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LabelDrawing, TreeDrawing
from ..operators import tree as T
from ..operators.label_matrix import matrix_fade
from ..operators.distance import symmetric

BLACK = "hsl(0,0%,0%)"
MARGIN = 60


def css(colour: Column) -> Column:
    """An HSL struct as CSS text."""
    return F.format_string("hsl(%.1f,%.1f%%,%.1f%%)", colour["h"], colour["s"] * 100, colour["l"] * 100)


def branches(tree: DataFrame, coords: DataFrame, widths: DataFrame, colours: DataFrame) -> DataFrame:
    """``x1, y1, x2, y2, width, colour``: the two strokes of every visible branch.

    From the parent vertically to the child's height, then across to the child.
    A branch under an empty parent or with zero width is not drawn.
    """
    at = tree.select("node_id", "parent_id").join(coords, "node_id") \
        .join(widths.select(F.col("id").alias("node_id"), "width"), "node_id") \
        .join(colours, "node_id", "left")
    up = at.select(F.col("node_id").alias("parent_id"), F.col("x").alias("px"), F.col("y").alias("py"),
                   F.col("width").alias("pw"))
    seen = at.join(up, "parent_id").where("pw > 0 and width > 0")
    stroke = F.explode(F.array(
        F.struct(F.col("px").alias("x1"), F.col("py").alias("y1"), F.col("px").alias("x2"), F.col("y").alias("y2")),
        F.struct(F.col("px").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))))
    return seen.select(stroke.alias("s"), "width", F.coalesce("colour", F.lit(BLACK)).alias("colour")) \
        .select("s.*", "width", "colour")


def _write(path: str, width: float, height: float, elements: Iterable[str]) -> None:
    with open(path, "w", encoding="utf-8") as out:
        out.write(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}">\n')
        for element in elements:
            out.write(element + "\n")
        out.write("</svg>\n")


def _text(x: float, y: float, label: str, size: int, colour: str = BLACK) -> str:
    return (f'<text x="{x:.2f}" y="{y:.2f}" font-family="monospace" font-weight="bold" '
            f'font-size="{size}" fill="{colour}">{escape(label)}</text>')


def draw_tree(tree: DataFrame, path: str, config: TreeDrawing, widths: DataFrame | None = None,
              colours: DataFrame | None = None, distances: DataFrame | None = None) -> None:
    """Rectangular tree; branch width by query share, colour by uniform subtree, optional heat map.

    ``widths(id, width)`` defaults to the line width everywhere,
    ``colours(node_id, colour)`` to black, ``distances(a, b, distance)`` adds
    one box per pair next to the leaves.
    """
    spark = tree.sparkSession
    leaf_count = tree.where("is_leaf").count()
    coords = T.coordinates(tree, config.height, config.width, leaf_count, config.equal_dist)
    if widths is None:
        widths = tree.select(F.col("node_id").alias("id"), F.lit(config.line_width).alias("width"))
    if colours is None:
        colours = spark.createDataFrame([], "node_id int, colour string")
    nodes = tree.select("node_id", "name", "is_leaf", "parent_id").join(coords, "node_id") \
        .join(widths.select(F.col("id").alias("node_id"), "width"), "node_id").join(colours, "node_id", "left") \
        .where("width > 0")
    label_room = 0.7 * config.font_size * ((tree.agg(F.max(F.length("name"))).first()[0] or 0) + 2)
    left = MARGIN + config.width + label_room
    canvas = left + (config.width if distances is not None else 0) + MARGIN

    def elements():
        for s in branches(tree, coords, widths, colours).toLocalIterator():
            yield (f'<path d="M{s.x1 + MARGIN:.2f} {s.y1 + MARGIN:.2f}L{s.x2 + MARGIN:.2f} {s.y2 + MARGIN:.2f}" '
                   f'stroke="{s.colour}" stroke-width="{s.width:g}" fill="none"/>')
        for n in nodes.toLocalIterator():
            x, y, colour = n.x + MARGIN, n.y + MARGIN, n.colour or BLACK
            if n.parent_id is None:
                yield (f'<path d="M{x - 50:.2f} {y:.2f}L{x:.2f} {y:.2f}" stroke="{BLACK}" '
                       f'stroke-width="{n.width:g}" fill="none"/>')
            if n.is_leaf:
                yield _text(config.width + MARGIN + config.font_size / 2, y, n.name, config.font_size, colour)
            elif config.include_id:
                yield _text(x + config.font_size / 2, y, str(n.node_id), config.font_size, colour)
        if distances is not None:
            yield from _heat_map(tree, coords, distances, config.width / leaf_count, left)

    _write(path, canvas, config.height + 2 * MARGIN, elements())


def _heat_map(tree: DataFrame, coords: DataFrame, distances: DataFrame, side: float, left: float):
    """One box per ordered pair of leaves, the column order mirroring the rows from the bottom."""
    place = T.leaf_order(tree).join(T.leaves(tree).join(coords, "node_id").select("name", "y"), "name")
    last = place.agg(F.max("position")).first()[0]
    same = place.select(F.col("name").alias("a"), F.col("name").alias("b"), F.lit(0.0).alias("distance"))
    boxes = matrix_fade(symmetric(distances).unionByName(same)) \
        .join(place.select(F.col("name").alias("a"), "y"), "a") \
        .join(place.select(F.col("name").alias("b"), (F.lit(last) - F.col("position")).alias("column")), "b")
    for b in boxes.select("y", "column", "opacity").toLocalIterator():
        yield (f'<rect x="{left + b.column * side:.2f}" y="{b.y + MARGIN - side / 2:.2f}" width="{side:.2f}" '
               f'height="{side:.2f}" fill="red" fill-opacity="{b.opacity:.4f}"/>')


def draw_label_bars(segments: DataFrame, queries: DataFrame, colours: DataFrame, path: str,
                    config: LabelDrawing) -> None:
    """Stacked bars, one line per query; labels without colour and blanked queries are white.

    ``segments(name, label, x, w)`` in canvas units, ``queries(name, rank)``,
    ``colours(label, colour)`` as CSS.
    """
    count = queries.count()
    height = config.height / max(1, count)
    placed = segments.join(queries, "name").join(colours, "label", "left")
    empty = segments.groupBy("name").agg(F.max("w").alias("w")).where("w = 0").join(queries, "name")
    room = 0.7 * config.font_size * ((queries.agg(F.max(F.length("name"))).first()[0] or 0) + 2)

    def box(x: float, rank: int, w: float, colour: str) -> str:
        return (f'<rect x="{room + x:.2f}" y="{rank * height:.2f}" width="{w:.2f}" height="{height:.2f}" '
                f'fill="{colour}" stroke="black" stroke-width="{config.line_width}"/>')

    def elements():
        for q in queries.toLocalIterator():
            yield _text(0, (q.rank + 0.5) * height, q.name, config.font_size)
        for s in placed.where("w > 0").toLocalIterator():
            yield box(s.x, s.rank, s.w, s.colour or "white")
        for e in empty.toLocalIterator():
            yield box(0.0, e.rank, float(config.width), "white")

    _write(path, room + config.width, config.height, elements())
