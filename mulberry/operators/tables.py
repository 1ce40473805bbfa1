"""Tables found on pages: quality, coverage, text outside of them, captions. A table is an array of rows of cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mulberry.functions.text import clean_cell, markdown_table

FILLED, RATIO, FREE_COLUMNS, MOST_COLUMNS, MOST_CELLS, CAPTION = 8, 0.35, 9, 10, 100, 60


def filled_cells(rows: Column) -> Column:
    return F.size(F.filter(F.flatten(rows), lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))


def is_meaningful(rows: Column) -> Column:
    """Two rows and two columns or more, ten columns and a hundred cells at most, eight filled cells; with ten columns a
    third of the cells filled."""
    columns = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    cells = F.size(rows) * columns
    shape = (F.size(rows) >= 2) & (columns >= 2) & (columns <= MOST_COLUMNS) & (cells <= MOST_CELLS)
    return shape & (filled_cells(rows) >= FILLED) & ((columns <= FREE_COLUMNS) | (filled_cells(rows) / cells >= RATIO))


def coverage(rows: Column, text: Column) -> Column:
    """The share of the characters inside a table's box that its cells hold."""
    inside = F.length(F.regexp_replace(text, r"\s+", ""))
    held = F.length(F.regexp_replace(F.array_join(F.flatten(rows), ""), r"\s+", ""))
    return F.when(inside > 0, F.least(held / inside, F.lit(1.0))).otherwise(0.0)


def share_inside(block: Column, box: Column) -> Column:
    """The share of a block's area that lies in a box; both are arrays x0, y0, x1, y1."""
    edge = lambda i, f: f(block[i], box[i])
    width = F.greatest(edge(2, F.least) - edge(0, F.greatest), F.lit(0.0))
    height = F.greatest(edge(3, F.least) - edge(1, F.greatest), F.lit(0.0))
    area = (block[2] - block[0]) * (block[3] - block[1])
    return F.when(area > 0, width * height / area).otherwise(0.0)


def body_blocks(blocks: Column, boxes: Column) -> Column:
    """The blocks (struct box, text) that lie in no table by more than half of their area."""
    return F.filter(blocks, lambda b: ~F.exists(boxes, lambda t: share_inside(b["box"], t) > 0.5))


def caption(blocks: Column, box: Column) -> Column:
    """The text of the block that ends closest above a table's top (90 above to 4 below it), cut to 60 characters."""
    near = F.filter(blocks, lambda b: (box[1] - b["box"][3]).between(-4, 90) & (F.trim(b["text"]) != ""))
    ranked = F.array_sort(F.transform(near, lambda b: F.struct(F.abs(box[1] - b["box"][3]).alias("d"), b["text"].alias("text"))))
    return F.left(F.trim(F.get(ranked, F.lit(0))["text"]), F.lit(CAPTION))


def table_block(name: Column, markdown: Column) -> Column:
    """A table as it stands in a parent text."""
    return F.concat(F.lit("【表格】"), F.coalesce(name, F.lit("")), F.lit("\n"), markdown)


COVERAGE = 0.75


def page_tables(tables: Column, blocks: Column) -> Column:
    """The tables of a page that are worth keeping, from the top down: array of box, markdown and caption.

    tables: array of struct(box, rows, region), region being the text inside the box; blocks: array of struct(box, text). A table
    is kept if its shape is meaningful and its cells hold three quarters of the characters of its region.
    """
    kept = F.filter(tables, lambda t: is_meaningful(t["rows"]) & (coverage(t["rows"], t["region"]) >= COVERAGE))
    told = F.transform(kept, lambda t: F.struct(t["box"][1].alias("top"), t["box"].alias("box"), markdown_table(F.transform(t["rows"], lambda r: F.transform(r, clean_cell))).alias("markdown"), caption(blocks, t["box"]).alias("caption")))
    return F.transform(F.array_sort(told), lambda t: F.struct(t["box"].alias("box"), t["markdown"].alias("markdown"), t["caption"].alias("caption")))


def page_text(body: Column, tables: Column) -> Column:
    """The parent text of a page: its body and then its tables (see page_tables), a blank line apart."""
    shown = F.transform(tables, lambda t: table_block(t["caption"], t["markdown"]))
    return F.array_join(F.concat(F.filter(F.array(F.trim(body)), lambda b: b != ""), F.coalesce(shown, F.array().cast("array<string>"))), "\n\n")
