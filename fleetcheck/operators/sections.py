"""Columns of the tables inside an OS dump's sections (df, inode, free) and its name/value sections (meminfo).

The header line of a section says where its columns are: text columns begin where their word begins, numbers end
where their word ends. A row's cell begins with the word at that place and reaches to the next cell, so a text may
hold blanks. Where a row isn't aligned with its header (a cell of the wrong kind, or one word at two places: blanks
were squeezed, or a number outgrew its column) its words are taken in order instead. Everything is an expression over the section's array of lines, so a section is read within its
row and nothing is shuffled, whatever the number of lines.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the units of a printed size multiply by.
UNITS = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40, "P": 1 << 50, "E": 1 << 60}


@dataclass(frozen=True)
class Cell:
    """word: the column's word in the header ("" for an unnamed first column); kind: word, rest, count, size, percent."""
    word: str
    name: str
    kind: str = "word"


# The columns that the collectors' commands print.
LAYOUTS = {
    "diskusage": (Cell("Filesystem", "filesystem"), Cell("Type", "fstype"), Cell("Size", "size_bytes", "size"), Cell("Used", "used_bytes", "size"),
                  Cell("Avail", "avail_bytes", "size"), Cell("Use%", "used_pct", "percent"), Cell("Mounted on", "mount", "rest")),
    "inode": (Cell("Filesystem", "filesystem"), Cell("Type", "fstype"), Cell("Inodes", "inodes", "size"), Cell("IUsed", "iused", "size"),
              Cell("IFree", "ifree", "size"), Cell("IUse%", "used_pct", "percent"), Cell("Mounted on", "mount", "rest")),
    "freemem": (Cell("", "kind"), Cell("total", "total_kb", "count"), Cell("used", "used_kb", "count"), Cell("free", "free_kb", "count"),
                Cell("shared", "shared_kb", "count"), Cell("buff/cache", "cache_kb", "count"), Cell("available", "available_kb", "count")),
}
_KIND = {"word": r"^\S.*$", "rest": r"^\S.*$", "count": r"^-?[0-9]+$", "size": r"^(?:[0-9]+(?:\.[0-9]+)?[KMGTPE]?|-)$", "percent": r"^(?:[0-9]+(?:\.[0-9]+)?%|-)$"}


def typed(text: Column, kind: str) -> Column:
    """A cell's text in the type of its kind; NULL for "-" and what isn't of the kind."""
    if kind in ("word", "rest"):
        return F.when(text != "", text)
    if kind == "count":
        return text.try_cast("bigint")
    if kind == "percent":
        return F.regexp_extract(text, r"^([0-9.]+)%$", 1).try_cast("double")
    number = F.regexp_extract(text, r"^([0-9.]+)[KMGTPE]?$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^[0-9.]+([KMGTPE]?)$", 1)
    factor = reduce(lambda c, u: c.when(unit == u, F.lit(float(UNITS[u]))), UNITS, F)
    return F.rint(number * factor).try_cast("bigint")


def _places(header: Column, cells: Sequence[Cell]) -> Column:
    """Where each cell is: the first character of a text column's word, the last of a number's, counted from one; 0: no such word."""
    def place(c: Cell) -> Column:
        if c.word == "":
            return F.lit(1)
        # a word counts only between blanks, so that "Used" isn't found within "IUsed"
        at = F.locate(" " + c.word + " ", F.concat(F.lit(" "), F.rtrim(header), F.lit(" ")))
        return F.when(at > 0, at if c.kind in ("word", "rest") else at + len(c.word) - 1).otherwise(0)

    return F.array(*[place(c) for c in cells])


def _of_kind(text: Column, kind: Column) -> Column:
    """Whether a text is a cell of a kind (given by its name)."""
    return reduce(lambda c, k: c.when(kind == k, text.rlike(_KIND[k])), _KIND, F)


def section_table(sections: DataFrame, keep: Sequence[str], section: str, cells: Sequence[Cell] | None = None) -> DataFrame:
    """(keep..., host, line_no, cells...) of a section's rows, from ``text.os_sections``.

    The header is the first line with the words of the first two named columns; a column whose word it lacks (another
    version of the command) is NULL. Lines before it, blank lines, and rows without a cell in the first two columns
    are no rows. A section without a header has none. A cell beyond the end of its line is NULL.
    """
    keep, cells = list(keep), list(cells or LAYOUTS[section])
    named = [c.word for c in cells if c.word]
    kinds, last = F.array(*[F.lit(c.kind) for c in cells]), len(cells) - 1
    d = sections.filter(F.col("section") == section)
    is_header = lambda x: x.contains(named[0]) & x.contains(named[1])
    d = d.withColumn("_h", F.array_position(F.transform("lines", is_header), True)).filter(F.col("_h") > 0)
    d = d.withColumn("_header", F.regexp_replace(F.get("lines", F.col("_h") - 1), "\t", " "))
    # places once for a section; the place of a cell in its words is the number of columns the header has before it
    d = d.withColumn("_at", _places(F.col("_header"), cells))
    before = lambda i: F.size(F.filter(F.slice("_at", F.lit(1), i), lambda p: p > 0))
    d = d.withColumn("_nth", F.transform("_at", lambda p, i: F.when(p > 0, before(i))))
    d = d.select(*keep, "host", "at", "_h", "_at", "_nth", F.posexplode(F.slice("lines", F.col("_h") + 1, F.size("lines"))).alias("_p", "_line"))
    d = d.withColumn("_line", F.rtrim(F.regexp_replace("_line", "\t", " "))).filter(F.col("_line") != "")
    size = F.length("_line")
    d = d.withColumn("_cells", F.transform("_at", lambda p, i: F.struct(
        i.alias("i"), F.get(kinds, i).alias("kind"), p.alias("at"),
        F.when((p > 0) & (p <= size), F.regexp_extract(F.substring("_line", F.lit(1), p), r"(\S*)$", 1)).otherwise("").alias("left"))))
    # cells that the line has, where their words begin; each holds what stands from there to where the next one begins
    d = d.withColumn("_cells", F.transform(F.filter("_cells", lambda c: c["left"] != ""), lambda c: F.struct(
        c["i"].alias("i"), c["kind"].alias("kind"), (c["at"] - F.length(c["left"]) + 1).alias("begin"))))
    end = lambda k: F.coalesce(F.get("_cells", k + 1)["begin"], size + 1)
    d = d.withColumn("_cells", F.transform("_cells", lambda c, k: F.struct(
        c["i"].alias("i"), c["kind"].alias("kind"), c["begin"].alias("begin"), (end(k) - c["begin"]).alias("wide"),
        F.trim(F.substring("_line", c["begin"], end(k) - c["begin"])).alias("text"))))
    aligned = F.forall("_cells", lambda c: (c["wide"] > 0) & _of_kind(c["text"], c["kind"])) & (
        F.get("_cells", 0)["begin"] == size - F.length(F.ltrim("_line")) + 1) & (F.get("_cells", 0)["i"] == 0) & (F.get("_cells", 1)["i"] == 1)
    # the words in order: what the last column takes to the end of the line is cut off first
    words = F.split(F.trim("_line"), r"\s+", len(cells) if cells[last].kind == "rest" else -1)
    ordered = F.get(F.transform(F.array(words), lambda w: F.transform("_nth", lambda n: F.get(w, n))), 0)  # split once
    d = d.withColumn("_aligned", F.coalesce(aligned, F.lit(False)))
    placed = F.transform("_at", lambda p, i: F.get(F.filter("_cells", lambda c: c["i"] == i), 0)["text"])
    # a row of a generator: filters on cells, here or a caller's, would otherwise be pushed below the steps above with
    # every step written out at each of its uses, and cost many times the cells themselves
    d = d.select(*keep, "host", "at", "_h", "_p", F.explode(F.array(F.when(F.col("_aligned"), placed).otherwise(ordered))).alias("_text"))
    out = d.select(*keep, "host", (F.col("at") + F.col("_h") + F.col("_p") + 1).alias("line_no"),
                   *[typed(F.coalesce(F.get("_text", i), F.lit("")), c.kind).alias(c.name) for i, c in enumerate(cells)])
    return out.filter(F.col(cells[0].name).isNotNull() & F.col(cells[1].name).isNotNull())


def section_pairs(sections: DataFrame, keep: Sequence[str], section: str, split: str = ":") -> DataFrame:
    """(keep..., host, line_no, line, name, value, unit) of ``name: value unit`` lines; value is NULL where it is no number."""
    d = sections.filter(F.col("section") == section)
    d = d.select(*keep, "host", "at", F.posexplode("lines").alias("_p", "_line")).filter(F.locate(split, F.col("_line")) > 0)
    rest = F.trim(F.expr(f"substring(_line, locate('{split}', _line) + 1)"))
    return d.select(*keep, "host", (F.col("at") + F.col("_p") + 1).alias("line_no"), F.col("_line").alias("line"),
                    F.trim(F.substring_index("_line", split, 1)).alias("name"),
                    F.get(F.split(rest, r"\s+"), 0).try_cast("bigint").alias("value"),
                    F.get(F.split(rest, r"\s+"), 1).alias("unit"))
