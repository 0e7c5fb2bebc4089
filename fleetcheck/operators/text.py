"""Text: log classification and fingerprints, OS section dumps, report HTML.

Whole texts are split into lines with ``posexplode(split(...))`` — a
generator in the scan stage, no shuffle, every line of every text kept.
Regexes run in the JVM (``rlike`` / ``regexp_replace`` / ``regexp_extract_all``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import col, first_match, matches
from ..sources import parse_log_lines
from .ranking import topn


def split_lines(df: DataFrame, text: str, keep: Sequence[str], line: str = "line",
                line_no: str = "line_no") -> DataFrame:
    """Text -> one row per line, ``line_no`` 1-based. ``\\r\\n`` and ``\\n`` both split."""
    return df.select(*keep, F.posexplode(F.split(col(text), "\r?\n")).alias("_pos", line)) \
             .withColumn(line_no, F.col("_pos") + 1).drop("_pos")


def record_lines(lines: DataFrame, file: Sequence[str], split: str, at: str, starts: Column, ts: Column) -> DataFrame:
    """Lines with the record they belong to: ``record_no`` in the file (0 before the first one) and ``record_ts``.

    A line for which ``starts`` holds begins a record; the others continue the last one before them, wherever the
    file was split. ``split`` orders a file's pieces, ``at`` the lines of a piece. Records are counted within a piece;
    one row for each piece carries their number and last timestamp to the next ones, so that no task holds a file.
    """
    file = list(file)
    begun = F.coalesce(starts, F.lit(False))
    d = lines.withColumn("_b", begun.cast("bigint")).withColumn("_t", F.when(begun, F.struct(ts.alias("ts"))))
    upto = Window.partitionBy(*file, split).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    here = d.withColumn("_n", F.sum("_b").over(upto)).withColumn("_here", F.last("_t", ignorenulls=True).over(upto))
    pieces = d.groupBy(*file, split).agg(F.sum("_b").alias("_k"), F.max_by("_t", F.when(F.col("_b") == 1, F.col(at))).alias("_last"))
    before = Window.partitionBy(*file).orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate([*file, split])],
                           F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"), F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate([*file, split])])
    j = here.join(pieces, same)
    return j.select(*[F.col(c) for c in lines.columns], (F.col("_before") + F.col("_n")).alias("record_no"),
                    F.coalesce("_here", "_carry")["ts"].alias("record_ts"))


def log_records(lines: DataFrame, file: Sequence[str], split: str, at: str, line: str, starts: Column, ts: Column,
                max_lines: int = 10_000) -> DataFrame:
    """(file..., record_no, part, record_ts, n_lines, text): the lines of each record joined by line ends, in order.

    A record of over ``max_lines`` lines has a row for each run of as many lines of a piece at most, numbered by ``part``;
    any other is one row, part 0. So no group that is collected is longer, and no line is lost.
    """
    file = list(file)
    d = record_lines(lines, file, split, at, starts, ts)
    d = d.withColumn("_run", F.floor((F.row_number().over(Window.partitionBy(*file, split).orderBy(at)) - 1) / max_lines))
    long = d.groupBy(*file, "record_no").agg(F.count("*").alias("_n")).filter(F.col("_n") > max_lines)
    keys = [F.col(c).alias(f"_{i}") for i, c in enumerate([*file, "record_no"])]
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate([*file, "record_no"])])
    j = d.join(long.select(*keys, F.lit(True).alias("_long")), same, "left")
    run = F.when(F.col("_long"), F.struct(F.col(split).alias("split"), F.col("_run").alias("run")))
    g = j.groupBy(*file, "record_no", run.alias("_part")).agg(
        F.first("record_ts").alias("record_ts"), F.count("*").alias("n_lines"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(split).alias("s"), F.col(at).alias("a"), F.col(line).alias("l")))),
                                 lambda x: F.coalesce(x["l"], F.lit(""))), "\n").alias("text"))
    # parts are numbered over one row for each run of a long record
    part = F.row_number().over(Window.partitionBy(*file, "record_no").orderBy("_part"))
    whole = g.filter(F.col("_part").isNull()).withColumn("part", F.lit(0))
    return whole.unionByName(g.filter(F.col("_part").isNotNull()).withColumn("part", part)).select(
        *file, "record_no", "part", "record_ts", "n_lines", "text")


def log_severity(lines: DataFrame, line: str, patterns: Sequence[tuple], keep: Sequence[str],
                 distinct: bool = True, out: str = "severity", ts: str | None = None, as_of: Column | None = None,
                 days: int | None = None) -> DataFrame:
    """Classify lines by the first matching (label, regex[, guard literal]);
    drop unmatched; optionally distinct (the reference prints DISTINCT messages).

    With ``ts`` (one of ``keep``) the most recent come first; with ``days`` only those of the ``days`` before
    ``as_of`` are taken, and none after it."""
    if days is not None:
        lines = lines.filter((F.col(ts) > as_of - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col(ts) <= as_of))
    df = lines.withColumn(out, first_match(line, patterns)).filter(F.col(out).isNotNull())
    df = df.select(*keep, out, line)
    df = df.distinct() if distinct else df
    return df if ts is None else df.orderBy(F.col(ts).desc_nulls_last(), F.col(line).asc())


# Fixed value: a leading timestamp / bracket / number prefix of a log line.
LEADING_NOISE = r"^[^A-Za-z]+"
# Fixed value: the characters of a leading timestamp alone.
LEADING_TIMESTAMP = r"^[0-9T:.+/ -]*"


def fingerprint(line: Column, strip: str = LEADING_NOISE) -> Column:
    """Message fingerprint: leading non-letters removed, then trimmed."""
    return F.trim(F.regexp_replace(line, strip, ""))


def log_fingerprint(lines: DataFrame, line: str, n: int, part: Sequence[str] = (),
                    strip: str = LEADING_NOISE, out: str = "message", as_of: Column | None = None, days: int | None = None) -> DataFrame:
    """Count lines per normalized message and keep the top ``n`` (ties by text).
    Counting is a partial aggregation, so a message repeated a billion times
    is one row per map task before the shuffle. With ``days`` the timestamp that
    a line begins with is parsed: lines of the ``days`` before ``as_of`` count, as
    do those without one, which continue others."""
    if days is not None:
        lines = parse_log_lines(lines, line)
        ts = F.col("ts").cast("timestamp")
        lines = lines.filter(ts.isNull() | ((ts >= as_of - F.expr(f"INTERVAL {int(days)} DAYS")) & (ts <= as_of)))
    g = (lines.select(*part, fingerprint(col(line), strip).alias(out))
              .filter(F.col(out) != "")
              .groupBy(*part, out).agg(F.count("*").alias("n_lines")))
    return topn(g, [F.col("n_lines").desc(), F.col(out).asc()], n, part)


def log_totals(lines: DataFrame, line: str, classes: Sequence[tuple],
               part: Sequence[str] = ()) -> DataFrame:
    """Total lines per class (e.g. errors, warnings) in one aggregation."""
    return lines.groupBy(*part).agg(F.count("*").alias("n_lines"),
                                    *[F.count_if(matches(line, p, g[0] if g else None)).alias(f"n_{label}")
                                      for label, p, *g in classes])


def os_sections(dump: DataFrame, text: str, keep: Sequence[str], sections: Sequence[str] | None = None,
                section_re: str = r"^#{2,}\s*(\S.*?)\s*#*$", host_re: str = r"^\*\*\s*([^:]+):") -> DataFrame:
    """Section-structured text dump -> (keep..., host, section, at, lines): one row for each host's part of a section.

    A header opens a section: with ``sections`` given, a line equal to one of
    those names that is the dump's first line or follows a blank line (the
    collectors print ``name``, the body, then an empty line); otherwise a line
    matching ``section_re``. ``** host:`` switches the host inside a section.
    All in the row: the lines between two headers are sliced out of the array
    of lines, then those between two host marks; no shuffle, whatever a dump's size.
    ``at`` is the number of the line before the first of ``lines``.
    """
    ln = lambda x: F.trim(x)

    def header(x, i):
        if sections is not None:
            prev_blank = F.coalesce(F.trim(F.get("_l", i - 1)) == "", F.lit(True))
            return F.when(ln(x).isin(list(sections)) & prev_blank, ln(x))
        m = F.regexp_extract(x, section_re, 1)
        return F.when(m != "", m)

    def host(x, i):
        m = F.regexp_extract(x, host_re, 1)
        return F.when(m != "", F.trim(m))

    def marks(lines, name):
        """(at, name) of the marked lines, counted from one."""
        return F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("at"), name(x, i).alias("name"))),
                        lambda m: m["name"].isNotNull())

    def between(at, lines):
        """(at, name, next): each mark with the place of the next one."""
        return F.transform(at, lambda m, k: F.struct(m["at"].alias("at"), m["name"].alias("name"), F.coalesce(
            F.get(at, k + 1)["at"], F.size(lines) + 1).alias("next")))

    keep = list(keep)
    d = dump.select(*keep, F.split(col(text), "\r?\n").alias("_l"))
    d = d.withColumn("_m", marks(F.col("_l"), header))
    d = d.select(*keep, "_l", F.explode(between(F.col("_m"), F.col("_l"))).alias("_s"))
    d = d.select(*keep, F.col("_s.name").alias("section"), F.col("_s.at").alias("_at"),
                 F.slice("_l", F.col("_s.at") + 1, F.col("_s.next") - F.col("_s.at") - 1).alias("_b"))
    start = F.array(F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("name")))
    d = d.withColumn("_m", F.concat(start, marks(F.col("_b"), host)))
    d = d.select(*keep, "section", "_at", "_b", F.explode(between(F.col("_m"), F.col("_b"))).alias("_h"))
    return d.select(*keep, F.col("_h.name").alias("host"), "section", (F.col("_at") + F.col("_h.at")).alias("at"),
                    F.slice("_b", F.col("_h.at") + 1, F.col("_h.next") - F.col("_h.at") - 1).alias("lines"))


def os_section_parse(dump: DataFrame, text: str, keep: Sequence[str], sections: Sequence[str] | None = None,
                     section_re: str = r"^#{2,}\s*(\S.*?)\s*#*$",
                     host_re: str = r"^\*\*\s*([^:]+):") -> DataFrame:
    """Section-structured text dump -> (keep..., host, section, line_no, line), blank lines left out; see ``os_sections``."""
    keep = list(keep)
    d = os_sections(dump, text, keep, sections, section_re, host_re)
    d = d.select(*keep, "host", "section", "at", F.posexplode("lines").alias("_pos", "line"))
    return d.filter(F.trim("line") != "").select(*keep, "host", "section", (F.col("at") + F.col("_pos") + 1).alias("line_no"), "line")


def html_list_extract(pages: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    """``<li><a href="...">text</a></li>`` items -> (keep..., item_no, href, text)."""
    pat = r'<li><a href="([^"]*)">([^<]*)</a></li>'
    z = F.arrays_zip(F.regexp_extract_all(col(html), F.lit(pat), 1).alias("href"),
                     F.regexp_extract_all(col(html), F.lit(pat), 2).alias("text"))
    return (pages.select(*keep, F.posexplode(z).alias("_pos", "_it"))
                 .select(*keep, (F.col("_pos") + 1).alias("item_no"),
                         F.col("_it.href").alias("href"), F.col("_it.text").alias("text")))


# The report HTML contract (table ids, spans, red font).
TABLE_RE = r'(?s)<table[^>]*id="([^"]+)"[^>]*>(.*?)</table>'
ROW_RE = r"(?s)<tr[^>]*>(.*?)</tr>"
CELL_RE = r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"
SPAN_RE = r'<span id="([^"]+)"[^>]*>([^<]*)</span>'
RED_RE = r'(?i)<font[^>]*color="?red'


def html_table_extract(reports: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    """Report HTML -> (keep..., table_id, row_no, col_no, cell, is_red).

    Header rows (``<th>``) get row_no 0; cell markup is stripped. Three
    nested generators in one stage: no shuffle."""
    tables = reports.select(*keep, F.explode(F.arrays_zip(
        F.regexp_extract_all(col(html), F.lit(TABLE_RE), 1).alias("tid"),
        F.regexp_extract_all(col(html), F.lit(TABLE_RE), 2).alias("body"))).alias("_t"))
    # Data rows are numbered from the table's first one, inside the array of rows.
    rows = tables.select(*keep, F.col("_t.tid").alias("table_id"), F.regexp_extract_all(F.col("_t.body"), F.lit(ROW_RE), 1).alias("_rows"))
    first_data = F.array_position(F.transform("_rows", lambda x: x.contains("<td") & ~x.contains("<th")), True)
    rows = rows.select(*keep, "table_id", first_data.alias("_first"), F.posexplode("_rows").alias("_r", "_row"))
    row_no = F.when(F.col("_row").contains("<th"), F.lit(0)).otherwise((F.col("_r") - F.col("_first") + 2).cast("int"))
    cells = rows.select(*keep, "table_id", row_no.alias("row_no"),
                        F.posexplode(F.regexp_extract_all(F.col("_row"), F.lit(CELL_RE), 1)).alias("_c", "_cell"))
    return (cells.withColumn("col_no", F.col("_c") + 1)
                 .withColumn("is_red", F.col("_cell").rlike(RED_RE))
                 .withColumn("cell", F.trim(F.regexp_replace(F.col("_cell"), "<[^>]+>", "")))
                 .select(*keep, "table_id", "row_no", "col_no", "cell", "is_red"))


def html_span_extract(reports: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    """``<span id=...>value</span>`` scalar facts -> (keep..., span_id, value)."""
    z = F.arrays_zip(F.regexp_extract_all(col(html), F.lit(SPAN_RE), 1).alias("span_id"),
                     F.regexp_extract_all(col(html), F.lit(SPAN_RE), 2).alias("value"))
    return reports.select(*keep, F.explode(z).alias("_s")).select(*keep, "_s.span_id", "_s.value")
