"""Column expressions shared by the operators.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` only,
so it stays inside whole-stage codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_or_col(v) -> Column:
    if isinstance(v, Column):
        return v
    return F.lit(v)


def nz(c) -> Column:
    """NULLIF(c, 0): a divisor that makes a zero total NULL instead of an error."""
    v = col(c)
    return F.when(v != 0, v)


def safe_div(num, den) -> Column:
    """num / den as DOUBLE; NULL when den is 0 or NULL (``NULLIF(den, 0)``)."""
    d = col(den).cast("double")
    return col(num).cast("double") / F.when(d != 0, d)


def fround(x, digits: int) -> Column:
    """Rounding of a DOUBLE, halves away from zero, as ``floor(|x| * 10^d + 0.5) / 10^d`` with the sign of x.

    Plain IEEE arithmetic (the built-in ``round`` re-parses the double's
    decimal text, which differs between engines at exact halves), and it stays
    in codegen without BigDecimal. From 2^52 on a scaled double has no
    fraction left, so such values are returned as they are: ``floor`` goes
    through BIGINT and would saturate.
    """
    m = float(10 ** digits)
    v = col(x).cast("double")
    size = F.abs(v)
    rounded = F.when(size * m < float(1 << 52), F.floor(size * m + 0.5) / m).otherwise(size)
    return F.when(v < 0, -rounded).otherwise(rounded)


def pct(num, den, digits: int | None = 2) -> Column:
    """``round(100 * (num / nullif(den, 0)), digits)``."""
    v = F.lit(100.0) * safe_div(num, den)
    return fround(v, digits) if digits is not None else v


def compare(metric, op: str, limit) -> Column:
    """``metric <op> limit`` for op in > >= < <= = != ; NULL propagates."""
    m, t = col(metric), lit_or_col(limit)
    return {
        ">": m > t, ">=": m >= t, "<": m < t, "<=": m <= t,
        "=": m == t, "==": m == t, "!=": m != t, "<>": m != t,
    }[op]


def flag(cond: Column) -> Column:
    """A verdict column: NULL (unknown metric) is *not* abnormal."""
    return F.coalesce(cond, F.lit(False))


def seconds_between(start, end) -> Column:
    """Whole seconds from start to end, as BIGINT (``timestampdiff``): exact for
    TIMESTAMP_NTZ whatever the session time zone (no DST shift), real elapsed
    time for TIMESTAMP."""
    return F.timestamp_diff("SECOND", col(start), col(end))


def days_between(start, end) -> Column:
    """Calendar days from start to end (``DATEDIFF(end, start)``)."""
    return F.datediff(col(end).cast("date"), col(start).cast("date"))


def interval_minutes(c) -> Column:
    """DAY TO SECOND interval -> minutes as DOUBLE (EXTRACT of each field)."""
    v = col(c)
    return (F.extract(F.lit("DAY"), v).cast("double") * 1440 + F.extract(F.lit("HOUR"), v).cast("double") * 60
            + F.extract(F.lit("MINUTE"), v).cast("double") + F.extract(F.lit("SECOND"), v).cast("double") / 60)


def as_of_lit(ts: str) -> Column:
    return F.lit(ts).cast("timestamp_ntz")


def day_str(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd")


def label_map(c, mapping: Sequence[tuple], default=None) -> Column:
    """Decode a code column through a fixed (code, label) list (``DECODE``)."""
    out = None
    for code, label in mapping:
        cond = col(c).eqNullSafe(F.lit(code))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default))


def matches(value, pat: str, guard=None, kind: str = "rlike") -> Column:
    """``value`` matches ``pat``. ``guard``: a literal (or tuple of literals,
    any of which) every match must contain, e.g. ``@`` for an e-mail regex —
    tested first; ``And`` short-circuits in codegen, so most lines never reach
    the regex engine. For a ``(?i)`` pattern the guard is tested on
    ``lower(value)``."""
    v = col(value)
    cond = v.rlike(pat) if kind == "rlike" else v.like(pat) if kind == "like" else v.startswith(pat)
    if not guard:
        return cond
    lits = [guard] if isinstance(guard, str) else list(guard)
    ci = pat.startswith("(?i)")
    hay = F.lower(v) if ci else v
    g = None
    for lit_ in lits:
        c = hay.contains(lit_.lower() if ci else lit_)
        g = c if g is None else (g | c)
    return g & cond


def first_match(value, patterns: Sequence[tuple], kind: str = "rlike", default=None) -> Column:
    """Label of the first (label, pattern[, guard]) that matches ``value``."""
    out = None
    for label, pat, *guard in patterns:
        cond = matches(value, pat, guard[0] if guard else None, kind)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def longest_prefix(value, prefixes: Iterable[str]) -> Column:
    """The longest of ``prefixes`` that ``value`` starts with (NULL if none).

    The prefix list is a parameter (a type catalog of a few dozen rows), so it
    becomes a CASE chain tried longest-first: a projection, no join, no shuffle.
    """
    ordered = sorted(set(prefixes), key=lambda p: (-len(p), p))
    out = None
    v = col(value)
    for p in ordered:
        cond = v.startswith(p)
        out = F.when(cond, F.lit(p)) if out is None else out.when(cond, F.lit(p))
    return out if out is not None else F.lit(None).cast("string")


def format_bytes(c) -> Column:
    """Human readable size like ``pg_size_pretty``: bytes, kB, MB, GB, TB."""
    b = col(c).cast("double")
    a = F.abs(b)
    return (F.when(b.isNull(), F.lit(None).cast("string"))
            .when(a < 10240, F.concat(F.round(b, 0).cast("bigint").cast("string"), F.lit(" bytes")))
            .when(a < 10240 * 1024, F.concat(F.round(b / 1024, 0).cast("bigint").cast("string"), F.lit(" kB")))
            .when(a < 10240 * 1024 ** 2, F.concat(F.round(b / 1024 ** 2, 0).cast("bigint").cast("string"), F.lit(" MB")))
            .when(a < 10240 * 1024 ** 3, F.concat(F.round(b / 1024 ** 3, 0).cast("bigint").cast("string"), F.lit(" GB")))
            .otherwise(F.concat(F.round(b / 1024 ** 4, 0).cast("bigint").cast("string"), F.lit(" TB"))))


def lsn_to_number(c) -> Column:
    """WAL position ``'hi/lo'`` (hex halves) -> DECIMAL(20,0) byte offset."""
    hi = F.conv(F.substring_index(col(c), "/", 1), 16, 10).cast("decimal(20,0)")
    lo = F.conv(F.substring_index(col(c), "/", -1), 16, 10).cast("decimal(20,0)")
    return (hi * F.lit(4294967296).cast("decimal(20,0)") + lo).cast("decimal(20,0)")


def decode_date_bytes(c) -> Column:
    """Seven-byte internal DATE (century+100, year+100, month, day, hour+1,
    minute+1, second+1) stored as BINARY -> TIMESTAMP_NTZ."""
    h = F.hex(col(c))

    def byte(i):  # 1-based byte index
        return F.conv(F.substring(h, 2 * i - 1, 2), 16, 10).cast("int")

    year = (byte(1) - 100) * 100 + (byte(2) - 100)
    return F.make_timestamp_ntz(year, byte(3), byte(4), byte(5) - 1, byte(6) - 1, byte(7) - 1)


def split_host_port(c, default_port=None):
    """``host:port`` -> (host, port) columns (``SUBSTRING_INDEX``)."""
    v = col(c)
    host = F.substring_index(v, ":", 1)
    port = F.when(F.instr(v, ":") > 0, F.substring_index(v, ":", -1).cast("int"))
    if default_port is not None:
        port = F.coalesce(port, F.lit(default_port))
    return host, port


def to_ts_from_int_parts(date_int, time_int) -> Column:
    """Integer yyyymmdd + hhmmss (agent job history) -> TIMESTAMP_NTZ."""
    s = F.concat(col(date_int).cast("string"), F.lpad(col(time_int).cast("string"), 6, "0"))
    return F.try_to_timestamp(s, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def exact_money(c, scale: int = 2) -> Column:
    """Cast to DECIMAL so that sums are exact and order-independent."""
    return col(c).cast(f"decimal(18,{scale})")
