"""Text, literal and path columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit multipliers of size and duration literals.
SIZE_UNITS = {"b": 1, "kb": 1024, "mb": 1024**2, "gb": 1024**3, "tb": 1024**4}
DURATION_UNITS = {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _literal(c, units: dict[str, int]) -> Column:
    text = F.lower(F.trim(_col(c)))
    pattern = rf"^(\d+(?:\.\d+)?)\s*({'|'.join(sorted(units))})$"
    number = F.regexp_extract(text, pattern, 1)
    unit = F.regexp_extract(text, pattern, 2)
    table = F.create_map(*[F.lit(v) for pair in units.items() for v in pair])
    value = F.floor(number.cast("double") * F.try_element_at(table, unit) + 0.5).cast("bigint")
    return F.when(text.rlike(pattern), value)


def parse_size(c) -> Column:
    """Bytes of "500MB" or "1.5gb"; null when it is no size."""
    return _literal(c, SIZE_UNITS)


def parse_duration(c) -> Column:
    """Milliseconds of "30s", "12h" or "2w"; null when it is no duration."""
    return _literal(c, DURATION_UNITS)


def glob_regex(glob: str) -> str:
    """Anchored regex of a path glob: ** crosses segments and takes a following /, * and ? do not."""
    tokens = re.findall(r"\*\*/?|\*|\?|[^*?]+", glob)
    meaning = {"**": ".*", "**/": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(meaning.get(t) or re.escape(t) for t in tokens) + "$"


def matches_glob(c, glob: str) -> Column:
    return _col(c).rlike(glob_regex(glob))


def age_bucket(ts, now) -> Column:
    """Words for the age of ``ts``: just now, minutes, hours (below 36) or days. Both times count to the nearest millisecond."""
    millis = lambda c: F.floor((F.unix_micros(_col(c).cast("timestamp")) + 500) / 1000)
    seconds = F.greatest(F.lit(0), F.floor((millis(now) - millis(ts)) / 1000 + 0.5))
    minutes = F.floor(seconds / 60 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5)
    words = lambda n, unit: F.concat(n.cast("bigint").cast("string"), F.lit(unit))
    return (
        F.when(ts.isNull() if isinstance(ts, Column) else F.col(ts).isNull(), F.lit("unknown"))
        .when(seconds < 45, F.lit("just now"))
        .when(minutes < 60, words(minutes, " min ago"))
        .when(hours < 36, words(hours, " h ago"))
        .otherwise(words(days, " d ago"))
    )


def is_settled_path(c) -> Column:
    """False for staging directories and temporary files, which are still being written."""
    return ~_col(c).rlike(r"(^|/)\.partial(/|$)|\.tmp(/|$)")


def swap_side(c) -> Column:
    """Exchange left and right in a camel-case prefix or in the tokens of a kebab-case name."""
    name = _col(c)
    camel = r"^(left|right)(?=[A-Z0-9]|$)"
    head = F.regexp_extract(name, camel, 1)
    other = F.when(head == "left", F.lit("right")).otherwise(F.lit("left"))
    swapped = F.concat(other, F.expr(f"substring({_sql(c)}, length(regexp_extract({_sql(c)}, '^(left|right)', 1)) + 1)"))
    token = lambda t: F.when(t == "left", F.lit("right")).when(t == "right", F.lit("left")).otherwise(t)
    return F.when(head != "", swapped).otherwise(F.array_join(F.transform(F.split(name, "-"), token), "-"))


def _sql(c) -> str:
    return f"`{c}`" if isinstance(c, str) else c._jc.toString()


def format_path(parts) -> Column:
    """Text such as a.b[2]["x y"] of an ARRAY<STRING> path; digit-only parts are positions."""
    def step(out: Column, part: Column) -> Column:
        plain = F.when(out == "", part).otherwise(F.concat(out, F.lit("."), part))
        return (
            F.when(part.rlike(r"^\d+$"), F.concat(out, F.lit("["), part, F.lit("]")))
            .when(part.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$"), plain)
            .otherwise(F.concat(out, F.lit('["'), F.regexp_replace(part, r'(["\\\\])', r"\\$1"), F.lit('"]')))
        )

    return F.aggregate(_col(parts), F.lit(""), step)
