"""String formatting helpers that print the same text as Python format specs.

Values are rounded half-up to the printed precision first so that Java's
formatter and other engines cannot disagree on ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import LAKH
from .numeric import col_, round_half_up


def fmt_fixed(c, digits: int, signed: bool = False) -> Column:
    """Like ``f"{x:.{digits}f}"`` (or ``:+.{digits}f`` when signed)."""
    if not signed:
        return F.format_string(f"%.{digits}f", round_half_up(c, digits))
    c = col_(c)
    return F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("+")),
                    F.format_string(f"%.{digits}f", round_half_up(F.abs(c), digits)))


def fmt_pct(c, digits: int = 1) -> Column:
    """Like ``f"{x:.1%}"``."""
    return F.concat(F.format_string(f"%.{digits}f", round_half_up(col_(c) * F.lit(100.0), digits)), F.lit("%"))


def fmt_thousands(c) -> Column:
    """Like ``f"{n:,}"`` for integers."""
    return F.format_number(col_(c).cast("long"), 0)


def fmt_crore(c) -> Column:
    """Like ``f"Rs {x/1e7:,.2f} Cr"``."""
    return F.concat(F.lit("Rs "), F.format_number(round_half_up(col_(c) / F.lit(1e7), 2), 2), F.lit(" Cr"))


def fmt_lakh(c) -> Column:
    """Like ``f"Rs {x/1e5:,.0f}L"``."""
    return F.concat(F.lit("Rs "), F.format_number(round_half_up(col_(c) / F.lit(LAKH), 0), 0), F.lit("L"))


def py_strip(c) -> Column:
    """Python ``str.strip()``: all leading/trailing whitespace, not only spaces."""
    return F.regexp_replace(col_(c), r"^\s+|\s+$", "")


def template_parts(template: str) -> list[tuple[str, str]]:
    """Split ``"a {x} b"`` into [("lit", "a "), ("var", "x"), ("lit", " b")]."""
    import re
    out = []
    for i, p in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            out.append(("var", p))
        elif p:
            out.append(("lit", p))
    return out


def fill(template: str, **values) -> Column:
    """A fixed format filled with column values: ``concat(lit, col, lit, ...)``."""
    cols = []
    for kind, p in template_parts(template):
        if kind == "lit":
            cols.append(F.lit(p))
        else:
            v = values[p]
            cols.append(v if isinstance(v, Column) else F.lit(str(v)))
    return F.concat(*cols)
