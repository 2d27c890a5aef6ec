"""How strings compare: without regard to case and to blanks at the end; and LIKE patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def ci(c: Column) -> Column:
    """The key by which strings compare, join and group."""
    return F.lower(F.rtrim(c))


def ci_value(s: str) -> str:
    return s.rstrip(" ").lower()


_META = set("\\.^$|?*+()[]{}")


def like_regex(pattern: str) -> str:
    """% is any run, _ any character, [..] a class (with ranges, ^ first negates); all else is itself."""
    return "(?i)^" + like_body(pattern) + r"\z"


def like_body(pattern: str) -> str:
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", at + 2)) > 0:
            body = pattern[at + 1 : end]
            negated = body.startswith("^")
            body = re.sub(r"([\\\[\]^&~])", r"\\\1", body[negated:])
            out.append(f"[{'^' if negated else ''}{body}]")
            at = end
        else:
            out.append("\\" + c if c in _META else c)
        at += 1
    return "".join(out)


def like(c: Column, pattern: str) -> Column:
    """The condition for a pattern that is known while planning."""
    inner = pattern.strip("%")
    if pattern[:1] == "%" and pattern[-1:] == "%" and inner and len(pattern) > 2:
        # anchored runs at both ends match anything but a line break: search the middle instead
        return c.rlike("(?i)" + like_body(inner)) & ~c.contains("\n")
    return c.rlike(like_regex(pattern))


def like_column(c: Column, pattern: Column) -> Column:
    """The condition for a pattern that is another column; classes are kept, other signs are quoted."""
    quoted = F.regexp_replace(pattern, r"([\\.^$|?*+(){}])", r"\\$1")
    quoted = F.regexp_replace(quoted, r"\[\\\^", "[^")
    quoted = F.regexp_replace(F.regexp_replace(quoted, "%", ".*"), "(?<!\\[)_", ".")
    return F.regexp_like(c, F.concat(F.lit("(?i)^"), quoted, F.lit(r"\z")))
