"""Glob patterns over keys: *, ?, [abc], [^abc], [a-z] (either order) and \\x."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for Java and Python. An unclosed class is an error."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i < len(pattern):
            out.append(re.escape(pattern[i]))
            i += 1
        elif c == "[":
            negative = pattern[i : i + 1] == "^"
            i += negative
            members = []
            while True:
                if i >= len(pattern):
                    raise ValueError(f"unclosed class in {pattern!r}")
                if pattern[i] == "]":
                    i += 1
                    break
                if pattern[i] == "\\" and i + 1 < len(pattern):
                    i += 1
                low = pattern[i]
                i += 1
                if pattern[i : i + 1] == "-" and i + 1 < len(pattern) and pattern[i + 1] != "]":
                    low, high = sorted((low, pattern[i + 1]))
                    i += 2
                    members.append(f"\\u{ord(low):04x}-\\u{ord(high):04x}")
                else:
                    members.append(f"\\u{ord(low):04x}")
            if members:
                out.append(f"[{'^' if negative else ''}{''.join(members)}]")
            else:
                out.append("." if negative else "(?!)")
        else:
            out.append(re.escape(c))
    return rf"(?s)\A{''.join(out)}\z"


def glob(column: Column | str, pattern: str) -> Column:
    """Whether a key matches; a literal beginning also prunes by range."""
    column = F.col(column) if isinstance(column, str) else column
    literal = re.match(r"[^*?\[\\]*", pattern)[0]
    match = F.rlike(column, F.lit(glob_regex(pattern)))
    return match & column.startswith(literal) if literal else match
