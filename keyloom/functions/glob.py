"""Glob patterns as anchored regular expressions, translated once on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column


def to_regex(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "\\" and i < len(pattern):
            out += re.escape(pattern[i])
            i += 1
        elif c == "[":
            negated = pattern[i : i + 1] == "^"
            i += negated
            members = ""
            while i < len(pattern) and pattern[i] != "]":
                low = pattern[i]
                if low == "\\" and i + 1 < len(pattern):
                    i += 1
                    members += re.escape(pattern[i])
                elif pattern[i + 1 : i + 2] == "-" and i + 2 < len(pattern) and pattern[i + 2] != "]":
                    a, b = sorted((low, pattern[i + 2]))
                    members += f"{re.escape(a)}-{re.escape(b)}"
                    i += 2
                else:
                    members += re.escape(low) if low not in "[&^" else "\\" + low
                i += 1
            if i >= len(pattern):
                return "(?!)"  # a class that doesn't end matches nothing
            i += 1
            out += (f"[^{members}]" if negated else f"[{members}]") if members else ("." if negated else "(?!)")
        else:
            out += re.escape(c)
    return f"(?s)^{out}\\z"


def matches(column: Column, pattern: str) -> Column:
    return column.rlike(to_regex(pattern))
