"""JSON documents: reads by Catalyst, changes that keep key order by Arrow-batched functions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = re.compile(r"\.?([^.\[\]]+)|\[(-?\d+)\]|\[(?:\"([^\"\]]*)\"|'([^'\]]*)')\]")


def parse_path(path: str) -> tuple[list[str | int], bool]:
    """Steps of a single-match path, and whether it is of the `$` dialect."""
    if any(x in path for x in ("..", "*", "?", "@")):
        raise ValueError(f"unsupported path: {path}")
    rooted = path.startswith("$")
    rest = path[1:] if rooted else path
    if rest in ("", "."):
        return [], rooted
    out, at = [], 0
    while at < len(rest):
        if not (m := STEP.match(rest, at)):
            raise ValueError(f"unsupported path: {path}")
        out.append(int(m[2]) if m[2] is not None else next(x for x in (m[1], m[3], m[4]) if x is not None))
        at = m.end()
    return out, rooted


def find(doc, steps: list[str | int]):
    """(found, value)."""
    for s in steps:
        if isinstance(s, int) and isinstance(doc, list) and -len(doc) <= s < len(doc) or isinstance(s, str) and isinstance(doc, dict) and s in doc:
            doc = doc[s]
        else:
            return False, None
    return True, doc


def _dump(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def set_value(doc: str, steps: list[str | int], value: str, only: str = "") -> str:
    """A leaf is created or replaced, intermediates never; index == length appends. only: NX or XX."""
    new, whole = json.loads(value), json.loads(doc)
    there, _ = find(whole, steps)
    if only == "NX" and there or only == "XX" and not there:
        return doc
    if not steps:
        return _dump(new)
    found, parent = find(whole, steps[:-1])
    last = steps[-1]
    if found and isinstance(last, str) and isinstance(parent, dict):
        parent[last] = new
    elif found and isinstance(last, int) and isinstance(parent, list) and -len(parent) <= last < len(parent):
        parent[last] = new
    elif found and isinstance(last, int) and isinstance(parent, list) and last == len(parent):
        parent.append(new)
    else:
        raise ValueError("no such path")
    return _dump(whole)


def delete(doc: str, steps: list[str | int]) -> str | None:
    """None when the root goes."""
    if not steps:
        return None
    whole = json.loads(doc)
    found, parent = find(whole, steps[:-1])
    if found and find(parent, steps[-1:])[0]:
        del parent[steps[-1]]
    return _dump(whole)


def add_number(doc: str, steps: list[str | int], by: float) -> str:
    whole = json.loads(doc)
    found, value = find(whole, steps)
    if not found or isinstance(value, bool) or not isinstance(value, int | float):
        raise ValueError("not a number")
    total = float(value) + float(by)
    if total in (float("inf"), float("-inf")) or total != total:
        raise ValueError("result is not finite")
    integral = isinstance(value, int) and float(by).is_integer()
    return set_value(doc, steps, json.dumps(int(total) if integral else total))


def append(doc: str, steps: list[str | int], values: list[str]) -> str:
    whole = json.loads(doc)
    found, target = find(whole, steps)
    if not found or not isinstance(target, list):
        raise ValueError("not an array")
    target.extend(json.loads(v) for v in values)
    return _dump(whole)


def changed(doc: Column, change: Callable[[str], str | None]) -> Column:
    """doc after a change, in Arrow batches; a document that can't take it is null."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        def one(d):
            try:
                return None if d is None else change(d)
            except ValueError:
                return None

        return x.map(one)

    return run(doc)


def _place(doc: Column, steps: list) -> Column:
    """The path of each document; an index below 0 counts from the end of that document's array."""
    out = F.lit("$")
    for s in steps:
        if isinstance(s, int) and s < 0:
            size = F.json_array_length(F.call_function("get_json_object", doc, out))
            out = F.when(size + s >= 0, F.concat(out, F.lit("["), (size + s).cast("string"), F.lit("]")))
        else:
            out = F.concat(out, F.lit(f"[{s}]" if isinstance(s, int) else f"['{s}']"))
    return out


def get(doc: Column, path: str) -> Column:
    """JSON text of the value; `$` gives it in an array, or an empty array. A legacy path without a match gives null."""
    steps, rooted = parse_path(path)
    place = _place(doc, steps)
    value = F.try_variant_get(F.try_parse_json(doc), place, "variant")
    kind = F.schema_of_variant(value)
    # numbers, arrays and objects as they are written; strings quoted
    text = F.when(kind == "VOID", "null").when(kind == "STRING", F.to_json(value)).otherwise(F.call_function("get_json_object", doc, place))
    text = F.when(value.isNotNull(), text)
    return F.when(text.isNull(), F.lit("[]")).otherwise(F.concat(F.lit("["), text, F.lit("]"))) if rooted else text


def type_of(doc: Column, path: str) -> Column:
    """null, boolean, integer, number, string, array or object."""
    steps, _ = parse_path(path)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(doc), _place(doc, steps), "variant"))
    return (
        F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "BIGINT", "integer").when(kind == "STRING", "string")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind.isNotNull(), "number")
    )
