"""String leaves and object keys of JSON bodies, with the exact limits of a recursive walk."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# The limits of the walk.
MAX_DEPTH, MAX_STRINGS = 25, 200
SCHEMA = "string_values array<string>, was_valid_json boolean, max_depth int, failed boolean"


def walk(body: bytes | None) -> tuple[list[str], bool, int]:
    """Pre-order strings and keys; nodes deeper than MAX_DEPTH, or begun after MAX_STRINGS strings, are left out."""
    body = body or b""
    try:
        tree = json.loads(body.decode("utf-8"))
    except (ValueError, RecursionError):
        text = body.decode("utf-8", errors="replace")
        return ([text] if text else []), False, 0
    out: list[str] = []
    deepest = 0
    todo: list[tuple] = [("node", tree, 0)]
    while todo:
        kind, node, depth = todo.pop()
        if kind == "key":
            out.append(node)
        elif depth <= MAX_DEPTH and len(out) < MAX_STRINGS:
            deepest = max(deepest, depth)
            if isinstance(node, str):
                out.append(node)
            elif isinstance(node, dict):
                todo += [x for k, v in reversed(node.items()) for x in (("node", v, depth + 1), ("key", k, depth))]
            elif isinstance(node, list):
                todo += [("node", v, depth + 1) for v in reversed(node)]
    return out, True, deepest


def _walked(body: bytes | None) -> tuple[list[str], bool, int, bool]:
    try:
        return *walk(body), False
    except Exception:  # noqa: BLE001  one body must not end the job: its request gets an error of its own
        return [], False, 0, True


def json_strings(body: Column) -> Column:
    """struct(string_values, was_valid_json, max_depth, failed) of a binary or string body; failed: the walk broke off."""
    return F.udf(_walked, SCHEMA, useArrow=True)(body.cast("binary"))
