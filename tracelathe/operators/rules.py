"""The include/exclude rule language, compiled to columns that Catalyst can push down.

`mode="compat"` keeps the language's quirks: NOT is only seen at the start and negates all that follows; the first
" AND " splits before any " OR "; there are no parentheses; a LIKE pattern loses its first and last character and
may have `*` at its ends only; comparing text with a number, or a whole number with a fraction, is false, even
for !=; a rule that can't be parsed holds for every event. A missing tag equals ''. `mode="sql"` reads the text as a
SQL condition with ordinary precedence.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("==", "!=", ">=", "<=", ">", "<")


def resolve(name: str, fields: Mapping[str, tuple[Column, str]]) -> tuple[Column, str]:
    """A field's column and kind (text, integer, fraction). fields: known names; `tags.x` that are unknown are absent text."""
    if name in fields:
        column, kind = fields[name]
        if name.startswith("tags."):
            text = F.format_string("%.6f", column) if kind == "fraction" else column.cast("string")
            return F.coalesce(text, F.lit("")), "text"
        return column, kind
    return (F.lit(""), "text") if name.startswith("tags.") else (F.lit(None).cast("string"), "missing")


def _unquoted(text: str) -> str:
    return text[1:-1] if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"" else text


def constant(text: str) -> tuple[object, str]:
    """A rule's constant: quotes are dropped before a number is looked for at its beginning."""
    text = _unquoted(text.strip())
    if "." in text and (m := re.match(r"[+-]?\d*\.\d*", text)) and re.search(r"\d", m[0]):
        return float(m[0]), "fraction"
    if m := re.match(r"\d+", text):
        return int(m[0]), "integer"
    return text, "text"


def like(column: Column, pattern: str) -> Column:
    """`*` at the ends of a pattern stands for any text; one inside never matches."""
    body = pattern.strip("*") if pattern.strip("*") or not pattern else ""
    if "*" in body:
        return F.lit(False)
    start, end = pattern.startswith("*"), pattern.endswith("*")
    if start and end:
        return column.contains(body)
    return column.endswith(body) if start else column.startswith(body) if end else column == body


def compare(column: Column, kind: str, op: str, value: object, value_kind: str, guard: bool = True) -> Column:
    if kind != value_kind or kind == "text" and op not in ("==", "!="):
        return F.lit(False)
    made = {"==": column == value, "!=": column != value, ">=": column >= value, "<=": column <= value, ">": column > value, "<": column < value}[op] if kind != "text" else {"==": column == value, "!=": column != value}[op]
    return _no_null(made, guard)


def _no_null(made: Column, guard: bool) -> Column:
    return F.coalesce(made, F.lit(False)) if guard else made


def rule(text: str, fields: Mapping[str, tuple[Column, str]], mode: str = "compat", guard: bool = True) -> Column:
    """One rule as a column.

    A missing field makes a comparison false, before any NOT. As a filter drops nulls anyway, `guard=False` leaves them
    outside of NOT, so that the scan can take over the comparisons.
    """
    if mode == "sql":
        ready = re.sub(r"\{([^}]*)\}", r"(\1)", text).replace("==", "=")
        ready = re.sub(r"(?<=LIKE )'([^']*)'", lambda m: f"'{m[1].replace('*', '%')}'", ready)
        return _no_null(F.expr(ready), guard)
    text = text.strip()
    if text.startswith("NOT "):
        return ~rule(text[4:], fields)
    for word, join in ((" AND ", lambda a, b: a & b), (" OR ", lambda a, b: a | b)):
        if word in text:
            left, right = text.split(word, 1)
            return join(rule(left, fields, mode, guard), rule(right, fields, mode, guard))
    if " IN " in text and "{" in text and "}" in text:
        name, rest = text.split(" IN ", 1)
        column, kind = resolve(name.strip(), fields)
        members = [x.strip("'\"") for x in rest[rest.index("{") + 1 : rest.index("}")].split(",")]
        return _no_null(column.isin(*members), guard) if kind == "text" else F.lit(False)
    if " LIKE " in text:
        name, pattern = text.split(" LIKE ", 1)
        column, kind = resolve(name.strip(), fields)
        return _no_null(like(column, pattern.strip()[1:-1]), guard) if kind == "text" else F.lit(False)
    for op in OPERATORS:
        if op in text:
            name, value = text.split(op, 1)
            column, kind = resolve(name.strip(), fields)
            return compare(column, kind, op, *constant(value), guard)
    return F.lit(True)


def satisfies(rules: list[str], fields, mode: str = "compat", guard: bool = True) -> Column:
    """Whether any of the rules holds."""
    return reduce(lambda a, b: a | b, (rule(x, fields, mode, guard) for x in rules)) if rules else F.lit(False)


def should_aggregate(include: list[str], exclude: list[str], fields, mode: str = "compat", full: bool = False, guard: bool = True) -> Column:
    """No rules: everything. Else what is included and not excluded; only exclusions leave nothing. Full mode ignores rules.

    As a filter, `guard=False` leaves the included part to the scan (see `rule`); what is excluded stands under NOT and keeps its guard.
    """
    if full or not (include or exclude):
        return F.lit(True)
    return satisfies(include, fields, mode, guard) & ~satisfies(exclude, fields, mode)


def load_rules(text: str) -> tuple[list[str], list[str]]:
    """The `inclusion:` and `exclusion:` lists of a rule file in YAML."""
    lists: dict[str, list[str]] = {"inclusion": [], "exclusion": []}
    own = None
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if m := re.match(r"\s*(\w+):\s*$", line):
            own = lists.get(m[1])
        elif own is not None and (m := re.match(r"\s*-\s*(.+)$", line)):
            own.append(_unquoted(m[1].strip()))
    return lists["inclusion"], lists["exclusion"]


def path_traced(path: Column, include: list[str], exclude_suffixes: tuple[str, ...] = (".pfw", ".py", ".pfw.gz")) -> Column:
    """Whether a path is traced: no excluded suffix, and the walk along the included prefixes stops at a whole one.

    A prefix that another included prefix goes on from is only reached by paths that leave both at its end.
    """
    stop = F.lit(False)
    for p in sorted(set(include), key=len):
        longer = [q for q in include if q != p and q.startswith(p)]
        shadowed = reduce(lambda a, b: a | b, (F.substring(path, len(p) + 1, 1) == q[len(p)] for q in longer), F.lit(False))
        stop = stop | path.startswith(p) & ~shadowed
    excluded = reduce(lambda a, b: a | b, (path.endswith(x) for x in exclude_suffixes), F.lit(False))
    return stop & ~excluded if include else ~excluded
