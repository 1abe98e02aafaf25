"""Delimited lines that fail to parse: the valid ones become rows, the others come out with the reason.

Lines of a plain shape, which parse at cost 0, are split and judged with built-in expressions. All others go through a
minimum-cost parse: a dynamic program over the marks of the line (quotes and delimiters) and the columns so far, which
may insert or delete quotes and delimiters, finds the fewest edits that make the quotes legal and give the layout's
number of columns; which of the delimiters they fall on is settled by a second one over the fields, so that as many as
possible are valid. Quotes that are legal as they stand are left alone. A line that parses at cost 0 and whose fields are valid is loaded; for any other the edits state what is wrong.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that show nothing: separators, controls, format and default-ignorable characters, fillers.
INVISIBLE = r"\p{Z}\p{C}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}"


@dataclass(frozen=True)
class Check:
    """A field's rule: trimmed of spaces it must match `pattern` (Java and Python alike) and, as a number, lie from
    `low` to `high` in steps of `step`; `empty` allows nothing. `visible` only asks for a visible character."""

    reason: str
    column: int
    pattern: str = ""
    low: float | None = None
    high: float | None = None
    step: float | None = None
    empty: bool = False
    visible: bool = False

    def column_fails(self, field: Column) -> Column:
        if self.visible:
            return ~field.rlike(f"[^{INVISIBLE}]")
        v = F.trim(field)
        number = v.try_cast("double")
        ok = v.rlike(f"^(?:{self.pattern})$")
        if self.low is not None:
            ok = ok & F.coalesce(number >= self.low, F.lit(False)) & F.coalesce(number <= self.high, F.lit(False))
        if self.step:
            ok = ok & (number / self.step == F.floor(number / self.step))
        return ~(((v == "") | ok) if self.empty else ok)

    def fails(self, field: str) -> bool:
        if self.visible:
            import regex

            return regex.search(f"[^{re.sub(r'x{([0-9A-F]+)}', lambda m: ('u' + m[1]) if len(m[1]) == 4 else ('U' + m[1].zfill(8)), INVISIBLE)}]", field) is None
        v = field.strip(" ")
        if not v:
            return not self.empty
        if not re.fullmatch(self.pattern, v, re.ASCII):
            return True
        if self.low is None:
            return False
        number = float(v)
        return not (self.low <= number <= self.high) or bool(self.step and (number / self.step) % 1)


@dataclass(frozen=True)
class Layout:
    """Names of the columns in their order and the rules, the first that fails being the reason."""

    columns: tuple[str, ...]
    checks: tuple[Check, ...]
    delimiter: str = ","


def marks(line: str, delimiter: str) -> list[str]:
    """The line cut into quotes, delimiters and the runs of text between them."""
    return re.findall(rf'"|{re.escape(delimiter)}|[^"{re.escape(delimiter)}]+', line)


def settle_quotes(parts: list[str], delimiter: str, want: int | None = None) -> tuple[int, list[tuple[str, int]], list[str]]:
    """(cost, edits, fields): the fewest quotes deleted or inserted that make every quote legal; with `want` those that
    are fewest together with the delimiters to delete or insert until there are so many fields, quotes counting more.

    States: at a field's start, in a plain field, in a quoted one, after its closing quote, each with the number of
    fields ended, up to `want`: every field beyond costs a delimiter. A quote is legal at a field's start, doubled
    inside a quoted field, or as the last character of such a field.
    """
    START, PLAIN, QUOTED, CLOSED = range(4)
    most = 0 if want is None else want
    QUOTE, DELIMITER = 1_000_001, 1_000_000  # equal numbers of edits: rather delimiters than quotes
    # (state, fields ended) -> (cost, link); link = (link before, edit or None, characters for the field or None at a field's end)
    best: dict[tuple[int, int], tuple] = {(START, 0): (0, None)}

    def better(into: dict, state: int, n: int, cost: int, link: tuple) -> None:
        key = (state, n)
        if key not in into or cost < into[key][0]:
            into[key] = (cost, link)

    for at, mark in enumerate(parts):
        new: dict[tuple[int, int], tuple] = {}
        # a quote may be inserted before this mark: it opens at a field's start and closes a quoted field
        for (state, n), (cost, link) in list(best.items()):
            if state == START and mark != '"':
                better(best, QUOTED, n, cost + QUOTE, (link, ("insert quote", at), ""))
            if state == QUOTED and mark == delimiter:
                better(best, CLOSED, n, cost + QUOTE, (link, ("insert quote", at), ""))
        for (state, n), (cost, link) in best.items():
            if mark == '"':
                better(new, state, n, cost + QUOTE, (link, ("delete quote", at), ""))
                if state == START:
                    better(new, QUOTED, n, cost, (link, None, ""))
                elif state == QUOTED:
                    better(new, CLOSED, n, cost, (link, None, ""))
                    better(new, QUOTED, n, cost + QUOTE, (link, ("insert quote", at), '"'))  # doubled
                elif state == CLOSED:
                    better(new, QUOTED, n, cost, (link, None, '"'))
            elif mark == delimiter:
                if state == QUOTED:
                    better(new, QUOTED, n, cost, (link, None, mark))
                else:  # the last field is ended by the line's end, so this one is the first of two at least
                    beyond = most and n >= most - 1
                    better(new, START, n if beyond or not most else n + 1, cost + (DELIMITER if beyond else 0), (link, None, None))
            elif state == QUOTED:
                better(new, QUOTED, n, cost, (link, None, mark))
            elif state in (START, PLAIN):
                better(new, PLAIN, n, cost, (link, None, mark))
        best = new
    for (state, n), (cost, link) in list(best.items()):
        if state == QUOTED:
            better(best, CLOSED, n, cost + QUOTE, (link, ("insert quote", len(parts)), ""))
    missing = lambda n: DELIMITER * (most - 1 - n) if most else 0
    _, link = min(((c + missing(n), x) for (s, n), (c, x) in best.items() if s != QUOTED), key=lambda v: v[0])
    steps = []
    while link:
        steps.append(link[1:])
        link = link[0]
    fields, edits = [""], []
    for edit, text in reversed(steps):
        if edit:
            edits.append(edit)
        if text is None:
            fields.append("")
        else:
            fields[-1] += text
    return len(edits), edits, fields


def settle_delimiters(fields: list[str], layout: Layout) -> tuple[int, list[tuple[str, int]], list[str]]:
    """(cost, edits, fields): the fewest delimiters deleted or inserted that give the layout's number of columns; of
    these the way with the fewest invalid fields, and with the surplus as far behind as it may be. Deleting joins
    fields, inserting adds an empty one. A joined field holds delimiters, so of the rules only `visible` can hold."""
    want, have = len(layout.columns), len(fields)
    if want == have:
        return 0, [], fields
    rules: dict[int, list[Check]] = {}
    for c in layout.checks:
        rules.setdefault(c.column, []).append(c)
    spare = abs(have - want)

    def bad(k: int, text: str) -> int:
        return sum(c.fails(text) for c in rules.get(k, []))

    # best[j] after k columns, which take the first j fields: (invalid fields, link to the column before, fields taken)
    best: dict[int, tuple] = {0: (0, None, 0)}
    for k in range(want):
        new: dict[int, tuple] = {}
        joined = sum(not c.visible for c in rules.get(k, []))
        least = None  # where a column of two fields or more starts best, of the starts so far
        for end in range(max(0, k + 1 - spare) if have < want else k + 1, min(have, k + 1 + (spare if have > want else 0)) + 1):
            options = []
            if have > want:
                if end - 2 in best and (least is None or best[end - 2][0] < best[least][0]):
                    least = end - 2
                if least is not None:
                    options.append((best[least][0] + joined, least))
            if end - 1 in best:
                options.append((best[end - 1][0] + bad(k, fields[end - 1]), end - 1))
            if have < want and end in best:
                options.append((best[end][0] + bad(k, ""), end))
            if options:
                cost, j = min(options, key=lambda x: x[0])
                new[end] = (cost, best[j], end - j)
        best = new
    widths, link = [], best[have]
    while link[1]:
        widths.append(link[2])
        link = link[1]
    out, edits, at = [], [], 0
    for width in reversed(widths):
        out.append(layout.delimiter.join(fields[at : at + width]))
        edits += [("delete delimiter", at)] * (width - 1) if width else [("insert delimiter", at)]
        at += width
    return spare, edits, out


def parse_line(line: str, layout: Layout) -> tuple[str | None, list[str], int, list[str]]:
    """(reason or None, fields as read or repaired, cost, edits). Cost 0 and no reason: the line is a row.

    The reason is `quoting` if no way to read the line does without touching quotes, whatever the number of columns.
    """
    parts = marks(line, layout.delimiter)
    cost, edits, fields = settle_quotes(parts, layout.delimiter)
    reason = "quoting" if cost else "columns" if len(fields) != len(layout.columns) else None
    if cost:  # the least edits of both kinds together; quotes that are legal as they stand are left alone
        cost, edits, fields = settle_quotes(parts, layout.delimiter, len(layout.columns))
    cost2, more, fields = settle_delimiters(fields, layout)
    if reason is None:
        reason = next((c.reason for c in layout.checks if c.fails(fields[c.column])), None)
    return reason, fields, cost + cost2, [f"{what} at {at}" for what, at in edits + more]


def _parse(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse_line(x or "", layout) for x in b.column("line").to_pylist()]
            reason, fields, cost, edits = zip(*got, strict=True) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("line"), pa.array(fields, pa.list_(pa.string())), pa.array(reason, pa.string()), pa.array(cost, pa.int32()), pa.array(edits, pa.list_(pa.string()))],
                ["key", "line", "fields", "reason", "cost", "edits"],
            )

    return run


def read_lines(df: DataFrame, key: str, line: str, layout: Layout) -> DataFrame:
    """(key, line, fields, reason, cost, edits) of every line; reason is null for the valid ones.

    Reasons: `quoting` - a quote is illegal where it stands or never closed; `columns` - not the layout's number of
    fields; then the layout's checks in their order. `fields` are as read, or as the cheapest repair gives them. A byte
    order mark before the line is dropped; an empty or null line has one empty field; lines may be of any length; keys
    may repeat or be null; an empty table gives no rows; other columns are ignored.
    """
    n, sep = len(layout.columns), re.escape(layout.delimiter)
    rows = df.select(F.col(key).alias("key"), F.regexp_replace(F.coalesce(F.col(line).cast("string"), F.lit("")), "^\\x{FEFF}", "").alias("line"))
    # only fields without a quote inside: single-character loops, which need no stack for long lines
    one = f'(?:"[^"]*"|[^"{sep}]*)'
    plain = F.col("line").rlike(f"^{sep.join([one] * n)}$") & ~F.col("line").contains("\n") & ~F.col("line").contains("\r")
    fields = F.array(*[F.regexp_replace(F.regexp_extract("line", "^" + sep.join([f"({one})" if i == k else one for i in range(n)]) + "$", 1), '"', "") for k in range(n)])
    fast = rows.where(plain).withColumn("fields", fields)
    reason = F.lit(None).cast("string")
    for c in reversed(layout.checks):
        reason = F.when(c.column_fails(F.get("fields", F.lit(c.column))), F.lit(c.reason)).otherwise(reason)
    fast = fast.select("key", "line", "fields", reason.alias("reason"), F.lit(0).alias("cost"), F.array().cast("array<string>").alias("edits"))
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *T._parse_datatype_string("line string, fields array<string>, reason string, cost int, edits array<string>").fields])
    slow = rows.where(~plain).mapInArrow(_parse(layout), schema)
    out = fast.unionByName(slow)
    return out.withColumnRenamed("key", key)
