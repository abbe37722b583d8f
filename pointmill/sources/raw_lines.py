"""Rows that fail to parse: bulk parsing with bisection, strict diagnosis of the rest.

A block of lines of one layout is parsed by one columnar pass (field extraction by regular expression,
casts of whole columns, range checks of whole columns).  If any line of a block does not take that path, the
block is halved until the lines in question stand alone; those are read field by field, which either accepts
them (unusual but valid spellings) or names the reason.

Layouts: xyz (at least three fields), scene7 (X Y Z Intensity R G B), csv6 (X,Y,Z,NX,NY,NZ), csv7
(csv6 and SegmentID).  Null lines, lines of nothing but blanks and lines starting with # are skipped.
An unknown or null layout is diagnosed as 'layout'.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
LEAF_ROWS = 8
#: Field kinds of a layout: c coordinate, n normal component, w whole number, b whole number in 0..255, s whole number >= 0.
KINDS = {"xyz": "ccc", "scene7": "cccwbbb", "csv6": "cccnnn", "csv7": "cccnnns"}
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
WHOLE = r"[+-]?[0-9]+"
POINT_SCHEMA = "line_id bigint, file_name string, line_num bigint, layout string, x double, y double, z double, nx double, ny double, nz double, intensity bigint, r bigint, g bigint, b bigint, segment_id bigint, reason string, line string"
NAMES = {"xyz": ["x", "y", "z"], "scene7": ["x", "y", "z", "intensity", "r", "g", "b"], "csv6": ["x", "y", "z", "nx", "ny", "nz"], "csv7": ["x", "y", "z", "nx", "ny", "nz", "segment_id"]}


def _row_pattern(layout: str) -> str:
    # Digits are bounded so that whole numbers surely fit a bigint; longer ones are left to the strict reader.
    kinds = ["-?[0-9]{1,15}" if k in "wbs" else r"-?[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]{1,3})?" for k in KINDS[layout]]
    if layout.startswith("csv"):
        fields = [rf'[ \t]*(?P<f{i}>{k}|"{k}")[ \t]*' for i, k in enumerate(kinds)]
        return "^" + ",".join(fields) + "\r?[ \t]*$"
    fields = [rf"(?P<f{i}>{k})" for i, k in enumerate(kinds)]
    tail = r"(?:\r|[ \t].*)?$" if layout == "xyz" else "[ \t]*\r?[ \t]*$"
    return "^[ \t]*" + r"[ \t]+".join(fields) + tail


def extract(lines: pa.Array, layout: str) -> tuple[list[pa.Array], np.ndarray]:
    """Field texts of a whole block, and how many of its first i lines took the pattern."""
    found = pc.extract_regex(lines, _row_pattern(layout))
    texts = [pc.struct_field(found, f"f{i}") for i in range(len(KINDS[layout]))]
    if layout.startswith("csv"):
        texts = [pc.utf8_trim(t, '"') for t in texts]
    return texts, np.concatenate([[0], np.cumsum(pc.is_valid(found).to_numpy(zero_copy_only=False))])


def bulk(texts: list[pa.Array], at: int, n: int, layout: str) -> list[np.ndarray] | None:
    """Columns of n lines, or None if a value of any of them is not plainly valid."""
    out = []
    for text, k in zip(texts, KINDS[layout]):
        try:
            col = pc.cast(text.slice(at, n), pa.int64() if k in "wbs" else pa.float64()).to_numpy()
        except pa.ArrowInvalid:
            return None
        if k in "cn" and not np.abs(col).max() <= (1.0 if k == "n" else np.finfo(float).max):
            return None
        if (k == "b" and not (col.min() >= 0 and col.max() <= 255)) or (k == "s" and col.min() < 0):
            return None
        out.append(col)
    return out


def split_csv(line: str) -> list[str] | None:
    """Fields of a csv line, or None if its quotes are broken."""
    fields, i, n = [], 0, len(line)
    while True:
        while i < n and line[i] in " \t":
            i += 1
        if i < n and line[i] == '"':
            i, part = i + 1, []
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                part.append(line[i:j])
                if line[j + 1 : j + 2] != '"':
                    break
                part.append('"')
                i = j + 2
            i = j + 1
            while i < n and line[i] in " \t":
                i += 1
            if i < n and line[i] != ",":
                return None
            fields.append("".join(part))
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            field = line[i:j].rstrip(" \t")
            if '"' in field:
                return None
            fields.append(field)
            i = j
        if i >= n:
            return fields
        i += 1


def _value(text: str, kind: str) -> float | int | None:
    if kind in "wbs":
        if not re.fullmatch(WHOLE, text):
            return None
        digits = text.lstrip("+-").lstrip("0") or "0"
        # Twenty digits are beyond a bigint whatever follows, so longer numbers need no conversion.
        v = int(digits[:20]) * (-1 if text[0] == "-" else 1)
        if (kind == "b" and not 0 <= v <= 255) or (kind == "s" and v < 0):
            return None
        return v
    if not re.fullmatch(NUMBER, text):
        return None
    f = float(text)
    if f in (float("inf"), float("-inf")) or (kind == "n" and not -1 <= f <= 1):
        return None
    return f


def strict(line: str, layout: str) -> tuple[list | None, str | None]:
    """(values, None) of a valid line, else (None, reason); ([], None) for a line to be skipped."""
    body = line.strip(" \t")
    if body.endswith("\r"):
        body = body[:-1].rstrip(" \t")
    if not body or line[0] == "#":
        return [], None
    if layout not in KINDS:
        return None, "layout"
    kinds = KINDS[layout]
    if layout.startswith("csv"):
        fields = split_csv(body)
        if fields is None:
            return None, "quoting"
        if len(fields) != len(kinds):
            return None, "columns"
    else:
        fields = re.split(r"[ \t]+", body)
        if len(fields) < 3 or (layout == "scene7" and len(fields) != 7):
            return None, "columns"
    values = [_value(t, k) for t, k in zip(fields, kinds)]
    return (None, "value") if None in values else (values, None)


def parse_block(lines: pa.Array, layout: str) -> tuple[dict[int, list], dict[int, str], list[tuple[int, list[np.ndarray]]]]:
    """(values of strictly read lines, reasons of failing ones, (offset, columns) of bulk-parsed runs)."""
    single: dict[int, list] = {}
    failed: dict[int, str] = {}
    runs: list[tuple[int, list[np.ndarray]]] = []
    texts, taken = extract(lines, layout) if layout in KINDS else ([], np.zeros(len(lines) + 1))
    todo = [(0, len(lines))]
    while todo:
        at, n = todo.pop()
        cols = bulk(texts, at, n, layout) if taken[at + n] - taken[at] == n else None
        if cols is not None:
            runs.append((at, cols))
        elif n > LEAF_ROWS and layout in KINDS:
            todo += [(at, n // 2), (at + n // 2, n - n // 2)]
        else:
            for i in range(at, at + n):
                values, reason = strict(lines[i].as_py(), layout)
                if reason:
                    failed[i] = reason
                elif values:
                    single[i] = values
    return single, failed, runs


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["x", "y", "z", "nx", "ny", "nz", "intensity", "r", "g", "b", "segment_id"]
    whole = {"intensity", "r", "g", "b", "segment_id"}
    for batch in batches:
        table = pa.table(batch)
        table = table.filter(pc.is_valid(table["line"]))
        for layout in pc.unique(table["layout"]).to_pylist():
            own = table.filter(pc.is_null(table["layout"]) if layout is None else pc.equal(table["layout"], layout))
            for start in range(0, own.num_rows, BLOCK_ROWS):
                part = own.slice(start, BLOCK_ROWS).combine_chunks()
                lines = part["line"].combine_chunks()
                single, failed, runs = parse_block(lines, layout)
                n = part.num_rows
                cols = {c: np.zeros(n, dtype=np.int64 if c in whole else np.float64) for c in names}
                good = np.zeros(n, dtype=bool)
                for at, got in runs:
                    good[at : at + len(got[0])] = True
                    for c, v in zip(NAMES[layout], got):
                        cols[c][at : at + len(v)] = v
                wide: dict[str, dict[int, int]] = {}
                for i, values in single.items():
                    good[i] = True
                    for c, v in zip(NAMES[layout], values):
                        # A valid whole number beyond a bigint cannot be stored; it comes out as null.
                        if c in whole and not -(2**63) <= v < 2**63:
                            wide.setdefault(c, {})[i] = v
                        else:
                            cols[c][i] = v
                reason = [failed.get(i) for i in range(n)]
                has = set(NAMES.get(layout, ()))
                arrays = []
                for c in names:
                    hide = ~good if c in has else np.ones(n, dtype=bool)
                    for i in wide.get(c, ()):
                        hide[i] = True
                    arrays.append(pa.array(cols[c], mask=hide))
                bad = np.array([r is not None for r in reason])
                text = pc.if_else(pa.array(bad), lines, pa.scalar(None, pa.string()))
                out = pa.RecordBatch.from_arrays(
                    [part["line_id"].combine_chunks(), part["file_name"].combine_chunks(), part["line_num"].combine_chunks(), part["layout"].combine_chunks(), *arrays, pa.array(reason, pa.string()), text],
                    names=["line_id", "file_name", "line_num", "layout", *names, "reason", "line"],
                )
                yield out.filter(pa.array(good | bad))


def parse_lines(raw: DataFrame) -> DataFrame:
    """Every valid and every failing line of ``raw``; reason (and line) are null exactly for valid ones.

    Lines to be skipped do not come out.  One pass, no shuffle; other columns of ``raw`` are not read.
    """
    return raw.select("line_id", "file_name", "line_num", "layout", "line").mapInArrow(_parse, POINT_SCHEMA)


def failing_lines(raw: DataFrame) -> DataFrame:
    """(line_id, reason) of the failing lines (p2_found)."""
    return parse_lines(raw).where(F.col("reason").isNotNull()).select("line_id", "reason")
