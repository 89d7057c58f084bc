"""CSV without a header: every row is a sequence of strings."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

from .. import value as V
from ..errors import CsvError
from .stream import as_file

csv.field_size_limit(2**31 - 1)


def decode(data) -> Iterator[tuple]:
    """Rows of equal width; blank lines are skipped, empty cells are empty strings."""
    width = None
    try:
        for row in csv.reader(io.TextIOWrapper(as_file(data), "utf-8", newline="")):
            if not row:
                continue
            width = width or len(row)
            if len(row) != width:
                raise CsvError(f"a row of {len(row)} cells after rows of {width}")
            yield ("q", [("s", cell) for cell in row])
    except UnicodeDecodeError as e:
        raise CsvError("not UTF-8") from e
    except csv.Error as e:
        raise CsvError(str(e)) from e


def cell(v) -> str:
    tag = v[0]
    if tag in ("s", "c"):
        return v[1]
    if tag in V.INTEGERS or tag in V.FLOATS or tag == "b":
        return V.display(v)
    raise CsvError(f"a cell can't hold {tag}")


def encode(v) -> bytes:
    """A row; only sequences are rows."""
    if v[0] != "q":
        raise CsvError(f"a row must be a sequence, not {v[0]}")
    cells = [cell(x) for x in v[1]]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerow(cells)
    return out.getvalue().encode()
