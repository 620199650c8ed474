"""SQL notebook cells (C1): run cells in order on one session, frame the output.

Cells run one after another on the same session, so a later cell sees the
temp views an earlier one created.  A failing cell yields an error frame
and does not discard the frames already produced.  Only
``limit`` rows of a result are ever brought back, so a cell over a huge
table returns a bounded payload.
"""

from __future__ import annotations

import contextlib
import json
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lakeops.functions import exprs as X

# Fixed value: rows framed per result when no limit is given.
DEFAULT_FRAME_ROWS = 100

FRAME_SCHEMA = "cell int, pos int, type string, text string"


@dataclass
class CellResult:
    cell: int
    text: str | None
    error: str | None


@contextlib.contextmanager
def _quiet_sql_errors():
    """The failing cell's error becomes a frame; keep PySpark from also logging it."""
    log = logging.getLogger("SQLQueryContextLogger")
    was = log.disabled
    log.disabled = True
    try:
        yield
    finally:
        log.disabled = was


def run_sql_cells(spark: SparkSession, cells: list[str], limit: int = DEFAULT_FRAME_ROWS) -> list[CellResult]:
    """Run every cell in order; a cell's result is read before the next cell runs.

    Errors, of analysis or of evaluation, are captured per cell.
    """
    out = []
    with _quiet_sql_errors():
        for i, sql in enumerate(cells):
            try:
                out.append(CellResult(i, _result_text(spark.sql(sql), limit), None))
            except Exception as e:  # noqa: BLE001 - any analysis/runtime error becomes an error frame
                out.append(CellResult(i, None, f"{type(e).__name__}: {e}".splitlines()[0]))
    return out


def _result_text(df: DataFrame, limit: int) -> str:
    shown = X.cell_text_frame(df.limit(limit))
    rows = [list(r) for r in shown.collect()]
    return json.dumps({"columns": df.columns, "rows": rows}, ensure_ascii=False)


def frames(spark: SparkSession, results: list[CellResult]) -> DataFrame:
    """(cell, pos, type, text) frames: ``result`` JSON or ``error`` message."""
    rows = [(r.cell, 0, "result", r.text) if r.error is None else (r.cell, 0, "error", r.error) for r in results]
    return spark.createDataFrame(rows, FRAME_SCHEMA)
