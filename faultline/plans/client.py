"""What a caller of the service gets: nested answers, kept by their arguments, and nothing where something fails."""

from __future__ import annotations

import asyncio
import logging

from pyspark.sql import DataFrame

from faultline.plans.engine import Engine
from faultline.plans.timing import timed

logger = logging.getLogger("faultline")
FIELDS = ("row_id", "tc_uuid", "soc", "model", "reason", "cluster_name", "cluster_class")


class TooManyRows(ValueError):
    """An answer too large for one message; the frame itself is what to read then."""


def nested(rows: DataFrame, most: int = 100_000) -> dict:
    """AG06, AG07: {"type": {type: {runtime: {cluster: [row]}}}, "model": {model: [row]}} of at most `most` rows, taken
    from the executors a partition at a time."""
    kept = [c for c in ("type", "runtime", *FIELDS) if c in rows.columns]
    out: dict = {"type": {}, "model": {}}
    for k, row in enumerate(rows.select(kept).orderBy("row_id").toLocalIterator()):
        if k >= most:
            raise TooManyRows(f"more than {most} rows")
        entry = {c: row[c] for c in FIELDS if c in kept}
        runtime = row["runtime"] if "runtime" in kept else None
        out["type"].setdefault(row["type"], {}).setdefault(runtime, {}).setdefault(row["cluster_name"], []).append(entry)
        if "model" in kept:
            out["model"].setdefault(row["model"], []).append(entry)
    return out


class RegressionClient:
    """RP10: regressions between two runs as a nested answer; an error is logged and the answer is {}."""

    def __init__(self, engine: Engine) -> None:
        self.engine = engine
        self.known: dict[tuple[str, str], dict] = {}

    @timed
    def cluster_info(self, new: str, old: str, force: bool = False) -> dict:
        """API03: kept for the pair of runs, whichever is named first, unless `force`."""
        try:
            key = self.engine.newer_first(new, old)
            if force or key not in self.known:
                self.known[key] = {"status": 200, **nested(self.engine.regressions(*key))}
            return self.known[key]
        except Exception:
            logger.exception("no regressions of %s and %s", new, old)
            return {}

    async def cluster_info_async(self, new: str, old: str, force: bool = False) -> dict:
        return await asyncio.to_thread(self.cluster_info, new, old, force)
