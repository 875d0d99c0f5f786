"""A runner for scans of files by an outside function, under a budget of requests and time.

Requests are dealt to slots in their order, the first to each slot before the second to any. A slot is one task that calls the function for one file
after another until its budget is spent; what is left is refused. So a budget bounds what is asked in all, by slots, and results found before it was
spent stay. Each file gives rows, whatever happened to it, and refused and failed ones are told, so that another search may take them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.tables import ship, written

ANSWER = "rule_id string, severity string, line_number int, explanation string"
ROW = f"file_path string, outcome string, {ANSWER}, message string"
#: Rows that are numbered in one task to be dealt out; more are dealt by hash.
ORDERED = 100_000


@dataclass(frozen=True)
class Budget:
    """slots: how many tasks ask at once. requests, seconds: what each of them may spend; None: no bound. interval: seconds
    that a slot waits between two requests at least."""

    slots: int = 1
    requests: int | None = None
    seconds: float | None = None
    interval: float = 0.0


def scanner(run: Callable[[str, str], Iterable[tuple]], budget: Budget, clock: Callable[[], float] = time.monotonic):
    """The table function: of (file_path, text) rows in their order, rows of ROW."""
    from pyspark.sql.functions import udtf

    class Scan:
        def __init__(self) -> None:
            self.asked, self.began, self.last = 0, None, None

        def eval(self, row):
            now = clock()
            self.began = now if self.began is None else self.began
            spent = budget.requests is not None and self.asked >= budget.requests or budget.seconds is not None and now - self.began >= budget.seconds
            if spent:
                yield row["file_path"], "refused", None, None, None, None, f"budget spent after {self.asked} requests"
                return
            if budget.interval and self.last is not None:
                time.sleep(max(0.0, self.last + budget.interval - now))
            self.asked, self.last = self.asked + 1, clock()
            try:
                answers = [tuple(a) for a in run(row["file_path"], row["text"])]
            except Exception as e:  # noqa: BLE001  one file's failure is its own
                yield row["file_path"], "failed", None, None, None, None, f"{type(e).__name__}: {e}"
                return
            for a in answers or [(None, None, None, None)]:
                yield (row["file_path"], "answered", *a, None)

    return udtf(Scan, returnType=ROW)


def run_scans(requests: DataFrame, run: Callable[[str, str], Iterable[tuple]], budget: Budget = Budget(), order: list[str] = ("file_path",), clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """requests (file_path, text): rows of ROW, at least one a file. outcome: answered (without a rule if nothing was found), failed or refused.

    run: (file_path, text) -> (rule_id, severity, line_number, explanation) each; importable where executors run. It is called once a file, but again
    for the files of a task that was lost. The rows are written, so using them twice asks nothing twice. Equal paths are requests each.
    """
    ship(requests.sparkSession)
    rows = written(requests.select("file_path", "text", *[c for c in order if c not in ("file_path", "text")]), "requests")
    if rows.count() <= ORDERED:
        rank = F.row_number().over(Window.orderBy(*order, "file_path", "text"))
        dealt = rows.withColumns({"__rank": rank, "__slot": rank % budget.slots})
    else:
        dealt = rows.withColumns({"__rank": F.lit(0), "__slot": F.pmod(F.xxhash64("file_path", "text"), F.lit(budget.slots))})
    table = dealt.asTable().partitionBy("__slot").orderBy("__rank", *order, "file_path", "text")
    return written(scanner(run, budget, clock)(table), "scans")


def answers_of(scans: DataFrame) -> DataFrame:
    """What was found: file_path and ANSWER."""
    return scans.where("outcome = 'answered' and rule_id is not null").select("file_path", *[f.split()[0] for f in ANSWER.split(", ")])


def unanswered(scans: DataFrame) -> DataFrame:
    """Files that were refused or failed (file_path), for a search of another kind."""
    return scans.where("outcome <> 'answered'").select("file_path").distinct()
