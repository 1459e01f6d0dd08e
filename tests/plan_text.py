"""What a plan did, read from its text after it ran."""

from __future__ import annotations

import contextlib
import io
import re


def executed_plan(df) -> str:
    """The formatted final plan, subqueries included, after running it once."""
    text = io.StringIO()
    df.collect()  # the frame's own plan is final only once the frame itself has run
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return re.sub(r"\+- == Initial Plan ==.*?(?=\n\n)", "", text.getvalue(), flags=re.S)


def exchanges(plan: str, partitioning: str) -> int:
    """Shuffles of the final plan whose partitioning starts with the given text."""
    ids = set(re.findall(r"^[ :+\-*]*Exchange +\((\d+)\)", plan, re.M))
    details = re.findall(r"^\((\d+)\) Exchange\b.*?^Arguments: (.*?)$", plan, re.M | re.S)
    return sum(1 for i, text in details if i in ids and text.startswith(partitioning))


def scans(plan: str, table: str) -> int:
    """How often the plan reads a table; reused exchanges do not read again."""
    ids = set(re.findall(r"^[ :+\-*]*Scan parquet +\((\d+)\)", plan, re.M))
    located = re.findall(r"^\((\d+)\) Scan parquet.*?Location: \S+ \[([^\]]*)\]", plan, re.M | re.S)
    return sum(1 for i, path in located if i in ids and path.endswith(f"/{table}.parquet"))


def shuffled_rows(df) -> list[int]:
    """Rows written by each shuffle of the final plan, after running it once."""
    df.collect()
    found, open_plans = [], [df._jdf.queryExecution().executedPlan()]
    while open_plans:
        plan = open_plans.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            open_plans.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            open_plans.append(plan.plan())
        if kind == "ShuffleExchangeExec":
            found.append(plan.metrics().apply("shuffleRecordsWritten").value())
        children = plan.children()
        open_plans += [children.apply(i) for i in range(children.size())]
    return found
