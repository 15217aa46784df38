"""Reports: metric tables rendered as text.  The tables are small whatever the input; they stay DataFrames until here."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import evaluation as A
from ..operators import profile as R


def lines(title: str, table: DataFrame, most: int = 200) -> list[str]:
    """A titled table with aligned columns."""
    rows = [table.columns, *[["" if v is None else str(v) for v in r] for r in table.limit(most).collect()]]
    width = [max(len(r[k]) for r in rows) for k in range(len(table.columns))]
    return [title, "-" * len(title), *["  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in rows], ""]


def profile_report(records: DataFrame, truth: DataFrame | None = None, targets: DataFrame | None = None) -> list[str]:
    """Missing values, duplicates, lengths and countries of records; matches and integrity of a ground truth."""
    out = [
        *lines("Missing values", R.missing_values(records)), *lines("Duplicate ids", R.duplicate_ids(records)), *lines("Duplicate values", R.duplicate_values(records)),
        *lines("Beyond ASCII", R.non_ascii(records)), *lines("Lengths", R.length_statistics(records)), *lines("Countries", R.country_counts(records)),
    ]
    if truth is not None:
        out += [*lines("Ground truth", R.truth_summary(truth)), *lines("Matches per record", R.match_counts(truth))]
        if targets is not None:
            out += [*lines("Integrity", R.integrity(truth, targets)), *lines("Coverage", R.target_coverage(truth, targets))]
    return out


def blocking_report(queries: DataFrame, truths: DataFrame, pairs: DataFrame, caps: tuple[int, ...] = A.CAPS) -> list[str]:
    return [
        *lines("Recall by cap", A.recall(truths, pairs, caps).orderBy("cap")), *lines("Records", A.entity_counts(queries, truths, pairs)),
        *lines("Candidates per record", A.count_distribution(queries, pairs)), *lines("Passes", A.pass_contributions(truths, pairs).orderBy("pass")),
    ]
