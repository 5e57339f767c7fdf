"""The cleaning order of a master set: missing values, encoding, correlation, outliers, scaling, row id."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import cleaning, columns, encoding, selection


@dataclass(frozen=True)
class MasterSet:
    frame: DataFrame
    encoding: encoding.OneHot
    dropped: dict[str, list[str]] = field(default_factory=dict)


def build_master(df: DataFrame, target: str | None, protected: Sequence[str] = (), order: Sequence[str] = (),
                 outliers: str | None = "single_pass", row_id: str = "master_id") -> MasterSet:
    """Clean a merged table for modelling.

    ``protected`` columns pass through untouched; ``order`` states the order of the dense row id;
    ``outliers`` is the mode of ``cleaning.without_outliers`` or None to keep all rows.
    """
    if target:
        df = columns.coerced_numeric(df, target)
    safe = {*protected, *([target] if target else [])}
    plan = cleaning.imputation(df, sorted(safe))
    full = plan.apply(df)
    texts = [c for c, t in full.dtypes if t == "string" and c not in safe]
    coded, mapping = encoding.one_hot(full, texts)
    shielded = safe | set(mapping.mapping)
    dropped = {"missing": plan.dropped, "weak": [], "redundant": [], "proxies": []}

    def numbers(frame):
        return [c for c in frame.columns if c not in shielded and columns.is_numeric(frame, c)]

    if target and columns.is_numeric(coded, target):
        # One pass gives the correlations with the target that three of the rules need.
        corr = {r["feature"]: r["corr"] for r in selection.target_correlations(coded, target, numbers(coded)).collect()} if numbers(coded) else {}
        dropped["weak"] = [c for c, v in corr.items() if v is not None and abs(v) < 0.01]
        coded = coded.drop(*dropped["weak"])
        dropped["redundant"] = selection.redundant_features(coded, numbers(coded)) if len(numbers(coded)) > 1 else []
        dropped["proxies"] = [c for c in numbers(coded) if c not in dropped["redundant"] and corr.get(c) is not None and abs(corr[c]) >= 0.90]
        coded = coded.drop(*dropped["redundant"], *dropped["proxies"])
        close = {c for c, v in corr.items() if v is not None and abs(v) >= 0.50}
    else:
        if len(numbers(coded)) > 1:
            dropped["redundant"] = selection.redundant_features(coded, numbers(coded))
        coded, close = coded.drop(*dropped["redundant"]), set()
    if outliers:
        coded = cleaning.without_outliers(coded, [c for c in numbers(coded) if c not in close], mode=outliers)
    scaled = cleaning.min_max_scaled(coded, numbers(coded)) if numbers(coded) else coded
    final = columns.with_row_id(scaled, list(order), row_id) if order else scaled
    return MasterSet(final, mapping, dropped)
