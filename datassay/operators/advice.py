"""Insight cards, and columns grouped for display: rules over small result tables."""

from __future__ import annotations

from .score import share_pct

RANK = {"critical": 0, "warning": 1, "info": 2, "success": 3}


def decisions(profile: list, leaks: list[str], target: str | None) -> dict[str, set[str]]:
    """dropped (identifier, empty, constant), replaced (mostly missing, constant with gaps), leaking columns; the target is in none."""
    own = [r for r in profile if r["col"] != target]
    dropped = {r["col"] for r in own if r["role"] == "identifier" or r["present"] == 0 or r["distinct_raw"] == 1 and r["missing"] == 0}
    replaced = {r["col"] for r in own if r["present"] and r["role"] != "identifier" and (r["rows"] and int(r["missing"] / r["rows"] * 100 + 0.5) > 50 or r["distinct_raw"] == 1 and r["missing"])}
    return {"dropped": dropped, "replaced": replaced, "leaking": set(leaks), "not_kept": dropped | replaced | set(leaks)}


def insights(profile: list, leaks: list[str], duplicates: int, target: str | None, statistics: list, pairs: list, associations: list, classes: list, imbalanced: bool, high_cardinality: list[str], clusters: list[str], dataset: str, most: int = 8) -> list[tuple[str, float, str, str]]:
    """(severity, score, title, subject), the `most` of the highest score, shown by severity.

    pairs: (a, b, r); classes: rows (label, n, pct), missing ones labelled (missing); clusters: columns with several strong partners.
    """
    by = {r["col"]: r for r in profile}
    rows = profile[0]["rows"] if profile else 0
    kept_of = decisions(profile, leaks, target)
    kept = lambda c: c not in kept_of["not_kept"] and c != target
    out: list[tuple[str, float, str, str]] = []
    say = lambda severity, score, title, subject="": out.append((severity, float(score), title, subject))
    goal = by.get(target)
    constant = bool(goal and goal["distinct_raw"] < 2)
    usable = bool(goal and not constant and goal["role"] != "identifier")
    names = lambda xs: ", ".join(xs)
    if constant:
        say("critical", 101, "the target never varies", target)
    for c in dict.fromkeys(leaks):
        say("critical", 100, "possible target leakage", c)
    pct = {r["col"]: share_pct(r["missing"], r["rows"]) for r in profile if r["missing"]}
    if sparse := [c for c, p in pct.items() if p > 50 and c != target and c not in kept_of["dropped"] | kept_of["leaking"]]:
        say("critical", 98, "more than half of the values are missing", names(sparse))
    seen = [c for c in classes if c["label"] != "(missing)"]
    majority = max((c["pct"] for c in seen), default=0.0)
    if usable and imbalanced and majority > 90:
        say("critical", 95, "severe class imbalance", target)
    if duplicates:
        say("warning", 80, "duplicate rows", str(duplicates))
    if moderate := [c for c, p in pct.items() if 5 < p <= 50 and kept(c)]:
        say("warning", 70 + 0.3 * max(pct[c] for c in moderate), "missing values", names(moderate))
    if goal and not constant and pct.get(target, 0) > 5:
        say("warning", 70 + 0.3 * min(50, pct[target]), "missing values in the target", target)
    strong = [(a, b, r) for a, b, r in pairs if kept(a) and kept(b)]
    if tied := [(a, b) for a, b, r in strong if abs(r) >= 0.9]:
        say("warning", 75, "highly correlated features", names(f"{a} and {b}" for a, b in tied[:2]))
    if usable and imbalanced and majority <= 90:
        say("warning", 72, "class imbalance", target)
    odd = sorted((s for s in statistics if s["outliers"] and kept(s["col"])), key=lambda s: (-s["outliers"], s["col"]))[:2]
    if odd:
        say("warning", 65, "outliers", names(s["col"] for s in odd))
    if fine := [c for c in high_cardinality if kept(c)]:
        say("warning", 62, "high-cardinality columns", names(fine))
    if flat := [r["col"] for r in profile if r["col"] in kept_of["dropped"] - kept_of["leaking"] and r["present"] and r["distinct_raw"] == 1]:
        say("warning", 68, "constant columns", names(flat))
    features = [r for r in profile if r["role"] in ("numeric", "binary", "categorical") and r["col"] != target]
    if len(features) >= 2 and rows:
        if rows / len(features) < 5:
            say("warning", 78, "few rows for the number of features", f"{rows / len(features):.1f}")
        elif rows / len(features) < 10:
            say("info", 55, "limited rows for the number of features", f"{rows / len(features):.1f}")
    if middle := [(a, b) for a, b, r in strong if 0.7 <= abs(r) < 0.9]:
        say("info", 50, "strong feature correlations", f"{middle[0][0]} and {middle[0][1]}")
    if len(own := [c for c in clusters if kept(c)]) >= 3:
        say("info", 48, "feature cluster", names(own))
    sizes = sorted(((r["abs_value"], r["col"]) for r in associations if r["abs_value"] is not None), key=lambda x: (-x[0], x[1]))
    if sizes and sizes[0][0] < 0.1:
        say("warning", 60, "no feature tells about the target", target)
    elif sizes and sizes[0][0] < 0.3:
        say("info", 45, "weak signal for the target", target)
    elif sizes:
        say("info", 48, "top predictors", names(c for _, c in sizes[:3]))
    if dates := [r["col"] for r in profile if r["role"] == "temporal" and r["col"] != target]:
        say("info", 50, "date columns", names(dates))
    if dataset == "Time Series":
        say("info", 58, "the target is a date: forecasting is not covered", target)
    tails = sorted((s for s in statistics if s["kurtosis"] > 3 and kept(s["col"])), key=lambda s: (-s["kurtosis"], s["col"]))[:3]
    if tails:
        say("info", 46, "heavy-tailed features", names(s["col"] for s in tails))
    if not pct and not duplicates:
        say("success", 40, "no missing values and no duplicates")
    if usable and classes and not imbalanced:
        say("success", 38, "classes are balanced", target)
    if not [p for p in pairs if abs(p[2]) >= 0.9] and sum(r["role"] == "numeric" for r in profile) >= 2:
        say("success", 35, "no highly correlated pairs")
    best = sorted(out, key=lambda x: -x[1])[:most]
    return sorted(best, key=lambda x: RANK[x[0]])


def by_role(roles: dict[str, str]) -> dict[str, list[str]]:
    """Columns of each role, in the table's order."""
    out: dict[str, list[str]] = {}
    for c, r in roles.items():
        out.setdefault(r, []).append(c)
    return out


def by_treatment(plan: list) -> dict[str, list[str]]:
    """Columns that are treated alike: (treatment, reason) as text -> columns."""
    out: dict[str, list[str]] = {}
    for r in plan:
        out.setdefault(r["treatment"] + (f" ({r['reason']})" if r["reason"] else ""), []).append(r["col"])
    return out
