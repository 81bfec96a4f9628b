"""Exports of an analysis: report model and its renderings, data dictionary, preparation script and notebook, file stems."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.cleaning import mask_personal
from ..operators.model import Plan

DICTIONARY = ["column", "role", "is_target", "present", "missing", "missing_pct", "distinct", "min", "median", "max", "mean", "top_values", "notes"]


def stem(name: str | None) -> str:
    """A safe file name stem: "My data (v2).csv" gives datassay-my-data-v2."""
    base = re.sub(r"\.[^.]+$", "", name or "").lower()
    return "datassay-" + (re.sub(r"^-|-$", "", re.sub(r"[^a-z0-9]+", "-", base)) or "report")


def data_dictionary(counts: DataFrame, profile: DataFrame, statistics: DataFrame | None, quality: DataFrame, target: str | None) -> DataFrame:
    """DICTIONARY, a row a column; the commonest values only where there are at most fifty, masked."""
    from ..operators.profile import levels

    lev = levels(counts).withColumn("i", F.row_number().over(Window.partitionBy("col").orderBy(F.desc("n"), "key"))).where("i <= 3")
    top = lev.groupBy("col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "label", "n"))), lambda s: F.concat(mask_personal(s["label"]), F.lit(" ("), s["n"].cast("string"), F.lit(")"))), "; ").alias("top_values"))
    flags = quality.select("col", F.array_join(F.array_compact(F.array(*[F.when(F.col(c), c.replace("_", " ")) for c in ("mixed_numeric", "possible_code", "constant", "high_cardinality")])), "; ").alias("notes"))
    stats = statistics.select("col", F.col("min").alias("lo"), "median", F.col("max").alias("hi"), "mean") if statistics is not None else profile.sparkSession.createDataFrame([], "col string, lo double, median double, hi double, mean double")
    both = profile.join(F.broadcast(stats), "col", "left").join(F.broadcast(flags), "col", "left").join(F.broadcast(top), "col", "left")  # a row a column
    pct = F.floor(F.coalesce(F.try_divide(F.col("missing"), F.col("rows")), F.lit(0.0)) * 1000 + 0.5) / 10
    shown = F.when(F.col("distinct").between(1, 50), F.col("top_values")).otherwise("")
    return both.orderBy("pos").select(
        F.col("col").alias("column"), "role", F.when(F.col("col") == F.lit(target or ""), "yes").otherwise("no").alias("is_target"), "present", "missing", pct.alias("missing_pct"), "distinct",
        F.col("lo").alias("min"), "median", F.col("hi").alias("max"), "mean", F.coalesce(shown, F.lit("")).alias("top_values"), F.coalesce("notes", F.lit("")).alias("notes"),
    )


def report_model(result: dict[str, DataFrame], name: str, target: str | None = None) -> dict:
    """title, facts (pairs) and sections (heading, blocks of p, list or table), with the fifteen strongest associations; rows of data are not in it."""
    one = lambda key: [r.asDict() for r in result[key].collect()] if key in result else []  # noqa: E731  small tables
    profile, health, ready = one("profile"), one("health"), one("readiness")
    rows = profile[0]["rows"] if profile else 0
    quality = one("quality_score")
    facts = [
        ("rows", rows), ("columns", len(profile)), ("target", target or "none"), ("verdict", ready[0]["verdict"] if ready else ""),
        ("health", f"{health[0]['score']} ({health[0]['grade']})" if health else ""), ("quality", quality[0]["score"] if quality else ""), ("missing cells", sum(r["missing"] for r in profile)),
    ]
    strongest = sorted((r for r in one("associations") if r["abs_value"] is not None), key=lambda r: (-r["abs_value"], r["col"]))[:15]
    sections = [
        ("Readiness", [("list", [f"{r['level']}: {r['finding']}" for r in ready])]),
        ("What to do", [("list", [f"{r['priority']}: {r['col'] + ': ' if r['col'] else ''}{r['action']}" for r in one("recommendations")])]),
        ("Columns", [("table", [[r["col"], r["role"], r["present"], r["missing"], r["distinct"]] for r in profile], ["column", "role", "present", "missing", "distinct"])]),
        ("Associations with the target", [("table", [[r["col"], r["metric"], r["value"], r["n"], r["p"]] for r in strongest], ["column", "measure", "value", "rows", "p"])] if strongest else [("p", "no column was measured")]),
    ]
    return {"title": name, "facts": facts, "sections": sections}


def to_markdown(model: dict) -> str:
    mark = lambda v: str(v).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")
    line = lambda cells: "| " + " | ".join(map(mark, cells)) + " |"
    out = [f"# {mark(model['title'])}", "", *[f"* {mark(k)}: {mark(v)}" for k, v in model["facts"]]]
    for heading, blocks in model["sections"]:
        out += ["", f"## {mark(heading)}", ""]
        for b in blocks:
            out += [mark(b[1])] if b[0] == "p" else [f"* {mark(x)}" for x in b[1]] if b[0] == "list" else [line(b[2]), "|" + "---|" * len(b[2]), *map(line, b[1])]
    return "\n".join(out) + "\n"


def to_html(model: dict) -> str:
    safe = lambda v: html.escape(str(v))
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{safe(c)}</{tag}>" for c in cells) + "</tr>"
    body = [f"<h1>{safe(model['title'])}</h1><dl>", *[f"<dt>{safe(k)}</dt><dd>{safe(v)}</dd>" for k, v in model["facts"]], "</dl>"]
    for heading, blocks in model["sections"]:
        body.append(f"<h2>{safe(heading)}</h2>")
        for b in blocks:
            body.append(f"<p>{safe(b[1])}</p>" if b[0] == "p" else "<ul>" + "".join(f"<li>{safe(x)}</li>" for x in b[1]) + "</ul>" if b[0] == "list" else "<table>" + row(b[2], "th") + "".join(row(r, "td") for r in b[1]) + "</table>")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{safe(model['title'])}</title></head><body>{''.join(body)}</body></html>"


def to_json(result: dict[str, DataFrame], name: str) -> str:
    """Every result table, whole; a preview of the data is left out."""
    return json.dumps({"name": name, "tables": {k: [r.asDict(recursive=True) for r in v.toLocalIterator()] for k, v in result.items() if k != "snapshot"}}, default=str)


def preparation_script(plan: Plan, rules: list[dict] = (), cutoff: tuple[str, str] | None = None, model: bool = True) -> str:
    """A runnable PySpark script of the plan, in seven numbered parts; cutoff: (date column, time) splits by time."""
    q = json.dumps
    parts = [
        ("Read", ["from pyspark.sql import SparkSession", "from pyspark.sql import functions as F", "from datassay.operators import cleaning, model, timechecks", "from datassay.sources.delimited import read_delimited", "", "spark = SparkSession.builder.getOrCreate()", 'df, intake = read_delimited(spark, "your_file.csv")']),
        ("Clean", [f"df = cleaning.clean(df, {list(rules)!r})"] if rules else ["# no rules were accepted"]),
        ("Choose rows", [f"plan = model.{plan!r}", "rows, classes = model.encode_target(model.usable_rows(df, plan), plan)"]),
        ("Split", [f"train, test = timechecks.time_split(rows, {q(cutoff[0])}, {q(cutoff[1])})"] if cutoff else [f"side = F.pmod(F.xxhash64(F.lit(42), F.col({q("`" + plan.group_by + "`")})), F.lit(5))  # no group on both sides" if plan.group_by else "side = F.pmod(F.xxhash64(F.lit(42), *[F.col(f\"`{c}`\") for c in rows.columns]), F.lit(5))", "train, test = rows.where(side != 0), rows.where(side == 0)"]),
        ("Fit the preparation on the training rows", ["parts = model.fit(train, plan)"]),
        ("Apply it", ['x, names = model.transform(train, parts, ["datassay_y"])', 'z, _ = model.transform(test, parts, ["datassay_y"])', "# outputs get plain names: levels may hold any sign", 'inputs = [f"x{i}" for i in range(len(names))]', 'x, z = (d.toDF("datassay_y", *inputs) for d in (x, z))']),
        ("Model", ["from pyspark.ml.feature import VectorAssembler", f"from pyspark.ml.{'classification import LogisticRegression' if plan.task == 'classification' else 'regression import LinearRegression'}", "", 'features = VectorAssembler(inputCols=inputs, outputCol="features")', f"fitted = {'LogisticRegression' if plan.task == 'classification' else 'LinearRegression'}(labelCol=\"datassay_y\", regParam=0.01).fit(features.transform(x))", "fitted.transform(features.transform(z)).show()"] if model else ["x.show()"]),
    ]
    return "\n".join("\n".join([f"# ── {i} {title}", *lines, ""]) for i, (title, lines) in enumerate(parts, 1))


def to_notebook(script: str) -> str:
    """A script as a notebook (format 4.4), a heading and a cell of code for each numbered part."""
    cells = []
    for part in re.split(r"(?m)^(?=# ── \d+ )", script):
        if part.strip():
            head, _, body = part.partition("\n")
            title = re.sub(r"^# ── \d+ ", "", head)
            cells += [{"cell_type": "markdown", "metadata": {}, "source": [f"## {title}"]}, {"cell_type": "code", "metadata": {}, "execution_count": None, "outputs": [], "source": body.strip("\n").splitlines(keepends=True)}]
    return json.dumps({"cells": cells, "metadata": {"kernelspec": {"display_name": "Python 3", "language": "python", "name": "python3"}, "language_info": {"name": "python"}}, "nbformat": 4, "nbformat_minor": 4})
