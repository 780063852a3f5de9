"""Report exports, as lines in order, so that a report of any length is written in parallel."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

ORDER = ["phase", "owner", "rule_no", "item"]
HEADER = "severidad,regla,titulo,detalle,tabla,categoria"


def csv_field(c: Column) -> Column:
    v = F.coalesce(c, F.lit(""))
    return F.when(v.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_lines(issues: DataFrame) -> DataFrame:
    """(phase, owner, rule_no, item, line) of the issues; HEADER goes before them."""
    fields = [csv_field(F.col(c)) for c in ("severity", "rule_id", "title", "detail", "table_name", "category")]
    line = F.concat_ws(",", *fields)
    return issues.select(*ORDER, line.alias("line"))


def json_lines(issues: DataFrame) -> DataFrame:
    """(phase, owner, rule_no, item, line): each issue as a JSON object with all its fields."""
    return issues.select(*ORDER, F.to_json(F.struct("rule_id", "severity", "category", "title", "detail", "table_id", "table_name"), {"ignoreNullFields": "false"}).alias("line"))


#: Headings of the Markdown report by severity, in order.
SEVERITIES = [("error", "Errores"), ("warning", "Avisos"), ("info", "Sugerencias")]
TABLE_HEAD = "| Regla | Título | Tabla | Detalle |\n|-------|--------|-------|---------|"
NO_ISSUES = "No se han encontrado incidencias."


def markdown_lines(issues: DataFrame, score: DataFrame, name: str, day: str) -> DataFrame:
    """(section, phase, owner, rule_no, item, line): the report's head (section 0), then for each severity that occurs its heading and
    its issues. score: the row of lint_score with its counts by severity; day: the date as it is shown."""
    low, zero = F.lit(-1).cast("long"), [F.lit(0).cast("long").alias(c) for c in ORDER]
    head = F.concat(
        F.lit(f"# Informe de calidad — {name}\n\n- **Fecha:** {day}\n- **Puntuación:** "), F.col("score").cast("string"), F.lit("/100\n- **Errores:** "), F.col("n_error").cast("string"),
        F.lit("\n- **Avisos:** "), F.col("n_warning").cast("string"), F.lit("\n- **Sugerencias:** "), F.col("n_info").cast("string"), F.lit("\n"),
        F.when(F.col("n_error") + F.col("n_warning") + F.col("n_info") == 0, "\n" + NO_ISSUES).otherwise(""),
    )
    counts = issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    titles = issues.sparkSession.createDataFrame([(i + 1, s, t) for i, (s, t) in enumerate(SEVERITIES)], "section int, severity string, title string")
    headings = counts.join(F.broadcast(titles), "severity").select("section", *(low.alias(c) for c in ORDER), F.concat(F.lit("## "), "title", F.lit(" ("), F.col("n").cast("string"), F.lit(f")\n\n{TABLE_HEAD}")).alias("line"))
    row = F.concat(F.lit("| `"), "rule_id", F.lit("` | "), "title", F.lit(" | "), F.coalesce("table_name", F.lit("—")), F.lit(" | "), F.replace("detail", F.lit("|"), F.lit("\\|")), F.lit(" |"))
    number = F.array_position(F.array(*(F.lit(s) for s, _ in SEVERITIES)), F.col("severity")).cast("int")
    rows = issues.select(number.alias("section"), *(F.col(c).cast("long").alias(c) for c in ORDER), row.alias("line"))
    return score.select(F.lit(0).alias("section"), *zero, head.alias("line")).union(headings).union(rows)


def report_filename(name: str, kind: str) -> str:
    """informe-NAME.KIND with runs of other characters than letters and digits as dashes."""
    return f"informe-{re.sub('[^a-z0-9]+', '-', name.lower()) or 'modelo'}.{'md' if kind == 'markdown' else kind}"


def slug(value: str) -> str:
    """Runs of other characters than letters and digits as dashes, none at either end."""
    return re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", value.lower())) or "modelo"


def report_object(issues: DataFrame, score: DataFrame, name: str, now: Column) -> DataFrame:
    """(part, phase, owner, rule_no, item, line): the report as one JSON object, written in parallel: its head (part 0) with the
    model's name, the time, the score and the counts, its issues (part 1), its end (part 2)."""
    low = [F.lit(-1).cast("long").alias(c) for c in ORDER]
    counts = F.struct(F.col("n_error").alias("error"), F.col("n_warning").alias("warning"), F.col("n_info").alias("info"))
    head = F.to_json(F.struct(F.lit(name).alias("modelo"), now.alias("generado"), F.col("score").alias("puntuacion"), counts.alias("conteos")))
    head = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"incidencias":['))
    fields = [("severidad", "severity"), ("regla", "rule_id"), ("titulo", "title"), ("detalle", "detail"), ("tabla", None), ("categoria", "category"), ("tableId", "table_id")]
    row = F.to_json(F.struct(*(F.coalesce("table_name", F.lit("")).alias(k) if c is None else F.col(c).alias(k) for k, c in fields)), {"ignoreNullFields": "false"})
    at = [F.col(c).cast("long").alias(c) for c in ORDER]
    rows = issues.select(F.lit(1).alias("part"), *at, F.struct(*at).alias("k"), row.alias("line"))
    first = issues.agg(F.min(F.struct(*at)).alias("first"))
    rows = rows.crossJoin(F.broadcast(first)).select("part", *ORDER, F.concat(F.when(F.col("k") == F.col("first"), "").otherwise(","), "line").alias("line"))
    return score.select(F.lit(0).alias("part"), *low, head.alias("line")).union(rows).union(score.select(F.lit(2).alias("part"), *low, F.lit("]}").alias("line")))


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """Writes the column line to text files under path, in order: file names follow the order, lines inside a file too."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def write_file(files: DataFrame, path: str) -> None:
    """Writes each text of (model_id, text), one file a row, under path/model=NAME; every file ends with one line break."""
    named = files.select(F.regexp_replace("model_id", "^.*/", "").alias("model"), F.regexp_replace("text", r"\n\z", "").alias("text"))
    named.repartition("model").write.mode("overwrite").partitionBy("model").text(path)
