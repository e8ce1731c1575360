"""Sinks (K1 to K18): partitioned tables; text reports are rendered on the driver from small aggregates."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

from dialmill.operators.generate import question


def json_lines(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """JSON lines, whole or some columns."""
    (df.select(*columns) if columns else df).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def json_array(df: DataFrame, path: str, most: int = 10_000) -> None:
    """A report's rows as one JSON array, in df's order; more rows than most raise: large tables go to ``json_lines`` (K4)."""
    spark = df.sparkSession
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for one array")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(("[\n" + ",\n".join(rows) + "\n]\n").encode()))
    out.close()


def dual(df: DataFrame, trainer: DataFrame, path: str) -> None:
    """Full records and the trainer's projection side by side (K3)."""
    json_lines(df, f"{path}/full")
    json_lines(trainer, f"{path}/trainer")


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key isn't in the table yet; existing rows stay (K5, K6). The number of rows appended."""
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path).select(key).distinct()
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.dropDuplicates([key]).write.parquet(path)
        return spark.read.parquet(path).count()
    before = spark.read.parquet(path).count()
    df.dropDuplicates([key]).join(there, key, "left_anti").write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def markdown(title: str, sections: dict[str, DataFrame], most: int = 200) -> str:
    """A report: one table per section; an aggregate of more rows than most raises rather than being cut."""
    lines = [f"# {title}", ""]
    for name, df in sections.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"section {name} has more than {most} rows")
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join("" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
        lines.append("")
    return "\n".join(lines)


def dashboard(title: str, rates: DataFrame, items: DataFrame, most: int = 500) -> str:
    """A self-contained page: rates per group and the items, filtered by verdict in the browser (K13, F17, F18); more than most raise."""
    groups, shown = rates.limit(most + 1).collect(), items.limit(most + 1).collect()
    if max(len(groups), len(shown)) > most:
        raise ValueError(f"more than {most} rows for one page")
    cells = lambda r: "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r)
    head = lambda df: "<tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>"
    body = "".join(f"<tr>{cells(r)}</tr>" for r in groups)
    rows = "".join(f'<tr class="item" data-verdict="{html.escape(str(r["verdict"]))}">{cells(r)}</tr>' for r in shown)
    script = "function show(v){document.querySelectorAll('.item').forEach(function(e){e.hidden=v&&e.dataset.verdict!==v})}"
    buttons = "".join(f"<button onclick=\"show('{v}')\">{v or 'all'}</button>" for v in ("", "candidate", "baseline", "tie"))
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><script>{script}</script><h1>{html.escape(title)}</h1><table>{head(rates)}{body}</table>{buttons}<table>{head(items)}{rows}</table>"


def frozen_questions(seeds: DataFrame, path: str) -> None:
    """Rule columns and the question, sorted by id."""
    json_lines(seeds.orderBy("seed_id").withColumn("question", question()), path)
