"""Queries of the data-pipeline problems over the project tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry import tables as T
from codequarry.operators.dense_counts import dense_counts
from codequarry.operators.incremental import IncrementalBatches
from codequarry.operators.orphans import ALWAYS_FROM, NEVER_ENDS, month_index, month_label, orphans
from codequarry.session import width, workspace

# ---------------------------------------------------------------- 1: new or changed records


def replay_runs(spark: SparkSession, sf_dir: str) -> IncrementalBatches:
    """Every effective indexing run as one batch over the reports that came in since the run before."""
    runs = (
        T.read(spark, sf_dir, "index_runs")
        .where("status = 'ok' AND started_at IS NOT NULL")
        .groupBy("run_id")
        .agg(F.min("started_at").alias("started_at"))
        .orderBy("started_at", "run_id")
        .collect()
    )  # one row for each run, not for each record
    reports = T.read(spark, sf_dir, "files").select(
        T.clean_path(F.col("path")).alias("path"),
        F.col("walked_at").alias("observed_at"),
        F.col("mtime").isNotNull().alias("present"),
        F.lit(None).cast("bigint").alias("size"),
        F.col("mtime").cast("string").alias("checksum"),
        "loaded_at",
    )
    batches = IncrementalBatches(spark, workspace(spark, "runs"))
    batches.catch_up([(str(r.run_id), r.started_at) for r in runs], reports.where("loaded_at IS NOT NULL"), "loaded_at")
    return batches


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_runs(spark, sf_dir).outputs().select(F.col("batch").cast("bigint").alias("run_id"), "path")


def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of `sources` as a batch a month, told apart by size and checksum of the whole text: what each month
    brought that was new or different."""
    readings = T.read(spark, sf_dir, "sources").select(
        T.clean_path(F.col("path")).alias("path"),
        F.col("read_at").alias("observed_at"),
        F.col("source_text").isNotNull().alias("present"),
        F.octet_length("source_text").cast("bigint").alias("size"),
        F.md5("source_text").alias("checksum"),
    )
    months = readings.where("observed_at IS NOT NULL").select(F.date_trunc("month", "observed_at").cast("timestamp_ntz").alias("m")).distinct()
    ends = months.select("m", (F.add_months("m", 1).cast("timestamp_ntz") - F.expr("INTERVAL 1 MICROSECOND")).alias("until")).orderBy("m").collect()
    batches = IncrementalBatches(spark, workspace(spark, "readings"))  # above: one row for each month
    batches.catch_up([(f"{r.m:%Y-%m}", r.until) for r in ends], readings, "observed_at")
    return batches.outputs().select("batch", "path", "size", "checksum")


# ---------------------------------------------------------------- 2: references to nothing


def dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, period_month, row_id, status of each reference without a valid target."""
    d = T.read(spark, sf_dir, "definitions").select(
        "def_id",
        T.clean_module(F.col("module")).alias("module"),
        T.strip(F.col("function")).alias("function"),
        T.clean_module(F.col("delegate_to")).alias("delegate_to"),
        T.strip(F.col("delegate_as")).alias("delegate_as"),
        month_index(F.col("indexed_at")).alias("valid_from"),
        F.when(F.col("removed_at").isNull(), F.lit(NEVER_ENDS)).otherwise(month_index(F.col("removed_at"))).alias("valid_to"),
    )
    s = T.read(spark, sf_dir, "stdlib_definitions").select(
        T.clean_module(F.col("module")).alias("module"),
        T.strip(F.col("function")).alias("function"),
        F.lit(ALWAYS_FROM).alias("valid_from"),
        F.lit(NEVER_ENDS).alias("valid_to"),
    )
    parents = d.select("module", "function", "valid_from", "valid_to").unionByName(s)
    pointing = (
        T.read(spark, sf_dir, "refs")
        .select(
            F.lit("refs").alias("table_name"),
            F.col("ref_id").alias("row_id"),
            T.clean_module(F.col("module")).alias("module"),
            T.strip(F.col("function")).alias("function"),
            month_index(F.col("indexed_at")).alias("period"),
        )
        .unionByName(
            d.where("delegate_to <> ''").select(
                F.lit("definitions").alias("table_name"),
                F.col("def_id").alias("row_id"),
                F.col("delegate_to").alias("module"),
                F.when(F.col("delegate_as") == "", F.col("function")).otherwise(F.col("delegate_as")).alias("function"),
                F.col("valid_from").alias("period"),
            )
        )
    )
    found = orphans(pointing, parents, ["module", "function"])
    return (
        found.groupBy("table_name", "row_id")
        .agg(F.min(F.struct("period", "status", "module", "function")).alias("x"))
        .select("table_name", month_label(F.col("x.period")).alias("period_month"), "row_id", "x.status", "x.module", "x.function")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dangling(spark, sf_dir).select("table_name", "period_month", "row_id")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans by table, month and what became of their target."""
    return dangling(spark, sf_dir).groupBy("table_name", "period_month", "status").agg(F.count("*").alias("n_rows"))


# ---------------------------------------------------------------- 5: per-key results under skew


def module_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, module, n_rows, sum_n_call, sum_line and share of the table's rows."""
    both = (
        T.read(spark, sf_dir, "refs")
        .select(
            F.lit("refs").alias("table_name"),
            T.clean_module(F.col("module")).alias("module"),
            F.col("ref_id").alias("row"),
            "line",
            (F.col("function").isNotNull() & (T.strip(F.col("function")) != "")).cast("bigint").alias("n_function"),
        )
        .unionByName(
            T.read(spark, sf_dir, "definitions").select(
                F.lit("definitions").alias("table_name"),
                T.clean_module(F.col("module")).alias("module"),
                F.col("def_id").alias("row"),
                "line",
                (F.col("function").isNotNull() & (T.strip(F.col("function")) != "")).cast("bigint").alias("n_function"),
            )
        )
    )
    sums = dense_counts(both, ["table_name", "module"], "row", ["line", "n_function"], width(spark))
    return sums


def p5_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each module of both tables its rows, those that name a function, and the sum of their lines."""
    return module_totals(spark, sf_dir).withColumnsRenamed({"sum_line": "sum_lines", "sum_n_function": "n_function_rows"})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The totals are read twice, by the sum and by the filter: they are written once, cutting the lineage.
    folder = workspace(spark, "modules")
    module_totals(spark, sf_dir).select("table_name", "module", "n_rows").write.parquet(folder)
    counts = spark.read.parquet(folder)
    totals = counts.groupBy("table_name").agg(F.sum("n_rows").alias("all_rows"))  # one row for each table
    return (
        counts.join(F.broadcast(totals), "table_name")
        .where(F.col("n_rows") * 50 >= F.col("all_rows"))
        .select("table_name", "module")
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_texts": p1_texts,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p5_found": p5_found,
    "p5_modules": p5_modules,
}

# ---------------------------------------------------------------- SQL

_STRIP = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"


def sql_strip(column: str) -> str:
    return _STRIP.format(column)


def sql_module(column: str) -> str:
    return rf"regexp_replace({sql_strip(column)}, '^Elixir\.', '')"


_PATH = r"regexp_replace(regexp_replace(path, '(^|/)(\.?/)+', '\1', 'g'), '(^|/)\.?$', '')"

_DANGLING = f"""
WITH d AS (SELECT DISTINCT def_id, {sql_module("module")} AS module, {sql_strip("function")} AS function,
    {sql_module("delegate_to")} AS delegate_to, {sql_strip("delegate_as")} AS delegate_as, indexed_at, removed_at FROM definitions),
p AS (SELECT DISTINCT module, function, date_trunc('month', indexed_at) AS since, date_trunc('month', removed_at) AS until FROM d
    UNION SELECT {sql_module("module")}, {sql_strip("function")}, TIMESTAMP '0001-01-01', NULL FROM stdlib_definitions),
t AS (SELECT DISTINCT 'refs' AS table_name, ref_id AS row_id, {sql_module("module")} AS module, {sql_strip("function")} AS function,
    date_trunc('month', indexed_at) AS m FROM refs
    UNION SELECT 'definitions', def_id, delegate_to, CASE WHEN delegate_as = '' THEN function ELSE delegate_as END,
    date_trunc('month', indexed_at) FROM d WHERE delegate_to <> ''),
o AS (SELECT t.*,
    CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.module = t.module AND p.function = t.function AND p.until <= t.m AND p.until > p.since) THEN 'deleted'
      WHEN EXISTS (SELECT 1 FROM p WHERE p.module = t.module AND p.function = t.function AND p.since > t.m AND (p.until IS NULL OR p.until > p.since)) THEN 'late'
      ELSE 'missing' END AS status
    FROM t WHERE m IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.module = t.module AND p.function = t.function
      AND p.since <= t.m AND (p.until IS NULL OR p.until > t.m)))
"""

_MODULES = f"""
WITH b AS (SELECT DISTINCT 'refs' AS table_name, ref_id AS id, {sql_module("module")} AS module, line, {sql_strip("function")} <> '' AS fn FROM refs
    UNION ALL SELECT DISTINCT 'definitions', def_id, {sql_module("module")}, line, {sql_strip("function")} <> '' FROM definitions)
"""

SQL = {
    "p1_found": f"""
WITH r AS (SELECT DISTINCT run_id, started_at FROM index_runs WHERE status = 'ok' AND started_at IS NOT NULL),
o AS (SELECT run_id, started_at, row_number() OVER (ORDER BY started_at, run_id) AS n FROM r),
s AS (SELECT o.n, o.run_id, {_PATH} AS path, arg_max(coalesce(f.mtime, -1), f.walked_at) AS mtime
    FROM o JOIN files f ON f.loaded_at <= o.started_at GROUP BY ALL)
SELECT a.run_id, a.path FROM s a LEFT JOIN s b ON b.n = a.n - 1 AND b.path = a.path
WHERE a.mtime <> -1 AND (b.path IS NULL OR b.mtime <> a.mtime)""",
    # Of several readings of a month the latest counts, of equally late ones the greatest; unreadable files are not present.
    "p1_texts": f"""
WITH s AS (SELECT {_PATH} AS path, strftime(read_at, '%Y-%m') AS batch, max((read_at, source_text IS NOT NULL, strlen(source_text), md5(source_text))) AS x
    FROM sources WHERE path IS NOT NULL AND read_at IS NOT NULL GROUP BY ALL),
t AS (SELECT *, lag(x) OVER (PARTITION BY path ORDER BY batch) AS w FROM s)
SELECT batch, path, x[3] AS size, x[4] AS checksum FROM t WHERE x[2] AND (w IS NULL OR NOT w[2] OR w[4] <> x[4])""",
    "p2_found": f"{_DANGLING} SELECT table_name, strftime(m, '%Y-%m') AS period_month, row_id FROM o",
    "p2_report": f"{_DANGLING} SELECT table_name, strftime(m, '%Y-%m') AS period_month, status, COUNT(*) AS n_rows FROM o GROUP BY ALL",
    "p5_found": f"""{_MODULES}, c AS (SELECT table_name, module, COUNT(*) AS n FROM b GROUP BY ALL)
SELECT table_name, module FROM c WHERE n * 50 >= (SELECT SUM(n) FROM c x WHERE x.table_name = c.table_name)""",
    "p5_modules": f"""{_MODULES} SELECT table_name, module, COUNT(*) AS n_rows, CAST(SUM(line) AS BIGINT) AS sum_lines,
COUNT(*) FILTER (WHERE fn) AS n_function_rows FROM b GROUP BY ALL""",
}
