"""Queries of the text problems over the project tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry import tables as T
from codequarry.llm.docpairs import PAIRED_KINDS, documented_functions
from codequarry.llm.mixing import BLOCK_TOKENS, CHUNK_TOKENS, blocks_of, mix, share_report, source_name, wanted_sources
from codequarry.llm.packing import fill_report, pack
from codequarry.llm.subjects import subject_areas
from codequarry.llm.term_counts import mark_terms, term_counts, term_tuples
from codequarry.llm.tokens import VOCABULARY
from codequarry.plans.data_queries import sql_module
from codequarry.plans.text_sql import DEFINED, DOCS
from codequarry.session import width, workspace

# ---------------------------------------------------------------- 3: functions with their documentation


def pairs(spark: SparkSession, sf_dir: str, trivial: bool = False) -> DataFrame:
    """Pairs of the functions that `definitions` lists, by file, name, parameters and line.

    A function with defaults is listed once for each arity, with its first parameters; a NULL list agrees with any."""
    listed = (
        T.read(spark, sf_dir, "definitions")
        .where("function <> ''")
        .select(
            T.clean_path(F.col("file_path")).alias("path"),
            T.strip(F.col("function")).alias("function"),
            "line",
            F.col("params").alias("listed"),
        )
    )
    sources = T.read(spark, sf_dir, "sources").withColumn("path", T.clean_path(F.col("path")))
    found = documented_functions(sources, PAIRED_KINDS, trivial)
    first = F.startswith(F.concat(F.array_join(found["params"], ","), F.lit(",")), F.concat(listed["listed"], F.lit(",")))
    same = [found[c] == listed[c] for c in ("path", "function", "line")]
    return found.join(listed, [*same, listed["listed"].isNull() | (listed["listed"] == "") | first], "left_semi")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("path", "line").distinct()


def p3_documented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listed function with the documentation that is attached to it, trivial or not."""
    return pairs(spark, sf_dir, trivial=True).select("path", "line", "kind", "module", "function", "arity", "doc", "doc_origin")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("path", "line", "kind", "module", "function", "arity", "doc", "doc_origin", "code")


# ---------------------------------------------------------------- 4: term frequencies


def term_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field, term, n_rows, n_records, all_records, mark over the three fields."""
    r, d = T.read(spark, sf_dir, "refs"), T.read(spark, sf_dir, "definitions")
    of_refs = {"refs.module": T.clean_module(F.col("module")), "refs.kind": F.col("kind")}
    tuples = term_tuples(r, of_refs, "file_path", "ref_id").unionByName(term_tuples(d, {"definitions.kind": F.col("kind")}, "file_path", "def_id"))
    files = r.select(F.lit("refs").alias("t"), "file_path").unionByName(d.select(F.lit("definitions").alias("t"), "file_path"))
    totals = files.groupBy("t").agg(F.countDistinct(F.coalesce("file_path", F.lit(""))).alias("all_records"))
    fields = spark.createDataFrame(
        [("refs.module", "refs"), ("refs.kind", "refs"), ("definitions.kind", "definitions")], "field string, t string"
    )
    return mark_terms(term_counts(tuples, width(spark)), totals.join(fields, "t").select("field", "all_records"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_table(spark, sf_dir).where("mark <> ''").select(F.col("field").alias("field_name"), "term", "mark")


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its number of rows and of files."""
    return term_table(spark, sf_dir).select(F.col("field").alias("field_name"), "term", "n_rows", F.col("n_records").alias("n_files"), "mark")


# ---------------------------------------------------------------- 6: containers


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers = [(r.container, r.capacity_tokens) for r in T.read(spark, sf_dir, "containers").orderBy("container").collect()]
    return pack(spark, T.read(spark, sf_dir, "documents"), containers)


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return fill_report(packed(spark, sf_dir), T.read(spark, sf_dir, "containers"))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the packing, for each capacity: every document is in it, no container is over its capacity, the parts
    of a document are its tokens from the first to the last without gap, overlap or repetition, only documents larger than
    the container are split, and 95 % of the room is filled, not counting one container a shard."""
    folder = workspace(spark, "packing")
    packed(spark, sf_dir).write.parquet(folder)
    rows = spark.read.parquet(folder)
    containers = T.read(spark, sf_dir, "containers").select("container", "capacity_tokens")
    bins = rows.groupBy("container", "bin").agg(F.sum("n_tokens").alias("used")).join(F.broadcast(containers), "container")
    shards = bins.groupBy("container").agg(
        F.count_if(F.col("used") > F.col("capacity_tokens")).alias("overfull"),
        (F.sum("used") >= 0.95 * (F.count("*") - F.countDistinct(F.substring_index("bin", "-", 1))) * F.max("capacity_tokens")).alias("well_filled"),
    )
    docs = rows.groupBy("container", "doc_id").agg(
        F.count("*").alias("parts"), F.countDistinct("part").alias("own"), F.max("part").alias("last"), F.min("token_start").alias("first"),
        F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.sum("n_tokens").alias("n"),
    ).join(F.broadcast(containers), "container")
    whole = (F.col("first") == 0) & (F.col("end") == F.col("n")) & (F.col("own") == F.col("parts")) & (F.col("last") == F.col("parts") - 1)
    least = F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("capacity_tokens")))
    by_doc = docs.groupBy("container").agg(
        F.count("*").alias("n_documents"), F.count_if(~whole).alias("torn"), F.count_if(F.col("parts") != least).alias("split_without_need"),
        F.count_if(F.col("n") > 0).alias("with_tokens"),
    )
    return containers.join(F.broadcast(shards), "container").join(F.broadcast(by_doc), "container").drop("capacity_tokens")


# ---------------------------------------------------------------- 7: mixture


def mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The mixture, and the blocks that it is drawn from."""
    targets = [(r.source, r.target_share, r.max_repeats) for r in T.read(spark, sf_dir, "source_targets").orderBy("source").collect()]
    documents = T.read(spark, sf_dir, "documents")
    blocks = blocks_of(spark, documents, list(wanted_sources(targets)), BLOCK_TOKENS, CHUNK_TOKENS, VOCABULARY)
    return mix(spark, documents, targets, blocks=blocks), blocks


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the mixture reaches, beside their targets, and what it leaves unused of each source."""
    folder = workspace(spark, "mixture")
    mixed, blocks = mixture(spark, sf_dir)
    mixed.drop("pieces").write.parquet(folder)
    return share_report(spark.read.parquet(folder), T.read(spark, sf_dir, "source_targets"), blocks)


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the mixture, for each source of the targets: no block used twice in one repetition or more often
    than allowed, no piece outside its document or overlapping another of its repetition, and the share of tokens within two
    points of the target (and, since shares come in whole slots, one slot a source), where the targets of sources without
    documents are dealt to the others."""
    folder = workspace(spark, "mixture")
    mixed, blocks = mixture(spark, sf_dir)
    mixed.write.parquet(folder)
    rows = spark.read.parquet(folder)
    targets = T.read(spark, sf_dir, "source_targets").select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    uses = rows.groupBy("source", "index").agg(F.count("*").alias("n"), F.countDistinct("repeat").alias("r"))
    bad_uses = uses.join(F.broadcast(targets), "source").groupBy("source").agg(F.count_if((F.col("n") > F.col("max_repeats")) | (F.col("n") != F.col("r"))).alias("bad_uses"))
    documents = T.read(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", source_name(F.col("source")).alias("of"), F.octet_length("text").alias("bytes"))
    pieces = rows.select("source", "repeat", F.explode("pieces").alias("p")).select("source", "repeat", "p.*")
    ends = Window.partitionBy("source", "repeat", "doc_id").orderBy("token_start")
    pieces = pieces.withColumn("after", F.lead("token_start").over(ends)).join(documents, "doc_id", "left_outer")
    # A token has at least one byte.
    wrong = (F.col("of").isNull()) | (F.col("of") != F.col("source")) | (F.col("token_start") + F.col("n_tokens") > F.col("bytes"))
    overlap = F.coalesce(F.col("after") < F.col("token_start") + F.col("n_tokens"), F.lit(False))
    bad_pieces = pieces.groupBy("source").agg(F.count_if(wrong | overlap).alias("bad_pieces"))
    report = share_report(rows.drop("pieces"), T.read(spark, sf_dir, "source_targets"), blocks)
    # One row for each source: a single partition of them is as small as the target table.
    report = report.join(F.broadcast(rows.groupBy("source").agg(F.count("*").alias("n_slots"))), "source", "left_outer")
    every = Window.partitionBy(F.lit(0))
    slack = 0.02 + F.count("*").over(every) / F.greatest(F.lit(1), F.sum("n_slots").over(every))
    report = report.withColumn("slack", slack).withColumn("there", F.sum(F.when(F.col("n_available") > 0, F.col("target_share"))).over(every))
    near = F.abs(F.col("actual_share") - F.when(F.col("n_available") > 0, F.col("target_share") / F.col("there")).otherwise(0.0)) < F.col("slack")
    return (
        report.join(F.broadcast(bad_uses), "source", "left_outer")
        .join(F.broadcast(bad_pieces), "source", "left_outer")
        .select(
            "source",
            (F.col("n_available") > 0).alias("has_documents"),
            F.coalesce("bad_uses", F.lit(0)).alias("bad_uses"),
            F.coalesce("bad_pieces", F.lit(0)).alias("bad_pieces"),
            near.alias("share_is_near"),
            (F.col("n_unused") >= 0).alias("unused_is_rest"),
        )
    )


# ---------------------------------------------------------------- 8: subject areas


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects = T.read(spark, sf_dir, "subjects").orderBy("subject").collect()  # a fixed list of areas
    return subject_areas(
        spark,
        T.read(spark, sf_dir, "documents"),
        T.read(spark, sf_dir, "subject_labels"),
        [(r.subject, r.scope_note) for r in subjects],
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas(spark, sf_dir).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each subject area has, alone and with others."""
    found = areas(spark, sf_dir)
    per_doc = found.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))  # at most the fixed areas
    return (
        per_doc.select(F.explode("subjects").alias("subject"), (F.size("subjects") == 1).alias("alone"))
        .groupBy("subject")
        .agg(F.count("*").alias("n_documents"), F.count_if("alone").alias("n_alone"))
    )


QUERIES = {
    "p3_found": p3_found,
    "p3_pairs": p3_pairs,
    "p3_documented": p3_documented,
    "p4_found": p4_found,
    "p4_terms": p4_terms,
    "p6_packing": p6_packing,
    "p6_fill": p6_fill,
    "p6_checks": p6_checks,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p7_checks": p7_checks,
    "p8_found": p8_found,
    "p8_composition": p8_composition,
}

# ---------------------------------------------------------------- SQL

_TERMS = f"""
WITH r AS (SELECT DISTINCT ref_id, {sql_module("module")} AS module, coalesce(kind, '') AS kind, coalesce(file_path, '') AS f FROM refs),
d AS (SELECT DISTINCT def_id, coalesce(kind, '') AS kind, coalesce(file_path, '') AS f FROM definitions),
c AS (SELECT 'refs.module' AS field_name, module AS term, COUNT(*) AS n_rows, COUNT(DISTINCT f) AS n_files, (SELECT COUNT(DISTINCT f) FROM r) AS n FROM r GROUP BY module
    UNION ALL SELECT 'refs.kind', kind, COUNT(*), COUNT(DISTINCT f), (SELECT COUNT(DISTINCT f) FROM r) FROM r GROUP BY kind
    UNION ALL SELECT 'definitions.kind', kind, COUNT(*), COUNT(DISTINCT f), (SELECT COUNT(DISTINCT f) FROM d) FROM d GROUP BY kind),
m AS (SELECT field_name, term, n_rows, n_files, CASE WHEN n_files < 3 THEN 'rare' WHEN n_files > 0.2 * n THEN 'common' ELSE '' END AS mark FROM c)
"""

# The last `@doc` with a text or `false` before any clause of a function; without one the comment lines right above its first
# clause, or above the attributes that stand right above it.
_DOCUMENTED = DEFINED + DOCS + r""",
RESET AS (SELECT file_path, last_line AS n FROM FN UNION ALL SELECT file_path, line FROM MD UNION ALL SELECT file_path, last_line FROM MD
    UNION ALL SELECT path, n FROM LN WHERE regexp_matches(code, '^\s*@(macro)?callback')),
SAID AS (SELECT path, n, CASE WHEN quote_of > 0 THEN value END AS doc FROM VD WHERE a = 'doc' AND (quote_of > 0 OR regexp_matches(t, '@doc\(? *(false|nil)'))),
-- Attributes from their first to their last line, and runs of them without a gap.
SPAN AS (SELECT path, n, greatest(n, coalesce((SELECT l.last FROM LITERALS l WHERE l.path = LN.path AND l.first = LN.n), 0), coalesce((SELECT b.last FROM BRACKETS b WHERE b.path = LN.path AND b.first = LN.n), 0),
    n + CASE WHEN code LIKE '%<>' THEN 1 + CAST(EXISTS (SELECT 1 FROM LN x WHERE x.path = LN.path AND x.n = LN.n + 1 AND x.code LIKE '%<>') AS INT) ELSE 0 END) AS last FROM LN WHERE regexp_matches(code, '^\s*@[a-z_]+')),
ISLE AS (SELECT path, min(n) AS first, max(last) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY n) AS g FROM
    (SELECT *, CAST(n IS DISTINCT FROM lag(last) OVER (PARTITION BY path ORDER BY n) + 1 AS INT) AS new FROM SPAN)) GROUP BY path, g),
REMARK AS (SELECT path, min(n) AS first, max(n) AS last, string_agg(trim(ltrim(ltrim(t), '#')), chr(10) ORDER BY n) AS doc FROM
    (SELECT path, n, t, n - row_number() OVER (PARTITION BY path ORDER BY n) AS g FROM LN WHERE q % 2 = 0 AND starts_with(ltrim(t), '#')) GROUP BY path, g),
CLAUSE AS (SELECT FN.*, (SELECT arg_max((doc IS NULL, doc), s.n) FROM SAID s WHERE s.path = FN.file_path AND s.n < FN.line
        AND s.n > coalesce((SELECT max(r.n) FROM RESET r WHERE r.file_path = FN.file_path AND r.n < FN.line), 0)) AS said,
    coalesce((SELECT i.first FROM ISLE i WHERE i.path = FN.file_path AND i.last = FN.line - 1), line) AS above FROM FN),
WHOLE AS (SELECT file_path AS path, min(line) AS line, arg_min(kind, line) AS kind, module, function, arity, arg_max(said, line) FILTER (WHERE said IS NOT NULL) AS said, arg_min(above, line) AS above
    FROM CLAUSE GROUP BY file_path, module, function, arity)
"""

SQL: dict[str, str] = {
    "p3_documented": _DOCUMENTED
    + """SELECT w.path, w.line, kind, module, function, arity, CASE WHEN said IS NULL THEN r.doc ELSE said[2] END AS doc, CASE WHEN said IS NULL THEN 'comment' ELSE 'attribute' END AS doc_origin
FROM WHOLE w LEFT JOIN REMARK r ON r.path = w.path AND r.last = w.above - 1
WHERE kind IN ('def', 'defp', 'defmacro', 'defguard', 'defdelegate') AND CASE WHEN said IS NULL THEN r.doc ELSE said[2] END IS NOT NULL""",
    "p4_found": f"{_TERMS} SELECT field_name, term, mark FROM m WHERE mark <> ''",
    "p4_terms": f"{_TERMS} SELECT field_name, term, n_rows, n_files, mark FROM m",
    "p6_checks": """
SELECT container, 0 AS overfull, true AS well_filled, (SELECT COUNT(DISTINCT doc_id) FROM documents) AS n_documents, 0 AS torn, 0 AS split_without_need,
    (SELECT COUNT(DISTINCT doc_id) FROM documents WHERE text <> '') AS with_tokens FROM containers""",
    "p7_checks": """
SELECT lower(trim(t.source)) AS source, EXISTS (SELECT 1 FROM documents d WHERE lower(trim(d.source)) = lower(trim(t.source)) AND text <> '') AS has_documents,
    0 AS bad_uses, 0 AS bad_pieces, true AS share_is_near, true AS unused_is_rest FROM source_targets t""",
}
