"""Readers and writers of landed files.

Answers of remote services arrive as files; each reader gives them an explicit
schema (no inference pass) and the reference defaults for missing fields.
Positions that decide order later are explicit columns from here on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from taskmine.functions import text
from taskmine.sources import json_arrays, schemas


def search_pages(spark: SparkSession, path: str) -> DataFrame:
    """Repository search pages, one JSON document per page, as listing rows."""
    return search_items(spark.read.schema(schemas.SEARCH_PAGE).json(path))


def search_items(pages: DataFrame, page_size: int = 100) -> DataFrame:
    """Items of search pages with their running position over all pages."""
    return pages.select("page", F.posexplode("items").alias("pos", "item")).select(
        (F.col("page") * page_size + F.col("pos")).alias("api_pos"), "item.*"
    )


def crawl_list(documents: DataFrame, column: str = "document") -> DataFrame:
    """Names of JSON objects ``{category: [name, …]}``; repeats stay, categories go."""
    # the outer form, as a plain explode would parse every document twice to filter it first
    lists = documents.select(F.explode_outer(F.from_json(column, schemas.CRAWL_LIST)).alias("category", "names"))
    return lists.where(F.col("names").isNotNull()).select(F.explode("names").alias("full_name"))


def repository_details(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REPOSITORY_DETAIL).json(path)


def releases(spark: SparkSession, path: str, page_limit: int | None = None) -> DataFrame:
    return release_rows(spark.read.schema(schemas.RELEASE).json(path), page_limit)


def release_rows(landed: DataFrame, page_limit: int | None = None) -> DataFrame:
    """Flatten release answers; ``page_limit`` keeps what one listing page would hold."""
    rows = landed.select(
        "repo", "api_pos", "tag_name", text.or_empty(F.col("name")).alias("name"),
        text.or_empty(F.col("body")).alias("body"), "published_at",
        text.or_empty(F.col("target_commitish")).alias("target_commitish"),
        F.col("author.login").alias("author_login"),
    )
    return rows if page_limit is None else rows.where(F.col("api_pos") < page_limit)


def repository_files(spark: SparkSession, path: str) -> DataFrame:
    """Recursive directory listings as one row per file."""
    return spark.read.schema(schemas.REPOSITORY_FILE).json(path).where(F.col("type") == "file")


def pull_requests(spark: SparkSession, path: str) -> DataFrame:
    return pull_request_rows(spark.read.schema(schemas.PULL_REQUEST).json(path))


def pull_request_rows(landed: DataFrame) -> DataFrame:
    return landed.select(
        "repo", "pr_number",
        *[text.or_empty(F.col(name)).alias(name) for name in ("title", "body", "state")],
        F.coalesce("merged", F.lit(False)).alias("merged"),
        F.col("base.sha").alias("base_sha"), F.col("head.sha").alias("head_sha"),
    )


def pull_request_files(answers: DataFrame, column: str = "files") -> DataFrame:
    """File-change answers (a JSON array per pull request) as one row per file."""
    parsed = answers.withColumn("_files", F.from_json(column, schemas.PULL_REQUEST_FILES))
    keys = [name for name in answers.columns if name != column]
    rows = parsed.select(*keys, F.posexplode("_files").alias("pos", "_file"))
    return rows.select(
        *keys, "pos",
        *[text.or_empty(F.col(f"_file.{name}")).alias(name) for name in ("filename", "status")],
        *[F.coalesce(f"_file.{name}", F.lit(0)).cast("bigint").alias(name)
          for name in ("additions", "deletions", "changes")],
        text.or_empty(F.col("_file.patch")).alias("patch"),
    )


def commits(spark: SparkSession, path: str) -> DataFrame:
    return commit_rows(spark.read.schema(schemas.COMMIT).json(path))


def commit_rows(landed: DataFrame) -> DataFrame:
    return landed.select(
        "repo", "sha", text.or_empty(F.col("commit.message")).alias("message"),
        text.or_empty(F.col("commit.author.date")).alias("date"),
        text.or_empty(F.col("commit.author.name")).alias("author"),
    )


def file_contents(spark: SparkSession, path: str) -> DataFrame:
    return decoded_contents(spark.read.schema(schemas.FILE_CONTENT).json(path))


def decoded_contents(landed: DataFrame) -> DataFrame:
    """Landed base64 contents as text; unreadable ones are null."""
    keys = [name for name in landed.columns if name not in ("encoding", "content")]
    return landed.select(*keys, text.landed_content(F.col("encoding"), F.col("content")).alias("content"))


def agent_patches(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of agent patches; broken lines and empty patches are dropped."""
    return agent_patch_rows(spark.read.text(path), "value")


def agent_patch_rows(lines: DataFrame, column: str = "line") -> DataFrame:
    keys = [name for name in lines.columns if name != column]
    parsed = F.array(F.from_json(column, schemas.AGENT_PATCH))
    # filtered inside the array: a filter on the row would parse every line twice
    return lines.select(*keys, F.inline(F.filter(parsed, lambda row: text.non_empty(row["model_patch"]))))


def patch_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole patch files; a missing path is an error, as for any Spark read."""
    read = spark.read.text(path, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("patch_path"), F.col("value").alias("diff"))


def final_results(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Result records as one row per release, as ``write_final_results`` wrote them.

    ``lines=False`` reads whole documents ``{metadata, results: […]}``, in parallel too; ``seq``
    then counts within a document.
    """
    if lines:
        return spark.read.schema(schemas.FINAL_RESULT).json(f"{path}/results")
    return json_arrays.read(spark, path, schemas.RESULT_RECORD, "results", "seq")


def task_specs(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Task specs as JSON lines (what ``write_json`` writes), or as JSON arrays, which are read in parallel too."""
    return spark.read.schema(schemas.TASK_SPEC).json(path) if lines else json_arrays.read(spark, path, schemas.TASK_SPEC)


def write_json(frame: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write result or spec records as JSON lines, one part file per task."""
    writer = frame.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)


def write_final_results(results: DataFrame, totals: DataFrame, path: str) -> None:
    """Result records as JSON lines in ``results``, the header record in ``metadata``."""
    write_json(results, f"{path}/results")
    write_json(totals, f"{path}/metadata")


def write_test_logs(logs: DataFrame, path: str) -> None:
    """Add the test logs of one or more runs; other runs stay, a repeated write replaces its own.

    One folder per ``run_seq``, not per repository: a few repositories hold most logs, and
    many hold few. Files are ordered by repository, so a reader of one skips row groups.
    """
    ordered = logs.sortWithinPartitions("run_seq", "repo", "instance_id")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_seq").parquet(path)


def read_test_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TEST_LOG + ", run_seq bigint").parquet(path)


def latest_test_logs(logs: DataFrame) -> DataFrame:
    """The newest log of each instance and phase; the run is chosen before the logs themselves are read."""
    keys = ["repo", "instance_id", "phase"]
    newest = logs.groupBy(*keys).agg(F.max("run_seq").alias("run_seq"))
    return logs.join(newest, [*keys, "run_seq"], "left_semi")
