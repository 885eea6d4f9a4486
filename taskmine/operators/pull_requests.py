"""Pull requests: files, snapshots, eligibility, descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taskmine import defaults as d
from taskmine.functions import paths, source_code, text
from taskmine.operators.changes import fill
from taskmine.operators.ranking import WIDE, dealt, first_n
from taskmine.sources.stages import staged

PR = ["repo", "pr_number"]
SNAPSHOT = ["repo", "path", "ref"]

PR_PROMPT = (
    "Write the request a user would make to get the change below, for someone who will build it "
    "without seeing this pull request.\n\nFeature: {feature}\nTitle: {title}\nDescription: {body}\n\n"
    "Changed files:\n{files}\n\n"
    'Begin with "I want to". Carry over every requirement of the description, cover the purpose of '
    "each changed file, name changed parameters where they matter, and say what should happen "
    "rather than how. Do not include code."
)
FEATURE_PROMPT = (
    "Describe for users what this feature lets them do.\n\nKind: {feature_type}\n"
    "Summary: {feature}\n\nPull requests:\n{pull_requests}\n\n"
    'Begin with "I want to". Bring the pull requests together into one picture of what is new, what '
    "it is good for and why it matters; leave implementation aside."
)


def feature_prs(changes: DataFrame) -> DataFrame:
    """Pull requests of new features; links without a number are skipped."""
    features = changes.where((F.col("feature_type") == "new_feature") & (F.size("pr_links") > 0))
    keys = [name for name in changes.columns if name != "pr_links"]
    links = features.select(*keys, F.posexplode("pr_links").alias("pr_pos", "pr_link"))
    numbered = links.where(F.col("pr_link").rlike(r"/pull/\d"))
    return numbered.withColumn("pr_number", F.regexp_extract("pr_link", r"/pull/(\d+)", 1))


def file_lists(files: DataFrame) -> DataFrame:
    """Test files and non-test Python files of each pull request, in listing order."""
    is_test = paths.is_test_file(F.col("filename"))
    is_source = paths.is_source_file(F.col("filename"))

    def listed(condition: Column) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(condition, F.struct("pos", "filename"))))
        return F.transform(ordered, lambda entry: entry["filename"])

    return files.groupBy(*PR).agg(listed(is_test).alias("test_files"), listed(is_source).alias("non_test_files"))


def with_commits(prs: DataFrame, commits: DataFrame) -> DataFrame:
    """Base and head commit records; a commit that was not landed keeps its sha only."""
    joined = prs
    for side in ("base", "head"):
        record = F.struct("sha", "message", "date", "author")
        landed = commits.select("repo", F.col("sha").alias(f"{side}_sha"), record.alias("_landed"))
        bare = F.struct(
            F.col(f"{side}_sha").alias("sha"), F.lit("").alias("message"),
            F.lit("").alias("date"), F.lit("").alias("author"),
        )
        joined = joined.join(landed, ["repo", f"{side}_sha"], "left")
        joined = joined.withColumn(f"{side}_commit", F.coalesce("_landed", bare)).drop("_landed")
    return joined


def snapshot_definitions(contents: DataFrame) -> DataFrame:
    """Definition paths of each landed snapshot; the text itself is not carried on.

    Snapshots are parsed where they are read. A null content stays null; so do the
    definitions of a ``landed`` one that is too deep to parse.
    """
    listed = F.when(F.col("content").isNotNull(), source_code.definitions(source_code.candidate(F.col("content"))))
    return contents.select("repo", "path", "ref", F.col("content").isNotNull().alias("landed"), listed.alias("definitions"))


def needed_snapshots(files: DataFrame, prs: DataFrame) -> DataFrame:
    """(repo, path, ref) of the snapshots that decide about these pull requests: source files at the commits that count."""
    source = files.where(paths.is_source_file(F.col("filename"))).select(*PR, F.col("filename").alias("path"))
    at = source.join(prs.select(*PR, F.explode(F.array("base_sha", "head_sha")).alias("ref")), PR)
    return at.select(*SNAPSHOT).distinct()


def distinct_definitions(contents: DataFrame, needed: DataFrame | None = None) -> DataFrame:
    """``snapshot_definitions`` of the ``needed`` snapshots (or all), each different text parsed once.

    Digests are taken where the texts lie, and one snapshot of each digest is chosen on these
    narrow rows; only the chosen texts are then looked up and parsed. Writes the digests when called.
    """
    keyed = contents.select(*SNAPSHOT, F.sha2("content", 256).alias("_text"))
    digests = staged(keyed if needed is None else keyed.join(needed, SNAPSHOT, "left_semi"), "snapshot-digests")
    chosen = digests.where("_text is not null").groupBy("_text").agg(F.min(F.struct(*SNAPSHOT)).alias("at")).select("at.*")
    texts = contents.where("content is not null").join(chosen, SNAPSHOT, "left_semi").select(
        F.sha2("content", 256).alias("_text"), source_code.definitions(source_code.candidate(F.col("content"))).alias("definitions"))
    # a snapshot landed twice gives its text twice; the lists are equal then
    parsed = texts.groupBy("_text").agg(F.first("definitions", ignorenulls=True).alias("definitions"))
    landed = F.col("_text").isNotNull().alias("landed")
    return digests.join(parsed, "_text", "left").select(*SNAPSHOT, landed, "definitions")


def definition_diff(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """New and deleted definitions between two source columns of one row."""
    keys = [name for name in pairs.columns if name not in (before, after)]
    listed = pairs.select(
        *keys, source_code.definitions(source_code.candidate(F.col(before))).alias("_before"),
        source_code.definitions(source_code.candidate(F.col(after))).alias("_after"),
    )
    new, gone = F.array_except("_after", "_before"), F.array_except("_before", "_after")
    return listed.select(
        *keys, F.coalesce((F.size(new) == 0) & (F.size(gone) == 0), F.lit(False)).alias("only_modified"),
        F.array_sort(new).alias("new_definitions"), F.array_sort(gone).alias("deleted_definitions"),
    )


def file_violations(files: DataFrame, prs: DataFrame, definitions: DataFrame) -> DataFrame:
    """Per changed file: is it a test, is it source, does it add or drop definitions?

    Only the few columns that decide go through the joins; an added file is looked up
    at the head commit, a removed one at the base, a modified one at both.
    """
    classified = files.select(
        *PR, "filename", "status", paths.is_test_file(F.col("filename")).alias("is_test"),
        paths.is_source_file(F.col("filename")).alias("is_source"),
    )
    looked_up = F.col("is_source")
    refs = prs.select(*PR, "base_sha", "head_sha")
    at = classified.join(refs, PR).select(
        *PR, "filename", "status", "is_test", "is_source",
        F.when(looked_up & F.col("status").isin("removed", "modified"), F.col("base_sha")).alias("base_ref"),
        F.when(looked_up & F.col("status").isin("added", "modified"), F.col("head_sha")).alias("head_ref"),
    )

    # One long lookup instead of a join per side: both sides of a file meet in one aggregate.
    # Files that need no lookup pass through it with an empty reference.
    sides = F.array(
        F.struct(F.lit("base").alias("side"), F.col("base_ref").alias("ref")),
        F.struct(F.lit("head").alias("side"), F.col("head_ref").alias("ref")),
    )
    keep = [*PR, "filename", "status", "is_test", "is_source"]
    wanted = at.select(*keep, F.inline_outer(F.filter(sides, lambda one: one["ref"].isNotNull())))
    # not filtered on the definitions: that would run the parser a second time
    landed = definitions.select(
        "repo", F.col("path").alias("filename"), "ref", (F.size("definitions") > 0).alias("_defines"),
        (F.col("landed") & F.col("definitions").isNull()).alias("_unreadable"),
        *[F.when(F.col("definitions").isNotNull(), part).alias(f"_digest_{n}")
          for n, part in enumerate(text.fingerprint(F.col("definitions")))],
    )
    found = wanted.join(landed, ["repo", "filename", "ref"], "left")
    compared = found.groupBy(*keep).agg(F.bool_or("_defines").alias("_defines"), F.bool_or("_unreadable").alias("_unreadable"), *[
        F.max(F.when(F.col("side") == side, F.col(f"_digest_{n}"))).alias(f"_{side}_{n}")
        for side in ("base", "head") for n in (0, 1)
    ])
    # a side that was not readable is null and differs
    differs = F.coalesce((F.col("_base_0") != F.col("_head_0")) | (F.col("_base_1") != F.col("_head_1")), F.lit(True))
    violates = F.when(F.col("status") == "modified", differs).otherwise(F.coalesce("_defines", F.lit(False)))
    unsure = F.coalesce("_unreadable", F.lit(False))  # what cannot be read may define anything
    return compared.select(*keep, (F.col("is_source") & (violates | unsure)).alias("violates"))


def eligibility(files: DataFrame, prs: DataFrame, definitions: DataFrame, merged_only: bool = False) -> DataFrame:
    """Flags per pull request; eligible = tests, source, and only existing definitions changed."""
    wanted = prs.where("merged") if merged_only else prs
    flags = file_violations(files, wanted, definitions).groupBy(*PR).agg(
        F.bool_or("is_test").alias("has_tests"),
        F.bool_or("is_source").alias("has_source"),
        (~F.bool_or("violates")).alias("only_modified_existing_functions"),
    )
    eligible = F.col("has_tests") & F.col("has_source") & F.col("only_modified_existing_functions")
    return flags.withColumn("eligible", eligible)


def files_summary(
    files: DataFrame,
    max_files: int | None = None,
    max_patch: int | None = None,
    max_preview: int | None = None,
) -> DataFrame:
    """Text listing the non-test files of a pull request with their patches.

    ``max_files`` keeps the first ones only, ``max_patch`` leaves longer patches out and
    ``max_preview`` cuts the others; ``defaults.SUMMARY_LIMITS`` holds the usual numbers.
    """
    patch = text.or_empty(F.col("patch"))
    head = F.format_string("- %s (%s): +%d/-%d", "filename", "status", "additions", "deletions")
    short = (F.length(patch) > 0) & (F.length(patch) < max_patch if max_patch is not None else F.lit(True))
    body = text.preview(patch, max_preview) if max_preview is not None else patch
    line = F.when(short, F.concat(head, F.lit("\n  "), body)).otherwise(head)
    is_test = paths.is_test_file(F.col("filename"))
    counts = files.groupBy(*PR).agg(F.count_if(~is_test).alias("_files"))
    # only the lines are ranked, in tasks that do not grow with the input as those of short rows would
    lines = dealt(files.where(~is_test).select(*PR, "pos", line.alias("line")), PR)
    shown = lines if max_files is None else first_n(lines, PR, [F.asc("pos")], max_files)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    texts = shown.groupBy(*PR).agg(
        F.array_join(F.transform(ordered, lambda entry: entry["line"]), "\n").alias("_text")
    )
    more = F.col("_files") - max_files if max_files is not None else F.lit(0).cast("long")
    summary = F.when(F.col("_text").isNull(), F.lit(d.NO_FILES_TEXT)).when(
        more > 0, F.concat("_text", F.format_string("\n... and %d more files", more))
    ).otherwise(F.col("_text"))
    return counts.join(texts, PR, "left").select(*PR, summary.alias("files_text"))


def first_mentions(features: DataFrame) -> DataFrame:
    """The feature that names a pull request first; it decides the request text."""
    order = F.struct("release_pos", "feature_pos", "pr_pos")
    return features.groupBy(*PR).agg(F.min_by("description", order).alias("feature_description"))


def pr_requests(eligible: DataFrame, prs: DataFrame, summaries: DataFrame, mentions: DataFrame,
                template: str = PR_PROMPT) -> DataFrame:
    """One description request per eligible pull request."""
    about = prs.select(*PR, "title", "body").join(eligible.where("eligible").select(*PR), PR, "left_semi")
    joined = about.join(summaries, PR).join(mentions, PR)
    prompt = fill(template, {
        "feature": F.col("feature_description"), "title": F.col("title"),
        "body": F.col("body"), "files": F.col("files_text"),
    })
    return joined.select(*PR, prompt.alias("prompt"))


def pr_descriptions(eligible: DataFrame, mentions: DataFrame, responses: DataFrame) -> DataFrame:
    """Description of each eligible pull request: the answer, else the feature's own words."""
    joined = eligible.where("eligible").select(*PR).join(mentions, PR).join(responses, PR, "left")
    chosen = F.coalesce("response", "feature_description")
    return joined.select(*PR, chosen.alias("detailed_description")).where(F.length("detailed_description") > 0)


FEATURE = ["repo", "tag_name", "feature_pos"]


def feature_requests(features: DataFrame, prs: DataFrame, file_counts: DataFrame, descriptions: DataFrame,
                     template: str = FEATURE_PROMPT) -> DataFrame:
    """A synthesis request for each feature with more than one described pull request."""
    about = prs.select(*PR, "title", "state", "merged")
    joined = features.join(descriptions, PR).join(about, PR).join(file_counts, PR)
    flag = F.when(F.col("merged"), F.lit("True")).otherwise(F.lit("False"))
    block = F.concat(
        F.lit("\nPR #"), F.col("pr_number"), F.lit(": "), F.col("title"),
        F.lit("\n- Status: "), F.col("state"), F.lit(" (merged: "), flag,
        F.lit(")\n- Files changed: "), F.col("n_files").cast("string"),
        F.lit("\n- User benefits: "), F.col("detailed_description"), F.lit("\n"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("pr_pos", block.alias("block"))))
    grouped = joined.groupBy(*FEATURE, "feature_type", "description").agg(
        F.count("*").alias("n_prs"),
        F.array_join(F.transform(ordered, lambda entry: entry["block"]), "\n").alias("_blocks"),
    )
    prompt = fill(template, {
        "feature_type": F.col("feature_type"), "feature": F.col("description"), "pull_requests": F.col("_blocks"),
    })
    return grouped.where(F.col("n_prs") > 1).select(*FEATURE, prompt.alias("prompt"))


def enriched_features(features: DataFrame, descriptions: DataFrame, responses: DataFrame) -> DataFrame:
    """Features with at least one described pull request and a text of their own.

    One pull request: its description. Several: the synthesised answer, or the
    feature's own words when the answer came back empty (null); a feature whose
    request got no answer row at all is dropped.
    """
    described = features.join(descriptions, PR)
    grouped = described.groupBy(*FEATURE, "feature_type", "description").agg(
        F.count("*").alias("n_prs"), F.min("detailed_description").alias("_single")
    )
    joined = grouped.join(responses.withColumn("_answered", F.lit(True)), FEATURE, "left")
    chosen = F.when(F.col("n_prs") == 1, F.col("_single")).when(
        F.col("_answered"), F.coalesce("response", "description")
    )
    enriched = joined.withColumn("feature_detailed_description", chosen)
    kept = enriched.where(F.length("feature_detailed_description") > 0)
    return kept.select(*FEATURE, "feature_type", "description", "n_prs", "feature_detailed_description")


def analyses(prs: DataFrame, files: DataFrame, lists: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Nested analysis records of described pull requests (for export)."""
    change = F.struct("pos", "filename", "status", "additions", "deletions", "changes", "patch")
    changes = files.groupBy(*PR).agg(
        F.transform(F.array_sort(F.collect_list(change)), lambda entry: entry.dropFields("pos")).alias("file_changes")
    )
    joined = prs.join(descriptions, PR).join(changes, PR).join(lists, PR)
    record = F.struct(
        F.col("pr_number"), F.col("repo").alias("repo_name"), "title", F.col("body").alias("description"),
        "state", "merged", "base_commit", "head_commit", "file_changes", "detailed_description",
        (F.size("test_files") > 0).alias("has_tests"), "test_files",
        F.lit(True).alias("only_modified_existing_functions"), "non_test_files",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("analyzed_at"),
    )
    return joined.select(*PR, record.alias("pr_analysis"))


def nested_results(features: DataFrame, enriched: DataFrame, pr_analyses: DataFrame, records: DataFrame) -> DataFrame:
    """One document per release with its enriched features (for export), in release order ``seq``."""
    release, own = ["repo", "tag_name"], ["feature_type", "description", "feature_detailed_description"]
    # narrow rows meet first, so that the analyses move once, to their release; equal features stay apart by their copy
    counted = enriched.groupBy(*FEATURE, *own).agg(F.count("*").alias("_n"))
    copies = counted.select(*FEATURE, *own, F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")).alias("_copy"))
    named = features.select(*FEATURE, "pr_pos", *PR[1:]).join(copies, FEATURE)
    per_pr = dealt(named.join(pr_analyses, PR), release, WIDE)
    entry = F.struct("pr_pos", "pr_analysis")
    gathered = per_pr.groupBy(*FEATURE, *own, "_copy").agg(
        F.transform(F.array_sort(F.collect_list(entry), _by_position("pr_pos")), lambda one: one["pr_analysis"])
        .alias("pr_analyses")
    )
    feature = F.struct("feature_pos", F.struct(
        "feature_type", "description", "pr_analyses", "feature_detailed_description").alias("_feature"))
    documents = gathered.groupBy(*release).agg(
        F.transform(F.array_sort(F.collect_list(feature), _by_position("feature_pos")), lambda one: one["_feature"])
        .alias("enhanced_new_features")
    )
    return documents.join(records, ["repo", "tag_name"]).select(
        F.col("release_pos").cast("bigint").alias("seq"), F.col("repo").alias("repository"),
        F.col("tag_name").alias("release"), F.col("original_analysis.analyzed_at").alias("analyzed_at"),
        "enhanced_new_features", "original_analysis",
    )


def _by_position(field: str):
    """Comparator on one position field; nested maps and wide structs are never compared."""
    def compare(left: Column, right: Column) -> Column:
        return F.when(left[field] < right[field], -1).when(left[field] > right[field], 1).otherwise(0)
    return compare


def result_totals(enriched: DataFrame) -> DataFrame:
    """Distinct repositories, releases and features of the final results."""
    releases = enriched.groupBy("repo", "tag_name").agg(F.count("*").alias("n"))
    return releases.agg(
        F.count_distinct("repo").alias("total_repositories"), F.count("*").alias("total_releases"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_enhanced_features"),
    )


def sample_preview(enriched: DataFrame, order: list[str], limit: int = 5, features: int = 2) -> DataFrame:
    """First features of the first releases, texts cut short (the printed sample)."""
    releases = enriched.groupBy("repo", "tag_name").agg(F.min(F.struct(*order)).alias("_at"))
    chosen = releases.orderBy("_at").limit(limit).select("repo", "tag_name")
    rows = enriched.join(F.broadcast(chosen), ["repo", "tag_name"])
    shown = first_n(rows, ["repo", "tag_name"], [F.asc("feature_pos")], features)
    return shown.select(
        *FEATURE, text.preview(F.col("description"), 100).alias("description_preview"), "n_prs",
        text.preview(F.col("feature_detailed_description"), 150).alias("detail_preview"),
    )
