"""From release changes to described features and task specs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from taskmine.operators import changes as ch, pull_requests as pr, requests, specs
from taskmine.sources.stages import staged


class Landed(NamedTuple):
    """Landed pull-request tables."""

    prs: DataFrame
    files: DataFrame
    commits: DataFrame
    contents: DataFrame


class Requests(NamedTuple):
    """What still has to be asked: pull requests to describe, features to summarise."""

    features: DataFrame
    eligible: DataFrame
    prs: DataFrame


def judged(features: DataFrame, landed: Landed) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Eligibility of the pull requests that the features name, with their prs and files.

    Landed tables hold far more than that, so they are narrowed first, to the pull
    requests and then to the snapshots that decide; only different texts are parsed.
    """
    keys = features.select(*pr.PR).distinct()
    wanted = lambda frame: frame.join(keys, pr.PR, "left_semi")
    files, prs = wanted(landed.files), wanted(landed.prs)
    # what decides is narrow: it is written once, and patches and bodies stay where they are
    changed = staged(files.select(*pr.PR, "filename", "status"), "changed-files")
    refs = staged(prs.select(*pr.PR, "base_sha", "head_sha"), "changed-refs")
    definitions = pr.distinct_definitions(landed.contents, pr.needed_snapshots(changed, refs))
    return staged(pr.eligibility(changed, refs, definitions), "eligibility"), prs, files


def with_stored(responses: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Answers landed now and those stored before; a stored one is never replaced."""
    if stored is None:
        return responses
    known = stored.select(*responses.columns).dropDuplicates(pr.PR)
    return known.unionByName(responses.join(known.select(*pr.PR), pr.PR, "left_anti"))


def description_requests(
    changes: DataFrame, landed: Landed, analysed: DataFrame, template: str = pr.PR_PROMPT, **limits: int
) -> Requests:
    """Description requests for eligible pull requests that have no stored analysis, keyed by their prompts.

    ``limits`` are those of ``pull_requests.files_summary``. Runs jobs when called.
    """
    features = staged(pr.feature_prs(changes), "features")
    todo = features.join(analysed.select(*pr.PR), pr.PR, "left_anti")
    eligible, prs, files = judged(todo, landed)
    texts = pr.pr_requests(eligible, prs, pr.files_summary(files, **limits), pr.first_mentions(features), template)
    return Requests(features, eligible, requests.keyed(texts))


def feature_requests(
    changes: DataFrame, landed: Landed, pr_responses: DataFrame, stored: DataFrame | None = None, template: str = pr.FEATURE_PROMPT
) -> DataFrame:
    """Synthesis requests for features with several described pull requests, keyed by their prompts. Runs jobs when called."""
    features = staged(pr.feature_prs(changes), "features")
    eligible, prs, files = judged(features, landed)
    descriptions = pr.pr_descriptions(eligible, pr.first_mentions(features), with_stored(pr_responses, stored))
    counts = files.groupBy(*pr.PR).agg(F.count("*").alias("n_files"))
    return requests.keyed(pr.feature_requests(features, prs, counts, descriptions, template))


def enrich_features(
    changes: DataFrame, landed: Landed, pr_responses: DataFrame, feature_responses: DataFrame, stored: DataFrame | None = None
) -> DataFrame:
    """Features with described, eligible pull requests; ``stored``: answers of earlier runs. Runs jobs when called."""
    features = staged(pr.feature_prs(changes), "features")
    eligible, _, _ = judged(features, landed)
    descriptions = pr.pr_descriptions(eligible, pr.first_mentions(features), with_stored(pr_responses, stored))
    return pr.enriched_features(features, descriptions, feature_responses)


def final_results(
    answers: DataFrame, releases: DataFrame, landed: Landed, pr_responses: DataFrame, feature_responses: DataFrame,
    stored: DataFrame | None = None,
) -> DataFrame:
    """The nested result documents, one per release with enriched features.

    The named features and the described pull requests are few next to what they are
    found in; they become stage tables, written when this is called, since several parts
    start from them and answers are parsed only once.
    """
    analysed = ch.analysed(ch.parsed_answers(answers))
    features = staged(pr.feature_prs(ch.release_changes(analysed)), "features")
    eligible, prs, files = judged(features, landed)
    chosen = pr.pr_descriptions(eligible, pr.first_mentions(features), with_stored(pr_responses, stored))
    descriptions = staged(chosen, "descriptions")
    enriched = pr.enriched_features(features, descriptions, feature_responses)
    described = lambda frame: frame.join(descriptions.select(*pr.PR), pr.PR, "left_semi")
    prs, files = pr.with_commits(described(landed.prs), landed.commits), described(landed.files)
    analyses = pr.analyses(prs, files, pr.file_lists(files), descriptions)
    return pr.nested_results(features, enriched, analyses, ch.analysis_records(analysed, releases))


def build_specs(results: DataFrame) -> DataFrame:
    """Unique task specs of result documents (``seq`` gives the document order)."""
    return specs.dedup_specs(specs.build_specs(results))


def totals(enriched: DataFrame) -> DataFrame:
    """The metadata header of the final document."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("generated_at")
    return pr.result_totals(enriched).select(stamp, "*")
