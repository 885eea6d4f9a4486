"""Queries on release changes, pull requests and task specs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.registry import query
from taskmine import defaults as d
from taskmine.functions import text
from taskmine.operators import changes as ch, pull_requests as pr, repos as rep, requests as rq, specs as sp
from taskmine.operators.ranking import WIDE, dealt, landed_once
from taskmine.plans import collect, enrich
from taskmine.sources import json_arrays, landed, schemas
from taskmine.sources.folders import work_folder
from taskmine.sources.stages import staged

# the change rows of a generated answer, from the order key it was built of
CHANGE_ROWS = """
select repo, release_pos, tag_name, 'new_feature' as feature_type, 0 as feature_pos, concat('f', release_pos % 50) as description,
  concat_ws(', ', concat('https://github.com/', repo, '/pull/', release_pos), concat('https://github.com/', repo, '/pull/#', release_pos % 9),
    case when release_pos % 4 < 3 then concat('https://github.com/', repo, '/pull/', release_pos + 1) end) as links
from release_answers where release_pos % 29 <> 0
union all
select repo, release_pos, tag_name, 'new_feature', 1, '', '' from release_answers where release_pos % 29 <> 0 and release_pos % 3 = 0
union all
select repo, release_pos, tag_name, 'improvement', 0, 'i', concat('https://github.com/', repo, '/pull/7')
from release_answers where release_pos % 29 <> 0 and release_pos % 2 = 0
union all
select repo, release_pos, tag_name, 'bug_fix', pos, concat('b', pos + 1), case pos when 0 then '' else concat('https://github.com/', repo, '/pull/8') end
from release_answers, (select unnest([0, 1]) as pos) where release_pos % 29 <> 0 and release_pos % 5 = 0"""

FEATURE_PRS = """
select repo, release_pos, tag_name, feature_pos, description, pr_pos, pr_number from (
  select repo, release_pos, tag_name, 0 as feature_pos, concat('f', release_pos % 50) as description,
    unnest([0, 2]) as pr_pos, unnest([release_pos, case when release_pos % 4 < 3 then release_pos + 1 end]) as pr_number
  from release_answers where release_pos % 29 <> 0) where pr_number is not null"""


def change_rows(t):
    return collect.parse_release_changes(t.release_answers.drop("priority"))


@query("release_changes_parse", CHANGE_ROWS)
def release_changes_parse(t):
    return change_rows(t).withColumn("links", F.array_join("pr_links", ", ")).drop("pr_links")


@query("change_counts", """
select case when grouping(repo) = 1 then null else repo end as repo, count(*) as releases,
  cast(sum(case when release_pos % 29 = 0 then 0 when release_pos % 3 = 0 then 2 else 1 end) as bigint) as new_features,
  cast(sum(case when release_pos % 29 <> 0 and release_pos % 2 = 0 then 1 else 0 end) as bigint) as improvements,
  cast(sum(case when release_pos % 29 <> 0 and release_pos % 5 = 0 then 2 else 0 end) as bigint) as bug_fixes
from release_answers group by rollup(repo)""")
def change_counts(t):
    return ch.change_counts(ch.parsed_answers(t.release_answers))


@query("readme_excerpt", """
select doc_id, case when length(text) > 2000 then concat(left(text, 2000), '...(truncated)') else text end as excerpt from {documents}""")
def readme_excerpt(t):
    return t.documents.select("doc_id", text.excerpt(F.col("text"), d.MAX_README_LENGTH).alias("excerpt"))


@query("release_prompt", """
with readme as (select repo, arg_min(content, pos) as content from repo_files
  where lower(path) in ('readme.md', 'readme.rst', 'readme.txt', 'readme') and download_url <> '' group by repo)
select r.repo, r.tag_name, concat(case when content is null then '' else concat('Context: ', content, chr(10)) end,
  'Release {', r.tag_name, '}: ', r.body) as prompt
from releases r left join readme using (repo)""")
def release_prompt(t):
    # the default wording is long; a short template shows the same slots
    requests = ch.release_requests(
        t.releases, rep.readmes(t.repo_files), "{readme_section}Release {{tag_name}}: {body}", "Context: {readme}\n"
    )
    return requests


@query("feature_prs", f"""
select repo, tag_name, feature_pos, pr_pos, cast(pr_number as string) as pr_number from ({FEATURE_PRS})""")
def feature_prs(t):
    return pr.feature_prs(change_rows(t)).select("repo", "tag_name", "feature_pos", "pr_pos", "pr_number")


@query("pr_files_scan", """
select repo, pr_number, pos, filename, status, additions, deletions, changes, coalesce(patch, '') as patch from pr_files""")
def pr_files_scan(t):
    fields = F.struct("filename", "status", "additions", "deletions", "changes", "patch")
    # the files answer of one pull request; positions come back from the array
    ordered = F.array_sort(F.collect_list(F.struct("pos", fields.alias("file"))))
    answers = t.pr_files.groupBy("repo", "pr_number").agg(
        F.transform(ordered, lambda one: one["pos"]).alias("places"),
        F.to_json(F.transform(ordered, lambda one: one["file"])).alias("files"),
    )
    rows = landed.pull_request_files(answers)
    return rows.withColumn("pos", F.get("places", F.col("pos"))).drop("places")


@query("content_decode", "select doc_id, length(text) as n_chars, md5(text) as digest from {documents}")
def content_decode(t):
    answers = t.documents.select("doc_id", F.lit("base64").alias("encoding"), F.base64(F.encode("text", "UTF-8")).alias("content"))
    decoded = landed.decoded_contents(answers)
    return decoded.select("doc_id", F.length("content").cast("bigint").alias("n_chars"), F.md5("content").alias("digest"))


@query("pr_commits", """
select p.repo, p.pr_number, base_sha, coalesce(b.message, '') as base_message, coalesce(b.date, '') as base_date,
  head_sha, coalesce(h.message, '') as head_message, coalesce(h.author, '') as head_author
from pull_requests p left join commits b on b.repo = p.repo and b.sha = base_sha
left join commits h on h.repo = p.repo and h.sha = head_sha""")
def pr_commits(t):
    commits = t.commits.withColumn("author", text.or_empty(F.col("author")))
    joined = pr.with_commits(landed_prs(t), commits)
    return joined.select(
        "repo", "pr_number", F.col("base_commit.sha").alias("base_sha"), F.col("base_commit.message").alias("base_message"),
        F.col("base_commit.date").alias("base_date"), F.col("head_commit.sha").alias("head_sha"),
        F.col("head_commit.message").alias("head_message"), F.col("head_commit.author").alias("head_author"),
    )


@query("pr_commits_landed_twice", """
select p.repo, p.pr_number, coalesce(b.message, '') as base_message, case when b.message is null then '' else '2' end as base_author
from pull_requests p left join commits b on b.repo = p.repo and b.sha = base_sha""")
def pr_commits_landed_twice(t):
    """A commit that landed again counts once, as it landed last; a pull request stays one row."""
    land = lambda n: t.commits.where("message = 'base'").withColumn("author", F.lit(str(n))).withColumn("landed_seq", F.lit(n))
    commits = landed_once(land(1).unionByName(land(2)), ["repo", "sha"], ["landed_seq"])
    joined = pr.with_commits(landed_prs(t), commits)
    return joined.select("repo", "pr_number", F.col("base_commit.message").alias("base_message"), F.col("base_commit.author").alias("base_author"))


def landed_prs(t):
    return t.pull_requests.select(
        "repo", "pr_number", "title", text.or_empty(F.col("body")).alias("body"), "state", "merged", "base_sha", "head_sha"
    )


def landed_tables(t):
    return enrich.Landed(landed_prs(t), t.pr_files, t.commits, t.file_contents)


@query("pr_file_lists", """
select repo, pr_number, coalesce(string_agg(filename, ', ' order by pos) filter (filename like 'tests/%'), '') as test_files,
  coalesce(string_agg(filename, ', ' order by pos) filter (filename like 'src/%'), '') as non_test_files
from pr_files group by repo, pr_number""")
def pr_file_lists(t):
    lists = pr.file_lists(t.pr_files)
    joined = lambda name: F.array_join(name, ", ").alias(name)
    return lists.select("repo", "pr_number", joined("test_files"), joined("non_test_files"))


ELIGIBLE = """
select repo, pr_number, bool_or(filename like 'tests/%') as has_tests, bool_or(filename like 'src/%') as has_source,
  not bool_or(filename like 'src/%' and case status when 'added' then pr_id % 9 = 0 and pr_id % 11 <> 0
    when 'removed' then pr_id % 6 = 0 else pr_id % 8 = 0 or pr_id % 11 = 0 end) as only_modified_existing_functions
from pr_files f where exists (select 1 from pull_requests p where p.repo = f.repo and p.pr_number = f.pr_number)
group by repo, pr_number"""


def eligible(t):
    return pr.eligibility(t.pr_files, landed_prs(t), pr.snapshot_definitions(t.file_contents))


@query("pr_eligibility", f"select *, has_tests and has_source and only_modified_existing_functions as eligible from ({ELIGIBLE})")
def pr_eligibility(t):
    return eligible(t)


SUMMARY = """
select repo, pr_number, coalesce(string_agg(concat('- ', filename, ' (', status, '): +', additions, '/-', deletions,
    case when length(patch) < 1000 then concat(chr(10), '  ', left(patch, 600), '...') else '' end), chr(10) order by pos)
  filter (filename not like 'tests/%' and shown <= 2), 'No files were modified in this PR.')
  || case when max(others) > 2 then concat(chr(10), '... and ', max(others) - 2, ' more files') else '' end as files_text
from (select *, count(*) filter (filename not like 'tests/%') over (partition by repo, pr_number) as others,
    row_number() over (partition by repo, pr_number, filename like 'tests/%' order by pos) as shown from pr_files)
group by repo, pr_number"""


@query("pr_files_summary", SUMMARY)
def pr_files_summary(t):
    # orders have at most seven files, so the file limit is set low enough to matter
    return pr.files_summary(t.pr_files, **{**d.SUMMARY_LIMITS, "max_files": 2})


MENTIONS = f"select repo, pr_number, arg_min(description, release_pos) as feature_description from ({FEATURE_PRS}) group by repo, pr_number"


@query("feature_prompt", f"""
select e.repo, e.pr_number, concat('Feature ', feature_description, chr(10), title, chr(10), coalesce(body, ''), chr(10), files_text) as prompt
from ({ELIGIBLE}) e join pull_requests p on p.repo = e.repo and p.pr_number = e.pr_number
join ({SUMMARY}) s on s.repo = e.repo and s.pr_number = e.pr_number
join ({MENTIONS}) m on m.repo = e.repo and cast(m.pr_number as string) = e.pr_number
where has_tests and has_source and only_modified_existing_functions""")
def feature_prompt(t):
    t = t.files_landed()
    mentions = pr.first_mentions(pr.feature_prs(change_rows(t)))
    summaries = pr.files_summary(t.pr_files, **{**d.SUMMARY_LIMITS, "max_files": 2})
    return pr.pr_requests(eligible(t), landed_prs(t), summaries, mentions, "Feature {feature}\n{title}\n{body}\n{files}")


ALL_SUMMARY = SUMMARY.replace(" and shown <= 2", "").replace("max(others) > 2", "false")
SHORT = "Feature {feature}\n{title}\n{body}\n{files}"
PR_REQUESTS = f"""
select e.repo, e.pr_number, sha256(concat('Feature ', feature_description, chr(10), title, chr(10), coalesce(body, ''), chr(10), files_text)) as prompt_key
from ({ELIGIBLE}) e join pull_requests p on p.repo = e.repo and p.pr_number = e.pr_number
join ({ALL_SUMMARY}) s on s.repo = e.repo and s.pr_number = e.pr_number
join ({MENTIONS}) m on m.repo = e.repo and cast(m.pr_number as string) = e.pr_number
where has_tests and has_source and only_modified_existing_functions and cast(e.pr_number as bigint) % 5 <> 0"""


def pr_requests(t):
    t = t.files_landed()
    analysed = t.pull_requests.where("cast(pr_number as bigint) % 5 = 0").select("repo", "pr_number")
    limits = {name: d.SUMMARY_LIMITS[name] for name in ("max_patch", "max_preview")}
    return enrich.description_requests(change_rows(t), landed_tables(t), analysed, SHORT, **limits).prs


@query("description_requests", PR_REQUESTS)
def description_requests(t):
    return pr_requests(t).drop("prompt")


@query("requests_answered", f"""
select repo, pr_number, case when cast(pr_number as bigint) % 3 > 0 then concat('I want to ', pr_number) end as response,
  cast(pr_number as bigint) % 3 = 0 as to_ask from ({PR_REQUESTS})""")
def requests_answered(t):
    """Answers to prompts of an older wording (every third) are not taken for those of today."""
    asked = staged(pr_requests(t), "pr-requests")
    old = F.col("pr_number").cast("bigint") % 3 == 0
    answers = asked.select(F.when(old, F.sha2(F.concat(F.lit("old "), "prompt"), 256)).otherwise(F.col("prompt_key")).alias("prompt_key"),
                           F.concat(F.lit("I want to "), "pr_number").alias("response"))
    answers = answers.unionByName(answers.withColumn("response", F.lit(None).cast("string")))
    known = rq.answered(asked, answers).select("repo", "pr_number", "response")
    todo = asked.join(rq.to_ask(asked, answers).select("prompt_key", F.lit(True).alias("to_ask")), "prompt_key", "left")
    return todo.join(known, ["repo", "pr_number"], "left").select("repo", "pr_number", "response", F.coalesce("to_ask", F.lit(False)).alias("to_ask"))


@query("release_requests", """
with readme as (select repo, arg_min(content, pos) as content from repo_files
  where lower(path) in ('readme.md', 'readme.rst', 'readme.txt', 'readme') and download_url <> '' group by repo)
select distinct r.repo, r.tag_name, sha256(concat(case when content is null then '' else concat('Context: ', content, chr(10)) end,
  'Release {', r.tag_name, '}: ', r.body)) as prompt_key
from releases r left join readme using (repo) where r.author_login is distinct from 'dev' and not exists (
  select 1 from releases c where c.repo = r.repo and c.tag_name = r.tag_name and c.author_login = 'dev')""")
def release_requests(t):
    listed = t.releases.groupBy(F.col("repo").alias("full_name")).agg(F.collect_list(F.struct("tag_name", "body")).alias("major_releases"))
    records = listed.join(rep.readmes(t.repo_files).withColumnRenamed("repo", "full_name"), "full_name", "left")
    twice = records.unionByName(records)  # a repository may be named twice
    analysed = t.releases.where("author_login = 'dev'").select("repo", "tag_name")
    wording = {"template": "{readme_section}Release {{tag_name}}: {body}", "readme_section": "Context: {readme}\n"}
    return collect.release_requests(twice, analysed, **wording).drop("prompt").distinct()


def pr_responses(t):
    return t.pull_requests.where("priority <> '5-LOW'").select(
        "repo", "pr_number", F.concat(F.lit("I want to "), "pr_number").alias("response")
    )


def feature_responses(t):
    return t.release_answers.where("priority <> '1-URGENT'").select(
        "repo", "tag_name", F.lit(0).alias("feature_pos"),
        F.expr("case when release_pos % 5 = 0 then null else concat('All of ', tag_name) end").alias("response"),
    )


ENRICHED = f"""
with described as (
  select f.*, a.priority as release_priority, case when p.priority <> '5-LOW' then concat('I want to ', e.pr_number) else feature_description end as text
  from ({FEATURE_PRS}) f join ({ELIGIBLE}) e on e.repo = f.repo and e.pr_number = cast(f.pr_number as string)
  join pull_requests p on p.repo = e.repo and p.pr_number = e.pr_number
  join ({MENTIONS}) m on m.repo = f.repo and m.pr_number = f.pr_number
  join release_answers a on a.repo = f.repo and a.tag_name = f.tag_name
  where has_tests and has_source and only_modified_existing_functions),
enriched as (select repo, tag_name, feature_pos, 'new_feature' as feature_type, description, count(*) as n_prs,
  case when count(*) = 1 then min(text) when release_priority = '1-URGENT' then null
    when release_pos % 5 = 0 then description else concat('All of ', tag_name) end as feature_detailed_description, release_pos
from described group by repo, tag_name, feature_pos, description, release_pos, release_priority)"""


@query("feature_requests", f"""
with described as (
  select f.repo, f.tag_name, f.feature_pos, f.description, f.pr_pos, f.pr_number, p.title, p.state, p.merged, n_files,
    case when p.priority <> '5-LOW' then concat('I want to ', e.pr_number) else feature_description end as text
  from ({FEATURE_PRS}) f join ({ELIGIBLE}) e on e.repo = f.repo and e.pr_number = cast(f.pr_number as string)
  join pull_requests p on p.repo = e.repo and p.pr_number = e.pr_number
  join ({MENTIONS}) m on m.repo = f.repo and m.pr_number = f.pr_number
  join (select repo, pr_number, count(*) as n_files from pr_files group by repo, pr_number) c on c.repo = e.repo and c.pr_number = e.pr_number
  where has_tests and has_source and only_modified_existing_functions)
select repo, tag_name, feature_pos, sha256(concat('new_feature ', description, ':', string_agg(concat(chr(10), 'PR #', pr_number, ': ', title, chr(10), '- Status: ', state,
    ' (merged: ', case when merged then 'True' else 'False' end, ')', chr(10), '- Files changed: ', n_files, chr(10), '- User benefits: ', text, chr(10)), chr(10) order by pr_pos))) as prompt_key
from described group by repo, tag_name, feature_pos, description having count(*) > 1""")
def feature_requests(t):
    t = t.files_landed()
    wording = "{feature_type} {feature}:{pull_requests}"
    return enrich.feature_requests(change_rows(t), landed_tables(t), pr_responses(t), template=wording).drop("prompt")


def enriched(t):
    t = t.files_landed()
    return enrich.enrich_features(change_rows(t), landed_tables(t), pr_responses(t), feature_responses(t))


@query("feature_enrich", f"""{ENRICHED}
select * exclude (release_pos) from enriched where feature_detailed_description is not null""")
def feature_enrich(t):
    return enriched(t)


ORDERED = """
select repo, pr_number, pr_id, title, case when pr_id % 3 = 0 then [2, 0, 1] when pr_id % 3 = 1 then [1, 0] else [0] end as places from (
  select *, cast(pr_number as bigint) as pr_id from pull_requests)"""


@query("feature_order", f"""
select repo, concat('v', pr_number) as release, string_agg(concat('f', place, ': ', pr_number, '=', title), ', ' order by place) as features
from (select *, unnest(places) as place from ({ORDERED})) group by repo, pr_number""")
def feature_order(t):
    """Several features of one release, which arrive in any order, stand in it in theirs."""
    places = F.expr("case cast(pr_number as bigint) % 3 when 0 then array(2, 0, 1) when 1 then array(1, 0) else array(0) end")
    prs = landed_prs(t).withColumns({"base_commit": F.lit("b"), "head_commit": F.lit("h")})
    rows = prs.select(*pr.PR, "title", F.concat(F.lit("v"), "pr_number").alias("tag_name"), F.explode(places).alias("feature_pos"))
    features = rows.select("*", F.lit("new_feature").alias("feature_type"), F.concat(F.lit("f"), "feature_pos").alias("description"), F.lit(0).alias("pr_pos"))
    descriptions = prs.select(*pr.PR, F.col("title").alias("detailed_description"))
    enriched = pr.enriched_features(features, descriptions, feature_responses(t).where("false"))
    analyses = prs.select(*pr.PR, F.struct("pr_number", F.col("title").alias("detailed_description")).alias("pr_analysis"))
    records = prs.select("repo", F.concat(F.lit("v"), "pr_number").alias("tag_name"), F.lit(0).alias("release_pos"),
                         F.struct(F.lit("now").alias("analyzed_at")).alias("original_analysis"))
    nested = pr.nested_results(features, enriched, analyses, records)
    shown = lambda one: F.concat(one["description"], F.lit(": "), one["pr_analyses"][0]["pr_number"], F.lit("="), one["feature_detailed_description"])
    return nested.select(F.col("repository").alias("repo"), "release", F.array_join(F.transform("enhanced_new_features", shown), ", ").alias("features"))


@query("final_metadata", f"""{ENRICHED}
select count(distinct repo) as total_repositories, count(distinct (repo, tag_name)) as total_releases,
  count(*) as total_enhanced_features from enriched where feature_detailed_description is not null""")
def final_metadata(t):
    return enrich.totals(enriched(t)).drop("generated_at")


@query("sample_preview", f"""{ENRICHED}, kept as (select * from enriched where feature_detailed_description is not null),
chosen as (select repo, tag_name from kept group by repo, tag_name order by tag_name limit 5)
select repo, tag_name, feature_pos, concat(left(description, 100), '...') as description_preview, n_prs,
  concat(left(feature_detailed_description, 150), '...') as detail_preview from kept join chosen using (repo, tag_name) where feature_pos < 2""")
def sample_preview(t):
    return pr.sample_preview(staged(enriched(t), "enriched"), order=["tag_name"])


@query("final_results", f"""{ENRICHED}
select release_pos as seq, repo as repository, tag_name as "release", count(*) as features, cast(sum(n_prs) as bigint) as prs,
  string_agg(feature_detailed_description, '; ' order by feature_pos) as details,
  cast(case when release_pos % 2 = 0 then 1 else 0 end as int) as improvements, concat('notes of ', tag_name) as notes
from enriched where feature_detailed_description is not null group by repo, tag_name, release_pos""")
def final_results(t):
    t = t.files_landed()
    notes = t.release_answers.select("repo", "tag_name", F.concat(F.lit("notes of "), "tag_name").alias("body"))
    answers = t.release_answers.drop("priority")
    results = enrich.final_results(answers, notes, landed_tables(t), pr_responses(t), feature_responses(t))
    features = F.col("enhanced_new_features")
    counted = F.aggregate(features, F.lit(0).cast("bigint"), lambda n, one: n + F.size(one["pr_analyses"]))
    return results.select(
        "seq", "repository", "release", F.size(features).cast("bigint").alias("features"), counted.alias("prs"),
        F.array_join(F.transform(features, lambda one: one["feature_detailed_description"]), "; ").alias("details"),
        F.size("original_analysis.improvements").alias("improvements"), F.col("original_analysis.processed_body").alias("notes"),
    )


# --- task specs ------------------------------------------------------------

# each pull request is named by its own release and, mostly, by the one before it
SPEC_ROWS = """
select r.seq, r.repo, r.version, p.pr_number, p.base_sha, p.title
from (select repo, release_pos as seq, tag_name as version, unnest([release_pos, release_pos - 1]) as pr_id from release_answers) r
join pull_requests p on p.repo = r.repo and p.pr_number = cast(r.pr_id as string)"""
PATCHES = """
select repo, pr_number, coalesce(string_agg(filename, ', ' order by pos) filter (filename not like 'tests/%'), '') as patch,
  coalesce(string_agg(filename, ', ' order by pos) filter (filename like 'tests/%'), '') as test_patch
from pr_files group by repo, pr_number"""


def results(t):
    """Nested result documents: each release holds its own pull request and the one before."""
    t = t.files_dealt()
    changes = t.pr_files.groupBy("repo", "pr_number").agg(F.array_sort(F.collect_list(F.struct(
        "pos", "filename", "status", "additions", "deletions", "changes", "patch"))).alias("file_changes"))
    with_files = landed_prs(t).join(changes, ["repo", "pr_number"]).join(pr.file_lists(t.pr_files), ["repo", "pr_number"])
    record = F.struct(
        "pr_number", F.struct(F.col("base_sha").alias("sha"), F.lit("2024-01-01T00:00:00Z").alias("date")).alias("base_commit"),
        F.col("title").alias("detailed_description"), "file_changes", "test_files",
    )
    own = t.release_answers.select(
        "repo", F.col("release_pos").alias("seq"), F.col("tag_name").alias("release"),
        F.posexplode(F.array("release_pos", F.col("release_pos") - 1)).alias("at", "pr_id"),
    ).withColumn("pr_number", F.col("pr_id").cast("string"))
    joined = own.join(with_files.select("repo", "pr_number", record.alias("record")), ["repo", "pr_number"])
    # whole records move here, into tasks that hold few of them
    documents = dealt(joined.withColumnRenamed("repo", "repository"), ["seq", "repository", "release"], WIDE)
    gathered = documents.groupBy("seq", "repository", "release").agg(
        F.array_sort(F.collect_list(F.struct("at", "record"))).alias("entries"))
    feature = F.struct(F.transform("entries", lambda one: one["record"]).alias("pr_analyses"))
    return gathered.select("seq", "repository", "release", F.array(feature).alias("enhanced_new_features"))


def flat(specs, *extra):
    names = lambda name: F.array_join(F.transform(name, lambda change: change["filename"]), ", ").alias(name)
    return specs.select(*extra, "repo", "instance_id", "version", "org", "number", "base_commit", "problem_statement",
                        names("patch"), names("test_patch"))


SPEC_COLUMNS = """s.repo, concat(replace(s.repo, '/', '__'), '-', s.pr_number) as instance_id, version, split_part(s.repo, '/', 1) as org,
  cast(s.pr_number as bigint) as number, base_sha as base_commit, title as problem_statement, patch, test_patch"""


@query("specs_build", f"select seq, {SPEC_COLUMNS} from ({SPEC_ROWS}) s join ({PATCHES}) p on p.repo = s.repo and p.pr_number = s.pr_number")
def specs_build(t):
    return flat(sp.build_specs(results(t)), F.col("spec_order.seq").alias("seq"))


@query("specs_dedup", f"""
select min(seq) as first_seq, arg_max(version, seq) as version, repo, instance_id, org, number, base_commit, problem_statement, patch, test_patch
from (select seq, {SPEC_COLUMNS} from ({SPEC_ROWS}) s join ({PATCHES}) p on p.repo = s.repo and p.pr_number = s.pr_number)
group by all""")
def specs_dedup(t):
    return flat(enrich.build_specs(results(t)), F.col("spec_order.seq").alias("first_seq"))


@query("spec_patch_split", PATCHES)
def spec_patch_split(t):
    change = F.struct("pos", "filename")
    gathered = t.pr_files.groupBy("repo", "pr_number").agg(F.array_sort(F.collect_list(change)).alias("file_changes"))
    source, tests = sp.patch_split(F.col("file_changes"), F.col("test_files"))
    names = lambda column: F.array_join(F.transform(column, lambda one: one["filename"]), ", ")
    split = gathered.join(pr.file_lists(t.pr_files), ["repo", "pr_number"])
    return split.select("repo", "pr_number", names(source).alias("patch"), names(tests).alias("test_patch"))


@query("specs_json_array", f"select seq, {SPEC_COLUMNS} from ({SPEC_ROWS}) s join ({PATCHES}) p on p.repo = s.repo and p.pr_number = s.pr_number")
def specs_json_array(t):
    """The specs of ``specs_build``, written as JSON arrays and read back in parallel."""
    target = f"{work_folder(t.spark)}/specs-{uuid.uuid4().hex}"
    json_arrays.write(sp.build_specs(results(t)), target, "gzip")
    place = "spec_order struct<seq:bigint,feature_pos:int,pr_pos:int>"
    return flat(json_arrays.read(t.spark, target, f"{schemas.TASK_SPEC}, {place}"), F.col("spec_order.seq").alias("seq"))
