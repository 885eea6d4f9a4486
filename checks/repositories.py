"""Queries on repositories and releases."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import Tables, repo
from taskmine import defaults as d
from taskmine.functions import paths, text
from taskmine.operators import releases as rel, repos as rep
from taskmine.plans import collect
from taskmine.sources import landed
from taskmine.sources.folders import work_folder

DATE = "1998-06-01"  # the given orders span 1995 to 2001


def listing(t: Tables):
    return t.repo_listing.withColumn("topics", F.split("topics_csv", ","))


def processed(t: Tables):
    return listing(t).where("segment = 'BUILDING'")


@query("repo_rank_range", """
select full_name, stargazers_count, cast("rank" as int) as "rank" from (
  select *, row_number() over (order by stargazers_count desc, api_pos) as "rank" from repo_listing where stargazers_count >= 5000)
where "rank" between 100 and 200""")
def repo_rank_range(t):
    return rep.rank_candidates(t.repo_listing).select("full_name", "stargazers_count", "rank")


@query("repo_rank_wide", """
select full_name, stargazers_count, cast("rank" as int) as "rank" from (
  select *, row_number() over (order by stargazers_count desc, api_pos) as "rank" from repo_listing where stargazers_count >= 0)
where "rank" between 900 and 1400""")
def repo_rank_wide(t):
    return rep.rank_candidates(t.repo_listing, 0, 900, 1400).select("full_name", "stargazers_count", "rank")


NAMES = f"""
select {repo('c_custkey')} as full_name from {{customer}} where c_custkey % 50 <> 0
union all select {repo('(c_custkey + 1)')} from {{customer}} where c_custkey % 50 <> 0
union all select {repo('c_custkey')} from {{customer}} where c_custkey % 50 <> 0"""


@query("crawl_list_explode", NAMES)
def crawl_list_explode(t):
    return landed.crawl_list(t.crawl_documents)


@query("repo_detail_lookup", f"""
with names as ({NAMES})
select full_name, stargazers_count, size, coalesce(topics_csv, '') as topics, coalesce(language, '') as language,
  coalesce(archived, false) as archived, false as disabled, false as fork
from names join repo_listing using (full_name) where segment <> 'AUTOMOBILE'""")
def repo_detail_lookup(t):
    details = listing(t).where("segment <> 'AUTOMOBILE'").select(
        "full_name", "stargazers_count", "size", "topics", "language", "archived",
        F.lit(None).cast("boolean").alias("disabled"), F.lit(False).alias("fork"),
    )
    found = rep.detail_lookup(landed.crawl_list(t.crawl_documents), details)
    return found.withColumn("topics", F.array_join("topics", ","))


@query("repos_todo", """
select full_name, stargazers_count from repo_listing
where full_name not in (select full_name from repo_listing where segment = 'BUILDING')""")
def repos_todo(t):
    return rep.unprocessed(listing(t), processed(t)).select("full_name", "stargazers_count")


@query("repos_all", """
select full_name, case when segment = 'BUILDING' then python_version end as python_version from repo_listing""")
def repos_all(t):
    fresh = rep.unprocessed(listing(t), processed(t)).select("full_name")
    return rep.with_processed(processed(t).select("full_name", "python_version"), fresh)


TOPIC_OK = """not coalesce(list_has_any(string_split(topics_csv, ','), ['tutorial', 'beginner', 'example', 'course',
  'boilerplate', 'book', 'awesome', 'books', 'education', 'learning', 'demo', 'starter', 'guide']), false)"""


@query("topic_exclusion", f"select full_name, topics_csv from repo_listing where {TOPIC_OK}")
def topic_exclusion(t):
    return rep.without_topics(listing(t)).select("full_name", "topics_csv")


TEST_NAME = r"'^(test_.*\.py$|.*_test\.py$|.*_spec\.py$|conftest\.py$)'"
HAS_TESTS = f"""
select repo, bool_or(case when not contains(path, '/') then regexp_matches(path, {TEST_NAME})
    else (contains(lower(split_part(path, '/', 1)), 'test') or contains(lower(split_part(path, '/', 1)), 'spec'))
      and path like '%.py' end) as has_tests
from repo_files group by repo"""


@query("repo_has_tests", HAS_TESTS)
def repo_has_tests(t):
    return rep.tested_repos(t.repo_files)


@query("repo_has_tests_read", HAS_TESTS.replace("repo_files", "sparse_files"))
def repo_has_tests_read(t):
    """Listings written as JSON with their directories, and read back: only files count."""
    target = f"{work_folder(t.spark)}/listings-{uuid.uuid4().hex}"
    files = t.sparse_files.withColumn("type", F.lit("file"))
    folders = files.select("repo", "pos", F.lit("tests/test_dir.py").alias("path"), F.lit("dir").alias("type"))
    files.unionByName(folders, allowMissingColumns=True).write.json(target)
    return rep.tested_repos(landed.repository_files(t.spark, target))


@query("is_test_file", f"""
select repo, pos, path, list_has_any(string_split(lower(path), '/'), ['test', 'tests', 'testing', 'spec', 'specs'])
  or regexp_matches(split_part(path, '/', -1), {TEST_NAME}) as is_test from repo_files""")
def is_test_file(t):
    return t.repo_files.select("repo", "pos", "path", paths.is_test_file(F.col("path")).alias("is_test"))


@query("release_scan", """
select repo, api_pos, tag_name, coalesce(name, '') as name, length(body) as body_length, published_at, target_commitish,
  author_login from releases""")
def release_scan(t):
    answers = t.releases.withColumn("author", F.when(F.col("author_login").isNotNull(), F.struct(F.col("author_login").alias("login"))))
    rows = landed.release_rows(answers)
    return rows.withColumn("body_length", F.length("body").cast("bigint")).drop("body")


VALID = f"""
select repo, api_pos, tag_name, try_cast(replace(published_at, 'Z', '+00:00') as timestamptz) as at from releases
where coalesce(author_login, '') not in ('github-actions[bot]', 'dependabot[bot]', 'renovate[bot]', 'greenkeeper[bot]')
  and api_pos % 120 >= 50 and published_at like '%Z'
  and try_cast(replace(published_at, 'Z', '+00:00') as timestamptz) >= timestamptz '{DATE} 00:00:00+00'"""


def valid(t):
    return rel.valid_releases(t.releases, min_date=DATE)


@query("valid_releases", f"select repo, api_pos, tag_name from ({VALID})")
def valid_releases(t):
    return valid(t).select("repo", "api_pos", "tag_name")


@query("repo_min_releases", f"select repo, count(*) as releases_count from ({VALID}) group by repo having count(*) >= 5")
def repo_min_releases(t):
    return rel.release_counts(valid(t))


# the version of a generated tag, from the numbers it was built of
VERSION = """case when api_pos % 31 = 0 then null else
  [cast(api_pos % 4 as hugeint), api_pos % 13] || case when api_pos % 5 = 0 then [] else [cast(api_pos % 29 as hugeint)] end end"""
KEYED = f"""
select *, {VERSION} as version, array_to_string({VERSION}, '.') as version_key,
  regexp_matches(lower(tag_name), '(alpha|beta|rc|a[0-9]+|b[0-9]+)') as pre from releases"""


@query("version_extract", f"select api_pos, tag_name, version_key from ({KEYED}) where version is not null")
def version_extract(t):
    return rel.versioned(t.releases).select("api_pos", "tag_name", "version_key")


@query("release_top_versions", f"""
select repo, api_pos, version_key, cast("rank" as int) as "rank" from (
  select *, row_number() over (partition by repo order by version desc, api_pos) as "rank" from ({KEYED})
  where version is not null and not pre) where "rank" <= 30""")
def release_top_versions(t):
    return rel.top_versions(t.releases, d.RELEASES_PER_REPO).select("repo", "api_pos", "version_key", "rank")


@query("release_latest_per_major", f"""
select repo, api_pos, version_key from (
  select *, row_number() over (partition by repo, version[1] order by version desc, api_pos) as n from ({KEYED})
  where version is not null and not pre) where n = 1""")
def release_latest_per_major(t):
    return rel.latest_per_major(t.releases).select("repo", "api_pos", "version_key")


@query("repo_readme", """
select repo, arg_min(content, pos) as readme_content from repo_files
where lower(path) in ('readme.md', 'readme.rst', 'readme.txt', 'readme') and download_url <> '' group by repo""")
def repo_readme(t):
    return rep.readmes(t.repo_files)


@query("repo_ci_configs", """
select repo, path, arg_max(download_url, pos) as download_url from repo_files
where path like '.github/workflows/%' and (path like '%.yml' or path like '%.yaml') and download_url <> ''
group by repo, path""")
def repo_ci_configs(t):
    return rep.ci_configs(t.repo_files)


QUALIFIED = f"""
select l.full_name, l.stargazers_count, c.releases_count from repo_listing l
join (select repo, count(*) as releases_count from ({VALID}) group by repo having count(*) >= 5) c on c.repo = l.full_name
join ({HAS_TESTS}) h on h.repo = l.full_name
where {TOPIC_OK} and segment <> 'BUILDING' and has_tests"""


def qualified(t):
    return collect.qualify_repositories(listing(t), processed(t), t.repo_files, t.releases, min_release_date=DATE)


@query("qualified_repositories", QUALIFIED)
def qualified_repositories(t):
    return qualified(t).select("full_name", "stargazers_count", "releases_count")


@query("repositories", f"""
with best as (select repo, string_agg(tag_name, '; ' order by "rank") as tags from (
    select k.*, row_number() over (partition by k.repo order by version desc, k.api_pos) as "rank"
    from ({KEYED}) k join ({VALID}) v on v.api_pos = k.api_pos where version is not null and not pre)
  where "rank" <= 30 group by repo),
readme as (select repo, arg_min(content, pos) as content from repo_files
  where lower(path) in ('readme.md', 'readme.rst', 'readme.txt', 'readme') and download_url <> '' group by repo),
ci as (select repo, string_agg(distinct path, '; ' order by path) as paths from repo_files
  where path like '.github/workflows/%' and download_url <> '' group by repo)
select full_name, stargazers_count, releases_count, tags, coalesce(content, '') as readme, coalesce(paths, '') as workflows
from ({QUALIFIED}) q join best on best.repo = full_name left join readme on readme.repo = full_name left join ci on ci.repo = full_name""")
def repositories(t):
    records = collect.build_repositories(qualified(t), t.releases, t.repo_files, d.RELEASES_PER_REPO, min_release_date=DATE)
    return records.select(
        "full_name", "stargazers_count", "releases_count",
        F.array_join(F.transform("major_releases", lambda release: release["tag_name"]), "; ").alias("tags"),
        F.col("readme_content").alias("readme"),
        F.array_join(F.array_sort(F.map_keys("ci_configs")), "; ").alias("workflows"),
    )


@query("test_dirs", """
with flags as (select repo, bool_or(split_part(path, '/', 1) in ('tests', 'test', 'Tests', 'TESTS', 'unit_tests', 'TEST')
    and contains(path, '/')) as has_root from repo_files group by repo),
dirs as (select distinct repo, case path when 'tests/test_a.py' then 'tests' when 'unit_tests/a/b.py' then 'unit_tests'
    when 'lib/tests/y.py' then 'lib/tests' end as dir, path not like 'lib/%' as is_root from repo_files)
select f.repo, coalesce(d.dir, 'tests') as test_dir from flags f
left join (select * from dirs where dir is not null) d on d.repo = f.repo and d.is_root = f.has_root""")
def test_dirs(t):
    return rep.test_dirs(t.repo_files)


@query("python_version", "select full_name, coalesce(python_version, '3.9') as python_version from repo_listing")
def python_version(t):
    return rep.python_versions(t.repo_listing, t.repo_listing.where("python_version is not null"))


@query("created_date", """
select api_pos, case when published_at is null then '' when published_at = 'not-a-date' then published_at
  else substr(published_at, 1, 10) end as created_on from releases""")
def created_date(t):
    return t.releases.select("api_pos", text.calendar_date(F.col("published_at")).alias("created_on"))
