"""Queries on test sources, diffs and patches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.registry import query
from taskmine import defaults as d
from taskmine.functions import paths, text
from taskmine.operators import code_changes as cc, diffs as df, pull_requests as pr, specs as sp
from taskmine.plans import label
from taskmine.sources import landed
from taskmine.sources.folders import work_folder

SPECS = """select instance_id, path from test_sources"""


def specs(t):
    """Specs with their test files, and one file that is no Python file."""
    files = F.concat(F.array_sort(F.collect_list("path")), F.array(F.lit("README.md")))
    return t.test_sources.groupBy("instance_id").agg(files.alias("test_files"))


def snapshots(t):
    """Landed sources; those of one brand are missing."""
    return t.test_sources.where("p_brand <> 'Brand#1'").select("instance_id", "path", "before_src", "after_src")


@query("test_code_snapshot", """
select instance_id, path, case when p_brand <> 'Brand#1' then before_src else '' end as before_src,
  case when p_brand <> 'Brand#1' then after_src else '' end as after_src from test_sources""")
def test_code_snapshot(t):
    return sp.test_snapshots(sp.test_file_rows(specs(t)), snapshots(t)).drop("file_pos")


DEFINITIONS = """
select file_id, unnest(['TestA', 'TestA.test_m', 'test_f']) as path from test_sources where file_id % 50 <> 0
union all select file_id, 'test_gone' from test_sources where file_id % 50 <> 0 and file_id % 3 = 0"""


@query("definitions", DEFINITIONS)
def definitions(t):
    from taskmine.functions.source_code import definitions as listed

    return t.test_sources.select("file_id", F.explode(listed(F.col("before_src"))).alias("path"))


@query("definition_diff", """
select file_id, file_id % 50 <> 0 and file_id % 3 <> 0 as only_modified,
  case when file_id % 50 = 0 then 'TestA, TestA.test_m, test_f' else '' end as new_definitions,
  case when file_id % 50 <> 0 and file_id % 3 = 0 then 'test_gone' else '' end as deleted_definitions from test_sources""")
def definition_diff(t):
    pairs = t.test_sources.select("file_id", "before_src", "after_src")
    diff = pr.definition_diff(pairs, "before_src", "after_src")
    joined = lambda name: F.array_join(name, ", ").alias(name)
    return diff.select("file_id", "only_modified", joined("new_definitions"), joined("deleted_definitions"))


@query("code_elements", r"""
select file_id, code_type, name, "start", "end", md5(body) as digest from (
  select file_id, 'class' as code_type, 'TestA' as name, 0 as "start", 3 as "end", concat('class TestA:', chr(10), '    def test_m(self):', chr(10), '        return ', p_size % 25) as body from test_sources
  union all select file_id, 'method', 'TestA.test_m', 1, 3, concat('    def test_m(self):', chr(10), '        return ', p_size % 25) from test_sources
  union all select file_id, 'function', 'test_f', 3, 5, concat('def test_f():', chr(10), '      return 1') from test_sources
  union all select file_id, 'function', 'test_new', 5, 7, concat('async def test_new():', chr(10), '    pass') from test_sources where file_id % 4 = 0
  union all select file_id, 'function', 'test_cond', case when file_id % 4 = 0 then 8 else 6 end, case when file_id % 4 = 0 then 10 else 8 end,
    concat('    def test_cond():', chr(10), '        pass') from test_sources where file_id % 5 = 0)""")
def code_elements(t):
    rows = cc.code_elements(t.test_sources.select("file_id", "after_src"), "after_src")
    return rows.select("file_id", "code_type", "name", "start", "end", F.md5("body").alias("digest"))


# sources behind an expression that is nested too deeply for any parser: the scanner lists them
@query("definitions_too_deep", r"""
select file_id, unnest(case when file_id % 3 = 0 then ['TestA', 'TestA.test_m', 'test_f', 'test_gone'] else ['TestA', 'TestA.test_m', 'test_f'] end) as path
from test_sources where file_id % 50 <> 0""")
def definitions_too_deep(t):
    from taskmine.functions.source_code import definitions as listed

    deep = F.concat(F.lit("x = "), F.repeat(F.lit("("), 10_000), F.lit("1"), F.repeat(F.lit(")"), 10_000), F.lit("\n"), "before_src")
    # a header without an end stays unreadable: neither definitions nor the lack of them are known
    return t.test_sources.select("file_id", F.explode(listed(deep)).alias("path"))


@query("code_normalize", r"""
select doc_id, coalesce((select string_agg(line, chr(10) order by pos) from (
    select trim(unnest(string_split(text, chr(10))), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(28), chr(29), chr(30), chr(31),
      chr(133), chr(160), chr(5760), chr(8192), chr(8193), chr(8194), chr(8195), chr(8196), chr(8197), chr(8198), chr(8199), chr(8200), chr(8201),
      chr(8202), chr(8232), chr(8233), chr(8239), chr(8287), chr(12288))) as line,
      generate_subscripts(string_split(text, chr(10)), 1) as pos) where line <> ''), '') as normalised from {documents}""")
def code_normalize(t):
    return t.documents.select("doc_id", text.normalised_code(F.col("text")).alias("normalised"))


# what changes between the two generated sources of a file
CHANGES = """
select instance_id, path, code_type, name, change_type from (
  select instance_id, path, 'function' as code_type, 'test_gone' as name, 'deleted' as change_type from test_sources where file_id % 3 = 0 and file_id % 50 <> 0
  union all select instance_id, path, 'function', 'test_new', 'added' from test_sources where file_id % 4 = 0
  union all select instance_id, path, 'function', 'test_cond', 'added' from test_sources where file_id % 5 = 0
  union all select instance_id, path, 'class', 'TestA', case when file_id % 50 = 0 then 'added' else 'modified' end from test_sources where file_id % 50 = 0 or p_size >= 25
  union all select instance_id, path, 'method', 'TestA.test_m', case when file_id % 50 = 0 then 'added' else 'modified' end from test_sources where file_id % 50 = 0 or p_size >= 25
  union all select instance_id, path, 'function', 'test_f', 'added' from test_sources where file_id % 50 = 0)"""
TESTS = f"select * from ({CHANGES}) where code_type <> 'class'"
SELECTORS = f"""
select instance_id, path, concat(path, '::', replace(name, '.', '::')) as selector from ({TESTS}) where change_type <> 'deleted'"""


def pairs(t):
    return t.sources_dealt().test_sources.select("instance_id", "path", "before_src", "after_src")


def tests(t):
    return cc.changed_tests(cc.code_changes(pairs(t)))


@query("code_changes", CHANGES)
def code_changes(t):
    return cc.code_changes(pairs(t)).select("instance_id", "path", "code_type", "name", "change_type")


@query("changed_tests", TESTS)
def changed_tests(t):
    rows = label.changed_tests(specs(t), t.test_sources)
    return rows.select("instance_id", "path", "code_type", "name", "change_type")


@query("test_selectors", SELECTORS)
def test_selectors(t):
    return cc.test_selectors(tests(t)).select("instance_id", "path", "selector")


# selectors of every changed file; a third of them fall into one run, which has to be batched
PICKS = """
select case when pr_id % 3 = 0 then 'hot' else concat('run-', cast(pr_id as string)) end as run, pr_id, pos,
  concat(filename, '::test_', cast(pr_id as string)) as selector from pr_files"""


@query("selector_batches", f"""
with numbered as (select *, row_number() over (partition by run order by pr_id, pos) - 1 as position,
  113 + sum(length(selector) + 1) over (partition by run) as chars from ({PICKS}))
select run, selector, position, case when chars > 100000 then position // 250 else 0 end as batch from numbered""")
def selector_batches(t):
    picks = t.sql(f"select * from ({PICKS})")
    block = F.floor(F.col("pr_id") / 1000)
    batches = cc.selector_batches(picks, ["run"], block, ["pr_id", "pos"], **d.BATCH_LIMITS)
    return batches.select("run", "selector", "position", "batch")


@query("specs_skipped", f"""
select distinct instance_id, true as processed from test_sources where instance_id not in (select instance_id from ({TESTS}))""")
def specs_skipped(t):
    return cc.without_changed_tests(specs(t), tests(t))


@query("change_report", f"""
select path, coalesce(nullif(array_to_string(list_filter([
    '🟢 Added:' || chr(10) || string_agg(line, chr(10) order by name, code_type) filter (change_type = 'added'),
    '🟡 Modified:' || chr(10) || string_agg(line, chr(10) order by name, code_type) filter (change_type = 'modified'),
    '🔴 Deleted:' || chr(10) || string_agg(line, chr(10) order by name, code_type) filter (change_type = 'deleted')],
  lambda x: x is not null), chr(10)), ''), 'No changes detected in classes or functions.') as report
from (select f.path, change_type, name, code_type, concat('  - ', code_type, ': ', name) as line
  from test_sources f left join ({CHANGES}) c on c.path = f.path) group by path""")
def change_report(t):
    return cc.change_report(cc.code_changes(pairs(t)), ["path"], t.test_sources)


METHOD_HINT = "concat('  pytest -v -k ', chr(39), 'test_file.py::TestA::test_m', chr(39), chr(10), '  pytest -v -k ', chr(39), 'TestA and test_m', chr(39))"


@query("test_change_report", f"""
select path, case when count(name) = 0 then 'No pytest-related test changes detected.' else array_to_string(list_filter([
    '🧪 Pytest test changes:', repeat('=', 40),
    '🟢 Added tests:' || chr(10) || string_agg(line, chr(10) order by name) filter (change_type = 'added'),
    '🟡 Modified tests:' || chr(10) || string_agg(line, chr(10) order by name) filter (change_type = 'modified'),
    '🔴 Deleted tests:' || chr(10) || string_agg(line, chr(10) order by name) filter (change_type = 'deleted'),
    chr(10) || '💡 Suggested pytest run commands:', repeat('-', 30),
    'Run specific test functions:' || chr(10) || string_agg('  pytest -v -k ' || name, chr(10) order by name) filter (code_type = 'function'),
    'Run specific test methods:' || chr(10) || string_agg({METHOD_HINT}, chr(10)) filter (code_type = 'method')],
  lambda x: x is not null), chr(10)) end as report
from (select f.path, change_type, name, code_type, concat('  - ', code_type, ': ', name) as line
  from test_sources f left join ({TESTS}) c on c.path = f.path) group by path""")
def test_change_report(t):
    return cc.test_report(tests(t), ["path"], t.test_sources)


@query("run_hints", f"""
select path, name, case when code_type = 'method' then concat('pytest -v ', path, '::', replace(name, '.', '::'))
  else concat('pytest -v -k ', name, ' ', path) end as command from ({TESTS})""")
def run_hints(t):
    return cc.run_hints(tests(t)).select("path", "name", "command")


# --- diffs -------------------------------------------------------------------

BODY = "concat('@@ -1 +1 @@', chr(10), '-old', pos, chr(10), '+new', additions)"
FILES = f"""
select repo, pr_number, cast(row_number() over (partition by repo, pr_number order by pos) - 1 as int) as piece, filename, status,
  {BODY} as patch_content, filename like 'tests/%' as is_test_file from pr_files"""


def parsed(t):
    return df.parse_diffs(t.diffs)


@query("diff_parse", f"select *, cast(null as varchar) as old_filename from ({FILES})")
def diff_parse(t):
    return parsed(t)


@query("diff_rebuild", f"""
select repo, pr_number, piece, concat('diff --git a/', filename, ' b/', filename, chr(10), case status
    when 'added' then concat('new file mode 100644', chr(10), 'index 0000000..1111111', chr(10), '--- /dev/null', chr(10), '+++ b/', filename)
    when 'removed' then concat('deleted file mode 100644', chr(10), 'index 1111111..0000000', chr(10), '--- a/', filename, chr(10), '+++ /dev/null')
    else concat('index 1111111..2222222 100644', chr(10), '--- a/', filename, chr(10), '+++ b/', filename) end,
  chr(10), patch_content, chr(10)) as diff from ({FILES})""")
def diff_rebuild(t):
    return df.rebuild(parsed(t)).select("repo", "pr_number", "piece", "diff")


RENAMED = """
select repo, pr_number, cast(row_number() over (partition by repo, pr_number order by pos) - 1 as int) as piece, filename, 'renamed' as status, old_filename,
  case when pure then '' else concat('@@ -1,2 +1,2 @@', chr(10), ' same', chr(10), '-one', chr(10), '+two', chr(10), '@@ -9 +9 @@ def f():', chr(10), '-x', chr(10),
    '+', additions, chr(10), chr(92), ' No newline at end of file') end as patch_content, filename like 'tests/%' as is_test_file from renames"""


@query("diff_parse_renames", RENAMED)
def diff_parse_renames(t):
    return df.parse_diffs(t.rename_diffs)


@query("diff_rebuild_renames", f"""
select repo, pr_number, piece, concat('diff --git a/', old_filename, ' b/', filename, chr(10), 'similarity index 100%', chr(10), 'rename from ', old_filename, chr(10),
  'rename to ', filename, chr(10), patch_content, chr(10)) as diff from ({RENAMED})""")
def diff_rebuild_renames(t):
    return df.rebuild(df.parse_diffs(t.rename_diffs)).select("repo", "pr_number", "piece", "diff")


@query("patch_files_read", f"""
select cast(pr_number as bigint) % 50 as part, filename, status, patch_content, count(*) as files from ({FILES}) group by all""")
def patch_files_read(t):
    """Diffs written to patch files, one after the other, and whole files read back."""
    target = f"{work_folder(t.spark)}/patches-{uuid.uuid4().hex}"
    t.diffs.select((F.col("pr_number").cast("bigint") % 50).alias("part"), "diff").repartition("part").write.partitionBy("part").text(target)
    read = landed.patch_files(t.spark, f"{target}/*/*.txt")
    parts = df.parse_diffs(read.select(F.regexp_extract("patch_path", r"/part=(\d+)/", 1).cast("bigint").alias("part"), "diff"))
    return parts.groupBy("part", "filename", "status", "patch_content").agg(F.count("*").alias("files"))


@query("is_test_patch", r"""
select repo, pos, path, regexp_matches(lower(path), 'test.*\.py$|.*test\.py$|.*_test\.py$|.*/test[s]?/.*\.py$|.*/testing/.*\.py$') as is_test
from repo_files""")
def is_test_patch(t):
    return t.repo_files.select("repo", "pos", "path", paths.is_test_patch(F.col("path")).alias("is_test"))


@query("patch_filter", "select repo, pr_number, pos, filename from pr_files where patch is not null and filename not like 'tests/%'")
def patch_filter(t):
    kept = df.filter_patches(df.usable_changes(t.pr_files), include_test=False)
    return kept.select("repo", "pr_number", "pos", "filename")


@query("patch_tally", """
select repo, pr_number, count(*) as total_files_num, count(*) filter (additions >= 10) as applied_files_num,
  coalesce(string_agg(filename, ', ' order by pos) filter (additions >= 10), '') as applied_files
from pr_files where filename not like 'tests/%' group by repo, pr_number""")
def patch_tally(t):
    # a file applies when the landed outcome says so; here: when it adds at least ten lines
    source = df.filter_patches(parsed(t), include_test=False)
    outcome = t.pr_files.select("repo", "pr_number", "filename", (F.col("additions") >= 10).alias("applied"))
    attempts = source.join(outcome, ["repo", "pr_number", "filename"], "left")
    tally = df.application_tally(attempts, ["repo", "pr_number"])
    return tally.withColumn("applied_files", F.array_join("applied_files", ", "))


@query("jsonl_patches", """
select o_orderkey as seq, concat('org__repo-', o_custkey) as instance_id, concat('patch ', o_orderkey) as model_patch
from {orders} where o_orderkey % 41 <> 0 and o_orderkey % 6 <> 0""")
def jsonl_patches(t):
    from taskmine.sources import landed

    return landed.agent_patch_rows(t.agent_patch_lines)
