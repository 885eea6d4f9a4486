"""Domain tables derived from the given tables, in SQL that Spark and DuckDB both run.

``{orders}`` and the like stand for the given tables; a view may use other views by
name. Integer and string arithmetic only, order columns explicit. A log holds what
one user did in ten days before or after a patch, so labels do not change as other
events are added; ``test_results_of_lines`` reads the same logs line by line, as
logs too long for a cell are. A diff holds the at most seven line numbers of an order.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from taskmine import ship
from taskmine.sources.stages import staged

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def repo(index: str) -> str:
    """A repository name as SQL; sixty repositories share all releases and pull requests."""
    return f"concat('org', cast(({index}) % 7 as string), '/repo', cast({index} as string))"


_PR_REPO = repo("cast(floor(o_orderkey / 4.0) as bigint) % 60")
_FILE_REPO = repo("cast(floor(l_orderkey / 4.0) as bigint) % 60")

VIEWS = {
    # repository listing, details, crawl lists
    "repo_listing": f"""
select {repo('c_custkey')} as full_name,
  cast(floor(c_acctbal) as bigint) as stargazers_count, c_custkey as api_pos,
  cast(c_nationkey * 100 as bigint) as size, c_mktsegment as segment,
  case when c_custkey % 11 = 0 then null else concat_ws(',', 'python',
    case when c_custkey % 6 = 0 then 'tutorial' when c_custkey % 13 = 0 then 'books' end, lower(c_mktsegment)) end as topics_csv,
  case when c_custkey % 3 = 0 then null else 'Python' end as language,
  case when c_custkey % 5 = 0 then null else c_custkey % 2 = 0 end as archived,
  case when c_custkey % 4 <> 0 then concat('3.', cast(8 + c_custkey % 5 as string)) end as python_version
from {{customer}}""",
    "crawl_documents": f"""
select c_custkey as doc_no, case when c_custkey % 50 = 0 then 'oops' else concat('{{"cat', cast(c_custkey % 5 as string),
  '":["', {repo('c_custkey')}, '"],"more":["', {repo('(c_custkey + 1)')}, '","', {repo('c_custkey')}, '"]}}') end as document
from {{customer}}""",
    # releases
    "releases": f"""
select {repo('o_orderkey % 60')} as repo, o_orderkey as api_pos,
  concat(case o_orderkey % 7 when 0 then 'v' when 1 then 'release-' when 2 then 'version ' when 3 then 'Ver_'
      when 4 then '' when 5 then 'rel.v' else 'source-' end,
    case when o_orderkey % 31 = 0 then 'nightly' else concat(cast(o_orderkey % 4 as string),
      case o_orderkey % 4 when 0 then '.' when 1 then '-' when 2 then '_' else ' . ' end,
      cast(o_orderkey % 13 as string),
      case when o_orderkey % 5 = 0 then '' else concat('.', cast(o_orderkey % 29 as string)) end,
      case when o_orderkey % 9 = 0 then 'rc1' when o_orderkey % 10 = 0 then '-beta' else '' end) end) as tag_name,
  case when o_orderkey % 8 = 0 then null else concat('Release ', cast(o_orderkey as string)) end as name,
  case o_orderpriority when '5-LOW' then 'dependabot[bot]' when '4-NOT SPECIFIED' then null else 'dev' end as author_login,
  concat(chr(10), '  ', repeat('x', cast(o_orderkey % 120 as int)), chr(9), chr(10)) as body,
  case when o_orderkey % 17 = 0 then null when o_orderkey % 19 = 0 then 'not-a-date'
    when o_orderkey % 23 = 0 then concat(cast(cast(o_orderdate as date) as string), 'T00:00:00')
    else concat(cast(cast(o_orderdate as date) as string), 'T00:00:00Z') end as published_at,
  'main' as target_commitish
from {{orders}}""",
    # repository files
    "repo_files": f"""
select {repo('p_partkey % 60')} as repo, p_partkey as pos,
  case p_partkey % 13 when 0 then 'README.md' when 1 then 'tests/test_a.py' when 2 then 'docs/readme.rst'
    when 3 then 'src/mod.py' when 4 then concat('.github/workflows/ci', cast(p_partkey % 3 as string), '.yml') when 5 then 'contest/data.txt'
    when 6 then 'test_root.py' when 7 then 'unit_tests/a/b.py' when 8 then 'build/tests/x.py'
    when 9 then 'lib/tests/y.py' when 10 then 'latest_util.py' when 11 then 'readme' else 'Spec/conftest.py' end as path,
  case when p_partkey % 17 = 0 then '' else concat('https://raw/', cast(p_partkey as string)) end as download_url,
  concat('# ', p_name) as content
from {{part}}""",
    # listings of which some have tests in one place only, and some in none that counts
    "sparse_files": """
select repo, pos, path, download_url, content from repo_files where case length(repo) % 2 + cast(right(repo, 1) as int) % 4
  when 0 then path in ('README.md', 'contest/data.txt', 'latest_util.py', 'build/tests/x.py') when 1 then path in ('unit_tests/a/b.py', 'src/mod.py')
  when 2 then path in ('lib/tests/y.py', 'contest/data.txt', 'readme') else path in ('test_root.py', 'docs/readme.rst') end""",
    # categorised changes
    "release_answers": f"""
select {_PR_REPO} as repo, o_orderkey as release_pos, concat('v', cast(o_orderkey as string)) as tag_name,
  case when o_orderkey % 29 = 0 then 'oops' else concat('{{"new_features":[{{"description":"f', cast(o_orderkey % 50 as string),
    '","pr_ids":["', cast(o_orderkey as string), '","#', cast(o_orderkey % 9 as string), '"',
    case when o_orderkey % 4 < 3 then concat(',', cast(o_orderkey + 1 as string)) else '' end, ']}}',
    case when o_orderkey % 3 = 0 then ',{{"pr_ids":[]}}' else '' end, '],"improvements":[',
    case when o_orderkey % 2 = 0 then '{{"description":"i","pr_ids":["7"]}}' else '' end, '],"bug_fixes":[',
    case when o_orderkey % 5 = 0 then '{{"description":"b1"}},{{"description":"b2","pr_ids":["8"]}}' else '' end, ']}}') end as response, o_orderpriority as priority
from {{orders}}""",
    # pull requests, commits, files, contents
    "pull_requests": f"""
select {_PR_REPO} as repo, cast(o_orderkey as string) as pr_number, concat('PR ', cast(o_orderkey as string)) as title,
  case when o_orderkey % 7 = 0 then null else o_orderpriority end as body,
  case o_orderstatus when 'F' then 'closed' else 'open' end as state, o_orderstatus = 'F' as merged,
  concat('b', cast(o_orderkey as string)) as base_sha, concat('h', cast(o_orderkey as string)) as head_sha,
  o_orderpriority as priority, cast(cast(o_orderdate as date) as string) as day
from {{orders}}""",
    "commits": """
select repo, base_sha as sha, 'base' as message, concat(day, 'T00:00:00Z') as date, 'dev' as author
from pull_requests where priority <> '5-LOW'
union all
select repo, head_sha, 'head', concat(day, 'T12:00:00Z'), null from pull_requests where priority <> '1-URGENT'""",
    "pr_files": f"""
select {_FILE_REPO} as repo, cast(l_orderkey as string) as pr_number, cast(l_linenumber as int) as pos,
  case min(l_suppkey) % 6 when 0 then concat('tests/test_', cast(min(l_partkey) % 40 as string), '_', cast(l_linenumber as string), '.py')
    when 1 then concat('docs/note', cast(l_linenumber as string), '.md') else concat('src/m', cast(min(l_partkey) % 40 as string), '_', cast(l_linenumber as string), '.py') end as filename,
  case min(case l_returnflag when 'A' then 0 when 'R' then 2 else 1 end) when 0 then 'added' when 2 then 'removed' else 'modified' end as status,
  cast(floor(min(l_quantity)) as bigint) as additions, cast(l_linenumber * 2 as bigint) as deletions,
  cast(floor(min(l_quantity)) as bigint) + l_linenumber * 2 as changes,
  case when min(l_partkey) % 8 = 0 then null else concat('@@ -1 +1 @@', chr(10), '+', repeat('p', cast(min(l_partkey) % 1200 as int))) end as patch,
  l_orderkey as pr_id
from {{lineitem}} group by l_orderkey, l_linenumber""",
    "file_contents": """
select repo, filename as path, concat('b', pr_number) as ref, case
    when status = 'removed' then case when pr_id % 6 = 0 then concat('def gone():', chr(10), '    pass', chr(10)) else concat('X = 1', chr(10)) end
    else concat('def f():', chr(10), '    return 1', chr(10)) end as content
from pr_files where filename like 'src/%' and status <> 'added'
union all
select repo, filename, concat('h', pr_number), case
    when status = 'added' then case when pr_id % 9 = 0 then concat('class C:', chr(10), '    pass', chr(10)) else concat('if 1:', chr(10), '    def hidden(): pass', chr(10)) end
    else concat('def f():', chr(10), '    return ', cast(additions as string), chr(10),
      case when pr_id % 5 = 0 then concat('async def g():', chr(10), '    pass', chr(10)) else '' end,
      case when pr_id % 8 = 0 then concat('def h():', chr(10), '    pass', chr(10)) else '' end) end
from pr_files where filename like 'src/%' and status <> 'removed' and pr_id % 11 <> 0""",
    # test sources before and after a test patch
    "test_sources": """
select concat('inst-', cast(cast(floor(p_partkey / 2.0) as bigint) as string)) as instance_id,
  p_partkey as file_id, concat('tests/test_', cast(p_partkey as string), '.py') as path,
  concat('class TestA:', chr(10), '    def test_m(self):', chr(10), '        return ', cast(p_size as string), chr(10),
    'def test_f():', chr(10), '    return 1', chr(10),
    case when p_partkey % 3 = 0 then concat('def test_gone():', chr(10), '    pass', chr(10)) else '' end,
    case when p_partkey % 50 = 0 then 'def (' else '' end) as before_src,
  concat('class TestA:', chr(10), '    def test_m(self):', chr(10), '        return ', cast(p_size % 25 as string), chr(10),
    'def test_f():', chr(10), '      return 1', chr(10),
    case when p_partkey % 4 = 0 then concat('async def test_new():', chr(10), '    pass', chr(10)) else '' end,
    case when p_partkey % 5 = 0 then concat('if True:', chr(10), '    def test_cond():', chr(10), '        pass', chr(10)) else '' end) as after_src,
  p_size, p_brand
from {part}""",
    # test logs: one before and one after the patch per instance
    "log_events": """
select concat('u', cast(user_id as string), '-', cast(cast(floor(extract(day from ts) / 10.0) as bigint) as string)) as instance_id,
  case when event_id % 5 < 2 then 'pre' else 'post' end as phase, cast(event_id % 2 as bigint) as batch, event_id,
  case event_type when 'error' then 'FAILED' when 'signup' then 'SKIPPED' when 'purchase' then 'ERROR' else 'PASSED' end as status,
  concat('tests/t', cast(event_id % 3 as string), '.py::test_', cast(event_id % 41 as string)) as base,
  concat('tests/t', cast(event_id % 3 as string), '.py::test_', cast(event_id % 41 as string), '[', cast(event_id % 4 as string), ']') as test_path,
  case when event_type = 'error' then ' - boom - x' else '' end as message
from {events}""",
    "test_logs": """
select instance_id, phase, concat('=== test session ===', chr(10), chr(27), '[36m', 'short test summary info', chr(27), '[0m', chr(10),
    listagg(concat(status, ' ', test_path, message), chr(10)) within group (order by event_id), chr(10), '1 passed in 0.1s') as log
from log_events group by instance_id, phase""",
    "batch_logs": """
select instance_id, phase, batch, concat('short test summary info', chr(10),
    listagg(concat(status, ' ', test_path, message), chr(10)) within group (order by event_id)) as log
from log_events group by instance_id, phase, batch""",
    # four runs of an instance in two batches each: the two labels' runs disagree on some tests, some logs are empty and some are missing
    "run_events": """
select instance_id, phase, 'FAIL_TO_PASS' as label, batch, event_id, base, test_path, status, message from log_events
union all
select instance_id, phase, 'PASS_TO_PASS' as label, cast(event_id % 7 % 2 as bigint) as batch, event_id, base, test_path,
  case when event_id % 7 = 0 then 'FAILED' else status end as status, message from log_events""",
    "run_logs": """
select instance_id, label, phase, batch, case when instance_id like 'u%7-_' and batch = 0 and phase = 'post' then 'collected 0 items' else
    concat('short test summary info', chr(10), listagg(concat(status, ' ', test_path, message), chr(10)) within group (order by event_id)) end as log
from run_events where not (instance_id like 'u%3-_' and label = 'FAIL_TO_PASS' and phase = 'post' and batch = 1)
group by instance_id, label, phase, batch""",
    "log_last": """
select instance_id, phase, base, test_path, max_by(status, event_id) as status
from log_events group by instance_id, phase, base, test_path""",
    "log_base": """
select instance_id, phase, base, case when bool_or(status in ('FAILED', 'ERROR')) then 'FAILED'
    when bool_or(status = 'PASSED') then 'PASSED' else 'SKIPPED' end as status
from log_last group by instance_id, phase, base""",
    # tests asked for: an exact parameter, a whole test, and one that no log has
    "asked_tests": """
select distinct instance_id, phase, test_path as test from log_events where status <> 'PASSED'
union
select distinct instance_id, phase, base from log_events
union
select distinct instance_id, phase, 'tests/none.py::test_x' from log_events""",
    # diffs and agent patches
    "diffs": """
select repo, pr_number, listagg(concat('diff --git a/', filename, ' b/', filename, chr(10),
    case status when 'added' then concat('new file mode 100644', chr(10)) when 'removed' then concat('deleted file mode 100644', chr(10)) else '' end,
    'index 1..2', chr(10), '@@ -1 +1 @@', chr(10), '-old', cast(pos as string), chr(10), '+new', cast(additions as string)), chr(10)) within group (order by pos) as diff
from pr_files group by repo, pr_number""",
    "renames": """
select repo, pr_number, pos, filename, concat('old/', cast(pos as string), ' ', filename) as old_filename, additions, pr_id % 3 = 0 as pure from pr_files""",
    "rename_diffs": """
select repo, pr_number, listagg(concat('diff --git a/', old_filename, ' b/', filename, chr(10), 'similarity index 90%', chr(10), 'rename from ', old_filename, chr(10),
    'rename to ', filename, chr(10), case when pure then '' else concat('index 1..2 100644', chr(10), '--- a/', old_filename, chr(10), '+++ b/', filename, chr(10),
    '@@ -1,2 +1,2 @@', chr(10), ' same', chr(10), '-one', chr(10), '+two', chr(10), '@@ -9 +9 @@ def f():', chr(10), '-x', chr(10), '+', cast(additions as string), chr(10),
    chr(92), ' No newline at end of file') end), chr(10)) within group (order by pos) as diff
from renames group by repo, pr_number""",
    "agent_logs": """
select event_id, case when event_id % 7 = 0 then 'no summary' else concat('x', chr(10), chr(27), '[1mExecution Summary', chr(27), '[0m', chr(10),
    '│ Steps │ 3 │', chr(10), case when event_id % 5 = 0 then '' else concat('│ Total Tokens   │ ', cast(event_id * 13 as string), ' │') end) end as log
from {events}""",
    "agent_patch_lines": """
select o_orderkey as seq, case when o_orderkey % 41 = 0 then '{"instance_id": oops' else concat('{"instance_id":"org__repo-',
    cast(o_custkey as string), '","model_patch":"', case when o_orderkey % 6 = 0 then '' else concat('patch ', cast(o_orderkey as string)) end, '"}') end as line
from {orders}""",
    # agent results, specs
    "eval_results": """
select o_orderkey as seq, case when o_orderkey % 2 = 0 then 'agent-a' else 'agent-b' end as agent, 'm' as model,
  case when o_orderkey % 37 = 0 then null when o_orderkey % 41 = 0 then '' else concat('org__repo-', cast(o_custkey % 500 as string)) end as instance_id,
  'a, b' as expected_f2p, case when o_orderstatus = 'F' then 'a, b' else 'a' end as passed_f2p,
  case when o_orderkey % 3 = 0 then '' else 'c' end as expected_p2p, case when o_orderkey % 4 = 0 then '' else 'c, d' end as passed_p2p
from {orders}""",
    "specs": """
select concat('org/repo', cast(o_custkey % 60 as string)) as repo, o_orderkey as seq,
  concat('org__repo-', cast(o_orderkey as string)) as instance_id, o_orderkey % 3 = 0 as processed,
  case o_orderkey % 4 when 0 then null when 1 then '' else 't.py::test_a' end as fail_to_pass,
  case o_orderkey % 5 when 0 then 't.py::test_b, t.py::test_c' else null end as pass_to_pass, o_orderpriority as priority
from {orders}""",
}


def with_views(sql: str, views: dict[str, str] = VIEWS) -> str:
    """``sql`` behind a WITH clause of the views it uses, directly or through others."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in views:
            if name not in needed and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                visit(views[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = ",\n".join(f"{name} as ({views[name]})" for name in needed)
    own = sql.strip()
    glue = ",\n" + own[5:] if own.lower().startswith("with ") else "\n" + own
    return f"with {views}{glue}"


def _placed(sql: str, place) -> str:
    return re.sub(r"\{(%s)\}" % "|".join(TABLES), lambda found: place(found.group(1)), sql)


def duckdb_sql(sql: str) -> str:
    """The text for DuckDB, where the tables are views of their own name."""
    return _placed(with_views(sql), lambda name: name).replace(") within group (", " ")


class Tables:
    """The given tables and the views on them, by attribute."""

    def __init__(self, spark: SparkSession, folder: str, views: dict[str, str] = VIEWS):
        ship(spark)
        self.spark, self.folder, self.views = spark, folder, views

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in self.views:
            return self.sql(f"select * from {name}")
        raise AttributeError(name)

    def files_landed(self) -> Tables:
        """These tables with the groups of ``pr_files`` written once, for queries that start from it several times.

        What is written are the aggregates of the view's text; its columns are still made where they
        are read, so no text is written. Runs a job when called.
        """
        view = self.views["pr_files"]
        columns, grouping = view.rsplit("\nfrom ", 1)
        table, keys = grouping.split(" group by ")
        values = {one: f"_value_{n}" for n, one in enumerate(dict.fromkeys(re.findall(r"min\([^()]*\)", columns)))}
        named = ", ".join(f"{one} as {name}" for one, name in values.items())
        groups = staged(self.sql(f"select {keys}, {named} from {table} group by {keys}"), "pr-file-groups")
        landed = f"pr_file_groups_{uuid.uuid4().hex}"
        groups.createTempView(landed)
        for one, name in values.items():
            columns = columns.replace(one, name)
        return Tables(self.spark, self.folder, {**self.views, "pr_files": f"{columns}\nfrom {landed}"})

    def files_dealt(self) -> Tables:
        """These tables with the rows behind ``pr_files`` dealt by pull request before they are grouped.

        The files of a pull request then stand in one task, and what gathers them needs no shuffle of its own.
        """
        columns, grouping = self.views["pr_files"].rsplit("\nfrom ", 1)
        table, keys = grouping.split(" group by ")
        number = "cast(l_orderkey as string)"
        columns = columns.replace(f"{_FILE_REPO} as repo", "_repo as repo").replace(f"{number} as pr_number", "_number as pr_number")
        # dealt by expressions, so that the names themselves are made after the move
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = f"pr_file_rows_{uuid.uuid4().hex}"
        self.sql(f"select * from {table}").repartition(partitions, F.expr(_FILE_REPO), F.expr(number)).createTempView(dealt)
        rows = f"select *, {_FILE_REPO} as _repo, {number} as _number from {dealt}"
        return Tables(self.spark, self.folder, {**self.views, "pr_files": f"{columns}\nfrom ({rows}) group by _repo, _number, {keys}"})

    def sources_dealt(self) -> Tables:
        """These tables with the rows behind ``test_sources`` dealt before its texts are made.

        The given file is one task's; it would otherwise hold the texts of all its rows for the next shuffle.
        """
        columns, table = self.views["test_sources"].rsplit("\nfrom ", 1)
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = f"test_source_rows_{uuid.uuid4().hex}"
        self.sql(f"select * from {table}").repartition(partitions, "p_partkey").createTempView(dealt)
        return Tables(self.spark, self.folder, {**self.views, "test_sources": f"{columns}\nfrom {dealt}"})

    def sql(self, sql: str) -> DataFrame:
        return self.spark.sql(_placed(with_views(sql, self.views), lambda name: f"parquet.`{self.folder}/{name}.parquet`"))
