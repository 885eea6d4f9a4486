"""Queries on test logs, labels, agent results and keyed stores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.registry import query
from taskmine import defaults as d
from taskmine.functions import text
from taskmine.operators import labels as lb, scoring as sc, specs as sp, testlogs as tl
from taskmine.plans import collect, label, score
from taskmine.sources import landed
from taskmine.sources.stages import staged
from taskmine.sources.store import KeyedStore, work_folder
from taskmine.streaming import incremental as inc

RUN = ["instance_id", "phase"]

SIDES = """
select instance_id, base as test, max(status) filter (phase = 'pre') as pre, max(status) filter (phase = 'post') as post
from log_base group by instance_id, base"""
LABELS = f"""
select instance_id, case pre when 'FAILED' then 'FAIL_TO_PASS' else 'PASS_TO_PASS' end as label, test
from ({SIDES}) where post = 'PASSED' and pre in ('FAILED', 'PASSED')"""


@query("f2p_p2p", f"""
select i.instance_id, string_agg(test, ', ' order by test) filter (label = 'FAIL_TO_PASS') as fail_to_pass,
  string_agg(test, ', ' order by test) filter (label = 'PASS_TO_PASS') as pass_to_pass
from (select distinct instance_id from log_events) i left join ({LABELS}) l using (instance_id) group by i.instance_id""")
def f2p_p2p(t):
    return lb.rendered(t.test_logs.select("instance_id"), lb.labels_of_runs(t.test_logs))


@query("label_rows", LABELS)
def label_rows(t):
    return lb.labels_of_runs(t.test_logs)


@query("ansi_strip", """
select instance_id, phase, concat('=== test session ===', chr(10), 'short test summary info', chr(10),
  string_agg(concat(status, ' ', test_path, message), chr(10) order by event_id), chr(10), '1 passed in 0.1s') as log
from log_events group by instance_id, phase""")
def ansi_strip(t):
    return t.test_logs.withColumn("log", text.without_colours(F.col("log")))


def results(t):
    return tl.test_results(t.test_logs, RUN)


@query("test_results", "select instance_id, phase, test_path, status from log_last")
def test_results(t):
    return results(t)


@query("test_results_of_lines", "select instance_id, phase, test_path, status from log_last")
def test_results_of_lines(t):
    # no cell ever holds a whole log; what stands before the summary does not count
    lines = t.sql("""
select instance_id, phase, event_id + 2 as line_no, concat(status, ' ', test_path, message) as line from log_events
union all select distinct instance_id, phase, 1, 'short test summary info' from log_events
union all select distinct instance_id, phase, 0, concat('FAILED ', base, ' - before the summary') from log_events""")
    return tl.results_of_lines(lines, RUN)


@query("test_base_status", "select instance_id, phase, base, status from log_base")
def test_base_status(t):
    return tl.base_status(results(t), RUN)


def summary_of(view: str) -> str:
    return f"""
select r.instance_id, r.phase, s.status, cast(count(l.status) as bigint) as tests
from (select distinct instance_id, phase from log_events) r
cross join (select unnest(['PASSED', 'FAILED', 'SKIPPED', 'ERROR', 'UNKNOWN']) as status) s
left join {view} l on l.instance_id = r.instance_id and l.phase = r.phase and l.status = s.status
group by r.instance_id, r.phase, s.status"""


@query("status_summary", summary_of("log_last"))
def status_summary(t):
    return tl.status_summary(results(t), t.test_logs, RUN)


@query("status_summary_agg", summary_of("log_base"))
def status_summary_agg(t):
    return tl.status_summary(tl.base_status(results(t), RUN), t.test_logs, RUN)


QUERIED = """
select a.instance_id, a.phase, a.test, coalesce(e.status, b.status, 'UNKNOWN') as status from asked_tests a
left join log_last e on e.instance_id = a.instance_id and e.phase = a.phase and e.test_path = a.test
left join log_base b on b.instance_id = a.instance_id and b.phase = a.phase and b.base = split_part(a.test, '[', 1)"""


def queried(t):
    return tl.query_tests(t.asked_tests, results(t), RUN)


@query("query_tests", QUERIED)
def query_tests(t):
    return queried(t)


@query("check_all_status", f"""
select instance_id, phase, bool_and(status in ('PASSED', 'SKIPPED', 'UNKNOWN')) as all_expected,
  string_agg(concat(test, '=', status), ', ' order by test) as actual from ({QUERIED}) group by instance_id, phase""")
def check_all_status(t):
    checked = tl.check_all(queried(t), RUN, ["PASSED", "SKIPPED", "UNKNOWN"])
    entries = F.array_sort(F.transform(F.map_entries("actual"), lambda one: F.concat(one["key"], F.lit("="), one["value"])))
    by_test = F.array_sort(F.map_entries("actual"))
    shown = F.transform(by_test, lambda one: F.concat(one["key"], F.lit("="), one["value"]))
    return checked.select(*RUN, "all_expected", F.array_join(shown, ", ").alias("actual"))


@query("find_tests_pattern", "select instance_id, phase, test_path, status from log_last where regexp_matches(test_path, 't1.py::test_1[0-9]')")
def find_tests_pattern(t):
    return tl.find_by_pattern(results(t), r"t1.py::test_1\d")


@query("find_tests_base", "select instance_id, phase, test_path, status from log_last where contains(base, 'test_4')")
def find_tests_base(t):
    return tl.find_by_base_name(results(t), "test_4")


@query("tests_by_status", "select instance_id, phase, base, status from log_base where status = 'PASSED'")
def tests_by_status(t):
    return tl.tests_by_status(results(t), RUN)


BATCH = """
select distinct instance_id, phase, test from (
  select instance_id, phase, batch, base as test, status from (
    select instance_id, phase, batch, base, case when bool_or(status in ('FAILED', 'ERROR')) then 'FAILED'
      when bool_or(status = 'PASSED') then 'PASSED' else 'SKIPPED' end as status
    from (select instance_id, phase, batch, base, test_path, max_by(status, event_id) as status from log_events group by all)
    group by all)) where status = 'PASSED'"""


@query("batch_results_union", BATCH)
def batch_results_union(t):
    asked = t.log_events.select(*RUN, "batch", F.col("base").alias("test")).distinct()
    return tl.matched_in_batches(asked, t.batch_logs, RUN)


@query("batch_logs_joined", """
select instance_id, phase, string_agg(log, chr(10) order by batch) as log from (
  select instance_id, phase, batch, concat('short test summary info', chr(10), string_agg(concat(status, ' ', test_path, message), chr(10) order by event_id)) as log
  from log_events group by instance_id, phase, batch) group by instance_id, phase""")
def batch_logs_joined(t):
    return tl.joined_batch_logs(t.batch_logs, RUN)


def folder(t, name: str) -> str:
    return f"{work_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("test_log_store", """
select concat('org/', split_part(instance_id, '-', 1)) as repo, phase, md5(concat('=== test session ===', chr(10), chr(27), '[36m', 'short test summary info', chr(27), '[0m', chr(10),
  string_agg(concat(status, ' ', test_path, message), chr(10) order by event_id), chr(10), '1 passed in 0.1s')) as digest
from log_events group by instance_id, phase""")
def test_log_store(t):
    logs = t.test_logs.withColumn("repo", F.concat(F.lit("org/"), F.substring_index("instance_id", "-", 1)))
    target = folder(t, "test-logs")
    run = lambda n, log: logs.withColumn("log", log).withColumn("run_seq", F.lit(n).cast("bigint"))
    landed.write_test_logs(run(0, F.lit("old")), target)
    for _ in range(2):  # a repeated write replaces its own run
        landed.write_test_logs(run(1, F.col("log")), target)
    return landed.latest_test_logs(landed.read_test_logs(t.spark, target)).select("repo", "phase", F.md5("log").alias("digest"))


SELECTED = "select * from (select *, row_number() over (partition by repo order by seq) as n from specs) where n <= 100"


@query("spec_selection", f"select repo, seq, instance_id from ({SELECTED}) where not processed")
def spec_selection(t):
    return sp.select_for_labelling(t.specs, d.MAX_SPECS_PER_REPO).select("repo", "seq", "instance_id")


@query("spec_selection_test_only", f"select repo, seq, instance_id from ({SELECTED}) where fail_to_pass is not null and pass_to_pass is null")
def spec_selection_test_only(t):
    return sp.select_for_labelling(t.specs, d.MAX_SPECS_PER_REPO, test_only=True).select("repo", "seq", "instance_id")


TODO = f"""
select s.instance_id, a.agent, 'm' as model from ({SELECTED}) s cross join (select unnest(['agent-a', 'agent-b']) as agent) a
where fail_to_pass <> '' and not exists (select 1 from eval_results e where e.instance_id = s.instance_id and e.agent = a.agent)"""


AGENTS = [("agent-a", "m"), ("agent-b", "m"), ("agent-c", "m")]


def todo(t):
    return sp.select_for_evaluation(t.specs, t.eval_results, AGENTS, ["agent-a", "agent-b"], d.MAX_SPECS_PER_REPO)


@query("eval_selection", TODO)
def eval_selection(t):
    return todo(t).select("instance_id", "agent", "model")


FIRST_PATCH = """
select concat('org__repo-', o_custkey) as instance_id, concat('patch ', min(o_orderkey)) as model_patch
from {orders} where o_orderkey % 41 <> 0 and o_orderkey % 6 <> 0 group by o_custkey"""


@query("eval_patch_join", f"""
select s.instance_id, p.model_patch, case when p.model_patch is null then 'Agent failed to generate valid patches' end as error
from specs s left join ({FIRST_PATCH}) p on p.instance_id = s.instance_id""")
def eval_patch_join(t):
    patches = landed.agent_patch_rows(t.agent_patch_lines)
    return sc.with_patches(t.specs, patches).select("instance_id", "model_patch", "error")


@query("agent_tokens", """
select event_id, case when event_id % 7 <> 0 and event_id % 5 <> 0 then event_id * 13 end as total_tokens from {events}""")
def agent_tokens(t):
    return t.agent_logs.select("event_id", sc.total_tokens(F.col("log")).alias("total_tokens"))


@query("eval_outcome", """
select seq, passed_f2p = 'a, b' as success_f2p, expected_p2p = '' or passed_p2p <> '' as success_p2p,
  passed_f2p = 'a, b' and (expected_p2p = '' or passed_p2p <> '') as success from eval_results""")
def eval_outcome(t):
    listed = t.eval_results.withColumns({name: lb.label_list(F.col(name)) for name in ("passed_f2p", "passed_p2p")})
    return sc.outcomes(listed).select("seq", "success_f2p", "success_p2p", "success")


# stored rows (passed_f2p = 'a') come first whatever their number, then new ones
KEPT = """
with kept as (select *, row_number() over (partition by {key} order by case when passed_f2p = 'a' then 0 else 1 end, seq) as n
  from eval_results where instance_id <> '')
select seq, agent, instance_id from eval_results where coalesce(instance_id, '') = ''
union all select seq, agent, instance_id from kept where n = 1"""


@query("eval_append_dedup", KEPT.replace("{key}", "agent, instance_id"))
def eval_append_dedup(t):
    old = t.eval_results.where("passed_f2p = 'a'")
    new = t.eval_results.where("passed_f2p <> 'a'")
    return sc.append_results(old, new.drop("expected_p2p"), ["seq"]).select("seq", "agent", "instance_id")


@query("eval_append_dedup_compat", KEPT.replace("{key}", "instance_id"))
def eval_append_dedup_compat(t):
    old = t.eval_results.where("passed_f2p = 'a'")
    kept = sc.append_results(old, t.eval_results.where("passed_f2p <> 'a'"), ["seq"], compat=True)
    return kept.select("seq", "agent", "instance_id")


# --- keyed stores -------------------------------------------------------------

LAST = """
select instance_id, max(seq) as seq, arg_max(passed_p2p, seq) as passed_p2p from eval_results where instance_id <> '' group by instance_id"""
CACHE = "instance_id string, seq bigint, passed_p2p string"


def keyed(t):
    return t.eval_results.where("instance_id <> ''").select("instance_id", "seq", "passed_p2p")


@query("cache_scan", LAST)
def cache_scan(t):
    store = KeyedStore(t.spark, folder(t, "cache"), CACHE, ["instance_id"])
    store.add(keyed(t), 0, ["seq"])
    missing = KeyedStore(t.spark, folder(t, "missing"), CACHE, ["instance_id"])
    return store.read().unionByName(missing.read())


@query("cache_upsert", LAST)
def cache_upsert(t):
    store = KeyedStore(t.spark, folder(t, "cache"), CACHE, ["instance_id"])
    middle = F.lit(7000)
    store.add(keyed(t).where(F.col("seq") < middle), 0, ["seq"])
    store.add(keyed(t).where(F.col("seq") >= middle), 1, ["seq"])
    return store.read()


@query("cache_miss_requests", """
select repo, tag_name from releases r where not exists (
  select 1 from releases c where c.repo = r.repo and c.tag_name = r.tag_name and c.author_login = 'dev')""")
def cache_miss_requests(t):
    analysed = t.releases.where("author_login = 'dev'").select("repo", "tag_name")
    return collect.cache_misses(t.releases.select("repo", "tag_name"), analysed)


@query("cache_hits", """
select repo, tag_name, case when bool_or(author_login = 'dev') then 'stored' else 'new' end as origin from releases group by repo, tag_name""")
def cache_hits(t):
    stored = t.releases.where("author_login = 'dev'").select("repo", "tag_name", F.lit("stored").alias("origin"))
    return collect.with_cached(t.releases.select("repo", "tag_name", F.lit("new").alias("origin")), stored)


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def land_events(t, target: str, parts: list[int]) -> None:
    """Append some quarters of the events to a folder, one after the other, in the order given."""
    events = t.spark.read.parquet(f"{t.folder}/events.parquet").select(*[part.split(" ")[0] for part in EVENTS.split(", ")])
    for part in parts:
        events.where(F.col("user_id") * 7 % 4 == part if part % 2 else F.col("event_id") % 2 == part // 2).write.mode("append").parquet(target)


def event_stream(t, source: str):
    return t.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)


def forget_last_commit(t, checkpoint: str) -> None:
    """What a failure between a batch's write and its commit leaves: the batch runs again."""
    path = t.spark._jvm.org.apache.hadoop.fs.Path
    commits = path(f"{checkpoint}/commits")
    fs = commits.getFileSystem(t.spark._jsc.hadoopConfiguration())
    numbers = [int(name) for name in (status.getPath().getName() for status in fs.listStatus(commits)) if name.isdigit()]
    fs.delete(path(f"{checkpoint}/commits/{max(numbers)}"), False)


def streamed(t, store: KeyedStore, start, name: str):
    """Run a stream over events that come in several files, overlapping and out of order, with a batch repeated in the middle."""
    source, checkpoint = folder(t, f"{name}-in"), folder(t, f"{name}-checkpoint")
    land_events(t, source, [3, 2])
    start(event_stream(t, source), store, checkpoint).awaitTermination()
    forget_last_commit(t, checkpoint)
    land_events(t, source, [0, 1])
    start(event_stream(t, source), store, checkpoint).awaitTermination()
    return store.read()


@query("stream_upsert", """
select user_id, arg_max(event_id, event_id) as event_id, arg_max(event_type, event_id) as event_type from {events} group by user_id""")
def stream_upsert(t):
    schema = "user_id bigint, event_id bigint, event_type string"
    store = KeyedStore(t.spark, folder(t, "upsert"), schema, ["user_id"], order=["event_id"])
    return streamed(t, store, lambda rows, s, checkpoint: inc.upsert_stream(rows, s, ["event_id"], checkpoint), "upsert")


@query("stream_dedup", """
select user_id, event_type, event_id, value from (
  select *, row_number() over (partition by user_id, event_type order by event_id) as n from {events}) where n = 1""")
def stream_dedup(t):
    schema = "user_id bigint, event_type string, event_id bigint, value double"
    store = KeyedStore(t.spark, folder(t, "dedup"), schema, ["user_id", "event_type"], "first", ["event_id"])
    return streamed(t, store, inc.first_by_order, "dedup")


# --- whole jobs -----------------------------------------------------------------

# the tests each instance is labelled for: those that fail in the first log, and one unknown
CHANGED = """
select distinct instance_id, base as test from log_events where status = 'FAILED'"""


@query("labels_of_selectors", f"""
select c.instance_id, 'FAIL_TO_PASS' as label, c.test from ({CHANGED}) c
join ({SIDES}) s on s.instance_id = c.instance_id and s.test = c.test where pre = 'FAILED' and post = 'PASSED'
union all select instance_id, 'PASS_TO_PASS', test from ({SIDES}) where pre = 'PASSED' and post = 'PASSED'""")
def labels_of_selectors(t):
    selectors = t.sql(f"select instance_id, test as selector from ({CHANGED})")
    return lb.labels_of_selectors(selectors, t.test_logs)


@query("label_specs", f"""
select i.instance_id, true as processed,
  (select string_agg(c.test, ', ' order by c.test) from ({CHANGED}) c join ({SIDES}) s on s.instance_id = c.instance_id and s.test = c.test
    where pre = 'FAILED' and post = 'PASSED' and c.instance_id = i.instance_id) as fail_to_pass,
  case when i.instance_id in (select instance_id from ({CHANGED})) then
    (select string_agg(test, ', ' order by test) from ({SIDES}) s where pre = 'PASSED' and post = 'PASSED' and s.instance_id = i.instance_id) end as pass_to_pass
from (select distinct instance_id from log_events) i""")
def label_specs(t):
    tests = t.sql(f"""
select distinct instance_id, split(base, '::')[0] as path, split(base, '::')[1] as name, 'function' as code_type, 'modified' as change_type
from log_events where status = 'FAILED'""")
    return label.label_specs(t.log_events.select("instance_id").distinct(), tests, t.test_logs)


# The same in full: arguments are dealt into batches, every batch is run before and after the patch for each
# label, and labels wait for the last missing log.
COMMAND = "pytest"
DIRECTORIES = ["tests/", "test/", "unit/"]
ARGUMENTS = f"""
select instance_id, label, argument, (row_number() over (partition by instance_id, label order by md5(argument)) - 1) // 2 as batch from (
  select instance_id, 'FAIL_TO_PASS' as label, test as argument from ({CHANGED})
  union all select distinct instance_id, 'PASS_TO_PASS', unnest({DIRECTORIES}) from ({CHANGED}))"""
REQUESTS = f"""
select instance_id, label, unnest(['pre', 'post']) as phase, cast(batch as bigint) as batch, n_arguments, command from (
  select instance_id, label, batch, count(*) as n_arguments, 'pytest ' || string_agg(argument, ' ' order by md5(argument)) as command
  from ({ARGUMENTS}) group by instance_id, label, batch)"""
LANDED_RUNS = """
select distinct instance_id, label, phase, batch from run_events
where not (instance_id like 'u%3-_' and label = 'FAIL_TO_PASS' and phase = 'post' and batch = 1)"""
MISSING_RUNS = f"select instance_id, label, phase, batch, n_arguments, command from ({REQUESTS}) anti join ({LANDED_RUNS}) using (instance_id, label, phase, batch)"


def arguments(t):
    selectors = t.sql(f"select instance_id, test as selector from ({CHANGED})")
    folders = selectors.select("instance_id", F.explode(F.array(*map(F.lit, DIRECTORIES))).alias("directory"))
    return label.run_arguments(selectors, folders, max_chars=len(COMMAND), batch_size=2, command=COMMAND)


@query("run_requests", REQUESTS)
def run_requests(t):
    return label.run_requests(arguments(t), COMMAND)


@query("missing_runs", MISSING_RUNS)
def missing_runs(t):
    return label.missing_runs(label.run_requests(arguments(t), COMMAND), t.run_logs)


@query("label_runs", f"""
with wanted as (select * from ({ARGUMENTS})), missing as (select instance_id, count(*) as n_missing from ({MISSING_RUNS}) group by instance_id),
ends as (select instance_id, label, phase, batch, base, test_path, max_by(status, event_id) as status from run_events
  where not (instance_id like 'u%7-_' and batch = 0 and phase = 'post') group by all),
rolled as (select instance_id, label, phase, batch, base, case when bool_or(status in ('FAILED', 'ERROR')) then 'FAILED'
  when bool_or(status = 'PASSED') then 'PASSED' else 'SKIPPED' end as status from ends group by all),
f2p as (select w.instance_id, argument as test, bool_or(phase = 'pre' and status = 'FAILED') and bool_or(phase = 'post' and status = 'PASSED') as found
  from wanted w join rolled r on r.instance_id = w.instance_id and r.label = w.label and r.batch = w.batch and r.base = w.argument group by all),
p2p as (select instance_id, base as test, bool_or(phase = 'pre' and status = 'PASSED') and bool_or(phase = 'post' and status = 'PASSED') as found
  from rolled semi join (select instance_id, label, batch from wanted) using (instance_id, label, batch) where label = 'PASS_TO_PASS' group by all)
select i.instance_id, coalesce(n_missing, 0) as n_missing, n_missing is null as processed,
  case when n_missing is null then (select string_agg(test, ', ' order by test) from f2p where found and f2p.instance_id = i.instance_id) end as fail_to_pass,
  case when n_missing is null then (select string_agg(test, ', ' order by test) from p2p where found and p2p.instance_id = i.instance_id) end as pass_to_pass
from (select distinct instance_id from log_events) i left join missing using (instance_id)""")
def label_runs(t):
    return label.label_runs(t.log_events.select("instance_id").distinct(), arguments(t), t.run_logs)


# Agent a has two patches for every instance, of which the first counts, agent b has none. Labels
# come from the whole logs, the observed statuses from a part of the log after the patch for each
# label: some expected tests fail there and others are missing.
SCORED = f"""
with expected as (select instance_id, label, test from ({LABELS})),
ends as (select instance_id, batch, base, test_path, arg_max(status, event_id) as status from log_events where phase = 'post' group by all),
seen as (select instance_id, batch, base, case when bool_or(status in ('FAILED', 'ERROR')) then 'FAILED'
    when bool_or(status = 'PASSED') then 'PASSED' else 'SKIPPED' end as status from ends group by all),
flags as (select e.instance_id, coalesce(bool_and(coalesce(b.status, '') = 'PASSED') filter (label = 'FAIL_TO_PASS'), true) as success_f2p,
    coalesce(bool_and(coalesce(b.status, '') = 'PASSED') filter (label = 'PASS_TO_PASS'), true) as success_p2p,
    coalesce(string_agg(test, ', ' order by test) filter (label = 'FAIL_TO_PASS' and b.status = 'PASSED'), '') as passed_f2p,
    coalesce(string_agg(test, ', ' order by test) filter (label = 'PASS_TO_PASS'), '') as expected_p2p
  from expected e left join seen b on b.instance_id = e.instance_id and b.base = e.test
    and b.batch = case e.label when 'FAIL_TO_PASS' then 1 else 0 end group by e.instance_id)
select 'agent-a' as agent, 'm' as model, instance_id, success_f2p, success_p2p, success_f2p and success_p2p as success, passed_f2p, expected_p2p,
  cast(length(instance_id) as bigint) as total_tokens, cast(1 as bigint) as total_files_num, cast(1 as bigint) as applied_files_num, 'src/a.py' as applied,
  cast(null as varchar) as error from flags
union all select 'agent-b', 'm', instance_id, null, null, false, null, null, null, null, null, null, 'Agent failed to generate valid patches' from flags"""


@query("score_agents", SCORED)
def score_agents(t):
    found = lb.labels_of_runs(t.test_logs)
    texts = staged(lb.rendered(t.test_logs.select("instance_id"), found), "labels")
    labelled = texts.where("fail_to_pass is not null or pass_to_pass is not null")
    pairs = labelled.withColumn("agent", F.explode(F.array(F.lit("agent-a"), F.lit("agent-b")))).withColumn("model", F.lit("m"))
    key = [F.lit("agent-a").alias("agent"), F.lit("m").alias("model"), "instance_id"]
    diff = F.concat(F.lit("diff --git a/src/a.py b/src/a.py\n@@ -1 +1 @@\n+"), "instance_id", F.lit("\ndiff --git a/tests/test_a.py b/tests/test_a.py\n@@ -1 +1 @@\n+x"))
    patches = labelled.select(*key, F.lit(0).alias("seq"), diff.alias("model_patch"))
    attempts = score.source_files(patches.drop("seq")).withColumn("applied", F.lit(True))
    patches = patches.unionByName(patches.withColumn("seq", F.lit(1)).withColumn("model_patch", F.lit("")))
    logs = t.batch_logs.where("phase = 'post'").select(*key, F.when(F.col("batch") == 1, lb.F2P).otherwise(lb.P2P).alias("label"), "log")
    number = F.concat(F.lit("Execution Summary\n│ Total Tokens │ "), F.length("instance_id"), F.lit(" │"))
    agent_logs = labelled.select(*key, F.lit(0).alias("seq"), number.alias("log"))
    agent_logs = agent_logs.unionByName(agent_logs.withColumn("seq", F.lit(1)).withColumn("log", F.lit("")))
    done = score.score_agents(pairs, patches, attempts, logs, agent_logs)
    return done.select(
        "agent", "model", "instance_id", "success_f2p", "success_p2p", "success", F.array_join("passed_f2p_tests", ", ").alias("passed_f2p"),
        F.array_join("expected_p2p_tests", ", ").alias("expected_p2p"), "total_tokens", "total_files_num", "applied_files_num",
        F.array_join("applied_files", ", ").alias("applied"), "error")
