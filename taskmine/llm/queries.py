"""The operators' queries on the given tables, and the SQL they must agree with where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import taskmine
from taskmine.llm import bpe, contamination, fingerprints, html_text, licenses, near, pii, prefixes, repeats, runs, secrets, substrings, toxicity
from taskmine.llm.native import described
from taskmine.sources.stages import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RANKS = "byte_bpe_50k.tiktoken"


def query(name: str, sql: str | None = None):
    def register(function):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            taskmine.ship(spark)
            return function(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def _sha(column: Column) -> Column:
    return F.sha2(column, 256)


def default_ranks(path: str | None = None) -> dict[bytes, int]:
    """The ranks in a file; the public 50k vocabulary where none is named."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(RANKS)
    return bpe.read_ranks(path)


@query("op1_near_duplicates")
def op1(table) -> DataFrame:
    return near.linked(table("documents"))


@query("op2_html_text")
def op2(table) -> DataFrame:
    return html_text.extracted(table("pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))


@query("op3_toxicity")
def op3(table) -> DataFrame:
    docs, labels = table("documents"), table("labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    sample = toxicity.sample_of(labels.where(~held))
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most 16,000 ids
    scored = toxicity.scored(docs.select("doc_id", "text"), toxicity.train(known))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_fingerprints")
def op4(table) -> DataFrame:
    return fingerprints.compared(table("documents")).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op5_bpe")
def op5(table) -> DataFrame:
    coded = bpe.round_trip(table("documents").select("doc_id", "text"), default_ranks()).drop("text")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        _sha(F.concat_ws(" ", F.col("ids").cast("array<string>"))).alias("ids_sha256"), _sha("decoded").alias("decoded_sha256"))


@query("op6_secrets")
def op6(table) -> DataFrame:
    found = secrets.scanned(table("documents").select("doc_id", "text")).drop("text")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(kind) for kind in secrets.KINDS], _sha(described(F.col("base"))).alias("base_sha256"), described(F.col("spans")).alias("spans"))


@query("op7_licenses")
def op7(table) -> DataFrame:
    found = licenses.scanned(table("documents").select("doc_id", "text")).drop("text")
    base = F.transform("places", lambda p: p["label"])
    own = F.transform("detections", lambda d: d["label"])
    label_list = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), "first_word", "last_word",
        label_list(base).alias("base_labels"), label_list(F.concat(base, own)).alias("labels"), "score")


_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as w"""
OP8 = f"""
with d as (select doc_id, {_WORDS} from documents), b as (select item_id, {_WORDS} from benchmark),
item_windows as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') as win
  from b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(k) where len(w) > 0),
places as (select doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') as win
  from d, (select distinct n from item_windows) sizes, unnest(range(1, len(w) - n + 2)) t(k)),
hits as (select doc_id, k, n, item_id from places join item_windows using (n, win)),
covered as (select doc_id, count(distinct x) as n_hit from (select distinct doc_id, k, n from hits) h, unnest(range(k, k + n)) u(x) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join items using (doc_id)"""


@query("op8_decontamination", OP8)
def op8(table) -> DataFrame:
    found = contamination.contaminated(table("documents").select("doc_id", "text"), table("benchmark")).drop("text")
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        _sha(F.concat_ws(",", "items")).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


@query("op9_personal_data")
def op9(table) -> DataFrame:
    found = pii.spans(table("documents").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(kind) for kind in pii.KINDS], _sha(described(F.col("base"))).alias("base_sha256"), described(F.col("spans")).alias("spans"))


@query("op10_repeats")
def op10(table) -> DataFrame:
    found = repeats.without_repeats(table("documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), _sha("kept").alias("kept_sha256"))


def _crc_sql(column: str) -> str:
    """CRC-32 of a number's digits, bit by bit."""
    digits = f"cast({column} as varchar)"
    steps = f"flatten(list_transform(range(1, length({digits}) + 1), lambda i: [-cast(ascii({digits}[i]) as bigint), 0, 0, 0, 0, 0, 0, 0, 0]))"
    return f"""xor(4294967295, list_reduce(list_concat([4294967295], {steps}),
  lambda s, x: case when x < 0 then xor(s, -x) when s % 2 = 1 then xor(s >> 1, 3988292384) else s >> 1 end))"""


OP11 = f"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as pos, role, text
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
c as (select conv_id, conv_id - conv_id % 20 as base, {_crc_sql('conv_id')} % 4 as h from (select distinct conv_id from t)),
n as (select conv_id, count(*) as n from t group by conv_id),
r as (select c.conv_id, t.pos + 1 as d, role, text from c join t on t.conv_id = base where t.pos < h
  union all select c.conv_id, t.pos - h + least(h, coalesce(n, 0)) + 1, role, text from c join t using (conv_id) left join n on n.conv_id = base where t.pos >= h),
p as (select conv_id, d, list(struct_pack(role, text)) over (partition by conv_id order by d) as k,
    len(regexp_extract_all(text, '[^ \x09-\x0D]+')) as w from r
  union all select conv_id, 0, [], 0 from c),
node as (select d, k, min(conv_id) as id, count(*) as n, max(w) as w from p group by d, k),
stand as (select p.conv_id, d, node.id from p join node using (d, k)),
last as (select conv_id, max(d) as d from p group by conv_id),
ends as (select d, id, sha256(string_agg(cast(conv_id as varchar), ',' order by conv_id)) as e from last join stand using (conv_id, d) group by d, id),
above as (select node.d, node.id, stand.id as parent from node join stand on stand.conv_id = node.id and stand.d = node.d - 1),
children as (select d - 1 as d, parent as id, count(*) as n_children from above group by all),
sums as (select stand.d, stand.id, cast(sum((n - 1) * w) as bigint) as saved, count(*) filter (n_children is null) as leaves
  from node left join children using (d, id) join stand on stand.conv_id = node.id and stand.d <= node.d group by all)
select id as conv_id, cast(d as bigint) as depth, parent as parent_conv_id, n as n_convs, coalesce(n_children, 0) as n_children, leaves as n_leaves,
  saved as saved_tokens, coalesce(e, sha256('')) as ends_sha256
from node join sums using (d, id) left join above using (d, id) left join children using (d, id) left join ends using (d, id)"""


@query("op11_prefix_trie", OP11)
def op11(table) -> DataFrame:
    turns = staged(prefixes.numbered(table("conversations")), "conversation-turns")
    convs = turns.select("conv_id").distinct()
    return prefixes.trie(prefixes.with_shared_start(turns, convs), convs)


OP12 = f"""
with o as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') as w, {_crc_sql('doc_id')} as h from documents),
e as (select *, len(w) as n, h // 10 as g, h % 10 = 0 and len(w) > 0 as edited from o),
f as (select *, case when edited then g % n end as a from e),
d as (select doc_id, n, case when edited then
    list_concat(w[1:a], list_transform(range(0, n - a), lambda i: w[a + 1 + i % (1 + (n - a) // (3 + g % 8))])) else w end as w from f),
grams as (select doc_id, k, case when k > 1 then w[k - 1] end as before, array_to_string(w[k:k + 15], ' ') as gram
  from d, unnest(range(1, n - 14)) t(k) where n >= 24),
pairs as (select x.doc_id, x.k, y.k - x.k as q from grams x join grams y on x.doc_id = y.doc_id and x.gram = y.gram and x.k < y.k
  where x.before is distinct from y.before),
shared as (select doc_id, k, q, coalesce(list_position(list_transform(range(k, n - q + 1), lambda i: w[i] = w[i + q]), false) - 1, n - q - k + 1) as s
  from pairs join d using (doc_id) where 3 * q <= n),
runs as (select doc_id, k - 1 as start, s + q as length, min(q) as period from shared where s >= 2 * q and s + q >= 24 group by all),
gone as (select doc_id, list(distinct x) as gone from runs, unnest(range(start + period + 1, start + length + 1)) u(x) group by doc_id),
each as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from runs group by doc_id),
best as (select * from runs qualify row_number() over (partition by doc_id order by length / period desc, start, period) = 1)
select doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256,
  sha256(array_to_string(case when gone is null then w else list_filter(w, lambda x, i: not list_contains(gone, i)) end, ' ')) as collapsed_sha256
from d left join each using (doc_id) left join best using (doc_id) left join gone using (doc_id)"""


@query("op12_periodic_runs", OP12)
def op12(table) -> DataFrame:
    found = runs.collapsed(runs.with_repeated_end(table("documents").select("doc_id", "text")))
    one = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    every = F.concat_ws("", F.transform("runs", lambda r: F.concat(one(r), F.lit("\n"))))
    milli = F.expr("1000 * best.length div best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        _sha(every).alias("runs_sha256"), _sha("collapsed").alias("collapsed_sha256"))


OP13 = """
with recursive d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') as w from documents),
windows(g, doc_id, k, h, first_id) as (
  select * from (select 50 as g, doc_id, k, h, min(doc_id) over (partition by h) as first_id
    from (select doc_id, k, sha256(array_to_string(w[k:k + 49], ' ')) as h from d, unnest(range(1, len(w) - 48)) t(k)))
  qualify first_id < max(doc_id) over (partition by h)
  union all
  select g, doc_id, k, h, first_id from (select *, min(doc_id) over (partition by h) as first_id
    from (select 2 * a.g as g, a.doc_id, a.k, sha256(a.h || b.h) as h from windows a join windows b on b.doc_id = a.doc_id and b.k = a.k + a.g))
  qualify first_id < max(doc_id) over (partition by h)),
gone as (select doc_id, list(distinct x) as gone from windows, unnest(range(k, k + 50)) u(x) where g = 50 and first_id < doc_id group by doc_id),
twice as (select doc_id, max(g) as longest from windows where first_id < doc_id group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
  sha256(array_to_string(case when gone is null then w else list_filter(w, lambda x, i: not list_contains(gone, i)) end, ' ')) as kept_sha256,
  cast(longest as bigint) as longest
from d left join gone using (doc_id) left join twice using (doc_id)"""


@query("op13_substrings", OP13)
def op13(table) -> DataFrame:
    found = substrings.without_repeated_windows(table("documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), _sha("kept").alias("kept_sha256"), "longest")
