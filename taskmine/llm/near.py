"""N-gram Jaccard join: documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

MinHash banding finds candidates: ``bands`` times ``rows`` minima of hashed n-grams, a
shuffle on the band hashes, and exact verification of pairs on the full n-gram sets. At
16 bands of 4 rows a pair at 0.8 is a candidate with probability 1 - (1 - 0.8**4)**16 =
0.9998 and a pair at 0.9 practically always.

Documents with the same set of n-grams are one class and stand for each other through one
representative, so copies never multiply. Candidates connected by buckets are one group.
A group that fits into one cell (``cell_size`` n-grams in all) is verified there at once.
A larger group is cut by bucket and every bucket into blocks, two of which make a cell; a
pair then counts in the first band it shares, in the one cell that holds both, so nothing
is dropped, counted twice or gathered in one task. Cells hand on one row per member, its
links and the smallest member of the cell that links lead to from it, and never the pairs.

``linked`` gives one row per document: ``class_id`` (smallest id of the connected
documents), ``n_links`` (documents at or above the threshold, copies included) and
``n_ngrams``. A text of fewer words than n has one n-gram of all of them. Null, empty and
wordless texts have no n-grams and no links. Ids must be unique; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from taskmine.llm.arrays import Words, columns_of, mixed, packed, sized
from taskmine.sources.stages import staged

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 16, 4
CELL_SIZE = 1_500_000  # n-grams of a cell; half of it in a block
CELL_MEMBERS = 1024  # members of a block
_CHUNK = 1 << 18
_PAIRS = 1 << 21  # pairs of members counted at once


def _sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each text without repetitions: values, and where each text's begin (with the end)."""
    words = Words(*packed(column))
    at, values = words.runs(n)
    owner = words.text[at]
    short = np.flatnonzero((np.diff(words.first) > 0) & (np.diff(words.first) < n))
    if len(short):
        extra_owner, extra = [], []
        for size in range(1, n):
            first, hashes = words.runs(size)
            whole = (words.first[words.text[first]] == first) & (np.diff(words.first)[words.text[first]] == size)
            extra_owner.append(words.text[first[whole]])
            extra.append(hashes[whole])
        owner, values = np.concatenate([owner, *extra_owner]), np.concatenate([values, *extra])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    owner, values = owner[new], values[new]
    return values, np.searchsorted(owner, np.arange(len(column) + 1))


def signatures(docs: DataFrame, doc_id: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_ngrams, two digests of the set, and the band hashes."""
    seeds = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            ids, texts = columns_of(batch, ["doc_id", "text"])
            for lo, to in sized(texts, _CHUNK):
                values, first = _sets(texts.slice(lo, to - lo), n)
                size = np.diff(first)
                full = np.flatnonzero(size)
                one, two = np.zeros(to - lo, np.uint64), np.zeros(to - lo, np.uint64)
                band = np.zeros((to - lo, bands), np.uint64)
                if len(full):
                    starts = first[full]
                    one[full] = np.add.reduceat(mixed(values), starts)
                    two[full] = np.add.reduceat(mixed(values ^ seeds[0]), starts)
                    total = None
                    for k, seed in enumerate(seeds):
                        low = np.minimum.reduceat((values ^ seed) * (seed | np.uint64(1)), starts)
                        total = low if k % rows == 0 else mixed(total) ^ low
                        if k % rows == rows - 1:
                            band[full, k // rows] = mixed(total)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(to - lo + 1, dtype=np.int32) * bands), pa.array(band.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, to - lo), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists],
                    names=["doc_id", "n_ngrams", "digest1", "digest2", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_ngrams long, digest1 long, digest2 long, bands array<long>")


def _links(first: np.ndarray, values: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix: which two sets have the threshold's Jaccard similarity."""
    m = len(first) - 1
    size = np.diff(first)
    member = np.repeat(np.arange(m), size)
    _, code, df = np.unique(values, return_inverse=True, return_counts=True)
    shared = np.zeros((m, m), np.float32)
    # an n-gram that most members have is told by the members that lack it
    common = df > m // 2
    order = np.argsort(code, kind="stable")
    begin = np.concatenate([[0], np.cumsum(df)])
    lacks = np.zeros(m, np.float64)
    n_common = int(common.sum())
    if n_common:
        column = np.full(len(df), -1)
        column[common] = np.arange(n_common)
        lacks = n_common - np.bincount(member[common[code]], minlength=m).astype(float)
    minor = np.where(common, m - df, df)
    single = np.flatnonzero(minor > 48)
    flat, waiting = [], 0

    def counted() -> None:
        # pairs are counted as they come, so that a cell of many n-grams does not hold all of theirs
        nonlocal flat, waiting
        if flat:
            found, times = np.unique(np.concatenate(flat), return_counts=True)
            shared.ravel()[found] += times
        flat, waiting = [], 0

    def add(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal waiting
        flat.append(np.minimum(i, j) * m + np.maximum(i, j))
        waiting += len(i)
        if waiting >= _PAIRS:
            counted()

    for c in np.flatnonzero((minor > 1) & (minor <= 48) & common):
        lacking = np.setdiff1d(np.arange(m), member[order[begin[c]:begin[c + 1]]], assume_unique=True)
        i, j = np.triu_indices(len(lacking), 1)
        add(lacking[i], lacking[j])
    rare = np.flatnonzero((df > 1) & (df <= 48) & ~common)
    for k in np.unique(df[rare]):  # pairs inside short lists, by size so that each size is one step
        own = rare[df[rare] == k]
        for lo in range(0, len(own), _PAIRS // 48):
            rows = member[order[(begin[own[lo:lo + _PAIRS // 48]][:, None] + np.arange(k))]]
            for i in range(k):
                for j in range(i + 1, k):
                    add(rows[:, i], rows[:, j])
    counted()
    shared += shared.T.copy()
    for lo in range(0, len(single), 512):
        wide = np.zeros((m, min(512, len(single) - lo)), np.float32)
        for k, c in enumerate(single[lo:lo + 512]):
            wide[member[order[begin[c]:begin[c + 1]]], k] = 1
        flip = common[single[lo:lo + 512]]
        wide[:, flip] = 1 - wide[:, flip]
        shared += wide @ wide.T
    total = shared + (n_common - lacks[:, None] - lacks[None, :])
    linked = total * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-6
    np.fill_diagonal(linked, False)
    return linked


def _roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each member the smallest id that links lead to from it, directly or through other members."""
    root, waiting = ids.copy(), linked.any(1)
    for start in np.argsort(ids, kind="stable"):
        if waiting[start]:
            new = np.zeros(len(ids), bool)
            new[start] = True
            reached = new
            while new.any():
                new = linked[new].any(0) & ~reached
                reached = reached | new
            root[reached] = ids[start]
            waiting &= ~reached
    return root


def _verified(rows: dict[str, list], n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links with copies counted, smallest member that links lead to) of the members of one cell."""
    values, first = _sets(pa.array(rows["text"], pa.large_string()), n)
    linked = _links(first, values, threshold)
    block = np.array(rows["block"])
    low, high = rows["cell_i"][0], rows["cell_j"][0]
    if low >= 0:  # a cell of a cut bucket
        bands = np.array(rows["bands"])
        band = rows["band"][0]
        for k in range(band):
            linked &= bands[:, k][:, None] != bands[:, k][None, :]
        if low != high:
            linked &= block[:, None] != block[None, :]
    ids, weight = np.array(rows["doc_id"]), np.array(rows["copies"], float)
    count = linked @ weight
    return count.astype(np.int64), _roots(linked, ids)


def _cells(members: DataFrame, n: int, threshold: float) -> DataFrame:
    """doc_id, n_links and the smallest id that links lead to, for each member of each cell; cells are sorted runs of rows."""
    keys = ["cell_key", "cell_i", "cell_j"]
    names = ["doc_id", "copies", "block", "cell_i", "cell_j", "band", "bands", "text"]

    def run(batches):
        held = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            key = [table[k].to_numpy() for k in keys]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1 if len(table) > 1 else np.zeros(0, int)
            if len(change):
                yield from cells(table.slice(0, change[-1]), np.r_[0, change])
                held = table.slice(change[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            if len(table):
                key = [table[k].to_numpy() for k in keys]
                change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1 if len(table) > 1 else np.zeros(0, int)
                yield from cells(table, np.r_[0, change, len(table)])

    def cells(table, cuts):
        ids, links, least = [], [], []
        for lo, to in zip(cuts, cuts[1:]):
            rows = table.slice(lo, to - lo).select(names).to_pydict()
            count, root = _verified(rows, n, threshold)
            ids.append(rows["doc_id"])
            links.append(count)
            least.append(root)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(links)), pa.array(np.concatenate(least))],
                                         names=["doc_id", "n_links", "least"])

    dealt = members.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return dealt.select(*keys[:1], *names).mapInArrow(run, "doc_id long, n_links long, least long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): smallest node of each connected component; ``edges`` has columns a and b.

    Every round, each node takes the least label of its neighbours and then its label's
    label, so chains shorten by halves; rounds are stage tables in the shared folder.
    """
    # each node keeps one edge, to its least neighbour, which the other lesser neighbours join: from
    # here on a group has hardly more edges than members, however many ways it was connected
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = ordered.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    short = least.select("a", F.col("m").alias("b")).union(least.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
    both = staged(short.union(short.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), f"{name}-0")
    step = 0
    while True:
        step += 1
        met = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        better = labels.join(met, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        after = staged(better.join(jump, "root", "left").select("node", "old", F.least("root", "further").alias("root")), f"{name}-{step}")
        if after.where("root <> old").isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, threshold: float = SIMILARITY,
           bands: int = BANDS, rows: int = ROWS, cell_size: int = CELL_SIZE, cell_members: int = CELL_MEMBERS) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_ngrams. Runs jobs when called (stage tables, components)."""
    signed = staged(signatures(docs, doc_id, text, n, bands, rows), "near-signatures")
    digest = ["digest1", "digest2", "n_ngrams"]
    filled = signed.where("n_ngrams > 0")
    classes = staged(filled.groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "near-classes")
    spread = classes.select(F.col("rep").alias("doc_id"), "n_ngrams", F.posexplode("bands").alias("band", "key"))
    buckets = spread.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.sum("n_ngrams").alias("size"), F.min("doc_id").alias("least"), F.sum(F.xxhash64("doc_id").bitwiseAND((1 << 31) - 1)).alias("mark"),
        F.sum(F.xxhash64("doc_id", F.lit(1)).bitwiseAND((1 << 31) - 1)).alias("mark2")).where("n > 1")
    # buckets of the same members say the same: the first band is kept, in which all their pairs count
    kept = staged(buckets.groupBy("n", "size", "least", "mark", "mark2").agg(F.min(F.struct("band", "key")).alias("first"))
                  .select("n", "size", "least", "first.band", "first.key"), "near-buckets")
    inside = staged(spread.join(kept, ["band", "key"]).select("doc_id", "band", "key", "n", F.col("size").alias("bucket_size"), "least", "n_ngrams"), "near-members")
    grouped = components(inside.select(F.col("doc_id").alias("a"), F.col("least").alias("b")), "near-groups")
    found = grouped.select(F.col("node").alias("doc_id"), F.col("root").alias("group"))
    info = classes.select(F.col("rep").alias("doc_id"), "n_ngrams", "copies", "bands")
    of_group = found.join(info, "doc_id")
    large = of_group.groupBy("group").agg(F.count("*").alias("members"), F.sum("n_ngrams").alias("whole")).select(
        "group", ((F.col("members") > 2 * cell_members) | (F.col("whole") > cell_size)).alias("cut"))
    flagged = staged(of_group.join(large, "group"), "near-groups-sized")
    whole = flagged.where("not cut").select(
        "doc_id", "copies", "bands", F.col("group").alias("cell_key"), F.lit(-1).alias("band"), F.lit(0).alias("block"), F.lit(-1).alias("cell_i"), F.lit(-1).alias("cell_j"))
    blocks = F.greatest(F.ceil(F.col("n") / cell_members), F.ceil(F.col("bucket_size") / (cell_size // 2))).cast("int")
    mine = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("blocks")).cast("int")).otherwise(0)
    cut = flagged.where("cut").select("doc_id", "copies", "bands").join(inside.select("doc_id", "band", "key", blocks.alias("blocks")), "doc_id")
    cut = cut.withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "doc_id", "copies", "bands", F.xxhash64("band", "key").alias("cell_key"), "band", "block",
        F.least("block", "other").alias("cell_i"), F.greatest("block", "other").alias("cell_j"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    members = texts.join(staged(whole.unionByName(cut), "near-cells"), "doc_id")
    checked = staged(_cells(members, n, threshold), "near-checked")
    roots = components(checked.select(F.col("doc_id").alias("a"), F.col("least").alias("b")), "near-classes-joined")
    links = checked.groupBy("doc_id").agg(F.sum("n_links").alias("links"))
    of_class = classes.join(links.select(F.col("doc_id").alias("rep"), "links"), "rep", "left").join(
        roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select(
        *digest, F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("doc_id", *digest).join(of_class, digest, "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_ngrams")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each class, the one of the smallest id."""
    classes = linked(docs, doc_id, **options)
    extra = classes.where("class_id <> doc_id").select(F.col("doc_id").alias("_extra"))
    return docs.join(extra, docs[doc_id].cast("long") == F.col("_extra"), "left_anti")
