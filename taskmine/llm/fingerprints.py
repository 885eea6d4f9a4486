"""Document fingerprints that tell how far two versions differ, with built-in functions only.

A text is the set of the digests of its paragraphs, which are clauses: lines, and lines cut
at every blank after a mark or symbol or after a word of twelve characters or more, and
after the stops and commas of scripts that put no blank there. The rule is the same at every
length and in every script, and a cut depends on the text before it alone. A digest has 40
bits of hash and 24 bits that check them. The fingerprint is an invertible Bloom lookup sketch
of that set: every digest is added to one cell in each of three parts, and a cell keeps a count
and the exclusive or of its digests.

Two sketches of one size are subtracted cell by cell; what both sides have cancels out. Cells
that hold a single digest (count 1 or -1, check right, hashed to this very place) are peeled off
until none are left, which recovers exactly the differing digests. If cells remain, larger
sketches are tried: after the fingerprint's own size one of three cells for every digest, then,
for the few pairs that fail again, of eight and of sixteen with other positions. Likeness is
1 - differing / all digests of both sides; if even the last size fails, what it recovered
and the rest of its counts stand in for the differing digests.

The first two sizes are made and peeled as rows, one for each cell: sums and exclusive ors of
all digests of a text are a hash aggregate, and each round of peeling is one more. All of them
follow the partitioning that brought a text and its neighbour together, so texts are shuffled
once and digests never. Work grows in proportion to the clauses of a text.

Null and empty texts have no paragraphs; two of them are alike (1), and unlike any other
text (0). Repeated paragraphs count once. Ids must be unique. Equal texts have equal
fingerprints, whatever their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from taskmine.sources.stages import staged

PARTS = 3
FIRST_SIZE = 36  # cells of the fingerprint
ROUNDS = 12
ROW_ROUNDS = 9  # each goes through one part
SALTS = {0: 11, 3: 17, 8: 23, 16: 37}
_LARGE = 1 << 20  # positions of the second size begin here
# the blank comes first, so that only blanks and line feeds are looked at; texts without full-width stops need no more
_CUT = r"[ \n](?:(?<=\n)\n*+|(?<=[\p{P}\p{S}] |\S{12} ) *+)"
_STOPS = "[。！？，、；：．｡､]"
_CUT_WIDE = rf"{_CUT}|(?<={_STOPS})(?![ \n])"
_CELLS = "array<struct<pos:int,n:int,key:bigint>>"
_CHECK = 24
_BUCKET_ROWS = 60
_SEGMENTS = 64
# text of one task: its cells take about thirty times that in memory, so executors with more of it may take more
TASK_CHARS = 2 << 20


def paragraph_digests(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    cut = F.when(F.rlike(text, F.lit(_STOPS)), F.split(text, _CUT_WIDE, -1)).otherwise(F.split(text, _CUT, -1))
    parts = F.filter(cut, lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: _checked(F.xxhash64(p))))


def _checked(key: Column) -> Column:
    """The upper 40 bits of a hash with 24 bits that follow from them; a digest stays as it is."""
    upper = key.bitwiseAND(F.lit(-1 << _CHECK))
    return upper.bitwiseOR(F.xxhash64(upper).bitwiseAND(F.lit((1 << _CHECK) - 1)))


def _place(key: Column, part: Column | int, width: Column, salt: int) -> Column:
    """The cell of a digest in one of the parts."""
    return (F.pmod(F.xxhash64(key, F.lit(salt) + part), width) + width * part).cast("int")


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _entries(keys: Column, count: Column, size: Column, salt: int) -> Column:
    """One entry for each digest and part; ``count``: a function of the digest item."""
    width = F.greatest(F.floor(size / PARTS), F.lit(1)).cast("int")

    def of(item):
        key, n = count(item)
        return F.array(*[F.struct(_place(key, F.lit(p), width, salt).alias("pos"), n.cast("int").alias("n"), key.alias("key")) for p in range(PARTS)])

    return F.flatten(F.transform(keys, of))


def _summed(entries: Column) -> Column:
    """Entries of one position as one cell, by position; empty cells go. Linear in the entries but for their sorting."""
    def cells(rows):
        last = F.size(rows) + 1

        def cell(begin, k):
            own = F.slice(rows, begin, F.coalesce(F.get(starts, k + 1), last) - begin)
            add = lambda t, e: F.struct((t["n"] + e["n"]).alias("n"), t["key"].bitwiseXOR(e["key"]).alias("key"))
            total = F.aggregate(own, F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key")), add)
            return F.struct(F.element_at(rows, begin)["pos"].alias("pos"), total["n"].alias("n"), total["key"].alias("key"))

        starts = None

        def of(found):
            nonlocal starts
            starts = found
            return F.filter(F.transform(found, cell), lambda c: (c["n"] != 0) | (c["key"] != 0))

        first = lambda i: (i == 1) | (F.element_at(rows, i)["pos"] != F.element_at(rows, F.greatest(i - 1, F.lit(1)))["pos"])
        return F.when(last == 1, F.array().cast(_CELLS)).otherwise(_with(F.filter(F.sequence(F.lit(1), F.size(rows)), first), of))

    return _with(F.sort_array(entries), cells)


def sketch(keys: Column, size: Column, salt: int) -> Column:
    """Sorted non-empty cells (pos, n, key)."""
    return _summed(_entries(keys, lambda key: (key, F.lit(1)), size, salt))


def _minus(one: Column, other: Column) -> Column:
    turned = F.transform(other, lambda c: F.struct(c["pos"].alias("pos"), (-c["n"]).alias("n"), c["key"].alias("key")))
    return _summed(F.concat(one, turned))


def _difference(one: Column, other: Column, size: Column, salt: int) -> Column:
    """The sketch of ``one`` less that of ``other``, in one pass."""
    return _summed(F.concat(_entries(one, lambda key: (key, F.lit(1)), size, salt), _entries(other, lambda key: (key, F.lit(-1)), size, salt)))


def _pure(n: Column, key: Column) -> Column:
    return (F.abs(n) == 1) & (key == _checked(key))


def _peeled(cells: Column, size: Column, salt: int) -> Column:
    """(cells that are left, recovered: number of differing digests found)."""
    def keys(pure, n):  # numbers are made distinct by hashing, structs would be pair by pair
        return F.array_distinct(F.transform(F.filter(pure, lambda c: c["n"] == n), lambda c: c["key"]))

    def less(state, found):
        known = F.concat(_entries(found["one"], lambda key: (key, F.lit(-1)), size, salt), _entries(found["other"], lambda key: (key, F.lit(1)), size, salt))
        number = F.size(found["one"]) + F.size(found["other"])
        return F.when(number == 0, state).otherwise(
            F.struct(_summed(F.concat(state["cells"], known)).alias("cells"), (state["recovered"] + number).alias("recovered")))

    def step(state, _):
        pure = F.filter(state["cells"], lambda c: _pure(c["n"], c["key"]))
        found = _with(pure, lambda p: F.struct(keys(p, 1).alias("one"), keys(p, -1).alias("other")))
        return F.when(F.size(state["cells"]) == 0, state).otherwise(_with(found, lambda f: less(state, f)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(cells.alias("cells"), F.lit(0).alias("recovered")), step)


def _text_of(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(":", c["pos"], c["n"], F.hex(c["key"]))), ";")


def _likeness(differing: Column, total: Column) -> Column:
    return F.when(total == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - differing / total))


def with_likeness(pairs: DataFrame, one: str, other: str, name: str, sizes: tuple[int, ...] = (0, 3, 8, 16)) -> DataFrame:
    """Adds ``name``: likeness of two digest arrays by their sketches; larger ones only where the smaller ones fail.

    ``sizes``: cells for every digest, 0 for the fingerprint's size.
    """
    total = F.size(one) + F.size(other)
    out = pairs.withColumn("_peeled", F.lit(None).cast(f"struct<cells:{_CELLS},recovered:int>"))
    for per_digest in sizes:
        size, salt = (total * per_digest + FIRST_SIZE) if per_digest else F.lit(FIRST_SIZE), SALTS[per_digest]
        again = _peeled(_difference(F.col(one), F.col(other), size, salt), size, salt)
        out = out.withColumn("_peeled", F.when(F.size("_peeled.cells") == 0, F.col("_peeled")).otherwise(again))
    # a cell of count 0 holds two digests at least
    rest = F.ceil(F.aggregate("_peeled.cells", F.lit(0), lambda t, c: t + F.when(c["n"] == 0, 2).otherwise(F.abs(c["n"]))) / PARTS)
    return out.withColumn(name, _likeness(F.col("_peeled.recovered") + rest, total)).drop("_peeled")


def followed(docs: DataFrame, doc_id: str, columns: list[str], bucket_rows: int = _BUCKET_ROWS, task_chars: int = TASK_CHARS) -> DataFrame:
    """``docs`` with ``next_<column>`` of the next lower id and ``_bucket``, which they are partitioned by; the lowest is followed by the highest.

    Ids are cut into segments by their quantiles and each segment evenly into ranges of
    about ``bucket_rows`` rows, so the order needs one shuffle and no task holds more than
    some ranges, of about ``task_chars`` of text; only the last row of a range looks up the
    first of the next.
    """
    rows, low, high, chars = docs.agg(F.count("*"), F.min(doc_id), F.max(doc_id), F.sum(F.length("text")) if "text" in docs.columns else F.lit(0)).first()
    if not rows:
        return docs.select("*", F.lit(0).cast("long").alias("_bucket"), *[F.col(c).alias(f"next_{c}") for c in columns])
    cuts = docs.agg(F.percentile_approx(doc_id, [k / _SEGMENTS for k in range(1, _SEGMENTS)], 10_000)).first()[0]
    edges = sorted({low, high + 1, *cuts})
    each = -(-rows // (bucket_rows * (len(edges) - 1)))
    bounds = F.array(*[F.lit(e) for e in edges]).cast("array<bigint>")
    own = F.col(doc_id).cast("long")
    segment = F.size(F.filter(bounds, lambda b: b <= own))  # from 1
    floor, ceiling = F.element_at(bounds, segment), F.element_at(bounds, segment + 1)
    share = (own.cast("double") - floor.cast("double")) / (ceiling.cast("double") - floor.cast("double"))
    bucket = segment.cast("long") * each + F.floor(share * each)
    ranged = docs.withColumn("_bucket", bucket)
    if chars:
        ranged = ranged.repartition(-(-chars // task_chars), "_bucket")
    order = Window.partitionBy("_bucket").orderBy(F.desc(doc_id))
    ahead = ranged.withColumn("_next", F.lead(F.struct(*[F.col(c) for c in columns])).over(order))
    # first row of the nearest range below that has rows; the lowest range is followed by the highest
    heads = ranged.groupBy("_bucket", segment.alias("_segment")).agg(F.max(doc_id).alias("_head"))
    inside = Window.partitionBy("_segment").orderBy(F.desc("_bucket"))
    # the lowest range of a segment looks to the highest of the next segment that has any: a row for each of the few segments
    tops = heads.groupBy("_segment").agg(F.max("_head").alias("_top"))
    around = Window.orderBy(F.desc("_segment"))
    begun = tops.select("_segment", F.coalesce(F.lead("_top").over(around), F.first("_top").over(around)).alias("_below"))
    ring = heads.withColumn("_head", F.lead("_head").over(inside)).join(begun, "_segment").select("_bucket", F.coalesce("_head", "_below").alias("_head"))
    ring = staged(ring, "fingerprint-ranges")  # small, and known to be so; Spark decides how to join it
    edge = docs.join(ring, docs[doc_id] == F.col("_head")).select("_bucket", F.struct(*[docs[c] for c in columns]).alias("_edge"))
    joined = ahead.join(edge, "_bucket", "left")
    return joined.select(*docs.columns, "_bucket", *[F.coalesce(F.col("_next"), F.col("_edge"))[c].alias(f"next_{c}") for c in columns])


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``digests``, ``cells`` and their text form ``fingerprint``."""
    keyed = docs.withColumn("digests", paragraph_digests(F.col(text)))
    celled = keyed.withColumn("cells", sketch(F.col("digests"), F.lit(FIRST_SIZE), 11))
    return celled.withColumn("fingerprint", _text_of(F.col("cells")))


def edited_versions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", task_chars: int = TASK_CHARS) -> DataFrame:
    """doc_id, text, digests, the same of the next document and ``edited``: the last half replaced by as many first characters of that.

    Digests are made where the text is read and travel with it to the document before.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = plain.withColumn("digests", paragraph_digests(F.col("text"))).withColumn("id", F.col("doc_id"))
    both = followed(keyed, "doc_id", ["id", "text", "digests"], task_chars=task_chars).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half)
    return both.withColumn("edited", F.concat(kept, F.substr("next_text", F.lit(1), half)))


# rows of a document: cells of two differences, of the fingerprints of both texts, and single values
_EDITED, _NEXT, _OWN_PRINT, _EDITED_PRINT, _VALUE = range(5)
# one number says which cell of which sketch it is, and how wide the parts of the second size are: short rows keep the aggregates small
_POS_BITS, _WHICH_BITS, _BELOW = 30, 3, 64


def _cell(width: Column, which: Column | int, pos: Column) -> Column:
    number = F.lit(which) if isinstance(which, int) else which
    return F.shiftleft(width.cast("long"), _POS_BITS + _WHICH_BITS) + F.shiftleft(number.cast("long"), _POS_BITS) + pos + _BELOW


def _width(cell: Column) -> Column:
    return F.shiftright(cell, _POS_BITS + _WHICH_BITS).cast("int")


def _which(cell: Column) -> Column:
    return F.shiftright(cell, _POS_BITS).bitwiseAND(F.lit((1 << _WHICH_BITS) - 1))


def _pos(cell: Column) -> Column:
    return (cell.bitwiseAND(F.lit((1 << _POS_BITS) - 1)) - _BELOW).cast("int")


_HEX = 13  # digits of a SHA-256 in one number
_VALUES = ["n_chars", "next_id", "n_own", "n_edited", "n_next", *[f"sha_{k}" for k in range(5)]]


def _sketched(pairs: DataFrame) -> DataFrame:
    """Rows (document, cell, n, key): the cells of both differences in both sizes, of the two fingerprints, and the values."""
    sha = F.sha2("edited", 256)
    parts = [F.conv(F.substring(sha, 1 + _HEX * k, _HEX), 16, 10).cast("long") for k in range(5)]
    made = pairs.select("_bucket", "doc_id", "n_chars", "next_id", F.col("digests").alias("own"), paragraph_digests(F.col("edited")).alias("edited"),
                        F.col("next_digests").alias("next"), *[p.alias(f"sha_{k}") for k, p in enumerate(parts)])
    made = made.withColumns({f"n_{c}": F.size(c) for c in ("own", "edited", "next")})
    width = (F.greatest("n_edited", "n_next") + F.col("n_own") + FIRST_SIZE // PARTS).cast("int")
    values = F.array(*[F.col(v).cast("long") for v in _VALUES])
    rows = made.select("_bucket", "doc_id", "n_own", "n_edited", width.alias("width"), F.posexplode(F.concat(values, "own", "edited", "next")).alias("i", "key"))
    at = F.col("i") - len(_VALUES)
    side = F.when(at < F.col("n_own"), 0).when(at < F.col("n_own") + F.col("n_edited"), 1).otherwise(2)
    key, small = F.col("key"), F.lit(FIRST_SIZE // PARTS)
    places = [_place(key, F.lit(p), small, SALTS[0]) for p in range(PARTS)] + [F.lit(_LARGE) + _place(key, F.lit(p), F.col("width"), SALTS[3]) for p in range(PARTS)]
    cell = F.when(at < 0, F.array(_cell(F.col("width"), 0, at))).otherwise(F.array(*[_cell(F.col("width"), 0, place) for place in places]))
    placed = rows.select("_bucket", "doc_id", "key", F.when(at < 0, 3).otherwise(side).alias("side"), F.explode(cell).alias("cell"))
    one = lambda k: F.when(F.col("side") == k, 1).otherwise(0)
    own = lambda k: F.bit_xor(F.when(F.col("side") == k, F.col("key")).otherwise(F.lit(0).cast("long")))
    cells = placed.groupBy("_bucket", "doc_id", "cell").agg(
        *[F.sum(one(k)).alias(f"n{k}") for k in range(3)], *[own(k).alias(f"k{k}") for k in range(4)])

    def row(which: int, n: Column, key: Column) -> Column:
        return F.struct((F.col("cell") + (which << _POS_BITS)).alias("cell"), n.cast("long").alias("n"), key.alias("key"))

    n, k = [F.col(f"n{c}") for c in range(3)], [F.col(f"k{c}") for c in range(4)]
    differences = [row(_EDITED, n[0] - n[1], k[0].bitwiseXOR(k[1])), row(_NEXT, n[0] - n[2], k[0].bitwiseXOR(k[2]))]
    prints = [row(_OWN_PRINT, n[0], k[0]), row(_EDITED_PRINT, n[1], k[1])]
    pos = _pos(F.col("cell"))
    out = F.when(pos < 0, F.array(row(_VALUE, F.lit(0), k[3]))).when(pos < _LARGE, F.array(*differences, *prints)).otherwise(F.array(*differences))
    return cells.select("_bucket", "doc_id", F.inline(out)).where((F.col("n") != 0) | (F.col("key") != 0) | (_which(F.col("cell")) == _VALUE))


def _round(rows: DataFrame, part: int) -> DataFrame:
    """The pure cells of one part give up their digests, which leave their other cells and are counted at pos -1 (-2 for the second size).

    A digest has one cell in a part, so none is given up twice.
    """
    n, key, cell = F.col("n"), F.col("key"), F.col("cell")
    pos, which, width = _pos(cell), _which(cell), _width(cell)
    large = pos >= _LARGE
    place = lambda p: F.when(large, F.lit(_LARGE) + _place(key, F.lit(p), width, SALTS[3])).otherwise(_place(key, F.lit(p), F.lit(FIRST_SIZE // PARTS), SALTS[0]))
    pure = (which <= _NEXT) & (pos >= 0) & _pure(n, key) & (place(part) == pos)
    one = lambda cell, n, key: F.struct(cell.alias("cell"), n.alias("n"), key.alias("key"))
    taken = [one(cell - pos + place(p), -n, key) for p in range(PARTS) if p != part]
    found = one(cell - pos + F.when(large, -2).otherwise(-1), F.lit(1).cast("long"), F.lit(0).cast("long"))
    spread = rows.select("_bucket", "doc_id", F.inline(F.when(pure, F.array(*taken, found)).otherwise(F.array(one(cell, n, key)))))
    after = spread.groupBy("_bucket", "doc_id", "cell").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"))
    return after.where((F.col("n") != 0) | (F.col("key") != 0) | (_which(F.col("cell")) == _VALUE))


def _judged(rows: DataFrame) -> DataFrame:
    """One row per document: its values, fingerprints, and for each difference the digests found, null where cells are left in both sizes."""
    rows = rows.select("_bucket", "doc_id", _which(F.col("cell")).alias("which"), _pos(F.col("cell")).alias("pos"), "n", "key")
    value = {name: F.max(F.when((F.col("which") == _VALUE) & (F.col("pos") == k - len(_VALUES)), F.col("key"))).alias(name) for k, name in enumerate(_VALUES)}
    cell = F.struct("pos", F.col("n").cast("int").alias("n"), "key")
    prints = [F.array_sort(F.collect_list(F.when(F.col("which") == which, cell))).alias(name) for which, name in ((_OWN_PRINT, "own_cells"), (_EDITED_PRINT, "edited_cells"))]
    counts = []
    for which, name in ((_EDITED, "edited"), (_NEXT, "next")):
        mine = F.col("which") == which
        for size, of in enumerate((mine & F.col("pos").between(0, _LARGE - 1), mine & (F.col("pos") >= _LARGE))):
            counts.append(F.count_if(of).alias(f"{name}_left_{size}"))
            counts.append(F.coalesce(F.max(F.when(mine & (F.col("pos") == -1 - size), F.col("n"))), F.lit(0)).alias(f"{name}_found_{size}"))
    flat = rows.groupBy("_bucket", "doc_id").agg(*value.values(), *prints, *counts)
    differing = lambda name: F.when(F.col(f"{name}_left_0") == 0, F.col(f"{name}_found_0")).when(F.col(f"{name}_left_1") == 0, F.col(f"{name}_found_1"))
    sha = F.concat(*[F.lower(F.lpad(F.hex(f"sha_{k}"), _HEX if k < 4 else 64 - 4 * _HEX, "0")) for k in range(5)])
    return flat.select(
        "doc_id", "next_id", "n_chars", sha.alias("edited_sha256"), "own_cells", "edited_cells",
        *[F.when(differing(name).isNotNull(), _likeness(differing(name), F.col("n_own") + F.col(f"n_{name}"))).alias(f"near_{name}") for name in ("edited", "next")])


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", task_chars: int = TASK_CHARS) -> DataFrame:
    """Each document against its edited version and the next document. Runs jobs when called."""
    rows = _sketched(edited_versions(docs, doc_id, text, task_chars))
    for k in range(ROW_ROUNDS):
        rows = _round(rows, k % PARTS)
    known = staged(_judged(rows), "fingerprints")
    # the few pairs that are still not told apart: their texts again, and larger sketches
    failed = staged(known.where("near_edited is null or near_next is null").select("doc_id", "next_id"), "fingerprints-failed")
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = plain.join(failed, "doc_id")
    after = plain.select(F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    both = own.join(after, "next_id")
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), size - half), F.substr("next_text", F.lit(1), half))
    again = both.select("doc_id", *[paragraph_digests(c).alias(name) for c, name in ((F.col("text"), "own"), (edited, "edited"), (F.col("next_text"), "next"))])
    again = with_likeness(again, "own", "edited", "again_edited", (8, 16))
    again = staged(with_likeness(again, "own", "next", "again_next", (8, 16)).select("doc_id", "again_edited", "again_next"), "fingerprints-again")
    joined = known.join(again, "doc_id", "left")
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", _text_of(F.col("own_cells")).alias("fingerprint"), _text_of(F.col("edited_cells")).alias("edited_fingerprint"),
        F.coalesce("near_edited", "again_edited").alias("near_edited"), F.coalesce("near_next", "again_next").alias("near_next"))
