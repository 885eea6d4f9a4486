"""Secrets in texts, with multipart credentials linked inside their scopes.

Strong finds stand alone: assigned secrets, cloud access identifiers, long hex strings.
Weak candidates (short access identifiers, account names, connection endpoints, strings
that look random, short assigned values) say little alone. They are interval-joined: the
parts of a text are sorted by place, and a candidate is reported only if the parts it
needs lie in the same scope (a stretch without a blank line), however far apart in it; how
far the nearest of them is comes with the candidate (``distance``, the farther of two kinds),
as a measure of confidence. A name or identifier needs a secret, a random string needs a name,
identifier or endpoint, an endpoint needs a secret and a name or identifier.

The join is a sorted look-up for each candidate, so no pairs are made, and since all
parts of a scope are in one text, nothing is shuffled. Texts without any trigger are
passed over by one native scan each.

Null and empty texts have no spans; repeated rows are treated alike. Other columns pass
through, except those the operator writes. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

KINDS = ("assign", "access", "hex")
_FLAGS = re.IGNORECASE | re.ASCII
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", _FLAGS)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

# what the weak candidates look like
_SHORT_ID = re.compile(r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{4,}")
_NAME = re.compile(r"\b(?:access[_ -]?key(?:[_ -]?id)?|client[_ -]?id|account|user(?:name)?|login)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.@-]{3,})", _FLAGS)
_ENDPOINT = re.compile(r"\b(?:https?|ftp|sftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp|jdbc:\w+|s3)://[^\s\"'<>]+|\b(?:host|endpoint|server|base_?url)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._:/-]{4,})", _FLAGS)
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_SCOPE = re.compile(r"\n[ \t\r]*\n")

# cheap scans for whole batches; each holds for every text in which the pattern after it can match
_HAS_ASSIGN = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']? *[:=]"
_HAS_STRONG = r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}"
_HAS_WEAK = r"(?i)(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{4}|://|(?:key|id|account|user|username|login|host|endpoint|server|url)[\"']? *[:=]"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strong finds, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _random_looking(word: str) -> bool:
    """Three bits or more a character, and letters beside digits or both cases."""
    n = len(word)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(word).values())
    mixed = any(c.isdigit() for c in word) and any(c.isalpha() for c in word)
    return bits >= 3 and mixed


class _Places:
    """Places of one role; says how far the nearest one in a scope is from a span."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.start = np.sort(np.array([s for s, _ in spans], np.int64))
        self.end = np.sort(np.array([e for _, e in spans], np.int64))

    def near(self, span: tuple[int, int], low: int, high: int) -> int | None:
        """Code points between a span and the nearest place inside low to high, 0 where they touch; None without any."""
        if not np.searchsorted(self.start, high, "left") > np.searchsorted(self.end, low, "right"):
            return None
        if np.searchsorted(self.start, span[1], "right") > np.searchsorted(self.end, span[0], "left"):
            return 0
        k, j = int(np.searchsorted(self.start, span[1], "right")), int(np.searchsorted(self.end, span[0], "left"))
        after = int(self.start[k]) - span[1] if k < len(self.start) and self.start[k] < high else None
        before = span[0] - int(self.end[j - 1]) if j and self.end[j - 1] > low else None
        return min(d for d in (after, before) if d is not None)


def linked_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, distance) of the weak candidates whose complementary parts co-occur."""
    names = [(m.start(), m.end()) for m in _NAME.finditer(text)] + [(m.start(), m.end()) for m in _SHORT_ID.finditer(text)]
    names += [(s, e) for s, kind, e in base if kind == 1]
    endpoints = [(m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    short = [(m.start(), m.end()) for m in ASSIGN.finditer(text) if 4 <= len(m[2]) < 12]
    if not names and not endpoints:
        return []
    loose = [(m.start(), m.end()) for m in _RANDOM.finditer(text) if _random_looking(m[0])]
    strong = [(s, e) for s, kind, e in base if kind != 1]
    cuts = np.array([0] + [m.start() for m in _SCOPE.finditer(text)] + [len(text)])
    by_name, by_endpoint, by_secret = _Places(names), _Places(endpoints), _Places(strong + short + loose)

    def to(places, span):
        k = int(np.searchsorted(cuts, span[0], "right"))
        return places.near(span, int(cuts[k - 1]), int(cuts[min(k, len(cuts) - 1)]))

    out = set()
    for span in names:
        if (far := to(by_secret, span)) is not None:
            out.add((*span, "identifier", far))
    for span in short + loose:
        found = [d for d in (to(by_name, span), to(by_endpoint, span)) if d is not None]
        if found:
            out.add((*span, "secret", min(found)))
    for span in endpoints:
        found = [to(by_secret, span), to(by_name, span)]
        if None not in found:
            out.add((*span, "endpoint", max(found)))
    starts = [s for s, _, _ in base]
    reached = list(accumulate((e for _, _, e in base), max))

    def inside(span):
        k = bisect_right(starts, span[0])
        return k > 0 and reached[k - 1] >= span[1]

    return sorted(x for x in out if not inside(x))


SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("kind", StringType()), StructField("distance", IntegerType())])


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` (strong finds by start, then kind) and ``spans`` (with the linked candidates; strong finds have no distance)."""
    kept = [f for f in docs.schema.fields if f.name not in ("base", "spans")]
    schema = StructType(kept + [StructField("base", ArrayType(SPAN)), StructField("spans", ArrayType(SPAN))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("distance", pa.int32())]))

    def run(batches):
        for batch in batches:
            column = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
            hit = [pc.match_substring_regex(column, p).to_numpy(zero_copy_only=False) for p in (_HAS_ASSIGN, _HAS_STRONG, _HAS_WEAK)]
            strong, weak = hit[0] | hit[1], hit[2]
            base, spans = [[] for _ in range(len(column))], [[] for _ in range(len(column))]
            for i in np.flatnonzero(strong | weak):
                value = column[int(i)].as_py()
                found = base_spans(value) if strong[i] else []
                base[i] = [{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in found]
                more = [{"start": s, "end": e, "kind": k, "distance": d} for s, e, k, d in linked_spans(value, found)] if weak[i] else []
                rank = {k: r for r, k in enumerate((*KINDS, "identifier", "secret", "endpoint"))}
                spans[i] = sorted(base[i] + more, key=lambda s: (s["start"], rank[s["kind"]], s["end"]))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + [pa.array(base, kind), pa.array(spans, kind)],
                                             names=schema.names)

    return docs.mapInArrow(run, schema)
