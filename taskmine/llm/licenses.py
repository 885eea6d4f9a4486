"""Licence mentions: ordered signature rules behind a keyword prefilter, with built-in functions only.

Hundreds of signatures (families, their versions, the ways to write both) are patterns
with a label, a priority and a keyword. A text without any keyword is done after one
scan. Of other texts the rules whose keyword they hold are matched on the whole text: between
the words of a name or notice stands whatever is no letter or digit, so line ends and comment
marks do not part them (but a version never follows the end of a sentence). Of overlapping detections the one of higher priority stands;
at equal priority one that lies inside another goes.

Besides, base phrases are found as consecutive words, whatever stands between the words
(line ends too). A word is a run of digits, ASCII letters and non-ASCII characters.

Null and empty texts have no words and no labels. Equal texts and repeated rows are
treated alike. Other columns pass through, except those the operator writes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from taskmine.llm.native import matches

# fixed values: phrases of consecutive words, and their labels
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
PHRASE_GATES = ["license", "license", "nc"]

_IN = r"0-9A-Za-z\x80-\x{10FFFF}"
_WORD = rf"[{_IN}]+"
_GAP = rf"[^{_IN}]+"
_BETWEEN = r"[^0-9A-Za-z\p{L}]"  # between the words of a rule

# fixed values: label stem, written names (patterns), versions, keyword, priority
FAMILIES = [
    ("gpl", [r"gnu general public licen[cs]e", r"general public licen[cs]e", r"gnu gpl", r"gpl"], ["1.0", "2.0", "3.0"], "gpl|general public", 60),
    ("lgpl", [r"gnu (?:lesser|library) general public licen[cs]e", r"(?:lesser|library) general public licen[cs]e", r"gnu lgpl", r"lgpl"], ["2.0", "2.1", "3.0"], "lgpl|general public", 80),
    ("agpl", [r"gnu affero general public licen[cs]e", r"affero general public licen[cs]e", r"gnu agpl", r"agpl"], ["1.0", "3.0"], "agpl|affero", 80),
    ("gfdl", [r"gnu free documentation licen[cs]e", r"free documentation licen[cs]e", r"gfdl"], ["1.1", "1.2", "1.3"], "gfdl|free documentation", 60),
    ("apache", [r"apache (?:software )?licen[cs]e", r"apache"], ["1.0", "1.1", "2.0"], "apache", 70),
    ("mpl", [r"mozilla public licen[cs]e", r"mpl"], ["1.0", "1.1", "2.0"], "mpl|mozilla", 60),
    ("epl", [r"eclipse public licen[cs]e", r"epl"], ["1.0", "2.0"], "epl|eclipse", 60),
    ("cddl", [r"common development and distribution licen[cs]e", r"cddl"], ["1.0", "1.1"], "cddl|common development", 60),
    ("eupl", [r"european union public licen[cs]e", r"eupl"], ["1.0", "1.1", "1.2"], "eupl|european union", 60),
    ("osl", [r"open software licen[cs]e", r"osl"], ["1.0", "2.0", "2.1", "3.0"], "osl|open software", 50),
    ("afl", [r"academic free licen[cs]e", r"afl"], ["1.1", "1.2", "2.0", "2.1", "3.0"], "afl|academic free", 50),
    ("artistic", [r"artistic licen[cs]e"], ["1.0", "2.0"], "artistic", 50),
    ("lppl", [r"latex project public licen[cs]e", r"lppl"], ["1.0", "1.1", "1.2", "1.3"], "lppl|latex project", 50),
    ("cc0", [r"creative commons zero", r"cc ?0"], ["1.0"], "cc0|cc 0|creative commons", 70),
    *[(f"cc-{'-'.join(p)}", [rf"cc[ -]{'[ -]'.join(p)}", "creative commons " + r"[ -]".join(long)], ["1.0", "2.0", "2.5", "3.0", "4.0"], "cc|creative commons", 40 + 10 * len(p))
      for p, long in ((("by",), ("attribution",)), (("by", "sa"), ("attribution", "share ?alike")), (("by", "nd"), ("attribution", "no ?deriv(?:ative)?s?(?: works)?")),
                      (("by", "nc"), ("attribution", "non ?commercial")), (("by", "nc", "sa"), ("attribution", "non ?commercial", "share ?alike")),
                      (("by", "nc", "nd"), ("attribution", "non ?commercial", "no ?deriv(?:ative)?s?(?: works)?")))],
    ("psf", [r"python software foundation licen[cs]e", r"psf licen[cs]e"], ["2.0"], "psf|python software", 50),
    ("zpl", [r"zope public licen[cs]e", r"zpl"], ["1.1", "2.0", "2.1"], "zpl|zope", 50),
    ("php", [r"php licen[cs]e"], ["3.0", "3.01"], "php", 50),
    ("ms", [r"microsoft (?:public|reciprocal) licen[cs]e", r"ms-?(?:pl|rl)"], ["1.0"], "ms-pl|ms-rl|mspl|microsoft", 50),
    ("bsl", [r"boost software licen[cs]e", r"bsl"], ["1.0"], "bsl|boost", 50),
    ("ofl", [r"sil open font licen[cs]e", r"open font licen[cs]e", r"ofl"], ["1.0", "1.1"], "ofl|open font", 50),
]
# fixed values: label, pattern, keyword, priority of licences without versions
SINGLE = [
    ("mit", r"\bmit licen[cs]e\b", "mit licen", 50), ("mit", r"\blicen[cs]ed? under (?:the )?mit\b", "licen", 50), ("mit", r"\bmit/x11\b", "mit/x11", 50),
    ("mit", r"permission is hereby granted, free of charge", "free of charge", 60), ("mit", r"the software is provided [\"'“]?as is[\"'”]?, without warranty of any kind", "as is", 40),
    ("bsd-2-clause", r"\b(?:2|two|simplified)[ -]?(?:clause )?bsd\b", "bsd", 60), ("bsd-2-clause", r"\bbsd[ -](?:2|two|simplified)(?:[ -]clause)?\b", "bsd", 60),
    ("bsd-3-clause", r"\b(?:3|three|new|modified)[ -]?(?:clause )?bsd\b", "bsd", 60), ("bsd-3-clause", r"\bbsd[ -](?:3|three|new|modified)(?:[ -]clause)?\b", "bsd", 60),
    ("bsd-4-clause", r"\b(?:4|four|original)[ -]?(?:clause )?bsd\b", "bsd", 60), ("bsd-4-clause", r"\bbsd[ -](?:4|four|original)(?:[ -]clause)?\b", "bsd", 60),
    ("bsd", r"\bbsd licen[cs]e\b", "bsd", 40), ("bsd", r"redistribution and use in source and binary forms", "redistribution", 40),
    ("bsd-3-clause", r"neither the name of (?s:.{1,80}) nor the names of its contributors", "neither the name", 50),
    ("isc", r"\bisc licen[cs]e\b", "isc", 50), ("isc", r"permission to use, copy, modify, and(?:/or)? distribute this software", "permission to use", 50),
    ("zlib", r"\bzlib(?:/libpng)? licen[cs]e\b", "zlib", 50), ("unlicense", r"\bthe unlicense\b|\bunlicense\.org\b", "unlicense", 50),
    ("unlicense", r"free and unencumbered software released into the public domain", "unencumbered", 60),
    ("wtfpl", r"\bwtfpl\b|do what the f\w+ you want", "wtfpl", 50), ("public-domain", r"\bin(?:to)? the public domain\b", "public domain", 30),
    ("beerware", r"\bbeer-?ware\b", "beer", 50), ("proprietary", r"\ball rights reserved\b", "all rights reserved", 20), ("proprietary", r"\bproprietary and confidential\b", "proprietary", 30),
    ("copyright", r"\bcopyright (?:\(c\)|©)? ?\d{4}", "copyright", 10), ("copyright", r"(?:\(c\)|©) ?\d{4}", "(c)", 10),
    ("other-license", r"\blicen[cs]ed under\b", "licen", 5), ("other-license", r"\breleased under\b", "released under", 5), ("other-license", r"\blicen[cs]e\b", "licen", 1),
    ("spdx", r"spdx-license-identifier: ?\S+", "spdx", 5),
]


def _spread(pattern: str) -> str:
    """The pattern with any gap between words in place of single spaces."""
    for written, times in (("[ -]?", "*"), ("[ -]", "+"), (" ?", "*"), (" ", "+")):
        pattern = pattern.replace(written, _BETWEEN + times)
    return pattern


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, pattern), the highest priority first; patterns are for lower-case text."""
    out = [(label, priority, keyword, pattern if label == "spdx" else _spread(pattern)) for label, pattern, keyword, priority in SINGLE]
    for stem, names, versions, gate, priority in FAMILIES:
        for keyword in gate.split("|"):
            mine = [n for n in names if keyword in n.replace("[cs]", "c").replace("[ -]", " ").replace("(?:software )?", "")] or names
            for name in mine:
                out.append((stem, priority, keyword, rf"(?<![\w-]){_spread(name)}(?![\w])"))
                for version in versions:
                    number = version.removesuffix(".0").replace(".", r"\.") + (r"(?:\.0)?" if version.endswith(".0") else "")
                    gap = _BETWEEN.replace("]", ".!?;]") + "*"
                    between = rf"{gap}(?:licen[cs]e{gap})?(?:version{gap}|ver\.?{gap}|v\.?{gap})?"
                    out.append((f"{stem}-{version.removesuffix('.0')}", priority + 5, keyword, rf"(?<![\w-]){_spread(name)}{between}{number}(?![\w]|\.\d)"))
    return sorted(set(out), key=lambda r: (-r[1], r))


def _phrase(words: str) -> str:
    return rf"(?i)(?<![{_IN}])" + _GAP.join(words.split(" ")) + rf"(?![{_IN}])"


def count_words(text: Column) -> Column:
    return F.size(F.split(text, _WORD, -1)) - 1


def phrase_places(text: Column) -> Column:
    """(start, end, label) of the base phrases, by start; code points."""
    low = F.lower(text)
    out = []
    for (words, label), gate in zip(PHRASES, PHRASE_GATES):
        named = F.lit(label).alias("label")
        found = F.transform(matches(text, _phrase(words)), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), named))  # noqa: B023
        out.append(F.when(F.contains(low, F.lit(gate)), found).otherwise(F.array().cast("array<struct<start:int,end:int,label:string>>")))
    return F.array_sort(F.concat(*out))


_KEYWORDS = sorted({rule[2] for rule in rules()})
_GATE = "(?i)(?<![0-9A-Za-z])(?:" + "|".join(k.replace(".", r"\.").replace(" ", _BETWEEN + "+") for k in _KEYWORDS if k[0].isalnum()) + r")|\(c\)|©"
_DETECTIONS = "array<struct<start:int,end:int,label:string,priority:int>>"


def rule_detections(text: Column) -> Column:
    """(start, end, label, priority): what the rules find in the whole text, after suppression; code points."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")  # of one length with the text

    def of(label: str, priority: int, keyword: str, pattern: str, x: Column) -> Column:
        # each pattern is a literal of its own, which Spark compiles once, and runs only behind its keyword
        plain = re.sub(r"[^0-9a-z]+", " ", keyword).strip()
        rule = F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(pattern).alias("pattern"))
        return F.when(F.contains(x["flat"], F.lit(plain)) & F.rlike(x["low"], F.lit(pattern)), rule)

    def found_in(x):
        hits = F.filter(F.array(*[of(*rule, x) for rule in rules()]), lambda rule: rule.isNotNull())
        return F.flatten(F.transform(hits, lambda rule: F.transform(matches(x["low"], rule["pattern"]), lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), rule["label"].alias("label"), rule["priority"].alias("priority")))))

    views = F.transform(F.array(low), lambda t: F.struct(t.alias("low"), F.regexp_replace(t, _BETWEEN + "+", " ").alias("flat")))
    groups = F.flatten(F.transform(views, lambda x: _groups(F.array_distinct(found_in(x)))))
    return F.flatten(F.transform(groups, _suppressed))


def _groups(found: Column) -> Column:
    """Arrays of detections that overlap, directly or by others; only these can suppress each other."""
    start = F.struct(F.array().cast(f"array<{_DETECTIONS}>").alias("done"), F.array().cast(_DETECTIONS).alias("group"), F.lit(0).alias("reach"))

    def add(state, one):
        joined = F.struct(state["done"].alias("done"), F.concat(state["group"], F.array(one)).alias("group"), F.greatest(state["reach"], one["end"]).alias("reach"))
        opened = F.struct(F.concat(state["done"], F.array(state["group"])).alias("done"), F.array(one).alias("group"), one["end"].alias("reach"))
        return F.when(one["start"] < state["reach"], joined).otherwise(opened)

    return F.aggregate(F.sort_array(found), start, add, lambda state: F.concat(state["done"], F.array(state["group"])))


def _suppressed(found: Column) -> Column:
    """Without what overlaps a detection of higher priority, or lies inside one of equal priority."""
    def loses(one, other):
        overlap = (one["start"] < other["end"]) & (other["start"] < one["end"])
        inside = (other["start"] <= one["start"]) & (one["end"] <= other["end"]) & (
            (one["end"] - one["start"] < other["end"] - other["start"]) | ((one["end"] - one["start"] == other["end"] - other["start"]) & (other["label"] < one["label"])))
        return (overlap & (other["priority"] > one["priority"])) | ((other["priority"] == one["priority"]) & inside)

    return F.filter(found, lambda one: ~F.exists(found, lambda other: loses(one, other)))


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``places`` of the base phrases (with first and last word), ``detections`` of the rules and ``score``.

    The score is the share of certainty of the best mention: 1 for a base phrase, else the
    highest priority of a detection over 100; 0 without any.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    staged = docs.withColumn("_gated", F.rlike(whole, F.lit(_GATE))).withColumn("n_words", count_words(whole).cast("long"))
    staged = staged.withColumn("places", F.when(F.col("_gated"), phrase_places(whole)).otherwise(F.array().cast("array<struct<start:int,end:int,label:string>>")))
    staged = staged.withColumn("detections", F.when(F.col("_gated"), rule_detections(whole)).otherwise(F.array().cast(_DETECTIONS)))
    first, last = F.col("places")[0]["start"], F.element_at("places", -1)["start"]
    some = F.size("places") > 0
    staged = staged.withColumn("first_word", F.when(some, count_words(F.substr(whole, F.lit(1), first)).cast("long")))
    staged = staged.withColumn("last_word", F.when(some, count_words(F.substr(whole, F.lit(1), last)).cast("long")))
    best = F.array_max(F.transform("detections", lambda d: d["priority"])) / 100
    return staged.withColumn("score", F.when(some, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0)))).drop("_gated")
