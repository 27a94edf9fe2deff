"""License scans by ordered signature rules, in DataFrame functions only.

A text becomes its words in lower case with one blank between two. Only texts that hold one of a few stems are looked at
further; there, a rule's pattern runs only if all its keywords stand in the text. Each match is a detection: an interval of words
with the rule's label, priority and confidence. A detection inside the interval of another one of the same or a higher priority is suppressed
(equal intervals: the higher priority stays, then the earlier rule), so "general public license" inside "lesser general public license" and a name inside
a grant say nothing of their own. Base phrases are never suppressed.

Rules are data (``license_rules``): they meet a text as rows, so a text that needs no rule costs one pass. Only words' positions are shuffled, one row
per detection and one per document, to find what contains what by a running maximum over the detections of one text.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import license_rules as R
from .spans import let, matches

#: what stands between words
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DETECTIONS = "array<struct<start:int,end:int,label:string,kind:string,rule:int,base:boolean>>"


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    keywords: tuple[str, ...]
    pattern: str
    base: bool = False


def default_rules() -> list[Rule]:
    """Base phrases, tags, the written signatures, and a notice rule for each title."""
    rules = [Rule(label, "notice", tuple(w for w in phrase.split() if w not in ("the", "under", "version")), phrase, True) for label, phrase in R.BASE]
    for tag in R.TAGS.split():
        label, _, words = tag.partition(":")
        words = (words or label).replace("_", " ")
        rules.append(Rule(label, "tag", ("spdx", words.split()[0]), f"spdx licen[cs]e identifier {words}(?: only| or later)?"))
    written = [Rule(label, kind, tuple(keywords.split()), pattern) for label, kind, keywords, pattern in
               (map(str.strip, line.split(" | ")) for line in R.SIGNATURES.strip().split("\n"))]
    notices = [Rule(r.label, "notice", r.keywords, f"{R.GRANT}{R.TERMS} (?:{r.pattern})") for r in written if r.kind == "title"]
    return rules + written + notices


def words_of(text: Column) -> Column:
    """The words of a text with one blank between two, as they are written; '' if there are none."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " "))


def _blanks(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _rows(rules: list[Rule]) -> Column:
    rows = [{"rule": i, "label": r.label, "kind": r.kind, "priority": R.KINDS[r.kind][0], "keywords": list(r.keywords), "pattern": f" (?:{r.pattern})(?= )", "base": r.base}
            for i, r in enumerate(rules)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<rule:int,label:string,kind:string,priority:int,keywords:array<string>,pattern:string,base:boolean>>")


def _starts_word(text: Column, stem: Column) -> Column:
    return F.contains(text, F.concat(F.lit(" "), stem))


def _wanted(words: Column, rules: list[Rule]) -> Column:
    """The rules whose keywords all stand in the words."""
    strings = lambda xs: F.array(*(F.lit(x) for x in xs))
    known = sorted({k for r in rules for k in r.keywords})

    def chosen(text: Column) -> Column:
        found = F.filter(strings(known), lambda k: _starts_word(text, k))
        return let(found, lambda ks: F.filter(_rows(rules), lambda r: F.forall(r["keywords"], lambda k: F.array_contains(ks, k))))

    gate = lambda text: F.exists(strings(R.STEMS), lambda s: _starts_word(text, s))
    return let(F.concat(F.lit(" "), F.lower(words), F.lit(" ")), lambda text: F.when(gate(text), chosen(text)))


def find_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Per row: key, n_words, detections (start and end word, label, kind, rule, base; by start, then end) after suppression.

    Null or blank text: no words, no detections. Repeated rows and null keys are rows of their own; other columns are not read; an
    empty table gives no rows. One very long text is searched whole, in linear time.
    """
    rules = default_rules() if rules is None else rules
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words_of(F.col(text)).alias("words"))
    rows = rows.select("row", "key", F.when(F.col("words") == "", 0).otherwise(_blanks(F.col("words")) + 1).cast("long").alias("n_words"), "words", _wanted(F.col("words"), rules).alias("wanted"))
    lowered = F.when(F.size("wanted") > 0, F.concat(F.lit(" "), F.translate("words", UPPER, LOWER), F.lit(" ")))
    # a first entry without a rule keeps the documents that have no detection
    none = F.array(F.lit(None)).cast(_kind_of(rows, "wanted"))
    rows = rows.select("row", "key", "n_words", lowered.alias("words"), F.explode(F.concat(none, F.coalesce("wanted", F.array().cast(_kind_of(rows, "wanted"))))).alias("r"))
    found = F.transform(matches(F.col("words"), F.col("r.pattern"), F.lit(True), _blanks), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    once = F.array(F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")))
    hits = rows.select("row", "key", "n_words", "r.rule", "r.label", "r.kind", "r.priority", "r.base", F.explode(F.when(F.col("r").isNull(), once).otherwise(found)).alias("m"))
    hits = hits.select("row", "key", "n_words", "rule", "label", "kind", "priority", "base", "m.start", "m.end")
    # whatever contains a detection and is not weaker comes before it in this order
    before = Window.partitionBy("row").orderBy("start", F.col("end").desc(), F.col("priority").desc(), "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({R.KINDS[r.kind][0] for r in rules})
    reach = [F.max(F.when(F.col("priority") >= p, F.col("end"))).over(before) for p in levels]
    inside = F.coalesce(*(F.when(F.col("priority") == p, over >= F.col("end")) for p, over in zip(levels, reach, strict=True)), F.lit(False)) if levels else F.lit(False)
    kept = hits.withColumn("inside", inside).where(F.col("start").isNull() | F.col("base") | ~F.col("inside"))
    one = F.when(F.col("start").isNotNull(), F.struct("start", "end", "label", "kind", "rule", "base"))
    return kept.groupBy("row").agg(F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.collect_list(one).alias("d")).select(
        F.col("key").alias(key), "n_words", F.array_sort("d").cast(DETECTIONS).alias("detections"))


def _kind_of(df: DataFrame, column: str):
    return df.schema[column].dataType


def labels_of(detections: Column) -> Column:
    """Distinct labels, sorted."""
    return F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"])))


def confidence(detections: Column) -> Column:
    """Of the strongest detection; 0 without any."""
    of = F.create_map(*(x for k, (_, c) in R.KINDS.items() for x in (F.lit(k), F.lit(c))))
    return F.coalesce(F.array_max(F.transform(detections, lambda d: of[d["kind"]])), F.lit(0.0))
