"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every text version is addressed by its SHA-256 (the blob). The ledger is a Parquet table with one row per scan of a blob:
which rules (``name@version``) ran and what they found. A run hashes all rows, keeps one row per blob, drops the blob and rule
pairs that the ledger has, scans the rest, appends the new scans, and joins the findings back to every row (path) of the blob.
Copies of a blob are scanned once, and a rule that gets a new version is run again, alone.

Equal blobs meet in one group of the deduplication, which drops copies before the shuffle too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import in_order, matches, replace_spans

FINDINGS = "array<struct<start:int,kind:string,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A pattern, a cheap test that holds wherever it can match, and a test of each match."""

    name: str
    version: int
    pattern: str
    might: Callable[[Column], Column]
    keep: Callable[[Column], Column] = lambda m: F.lit(True)

    @property
    def id(self) -> str:
        return f"{self.name}@{self.version}"


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
#: access and hex: a failing match is a whole run that is too short, so the least length stands in the pattern
RULES = [
    Rule("assign", 1, _ASSIGN, lambda t: t.rlike("[:=]") & t.rlike("(?i)password|passwd|secret|token|api_?key"), lambda m: F.length(F.regexp_extract(m, _ASSIGN, 1)) >= 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}+", lambda t: t.contains("AKIA")),
    Rule("hex", 1, r"[0-9a-f]{24,}+", lambda t: t.rlike("[0-9a-f]{24}")),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", lambda t: t.contains("-----BEGIN ")),
    Rule("platform_token", 1, r"(?:gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+)", lambda t: t.rlike("gh[pousr]_|xox[abprs]-")),
    Rule("signed_token", 1, r"eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", lambda t: t.contains("eyJ")),
]


def _findings(text: Column, rule: Rule) -> Column:
    found = F.filter(matches(text, rule.pattern, rule.might(text)), lambda s: rule.keep(s["m"]))
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rule.name).alias("kind"), s["end"].alias("end")))


def blob_of(text: Column) -> Column:
    """Content address of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _read_ledger(docs: DataFrame, path: str) -> DataFrame | None:
    try:
        return docs.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def update_ledger(docs: DataFrame, ledger: str, text: str = "text", rules: list[Rule] = RULES) -> int:
    """Scans what the ledger lacks of these rows and appends it; returns the number of ledger rows written.

    The ledger may be missing at first. Rows: blob, rules (ids that ran), findings.
    """
    wanted = F.array(*(F.lit(r.id) for r in rules))
    blobs = docs.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["blob"])
    known = _read_ledger(docs, ledger)
    if known is None:
        todo = blobs.withColumn("rules", wanted)
    else:
        seen = known.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # as many as there are rules
        todo = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).drop("seen").where(F.size("rules") > 0)
    for i, rule in enumerate(rules):
        todo = todo.withColumn(f"f{i}", F.when(F.array_contains("rules", rule.id), _findings(F.col("text"), rule)).otherwise(F.array().cast(FINDINGS)))
    scans = todo.select("blob", "rules", F.concat(*(F.col(f"f{i}") for i in range(len(rules)))).alias("findings"))
    scans.write.mode("append").parquet(ledger)
    return scans.sparkSession.read.parquet(ledger).count()


def ledger_findings(docs: DataFrame, ledger: str, rules: list[Rule] = RULES) -> DataFrame:
    """blob, findings of these rules (only blobs with any), out of all scans of the ledger."""
    known = docs.sparkSession.read.parquet(ledger)
    ids = F.array(*(F.lit(r.id) for r in rules))
    names = F.array(*(F.lit(r.name) for r in rules))
    # a scan that ran a rule in an older version does not speak for its name
    current = known.where(F.arrays_overlap("rules", ids)).where(F.size("findings") > 0)
    told = F.transform(F.array_intersect("rules", ids), lambda r: F.split_part(r, F.lit("@"), F.lit(1)))
    hits = current.select("blob", F.explode(F.filter("findings", lambda s: F.array_contains(told, s["kind"]) & F.array_contains(names, s["kind"]))).alias("hit"))
    return hits.groupBy("blob").agg(F.collect_set("hit").alias("findings"))  # the findings of one text


def scan_secrets(docs: DataFrame, ledger: str, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``doc`` (struct of the columns of ``docs`` but the text) and ``findings``, an array of (start, rank, end, kind) in code points, by start and rule order.

    Null or empty texts are one blob without findings; repeated rows share one scan and each get the findings; an empty table writes an empty ledger.
    Columns of ``docs`` may have any names.
    """
    update_ledger(docs, ledger, text, rules)
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*rest).alias("doc"), blob_of(F.col(text)).alias("blob"))
    joined = rows.join(ledger_findings(docs, ledger, rules), "blob", "left")
    return joined.select("doc", in_order(F.coalesce("findings", F.array().cast(FINDINGS)), [r.name for r in rules]).alias("findings"))


def redact_secrets(docs: DataFrame, ledger: str, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` with every finding replaced by its rule's name in brackets; clean texts stay as they are."""
    update_ledger(docs, ledger, text, rules)
    rows = docs.select(F.struct("*").alias("doc"), F.col(text).alias("text"), blob_of(F.col(text)).alias("blob"))
    joined = rows.join(ledger_findings(docs, ledger, rules), "blob", "left")
    clean = F.when(F.col("findings").isNull(), F.col("text")).otherwise(replace_spans(F.col("text"), in_order(F.col("findings"), [r.name for r in rules])))
    return joined.select("doc", clean.alias("text")).select(*(F.col("text").alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns))
