"""Secrets in texts, over an incremental ledger of blobs; DataFrame functions only.

A text is a blob, addressed by its SHA-256.  A scan looks only at pairs of blob and
rule version that the ledger lacks, adds what it finds, and joins findings back to
every row (path, version) with that blob, so that a history of mostly unchanged
files costs one scan for each content.

Positions without a regex engine's offsets: a text is its gaps and matches in turn
(`split` and `regexp_extract_all` agree on what matches), so running sums of their
lengths are the spans, in code points, end exclusive.

Defined results: null counts as empty, and stays null where texts are redacted; rows
repeat with their findings; a table without rows gives none; extra columns stay, but for
`blob` and `findings` where these are added; a null key is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import field, scratch_path, stored, whole_row


@dataclass(frozen=True)
class Rule:
    """kind; pattern; least: how long the match, or its group, has to be; hint: what a text with a match contains."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    hint: str | None = None


# The kinds of secrets, the base kinds first, in the order of their spans.
RULES = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, group=2),
    Rule("access", r"AKIA[A-Z0-9]+", 20, hint="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, hint="PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 1, hint="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 1, hint="xox"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", 1, hint="eyJ"),
)
BASE_KINDS = ("assign", "access", "hex")
RULE_VERSION = "1"
#: Matches whose spans are gathered in one array before it is joined to the others.
SPANS_AT_ONCE = 256


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (begin, end, kind's place, kind) of a rule's leftmost matches that are long enough."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    kind = "array<struct<begin:int,end:int,place:int,kind:string>>"
    empty = F.array().cast(kind)

    def step(done: Column, pair: Column) -> Column:
        begin = done["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["match"])
        long = F.length(F.regexp_extract(pair["match"], rule.pattern, rule.group)) if rule.group else F.length(pair["match"])
        span = F.struct(begin.alias("begin"), end.alias("end"), F.lit(order).alias("place"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(long >= rule.least, F.array_append(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    def shifted(part: Column, base: Column) -> Column:
        return F.transform(part["spans"], lambda s: F.struct((s["begin"] + base).alias("begin"), (s["end"] + base).alias("end"), s["place"].alias("place"), s["kind"].alias("kind")))

    pairs = F.arrays_zip(gaps.alias("gap"), matches.alias("match"))
    pairs = F.filter(pairs, lambda p: p["match"].isNotNull())  # the last gap has no match after it
    # Appending copies an array, so spans are gathered SPANS_AT_ONCE matches at a time, and then moved to their part's begin.
    starts = F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(SPANS_AT_ONCE))
    parts = F.transform(starts, lambda at: F.aggregate(F.slice(pairs, at, SPANS_AT_ONCE), F.struct(F.lit(0).alias("at"), empty.alias("spans")), step))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("bases"))
    bases = F.aggregate(parts, none, lambda done, part: F.struct((done["at"] + part["at"]).alias("at"), F.array_append(done["bases"], done["at"]).alias("bases")), lambda done: done["bases"])
    found = F.flatten(F.zip_with(parts, bases, shifted))
    present = F.contains(text, F.lit(rule.hint)) if rule.hint else F.lit(True)
    return F.when(present & F.regexp_like(text, F.lit(rule.pattern)), found).otherwise(empty)


def scan(blobs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blobs with findings: array of (begin, end, place, kind) in the order of begin, then of rules."""
    each = [_spans(field(text), rule, i) for i, rule in enumerate(rules)]
    # Sorted by begin, then place.
    by_place = F.transform(F.concat(*each), lambda s: F.struct(s["begin"].alias("begin"), s["place"].alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    return blobs.withColumn("findings", F.array_sort(by_place))


class BlobLedger:
    """What has been scanned: a table of (blob, rule_version, findings), appended to in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(self.path) if self._exists() else None

    def scan_unseen(self, blobs: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
        """Scan those of blobs (blob, text) that the ledger lacks at this version, and return the ledger at this version.

        One content may stand in blobs many times; it is scanned once.
        """
        known = self.read()
        unseen = blobs
        if known is not None:
            unseen = blobs.join(known.filter(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
        found = scan(unseen.groupBy("blob").agg(F.first("text").alias("text")), rules=rules)
        found.select("blob", F.lit(version).alias("rule_version"), "findings").write.mode("append").parquet(self.path)
        # Only what was asked for; a blob that two scans wrote at once counts once.
        asked = self.read().filter(F.col("rule_version") == version)
        if known is not None:
            asked = asked.join(blobs.select("blob").distinct(), "blob", "left_semi")
        return asked.dropDuplicates(["blob"])


def _blob(text: str) -> Column:
    return F.sha2(F.coalesce(field(text), F.lit("")), 256)


def _scanned(docs: DataFrame, text: str, ledger: BlobLedger | None, rules: tuple[Rule, ...], version: str) -> DataFrame:
    ledger = ledger or BlobLedger(docs.sparkSession, scratch_path(docs.sparkSession, "ledger"))
    found = ledger.scan_unseen(docs.select(_blob(text).alias("blob"), F.coalesce(field(text), F.lit("")).alias("text")), rules, version)
    # Written, so that a join with it is one of plain exchanges, of which Spark splits the skewed.
    return stored(found.select("blob", "findings"), "findings")


def find_secrets(docs: DataFrame, text: str = "text", ledger: BlobLedger | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """docs without text, with blob and findings."""
    own = [c for c in docs.columns if c != text and c.lower() not in ("blob", "findings")]
    paths = docs.select(_blob(text).alias("blob"), whole_row(docs, (text,)).alias("row"))
    return paths.join(_scanned(docs, text, ledger, rules, version), "blob").select(*[field(c, "row").alias(c) for c in own], "blob", "findings")


def redact_secrets(docs: DataFrame, text: str = "text", ledger: BlobLedger | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """docs with each run of overlapping findings replaced by [KIND]; other texts, and all other columns, stay as they are."""
    hits = stored(_scanned(docs, text, ledger, rules, version).filter(F.size("findings") > 0), "hits")
    few = hits.count() <= BROADCAST_BLOBS
    paths = docs.select(_blob(text).alias("blob"), field(text).alias("whole"), whole_row(docs, (text,)).alias("row"))
    joined = paths.join(F.broadcast(hits) if few else hits, "blob", "left")
    whole = F.col("whole")

    def step(done: Column, s: Column) -> Column:
        begin = F.greatest(s["begin"], done["at"])
        # A span inside what is cut already adds nothing; one that reaches further extends the cut.
        new = s["begin"] >= done["at"]
        mark = F.concat(F.substring(whole, done["at"] + 1, begin - done["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(s["end"], done["at"]).alias("at"), F.when(new, F.concat(done["out"], mark)).otherwise(done["out"]).alias("out"))

    cut = F.aggregate("findings", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda done: F.concat(done["out"], F.substring(whole, done["at"] + 1, F.length(whole))))
    clean = F.when(F.col("findings").isNull() | whole.isNull(), whole).otherwise(cut)
    return joined.select(*[clean.alias(c) if c == text else field(c, "row").alias(c) for c in docs.columns])


#: Blobs with findings that are broadcast at most (a few hundred bytes each).
BROADCAST_BLOBS = 200_000


def joined_spans(findings: Column) -> Column:
    """kind:begin:end of findings, comma-joined."""
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(kinds: tuple[str, ...]) -> Column:
    return F.filter("findings", lambda s: s["kind"].isin(*kinds))
