"""Findings in texts: personal data by rule, hashed findings, allow lists, redaction."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules for personal data as (rule, pattern, entity type, confidence), in the order in which they apply.
PII_RULES = (
    ("github_url_username", r"github\.com/([A-Za-z0-9_.-]{2,})", "username", 0.85),
    ("github_raw_url_username", r"raw\.githubusercontent\.com/([A-Za-z0-9_.-]{2,})", "username", 0.85),
    ("email", r"([A-Za-z0-9_.+-]{3,}@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", "email", 0.90),
    ("email_truncated", r"([A-Za-z0-9_.+-]{3,})@(?=\s|$)", "email", 0.75),
    ("telegram_bot_token", r"(\d{8,}:[A-Za-z0-9_-]{30,})", "custom_sensitive", 0.95),
    ("personal_hostname", r"\b([a-z][a-z0-9]*s?-(?:macbook|imac|laptop|desktop|pc|workstation|server)-?[a-z0-9]*)\b", "device_id", 0.80),
    ("home_dir_path", r"(/(?:Users|home)/[A-Za-z0-9._-]{2,}/[^\s\"'`,;)}\]]{3,})", "path", 0.85),
    ("private_ip_10", r"\b(10\.\d{1,3}\.\d{1,3}\.\d{1,3})\b", "custom_sensitive", 0.70),
    ("private_ip_172", r"\b(172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3})\b", "custom_sensitive", 0.70),
    ("private_ip_192", r"\b(192\.168\.\d{1,3}\.\d{1,3})\b", "custom_sensitive", 0.70),
    ("mac_address", r"\b((?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2})\b", "device_id", 0.95),
    ("ssn_us", r"\b((?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4})\b", "custom_sensitive", 0.90),
    ("phone_e164", r"(?<!\d)(\+\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{2,4}[-.\s]?\d{3,9})(?!\d)", "custom_sensitive", 0.55),
    ("internal_tld_host", r"(?i)\b([a-z0-9][a-z0-9-]*(?:\.[a-z0-9][a-z0-9-]*)*\.(?:local|internal|corp|lan|intranet|localnet))\b", "private_url", 0.80),
    ("private_ip_url", r"(https?://(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3})(?::\d{2,5})?(?:/[^\s\"'`<>]*)?)", "private_url", 0.90),
    ("localhost_url", r"(https?://(?:localhost|127\.0\.0\.1)(?::\d{2,5})?(?:/[^\s\"'`<>]*)?)", "private_url", 0.85),
    ("npm_scoped_package", r"(?<![A-Za-z0-9])(@[a-z0-9][a-z0-9-]{1,38}/[a-z0-9][a-z0-9._-]{1,63})\b", "project_name", 0.70),
    ("package_at_version", r"(?<![A-Za-z0-9@])([a-z][a-z0-9-]{2,}(?:/[a-z][a-z0-9-]+)?@\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.-]+)?)\b", "project_name", 0.65),
    ("github_repo_slug", r"github\.com/([A-Za-z0-9._-]{2,39}/[A-Za-z0-9._-]{1,100})(?![A-Za-z0-9])", "project_name", 0.80),
    ("gitlab_repo_slug", r"gitlab\.com/([A-Za-z0-9._-]{2,39}(?:/[A-Za-z0-9._-]+){1,4})(?![A-Za-z0-9])", "project_name", 0.80),
    ("bitbucket_repo_slug", r"bitbucket\.org/([A-Za-z0-9._-]{2,39}/[A-Za-z0-9._-]+)(?![A-Za-z0-9])", "project_name", 0.80),
    ("aws_arn", r"(arn:aws:[a-z0-9-]+:[a-z0-9-]*:\d{12}:[^\s\"'`<>]+)", "custom_sensitive", 0.95),
    ("aws_account_ecr", r"\b(\d{12}\.dkr\.ecr\.[a-z0-9-]+\.amazonaws\.com)\b", "custom_sensitive", 0.95),
    ("gcp_project_id", r"projects/([a-z][a-z0-9-]{4,28}[a-z0-9])(?![A-Za-z0-9])", "project_name", 0.80),
    ("credit_card", r"(?<!\d)((?:\d[ -]?){12,18}\d)(?!\d)", "custom_sensitive", 0.60),
    ("meta_username", r'\\?"username\\?"\s*:\s*\\?"([^"\\]{3,})\\?"', "username", 0.98),
    ("meta_sender_id", r'\\?"sender_id\\?"\s*:\s*\\?"([^"\\]{3,})\\?"', "user_id", 0.98),
    ("meta_user_chat_id", r'\\?"(?:user_id|chat_id|account_id|sender_id|from_id)\\?"\s*:\s*\\?"([^"\\]{3,})\\?"', "user_id", 0.95),
    ("meta_numeric_id", r'\\?"id\\?"\s*:\s*\\?"(\d{5,})\\?"', "user_id", 0.75),
    ("meta_name", r'\\?"name\\?"\s*:\s*\\?"([^"\\]{3,})\\?"', "person_name", 0.82),
    ("meta_sender", r'\\?"sender\\?"\s*:\s*\\?"([^"\\]{3,})\\?"', "person_name", 0.82),
    ("meta_label", r'\\?"label\\?"\s*:\s*\\?"([^"\\]{3,})\\?"', "person_name", 0.75),
)
#: Rules that name an account on GitHub, and the public organisations that they skip.
GITHUB_RULES = ("github_url_username", "github_raw_url_username", "github_repo_slug")
PUBLIC_ORGS = frozenset("anthropics anthropic openai google microsoft meta facebook aws hashicorp vercel supabase huggingface pytorch tensorflow golang rust-lang python nodejs actions github cli docker kubernetes helm npm homebrew apache mozilla jetbrains gradle maven".split())
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: The same matches, found in one go: a scan begins where a name can begin, or the match before ended, and never goes back into a name.
EMAIL_SCAN = r"(?:\G|(?<![A-Za-z0-9_.+-]))[A-Za-z0-9_.+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

# What explains a token of high entropy: prefixes that other scans know, hex, UUIDs, paths and dotted names;
# and, in lower case, benign prefixes, parts and file extensions.
EXTENSIONS = ".py .js .ts .tsx .jsx .css .html .json .yaml .yml .toml .md .rst .txt .sh .go .rs .java .rb .php .c .h .cpp .hpp .swift .kt .lock .cfg .ini .xml .svg .png .jpg .gif .woff .ttf .map .vue .scss .less .sql .env .log".split()
BENIGN_TOKEN = r"^(?:eyJ|ghp_|gho_|ghs_|ghr_|sk-|hf_|AKIA|pypi-|npm_|xox)|^[0-9a-fA-F]+$|^[0-9a-fA-F]{8}(?:-?[0-9a-fA-F]{4}){3}-?[0-9a-fA-F]{12}$|/.*/|[.].*[.].*[.]"
BENIGN_PART = r"^(?:https?://|sha(?:1|256|384|512)-|data:|file://|mailto:)|node_modules|package-lock|webpack|babel|eslint|[.]chunk[.]|vendor/|dist/|build/|" + "|".join(map(re.escape, EXTENSIONS))


def skipped(found: str, kind: str, rule: str) -> bool:
    """Too short, a placeholder in brackets, a public organisation, or a sender that isn't a person."""
    if rule in GITHUB_RULES and found.lower() in PUBLIC_ORGS:
        return True
    return len(found) < 3 or (found.startswith("[") and found.endswith("]")) or (kind == "email" and found.lower().startswith(("noreply@", "no-reply@")))


def without_overlaps(spans: list[tuple]) -> list[tuple]:
    """Spans (start, end, confidence, ...) that don't overlap: the longest first, then the surest, then the leftmost."""
    taken: list[tuple] = []  # kept in order, so that only a span's neighbours can overlap it
    for s in sorted(spans, key=lambda s: (s[0] - s[1], -s[2], s[0])):
        at = bisect.bisect(taken, s[0], key=lambda t: t[0])
        if (not at or taken[at - 1][1] <= s[0]) and (at == len(taken) or s[1] <= taken[at][0]):
            taken.insert(at, s)
    return taken


def pii_spans(docs: DataFrame, id: str, text: str, rules: tuple = PII_RULES) -> DataFrame:
    """id, start, end, rule, entity_type, confidence, entity: personal data without overlaps, in code points."""
    key = docs.schema[id].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(name, re.compile(pattern), kind, sure) for name, pattern, kind, sure in rules]
        for frame in frames:
            rows = []
            for key_value, value in zip(frame[id], frame[text], strict=True):
                spans = [(m.start(1), m.end(1), sure, name, kind, m[1]) for name, rx, kind, sure in compiled for m in rx.finditer(value or "") if not skipped(m[1], kind, name)]
                rows += [(key_value, *s) for s in without_overlaps(spans)]
            yield pd.DataFrame(rows, columns=["id", "start", "end", "confidence", "rule", "entity_type", "entity"])

    return docs.select(F.col(id), F.col(text)).mapInPandas(work, f"id {key}, start int, end int, confidence double, rule string, entity_type string, entity string").withColumnRenamed("id", id)


def entity_hash(kind: Column, entity: Column, salt: str = "") -> Column:
    return F.sha2(F.concat_ws("|", F.lit(salt), kind, F.lower(entity)), 256)


def finding_id(*parts: Column) -> Column:
    """The same finding, the same id, whoever computes it."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 32)


def emails_of(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id, entity of each different address of a text."""
    some = docs.select(F.col(id), F.col(text)).filter(F.contains(F.col(text), F.lit("@")))
    return some.select(F.col(id), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(EMAIL_SCAN), F.lit(0)))).alias("entity"))


def grouped_findings(findings: DataFrame, group: list[str], confidence: str, entity: str) -> DataFrame:
    """Findings of one entity together: how many, the highest confidence, and the entity that has it."""
    best = F.max_by(entity, F.struct(confidence, entity)).alias("representative")
    return findings.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.max(confidence).alias("confidence"), best)


def decided(findings: DataFrame, decisions: DataFrame, group: list[str]) -> DataFrame:
    """findings with the status that a decision on any of their group gives to all; others are open."""
    return findings.join(decisions.select(*group, F.col("status").alias("decision")), group, "left").withColumn("status", F.coalesce("decision", F.lit("open"))).drop("decision")


def redacted(text: Column, patterns: dict[str, str], domains: tuple[str, ...] = (), hints: dict[str, str] | None = None) -> Column:
    """text with blocked domains and their subdomains, then each pattern in turn, replaced by placeholders.

    hints: what a text with a match contains, by placeholder; texts without it aren't searched.
    """
    out = text
    for domain in domains:
        out = F.when(F.contains(out, F.lit(domain)), F.regexp_replace(out, r"(?:[A-Za-z0-9-]+\.)*" + re.escape(domain), "[REDACTED_DOMAIN]")).otherwise(out)
    for placeholder, pattern in patterns.items():
        changed = F.regexp_replace(out, pattern, placeholder)
        hint = (hints or {}).get(placeholder)
        out = F.when(F.contains(out, F.lit(hint)), changed).otherwise(out) if hint else changed
    return out


def entropy_candidates(docs: DataFrame, id: str, text: str, least: int = 20, bits: float = 4.0, top: int = 15) -> DataFrame:
    """id, token, entropy, place: the top tokens of a text by entropy, of least characters, of upper case, lower case and digits, that nothing benign explains."""
    tokens = docs.select(F.col(id), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[A-Za-z0-9_/+=.-]{%d,}" % least), F.lit(0)))).alias("token"))
    # All filters come before the rank, so that the top holds candidates only.
    benign = F.regexp_like("token", F.lit(BENIGN_TOKEN)) | F.regexp_like(F.lower("token"), F.lit(BENIGN_PART))
    mixed = F.regexp_like("token", F.lit("[A-Z]")) & F.regexp_like("token", F.lit("[a-z]")) & F.regexp_like("token", F.lit("[0-9]"))
    chars = F.split("token", "")
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / F.length("token"))
    scored = tokens.filter(~benign & mixed).withColumn("entropy", F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p)))
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy(id).orderBy(F.desc("entropy"), "token"))
    return scored.filter(F.col("entropy") >= bits).withColumn("place", rank).filter(F.col("place") <= top)
