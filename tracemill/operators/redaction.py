"""From what sessions say to what may leave: places of texts, findings and their decisions, replacement, metadata, path tokens.

Texts are rows (session_id, idx, field, text); findings are rows with those keys, an engine,
rule, entity type and text, offset and length.  Entities are stored as salted hashes only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.texts import json_strings

# What stands for an entity of each type, and for a user's name and paths.
PLACEHOLDERS = {
    "person_name": "[REDACTED_NAME]", "email": "[REDACTED_EMAIL]", "phone": "[REDACTED_PHONE]", "username": "[REDACTED_USERNAME]", "user_id": "[REDACTED_USER_ID]", "org_name": "[REDACTED_ORG]", "project_name": "[REDACTED_PROJECT]",
    "private_url": "[REDACTED_URL]", "domain": "[REDACTED_DOMAIN]", "address": "[REDACTED_ADDRESS]", "location": "[REDACTED_LOCATION]", "bot_name": "[REDACTED_BOT]", "device_id": "[REDACTED_DEVICE_ID]", "path": "[REDACTED_PATH]", "custom_sensitive": "[REDACTED]",
}
USER, PATH = "[REDACTED_USERNAME]", "[REDACTED_PATH]"
#: Parts of a user's name that are no names by themselves.
COMMON_PARTS = frozenset("admin agent build cloud code data demo deploy dev desktop docs home lab local main prod project root server service team test tool user web work".split())

_TOOL = "array<struct<tool:string,id:string,input:string,output:string,status:string>>"


def placeholder(kind: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, text in PLACEHOLDERS.items():
        out = out.when(kind == name, text)
    return out.otherwise("[REDACTED]")


# Places of texts


def text_locations(messages: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """session_id, idx (null for a session's own fields), field, text of every text that may hold something: title, project, branch, contents, thoughts, and each value of a call's input and output."""
    part = lambda field, text: F.struct(field.alias("field"), text.alias("text"))

    def of(branch: str, t: Column, i: Column) -> Column:
        name = F.concat(F.lit("tool_uses["), i.cast("string"), F.lit(f"].{branch}"))
        whole = F.from_json(F.when(F.startswith(F.ltrim(t[branch]), F.lit("{")), t[branch]), "map<string,string>")
        each = F.transform(F.map_entries(whole), lambda e: part(F.concat(name, F.lit("."), e["key"]), e["value"]))
        return F.when(whole.isNotNull(), each).otherwise(F.array(part(name, t[branch])))

    tools = F.coalesce("tools", F.array().cast(_TOOL))
    nested = F.flatten(F.transform(tools, lambda t, i: F.concat(of("input", t, i), of("output", t, i))))
    own = F.array(part(F.lit("content"), F.col("content")), part(F.lit("thinking"), F.col("thinking")))
    out = messages.select("session_id", "idx", F.explode(F.concat(own, nested)).alias("p")).select("session_id", "idx", "p.field", "p.text")
    if sessions is not None:
        fields = [c for c in ("display_title", "project", "git_branch") if c in sessions.columns]
        heads = sessions.select("session_id", F.lit(None).cast("int").alias("idx"), F.explode(F.array(*[part(F.lit(c), F.col(c)) for c in fields])).alias("p")).select("session_id", "idx", "p.field", "p.text")
        out = out.union(heads)
    return out.filter("trim(text) <> ''")


def widened_locations(messages: DataFrame, fields: Sequence[str] = ("invocations", "snippets", "extra", "author")) -> DataFrame:
    """session_id, idx, field, text of every string, however deep, in messages' further fields (JSON texts)."""

    def located(name: str) -> Column:
        dot = lambda path: F.when((path != "") & ~F.startswith(path, F.lit("[")), ".").otherwise("")
        return F.transform(json_strings(F.col(name)), lambda s: F.struct(F.concat(F.lit(name), dot(s["path"]), s["path"]).alias("field"), s["text"].alias("text")))

    each = [located(f) for f in fields if f in messages.columns]
    return messages.select("session_id", "idx", F.explode(F.concat(*each)).alias("p")).select("session_id", "idx", "p.field", "p.text")


def allowed(findings: DataFrame, exact: Sequence[str] = (), kinds: Sequence[str] = (), patterns: Sequence[str] = ()) -> DataFrame:
    """findings less those that a user's list allows: by text, by type, or by a pattern that matches; a pattern that can't be read allows nothing."""
    skip = F.col("entity").isin(*exact) if exact else F.lit(False)
    skip = skip | (F.col("entity_type").isin(*kinds) if kinds else F.lit(False))
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        skip = skip | F.regexp_like("entity", F.lit(p))
    return findings.filter(~F.coalesce(skip, F.lit(False)))


# Findings


def union_engines(*engines: DataFrame) -> DataFrame:
    """Findings of several engines as one bag; columns that an engine lacks are null."""
    out = engines[0]
    for more in engines[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def hashed(entity: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), entity), 256)


def recorded(findings: DataFrame, allowlist: DataFrame, salt: str, revision: str) -> DataFrame:
    """findings as they are stored: an id that the same scan always gives, a hash for the entity, and a status.

    allowlist: allowlist_id, entity_hash, entity_type (null: any), added_at.  An entry of the type
    comes before one of any, an older before a younger one.
    """
    parts = [F.col("session_id").cast("string"), F.lit(revision), F.col("engine"), F.coalesce("rule", F.lit("")), F.col("field"), F.coalesce(F.col("idx").cast("string"), F.lit("")), F.col("offset").cast("string"), F.col("length").cast("string")]
    rows = findings.withColumn("finding_id", F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)).withColumn("entity_hash", hashed(F.col("entity"), salt)).withColumn("entity_length", F.length("entity")).drop("entity")
    hit = matched_entries(rows.select("finding_id", "entity_hash", "entity_type"), allowlist)
    out = rows.join(hit, "finding_id", "left")
    by = F.col("source_id").isNotNull()
    return out.withColumn("status", F.when(by, "ignored").otherwise("open")).withColumn("decided_by", F.when(by, "allowlist").otherwise("auto"))


def matched_entries(rows: DataFrame, allowlist: DataFrame) -> DataFrame:
    """finding_id, source_id: the entry that allows each finding, if one does.  Entries are few for a hash; they meet by equality."""
    a = allowlist.select(F.col("entity_hash").alias("a_hash"), F.col("entity_type").alias("a_type"), "allowlist_id", "added_at")
    met = rows.join(a, (rows.entity_hash == F.col("a_hash")) & (F.col("a_type").isNull() | (F.col("a_type") == rows.entity_type)))
    best = F.min_by("allowlist_id", F.struct(F.col("a_type").isNull(), "added_at", "allowlist_id"))
    return met.groupBy("finding_id").agg(best.alias("source_id"))


def entry_added(findings: DataFrame, entry: DataFrame) -> DataFrame:
    """findings after entries (allowlist_id, entity_hash, entity_type) came to the list: open ones that they match are ignored, decisions of users stay."""
    found = findings.filter("status = 'open'").select("finding_id", "entity_hash", "entity_type")
    hit = matched_entries(found, entry.withColumn("added_at", F.lit(0))).withColumnRenamed("source_id", "new_id")
    return findings.join(hit, "finding_id", "left").withColumn("status", F.when(F.col("new_id").isNotNull(), "ignored").otherwise(F.col("status"))).withColumn("decided_by", F.when(F.col("new_id").isNotNull(), "allowlist").otherwise(F.col("decided_by"))).withColumn("source_id", F.coalesce("new_id", "source_id")).drop("new_id")


def entry_removed(findings: DataFrame, removed: DataFrame, left: DataFrame) -> DataFrame:
    """findings after entries were removed: what they had decided goes to another entry that matches, or is open again."""
    gone = removed.select(F.col("allowlist_id").alias("source_id"), F.lit(True).alias("gone")).distinct()
    marked = findings.join(gone, "source_id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)) & (F.col("decided_by") == "allowlist"))
    again = matched_entries(marked.filter("gone").select("finding_id", "entity_hash", "entity_type"), left).withColumnRenamed("source_id", "new_id")
    out = marked.join(again, "finding_id", "left")
    lost = F.col("gone") & F.col("new_id").isNull()
    out = out.withColumn("status", F.when(lost, "open").otherwise(F.col("status"))).withColumn("decided_by", F.when(lost, "auto").otherwise(F.col("decided_by"))).withColumn("source_id", F.when(F.col("gone"), F.col("new_id")).otherwise(F.col("source_id")))
    return out.select(*findings.columns)


def ordered_findings(findings: DataFrame) -> DataFrame:
    """The surest first, then in the order of the text; a session's own fields come before its messages."""
    return findings.orderBy(F.desc("confidence"), F.col("idx").asc_nulls_first(), "offset", "finding_id")


def decision_map(findings: DataFrame) -> DataFrame:
    """session_id, entity_hash, status: one decision for each entity of a session; an ignored one counts before others."""
    return findings.groupBy("session_id", "entity_hash").agg(F.min(F.when(F.col("status") == "ignored", "ignored").otherwise("open")).alias("status"))


def merged_findings(findings: DataFrame, least: float = 0.0) -> DataFrame:
    """findings (session_id, idx, field, entity, entity_type, confidence) of each place less those whose text, in any case, another one of the place holds.

    Of equal texts the surest stays.  A place's findings are held against longer ones of the same
    place only; what contains is transitive, so any longer text decides as a chosen one would.
    """
    key = ["session_id", "idx", "field"]
    sure = findings.filter((F.col("confidence") >= least) & (F.col("entity") != "")).withColumn("low", F.lower("entity"))
    first = F.row_number().over(Window.partitionBy(*key, "low").orderBy(F.desc("confidence"), "entity_type", "entity"))
    one = sure.withColumn("n", first).filter("n = 1").drop("n")
    texts = one.groupBy(*key).agg(F.collect_set("low").alias("all"))
    inside = F.exists("all", lambda t: (F.length(t) > F.length("low")) & F.contains(t, F.col("low")))
    return one.join(texts, key).filter(~inside).drop("all", "low")


def apply_findings(texts: DataFrame, findings: DataFrame) -> DataFrame:
    """texts (session_id, idx, field, text) with each finding's entity of the session replaced wherever it stands as a whole word, in any case, longest first; and n, how many were."""
    replacement = F.coalesce("replacement", placeholder(F.col("entity_type"))) if "replacement" in findings.columns else placeholder(F.col("entity_type"))
    usable = findings.filter(F.length("entity") >= 3).groupBy("session_id", "entity").agg(F.max_by(replacement, F.struct("confidence", "entity_type")).alias("to"), F.max("confidence").alias("confidence"))
    order = F.struct((-F.length("entity")).alias("l"), (-F.col("confidence")).alias("c"), "entity", "to")
    lists = usable.groupBy("session_id").agg(F.array_sort(F.collect_list(order)).alias("changes"))
    quote = lambda s: F.concat(F.lit(r"(?i)(?<!\w)\Q"), F.replace(s, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    joined = texts.join(lists, "session_id", "left")
    start = F.struct(F.col("text").alias("text"), F.lit(0).cast("long").alias("n"))
    done = F.aggregate(
        F.coalesce("changes", F.array().cast("array<struct<l:int,c:double,entity:string,to:string>>")), start,
        lambda acc, c: F.struct(F.regexp_replace(acc["text"], quote(c["entity"]), c["to"]).alias("text"), (acc["n"] + F.regexp_count(acc["text"], quote(c["entity"]))).cast("long").alias("n")),
    )
    return joined.withColumn("done", done).select("session_id", "idx", "field", F.col("done.text").alias("text"), F.col("done.n").alias("n"))


def preview(text: Column, offset: Column, length: Column, around: int = 60) -> Column:
    """before and after of a finding in its text; the match itself isn't shown."""
    begin = F.greatest(offset, F.lit(0))
    end = F.least(F.length(text), begin + F.greatest(length, F.lit(0)))
    outside = text.isNull() | (begin > F.length(text))
    before = F.substring(text, F.greatest(begin - around, F.lit(0)) + 1, F.least(begin, F.lit(around)))
    return F.struct(F.when(outside, "").otherwise(before).alias("before"), F.when(outside, "").otherwise(F.substring(text, end + 1, F.lit(around))).alias("after"))


def revisions(texts: DataFrame, engine: str) -> DataFrame:
    """session_id, revision: a hash of the engine and of all that a session says, whatever the order of rows; texts move as their hashes."""
    one = F.sha2(F.concat_ws("\u0000", F.coalesce(F.col("idx").cast("string"), F.lit("")), "field", "text"), 256)
    return texts.groupBy("session_id").agg(F.array_sort(F.collect_list(one)).alias("parts")).select("session_id", F.concat(F.lit("v1:"), F.sha2(F.concat_ws("|", F.lit(engine), F.array_join("parts", "|")), 256)).alias("revision"))


def to_rescan(sessions: DataFrame, current: DataFrame, now: Column, settle: int = 120) -> DataFrame:
    """session_id, revision of sessions (session_id, end_time, findings_revision) that are settled and whose revision has changed."""
    quiet = F.col("end_time").isNull() | (F.col("end_time") <= now - F.make_dt_interval(secs=F.lit(settle)))
    return sessions.filter(quiet).join(current, "session_id").filter(~F.col("findings_revision").eqNullSafe(F.col("revision"))).select("session_id", "revision")


def rebuilt(findings: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """findings with those of touched sessions replaced by fresh ones."""
    return findings.join(touched.select("session_id").distinct(), "session_id", "left_anti").unionByName(fresh)


# Names, paths and metadata


def anonymised(text: Column, user: str, others: Sequence[str] = ()) -> Column:
    """text without the user's paths and name, and without other names (of three characters and more, in any case)."""
    out = text
    if user:
        name = re.escape(user)
        end = r"(?=/|[^a-zA-Z0-9_-]|$)"
        for root in ("/Users/", "/home/"):
            out = F.regexp_replace(out, rf"{root}{name}/[^\s\"'`,;)}}\]]*", PATH)
            out = F.regexp_replace(out, rf"{root}{name}{end}", PATH)
        for spelled in dict.fromkeys((user, user.replace("_", "-"))):
            out = F.regexp_replace(out, rf"-(?:Users|home)-{re.escape(spelled)}(?=-|/|$)", PATH)
        if len(user) >= 4:
            out = F.regexp_replace(out, rf"(?U)\b{name}\b", USER)
    for other in others:
        other = other.strip()
        if len(other) >= 3 and other != user:
            out = F.regexp_replace(out, "(?i)" + re.escape(other), USER)
    return out


def anonymised_path(path: Column, user: str, others: Sequence[str] = ()) -> Column:
    """A path of the user's home as one placeholder; other paths as texts."""
    homes = rf"^/(?:Users|home)/{re.escape(user)}|/(?:Users|home)/{re.escape(user)}/"
    return F.when(F.regexp_like(path, F.lit(homes)), PATH).otherwise(anonymised(path, user, others))


def scrubbed(text: Column, user: str, others: Sequence[str] = ()) -> Column:
    """A name of a project, branch or title without the user's name, its spelling with hyphens and its parts."""
    out = anonymised(text, user, others)
    spelled = user.replace("_", "-")
    if spelled != user and len(spelled) >= 4:
        out = F.regexp_replace(out, "(?i)" + re.escape(spelled), USER)
    for part in dict.fromkeys(spelled.split("-")):
        if len(part) >= 4 and part.lower() not in COMMON_PARTS:
            out = F.regexp_replace(out, rf"(?i)\b{re.escape(part)}\b(?!\])", USER)
    mark = re.escape(USER)
    return F.regexp_replace(out, rf"(?:{mark}[-_]?)+{mark}", USER)


def to_the_hour(at: Column) -> Column:
    """A time's text cut to the hour; its zone stays, other texts too."""
    return F.regexp_replace(at, r"^(\d{4}-\d{2}-\d{2}T\d{2}):\d{2}:\d{2}[^A-Z+\-]*(Z|[+-]\d{2}:\d{2})?.*$", "$1:00:00$2")


def scrubbed_sessions(sessions: DataFrame, user: str, custom: Sequence[str] = ()) -> DataFrame:
    """sessions with project, branch and title scrubbed and times cut to the hour."""
    out = sessions
    for c in ("project", "git_branch", "display_title"):
        if c in out.columns:
            column = scrubbed(F.col(c), user)
            for s in custom:
                if c == "git_branch" and len(s) >= 3:
                    column = F.regexp_replace(column, "(?i)" + re.escape(s), "[REDACTED]")
            out = out.withColumn(c, column)
    for c in ("start_time", "end_time"):
        if c in out.columns:
            text = F.date_format(c, "yyyy-MM-dd'T'HH:00:00") if not isinstance(out.schema[c].dataType, T.StringType) else to_the_hour(F.col(c))
            out = out.withColumn(c, text)
    return out


def path_tokens(paths: DataFrame, user: str) -> DataFrame:
    """session_key, path, token of each different pair: paths of the home, which would all look the same, get a token of their own by a hash; others as anonymised."""
    digest = F.substring(F.sha2(F.concat_ws("\u0000", F.lit("redacted-path:v1"), "session_key", "path"), 256), 1, 16)
    hidden = anonymised_path(F.col("path"), user)
    return paths.filter("path is not null").select("session_key", "path").distinct().withColumn("token", F.when(hidden == PATH, F.concat(F.lit("[REDACTED_PATH_"), digest, F.lit("]"))).otherwise(hidden))


def share_redacted(texts: DataFrame, findings: DataFrame, user: str, custom: Sequence[str] = (), domains: Sequence[str] = (), others: Sequence[str] = ()) -> DataFrame:
    """texts as they may be shared: custom strings, blocked domains, names and paths, then the findings that aren't ignored."""
    out = F.col("text")
    for s in custom:
        if len(s) >= 3:
            out = F.when(F.contains(F.lower(out), F.lit(s.lower())), F.regexp_replace(out, "(?i)" + re.escape(s), "[REDACTED]")).otherwise(out)
    for d in domains:
        bare = d.removeprefix("*.").lower()
        pattern = rf"(?i)(?<![A-Za-z0-9-])(?:[A-Za-z0-9-]+\.)*{re.escape(bare)}(?![A-Za-z0-9-]|\.[A-Za-z0-9])"
        out = F.when(F.contains(F.lower(out), F.lit(bare)), F.regexp_replace(out, pattern, PLACEHOLDERS["domain"])).otherwise(out)
    cleaned = texts.withColumn("text", anonymised(out, user, others))
    return apply_findings(cleaned, findings.filter("status <> 'ignored'"))


def redaction_counts(findings: DataFrame) -> DataFrame:
    """entity_type, applied, ignored."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return findings.groupBy("entity_type").agg(count(F.col("status") != "ignored").alias("applied"), count(F.col("status") == "ignored").alias("ignored"))


def order_preserving(values: Column) -> Column:
    """The values that aren't empty, each once, in their order."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))
