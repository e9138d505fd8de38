"""What a session's messages say: outcome, value, risk, task, title, workflow, training turns.

messages are rows (session_id, idx from 0, role, content, thinking, at, tools); tools is an
array of (tool, id, input, output, status), input a JSON object or text, output text.  Every
result is an aggregate by session or turn over flags that are found row by row, so a long
session's texts are never brought together unless they are the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import TASK_PATTERNS, task_type

# Tools that change nothing; what outputs say of builds and tests, of late errors and of trouble early and success late;
# sciences' libraries, files and terms; addresses that aren't public; first messages that ask for nothing; names of shells and files in calls.
READ_ONLY = ("Read", "Glob", "Grep", "cat", "ls", "find", "head", "tail", "View", "Search", "ListFiles", "read_file", "search_files")
BUILD_FAILED = (r"BUILD FAILED|build failed", r"(?i)(?:compile|compilation)\s+(?:error|failed)", r"error\[E\d+\]", r"error TS\d+:")
TESTS_FAILED = (r"(?<!BUILD\s)FAILED\s+\S+::", r"\d+\s+failed", r"AssertionError|FAIL:|Tests?:\s*\d+\s+failed", r"FAILURES|failures=\d*[1-9]")
TESTS_PASSED = ((r"\d+\s+passed",), (r"\bpassed\b", r"(?i)pytest|jest|mocha|vitest"), (r"\bOK\b", r"(?i)tests?\s+run|Ran\s+\d+"), (r"Tests?:\s+\d+\s+passed,\s+\d+\s+total",), (r"✓|All tests passed|BUILD SUCCESSFUL",))
LATE_ERROR = r"\b(?:Error|Exception|Traceback|FAILED|FATAL|panic|Segmentation fault|Permission denied|No such file|command not found)\b"
EARLY_TROUBLE, LATE_SUCCESS = r"(?i)\b(?:error|bug|broken|crash|traceback|exception|failing)\b", r"(?i)\b(?:passed|works|fixed|resolved|success|OK|verified)\b"
LIBRARIES = r"\b(?:numpy|scipy|pandas|matplotlib|seaborn|plotly|biopython|rdkit|pytorch|torch|tensorflow|keras|jax|flax|astropy|sympy|scikit-learn|sklearn|statsmodels|openmm|mdtraj|pymatgen|ase|dask|xarray|protein|genome|genomic|molecular|quantum|spectral|phylogen|metabol|transcriptom|proteom)\b"
DATA_FILES = r"\.(?:ipynb|csv|tsv|h5|hdf5|fasta|fastq|pdb|cif|mol2|sdf|npy|npz|parquet|feather)\b"
TERMS = r"(?i)\b(?:experiment|hypothesis|correlation|regression|p-value|pvalue|chi-square|t-test|anova|standard.deviation|confidence.interval|null.hypothesis|statistical|bayesian|spectroscopy|chromatography|genome|proteomics|phylogenetic)\b"
PRIVATE_URL = r"https?://(?:[a-zA-Z0-9._-]+\.(?:local|internal|corp|intranet|lan)|localhost(?::\d+)?|(?:10|172\.(?:1[6-9]|2\d|3[01])|192\.168)\.\d+\.\d+)\b"
TRIVIAL = r"(?i)^(?:/\w+|hello|hi|hey|say hi|say hello|warmup|test|ping|list your available tools.*|return x=\d+|what number was provided.*)\s*$"
PERSON = r"(?<![A-Za-z])[A-Z][a-z]{1,7}\s+[A-Z][a-z]{1,12}(?![A-Za-z])"
SHELLS, FILE_KEYS = ("Bash", "bash", "execute_command", "run_command"), ("file_path", "path", "file", "filename")
POLITE = ("Can you ", "Could you ", "Please ", "I need you to ", "I want you to ", "I'd like you to ", "Help me ", "Let's ", "Let me ")
SKIPPED_TITLE = r"(?s)^\s*<(command-message|local-command-caveat|command-name|local-command-stdout)\b[^>]*>.*?</\1>\s*$|^\s*\[Request interrupted by user\]\s*$|^\s*[a-z]{2,12}\s*$"
SECRET_WEIGHT, NAME_WEIGHT, URL_WEIGHT, REVIEW_FROM = 0.3, 0.1, 0.15, 0.7

_TOOL = "array<struct<tool:string,id:string,input:string,output:string,status:string>>"


def _any(text: Column, *patterns: str) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.regexp_like(text, F.lit(p))
    return out


def _max(flag: Column) -> Column:
    return F.coalesce(F.max(flag), F.lit(False))


def calls(messages: DataFrame) -> DataFrame:
    """session_id, idx, n (messages of the session), place, tool, id, input, output, status: a row for each tool call."""
    n = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    counted = messages.select("session_id", "idx", "tools", n.alias("n"))  # before messages without calls go
    return counted.select("session_id", "idx", "n", F.posexplode("tools").alias("place", "t")).select("session_id", "idx", "n", "place", "t.*")


def values_of(json: Column) -> Column:
    """The texts of a JSON object's fields; the text itself where it is no object."""
    whole = F.startswith(F.ltrim(json), F.lit("{"))
    return F.when(whole, F.map_values(F.from_json(json, "map<string,string>"))).otherwise(F.array(json))


def texts(messages: DataFrame) -> DataFrame:
    """session_id, idx, field, text of all that a session says: contents, thoughts, inputs and outputs of tools."""
    part = lambda field, text: F.struct(F.lit(field).alias("field"), text.alias("text"))
    tools = F.coalesce("tools", F.array().cast(_TOOL))
    given = F.flatten(F.transform(tools, lambda t: F.transform(F.coalesce(values_of(t["input"]), F.array().cast("array<string>")), lambda v: part("input", v))))
    gave = F.transform(tools, lambda t: part("output", t["output"]))
    all_parts = F.concat(F.array(part("content", F.col("content")), part("thinking", F.col("thinking"))), given, gave)
    return messages.select("session_id", "idx", F.explode(all_parts).alias("p")).select("session_id", "idx", "p.field", "p.text").filter("text is not null and text <> ''")


def outcome_badges(messages: DataFrame) -> DataFrame:
    """session_id, outcome_badge: failed tests before failed builds before passed tests; else who spoke last and late errors decide."""
    out = F.col("output")
    passed = F.lit(False)
    for every in TESTS_PASSED:
        met = F.lit(True)
        for p in every:
            met = met & F.regexp_like(out, F.lit(p))
        passed = passed | met
    late = (F.col("idx") >= F.floor(F.col("n") * 2 / 3)) & F.regexp_like(out, F.lit(LATE_ERROR))
    used = calls(messages).groupBy("session_id").agg(
        _max(~F.coalesce("tool", F.lit("")).isin(*READ_ONLY)).alias("acts"), _max(_any(out, *TESTS_FAILED)).alias("failed"), _max(_any(out, *BUILD_FAILED)).alias("broke"), _max(passed).alias("passed"), _max(late).alias("late"),
    )
    last = messages.groupBy("session_id").agg(F.max_by("role", F.when(F.col("role").isin("user", "assistant"), F.col("idx"))).alias("last"))
    badge = F.when(~F.coalesce("acts", F.lit(False)), "analysis_only").when(F.col("failed"), "tests_failed").when(F.col("broke"), "build_failed").when(F.col("passed"), "tests_passed").when(F.col("last") == "user", "partial").when(F.col("late"), "errored").otherwise("completed")
    return last.join(used, "session_id", "left").select("session_id", badge.alias("outcome_badge"))


def late_errors(messages: DataFrame) -> DataFrame:
    """session_id, idx, output of the outputs in the last third of a session's messages that tell of an error."""
    return calls(messages).filter((F.col("idx") >= F.floor(F.col("n") * 2 / 3)) & F.regexp_like("output", F.lit(LATE_ERROR))).select("session_id", "idx", "output")


def session_facts(messages: DataFrame) -> DataFrame:
    """session_id with counts of its messages and calls."""
    role = lambda r: F.sum(F.when(F.col("role") == r, 1).otherwise(0))
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), role("user").alias("user_messages"), role("assistant").alias("assistant_messages"), F.sum(F.greatest(F.size(F.coalesce("tools", F.array().cast(_TOOL))), F.lit(0))).alias("tool_uses"))


def value_badges(messages: DataFrame, tokens: DataFrame) -> DataFrame:
    """session_id, value_badges (sorted); tokens: session_id, tokens."""
    t = texts(messages)
    found = t.select("session_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LIBRARIES), F.lit(0))).alias("library")).groupBy("session_id").agg(F.countDistinct("library").alias("libraries"))
    signs = t.groupBy("session_id").agg(_max(F.regexp_like("text", F.lit(DATA_FILES))).alias("files"), _max(_any(F.col("text"), TERMS, "(?i)" + LIBRARIES)).alias("science"))
    n = Window.partitionBy("session_id")
    third = F.greatest(F.floor(F.col("n") / 3), F.lit(1))
    said = F.concat_ws("\n", "content", F.array_join(F.transform(F.coalesce("tools", F.array().cast(_TOOL)), lambda x: F.coalesce(x["output"], F.lit(""))), "\n"))
    turned = messages.withColumn("n", F.count(F.lit(1)).over(n)).groupBy("session_id").agg(_max((F.col("n") >= 3) & (F.col("idx") < third) & F.regexp_like("content", F.lit(EARLY_TROUBLE))).alias("early"), _max((F.col("n") >= 3) & (F.col("idx") >= 2 * third) & F.regexp_like(said, F.lit(LATE_SUCCESS))).alias("late"))
    rows = session_facts(messages).join(found, "session_id", "left").join(signs, "session_id", "left").join(turned, "session_id", "left").join(tokens, "session_id", "left")
    badge = lambda name, where: F.when(F.coalesce(where, F.lit(False)), F.lit(name))
    made = F.array(
        badge("novel_domain", F.col("libraries") >= 2), badge("long_horizon", (F.col("user_messages") > 20) & (F.col("tokens") > 100_000)),
        badge("tool_rich", F.col("tool_uses") / F.greatest(F.col("user_messages") + F.col("assistant_messages"), F.lit(1)) > 0.5), badge("scientific_workflow", F.col("files") & F.col("science")), badge("debugging", F.col("early") & F.col("late")),
    )
    return rows.select("session_id", F.array_sort(F.array_compact(made)).alias("value_badges"))


def risk_badges(messages: DataFrame, secrets: DataFrame) -> DataFrame:
    """session_id, risk_badges, sensitivity; secrets: session_id, secrets (how many some engine found).

    A person's name is two capitalised words, unless the session also writes the first one in
    lower case, as it would an ordinary word that opens a sentence or a title.
    """
    t = texts(messages)
    names = t.select("session_id", F.explode(F.regexp_extract_all("text", F.lit(PERSON), F.lit(0))).alias("name")).withColumn("word", F.lower(F.regexp_extract("name", r"^(\S+)", 1)))
    plain = t.select("session_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z])[a-z]{2,8}(?![A-Za-z])"), F.lit(0))).alias("word")).distinct()
    named = names.join(plain, ["session_id", "word"], "left_anti").groupBy("session_id").agg(F.count(F.lit(1)).alias("names"), F.countDistinct(F.lower("name")).alias("people"))
    urls = t.groupBy("session_id").agg(F.sum(F.regexp_count("text", F.lit(PRIVATE_URL))).alias("urls"))
    rows = messages.select("session_id").distinct().join(named, "session_id", "left").join(urls, "session_id", "left").join(secrets, "session_id", "left").na.fill(0, ["names", "people", "urls", "secrets"])
    cap = lambda c, w: F.least(F.col(c) * w, F.lit(1.0))
    rows = rows.withColumn("sensitivity", F.least(cap("secrets", SECRET_WEIGHT) + cap("names", NAME_WEIGHT) + cap("urls", URL_WEIGHT), F.lit(1.0)))
    made = F.array(F.when(F.col("secrets") > 0, "secrets_detected"), F.when(F.col("people") >= 5, "names_detected"), F.when(F.col("urls") > 0, "private_url"), F.when(F.col("sensitivity") >= REVIEW_FROM, "manual_review"))
    return rows.select("session_id", F.array_compact(made).alias("risk_badges"), "sensitivity")


def task_types(messages: DataFrame) -> DataFrame:
    """session_id, task_type by the first five messages of the user; sessions that ask for nothing are trivial."""
    asked = messages.filter("role = 'user' and content is not null and content <> ''")
    ranked = asked.withColumn("k", F.row_number().over(Window.partitionBy("session_id").orderBy("idx"))).filter("k <= 5")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "content"))), lambda x: x["content"]), "\n")
    said = ranked.groupBy("session_id").agg(F.min_by("content", "idx").alias("first"), joined.alias("all"))
    rows = session_facts(messages).join(said, "session_id", "left")
    short = (F.col("user_messages") + F.col("assistant_messages") <= 10) & F.regexp_like(F.trim("first"), F.lit(TRIVIAL))
    # The first message is among all, so that it counts twice.
    scored = [F.struct((F.regexp_count("first", F.lit("(?i)" + p)) + F.regexp_count("all", F.lit("(?i)" + p))).alias("s"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, (t, p) in enumerate(TASK_PATTERNS.items())]
    best = F.array_max(F.array(*scored))
    return rows.select("session_id", F.when(F.col("all").isNull() | short, "trivial").when(best["s"] > 0, best["t"]).otherwise("unknown").alias("task_type"))


def shortened(text: Column, most: int = 80, least: int = 40) -> Column:
    """text up to most characters, cut at a blank after the least-th one where there is one, with an ellipsis."""
    cut = F.substring(text, 1, most - 3)
    word = F.regexp_extract(cut, r"(?s)^(.*) [^ ]*$", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(F.length(word) > least, word).otherwise(cut), F.lit("...")))


def display_titles(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id, display_title: the first line of the first message that says something, without tags and polite words; else the project."""
    bare = F.trim(F.regexp_replace("content", r"<[^>]+>", ""))
    real = messages.filter((F.col("role") == "user") & ~F.coalesce(F.regexp_like("content", F.lit(SKIPPED_TITLE)), F.lit(True)) & (F.trim("content") != ""))
    first = real.groupBy("session_id").agg(F.min_by(bare, "idx").alias("text"))
    plain = F.regexp_replace("text", "^(?:" + "|".join(POLITE) + ")", "")
    plain = F.when(plain != F.col("text"), F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 1 << 30))).otherwise(F.col("text"))
    line = F.trim(F.regexp_extract(plain, r"^([^\n]*)", 1))
    title = shortened(line)
    return sessions.select("session_id", "project").join(first, "session_id", "left").select("session_id", F.when(F.coalesce(line, F.lit("")) != "", title).otherwise(F.coalesce("project", F.lit("Untitled session"))).alias("display_title"))


def tool_digest(messages: DataFrame) -> DataFrame:
    """session_id, files_touched, commands_run (each once, in order) and tool_counts."""
    c = calls(messages).withColumn("order", F.col("idx") * 100_000 + F.col("place"))
    whole = F.startswith(F.ltrim("input"), F.lit("{"))
    path = F.explode(F.array_compact(F.array(*[F.when(whole, F.get_json_object("input", f"$.{k}")) for k in FILE_KEYS])))
    once = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("first", "x"))), lambda s: s["x"]).alias(name)
    files = c.select("session_id", "order", path.alias("x")).groupBy("session_id", "x").agg(F.min("order").alias("first")).groupBy("session_id").agg(once("files_touched"))
    command = F.when(F.col("tool").isin(*SHELLS) & whole, F.get_json_object("input", "$.command")).when(F.col("tool").isin("Bash", "bash"), F.col("input"))
    commands = c.select("session_id", "order", command.alias("x")).filter("x is not null and x <> ''").groupBy("session_id", "x").agg(F.min("order").alias("first")).groupBy("session_id").agg(once("commands_run"))
    counts = c.filter("tool is not null and tool <> ''").groupBy("session_id", "tool").agg(F.count(F.lit(1)).alias("k")).groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "k")))).alias("tool_counts"))
    none = F.array().cast("array<string>")
    out = messages.select("session_id").distinct().join(files, "session_id", "left").join(commands, "session_id", "left").join(counts, "session_id", "left")
    return out.select("session_id", F.coalesce("files_touched", none).alias("files_touched"), F.coalesce("commands_run", none).alias("commands_run"), F.coalesce("tool_counts", F.create_map().cast("map<string,bigint>")).alias("tool_counts"))


def flattened(messages: DataFrame) -> DataFrame:
    """session_id, transcript: all that is said and done, line by line, for a search index."""
    t = texts(messages).filter("field <> 'thinking'")
    rank = F.when(F.col("field") == "content", 0).when(F.col("field") == "input", 1).otherwise(2)
    return t.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", rank.alias("r"), "text"))), lambda x: x["text"]), "\n").alias("transcript"))


# Judging


# What a judge may say of an outcome, and what older ones said.
RESOLUTIONS = ("resolved", "partial", "failed", "abandoned", "exploratory", "trivial")
OLD_RESOLUTIONS = {"tests_passed": "resolved", "completed": "resolved", "tests_failed": "failed", "build_failed": "failed", "errored": "failed", "analysis_only": "exploratory"}


def snake(text: Column) -> Column:
    return F.translate(F.lower(F.trim(text)), " -", "__")


def judged(rows: DataFrame, json: str = "json") -> DataFrame:
    """rows with what a judge's JSON says: substance (3 unless 1 to 5), resolution, effort (0 to 1), task_type, tags, flags, areas, title, summary."""
    at = lambda path: F.get_json_object(json, f"$.{path}")
    whole = lambda c: F.when(F.regexp_like(c, F.lit(r"^-?\d+$")), c.cast("bigint"))
    number = lambda c: F.when(F.regexp_like(c, F.lit(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$")), c.cast("double"))
    substance = whole(F.coalesce(at("substance"), at("quality")))
    label = snake(F.coalesce(at("resolution"), at("outcome_label"), F.lit("")))
    resolution = F.when(label.isin(*RESOLUTIONS), label)
    for old, new in OLD_RESOLUTIONS.items():
        resolution = resolution.when(label == old, new)
    items = lambda *names: F.coalesce(*[F.when(F.startswith(at(n), F.lit("[")), F.from_json(at(n), "array<string>")) for n in names], F.array().cast("array<string>"))
    tidy = lambda a: F.filter(F.transform(a, snake), lambda x: x != "")
    effort = number(at("effort_estimate"))
    task = snake(F.coalesce(at("task_type"), F.lit("")))
    return rows.select(
        *rows.columns, F.when(substance.between(1, 5), substance).otherwise(3).alias("substance"), resolution.otherwise("").alias("resolution"), F.when(effort.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), effort))).alias("effort"),
        F.when(task != "", task).otherwise("unknown").alias("task_type"), tidy(items("session_tags", "value_labels")).alias("tags"), tidy(items("privacy_flags", "risk_level")).alias("flags"),
        F.filter(F.transform(items("project_areas"), lambda x: F.trim(x)), lambda x: x != "").alias("areas"), F.substring(F.trim(F.coalesce(at("display_title"), F.lit(""))), 1, 80).alias("title"), F.coalesce(at("summary"), F.lit("")).alias("summary"),
    )


def judge_steps(messages: DataFrame) -> DataFrame:
    """session_id, segment, step, tool, input, output, status, plan, reflect: a step for each call, in segments that messages of the user begin.

    A plan is the text of the call's own message, or else of the last one without calls since the
    calls before; the last text without calls after a step, in the same segment, is its reflection.
    """
    w = Window.partitionBy("session_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    m = messages.withColumn("segment", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)).filter("role = 'assistant'")
    acts = F.size(F.coalesce("tools", F.array().cast(_TOOL))) > 0
    seg = Window.partitionBy("session_id", "segment").orderBy("idx")
    before = seg.rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("acts", acts).withColumn("round", F.coalesce(F.sum(F.when(acts, 1).otherwise(0)).over(before), F.lit(0)))
    quiet = m.filter("not acts").groupBy("session_id", "segment", "round").agg(F.max_by("content", "idx").alias("quiet"))
    steps = m.filter("acts").join(quiet, ["session_id", "segment", "round"], "left")
    # Only what comes before a segment's first calls is a plan; later it is a reflection on the calls before.
    plan = F.coalesce(F.when(F.col("content") != "", F.col("content")), F.when(F.col("round") == 0, F.col("quiet")), F.lit(""))
    rows = steps.select("session_id", "segment", "round", plan.alias("plan"), F.size("tools").alias("n"), F.posexplode("tools").alias("step", "t"))
    after = quiet.select("session_id", "segment", (F.col("round") - 1).alias("round"), F.col("quiet").alias("reflect"))
    rows = rows.join(after, ["session_id", "segment", "round"], "left")
    order = F.row_number().over(Window.partitionBy("session_id", "segment").orderBy("round", "step")) - 1
    first = F.when(F.startswith(F.ltrim("t.input"), F.lit("{")), F.element_at(values_of(F.col("t.input")), 1)).otherwise(F.col("t.input"))
    return rows.select("session_id", "segment", order.alias("step"), F.col("t.tool").alias("tool"), F.coalesce(first, F.lit("")).alias("input"), F.coalesce(F.substring("t.output", 1, 500), F.lit("")).alias("output"), F.coalesce("t.status", F.lit("")).alias("status"), F.when(F.col("step") == 0, F.col("plan")).otherwise("").alias("plan"), F.when(F.col("step") == F.col("n") - 1, F.coalesce("reflect", F.lit(""))).otherwise("").alias("reflect"))


# Workflow views


# Kinds of files by their names' ends, of commands by their first word, of tools; and commands that run tests.
FILE_KINDS = {".py": "python file", ".js": "javascript file", ".ts": "typescript file", ".tsx": "typescript file", ".jsx": "javascript file", ".rs": "rust file", ".go": "go file", ".java": "java file", ".rb": "ruby file", ".c": "c file", ".cpp": "c++ file", ".h": "header file", ".cs": "c# file", ".swift": "swift file", ".kt": "kotlin file", ".sh": "shell script", ".bash": "shell script", ".zsh": "shell script", ".html": "html file", ".css": "css file", ".scss": "css file", ".json": "config file", ".yaml": "config file", ".yml": "config file", ".toml": "config file", ".ini": "config file", ".cfg": "config file", ".env": "config file", ".xml": "config file", ".md": "docs file", ".rst": "docs file", ".txt": "text file", ".sql": "sql file", ".proto": "protobuf file", ".graphql": "graphql file", ".dockerfile": "dockerfile", ".lock": "lockfile"}
COMMAND_KINDS = {
    "test": "pytest jest vitest mocha", "build": "cargo go make cmake tsc webpack vite esbuild gradle mvn", "package": "npm yarn pnpm pip brew apt apt-get", "vcs": "git gh svn", "run": "python python3 node ruby", "container": "docker podman docker-compose",
    "infra": "terraform kubectl helm aws gcloud az", "network": "curl wget httpie", "filesystem": "mkdir rm mv cp chmod ln touch ls pwd cd", "read": "cat head tail less", "search": "grep rg find fd", "edit": "sed awk",
}
TOOL_KINDS = {"read": ("read", "view", "cat"), "edit": ("edit", "write", "notebookedit"), "bash": ("bash", "execute", "terminal", "command"), "search": ("grep", "search", "glob", "find"), "agent": ("agent", "task")}
TEST_COMMANDS = ("pytest", "jest", "vitest", "mocha", "cargo test", "go test", "npm test", "yarn test", "make test", "python -m unittest", "python3 -m unittest")


def file_kind(path: Column) -> Column:
    """What kind of file a path names."""
    low = F.lower(path)
    base = F.element_at(F.split(low, "/"), -1)
    tests = F.startswith(base, F.lit("test_")) | F.contains(base, F.lit("_test.")) | F.regexp_like(low, F.lit("/(?:tests?|__tests__)/"))
    out = F.when(tests, "test file")
    for end, kind in FILE_KINDS.items():
        out = out.when(F.endswith(low, F.lit(end)), kind)
    return out.when(base == "dockerfile", "dockerfile").when(base.isin("makefile", "cmakelists.txt"), "build file").otherwise("file")


def command_kind(command: Column) -> Column:
    """What kind of command is the last of those that are chained."""
    last = F.trim(F.element_at(F.split(F.coalesce(command, F.lit("")), r"\s*(?:&&|;|\|\|)\s*"), -1))
    word = F.element_at(F.split(F.element_at(F.split(last, r"\s+"), 1), "/"), -1)
    out = F.when(F.lit(False), "")
    for kind, words in COMMAND_KINDS.items():
        out = out.when(word.isin(*words.split()), kind)
    return out.otherwise("other")


def line_count(text: Column) -> Column:
    """Lines of a text; what follows the last line feed counts if there is something."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(breaks + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1))


def test_result(output: Column) -> Column:
    """passed/total of a test run's output, or whether it passed; null if it doesn't say."""
    passed = F.regexp_extract(output, r"(?s)(\d+)\s+passed", 1)
    failed = F.regexp_extract(output, r"\d+\s+passed.*?(\d+)\s+failed", 1)
    p, f = F.when(passed != "", passed.cast("long")), F.coalesce(F.when(failed != "", failed.cast("long")), F.lit(0))
    low = F.lower(output)
    bad = F.contains(low, F.lit("failed")) | F.contains(low, F.lit("error"))
    return F.when(p.isNotNull(), F.concat(p.cast("string"), F.lit("/"), (p + f).cast("string"), F.lit(" passed"))).when(F.contains(low, F.lit("passed")) & ~bad, "passed").when(bad, "failed")


def workflow_steps(messages: DataFrame, depth: str = "summary") -> DataFrame:
    """session_id, step, tool, detail, lines, outcome of each call; depth: full shows details, summary and workflow the kinds of files only."""
    if depth not in ("workflow", "summary", "full"):
        raise ValueError(f"no depth {depth!r}")
    c = calls(messages).withColumn("low", F.lower(F.coalesce("tool", F.lit("unknown"))))
    kind = F.when(F.lit(False), "")
    for name, words in TOOL_KINDS.items():
        kind = kind.when(F.col("low").isin(*words), name)
    at = lambda key: F.get_json_object("input", f"$.{key}")
    shell, files = F.col("low").isin(*TOOL_KINDS["bash"]), F.col("low").isin("read", "view", *TOOL_KINDS["edit"])
    command = F.coalesce(at("command"), F.lit(""))
    tests = shell & F.regexp_like(F.lower(command), F.lit("|".join(TEST_COMMANDS)))
    tool = F.when(tests, "test").when(shell, command_kind(command)).otherwise(kind.otherwise(F.col("low")))
    some = F.coalesce(*[F.when(at(k) != "", at(k)) for k in ("file_path", "path", "command", "query", "name")], F.lit(""))
    detail = F.when(files, at("file_path")).when(shell, command).when(F.col("low").isin("grep", "search", "glob"), at("pattern")).when(F.col("low").isin("agent", "task"), F.substring(at("description"), 1, 80)).otherwise(F.substring(some, 1, 80))
    detail = F.coalesce(detail, F.lit(""))
    edited = F.greatest(line_count(at("old_string")), line_count(at("new_string")))
    lines = F.when(F.col("low").isin("read", "view"), line_count(F.col("output"))).when(F.col("low").isin(*TOOL_KINDS["edit"]), F.when(edited > 0, edited).otherwise(line_count(at("content"))))
    shown = detail if depth == "full" else F.when(tool.isin("read", "edit") & (detail != ""), file_kind(detail))
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("idx", "place")) - 1
    return c.select("session_id", order.alias("step"), tool.alias("tool"), shown.alias("detail"), F.when(lines > 0, lines).alias("lines"), F.when(tests, test_result(F.col("output"))).alias("outcome"))


def workflow_lines(steps: DataFrame) -> DataFrame:
    """session_id, line: the steps in a row; of more than seven the first five and the last two."""
    head = F.concat(F.upper(F.substring("tool", 1, 1)), F.lower(F.substring("tool", 2, 100)))
    text = F.concat_ws(" ", head, F.when(F.col("detail") != "", F.col("detail")), F.when(F.col("lines").isNotNull(), F.format_string("(%d lines)", "lines")), F.when(F.col("outcome").isNotNull(), F.format_string("(%s)", "outcome")))
    n = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    shown = steps.withColumn("n", n).filter("n <= 7 or step < 6 or step >= n - 2")
    gap = (F.col("n") > 7) & (F.col("step") == 5)
    word = F.when(gap & (F.col("step") < F.col("n") - 2), F.format_string("... %d more ...", F.col("n") - 7)).otherwise(text)
    return shown.select("session_id", "step", word.alias("word")).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "word"))), lambda x: x["word"]), " → ").alias("line"))


def first_sentence(text: Column, words: int = 15) -> Column:
    """The first sentence of the first line, so many words at most, with code, addresses and paths masked."""
    line = F.trim(F.regexp_replace(F.trim(F.regexp_extract(text, r"^([^\n]*)", 1)), r"<[^>]+>", ""))
    sentence = F.coalesce(*[F.when(F.contains(line, F.lit(s + " ")), F.concat(F.substring_index(line, s + " ", 1), F.lit(s))) for s in (".", "!", "?")], line)
    parts = F.filter(F.split(sentence, r"\s+"), lambda w: w != "")
    cut = F.when(F.size(parts) > words, F.concat(F.array_join(F.slice(parts, 1, words), " "), F.lit("..."))).otherwise(sentence)
    masked = F.regexp_replace(F.regexp_replace(cut, r"`[^`]+`", "[code]"), r"https?://\S+", "[url]")
    return F.regexp_replace(masked, r"[\w./\-]+/[\w./\-]+\.\w+", "[file]")


# Training


# Marks of a reply and of a command that still runs, what a wrapper puts before a message, settings that aren't the task's, and characters of frames.
REPLY, RUNNING = "[[reply_to_current]]", r"Command still running \(session (\S+),"
SYSTEM_HEAD = r"(?s)^System:\s*\[.*?\]\s*Exec completed\s*\(.*?\)\s*::.*?(?=Sender \(untrusted metadata\)|$)"
SENDER = r"(?s)Sender \(untrusted metadata\):\s*```json\s*\{.*?\}\s*```\s*"
OWN_SETTINGS = {"exec": ("workdir", "yieldMs", "timeout", "elevated", "host", "security", "ask"), "process": ("timeout", "offset", "limit")}
FRAME = "─│┌┐└┘├┤┬┴┼╭╮╰╯╱╲╳═║╔╗╚╝╠╣╦╩╬◇◆●○■□▪▫▸▹►◂◃◄"


def user_text(content: Column) -> Column:
    """A message without the wrapper of its sender, and the time that this puts before it."""
    bare = F.trim(F.regexp_replace(content, SYSTEM_HEAD, ""))
    inner = F.trim(F.regexp_replace(bare, SENDER, ""))
    return F.when(F.regexp_like(bare, F.lit(SENDER)), F.trim(F.regexp_replace(inner, r"(?s)^\[.*?\]\s*", ""))).otherwise(inner)


def clean_output(text: Column) -> Column:
    """text less lines of frames and the bars at lines' ends."""
    decorated = lambda line: (F.length(F.trim(line)) > 3) & (F.length(F.trim(line)) - F.length(F.regexp_replace(F.trim(line), f"[{FRAME}]", "")) > 0.8 * F.length(F.trim(line)))
    kept = F.filter(F.split(text, "\n"), lambda line: ~decorated(line))
    return F.array_join(F.transform(kept, lambda line: F.regexp_replace(F.regexp_replace(line, r"^[│┃┆┇┊┋]+\s?", ""), r"\s?[│┃┆┇┊┋]+$", "")), "\n")


def clean_input(tool: Column, input: Column) -> Column:
    """A call's input as a JSON object less what only the runner needs."""
    given = F.from_json(input, "map<string,string>")
    out = F.when(F.lit(False), input)
    for name, keys in OWN_SETTINGS.items():
        out = out.when(tool == name, F.to_json(F.map_filter(given, lambda k, v: ~k.isin(*keys))))
    return out.otherwise(input)


def training_steps(messages: DataFrame) -> DataFrame:
    """session_id, turn, step, type, name, call, text, status: what a turn of the user leads to, as reasoning, calls, results and the reply.

    A command that still runs has its result in the first later `process` call of its session's id
    in the turn; a result that never comes, or that finds no session, is lost.
    """
    w = Window.partitionBy("session_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    m = messages.withColumn("turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w) - 1).filter("turn >= 0 and role = 'assistant'")
    reply = F.contains(F.coalesce("content", F.lit("")), F.lit(REPLY))
    last = m.filter(reply).groupBy("session_id", "turn").agg(F.max("idx").alias("reply_at"))
    work, said = m.filter(~reply), m.filter(reply).join(last, ["session_id", "turn"]).filter("idx = reply_at")
    thought = F.concat_ws("\n\n", F.when(F.trim("thinking") != "", F.trim("thinking")), F.when(F.trim("content") != "", F.trim("content")))
    none = F.lit(None).cast("string")
    row = lambda f, place, kind, name, call, text, status: f.select("session_id", "turn", "idx", place.cast("int").alias("place"), F.lit(kind).alias("type"), name.alias("name"), call.alias("call"), text.alias("text"), status.alias("status"))
    reasons = row(work.withColumn("t", thought).filter("t <> ''"), F.lit(-1), "reasoning", none, none, F.col("t"), none)
    uses = work.select("session_id", "turn", "idx", F.posexplode("tools").alias("place", "t")).select("session_id", "turn", "idx", "place", "t.*").withColumn("output", F.coalesce("output", F.lit(""))).withColumn("order", F.col("idx").cast("long") * 100_000 + F.col("place"))
    polled = F.get_json_object("input", "$.sessionId")
    polls = uses.filter((F.col("tool") == "process") & (polled != "")).select("session_id", "turn", polled.alias("running"), F.col("order").alias("poll"), F.col("idx").alias("poll_idx"), F.col("place").alias("poll_place"), F.col("output").alias("polled"))
    made = uses.filter(~((F.col("tool") == "process") & F.coalesce(polled != "", F.lit(False)))).withColumn("call", F.concat_ws("_", F.lit("tc"), "turn", "idx", "place")).withColumn("running", F.regexp_extract("output", RUNNING, 1))
    asked = row(made, 2 * F.col("place"), "tool_call", F.coalesce("tool", F.lit("unknown")), F.col("call"), clean_input(F.col("tool"), F.col("input")), none)
    at_once = row(made.filter("running = ''"), 2 * F.col("place") + 1, "tool_result", none, F.col("call"), clean_output(F.col("output")), F.coalesce("status", F.lit("unknown")))
    # Commands wait in order under their session's id; a poll after the start of the next one belongs to that.
    waits = made.filter("running <> ''").withColumn("next", F.lead("order").over(Window.partitionBy("session_id", "turn", "running").orderBy("order")))
    met = waits.join(polls, ["session_id", "turn", "running"], "left").withColumn("fits", (F.col("poll") > F.col("order")) & (F.col("next").isNull() | (F.col("poll") < F.col("next"))))
    first = met.groupBy("session_id", "turn", "idx", "place", "call", "running").agg(F.min_by(F.struct("poll_idx", "poll_place", "polled"), F.when(F.col("fits"), F.col("poll"))).alias("p"))
    found = (F.col("p.polled") != "") & (F.col("p.polled") != F.concat(F.lit("No session found for "), F.col("running")))
    late = first.select("session_id", "turn", F.coalesce("p.poll_idx", F.lit(1 << 30)).alias("idx"), F.coalesce("p.poll_place", "place").alias("place"), "call", F.when(found, clean_output(F.col("p.polled"))).alias("text"), F.when(found, "success").otherwise("lost").alias("status"))
    results = row(late, 2 * F.col("place") + 1, "tool_result", none, F.col("call"), F.col("text"), F.col("status"))
    final_idx = F.lit((1 << 30) + 1)
    thinks = row(said.filter("trim(thinking) <> ''").withColumn("idx", final_idx), F.lit(0), "reasoning", none, none, F.trim("thinking"), none)
    answer = F.trim(F.replace("content", F.lit(REPLY)))
    replies = row(said.withColumn("a", answer).filter("a <> ''").withColumn("idx", final_idx), F.lit(1), "message", none, none, F.col("a"), none)
    out = reasons.union(asked).union(at_once).union(results).union(thinks).union(replies)
    step = F.row_number().over(Window.partitionBy("session_id", "turn").orderBy("idx", "place", "type", "call")) - 1
    return out.withColumn("step", step).select("session_id", "turn", "step", "type", "name", "call", "text", "status")


def training_rows(messages: DataFrame) -> DataFrame:
    """turn_id, session_id, turn, input, output (JSON): a row for each turn of the user that says something and leads to something."""
    asked = messages.filter("role = 'user'").select("session_id", (F.row_number().over(Window.partitionBy("session_id").orderBy("idx")) - 1).alias("turn"), user_text(F.coalesce("content", F.lit(""))).alias("input"))
    steps = training_steps(messages).groupBy("session_id", "turn").agg(F.array_sort(F.collect_list(F.struct("step", "type", "name", "call", "text", "status"))).alias("s"))
    plain = F.transform("s", lambda x: F.struct(x["type"].alias("type"), x["name"].alias("name"), x["call"].alias("id"), x["text"].alias("text"), x["status"].alias("status")))
    out = asked.filter("input <> ''").join(steps, ["session_id", "turn"])
    return out.select(F.concat(F.col("session_id").cast("string"), F.lit("_"), F.lpad(F.col("turn").cast("string"), 3, "0")).alias("turn_id"), "session_id", "turn", "input", F.to_json(plain).alias("output"))


# Places where sessions are cut


# Folders that belong to the system.
SYSTEM_PATH = r"^/(?:usr|opt|etc|var|tmp|proc|sys)/"


def project_prefix(path: Column) -> Column:
    """The first three parts of a path; null for shorter ones and the system's."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when((F.size(parts) >= 3) & ~F.regexp_like(path, F.lit(SYSTEM_PATH)), F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, 3), "/")))


def compaction_boundaries(messages: DataFrame) -> DataFrame:
    """session_id, idx: messages right after a compaction."""
    before = F.lag("compaction").over(Window.partitionBy("session_id").orderBy("idx"))
    return messages.withColumn("b", before).filter("b").select("session_id", "idx")


def workspace_switches(messages: DataFrame) -> DataFrame:
    """session_id, idx: messages whose calls go to another folder, or to files of another project, than the call before that went anywhere."""
    c = calls(messages.filter("role = 'assistant'"))
    order = Window.partitionBy("session_id").orderBy("idx", "place").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda key: F.get_json_object("input", f"$.{key}")
    target = F.regexp_replace(F.regexp_extract(F.coalesce(at("command"), F.col("input")), r"\bcd\s+([^\s;&|]+)", 1), "/+$", "")
    folder = F.when(F.col("tool").isin("bash", "exec") & (target != ""), target)
    prefix = F.when(F.col("tool").isin("read", "edit", "write"), project_prefix(F.coalesce(at("file_path"), at("path"))))
    c = c.withColumn("folder", folder).withColumn("prefix", prefix)
    c = c.withColumn("old_folder", F.last("folder", True).over(order)).withColumn("old_prefix", F.last("prefix", True).over(order))
    new, old = project_prefix(F.col("folder")), project_prefix(F.col("old_folder"))
    moved = F.when(new.isNotNull() & old.isNotNull(), new != old).otherwise(F.col("folder") != F.col("old_folder"))
    return c.filter(moved | (F.col("prefix") != F.col("old_prefix"))).select("session_id", "idx").distinct()


def segment_table(split: DataFrame, reasons: DataFrame) -> DataFrame:
    """A row for each segment of split messages (session_id, idx, segment, segment_id): its range, times, counts, title and reason (session_id, idx, reason)."""
    clean = ~F.coalesce("compaction", F.lit(False))
    role = lambda r: F.sum(F.when(clean & (F.col("role") == r), 1).otherwise(0))
    fenced = F.size(F.split("content", "```")) >= 3
    inner = F.when(fenced, F.element_at(F.split("content", "```"), -1)).otherwise(F.col("content"))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(inner), r"(?s)^\[.*?\]\s*", ""), r"^Sender\s*\(untrusted metadata\):\s*", ""))
    out = split.groupBy("session_id", "segment", "segment_id").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min_by("at", F.when(clean & F.col("at").isNotNull(), F.col("idx"))).alias("start_time"), F.max_by("at", F.when(clean & F.col("at").isNotNull(), F.col("idx"))).alias("end_time"),
        role("user").alias("user_messages"), role("assistant").alias("assistant_messages"), F.sum(F.when(clean & (F.col("role") == "assistant"), F.greatest(F.size(F.coalesce("tools", F.array().cast(_TOOL))), F.lit(0))).otherwise(0)).alias("tool_uses"),
        F.min_by(text, F.when(clean & (F.col("role") == "user") & (text != ""), F.col("idx"))).alias("said"), F.sum(F.when(clean, 1).otherwise(0)).alias("n"),
    )
    out = out.filter("n > 0").join(reasons.select("session_id", F.col("idx").alias("first_idx"), "reason"), ["session_id", "first_idx"], "left")
    title = F.coalesce(shortened(F.col("said"), least=0), F.lit("Untitled segment"))
    return out.select("session_id", "segment", "segment_id", "first_idx", "last_idx", "start_time", "end_time", "user_messages", "assistant_messages", "tool_uses", title.alias("title"), F.coalesce("reason", F.lit("initial_segment")).alias("reason"))


def markdown(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id, card: a session as Markdown: title, facts, and its messages with their calls."""
    tools = F.array_join(F.transform(F.coalesce("tools", F.array().cast(_TOOL)), lambda t: F.concat(F.lit("\n- `"), F.coalesce(t["tool"], F.lit("unknown")), F.lit("` "), F.coalesce(t["status"], F.lit("")))), "")
    part = F.concat(F.lit("### "), F.initcap("role"), F.lit("\n\n"), F.coalesce("content", F.lit("")), tools)
    body = messages.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("body"))
    head = F.concat(F.lit("# "), F.coalesce("display_title", "session_id"), F.lit("\n\n- project: "), F.coalesce("project", F.lit("")), F.lit("\n- model: "), F.coalesce("model", F.lit("")), F.lit("\n\n"))
    return sessions.join(body, "session_id").select("session_id", F.concat(head, "body").alias("card"))
