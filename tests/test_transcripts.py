"""Badges, titles, steps, training turns, places of cuts: small sessions with known answers."""

import pytest
from pyspark.sql import functions as F

from tracemill.operators import transcripts as M

TOOLS = "array<struct<tool:string,id:string,input:string,output:string,status:string>>"
SCHEMA = f"session_id string, idx int, role string, content string, thinking string, at string, tools {TOOLS}, compaction boolean"


def rows(spark, **sessions):
    """Messages of sessions, each (role, content, calls as (tool, input, output))."""
    out = []
    for name, messages in sessions.items():
        for i, (role, content, *calls) in enumerate(messages):
            out.append((name, i, role, content, None, f"2026-01-01T10:{i:02d}:00", [(t, None, a, o, "success") for t, a, o in calls], False))
    return spark.createDataFrame(out, SCHEMA)


def by_session(frame, column):
    return {r["session_id"]: r[column] for r in frame.collect()}


def test_outcomes(spark):
    bash = lambda out: ("assistant", "x", ("Bash", "{}", out))
    m = rows(spark, none=[("user", "hi"), ("assistant", "ho")], reads=[("user", "a"), ("assistant", "b", ("Read", "{}", "Error"))], passed=[("user", "a"), bash("5 passed")], failed=[("user", "a"), bash("5 passed"), bash("1 failed")],
             built=[("user", "a"), bash("error TS12: no"), bash("5 passed")], left=[("user", "a"), bash("fine"), ("user", "still there?")], late=[("user", "a"), ("assistant", "b"), bash("Traceback")], early=[("user", "a"), bash("Traceback"), ("assistant", "b"), ("assistant", "c"), ("assistant", "d")], done=[("user", "a"), bash("fine")])
    want = {"none": "analysis_only", "reads": "analysis_only", "passed": "tests_passed", "failed": "tests_failed", "built": "build_failed", "left": "partial", "late": "errored", "early": "completed", "done": "completed"}
    assert by_session(M.outcome_badges(m), "outcome_badge") == want


def test_values_and_risks(spark):
    m = rows(spark, science=[("user", "use numpy and scipy on data.csv"), ("assistant", "ok", ("Bash", "{}", "x"), ("Bash", "{}", "y"))], fixed=[("user", "it is broken"), ("assistant", "look"), ("assistant", "it works")], plain=[("user", "hello there"), ("assistant", "hi")])
    tokens = spark.createDataFrame([("science", 5)], "session_id string, tokens long")
    assert by_session(M.value_badges(m, tokens), "value_badges") == {"science": ["novel_domain", "scientific_workflow", "tool_rich"], "fixed": ["debugging"], "plain": []}
    people = "Ada Lovelace, Alan Turing, Grace Hopper, Kurt Goedel and Emmy Noether. Status Code"
    m = rows(spark, people=[("user", people + " status")], url=[("user", "see http://10.0.0.1 or http://a.corp")], clean=[("user", "nothing here")])
    secrets = spark.createDataFrame([("url", 2)], "session_id string, secrets long")
    found = M.risk_badges(m, secrets)
    assert by_session(found, "risk_badges") == {"people": ["names_detected"], "url": ["secrets_detected", "private_url", "manual_review"], "clean": []}
    assert by_session(found, "sensitivity") == pytest.approx({"people": 0.5, "url": 0.9, "clean": 0.0})


def test_tasks_and_titles(spark):
    m = rows(spark, a=[("user", "fix the bug"), ("user", "add a thing")], b=[("user", "hello")], c=[("assistant", "x")], d=[("user", "qwerty asdf")])
    assert by_session(M.task_types(m), "task_type") == {"a": "debugging", "b": "trivial", "c": "trivial", "d": "unknown"}
    long = "word " * 30
    m = rows(spark, a=[("user", "init"), ("user", "<command-name>x</command-name>"), ("user", "Please  <b>do</b> it\nnow")], b=[("user", long)], c=[("user", "[Request interrupted by user]")], d=[("user", "x" * 100)])
    sessions = spark.createDataFrame([(s, f"p:{s}") for s in "abcd"], "session_id string, project string")
    titles = by_session(M.display_titles(m, sessions), "display_title")
    assert titles["a"].strip() == "do it" or titles["a"] == " do it" or titles["a"] == "Do it"
    assert titles["b"] == ("word " * 15).strip() + "..." and titles["c"] == "p:c" and titles["d"] == "x" * 77 + "..."


def test_digest_and_steps(spark):
    m = rows(spark, a=[("user", "go"), ("assistant", "plan", ("Read", '{"file_path":"/a/test_x.py"}', "1\n2\n"), ("Bash", '{"command":"cd x && pytest -q"}', "4 passed, 1 failed")), ("assistant", "hm", ("Bash", '{"command":"cd x && pytest -q"}', "5 passed"), ("Edit", '{"file_path":"/a/b.py","old_string":"a","new_string":"b\\nc"}', ""))])
    digest = M.tool_digest(m).first()
    assert (digest["files_touched"], digest["commands_run"], digest["tool_counts"]) == (["/a/test_x.py", "/a/b.py"], ["cd x && pytest -q"], {"Read": 1, "Bash": 2, "Edit": 1})
    steps = [(r["tool"], r["detail"], r["lines"], r["outcome"]) for r in M.workflow_steps(m).orderBy("step").collect()]
    assert steps == [("read", "test file", 2, None), ("test", None, None, "4/5 passed"), ("test", None, None, "5/5 passed"), ("edit", "python file", 2, None)]
    assert M.workflow_lines(M.workflow_steps(m, "full")).first()["line"] == "Read /a/test_x.py (2 lines) → Test cd x && pytest -q (4/5 passed) → Test cd x && pytest -q (5/5 passed) → Edit /a/b.py (2 lines)"
    many = rows(spark, a=[("assistant", "x", *[("Grep", '{"pattern":"p"}', "")] * 9)])
    assert M.workflow_lines(M.workflow_steps(many)).first()["line"] == " → ".join(["Search"] * 5 + ["... 2 more ..."] + ["Search"] * 2)
    with pytest.raises(ValueError):
        M.workflow_steps(m, "deep")
    judged = [(r["step"], r["tool"], r["plan"], r["input"]) for r in M.judge_steps(m).orderBy("step").collect()]
    assert judged == [(0, "Read", "plan", "/a/test_x.py"), (1, "Bash", "", "cd x && pytest -q"), (2, "Bash", "hm", "cd x && pytest -q"), (3, "Edit", "", "/a/b.py")]


def test_plans_and_reflections(spark):
    m = rows(spark, a=[("user", "q"), ("assistant", "first I think"), ("assistant", "", ("Bash", "ls", "x")), ("assistant", "so"), ("assistant", "that was it"), ("user", "thanks"), ("assistant", "bye")])
    assert [(r["segment"], r["plan"], r["reflect"]) for r in M.judge_steps(m).collect()] == [(1, "first I think", "that was it")]


def test_training_rows(spark):
    wrapped = 'Sender (untrusted metadata): ```json {"a": 1} ``` [Sat 10:00] do it'
    running = "Command still running (session s1, pid 3)"
    m = rows(
        spark,
        a=[("assistant", "before"), ("user", wrapped), ("assistant", "I run", ("exec", '{"command":"make","timeout":"5"}', running)), ("assistant", "", ("process", '{"sessionId":"s1"}', "│ built │")), ("assistant", "", ("exec", '{"command":"x"}', "Command still running (session s2, pid 4)")),
           ("assistant", "[[reply_to_current]] done"), ("user", "and?")],
    )
    got = [(r["turn"], r["type"], r["text"], r["status"]) for r in M.training_steps(m).orderBy("turn", "step").collect()]
    assert got == [(0, "reasoning", "I run", None), (0, "tool_call", '{"command":"make"}', None), (0, "tool_result", "built", "success"), (0, "tool_call", '{"command":"x"}', None), (0, "tool_result", None, "lost"), (0, "message", "done", None)]
    made = M.training_rows(m).collect()
    assert [(r["turn_id"], r["input"]) for r in made] == [("a_000", "do it")]


def test_cuts(spark):
    go = lambda folder: ("assistant", "x", ("bash", f'{{"command":"cd {folder} && ls"}}', ""))
    m = rows(spark, a=[("user", "1"), go("/w/team/one/src"), go("/w/team/one/doc"), go("/usr/lib/x"), ("user", "2"), go("/w/team/two"), ("assistant", "", ("read", '{"path":"/w/team/two/a"}', "")), ("assistant", "", ("edit", '{"file_path":"/w/team/three/b"}', ""))])
    assert sorted(r["idx"] for r in M.workspace_switches(m).collect()) == [3, 5, 7]
    packed = m.withColumn("compaction", F.col("idx").isin(2, 7))
    assert [r["idx"] for r in M.compaction_boundaries(packed).collect()] == [3]
    split = packed.withColumn("segment", F.when(F.col("idx") < 4, 0).otherwise(1)).withColumn("segment_id", F.concat("session_id", F.lit("_seg-"), "segment"))
    table = M.segment_table(split, spark.createDataFrame([("a", 4, "workspace")], "session_id string, idx int, reason string")).orderBy("segment").collect()
    assert [(r["first_idx"], r["last_idx"], r["user_messages"], r["tool_uses"], r["title"], r["reason"]) for r in table] == [(0, 3, 1, 2, "1", "initial_segment"), (4, 7, 1, 2, "2", "workspace")]


def test_judges(spark):
    texts = ['{"substance": 9, "resolution": "Tests-Passed", "effort_estimate": 7, "task_type": " ", "session_tags": ["A b", ""], "project_areas": [" x "], "display_title": " t "}', '{"quality": 4, "outcome_label": "nope", "value_labels": "no list"}', '{"substance": "4"}']
    got = M.judged(spark.createDataFrame([(t,) for t in texts], "json string")).collect()
    assert [(r["substance"], r["resolution"], r["effort"], r["task_type"], r["tags"], r["areas"], r["title"]) for r in got][:2] == [(3, "resolved", 1.0, "unknown", ["a_b"], ["x"], "t"), (4, "", None, "unknown", [], [], "")]


def test_kinds(spark):
    frame = spark.createDataFrame([("/a/Test_x.py", "make all && git status", "Fix it. Then more", "12 passed")], "p string, c string, s string, o string")
    r = frame.select(M.file_kind(F.col("p")).alias("p"), M.command_kind(F.col("c")).alias("c"), M.first_sentence(F.col("s")).alias("s"), M.test_result(F.col("o")).alias("o"), M.first_sentence(F.lit("see `x` at https://a.b/c and src/a.py now")).alias("m")).first()
    assert tuple(r) == ("test file", "vcs", "Fix it.", "12/12 passed", "see [code] at [url] and [file] now")


def test_texts(spark):
    from datetime import date

    from tracemill.functions import texts as T

    r = spark.range(1).select(T.masked(F.lit("ghp_abcdefghij")), T.masked(F.lit("short")), T.masked(F.lit("npm_abcdefghijk")), T.short_model(F.lit("anthropic/x-1-20250101")), T.squashed(F.lit(" a\n b "), 9), T.time_ago(F.lit(None).cast("timestamp"), F.current_timestamp())).first()
    assert tuple(r) == ("ghp_***ghij", "***", "npm_abcd***hijk", "x-1", "a b", "recently")
    nested = spark.range(1).select(T.json_strings(F.lit('{"a": {"b": ["x", {"c": "y"}], "n": 1}, "z": ""}')).alias("s"), T.json_strings(F.lit("no")).alias("n"), T.json_summary(F.lit('{"x": "later", "text": "first"}')).alias("t")).first()
    assert [tuple(x) for x in nested["s"]] == [("a.b[0]", "x"), ("a.b[1].c", "y")] and nested["n"] == [] and nested["t"] == "first · later"
    assert (T.since_day("week", date(2026, 4, 22)), T.gap_minutes("1h")) == (date(2026, 4, 20), 60)
    with pytest.raises(ValueError):
        T.gap_minutes("0m")
    from tracemill.operators.redaction import widened_locations

    m = spark.createDataFrame([("s", 0, '[{"arguments": {"k": "v"}}]', '{"a": {"t": "u"}}', '"me"')], "session_id string, idx int, invocations string, extra string, author string")
    assert [(x["field"], x["text"]) for x in widened_locations(m).collect()] == [("invocations[0].arguments.k", "v"), ("extra.a.t", "u"), ("author", "me")]
