"""The mistake detector: what texts say, and a small session for each rule."""

import json

import pytest
from pyspark.sql import functions as F

from engramite.operators import lineage, mistakes
from engramite.session import written

SAYS = [
    ("I was wrong about the parser.", True), ("Actually, I misread the file.", True), ("You're right, that was my mistake.", True), ("I was wrong, or maybe not.", False), ("Was it so that I was wrong?", False),
    ("The user said `I was wrong` there.", False), ("```\nI was wrong\n```\nAll good.", False), ("````\n```\nI was wrong\n````\nI made a mistake.", True), ('He wrote "I was wrong" to me.', False), ("> I was wrong\nfine", False),
    ("I ran the wrong command intentionally.", False), ("I ran the wrong command, not intentionally.", True), ("I ran the wrong command.", True), ("It works; I should have checked the config.", True), ("It works, and I incorrectly assumed a default.", True), ("Sorry about that.", False), (None, False), ("", False),
]
CORRECTS = [("You are wrong.", True, None), ("That's not what I asked for", True, None), ("You ran the wrong command", True, "command"), ("This is wrong, undo the last edit", True, "edit"), ("the edit is fine", False, None), ("`you are wrong`", False, None)]


def test_what_texts_say(spark):
    rows = spark.createDataFrame(list(enumerate(t for t, _ in SAYS)), "n long, text string").withColumn("plain", mistakes.prose(F.coalesce("text", F.lit(""))))
    got = {r.n: bool(r.found) for r in rows.select("n", mistakes.admissions(F.col("plain")).alias("found")).collect()}
    assert {SAYS[n][0]: v for n, v in got.items()} == dict(SAYS)
    asked = spark.createDataFrame(list(enumerate(t for t, *_ in CORRECTS)), "n long, text string").withColumns({"actor": F.lit("human"), "kind": F.lit("text"), **{c: F.lit(None).cast("string") for c in ("command", "name")}})
    told = {CORRECTS[r.n][0]: (r.corrects, r.noun) for r in mistakes.signals(asked).collect()}
    assert told == {t: (c, n) for t, c, n in CORRECTS}
    commands = {"uv run pytest -x": "pytest", "python -m pytest tests": "pytest", "pytest": "pytest", "'npm' test": "npm", "cargo test": "cargo", "python -m pytester": "python"}
    found = spark.createDataFrame([(c,) for c in commands], "c string").select("c", mistakes.command_intent(F.col("c"))).collect()
    assert {r[0]: r[1] for r in found} == commands
    pairs = [("see src/a.py, it", "src/a.py", True), ("see src/a.py:12.", "src/a.py", True), ("see xsrc/a.py", "src/a.py", False), ("see src/a.pyc", "src/a.py", False), ("end src/a.py.", "src/a.py", True), ("a.b\\Ec", "b\\Ec", False), ("x \\e y", "\\E", True)]
    got = spark.createDataFrame([(t, v) for t, v, _ in pairs], "t string, v string").select(mistakes.names(F.lower("t"), F.col("v"))).collect()
    assert [r[0] for r in got] == [w for *_, w in pairs]


def use(name, **fields):
    return ("assistant", "tool_use", name, fields, None, None)


def bash(command):
    return use("Bash", command=command)


def result(of, failed=False, text="ok"):
    return ("tool", "tool_result", None, {}, text, failed, of)


def says(text, kind="text", actor="assistant"):
    return (actor, kind, None, {}, text, None)


EDIT, OTHER, TEST = use("Edit", file_path="src/a.py", old="1"), use("Write", file_path="src/b.py"), bash("pytest tests")
CHANGE = [EDIT, result(0), TEST, result(2, True, "FAILED src/a.py:1 - assert")]
#: Session to its events (a result names the event of its use) and what is found: event, outcome, category, onset, recovery.
SESSIONS = {
    "objective": ([*CHANGE, use("Edit", file_path="src/a.py", old="2"), result(4), TEST, result(6)], {(3, "confirmed", "incorrect_change", 0, 7)}),
    "reverted": ([*CHANGE[:3], result(2, True, "FAILED"), bash("git checkout -- src/a.py"), result(4), TEST, result(6)], {(3, "confirmed", "incorrect_change", 0, 7)}),
    "other file": ([*CHANGE, OTHER, result(4), TEST, result(6)], set()),
    "other check": ([*CHANGE, EDIT, result(4), bash("pytest other"), result(6)], {(3, "unconfirmed", "invalid_command", 2, 7)}),
    "fix failed": ([*CHANGE, EDIT, result(4, True), TEST, result(6)], set()),
    "expected": ([says("A red phase first."), *[EDIT, result(1), TEST, result(3, True, "FAILED src/a.py"), EDIT, result(5), TEST, result(7)]], {(4, "suppressed", "expected_failure", None, None)}),
    "transient": ([bash("curl x"), result(0, True, "HTTP 429: too many requests"), bash("curl x"), result(2)], {(1, "suppressed", "transient_failure", None, None)}),
    "retry": ([bash("git psuh"), result(0, True, "no such"), bash("git push"), result(2)], {(1, "unconfirmed", "invalid_command", 0, 3)}),
    "thinking": ([EDIT, result(0), says("I was wrong about src/a.py", "thinking"), use("Edit", file_path="src/a.py", old="3"), result(3)], {(2, "probable", "wrong_assumption", 0, 4)}),
    "thought only": ([says("I was wrong about it", "thinking")], {(0, "unconfirmed", "wrong_assumption", None, None)}),
    "named": ([EDIT, result(0), OTHER, result(2), says("I was wrong about src/b.py.")], {(4, "confirmed", "wrong_assumption", 2, None)}),
    "pointed": ([says("go on", actor="human"), EDIT, result(1), says("I made a mistake in that edit.")], {(3, "confirmed", "wrong_assumption", 1, None)}),
    "two edits": ([EDIT, result(0), OTHER, result(2), says("I made a mistake in that edit.")], {(4, "unconfirmed", "wrong_assumption", None, None)}),
    "too far": ([EDIT, result(0), *[says("on it")] * 9, says("I made a mistake in that edit.")], {(11, "unconfirmed", "wrong_assumption", None, None)}),
    "before the user": ([EDIT, result(0), says("next", actor="human"), says("I made a mistake in that edit.")], {(3, "unconfirmed", "wrong_assumption", None, None)}),
    "corrected": ([bash("rm x"), result(0), says("You ran the wrong command", actor="human"), says("You're right, I was wrong.")], {(2, "unconfirmed", "user_correction", 0, None), (3, "confirmed", "wrong_assumption", 0, None)}),
    "bridge refused": ([EDIT, result(0), says("This is wrong, look at that edit", actor="human"), says("You're right, I was wrong about src/z.py.")], {(2, "unconfirmed", "user_correction", 0, None), (3, "unconfirmed", "wrong_assumption", None, None)}),
    "changed mind": ([says("From now on use tabs; you are wrong", actor="human")], {(0, "suppressed", "requirement_change", None, None)}),
    "apology": ([says("Sorry, one moment."), says("I was wrong, or maybe not."), says(None), says("fine")], {(0, "suppressed", "admission", None, None), (1, "suppressed", "admission", None, None)}),
}


@pytest.mark.parametrize("window", [64])
def test_each_rule(spark, window):
    rows = []
    for session, (events, _) in SESSIONS.items():
        for n, event in enumerate(events):
            actor, kind, name, fields, text, failed, *of = event
            partner = of[0] if of else next((k for k, e in enumerate(events) if len(e) > 6 and e[6] == n), None)
            rows.append((session, n, f"{session}-{n}", f"{session}-{n - 1}" if n else None, actor, kind, name, {k: v for k, v in fields.items()}, text, failed, partner))
    # the same change and check, but the correction and the last check are on another branch
    for n, event in enumerate(SESSIONS["objective"][0]):
        actor, kind, name, fields, text, failed, *of = event
        partner = of[0] if of else n + 1
        rows.append(("branches", n, f"b{n}", None if not n else "b0" if n == 4 else f"b{n - 1}", actor, kind, name, dict(fields), text, failed, partner))
    rows.append(("lost", 0, None, None, "assistant", "text", None, {}, "I was wrong about src/a.py", None, None))
    frame = spark.createDataFrame(rows, "session string, no long, uuid string, parent string, actor string, kind string, name string, fields map<string,string>, text string, is_error boolean, partner long")
    marked = written(lineage.annotate(frame, "session", "uuid", "parent", "no", F.lit(True), F.lit(False)))
    events = written(marked.withColumns(mistakes.tool_columns(F.col("fields"))).drop("fields"))
    assert json.loads(events.where("session = 'objective' and no = 0").first().selector) == {"file_path": "src/a.py", "old": "1"}
    found = mistakes.detect(events, lineage.event_parents(events, marked, "session", "uuid", "no"), window).collect()
    got = {}
    for r in found:
        got.setdefault(r.session, set()).add((r.no, r.outcome, r.category, r.onset, r.recovery))
    assert got.pop("lost") == {(0, "unconfirmed", "wrong_assumption", None, None)} and "branches" not in got
    assert {s: got.get(s, set()) for s in SESSIONS} == {s: want for s, (_, want) in SESSIONS.items()}
    assert sum(map(len, got.values())) == sum(len(want) for _, want in SESSIONS.values())
