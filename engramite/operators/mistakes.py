"""Mistakes in sessions: admissions, corrections and chains of failing and passing checks, along lineages.

What an event says is told by columns over its prose (code, quotations and quoted lines left out). What happened
around it is told by joins: each failing result, admission and correction is paired with at most ``WINDOW`` events before it
along its lineage and as many below it, and every rule is an aggregate over these pairs. So no session is gathered, and
rows are bounded by ``WINDOW`` for each such event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramite.operators import lineage
from engramite.session import written

#: Events before and after that a rule looks at, and events between an action and the words that point at it.
WINDOW, NEAR = 64, 8

# Tools, and the words by which signals are told.
MUTATIONS = ["Edit", "Write", "MultiEdit", "NotebookEdit"]
CAUSAL = [*MUTATIONS, "Bash"]
ARTIFACT_FIELDS = ["file_path", "notebook_path"]
COMMAND_NOUNS = ["command", "flag", "argument", "option", "profile"]
VALIDATION = r"^(?:uv\s+run\s+)?(?:pytest\b|python\s+-m\s+pytest\b|cargo\s+test\b|npm\s+(?:run\s+)?test\b|xcodebuild\b|vendor/bin/phpunit\b)"
REVERT = r"(?i)(?:^|\s)git\s+(?:restore\b|revert\b|checkout\s+--(?=\s|$))"
EXPECTED_FAILURE = r"(?i)\b(?:tdd|red\s+phase|write\s+(?:a\s+)?failing\s+test|(?:expect(?:ed)?|should)\b[^.!?]*\bfail)\b"
TRANSIENT = r"(?i)\b(?:timed?\s*out|timeout|rate\s*limit|too\s+many\s+requests|permission\s+denied|connection\s+(?:reset|refused|failed|timed)|temporary(?:ily)?\s+unavailable|service\s+unavailable|http\s*429)\b"
REQUIREMENT_CHANGE = r"(?i)\b(?:I\s+changed\s+my\s+mind|I\s+(?:want|prefer|decided)|let(?:'s|\s+us)\b[^.!?]*\binstead|new\s+requirement|different\s+tradeoff|from\s+now\s+on)\b"
APOLOGY = r"(?i)\b(?:sorry|I\s+apologize)\b"
RETRACTION = r"(?i)\b(?:or\s+maybe\s+not|but\s+perhaps\s+not|unless\b|I(?:'m|\s+am)\s+not\s+sure|I\s+still\s+need\s+to\s+verify)\b"
USER_CORRECTION = r"(?i)\b(?:you\s+(?:were|are)\s+(?:wrong|incorrect)|you\s+(?:misunderstood|assumed|changed\s+the\s+wrong|used\s+the\s+wrong)|(?:that|this)\s+(?:is|was|'s)\s+(?:wrong|incorrect)|not\s+what\s+I\s+(?:asked|said))\b"
USER_COMMAND = r"(?i)\byou\s+(?:(?:gave|sent)\s+me|provided|ran|used|passed)\s+the\s+(?:wrong|incorrect)\s+(command|flag|argument|option|profile)\b"
ACKNOWLEDGED = r"(?i)^\s*you(?:'re|\s+are)\s+right\b"
DEICTIC = r"(?i)\b(?:that|this|the)\s+(?:[\w./-]+\s+){0,3}(edit|change|write|command|revert|patch|implementation)\b"
OBJECT = r"(?i)\b(command|flag|argument|option|profile)\b"
ARTIFACT = r"(?<![\w.-])((?:[A-Za-z]:)?(?:(?:[/\\]?[\w.-]+)[/\\])*[\w.-]*[\w-]\.[A-Za-z0-9]+)(?::\d+)?(?=$|[\s),;!?]|\.(?=$|\s))"
CLAUSES = r"(?i)(?<=[.!?])\s+|[;\n]+|(?:,\s*+|(?<!\s)\s++)(?:and|but|while|because)\s+(?=(?:I|you|the|Correction)\b)"
QUOTED = "(\"[^\"\\n]*\"|“[^”\\n]*”|‘[^’\\n]*’|(?<!\\w)'[^'\\n]*'(?!\\w))"
OPENING = r"(?i)^\s*(?:(?:actually|admittedly|clearly|yes|right|you(?:'re|\s+are)\s+right|sorry(?:\s+about\s+that)?|I\s+apologize|on\s+reflection|after\s+checking)(?:(?:\s*[—–]\s*)|(?:\s*[,:-]\s+)|\s+))?"
GUARDED = (
    r"(?:Correction\s+first\s*:\s*[^.!?;\n]{1,160}?[—–]\s*I\s+gave\s+you\s+the\s+wrong\s+command\b"
    r"|I\s+(?:(?:gave|sent)\s+you|provided|ran|used|passed)\s+the\s+(?:wrong|incorrect)\s+(?:command|flag|argument|option|profile)\b"
    r"|The\s+command\s+I\s+gave\s+you\s+was\s+(?:wrong|incorrect)\b|Correction\s*:\s*I\s+dropped\s+the\s+[\w./-]+\s+flag\b)"
)
OWNED = (
    r"I\s+was\s+wrong\b|I\s+(?:misunderstood|misread|misinterpreted)\b|I\s+(?:incorrectly|wrongly)\s+(?:assumed|thought|said|stated|changed|edited|implemented|used|claimed)\b"
    r"|my\s+(?:assumption|diagnosis|interpretation|change|edit)\s+(?:was|is)\s+(?:wrong|incorrect)\b|(?:that|this)\s+was\s+my\s+(?:mistake|error)\b"
    r"|I\s+(?:made|introduced|caused)\s+(?:an?|the)\s+(?:mistake|error|bug)\b|I\s+should\s+have\s+(?:checked|read|verified|tested|confirmed)\b"
)
OMITTED = r"I\s+accidentally\s+omitted\s+the\s+[\w./-]+\s+argument\b|I\s+forgot\s+to\s+include\s+the\s+[\w./-]+\s+option\b|I\s+should\s+have\s+passed\s+the\s+[\w./-]+\s+profile\b"
WRONG_COMMAND = r"I\s+(?:(?:gave|sent)\s+you|provided|ran|used|passed)\s+the\s+(?:wrong|incorrect)\s+(?:command|flag|argument|option|profile)\b|The\s+command\s+I\s+gave\s+you\s+was\s+(?:wrong|incorrect)\b|Correction\s*:\s*I\s+dropped\s+the\s+[\w./-]+\s+flag\b"
ON_PURPOSE = r"(?:as\s+requested|intentionally|deliberately|purposely|on\s+purpose|by\s+design|to\s+test|(?:for|as)\s+(?:(?:a|the)\s+)?(?:negative\s+)?test(?:ing)?)\b"

PLAIN = f"(?:{OMITTED}|{OWNED})"
COMMAND_ACK = f"(?i)\\b(?:{WRONG_COMMAND}|{OMITTED})"
LEXEME = rf"(?i)\b(?:{OWNED}|The\s+command\s+I\s+gave\s+you\s+was\b[^.!?;\n]{{0,48}}\b(?:wrong|incorrect)\b)"


def prose(text: Column) -> Column:
    """The text without fenced blocks, inline code, quotations and lines that quote."""
    lines = F.split(text, r"\r\n|[\n\r]")
    fence = lambda x: F.regexp_extract(x, r"^\s*(`{3,}|~{3,})", 1)

    def add(state: Column, line: Column) -> Column:
        mark, inside = fence(line), state["fence"] != ""
        ends = inside & (mark != "") & (F.substring(mark, 1, 1) == F.substring(state["fence"], 1, 1)) & (F.length(mark) >= F.length(state["fence"]))
        now = F.when(ends, "").when(inside, state["fence"]).otherwise(mark)
        return F.struct(now.alias("fence"), F.when(inside | (mark != ""), state["kept"]).otherwise(F.concat(state["kept"], F.array(line))).alias("kept"))

    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<string>").alias("kept"))
    open_text = F.when(text.rlike("(?m)^\\s*(?:```|~~~)"), F.array_join(F.aggregate(lines, start, add, lambda s: s["kept"]), "\n")).otherwise(F.array_join(lines, "\n"))
    bare = F.regexp_replace(F.regexp_replace(open_text, "`[^`\\n]*(?:`|$)", " "), QUOTED, " ")
    return F.array_join(F.filter(F.split(bare, "\n"), lambda x: ~F.ltrim(x).startswith(">")), "\n")


def admissions(plain: Column) -> Column:
    """The clauses of a prose that admit a mistake; none if it is taken back."""

    def admits(clause: Column) -> Column:
        guarded = clause.rlike(OPENING + GUARDED)
        tail = F.regexp_replace(F.regexp_replace(clause, OPENING + GUARDED, ""), rf"(?i)\b(?:not|never)\s+{ON_PURPOSE}", " ")
        said = F.when(guarded, ~tail.rlike(rf"(?i)\b{ON_PURPOSE}")).otherwise(clause.rlike(OPENING + PLAIN))
        return said & (F.trim(clause) != "") & ~F.rtrim(clause).endswith("?")

    return F.when(plain.rlike(RETRACTION), F.array().cast("array<string>")).otherwise(F.filter(F.split(plain, CLAUSES), admits))


def admission_noun(clauses: Column) -> Column:
    """What the admissions point at (an edit, a command ...), if it is one thing."""

    def noun(clause: Column) -> Column:
        of_command = F.lower(F.regexp_extract(F.regexp_extract(clause, COMMAND_ACK, 0), OBJECT, 1))
        return F.when(of_command != "", of_command).otherwise(F.lower(F.regexp_extract(clause, DEICTIC, 1)))

    found = F.array_distinct(F.filter(F.transform(clauses, noun), lambda x: x != ""))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def correction_noun(plain: Column) -> Column:
    command, pointed = F.lower(F.regexp_extract(plain, USER_COMMAND, 1)), F.lower(F.regexp_extract(plain, DEICTIC, 1))
    return F.when(command != "", command).when(plain.rlike(USER_CORRECTION) & (pointed != ""), pointed)


def tool_columns(fields: Column) -> dict[str, Column]:
    """command, artifacts, values and selector from a tool's input, a map of strings."""
    texts = F.map_filter(fields, lambda k, v: v.isNotNull())
    return {
        "command": fields["command"], "artifacts": F.map_values(F.map_filter(texts, lambda k, v: k.isin(ARTIFACT_FIELDS) & (v != ""))), "values": F.map_values(texts),
        "selector": F.to_json(F.map_from_entries(F.array_sort(F.map_entries(texts)))),
    }


def command_intent(command: Column) -> Column:
    """The program of a command, with ``uv run`` left out and the ways to call pytest made one."""
    bare = F.regexp_replace(F.trim(command), r"^uv\s+run\s+", "")
    program = F.element_at(F.split(F.regexp_replace(bare, "[\"']", ""), r"\s+"), 1)
    return F.when(bare.rlike(r"^python\s+-m\s+pytest(?:\s|$)"), "pytest").otherwise(program)


def names(text: Column, value: Column) -> Column:
    """Whether a lower-case text with single spaces names a value, whole or with a line number."""
    plain = F.regexp_replace(F.lower(F.trim(value)), r"\s+", " ")
    quoted = F.concat(F.lit(r"(?<![\w.-])\Q"), F.replace(plain, F.lit("\\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?=$|[\s),;!?]|\.(?=$|\s)|:\d+(?=$|[\s),.;!?]))"))
    return (plain != "") & text.contains(plain) & F.regexp_like(text, quoted)


def _base(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def _names_any(text: Column, values: Column, artifacts: Column) -> Column:
    return F.exists(values, lambda v: names(text, v)) | F.exists(artifacts, lambda v: names(text, _base(v)))


def signals(events: DataFrame) -> DataFrame:
    """The events with what each says: plain, clauses, admits, noun, suppressed, changed, corrects, expected, check, revert, mutates."""
    made = events.withColumn("plain", prose(F.coalesce("text", F.lit("")))).withColumn("clauses", admissions(F.col("plain")))
    speaks, human = F.col("kind").isin("text", "thinking"), (F.col("actor") == "human") & (F.col("kind") == "text")
    assistant, plain, text = F.col("actor") == "assistant", F.col("plain"), F.coalesce("text", F.lit(""))
    admits = F.size("clauses") > 0
    corrects = human & (plain.rlike(USER_CORRECTION) | plain.rlike(USER_COMMAND))
    use = F.coalesce(F.col("kind") == "tool_use", F.lit(False))
    command, bash = F.coalesce("command", F.lit("")), F.coalesce(F.col("name") == "Bash", F.lit(False))
    revert = use & bash & command.rlike(REVERT)
    return made.withColumns({
        "admits": assistant & speaks & admits, "noun": F.when(human, correction_noun(plain)).otherwise(admission_noun(F.col("clauses"))),
        "suppressed": assistant & (F.col("kind") == "text") & ~admits & (plain.rlike(APOLOGY) | text.rlike(LEXEME) | text.rlike(COMMAND_ACK)),
        "changed": human & plain.rlike(REQUIREMENT_CHANGE), "corrects": corrects, "expected": speaks & plain.rlike(EXPECTED_FAILURE),
        "check": use & bash & F.lower(F.trim(command)).rlike(VALIDATION), "revert": revert, "mutates": use & (F.col("name").isin(MUTATIONS) | revert),
        "low": F.regexp_replace(F.lower(F.trim(plain)), r"\s+", " "), "acknowledges": plain.rlike(ACKNOWLEDGED),
    }).drop("clauses")


def _of(prefix: str, columns: list[str]) -> list[Column]:
    return [F.col(c).alias(f"{prefix}_{c}") for c in columns]


_FACTS = ["no", "kind", "actor", "name", "command", "artifacts", "values", "selector", "text", "is_error", "partner", "enter", "exit", "check", "revert", "mutates", "expected", "corrects", "low", "noun", "acknowledges", "uuid", "partner_error", "partner_enter", "partner_exit"]


def _share(a: str, b: str) -> Column:
    """Whether two intervals hold one another."""
    x, y, u, v = (F.col(c) for c in (f"{a}enter", f"{a}exit", f"{b}enter", f"{b}exit"))
    return ((x <= u) & (v <= y)) | ((u <= x) & (y <= v))


def _same_work(a: str, b: str) -> Column:
    """Whether a correction is of the same work: the same call, a common artifact, or a revert that names one."""
    tokens = lambda p: F.transform(F.split(F.coalesce(f"{p}_command", F.lit("")), r"\s+"), lambda x: F.regexp_replace(x, "[\"']", ""))
    same = (F.col(f"{a}_name") == F.col(f"{b}_name")) & (F.col(f"{a}_selector") == F.col(f"{b}_selector"))
    return same | F.arrays_overlap(f"{a}_artifacts", f"{b}_artifacts") | (F.col(f"{b}_revert") & F.arrays_overlap(F.col(f"{a}_artifacts"), tokens(b))) | (F.col(f"{a}_revert") & F.arrays_overlap(F.col(f"{b}_artifacts"), tokens(a)))


def _points_at(noun: Column, other: str) -> Column:
    """Whether a use is what a noun can mean."""
    return F.when(noun.isin(COMMAND_NOUNS), F.col(f"{other}_name") == "Bash").when(noun == "revert", F.col(f"{other}_revert")).otherwise(F.col(f"{other}_mutates"))


def detect(events: DataFrame, parents: DataFrame, window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """(session, no, outcome, category, onset, recovery): what the rules say of each event that has a signal; the first rule that holds counts.

    ``events``: session, no (order), uuid (of the record), actor (assistant, human, tool, system), kind (text, thinking,
    tool_use, tool_result), name, command, artifacts, values, selector (``tool_columns``), text, is_error, partner and
    the lineage (status, enter, exit). ``parents``: (session, no, parent) of ``lineage.event_parents``.
    ``outcome`` is suppressed, confirmed, probable or unconfirmed. Events without a lineage are judged by what they say
    alone; null texts say nothing; an empty frame gives an empty result.

    Suppressed: admissions that are negated, taken back or meant; changed requirements; checks that were expected to
    fail; passing failures of calls that succeed unchanged. Then: a change, a failing check, a correction of the same
    work and the same check passing (confirmed); a failing command and another of the same program that succeeds;
    admissions in thinking (probable with a linked action and its correction); corrections by the user; admissions in
    words (confirmed with a linked action). An action is linked if it alone is named, if it alone is pointed at within
    ``near`` events since the last human word, or through a user's correction just before.
    """
    own = events.where("session is not null and no is not null")
    partner = own.select("session", F.col("no").alias("partner"), F.col("is_error").alias("partner_error"), F.col("enter").alias("partner_enter"), F.col("exit").alias("partner_exit"))
    told = written(signals(own).join(partner, ["session", "partner"], "left"), "mistakes")
    facts = told.withColumnRenamed("session", "s").withColumnRenamed("no", "u")

    def others(prefix: str) -> DataFrame:
        return told.select(F.col("session").alias("s"), F.col("no").alias("other"), *_of(prefix, _FACTS))

    use = others("f").select("s", F.col("other").alias("partner"), *[f"f_{c}" for c in _FACTS])
    failed = facts.where("kind = 'tool_result' and is_error and partner is not null").join(use, ["s", "partner"]).select("s", "u", *_of("c", ["text", "enter", "exit"]), *[f"f_{c}" for c in _FACTS])
    failed = written(failed, "mistakes")
    words = facts.where("admits or corrects").select("s", "u", *_of("d", ["kind", "actor", "low", "noun", "acknowledges", "uuid", "enter", "exit", "corrects", "plain"]))
    words = written(words, "mistakes")
    asked = failed.select("s", "u").unionByName(words.select("s", "u"))
    back, ahead = (written(pairs, "mistakes") for pairs in lineage.around(parents, "session", "no", "parent", window, asked))
    succeeds = lambda p: F.col(f"{p}_partner").isNotNull() & ~F.coalesce(f"{p}_partner_error", F.lit(True))

    before = failed.join(back, ["s", "u"]).join(others("o"), ["s", "other"])
    after = failed.join(ahead, ["s", "u"]).join(others("e"), ["s", "other"])
    expected = before.where("f_check and o_expected and o_kind in ('text', 'thinking')").select("s", "u").distinct().withColumn("is_expected", F.lit(True))
    transient = after.where(F.col("c_text").rlike(TRANSIENT) & (F.col("e_kind") == "tool_use") & (F.col("e_name") == F.col("f_name")) & (F.col("e_selector") == F.col("f_selector")) & succeeds("e")).select("s", "u").distinct().withColumn("is_transient", F.lit(True))

    # change, failing check, correction, passing check
    nearest = before.where("f_check and o_mutates").groupBy("s", "u").agg(F.min_by(F.struct(*[F.col(f"o_{c}").alias(c) for c in _FACTS]), "n").alias("r"))
    roots = nearest.select("s", "u", *[F.col(f"r.{c}").alias(f"r_{c}") for c in _FACTS]).where(succeeds("r"))
    chains = failed.join(roots, ["s", "u"]).where((F.col("r_no") < F.col("r_partner")) & (F.col("r_partner") < F.col("f_no")) & (F.col("f_no") < F.col("u")))
    chains = chains.where(_share("c_", "r_") & _share("c_", "r_partner_") & _share("c_", "f_"))
    failure = F.regexp_replace(F.lower(F.trim(F.coalesce("c_text", F.lit("")))), r"\s+", " ")
    artifact = F.try_element_at("r_artifacts", F.lit(1))
    named = (F.size("r_artifacts") == 1) & (names(failure, artifact) | names(failure, _base(artifact)))
    steps = chains.join(ahead, ["s", "u"]).join(others("e"), ["s", "other"])
    fixes = steps.where(F.col("e_mutates") & _same_work("r", "e") & (F.col("e_revert") | named) & succeeds("e") & (F.col("e_no") < F.col("e_partner")))
    fixed = fixes.groupBy("s", "u").agg(F.min_by(F.struct(F.col("e_no").alias("no"), F.col("e_partner").alias("partner"), F.col("e_enter").alias("enter"), F.col("e_exit").alias("exit"), F.col("e_partner_enter").alias("partner_enter"), F.col("e_partner_exit").alias("partner_exit")), "e_no").alias("x"))
    fixed = fixed.select("s", "u", *[F.col(f"x.{c}").alias(f"x_{c}") for c in ("no", "partner", "enter", "exit", "partner_enter", "partner_exit")])
    checks = steps.where(F.col("e_check") & (F.col("e_name") == F.col("f_name")) & (F.col("e_selector") == F.col("f_selector")) & succeeds("e")).join(fixed, ["s", "u"])
    checks = checks.where((F.col("x_no") < F.col("e_no")) & (F.col("x_partner") < F.col("e_no")) & (F.col("e_no") < F.col("e_partner")) & _share("c_", "e_partner_") & _share("c_", "x_") & _share("c_", "x_partner_"))
    objective = checks.groupBy("s", "u").agg(F.min(F.struct("e_no", "e_partner", "r_no")).alias("m")).select("s", "u", F.col("m.r_no").alias("objective_onset"), F.col("m.e_partner").alias("objective_recovery"))

    # another command of the same program that succeeds
    retries = after.where("f_name = 'Bash' and e_kind = 'tool_use' and e_name = 'Bash'").where((F.col("e_command") != F.col("f_command")) & (command_intent(F.col("e_command")) == command_intent(F.col("f_command"))) & succeeds("e") & _share("c_", "e_partner_"))
    retried = retries.groupBy("s", "u").agg(F.min(F.struct("e_no", "e_partner", "f_no")).alias("m")).select("s", "u", F.col("m.f_no").alias("retry_onset"), F.col("m.e_partner").alias("retry_recovery"))

    # what admissions and corrections are about
    around = words.join(back, ["s", "u"]).join(others("o"), ["s", "other"])
    action = (F.col("o_kind") == "tool_use") & F.col("o_name").isin(CAUSAL)
    since = around.where(F.col("o_actor").isin("human", "system")).groupBy("s", "u").agg(F.min("n").alias("border"))
    is_named = action & _names_any(F.col("d_low"), F.col("o_values"), F.col("o_artifacts"))
    pointed = action & F.col("d_noun").isNotNull() & (F.col("n") < F.coalesce("border", F.lit(1 << 30))) & _points_at(F.col("d_noun"), "o")
    linked = around.join(since, ["s", "u"], "left").groupBy("s", "u").agg(
        F.count_if(is_named).alias("named"), F.max(F.when(is_named, F.col("other"))).alias("by_name"), F.count_if(pointed).alias("pointed"),
        F.max(F.when(pointed & (F.col("n") <= near + 1), F.col("other"))).alias("by_pointer"),
    )
    direct = linked.select("s", "u", F.when(F.col("named") == 1, F.col("by_name")).when(F.col("pointed") == 1, F.col("by_pointer")).alias("root"))
    direct = written(direct, "mistakes")
    passed_over = (F.col("o_uuid") == F.col("d_uuid")) & (F.col("o_actor") == "assistant") & F.col("o_kind").isin("thinking", "metadata")
    previous = around.where("d_actor = 'assistant'").where(~F.coalesce(passed_over, F.lit(False))).groupBy("s", "u").agg(F.min_by(F.struct("other", "o_corrects"), "n").alias("p")).where("p.o_corrects")
    over = previous.select("s", "u", F.col("p.other").alias("via")).join(direct.select("s", F.col("u").alias("via"), F.col("root").alias("bridged")), ["s", "via"]).where("bridged is not null")
    over = over.join(others("o").withColumnRenamed("other", "bridged"), ["s", "bridged"]).join(words, ["s", "u"])
    own_names = F.transform(F.col("o_artifacts"), lambda v: F.replace(F.lower(v), F.lit("\\"), F.lit("/")))
    accepted = F.concat(own_names, F.transform(own_names, _base))
    mentions = F.transform(F.regexp_extract_all("d_low", F.lit(ARTIFACT), F.lit(1)), lambda v: F.replace(F.lower(v), F.lit("\\"), F.lit("/")))
    conflict = (F.size(own_names) > 0) & (F.size(F.array_except(mentions, accepted)) > 0)
    supported = _names_any(F.col("d_low"), F.col("o_values"), F.col("o_artifacts")) | F.coalesce(F.col("d_noun").isNotNull() & _points_at(F.col("d_noun"), "o"), F.lit(False)) | F.col("d_low").rlike(ACKNOWLEDGED)
    bridges = over.where(~conflict & supported).select("s", "u", "bridged")
    roots = words.select("s", "u").join(direct, ["s", "u"], "left").join(bridges, ["s", "u"], "left").select("s", "u", F.coalesce("root", "bridged").alias("root"))

    # an admission in thinking, and a later success on the work it is about
    thoughts = words.where("d_kind = 'thinking'").join(roots.where("root is not null"), ["s", "u"]).join(others("r").withColumnRenamed("other", "root"), ["s", "root"])
    later = thoughts.join(ahead, ["s", "u"]).join(others("e"), ["s", "other"]).where((F.col("e_kind") == "tool_use") & F.col("e_name").isin(CAUSAL) & _same_work("r", "e") & succeeds("e") & _share("d_", "e_partner_"))
    mended = later.groupBy("s", "u").agg(F.min(F.struct("e_no", "e_partner")).alias("m")).select("s", "u", F.col("m.e_partner").alias("mended"))

    out = facts.select("s", "u", "kind", "suppressed", "changed", "admits", "corrects")
    for part in (expected, transient, objective, retried, roots, mended):
        out = out.join(part, ["s", "u"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    thinks, speaks = F.col("admits") & (F.col("kind") == "thinking"), F.col("admits") & (F.col("kind") == "text")
    rules = [
        (yes("suppressed"), "suppressed", "admission", None, None), (yes("changed"), "suppressed", "requirement_change", None, None), (yes("is_expected"), "suppressed", "expected_failure", None, None),
        (yes("is_transient"), "suppressed", "transient_failure", None, None), (F.col("objective_recovery").isNotNull(), "confirmed", "incorrect_change", "objective_onset", "objective_recovery"),
        (F.col("retry_recovery").isNotNull(), "unconfirmed", "invalid_command", "retry_onset", "retry_recovery"), (thinks & F.col("mended").isNotNull(), "probable", "wrong_assumption", "root", "mended"),
        (thinks, "unconfirmed", "wrong_assumption", "root", None), (yes("corrects"), "unconfirmed", "user_correction", "root", None),
        (speaks & F.col("root").isNotNull(), "confirmed", "wrong_assumption", "root", None), (speaks, "unconfirmed", "wrong_assumption", None, None),
    ]
    made = {"outcome": F.lit(None).cast("string"), "category": F.lit(None).cast("string"), "onset": F.lit(None).cast("long"), "recovery": F.lit(None).cast("long")}
    for when, outcome, category, onset, recovery in reversed(rules):
        values = {"outcome": F.lit(outcome), "category": F.lit(category), "onset": F.col(onset) if onset else F.lit(None), "recovery": F.col(recovery) if recovery else F.lit(None)}
        made = {k: F.when(when, values[k]).otherwise(made[k]) for k in made}
    return out.select(F.col("s").alias("session"), F.col("u").alias("no"), *[c.cast("string" if k in ("outcome", "category") else "long").alias(k) for k, c in made.items()]).where("outcome is not null")
