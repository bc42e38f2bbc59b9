import hashlib
import json
import random
import zipfile

from pyspark.sql import functions as F

from engramite.sources import files, transcripts


def line(record, uuid, parent, second, content, **more):
    return json.dumps({"type": record, "uuid": uuid, "parentUuid": parent, "timestamp": f"2026-01-01T00:00:{second:02d}Z", "isSidechain": False, "message": {"content": content}} | more)


def test_transcripts(spark, tmp_path):
    use = lambda i, name, given: [{"type": "tool_use", "id": i, "name": name, "input": given}]
    result = lambda i, bad: [{"type": "tool_result", "tool_use_id": i, "is_error": bad, "content": "out"}]
    edit, check = {"file_path": "a.py"}, {"command": "uv run pytest -q"}
    rows = [line("user", "u0", None, 0, "please"), line("assistant", "u1", "u0", 1, [{"type": "thinking", "thinking": "I was WRONG here"}])]
    for k, (i, name, given, bad) in enumerate([("t1", "Edit", edit, False), ("t2", "Bash", check, True), ("t3", "Edit", edit, False), ("t4", "Bash", check, False)]):
        rows += [line("assistant", f"a{k}", "u1", 2 * k + 2, use(i, name, given)), line("user", f"r{k}", f"a{k}", 2 * k + 3, result(i, bad))]
    rows += ["not json", "[1]", line("assistant", "x", "u1", 30, use("t9", "Read", {})), line("assistant", "y", "u1", 31, use("t9", "Read", {})), line("user", "z", "y", 32, result("t9", False))]
    (tmp_path / "s.jsonl").write_text("\n".join(rows) + "\n")
    records = transcripts.records(transcripts.read_lines(spark, str(tmp_path)))
    assert tuple(transcripts.account(records).select("records", "malformed", "over_limit").first()) == (15, 2, False)
    found = transcripts.blocks(records)
    assert [r["text"] for r in found.where("type = 'text'").collect()] == ["please"]
    assert transcripts.thinking(found, "wrong").count() == 1 and transcripts.thinking(found, "right").count() == 0
    uses = {(r["id"], r["line"]): (r["name"], r["result"], r["failed"]) for r in transcripts.tool_uses(found).collect()}
    assert len(uses) == 6, uses
    assert [v for (i, _), v in sorted(uses.items()) if i == "t2"] == [("Bash", "out", True)]
    assert all(v == ("Read", None, None) for (i, _), v in uses.items() if i == "t9")
    chain = transcripts.objective_chains(transcripts.tool_uses(found)).collect()
    assert len(chain) == 1 and chain[0]["changed"]["line"] < chain[0]["failed_check"]["line"] < chain[0]["fixed"]["line"] < chain[0]["passed_check"]["line"]


def test_lines_are_numbered_over_byte_ranges(spark, tmp_path, monkeypatch):
    draw, want = random.Random(3), {}
    for k in range(4):
        lines = [draw.choice(["", " ", "x" * draw.randint(1, 400), "naïve 漢字 " * draw.randint(1, 9)]) for _ in range(200 * k)]
        (tmp_path / f"f{k}.jsonl").write_bytes(("\r\n" if k == 2 else "\n").join(lines).encode() + b"\n" * (k % 2))
        want |= {(f"f{k}.jsonl", n): x for n, x in enumerate(lines) if x.strip(" ")}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("1000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "100")
            got = {(r.file.rsplit("/", 1)[1], r.line): r.raw for r in transcripts.read_lines(spark, str(tmp_path)).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_limits_and_fingerprints(spark, tmp_path, monkeypatch):
    block = [{"type": "text", "text": "a"}] * 3
    (tmp_path / "few.jsonl").write_text("\n".join([line("user", "u", None, 0, "hi"), line("user", "v", "u", 0, block), "{", json.dumps({"x": "y" * 300})]))
    (tmp_path / "many.jsonl").write_text("\n".join(line("user", f"u{k}", None, 0, "hi") for k in range(6)))
    (tmp_path / "blocks.jsonl").write_text(line("user", "u", None, 0, block * 3))
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "large.jsonl").write_text("\n" * 3000)
    for name, value in (("FILE_BYTES", 2000), ("LINE_BYTES", 300), ("RECORDS", 5), ("EVENTS", 8)):
        monkeypatch.setattr(transcripts, name, value)
    rows, prints = transcripts.records(transcripts.read_lines(spark, str(tmp_path))), transcripts.fingerprints(spark, str(tmp_path))
    told = {r.file.rsplit("/", 1)[1].split(".")[0]: r for r in transcripts.account(rows, prints).collect()}
    assert {k: (r.records, r.malformed, r.events, r.over_limit) for k, r in told.items()} == {"few": (4, 2, 4, False), "many": (6, 0, 6, True), "blocks": (1, 1, 0, False), "large": (0, 0, 0, True)}
    assert told["few"].sha256 == hashlib.sha256((tmp_path / "few.jsonl").read_bytes()).hexdigest() and told["large"].sha256 is None and told["large"].bytes == 3000
    kept = transcripts.within_limits(rows, transcripts.account(rows))
    assert {r.file.rsplit("/", 1)[1] for r in kept.select("file").distinct().collect()} == {"few.jsonl", "blocks.jsonl"}
    monkeypatch.setattr(transcripts, "LINE_BYTES", 3000)
    over = {r.file.rsplit("/", 1)[1]: r for r in transcripts.account(transcripts.records(transcripts.read_lines(spark, str(tmp_path)))).collect()}
    assert over["blocks.jsonl"].events == 9 and over["blocks.jsonl"].over_limit and over["few.jsonl"].malformed == 1


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_text("plain")
    (tmp_path / "b.html").write_text("<p>one</p><script>x()</script><style>p{}</style><b>two &amp; three</b>")
    (tmp_path / "sub/c.csv").write_text("a,b\n1,\"2 3\"\n")
    (tmp_path / "d.xml").write_text("<r><x>in</x> tail</r>")
    (tmp_path / "e.xml").write_text("<!DOCTYPE r><r/>")
    (tmp_path / "g.pdf").write_bytes(b"%PDF")
    (tmp_path / "h.bin").write_bytes(b"\0")
    with zipfile.ZipFile(tmp_path / "f.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>par</w:t><w:t>a</w:t></w:p><w:p><w:t>b</w:t></w:p></w:document>')
    scanned = files.scan(spark, str(tmp_path), ["txt", ".html", "csv", "xml", "docx", "pdf"])
    got = {r["path"].rsplit("/", 1)[-1]: (r["status"], r["text"]) for r in files.extract_texts(scanned).collect()}
    assert got == {
        "a.TXT": ("extracted", "plain"), "b.html": ("extracted", "one\ntwo & three"), "c.csv": ("extracted", "a b\n1 2 3"), "d.xml": ("extracted", "in\ntail"),
        "e.xml": ("error", None), "f.docx": ("extracted", "para\nb"), "g.pdf": ("skipped_unsupported", None),
    }
    seen = scanned.where("path like '%a.TXT'")
    assert files.changed(scanned, seen).count() == 6


def test_notes_and_collections(spark):
    text = "---\ntitle: A note: one\ntag: x\n---\n# Top\n## What Was Done\nthis\nthat\n### Next steps\nmore"
    row = files.notes(spark.createDataFrame([(text,), ("no front",)], "text string")).collect()
    assert row[0]["front"] == {"title": "A note: one", "tag": "x"} and row[0]["sections"] == {"what_was_done": "this\nthat", "next_steps": "more"}
    assert row[1]["front"] == {} and row[1]["sections"] == {}
    made = files.collections(spark, [{"name": "n", "path": "/p", "scope": "global", "extensions": [".MD", "txt"]}])
    assert made.first()["extensions"] == ["md", "txt"]
    paths = spark.createDataFrame([("/x/handoffs/a.md",), ("/x/handoffs/a.yaml",), ("/plans/p.md",), ("/q.md",)], "p string")
    assert [r[0] for r in paths.select(files.kind_of(F.col("p"))).collect()] == ["handoff", "handoff_yaml", "plan", None]
