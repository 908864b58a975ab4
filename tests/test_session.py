"""Command line, session, streams of files and the comparison of word order."""

import json

from quire import session
from quire.operators import wordorder
from quire.streaming import files

TEXT = "Abstract\nWe study exam-\nples of things.\n\fIntroductory words\n1 Results\nAll is well."


def test_command_line(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text(TEXT)
    (tmp_path / "in/sub/b.txt").write_text("no anchor here")
    out = str(tmp_path / "out")
    assert session.main(["convert", str(tmp_path / "in"), "-o", out, "--heuristics", "/missing.json"], spark) == 0
    md = (tmp_path / "out/a.md").read_text()
    assert md.startswith("---\ntitle: 1 Results\n") and md.endswith("# Abstract\n\nWe study examples of things.\n\nIntroductory words\n\nAll is well.\n\n")
    assert (tmp_path / "out/sub/b.md").exists()
    stats = json.loads((tmp_path / "out/run-reports/a.stats.json").read_text())
    assert (stats["pages"], stats["headings"], stats["title"]) == (2, 2, "1 Results")
    assert session.main(["--odd"], spark) == 0 and session.main([], spark) == 1 and session.main([str(tmp_path / "none")], spark) == 1


def test_session(spark, tmp_path):
    s = session.Session(spark)
    assert s.run("set ocr_dpi 150") == "ocr_dpi = 150" and "ocr_dpi = 150" in s.run("show heuristics")
    assert s.run(f"save {tmp_path}/h.json") == "saved" and s.run("set unknown 1") == session.HELP
    (tmp_path / "a.txt").write_text(TEXT)
    assert s.run(f"convert {tmp_path} -o {tmp_path}/out") == "started" and s.run("quit") is None
    assert (tmp_path / "out/a.md").exists() and s.run("jobs") == "0 of 1 running"


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / f"in/{name}.txt").write_text(TEXT)
        files.convert_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert (tmp_path / f"out/{name}.md").exists()


def test_word_order():
    assert wordorder.compared("---\na: b\n---\nThe exam-\nple ‘x’", "the example 'x'") == (None, 100.0)
    assert wordorder.compared("a b c", "a b d e") == (2, 50.0) and wordorder.compared("a b", "a b c")[0] == 2
