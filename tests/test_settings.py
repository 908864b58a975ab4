import pytest

from quire.sources import jobs, settings


def test_coerced():
    assert settings.coerced("12abc", 1.0) == 12.0
    assert settings.coerced("x", 3) == 3
    assert settings.coerced("false", True) is False


def test_round_trip(tmp_path):
    h = settings.Heuristics(ocr_dpi=150, page_overrides=["page=1"])
    settings.save(h, str(tmp_path / "h.json"))
    assert settings.load(str(tmp_path / "h.json")) == h
    assert settings.config_path("h.json", str(tmp_path / "h.json"))


def test_overrides():
    pages, wrong = settings.overrides(["page=4; region=float; units=pt; origin=topleft; box=100,90,346,785", "page=4; column_cut=300", "page=4; keep_captions=true", "box=1,2", "page=1; odd=1"])
    assert pages[4]["column_cut"] == 300 and pages[4]["keep_captions"] and len(pages[4]["regions"]) == 1
    assert len(wrong) == 2
    with pytest.raises(ValueError):
        settings.override("page=1; region=float")


def test_jobs(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.PDF").write_bytes(b"1")
    (tmp_path / "in/sub/b.pdf").write_bytes(b"22")
    (tmp_path / "in/c.txt").write_bytes(b"3")
    rows = jobs.listed(spark, [str(tmp_path / "in"), str(tmp_path / "missing")], "/out").collect()
    assert sorted((r.size_bytes, r.output_path) for r in rows) == [(1, "/out/a.md"), (2, "/out/sub/b.md")]
    assert jobs.listed(spark, [str(tmp_path / "in")], "/out", recursive=False).count() == 1
    assert jobs.listed(spark, [], "/out").count() == 0


def test_entry_without_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "quire", tmp_path / "quire", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 30 and not any(q.startswith('op') and q[2].isdigit() for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ":".join(p for p in sys.path if p and str(repo) != p)})
