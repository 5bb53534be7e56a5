"""The command line: a report on files of predictions, and a query."""

import pytest

from neumes.__main__ import main
from neumes.report import report

HEAD = "**kern\t**mxhm\n*clefG2\t*\n=1\t=1\n"
GT = HEAD + "4c\tC:maj7\n4d\t.\n!!linebreak:original\n=2\t=2\n8g\tG:7\n*-\t*-"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(4):
        files = {"gt": GT, "base": GT.replace("C:maj7", "C:min7"), "r100": GT.replace("4d\t.\n", "") if k else GT}
        for role, text in files.items():
            if (k, role) != (3, "r100"):
                (tmp_path / "in" / f"p{k}__{role}.kern").write_text(text)
    return tmp_path


def test_report_of_two_models(spark, folder):
    text = report(spark, str(folder / "in"), ["base", "r100"], str(folder / "out"))
    assert (folder / "out" / "report.md").read_text() == text
    titles = [x for x in text.split("\n") if x.startswith("## ")]
    assert titles == ["## Error rates", "## Means of pages, clipped at 100", "## Significance against base", "## Errors of both", "## Errors of base alone", "## Errors of r100 alone", "## Most frequent confusions"]
    rates = {r.split("|")[1].strip(): [c.strip() for c in r.split("|")[2:-1]] for r in text.split("\n") if r.startswith(("| base ", "| r100 ")) and r.count("|") == 10}
    assert rates["base"][:2] == ["4", "0"] and rates["r100"][:2] == ["4", "1"]
    listing = (folder / "out" / "p1_diff.txt").read_text()
    assert listing.startswith("=== p1 ===\n") and "<DEL>" in listing and "--- linebreak ---" in listing and "B!" in listing
    assert sorted(p.name for p in (folder / "out").glob("*_diff.txt")) == ["p0_diff.txt", "p1_diff.txt", "p2_diff.txt"]


def test_command_line(spark, folder, capsys):
    main(["report", str(folder / "in"), str(folder / "one"), "base"])
    assert "## Error rates" in capsys.readouterr().out and (folder / "one" / "report.md").exists()
    main(["run", "scan_project_filter", "/root/testdata/sf0.001", str(folder / "q")])
    assert spark.read.parquet(str(folder / "q")).count() > 0
    with pytest.raises(SystemExit):
        main(["run", "no such query", "x"])
