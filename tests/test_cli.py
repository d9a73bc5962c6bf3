import json
import sys

import pytest

from postlens import __main__ as cli
from postlens.sample_lexicon import sample_lines


class Kept:
    """The session of the tests, handed to the command line instead of a new one."""

    def __init__(self, spark):
        self.spark = spark

    def appName(self, name):
        return self

    def getOrCreate(self):
        return self.spark


@pytest.fixture
def run(spark, monkeypatch):
    class Session:
        builder = Kept(spark)

    monkeypatch.setattr(cli, "SparkSession", Session)

    def call(*arguments):
        monkeypatch.setattr(sys, "argv", ["postlens", *map(str, arguments)])
        cli.main()

    return call


def test_the_jobs_in_their_order(run, tmp_path, capfd):
    lexicon = tmp_path / "lexicon.txt"
    lexicon.write_text("\n".join(sample_lines()))
    lines = tmp_path / "lines"
    lines.mkdir()
    texts = ["so good today", "so bad today", "nothing here"] * 10
    (lines / "stream.json").write_text(
        "".join(json.dumps({"data": {"id": str(i), "text": t}}) + "\n" for i, t in enumerate(texts))
    )
    run("land", lines, tmp_path / "landed")
    run("tokenize", tmp_path / "landed", tmp_path / "tokens", tmp_path / "ck", "--available-now")
    run("score", tmp_path / "tokens", lexicon, tmp_path / "labels", tmp_path / "ck2", "--available-now")
    assert list((tmp_path / "labels").glob("*.parquet"))
    run("labels-report", tmp_path / "labels")
    scored = capfd.readouterr().out
    run("lake-report", tmp_path / "tokens", lexicon)
    printed = capfd.readouterr().out
    assert printed == scored and "Percentage(%)" in printed
    shares = [line.split("|")[1:4] for line in printed.splitlines() if line.startswith("|")][1:]
    # 29 of 30 lines are in published files
    assert [[cell.strip() for cell in row] for row in shares] == [
        ["negative", "10", "34.48"], ["positive", "10", "34.48"], ["mixed", "9", "31.03"]
    ]


def test_account_report(run, tmp_path, capfd):
    lexicon = tmp_path / "lexicon.txt"
    lexicon.write_text("\n".join(sample_lines()))
    page = {"data": [{"id": "1", "text": "so good today"}], "meta": {}}
    (tmp_path / "page.json").write_text(json.dumps(page, indent=1))
    run("account-report", tmp_path / "page.json", lexicon, "--multi-line")
    assert "positive" in capfd.readouterr().out
