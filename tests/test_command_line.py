"""The command line: every command, its flags and what it prints."""

import re

import pytest

from loomdex.__main__ import main

DOCS = "d1 a b c a\nd2 b b b b b c\nd3 a\n\nd5 c a b a a a\n"
QUERIES = "q1 a b\nq2 zzz\nq3 b\nq4 c zzz\nq5\n"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("cli")
    (at / "docs").write_text(DOCS)
    (at / "queries").write_text(QUERIES)
    main(["index", str(at / "docs"), str(at / "index")])
    main(["index", str(at / "docs"), str(at / "loose"), "--unpacked", "-p"])
    main(["index", str(at / "docs"), str(at / "none"), "--dry-run"])
    assert (at / "loose" / "positions").exists() and not (at / "none").exists()
    return at


def said(capsys, *argv):
    capsys.readouterr()
    main([str(a) for a in argv])
    return capsys.readouterr().out


def test_and_or(files, capsys):
    out = said(capsys, "and", files / "index", files / "queries", "-v")
    assert [x.split("\t")[1:] for x in out.splitlines()[1:4]] == [["q1", "2"], ["q3", "3"], ["q4", "3"]]
    profile = said(capsys, "and", files / "index", files / "queries", "-vv")
    assert "next_geq_count" in profile
    out = said(capsys, "or", files / "loose", files / "queries", "-v")
    assert [x.split("\t")[1:] for x in out.splitlines()[1:4]] == [["q1", "4"], ["q3", "3"], ["q4", "3"]]
    assert re.search(r"\|\s*3\|", said(capsys, "or", files / "index", files / "queries"))


def test_ranked(files, capsys):
    out = said(capsys, "ranked", files / "index", files / "queries", 2).splitlines()
    assert out[0].split("\t") == ["query_ord", "qid", "rank", "docid", "score"]
    assert [x.split("\t")[1:4] for x in out[1:]] == [["q1", "0", "5"], ["q1", "1", "1"], ["q3", "0", "2"], ["q3", "1", "1"], ["q4", "0", "1"], ["q4", "1", "2"]]
    out = said(capsys, "ranked", files / "index", files / "queries", 3, "-v")
    assert [x.split("\t")[1:] for x in out.splitlines()[1:4]] == [["q1", "3"], ["q3", "3"], ["q4", "3"]]
    main(["ranked", str(files / "index"), str(files / "queries"), "1", "--trec", str(files / "trec")])
    lines = sorted(x for p in (files / "trec").glob("part-*") for x in p.read_text().splitlines())
    assert len(lines) == 3 and lines[0].startswith("q1 Q0 5 0 ")


@pytest.mark.parametrize("what, extra, matches", [("and", [], [2, 3, 3]), ("or", [], [4, 3, 3]), ("ranked", [2], [2, 2, 2])])
def test_one_by_one(files, capsys, what, extra, matches):
    out = said(capsys, what, files / "index", files / "queries", *extra, "--one-by-one", "-v").splitlines()
    assert [re.fullmatch(r"(q\d) latency=\d+ matches=(\d+)", x).groups() for x in out[:3]] == list(zip(["q1", "q3", "q4"], map(str, matches), strict=True))
    assert out[3] == "Statistics over 3 queries with a match of 5"
    assert re.match(r"Latency mean: \S+ p50: \S+ p90: \S+ p95: \S+ p99: \S+$", out[4]) and out[5].startswith("Matches mean: ")
    assert len(said(capsys, what, files / "index", files / "queries", *extra, "--one-by-one").splitlines()) == 3


def test_export_and_report(files, capsys):
    main(["export", str(files / "docs"), str(files / "out"), "--canonical"])
    assert (files / "out.terms").read_text() == "a\nb\nc\n" and (files / "out.interleaved").stat().st_size == 9 * 8
    assert "bytes_per_posting" in said(capsys, "report", files / "docs", "--growth", "expon")


def test_command_line_prints_every_row(spark, tmp_path, capsys):
    (tmp_path / "docs").write_text("".join(f"d{i} a b{i % 3}\n" for i in range(30)))
    (tmp_path / "queries").write_text("".join(f"{q} a b{q % 3}\n" for q in range(120)))
    main(["index", str(tmp_path / "docs"), str(tmp_path / "index")])
    capsys.readouterr()
    main(["ranked", str(tmp_path / "index"), str(tmp_path / "queries"), "10"])
    lines = capsys.readouterr().out.splitlines()
    assert len([x for x in lines if x.count("\t") >= 3]) == 1 + 120 * 10
