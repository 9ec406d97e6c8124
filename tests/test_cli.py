"""The command line end to end."""

import random

import pytest

from readloom.cli import elapsed, main, parser, settings_of


def simulated(path, rng, molecules=8):
    lines, truth = [], {}
    for m in range(molecules):
        bc = "".join(rng.choice("ACGT") for _ in range(15))
        body = bc + "".join(rng.choice("ACGT") for _ in range(60))
        truth[bc] = body
        for _ in range(rng.randint(3, 8)):
            s = "".join(rng.choice("ACGT") if rng.random() < 0.01 else c for c in body)
            lines += [f"@r{len(lines)} barcode={bc}", s, "+", "I" * len(s)]
    path.write_text("\n".join(lines) + "\n")
    return truth


def test_run_finds_the_molecules(spark, tmp_path, capsys):
    truth = simulated(tmp_path / "a.fastq", random.Random(1))
    assert main(["run", "--in", str(tmp_path / "a.fastq"), "--out", str(tmp_path / "out"), "--fail", str(tmp_path / "fail")], spark) == 0
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    seqs = set(text.split("\n")[1::4])
    assert len(seqs & set(truth.values())) >= len(truth) - 1
    assert "suspicious" in capsys.readouterr().out


def test_evaluate_and_compare_and_split(spark, tmp_path, capsys):
    a, b = tmp_path / "a.fastq", tmp_path / "b.fastq"
    simulated(a, random.Random(2))
    records = a.read_text().strip().split("\n")
    four = [records[i : i + 4] for i in range(0, len(records), 4)]
    b.write_text("\n".join(x for r in reversed(four) for x in r))
    assert main(["compare", str(a), str(b)], spark) == 0
    assert "True" in capsys.readouterr().out
    b.write_text("\n".join(four[0]))
    assert main(["compare", str(a), str(b)], spark) == 1
    assert main(["evaluate", "--in", str(a)], spark) == 0
    a.write_text(a.read_text() + "@short\nAC\n+\nII\n")
    assert main(["split", "--in1", str(a), "--size", "3", "--out", str(tmp_path / "p"), "--bc-len", "4"], spark) == 0
    said = capsys.readouterr()
    pieces = sorted((tmp_path / "p").glob("*"))
    assert [p.name for p in pieces] == [f"a_{i:04d}.fastq" for i in range(1, len(pieces) + 1)] and len(pieces) > 1
    assert [x for p in pieces for x in p.read_text().split("\n") if x] == records
    assert str(pieces[0]) in said.out and "skipped 1 reads" in said.err


def test_flags():
    a = parser().parse_args(["run", "--in", "x", "--context", "^ACNNN", "--gap", "-2", "--no-alignment"])
    how = settings_of(a)
    assert how.extraction.context.length == 3 and how.gap == -2 and not how.align and how.max_mismatches == 2 and how.extraction.max_indels == 1
    with pytest.raises(ValueError):
        settings_of(parser().parse_args(["run", "--in", "x", "--max-n", "6"]))
    with pytest.raises(SystemExit):
        parser().parse_args(["run"])
    assert [elapsed(x) for x in (3, 63, 3723)] == ["3s", "1m 3s", "1h 2m 3s"]
