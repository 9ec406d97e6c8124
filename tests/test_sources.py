"""FASTQ files and the parser of raw records."""

import gzip
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.sources import error_parse as ep
from readloom.sources.fastq import FastqSource, is_gzip, lines_of, read_fastq, read_pairs, split_file, split_name, write_fastq, write_pairs


def record(rng, i):
    n = rng.randint(1, 30)
    return [f"@r{i}", "".join(rng.choice("ACGT") for _ in range(n)), "+", "".join(rng.choice("@+IF#") for _ in range(n))]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_reading_is_exact(spark, tmp_path, end):
    rng = random.Random(1)
    recs = [record(rng, i) for i in range(300)]
    p = tmp_path / "a.fastq"
    p.write_bytes(end.join(x for r in recs for x in r).encode())
    for split in (37, 200, 1 << 20):
        got = sorted(tuple(r) for r in read_fastq(spark, [str(p)], split_bytes=split).collect())
        assert got == [(0, i, *r) for i, r in enumerate(recs)]


def test_gzip_by_magic_and_tails(spark, tmp_path):
    z, t = tmp_path / "plain_name.fastq", tmp_path / "tail.fastq"
    z.write_bytes(gzip.compress(b"@a\nAC\n+\nII\n@b\nG\n+\nI\r"))
    t.write_bytes(b"@a\nAC\n+\nII\n@cut\nAC\n+\n")
    assert is_gzip(str(z)) and not is_gzip(str(t))
    got = sorted(tuple(r) for r in read_fastq(spark, [str(z), str(t)]).collect())
    assert got == [(0, 0, "@a", "AC", "+", "II"), (0, 1, "@b", "G", "+", "I\r"), (1, 0, "@a", "AC", "+", "II")]
    spark.dataSource.register(FastqSource)
    same = spark.read.format("fastq").option("paths", f"{z},{t}").load()
    assert sorted(tuple(r) for r in same.collect()) == got


def test_empty_file_missing_file_and_long_line(spark, tmp_path):
    e, long = tmp_path / "e.fastq", tmp_path / "l.fastq"
    e.write_bytes(b"")
    long.write_bytes(b"@a\n" + b"A" * 50 + b"\n+\nI\n")
    assert read_fastq(spark, [str(e)]).collect() == []
    with pytest.raises(FileNotFoundError):
        read_fastq(spark, [str(tmp_path / "none")])
    with pytest.raises(Exception, match="more than 20 bytes"):
        read_fastq(spark, [str(long)], max_line=20).collect()


def test_round_trip(spark, tmp_path):
    rng = random.Random(2)
    rows = [(0, i, *record(rng, i)) for i in range(50)]
    df = spark.createDataFrame(rows, "file_idx int, read_idx long, header string, seq string, plus string, qual string").coalesce(1)
    write_fastq(lines_of(df), str(tmp_path / "out"), single=True)
    (part,) = (tmp_path / "out").glob("part-*")
    assert sorted(tuple(r) for r in read_fastq(spark, [str(part)]).collect()) == rows


def test_pieces_of_a_gzipped_file_by_uri(spark, tmp_path):
    rng = random.Random(3)
    recs = [[f"@r{i}", "ACGT"[i // 7 % 4] * 5 + "".join(rng.choice("ACGT") for _ in range(9)), "+", "I" * 14] for i in range(60)]
    z = tmp_path / "a.fastq.gz"
    z.write_bytes(gzip.compress("\n".join(x for r in recs for x in r).encode()))
    reads = read_fastq(spark, [f"file://{z}"])
    paths, skipped = split_file(reads, str(z), 0, 5, 2, f"file:{tmp_path}/pieces")
    assert skipped == 0 and [p.rsplit("/", 1)[1] for p in paths] == [f"a_{i:04d}.fastq.gz" for i in range(1, 6)]
    assert [list(r)[2:] for r in read_fastq(spark, paths).orderBy("file_idx", "read_idx").collect()] == recs
    with pytest.raises(FileNotFoundError):
        read_fastq(spark, [f"file://{tmp_path}/none"])


def test_pairs_of_files(spark, tmp_path):
    rng = random.Random(4)
    one, two = ([record(rng, i) for i in range(40)] for _ in range(2))
    for name, recs in (("a", one), ("b", two), ("short", two[:-1])):
        (tmp_path / name).write_text("\n".join(x for r in recs for x in r) + "\n")
    pairs = read_pairs(spark, [str(tmp_path / "a")], [str(tmp_path / "b")])
    got = sorted((tuple(r) for r in pairs.select("header", "seq", "qual", "header2", "seq2", "qual2").collect()), key=lambda r: int(r[0][2:]))
    assert got == [(x[0], x[1], x[3], y[0], y[1], y[3]) for x, y in zip(one, two)]
    write_pairs(pairs, str(tmp_path / "out"))
    halves = [["".join(p.read_text() for p in sorted((tmp_path / f"out_{k}").glob("part-*"))).split("\n")[i::4] for i in (0, 1)] for k in (1, 2)]
    mate = {x[0]: y for x, y in zip(one, two)}
    assert [mate[h][1] for h in halves[0][0] if h] == [s for s in halves[1][1] if s] and len(halves[0][1]) >= 40
    with pytest.raises(Exception, match="no mate"):
        read_pairs(spark, [str(tmp_path / "a")], [str(tmp_path / "short")]).count()
    with pytest.raises(ValueError):
        read_pairs(spark, [str(tmp_path / "a")], [])


def test_piece_names():
    assert split_name("d/a.fastq.gz", 3) == "a_0003.fastq.gz"
    assert split_name("a.fq.gz", 12) == "a_0012.fq.gz"
    assert split_name("a.b.fastq", 1) == "a.b_0001.fastq"
    assert split_name("reads", 1) == "reads_0001"


HEAD = "@bc=ACG;bcid=1;count=2;min_q=3;mean_q=4;minor_frac_mean=0.5;minor_frac_max=1.0"
CASES = [
    ("@r\nAC\n+\nII", None),
    ("@r\r\nAC\r\n+\r\nII\r\n", None),
    (HEAD + "\nac\n+x\n!~", None),
    (None, "lines"),
    ("", "lines"),
    ("@r\nAC\n+", "lines"),
    ("@r\nAC\n+\nII\n\n", "lines"),
    ("@r\nAC\n+\nII\n@s\nA\n+\nI", "lines"),
    ("r\nAC\n+\nII", "header"),
    ("@ r\nAC\n+\nII", "header"),
    ("@\nAC\n+\nII", "header"),
    ('@r"x\nAC\n+\nII', "header"),
    ('@r"x"\nAC\n+\nII', None),
    (HEAD.replace("=4", "=x") + "\nAC\n+\nII", "header"),
    (HEAD.replace("0.5", "1.5") + "\nAC\n+\nII", "header"),
    (HEAD.replace(";count", "count") + "\nAC\n+\nII", "header"),
    (HEAD.replace("bcid=1;", "") + "\nAC\n+\nII", "header"),
    (HEAD + ";\nAC\n+\nII", "header"),
    ("@r\n\n+\nI", "sequence"),
    ("@r\nAXC\n+\nIII", "sequence"),
    ("@r\nAC\n-\nII", "separator"),
    ("@r\nAC\n\nII", "separator"),
    ("@r\nAC\n+\nI I", "quality"),
    ("@r\nAC\n+\nI", "length"),
    ("@r\nAXC\n-\nI", "sequence"),
]


@pytest.mark.parametrize("raw,reason", CASES)
def test_reasons(raw, reason):
    cost, got, edits = ep.parse_one(raw)
    assert got == reason and (cost == 0) == (reason is None) and (cost == 0) == (not edits)


def test_parser_on_a_table(spark):
    rows = [(i, 0, r, "x") for i, (r, _) in enumerate(CASES)] + [(0, 0, CASES[0][0], "x")]
    df = spark.createDataFrame(rows, "raw_id long, file_idx int, raw string, header string")
    parsed = ep.parse_records(df)
    want = sorted((i, r) for i, (_, r) in enumerate(CASES) if r)
    assert sorted((r["raw_id"], r["reason"]) for r in ep.rejected(parsed).collect()) == want
    good = ep.loaded(parsed).collect()
    assert len(good) == len(rows) - len(want)
    full = next(r for r in good if r["bc"])
    assert (full["bc"], full["bcid"], full["count"], full["minor_frac_max"]) == ("ACG", 1, 2, 1.0)
    assert ep.loaded(ep.parse_records(df.limit(0))).collect() == []


def first_failed(raw):
    """The checks in their order, written down plainly."""
    if raw is None:
        return "lines"
    lines = [x.removesuffix("\r") for x in raw.removesuffix("\n").split("\n")]
    if len(lines) != 4:
        return "lines"
    h, s, p, q = lines
    if not re.match("@[!-~]", h) or h.count('"') % 2 or (h.startswith("@bc=") and not re.fullmatch(ep.CONSENSUS_HEADER, h)):
        return "header"
    if not s or set(s) - set("ACGTNacgtn"):
        return "sequence"
    if not p.startswith("+"):
        return "separator"
    if any(not "!" <= c <= "~" for c in q):
        return "quality"
    return "length" if len(s) != len(q) else None


pieces = st.lists(st.sampled_from(["@", "@r", HEAD, '"', "A", "acN", "+", "I", "\n", "\n", "\n", "\r\n", "X", " ", ";", "=", "é", "\x85"]), max_size=14)


@settings(max_examples=400, deadline=None)
@given(pieces.map("".join))
def test_reason_is_the_first_failed_check(raw):
    assert ep.parse_one(raw)[1] == first_failed(raw)


def test_zero_cost_equals_the_program(spark):
    rng = random.Random(7)
    bits = ["@", "@r", HEAD, '"', "A", "acN", "+", "I", "\n", "\n", "\n", "\r", "X", " ", "é", "\x85"]
    raws = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    raws += [f"{rng.choice(['@r', HEAD])}\n{s}\n+\n{'I' * len(s)}" for s in ("A", "ACGT", "aX") for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(raws)), "raw_id long, raw string")
    got = {r["raw_id"]: r["reason"] for r in ep.parse_records(df).collect()}
    assert got == {i: first_failed(r) for i, r in enumerate(raws)}


def test_very_long_records(spark):
    seq = "ACGT" * 50_000
    df = spark.createDataFrame([(1, f"@r\n{seq}\n+\n{seq}"), (2, "\n" * 5000), (3, f"@r\n{seq}\n+\n{seq}I")], "raw_id long, raw string")
    assert {r["raw_id"]: r["reason"] for r in ep.parse_records(df).collect()} == {1: None, 2: "lines", 3: "length"}


def edits_of(header):
    cost, reason, edits = ep.parse_one(f"{header}\nAC\n+\nII")
    return cost, edits


def test_header_edits_are_cheapest():
    assert edits_of(HEAD + ";") == (1, ["header: delete ';'"])
    assert edits_of(HEAD.replace("bcid=", "bcid==")) == (1, ["header: delete '='"])
    assert edits_of(HEAD.replace("bcid=1", "bcid")) == (3, ["header: insert =", "header: insert a value"])
    assert edits_of(HEAD.replace("=4", "=x")) == (2, ["header: replace 'x'"])
    assert edits_of('@r"')[0] == edits_of('@"')[0] == edits_of("r")[0] == 1
    assert edits_of("@")[0] == 2 and edits_of("")[0] == 3


def plain_tokens(text):
    return ["\n" if t == "\r\n" else t for t in re.findall(r'\r?\n|[@=;"+]|[^@=;"+\r\n]+|\r', text)]


def reads_plainly(tokens, four):
    """Whether a row of tokens reads as a record with a plain header, written down without an automaton."""
    lines = "".join(tokens).split("\n")
    if len(lines) != 4:
        return False
    h, s, p, q = lines
    good = re.match("@[!-~]", h) and h.count('"') % 2 == 0 and re.fullmatch(ep.SEQUENCE, s) and p.startswith("+") and re.fullmatch(ep.QUALITY, q)
    return bool(good) and (not four or len(s) == len(q))


def brute_cost(raw, most):
    """Cheapest edits by trying all of them."""
    start = tuple(plain_tokens(raw.removesuffix("\n").removesuffix("\r")))
    four = start.count("\n") == 3
    best, todo = {start: 0}, {0: [start]}
    for cost in range(most + 1):
        for x in todo.get(cost, ()):
            if best[x] < cost:
                continue
            if reads_plainly(x, four):
                return cost
            after = []
            for i, t in enumerate(x):
                value = t not in '@=;"+' and t != "\n"
                if not (four and t == "\n"):
                    after.append((x[:i] + x[i + 1 :], 2 if value else 1))
                if value:
                    after += [(x[:i] + (v,) + x[i + 1 :], 2) for v in ("A", "AC", "ACG")]
            for i in range(len(x) + 1):
                # @ and + are delimiters where a line begins, quotes in the header; elsewhere they belong to a value
                role, begins = x[:i].count("\n"), i == 0 or x[i - 1] == "\n"
                delimiters = ["@"] * (i == 0 and x[:1] != ("@",)) + ['"'] * (role == 0) + ["+"] * (role == 2 and begins) + ["\n"] * (not four)
                after += [(x[:i] + (d,) + x[i:], 1) for d in delimiters]
                after += [(x[:i] + (v,) + x[i:], 2) for v in ("A", "AC", "ACG")]
            for y, c in after:
                if cost + c <= most and cost + c < best.get(y, most + 1):
                    best[y] = cost + c
                    todo.setdefault(cost + c, []).append(y)
    return None


def test_costs_are_least():
    rng = random.Random(5)
    checked = 0
    for _ in range(250):
        lines = [rng.choice(["@r", "r", "@", '@"', '@r"x"', " r"]), rng.choice(["AC", "A;C", "X", ""]), rng.choice(["+", "x", ""]), rng.choice(["II", "I", "I I", ""])]
        if rng.random() < 0.4:
            lines.pop(rng.randrange(4))
        if rng.random() < 0.15:
            lines.insert(rng.randrange(len(lines) + 1), "A")
        raw = "\n".join(lines)
        cost = ep.parse_one(raw)[0]
        if cost > 3 or raw.endswith("\n"):
            continue
        checked += 1
        assert brute_cost(raw, 3) == cost, (raw, ep.parse_one(raw))
    assert checked > 50


def test_stream_front(spark, tmp_path):
    from readloom.streaming import parse_stream

    src = tmp_path / "in"
    spark.createDataFrame([(1, 0, "@r\nAC\n+\nII"), (2, 0, "x")], "raw_id long, file_idx int, raw string").write.parquet(str(src))
    stream = spark.readStream.schema("raw_id long, file_idx int, raw string").parquet(str(src))
    q = parse_stream(stream).writeStream.format("memory").queryName("parsed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r["raw_id"]: r["reason"] for r in spark.table("parsed").collect()} == {1: None, 2: "lines"}
