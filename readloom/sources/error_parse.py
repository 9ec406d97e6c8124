"""Minimum-cost error parse of raw sequencing records.

A record is a row of tokens: line ends, the delimiters ``@ = ; +``, quotes, and the values between them. A
weighted automaton reads the four lines of a record of either header form. Every token it cannot read has to
be edited: inserting or deleting a delimiter, quote or line end costs 1; inserting, deleting or
replacing a value costs 2. Dynamic programming over (token, state) finds the cheapest edits that make
the record readable. A record that costs nothing loads; of any other, the earliest check its edits touch is
the reason.

A record of four lines keeps them, so its line ends are not edited, and a sequence and a quality that are both kept but
differ in length cost one replaced value more. A record of another number of lines fails for its lines;
its cost is that of four readable lines, whose lengths are not compared.

The zero-cost records are all but a regular language, which the JVM tests with one compiled pattern; only the
others enter the program.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASONS = ("lines", "header", "sequence", "separator", "quality", "length")

# The grammar of the two header forms and of the other lines.
_INT = "[0-9]+"
_FRACTION = r"(?:0(?:\.[0-9]+)?|1(?:\.0+)?)"
_BASES = "[ACGTN]+"
HEADER_FIELDS = (
    ("bc", _BASES),
    ("bcid", _INT),
    ("count", _INT),
    ("min_q", _INT),
    ("mean_q", _INT),
    ("minor_frac_mean", _FRACTION),
    ("minor_frac_max", _FRACTION),
)
CONSENSUS_HEADER = "@" + ";".join(f"{k}={v}" for k, v in HEADER_FIELDS)
VISIBLE = "[!-~]"
SEQUENCE = "[ACGTNacgtn]+"
QUALITY = "[!-~]*"

#: What the pattern leaves to other tests: that a header's quotes are paired and the lengths are equal.
_FOUR_LINES = rf"\A(?:{CONSENSUS_HEADER}|(?!@bc=)@{VISIBLE}[^\n]*)\r?\n{SEQUENCE}\r?\n\+[^\n]*\n{VISIBLE}+\r?\n?\z"


def line(raw: Column, i: int) -> Column:
    """Line i of a record without its line end, LF or CR and LF."""
    x = F.get(F.split(raw, "\n", -1), F.lit(i))
    return F.when(x.endswith("\r"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x)


def zero_cost(raw: Column) -> Column:
    """Whether a record reads as it stands; never null."""
    head, lines = F.substring_index(raw, "\n", 1), F.split(raw, "\n", -1)
    paired = (F.length(head) - F.length(F.replace(head, F.lit('"'), F.lit("")))) % 2 == 0
    size = lambda i: F.length(F.rtrim(F.get(lines, F.lit(i)), F.lit("\r")))
    return F.coalesce(raw.rlike(_FOUR_LINES) & paired & (size(1) == size(3)), F.lit(False))


_TOKEN = re.compile(r'\r?\n|[@=;"+]|[^@=;"+\r\n]+|\r')
_SEQ, _VISIBLE_ONLY = re.compile(SEQUENCE), re.compile(f"{VISIBLE}+")
_FAR = 1 << 40


def _is_value(token: str) -> bool:
    return token not in '@=;"+' and token != "\n"


class Machine:
    """The automaton of a record with one of the header forms.

    ``reads[s](token)`` is the state after the token, or None; ``inserts[s]`` lists (state after, token, cost) of what may be put
    in; ``replaced[s]`` is the state after a value that is replaced, or None; ``role[s]`` is the line a state is in.
    """

    def __init__(self, consensus: bool):
        self.reads, self.inserts, self.replaced, self.role = [], [], [], []
        if consensus:
            parts = [("@", None)]
            for k, pattern in HEADER_FIELDS:
                parts += [(";", None)] * (len(parts) > 1) + [(k, k), ("=", None), ("a value", pattern)]
            for n, (shown, pattern) in enumerate(parts):
                self._header_part(n, shown, pattern)
            end = len(parts)
        else:
            # before @, after it, an even and an odd number of quotes, after an @ put in (not before another)
            named = lambda t: 3 if t == '"' else 2 if t != "\n" and "!" <= t[0] <= "~" else None
            self._state("header", lambda t: 1 if t == "@" else None, [(4, "@", 1)])
            self._state("header", named, [(2, "a name", 2), (3, '"', 1)], 2)
            self._state("header", lambda t: 3 if t == '"' else 2, [(3, '"', 1)])
            self._state("header", lambda t: 2 if t == '"' else None if t == "\n" else 3, [(2, '"', 1)])
            self._state("header", lambda t: None if t == "@" else named(t), [(2, "a name", 2), (3, '"', 1)], 2)
            end = 2
        start = len(self.role) + consensus
        if consensus:
            self._state("header", lambda t: start if t == "\n" else None, [])
        else:
            self.reads[end] = lambda t: 3 if t == '"' else start if t == "\n" else 2
        self.inserts[end].append((start, "\n", 1))
        seq, plus = start, start + 2
        self._state("sequence", lambda t: seq + 1 if _SEQ.fullmatch(t) else None, [(seq + 1, "a sequence", 2)], seq + 1)
        self._state("sequence", lambda t: plus if t == "\n" else seq + 1 if _SEQ.fullmatch(t) else None, [(plus, "\n", 1)], seq + 1)
        self._state("separator", lambda t: plus + 1 if t == "+" else None, [(plus + 1, "+", 1)])
        self._state("separator", lambda t: plus + 2 if t == "\n" else plus + 1, [(plus + 2, "\n", 1)])
        self._state("quality", lambda t: plus + 2 if _VISIBLE_ONLY.fullmatch(t) else None, [], plus + 2)
        self.end = plus + 2

    def _state(self, role, reads, inserts, replaced=None):
        self.role.append(role)
        self.reads.append(reads)
        self.inserts.append(inserts)
        self.replaced.append(replaced)

    def _header_part(self, n: int, shown: str, pattern: str | None) -> None:
        if pattern is None:
            self._state("header", lambda t: n + 1 if t == shown else None, [(n + 1, shown, 1)])
        else:
            fits = re.compile(pattern).fullmatch
            self._state("header", lambda t: n + 1 if fits(t) else None, [(n + 1, shown, 2)], n + 1)


MACHINES = (Machine(False), Machine(True))


def tokens_of(raw: str) -> list[str]:
    """One LF at the very end is dropped, then one CR at the end of each line."""
    raw = raw.removesuffix("\n").removesuffix("\r")
    return ["\n" if t == "\r\n" else t for t in _TOKEN.findall(raw)]


def cheapest(tokens: list[str], m: Machine, keep_lines: bool) -> tuple[int, list[tuple[str, int, int, str]]]:
    """(cost, steps) of the cheapest path; a step is (what was done, token number, state before, text)."""
    costs: dict[int, int] = {0: 0}
    trail: list[dict[int, tuple[str, int, str]]] = []

    def spread(costs: dict[int, int], back: dict[int, tuple[str, int, str]]) -> None:
        todo = sorted(costs)
        while todo:
            s = todo.pop(0)
            for to, text, c in m.inserts[s]:
                if not (keep_lines and text == "\n") and costs[s] + c < costs.get(to, _FAR):
                    costs[to], back[to] = costs[s] + c, ("insert", s, text)
                    todo.append(to)

    first: dict[int, tuple[str, int, str]] = {}
    spread(costs, first)
    trail.append(first)
    for t in tokens:
        nxt: dict[int, int] = {}
        back: dict[int, tuple[str, int, str]] = {}

        def go(s, to, c, name):
            if c < nxt.get(to, _FAR):
                nxt[to], back[to] = c, (name, s, t)

        value = _is_value(t)
        for s, c in costs.items():
            to = m.reads[s](t)
            if to is not None:
                go(s, to, c, "keep")
            if value and m.replaced[s] is not None:
                go(s, m.replaced[s], c + 2, "replace")
            if not (keep_lines and t == "\n"):
                go(s, s, c + (2 if value else 1), "delete")
        spread(nxt, back)
        trail.append(back)
        costs = nxt
    steps, s, i = [], m.end, len(tokens)
    while i or s:
        name, before, text = trail[i][s]
        steps.append((name, i - (name != "insert"), before, text))
        i, s = i - (name != "insert"), before
    return costs[m.end], steps[::-1]


def parse_one(raw: str | None) -> tuple[int, str | None, list[str]]:
    """(cost, reason, edits) of one record; cost 0 and no reason for a record that loads."""
    tokens = tokens_of(raw or "")
    four = raw is not None and tokens.count("\n") == 3
    m = MACHINES[(raw or "").startswith("@bc=")]
    cost, steps = cheapest(tokens, m, four)
    found, size, free = [], {"sequence": 0, "quality": 0}, False
    for name, _, s, text in steps:
        role = m.role[s]
        if name == "keep":
            if role in size and text != "\n":
                size[role] += len(text)
            continue
        free |= role in size and name != "delete"
        if text == "\n":
            found.append(("lines", f"{name} a line end"))
        else:
            found.append((role, f"{name} {text if name == 'insert' else repr(text)}"))
    if four and not free and size["sequence"] != size["quality"]:
        cost += 2
        found.append(("length", f"replace the quality, {size['quality'] - size['sequence']:+d} characters off"))
    if not found:
        return 0, None, []
    return cost, min((r for r, _ in found), key=REASONS.index), [f"{r}: {e}" for r, e in found]


def _program(at: int, keep: list[int], schema: pa.Schema):
    def run(batches):
        for b in batches:
            done = [parse_one(x) for x in b.column(at).to_pylist()]
            made = [pa.array([r[i] for r in done], schema.field(name).type) for i, name in enumerate(("cost", "reason", "edits"))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *made], names=schema.names)

    return run


_MADE = pa.schema([("cost", pa.int32()), ("reason", pa.string()), ("edits", pa.list_(pa.string()))])


def parse_records(raw: DataFrame, text: str = "raw") -> DataFrame:
    """Every record with its parse: header, seq, plus, qual where it loads, cost, reason and edits.

    A null or empty text fails at ``lines``. Repeated rows are parsed each on their own. The other
    columns of the input are kept; a column of the same name as a result column is replaced.
    An empty input gives an empty result. The length of a text is not bounded.
    """
    parts = ("header", "seq", "plus", "qual")
    kept = [c for c in raw.columns if c not in (*parts, *_MADE.names)]
    good = raw.where(zero_cost(F.col(text))).select(
        *kept,
        *(line(F.col(text), i).alias(c) for i, c in enumerate(parts)),
        F.lit(0).alias("cost"),
        F.lit(None).cast("string").alias("reason"),
        F.array().cast("array<string>").alias("edits"),
    )
    bad = raw.where(~zero_cost(F.col(text)))
    if text not in kept:
        bad = bad.select(*kept, F.col(text).alias("_text"))
        at = len(kept)
    else:
        bad, at = bad.select(*kept), kept.index(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in bad.select(*kept).schema), "cost int, reason string, edits array<string>"])
    run = _program(at, list(range(len(kept))), pa.schema([*(pa.field(c, pa.null()) for c in kept), *_MADE]))
    none = F.lit(None).cast("string")
    return good.unionByName(bad.mapInArrow(run, schema).select(*kept, *(none.alias(c) for c in parts), *_MADE.names))


def loaded(parsed: DataFrame) -> DataFrame:
    """The records that load, typed; the consensus columns are null for plain reads.

    A count or id beyond the range of a bigint stays valid text and gives null.
    """
    spec = {"bcid": "bigint", "count": "bigint", "min_q": "bigint", "mean_q": "bigint"}
    values = F.split("header", "[=;]")
    is_consensus = F.col("header").startswith("@bc=")
    good = parsed.where(F.col("cost") == 0).drop("cost", "reason", "edits")
    return good.select(
        *[c for c in good.columns if c not in {k for k, _ in HEADER_FIELDS} and c != "raw"],
        *(
            F.when(is_consensus, F.get(values, F.lit(2 * i + 1)).try_cast(spec.get(k, "string" if k == "bc" else "double"))).alias(k)
            for i, (k, _) in enumerate(HEADER_FIELDS)
        ),
    )


def rejected(parsed: DataFrame, key: str = "raw_id") -> DataFrame:
    """The records that do not load: key, reason, cost and edits."""
    return parsed.where(F.col("reason").isNotNull()).select(key, "reason", "cost", "edits")
