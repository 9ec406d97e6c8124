"""Text that was decoded with the wrong character encoding."""

from __future__ import annotations

import codecs
import math
import re
import uuid
from bisect import bisect_left
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.session import Scratch, spread

LOST = "�"
#: A word is known if it makes up this share of all words; so at most 1/KNOWN words are known, and these are broadcast.
KNOWN = 5e-6
#: and stands in the corpus this many times.
KNOWN_ROWS = 3
#: Log-probability of a word that is not known, and of a wildcard byte put into the lattice.
UNKNOWN = math.log(KNOWN) - 3
WILDCARD = -4.0
#: What changing the channel between two words costs, within a line and across lines.
SWITCH, SWITCH_LINE = -7.0, -2.0
#: Evidence (a log-likelihood ratio) from which a document counts as damaged: by misread UTF-8, whose byte
#: sequences are hard to come by otherwise, and by other pairs of encodings.
EVIDENCE = 4.0
EVIDENCE_OTHER = 6.0
#: What each byte that continues a UTF-8 sequence speaks for a text of known words.
SEQUENCE = 2.0

# Code pages in which UTF-8 is commonly misread, and (written in, read as) pairs of other code
# pages. In cp1252 and its kin a byte without a character is read as the control character of that number or lost.
READ_UTF8_AS = ("cp1252", "cp1250", "cp1251", "iso8859_2", "mac_roman", "cp437", "cp850", "cp1253", "koi8_r", "cp866")
OTHER_PAIRS = (
    ("cp1250", "cp1252"),
    ("iso8859_2", "cp1252"),
    ("cp1251", "cp1252"),
    ("cp1253", "cp1252"),
    ("koi8_r", "cp1252"),
    ("iso8859_5", "cp1252"),
    ("cp1254", "cp1252"),
    ("cp1257", "cp1252"),
    ("mac_roman", "cp1252"),
    ("cp850", "cp1252"),
    ("cp437", "cp1252"),
    ("cp852", "cp1250"),
    ("cp866", "cp1251"),
    ("koi8_r", "cp1251"),
    ("cp1251", "koi8_r"),
    ("cp1251", "cp866"),
    ("cp1252", "cp1250"),
    ("cp1252", "cp1251"),
    ("cp1252", "mac_roman"),
    ("cp1252", "cp437"),
    ("cp1252", "cp850"),
    ("iso8859_2", "cp1250"),
    ("cp1250", "iso8859_2"),
    ("cp1252", "iso8859_2"),
    ("iso8859_7", "cp1252"),
    ("cp1253", "iso8859_7"),
)
CHANNELS = (
    *((("utf_8", w),) for w in READ_UTF8_AS),
    *((("utf_8", w), ("utf_8", w)) for w in READ_UTF8_AS[:6]),
    *((p,) for p in OTHER_PAIRS),
)

_UNIT = regex.compile(r"\p{L}+|[^\x00-\x7f\p{L}]")
_SPACE = re.compile("([ \t\r\n]+)")
_LETTER = regex.compile(r"\p{L}")
_C1 = re.compile("[\x80-\x84\x86-\x9f]")
_RUN = regex.compile(rf"[\p{{L}}{LOST}]+")


def vocabulary(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Log-shares of the known words over all documents.

    A word is a run of letters in lower case or one other character beyond ASCII. Whole texts are
    counted, words of rare tokens included.
    """
    tokens = (
        docs.select(F.explode(F.split(text, "[ \t\r\n]+")).alias("t"))
        .where(F.col("t").rlike(r"[a-zA-Z\x{80}-\x{10FFFF}]"))  # cue numbers and times are no words
        .groupBy("t")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    words = (
        tokens.select("n", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+|[^\x00-\x7f\p{L}]"), F.lit(0))).alias("w"))
        .groupBy("w")
        .agg(F.sum("n").alias("n"))
    )
    scratch = Scratch(docs.sparkSession)
    words = scratch.put(words)
    total = words.agg(F.sum("n")).first()[0] or 1
    least = max(total * KNOWN, KNOWN_ROWS)
    known = {r["w"]: math.log(r["n"] / total) for r in words.where(F.col("n") >= F.lit(least)).collect()}
    scratch.drop(words)
    return known


@lru_cache(maxsize=64)
def _to_bytes(page: str) -> dict[str, int]:
    """Character to byte under a code page; its bytes without a character stand for control characters."""
    out = {}
    for b in range(256):
        ch = bytes([b]).decode(page, "ignore") or chr(b)
        out[ch] = b
    for b in range(0x80, 0xA0):
        out.setdefault(chr(b), b)
    return out


_BY_PAGE: dict[str, list[int]] = defaultdict(list)
for _k, _c in enumerate(CHANNELS):
    _BY_PAGE[_c[0][1]].append(_k)
_PAGES = tuple(_BY_PAGE)


@lru_cache(maxsize=100_000)
def _pages_with(char: str) -> int:
    """Bit set of the code pages, in the order of _PAGES, that have the character."""
    return sum(1 << i for i, page in enumerate(_PAGES) if char in _to_bytes(page))


@lru_cache(maxsize=64)
def _byte_table(page: str) -> dict[int, int]:
    return {ord(c): b for c, b in _to_bytes(page).items()}


def feasible_pages(s: str) -> list[str]:
    """The code pages that have all characters of a text."""
    bits = -1
    for c in set(s):
        if c > "\x7f":
            bits &= _pages_with(c)
            if not bits:
                return []
    return [page for i, page in enumerate(_PAGES) if bits >> i & 1]


@lru_cache(maxsize=64)
def _holes(page: str) -> tuple[int, ...]:
    """Bytes without a character, and the no-break space: what a reader of this page may have dropped."""
    return (*(b for b in range(0x80, 0x100) if not bytes([b]).decode(page, "ignore")), 0xA0)


def units(s: str) -> list[str]:
    return _UNIT.findall(s.lower())


class Decoder:
    """The noisy channel: words have corpus frequencies, channels misread their bytes."""

    def __init__(self, words: dict[str, float]):
        self.words = words
        self.candidates = lru_cache(maxsize=50_000)(self._candidates)
        self.lossy = lru_cache(maxsize=50_000)(self._lossy)
        self.live = lru_cache(maxsize=200_000)(self._live)
        self.sorted = sorted(w.replace("ς", "σ") for w in words)
        self.evidence = lru_cache(maxsize=200_000)(self._evidence)
        self.shapes = defaultdict(list)
        for w, p in words.items():
            if not w.isascii() and w[0].isalpha():
                self.shapes["".join(c if c.isascii() else LOST for c in w)].append((p, w))
        for v in self.shapes.values():
            v.sort(reverse=True)

    def score(self, s: str) -> float:
        get = self.words.get
        return sum(get(u, UNKNOWN) for u in units(s))

    def undo(self, s: str, step: tuple[str, str]) -> str | None:
        """One misreading undone: the text written in step[0] that reads as ``s`` under step[1]."""
        written, read = step
        return self.decoded(s, written, read) if read in feasible_pages(s) else None

    def _lossy(self, s: str, channel: tuple[tuple[str, str], ...]) -> str:
        """A channel undone as far as the bytes that are left allow."""
        for written, read in channel:
            table = _to_bytes(read)
            if written != "utf_8":
                s = "".join(bytes([table[c]]).decode(written, "ignore") or c if c in table else c for c in s)
            else:
                s = self.lattice(s, table, _holes(read))
        return s

    @staticmethod
    def decoded(s: str, written: str, read: str) -> str | None:
        """``undo`` of a text whose characters the page has."""
        try:
            return codecs.charmap_encode(s, "strict", _byte_table(read))[0].decode(written)
        except UnicodeDecodeError:
            return None

    def _live(self, start: str) -> bool:
        """Whether a known word begins so."""
        start = start.lower().replace("ς", "σ")
        at = bisect_left(self.sorted, start)
        return at < len(self.sorted) and self.sorted[at].startswith(start)

    def _extend(self, paths: dict, key: str | None, score: float, trail, text: str) -> None:
        """A path's word so far (None once no known word begins so) goes on by ``text``; of two paths with the
        same word so far only the better one can win."""
        for c in text:
            if _LETTER.match(c):
                key = key + c if key is not None and self.live(key + c) else None
            else:
                score += self._closed(key)
                if c > "\x7f":
                    score += self.words.get(c.lower(), UNKNOWN)
                key = ""
        if key not in paths or paths[key][0] < score:
            paths[key] = (score, (trail, text))

    def _closed(self, key: str | None) -> float:
        return UNKNOWN if key is None else self.words.get(key.lower(), UNKNOWN) if key else 0.0

    def lattice(self, s: str, table: dict[str, int], holes: tuple[int, ...]) -> str:
        """Viterbi search through the byte lattice of ``s``; exact, and linear in the length.

        From each character the paths go on by a whole UTF-8 sequence, by one with a wildcard for a lost
        byte, or by the character as it stands; paths are ranked by the words they spell.
        """
        paths: list[dict] = [{} for _ in range(len(s) + 1)]
        paths[0][""] = (0.0, None)
        for i, c in enumerate(s):
            here, paths[i] = paths[i], {}
            b = table.get(c, -1)
            need = 1 if 0xC2 <= b < 0xE0 else 2 if 0xE0 <= b < 0xF0 else 3 if 0xF0 <= b < 0xF5 else 0
            ways = [(1, c, 0.0 if b < 0x80 else UNKNOWN / 2)]
            if need:
                tail = [table.get(x, -1) for x in s[i + 1 : i + 1 + need]]
                good = 0
                while good < len(tail) and 0x80 <= tail[good] < 0xC0:
                    good += 1
                fills: list[tuple[list[int], int, float]] = []
                if good == need:
                    fills.append((tail, need, 0.0))
                else:
                    for at in range(good + 1):
                        for h in holes:
                            if 0x80 <= h < 0xC0 and good + 1 == need:
                                fills.append(([*tail[:at], h, *tail[at:good]], good, WILDCARD))
                for rest, used, cost in fills:
                    try:
                        ways.append((1 + used, bytes([b, *rest]).decode("utf_8"), cost))
                    except UnicodeDecodeError:
                        continue
            for key, (score, trail) in here.items():
                for used, text, cost in ways:
                    self._extend(paths[i + used], key, score + cost, trail, text)
        trail = max(((score + self._closed(key), n, trail) for n, (key, (score, trail)) in enumerate(paths[-1].items())), key=lambda x: x[:2])[2]
        out = []
        while trail is not None:
            trail, text = trail
            out.append(text)
        return "".join(reversed(out))

    def undone(self, token: str):
        """(channel, text) of every exact way to undo a channel."""
        for page in feasible_pages(token):
            for k in _BY_PAGE[page]:
                channel = CHANNELS[k]
                v = self.decoded(token, *channel[0])
                if v is None or v == token or "\x00" in v:
                    continue
                if len(channel) == 2:
                    v = None if v.isascii() else self.undo(v, channel[1])
                    if v is None:
                        continue
                yield k, v

    def _candidates(self, token: str) -> tuple[float, dict[int, tuple[str, float]]]:
        """The score of a token as it stands, and by channel the text and score of the ways to undo it."""
        base, out = self.score(token), {}
        for k, v in self.undone(token):
            s = self.score(v)
            if CHANNELS[k][0][0] == "utf_8" and all(u in self.words for u in units(v)):
                # misread words stand in the corpus too; that bytes form UTF-8 and known words is no accident
                s += SEQUENCE * (len(token) - len(v))
            if CHANNELS[k][0][0] == "utf_8" or s <= base or not self.misread_utf8(v):
                out[k] = (v, s)
        return base, out

    def _evidence(self, token: str) -> tuple[tuple[int, float, str], ...]:
        """What a token says for each channel: the gain of undoing it, if that brings a known word in, and the text.

        A single letter counts for little, since scanned texts hold many stray ones.
        """
        seen, base, out = set(units(token)), None, []
        for k, v in self.undone(token):
            utf8 = CHANNELS[k][0][0] == "utf_8"
            if utf8 and "\ufeff" in v:
                out.append((k, 10.0, v))
                continue
            known = [u for u in units(v) if u in self.words and u not in seen]
            if not known or not (utf8 or any(len(u) >= 3 and not u.isascii() for u in known)):
                continue
            if base is None:
                base = self.score(token)
            gain = self.score(v) - base
            if gain <= 0 or (not utf8 and self.misread_utf8(v)):
                continue
            if utf8 and not any(len(u) > 1 or not u.isalpha() for u in known):
                gain = min(gain, EVIDENCE / 2)
            out.append((k, gain, v))
        return tuple(out)

    def misread_utf8(self, s: str) -> bool:
        """Whether the text is UTF-8 misread in some way, and so no source text."""
        return any((v := self.undo(s, ("utf_8", w))) is not None and v != s for w in READ_UTF8_AS)

    def damage(self, tokens: list[str]) -> tuple[bool, list[int]]:
        """Whether any of the words, none of ASCII only, is misread, and the channels that account for it.

        A channel that reads all its words as one with more evidence does is left out.
        """
        total: dict[int, float] = defaultdict(float)
        read: dict[int, dict[str, str]] = defaultdict(dict)
        certain = False
        for t in tokens:
            said = self.evidence(t)
            if LOST in t:
                certain = True
            elif _C1.search(t):
                # whatever turns all control characters into known signs may account for them
                certain = True
                base = self.score(t)
                said += tuple((k, EVIDENCE_OTHER, v) for k, v in self.undone(t) if not _C1.search(v) and self.score(v) > base)
            for k, e, v in said:
                total[k] += e
                read[k][t] = v
        enough = [k for k, e in total.items() if e >= (EVIDENCE if CHANNELS[k][0][0] == "utf_8" else EVIDENCE_OTHER)]
        kept: list[int] = []
        for k in sorted(enough, key=lambda k: (-total[k], k)):
            if not any(read[k].items() <= read[j].items() for j in kept):
                kept.append(k)
        return certain or bool(kept), kept

    def fill(self, token: str) -> str:
        """A token with lost bytes, each read as one lost character: the most frequent word of this shape."""

        def word(m) -> str:
            run = m.group()
            if LOST not in run:
                return run
            low = run.lower()
            for p, w in self.shapes.get("".join(c if c.isascii() else LOST for c in low), ()):
                if all(x == LOST or x == y for x, y in zip(low, w)):
                    upper = sum(c.isupper() for c in run) > 1 or (run[0].isupper() and len(run) == 1)
                    return "".join(
                        x if x != LOST else (y.upper() if upper else y)
                        for x, y in zip(run, w)
                    )
            parts = run.split(LOST)
            if len(parts) == 2 and all(parts) and all(p.lower() in self.words for p in parts):
                return "’".join(parts)
            if len(parts) == 2 and not parts[1] and parts[0].lower() in self.words:
                return parts[0] + "…"
            if len(parts) == 2 and not parts[0] and parts[1].lower() in self.words:
                return "“" + parts[1]
            return run

        if token == LOST:
            return "—"
        return _RUN.sub(word, token)

    def restore(self, pieces: list[str], channels: list[int]) -> tuple[str, list[str], int]:
        """Viterbi over the words of a text: each is as it stands or undone by one of the channels.

        Returns the text, the names of the channels used and the number of words changed.
        """
        states = [-1, *channels]
        best = {s: (0.0 if s < 0 else SWITCH_LINE, None) for s in states}
        trail = []
        for n, t in enumerate(pieces):
            if n % 2 or t.isascii():
                if "\n" in t:
                    top = max(best, key=lambda s: best[s][0])
                    jump = best[top][0] + SWITCH_LINE
                    step = {}
                    for s in states:
                        step[s] = (jump, top) if jump > best[s][0] else (best[s][0], s)
                    trail.append((n, {s: (p, t) for s, (_, p) in step.items()}))
                    best = {s: (v, None) for s, (v, _) in step.items()}
                continue
            base, found = self.candidates(t)
            top = max(best, key=lambda s: best[s][0])
            step = {}
            for s in states:
                if s < 0:
                    text, p = t, base
                elif s in found:
                    text, p = found[s]
                else:
                    text = self.lossy(t, CHANNELS[s])
                    p = self.score(text) + (WILDCARD if text != t else 0)
                stay, move = best[s][0], best[top][0] + SWITCH
                step[s] = (max(stay, move) + p, s if stay >= move else top, text)
            trail.append((n, {s: (p, x) for s, (_, p, x) in step.items()}))
            best = {s: (v, None) for s, (v, _, _) in step.items()}
        state = max(best, key=lambda s: best[s][0])
        out, used, changed = list(pieces), set(), 0
        for n, step in reversed(trail):
            before, text = step[state]
            if n % 2 == 0 and text != pieces[n]:
                out[n] = text
                changed += 1
                used.add(state)
            state = before
        for n in range(0, len(out), 2):
            if LOST in out[n]:
                filled = self.fill(out[n])
                if filled != out[n]:
                    out[n] = filled
                    changed += 1
        names = ["<".join([c[0][0], *(r for _, r in c)]) for c in (CHANNELS[s] for s in sorted(used) if s >= 0)]
        return "".join(out), names, changed


_DECODERS: dict[str, Decoder] = {}


def _decoder(key: str, words: dict[str, float]) -> Decoder:
    """The worker's decoder, kept from task to task for what it has worked out."""
    if key not in _DECODERS:
        _DECODERS.clear()
        _DECODERS[key] = Decoder(words)
    return _DECODERS[key]


def _repair(words: dict[str, float]):
    key = uuid.uuid4().hex

    def run(batches):
        decoder = _decoder(key, words)
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words_of = dict.fromkeys(text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" "))
                damaged, channels = decoder.damage([t for t in words_of if not t.isascii()])
                if damaged:
                    pieces = _SPACE.split(text)
                    fixed, names, changed = decoder.restore(pieces, channels)
                    if not changed and LOST not in text and not _C1.search(text):
                        continue  # the words taken together speak against every channel
                    rows.append((i, names + (["lost bytes"] if LOST in text else []), changed, LOST not in fixed and not _C1.search(fixed), fixed))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.list_(pa.string()), pa.int64(), pa.bool_(), pa.string()))],
                    names=["doc_id", "channels", "n_words", "complete", "restored"],
                )

    return run


def misread_documents(docs: DataFrame) -> DataFrame:
    """Documents with misread text: doc_id, channels, n_words changed, whether all was restored, restored text.

    The corpus's own words are the source model: the shares of all words over all documents. A
    channel is a pair of encodings, written in and read as. A document is damaged if bytes were lost
    (U+FFFD), if it holds control characters that only a misread byte gives, or if undoing one
    channel turns its words into known ones with a likelihood ratio of e^EVIDENCE or more
    (e^EVIDENCE_OTHER where the text was not written in UTF-8). Its text
    is restored by a Viterbi search over the channels from word to word; words whose bytes do
    not decode exactly go through a byte lattice with wildcards for lost bytes, and lost characters
    are filled by the most frequent word of their shape. What cannot be restored stays as it was.

    Null and empty texts, and texts of ASCII only, are not damaged. Repeated rows are each reported.
    Whole texts are searched; columns other than doc_id and text are ignored. An empty table gives
    an empty result.
    """
    docs = spread(docs.select("doc_id", "text"))
    words = vocabulary(docs)
    return (
        docs.where(F.col("text").rlike(r"[^\x00-\x7f]"))
        .select("doc_id", "text")
        .mapInArrow(_repair(words), "doc_id long, channels array<string>, n_words long, complete boolean, restored string")
    )
