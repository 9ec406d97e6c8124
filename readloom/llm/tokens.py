"""Token counts under a public byte-level vocabulary; its file is a parameter."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this public vocabulary cuts a text before merging bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The file's bytes, read where the query is planned; executors get them, not the path."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes | None = None):
    import tiktoken

    lines = (vocabulary or read_vocabulary()).splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("readloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# a run of white space this long is cut out, since the pattern's look-ahead would exhaust the stack on longer ones
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def count(text: str, vocabulary: bytes | None = None) -> int:
    """Tokens of a whole text, of any length.

    Where a long run of white space is cut out the pattern cuts too: after the character before it and before
    its last character, or its end at the end of the text.
    """
    e, n, at = encoder(vocabulary), 0, 0
    for m in _SPACES.finditer(text):
        end = m.end() - (m.end() < len(text))
        n += len(e.encode_ordinary(text[at : m.start()])) + len(e._encode_single_piece(text[m.start() : end]))
        at = end
    return n + len(e.encode_ordinary(text[at:]))
