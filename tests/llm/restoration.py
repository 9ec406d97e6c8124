"""Damages clean documents by each channel and reports how many damaged words come back: python tests/llm/restoration.py DIR [DOCUMENTS]"""

from __future__ import annotations

import random
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def misread(text: str, channel, lose: float, rng) -> str | None:
    """The text as written and read by the channel (the last step first), some bytes without a character lost; None if it cannot be written so."""
    for written, read in reversed(channel):
        out = []
        try:
            raw = text.encode(written)
        except UnicodeEncodeError:
            return None
        for b in raw:
            ch = bytes([b]).decode(read, "ignore")
            out.append(ch or ("" if rng.random() < lose else chr(b)))
        text = "".join(out)
    return text


def rates(words: dict[str, float], texts: list[str], lose: float, each: int = 60):
    """(channel, documents, found, damaged words, restored words) of every channel that damages any text."""
    from readloom.llm import encoding as en

    decoder = en.Decoder(words)
    for k, channel in enumerate(en.CHANNELS):
        rng = random.Random(k)
        documents = found = damaged = restored = 0
        for good in rng.sample(texts, len(texts)):
            bad = misread(good, channel, lose, rng)
            if bad is None or bad == good:
                continue
            documents += 1
            pieces = en._SPACE.split(bad)
            hit, channels = decoder.damage([t for t in dict.fromkeys(pieces[::2]) if not t.isascii()])
            made = en._SPACE.split(decoder.restore(pieces, channels)[0] if hit else bad)
            found += hit
            for x, y, z in zip(en._SPACE.split(good)[::2], pieces[::2], made[::2]):
                if x != y:
                    damaged += 1
                    restored += x == z
            if documents == each:
                break
        if damaged:
            yield "<".join([channel[0][0], *(r for _, r in channel)]), documents, found, damaged, restored


def main() -> None:
    from readloom.llm import encoding as en
    from readloom.session import local_session, table

    spark = local_session("restoration")
    spark.sparkContext.setLogLevel("ERROR")
    docs = table(spark, sys.argv[1], "documents")
    words = en.vocabulary(docs)
    bad = en.misread_documents(docs).select("doc_id")
    rows = docs.join(bad, "doc_id", "left_anti").where("text rlike '[^\\\\x00-\\\\x7f]'").orderBy("doc_id").limit(int(sys.argv[2]) if len(sys.argv) > 2 else 2000)
    texts = [r["text"] for r in rows.collect() if not re.search("[\x80-\x9f�]", r["text"])]
    for lose in (0.0, 1.0):
        began, all_damaged, all_restored = time.time(), 0, 0
        for name, documents, found, damaged, restored in rates(words, texts, lose):
            print(f"{name:28} {documents:4} documents, {found:4} found, {damaged:6} words damaged, {restored / damaged:.3f} restored", flush=True)
            all_damaged, all_restored = all_damaged + damaged, all_restored + restored
        print(f"bytes without a character {'lost' if lose else 'kept'}: {all_restored / all_damaged:.3f} of {all_damaged} words restored, {time.time() - began:.0f} s")


if __name__ == "__main__":
    main()
