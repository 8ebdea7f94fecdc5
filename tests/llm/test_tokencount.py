"""Greedy counts against a search for the longest piece at every place."""

import random
import re

from armwave.llm import tokencount
from armwave.llm.queries import TOKENIZERS

PATH = f"{TOKENIZERS}/byte_bpe_50k.json"


def greedy(word: bytes, pieces: set[bytes], longest: int) -> int:
    at = n = 0
    while at < len(word):
        at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at: at + k] in pieces)
        n += 1
    return n


def test_small_vocabulary():
    draw = random.Random(3)
    for _ in range(30):
        pieces = {bytes([b]) for b in b"abc"} | {bytes(draw.choice(b"abc") for _ in range(draw.randint(2, 6))) for _ in range(draw.randint(0, 25))}
        auto = tokencount.LongestMatch(sorted(pieces))
        for _ in range(200):
            word = bytes(draw.choice(b"abc") for _ in range(draw.randint(0, 20)))
            assert auto.count(word) == greedy(word, pieces, 6)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (-4, "x" * 3000), (-5, "é🙂 \x00a"), (-5, "é🙂 \x00a"), (None, "a b")], docs.schema)
    got = sorted(map(tuple, tokencount.count_tokens(docs.unionByName(odd), PATH).collect()), key=str)
    pieces = set(tokencount.byte_vocabulary(PATH))
    longest, seen, want = max(map(len, pieces)), {}, []
    for key, text in docs.unionByName(odd).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for w in words:
            if w not in seen:
                seen[w] = greedy(b" " + w.encode(), pieces, longest)
        want.append((key, len(words), sum(seen[w] for w in words)))
    assert got == sorted(want, key=str)
    assert tokencount.count_tokens(docs.limit(0), PATH).count() == 0
