"""Spelling variants against all pairs of words, with the damage of runs by checksum."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    form, out = {}, set()
    around = {w: [v for v in words if near(w, v)] for w in words}
    for w, n in words.items():
        best = min(around[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * n:
            form[w] = best
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(around[w]), words[form[w]] if w in form else None))
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit("y"))
    return {tuple(r) for r in spelling.variants(df).collect()}


def family():
    """Words with variants of falling counts, in chains, with letters beyond ASCII and words that share a half."""
    out = Counter({"letters": 700, "leters": 130, "leter": 9, "letersx": 20, "élèvement": 90, "éleèvement": 12, "elèvement": 6, "ÿÀÞ×÷ßabc": 7, "abcdefgh": 40, "abcdefgi": 8, "abcdefg": 8, "xabcdefgh": 5, "abcdeefgh": 6, "aaaaaaa": 30, "aaaaaa": 5, "aaaaaaaa": 6, "few": 50, "rarely": 4})
    for i in range(60):
        out["common" + chr(97 + i % 26) + "e" * (i // 26)] = 5 + i
    return out


def texts(r):
    words = [w for w, n in family().items() for _ in range(n)]
    r.shuffle(words)
    return [(i, " ".join(w.upper() if w.isascii() and k % 3 == 0 else w for k, w in enumerate(words[i::40])) + "Ātail letters-letters") for i in range(40)]


@pytest.mark.parametrize("shard, block", [(7, 5), (1 << 16, 1 << 14)])
def test_equals_all_pairs(spark, monkeypatch, shard, block):
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "COUNTED", 20)
    monkeypatch.setattr(spelling, "LENGTHS", shard)
    rows = texts(np.random.default_rng(3)) + [(None, "letters " * 9), (5, None), (6, ""), (7, "letters leters"), (7, "letters leters")]
    assert (want := brute(rows)) == found(spark, rows)
    assert any(r[1] and r[2] != r[1] for r in want)  # a chain of forms


def test_long_texts_damage_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(spelling, "STRETCH", 100)
    rows = [(i, " ".join(f"word{chr(97 + j)}{chr(97 + i % 26)}" for j in range(26)) + " " + "z" * 500) for i in range(300)]
    assert brute(rows) == found(spark, rows)
    assert found(spark, rows[:0]) == set()


def test_edits_by_arrays():
    words = [a + b for a in ("ab", "ba", "aab", "") for b in ("", "a", "b", "ab")]
    for n in range(6):
        for m in (n - 1, n, n + 1):
            x, y = [w for w in words if len(w) == n], [w for w in words if len(w) == m]
            if x and y:
                table = spelling._one_edit(spelling._codes(x, n), spelling._codes(y, m))
                assert [[bool(c) for c in r] for r in table] == [[near(a, b) for b in y] for a in x]
