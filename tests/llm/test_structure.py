"""Structure repair against all sequences of edits, by pieces and whole, with the odd rows."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from loomstone.llm import structure

ROW = "conv_id long, turn long, role string, text string"
SPACES = "[\x20\x09-\x0d]"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(f"{SPACES}+$", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """All edits of each row, up to two insertions before it and at the end."""
    why, best = faults(rows), None
    inserts = ["", "I", "II"]
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(w in ("blank", "duplicate") and e != "D" for e, w in zip(edits, why, strict=True)):
            continue
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            audit = "".join(g + e for g, e in itertools.zip_longest(gaps, edits, fillvalue=""))
            cost = 5 * audit.count("I") + audit.count("R") + 2 * audit.count("D") + sum(5 for e, w in zip(edits, why, strict=True) if w == "truncated" and e != "D")
            if best is not None and (cost, audit) >= best[:2]:
                continue
            made, last, at = [], "", 0
            for e in audit:
                role = "assistant" if last == "u" else "user"
                if e == "I":
                    made.append((role, ""))
                else:
                    at += 1
                    if e != "D":
                        made.append((rows[at - 1][0] if e == "K" else role, rows[at - 1][1]))
                last = made[-1][0][:1] if made else ""
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in made)):
                best = cost, audit, made
    return best


def texts(seed):
    r = random.Random(seed)
    return [(r.choice(["system", "user", "assistant", "user", "tool", ""]), r.choice(["One.", "Two!", "three", " \n", "", "One.", "é?  "])) for _ in range(r.randint(0, 4))]


def expected(turned):
    """The report's columns for rows (turn, role, text) in any order."""
    turned = sorted(turned, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
    rows, turns = [x[1:] for x in turned], [x[0] for x in turned if x[0] is not None]
    cost, audit, made = cheapest(rows)
    why = faults(rows)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, why.count("blank"), why.count("duplicate"), why.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()), made


@pytest.mark.parametrize("piece", [1, 2, structure.PIECE])
def test_repair_equals_all_edits(spark, monkeypatch, piece):
    monkeypatch.setattr(structure, "PIECE", piece)
    convs = {c: [(k * 2 if k % 3 else None, role, text) for k, (role, text) in enumerate(texts(c))] for c in range(60)}
    convs[None] = [(1, "user", "Hi."), (1, "user", "Hi."), (0, "system", "S."), (3, "user", "Hi.")]
    convs = {c: rows for c, rows in convs.items() if rows}
    df = spark.createDataFrame([(c, *r) for c, rows in convs.items() for r in rows], ROW)
    # Names that the operator uses itself.
    df = df.withColumn("digest", F.lit(1)).withColumn("pid", F.lit("x")).withColumn("conv", F.lit(None).cast("int"))
    found = {r.conv_id: tuple(r)[1:] for r in structure.report(df).collect()}
    want = {c: expected(rows) for c, rows in convs.items()}
    assert found == {c: w[0] for c, w in want.items()}
    made = {}
    for r in structure.repaired(df).orderBy("conv_id", "place").collect():
        assert r.place == len(made.setdefault(r.conv_id, [])) and r.edit in "KRI"
        made[r.conv_id].append((r.role, r.text))
    assert made == {c: w[1] for c, w in want.items() if w[1]}


def test_nulls_dropped_rows_and_empty_tables(spark):
    rows = [(1, None, None, None), (2, 0, "user", "Hi."), (3, 0, "user", "Hi."), (3, 1, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, ROW)
    nothing = hashlib.sha256(b"").hexdigest()
    found = {r.conv_id: tuple(r)[1:] for r in structure.report(df, F.when(F.col("conv_id") == 2, 0).otherwise(1)).collect()}
    assert found[1] == (0, 1, 0, 0, 0, 2, "D", nothing)
    assert found[2] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert found[3][5:] == (0, "KK", hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest())
    assert structure.report(df.limit(0)).count() == 0 and structure.repaired(df.limit(0)).count() == 0


def test_one_conversation_of_very_many_rows_and_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(structure, "PIECE", 64)
    turns = [(9, k, "user" if k % 2 == 0 else "assistant", f"Text {k}.") for k in range(3000)]
    turns[1000] = (9, 1000, "user", "Text 0.")  # seen before: deleted, and a user turn inserted or the answer deleted too
    df = spark.createDataFrame([*turns, (10, 0, "user", "x" * 3_000_000 + "."), (10, 1, "assistant", "Y.")], ROW)
    found = {r.conv_id: r for r in structure.report(df).collect()}
    assert (found[9].duplicate, found[9].cost, len(found[9].audit)) == (1, 4, 3000)
    assert found[9].audit == "K" * 999 + "DD" + "K" * 1999 and found[10].audit == "KK"
    kept = [t for k, t in enumerate(turns) if found[9].audit[k] == "K"]
    assert found[9].repaired_sha256 == hashlib.sha256("\n".join(f"{t[2]}:{t[3]}" for t in kept).encode()).hexdigest()


def test_chains_of_parts_compare_as_their_texts():
    parts = ["", "D", "K", "DD", "KI", "IK"]
    for a in itertools.product(parts, repeat=2):
        for b in itertools.product(parts, repeat=2):
            x, y = ((None, a[0]), a[1]), ((None, b[0]), b[1])
            assert structure._chain_before(x, y) == ("".join(a) < "".join(b))
