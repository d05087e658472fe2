"""Operators of the llm subpackage against brute force on small tables, with the odd cases of each."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import chat, classifier, decontaminate, neardup, repeats, rules, secrets, sentencepieces, sharding, tokens
from loomstone.session import Scratch

RNG = random.Random(7)
WORDS = "alpha beta gamma delta éclair Öl zwölf naïve of the and to sun moon river stone".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def table(spark, rows, extra=True):
    """Rows of (doc_id, text), with columns whose names an operator might use."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("component", F.lit("x")).withColumn("spans", F.lit("y")).withColumn("n", F.lit(1)) if extra else df


ODD = [(1, None), (2, ""), (3, "  \n\t "), (None, "alpha beta"), (5, "same words here and there"), (5, "same words here and there"), (6, "same words here and there"), (7, "é" * 3000)]


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# ---- 1 token counts ----


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_path())
    texts = ["It's 3 o'clock  \n\n now", "a<|endoftext|>b <|endoftext|>", "\x1c \x85 x ０ ２３", "日本語 テキスト 😀😀", "\U0001e900Ა x", prose(500, 1), None, "", "  ", "ab\r\n\r\n cd " * 50]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = {r.doc_id: r.n_tokens for r in tokens.count_tokens(table(spark, rows)).collect()}
    assert found == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    assert tokens.count_tokens(empty(spark)).count() == 0


def test_worker_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 10)
    split = tokens.Splitter(tokens.default_path())
    counts = tokens.Counts(split.tokenizer, {" the": 1})
    assert all(counts[f"word{i}"] > 0 for i in range(100)) and len(counts) <= 12 and counts[" the"] == 1


# ---- 2 quality rules ----


def base_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    where = {}
    for i in range(len(w) - 7):
        where.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for v in where.values() if len(v) > 1 for i in v for k in range(8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_rule_statistics(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "a b", "x y z\nx y z\n \nx y z", "so " * 40, prose(60, 3) + " # " + prose(60, 3), prose(9, 4) * 2, "a\x0bb\x0cc #*$%&|<> \n"])]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = {r.doc_id: tuple(r[n] for n in names) for r in rules.statistics(table(spark, rows)).collect()}
    assert found == {i: base_statistics(t) for i, t in rows}
    assert rules.apply_rules(empty(spark), [], []).count() == 0


def test_decision_list_finds_the_rule_and_spares_the_rest():
    r = random.Random(1)
    rows = []
    for _ in range(600):
        f = [r.uniform(20, 900), r.uniform(3, 7), r.random() * 0.05, 0.0, 0.0, r.random(), 0.0, 0.1]
        bad = r.random() < 0.2
        if bad:
            f[2] = 0.2 + r.random()
        rows.append((f, bad))
    learned = rules.learn_list(rows)
    assert learned and learned[0][0].feature == "symbol_share" and learned[0][0].above
    caught = [any(all((f[rules.FEATURES.index(t.feature)] >= t.bound) == t.above for t in rule) for rule in learned) for f, _ in rows]
    # Bounds lie at quantiles, so that a few bad rows next to the bound may pass; no good one is caught.
    bad = [b for _, b in rows]
    assert not any(c and not b for c, b in zip(caught, bad)) and sum(caught) >= 0.9 * sum(bad) and rules.learn_list([]) == []


def test_rules_from_tables(spark):
    docs = [(i, prose(80, i) + (" moron" if i % 4 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    terms, learned = rules.learn(table(spark, docs), labels)
    assert terms == ["moron"]
    kept = {r.doc_id: r.kept for r in rules.apply_rules(table(spark, docs), terms, learned).collect()}
    assert all(kept[i] == (i % 4 != 0) for i in range(200))


# ---- 3 near-duplicates ----


def brute_components(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({b" ".join(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and label[a] != label[b]:
                    n = len(sets[a] & sets[b])
                    if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                        label[a] = label[b] = min(label[a], label[b])
                        changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(0, None), (1, ""), (2, "One two"), (3, "one TWO"), (4, "É b c d e"), (5, "é b c d e")]
    base = [f"w{i}" for i in range(120)]
    for k in range(90):  # one large group whose members are alike to different degrees
        w = list(base)
        for _ in range(r.randrange(1, 9)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((100 + k, " ".join(w)))
    rows += [(300 + k, prose(70, 50 + k // 3) + (" end" if k % 3 else "")) for k in range(30)]
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(table(spark, rows)).collect()}
    assert found == brute_components(rows)


@pytest.mark.parametrize("block", [12, 3])
def test_near_duplicates_in_divided_regions(spark, monkeypatch, block):
    """Regions dealt into parts beside the members outside their main component, or divided: each document gets its right component."""
    r = random.Random(5)
    base, rows = [f"w{i}" for i in range(200)], []
    for k in range(120):
        w = list(base)
        for _ in range(r.randrange(1, 7)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(neardup, "BLOCK", block)
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(table(spark, rows)).collect()}
    assert found == brute_components(rows)


@pytest.mark.parametrize("block", [4, 15, 100])
def test_groups_hold_every_pair_of_different_components(spark, monkeypatch, block):
    """A region of one label, another of one component alone, and a large one whose main component leaves few others."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = [(0, 1, 2, k, k % 4) for k in range(40)] + [(0, 5, k, k, 9) for k in range(40)] + [(1, 7, k, k, 50 + (k % 20 == 0)) for k in range(60)]
    members = spark.createDataFrame(rows, "tree int, hi long, lo long, rep long, component long")
    held = {}
    for x in neardup.groups(members, Scratch(spark, "test")).collect():
        own = held.setdefault((x.tree, x.hi, x.sub, x.deep, x.part, x.chunk), {})
        assert x.rep not in own
        own[x.rep] = x.component
    met = {(k[0], k[1], a, b) for k, own in held.items() for a in own for b in own if a < b and own[a] != own[b]}
    want = {(t, h, min(a, b), max(a, b)) for t, h, _, a, c in rows for u, i, _, b, d in rows if (t, h) == (u, i) and c != d}
    assert met == want and all(len(own) <= 2 * block + 12 + (block < 15) * 30 for own in held.values())


@pytest.mark.parametrize("block", [4, 15])
def test_groups_divide_no_region_by_further_hashes(spark, monkeypatch, block):
    """Members of many components whose labels differ beyond their prefix: all pairs meet, one end asked and the other own."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = [(k % 2, 3, (k * 7919) % 65536 + (k << 20), k, k // 3) for k in range(120)]
    members = spark.createDataFrame(rows, "tree int, hi long, lo long, rep long, component long")
    held = {}
    for x in neardup.groups(members, Scratch(spark, "test")).collect():
        held.setdefault((x.tree, x.hi, x.part, x.chunk), []).append((x.rep, x.component, x.own, x.asked))
    met = {(k[0], min(a, b), max(a, b)) for k, rows in held.items() for a, c, _, asked in rows for b, d, own, _ in rows if asked and own and c != d}
    assert met == {(t, a, b) for t, _, _, a, c in rows for u, _, _, b, d in rows if t == u and a < b and c != d}


def test_filter_of_ids_passes_all_that_are_named(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(-500, 500)] + [(None, "t")], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(-500, 500, 7)], "doc_id long")
    found = {x.doc_id for x in neardup.marked(docs, ids, "doc_id").collect()}
    assert set(range(-500, 500, 7)) <= found and len(found) < 200 and neardup.marked(docs, ids.limit(0), "doc_id").count() == 0


def test_near_duplicates_across_cuts_of_ranges(spark, monkeypatch):
    """One tree alone, in so many ranges that most regions straddle a cut."""
    whole = neardup.forest
    monkeypatch.setattr(neardup, "forest", lambda reps: whole(reps).filter("tree = 0"))
    rows = [(3 * i + k, prose(400, 700 + i) + f" end{k}" * bool(k)) for i in range(20) for k in range(3)]
    name, coalesce = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before, found = spark.conf.get(name), []
    spark.conf.set(coalesce, "false")
    try:
        for n in ("1", "40"):
            spark.conf.set(name, n)
            found.append({x.doc_id: x.component_id for x in neardup.near_duplicates(table(spark, rows)).collect()})
    finally:
        spark.conf.set(name, before)
        spark.conf.unset(coalesce)
    assert found[0] == found[1] and sum(k != v for k, v in found[0].items()) > 30


def test_near_duplicates_filters_keep_unlucky_links(spark):
    """Pairs of 3 and 4 shingles, 3 of them shared, whose signatures agree in 74 to 76 of 128 hashes; a sketch five standard errors below."""
    hasher, at = neardup.Hasher(), [11660, 19939, 27054, 33404, 48883]
    words = [[f"{c}{k}" for c in "abcdefgh"] for k in at]
    sets = hasher.shingles([" ".join(w[:n]).encode() for w in words for n in (7, 8)])
    sigs = [hasher.signature(h) for h in sets]
    assert all(74 <= (x == y).sum() <= 76 for x, y in zip(sigs[::2], sigs[1::2]))
    reps = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sigs)], "rep long, sig binary")
    pairs = [(2 * i, 2 * i + 1) for i in range(len(at))]
    found = neardup.likely(spark.createDataFrame(pairs, "a long, b long"), reps).collect()
    assert sorted((r.a, r.b) for r in found) == pairs

    shared, rest, beyond = np.arange(516), np.arange(516, 768), np.arange(768, 1000)
    x, y = (np.concatenate([shared, rest[k::2], beyond])[: neardup.SKETCH].astype(np.uint32) for k in (0, 1))
    assert neardup.close(x, 2000, y, 2000)


def test_near_duplicates_odd_rows(spark):
    found = neardup.near_duplicates(table(spark, ODD)).collect()
    assert len(found) == len(ODD) and all(r.kept for r in found if r.doc_id is None)
    assert {r.component_id for r in found if r.doc_id in (5, 6)} == {5}
    kept = neardup.drop_near_duplicates(table(spark, ODD))
    assert kept.columns == table(spark, ODD).columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 5, 5, 7]
    assert neardup.near_duplicates(empty(spark)).count() == 0


# ---- 4 decontamination ----


def test_contained_items_are_found(spark):
    items = [(1, prose(30, 1)), (2, prose(12, 2)), (3, None), (4, "short one"), (5, prose(30, 1))]
    part = prose(30, 1).split()
    rows = [(10, prose(3000, 9) + " " + prose(30, 1).upper().replace("ÉCLAIR", "éclair").replace("ZWÖLF", "zwölf").replace("ÖL", "Öl").replace("NAÏVE", "naïve") + " tail"), (11, "x " + " ".join(part[:28])), (12, " ".join(part[:15])), (13, "Short ONE"), (14, "a short one"), (15, None), (16, prose(200, 77) + " " + prose(12, 2))]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def sets(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({b" ".join(w)} if w else set())

    expected = {(d, i, len(sets(t) & sets(x)), len(sets(x))) for d, t in rows for i, x in items if sets(x) and len(sets(t) & sets(x)) >= 0.75 * len(sets(x))}
    found = {tuple(r) for r in decontaminate.contaminated_pairs(table(spark, rows), bench).collect()}
    assert found == expected and {(13, 4), (16, 2), (10, 5)} <= {x[:2] for x in found}
    limit, decontaminate.BROADCAST_SHINGLES = decontaminate.BROADCAST_SHINGLES, 0
    try:
        assert {tuple(r) for r in decontaminate.contaminated_pairs(table(spark, rows), bench).collect()} == expected
    finally:
        decontaminate.BROADCAST_SHINGLES = limit
    assert decontaminate.remove_contaminated(table(spark, ODD), bench).count() == len(ODD)


# ---- 5 SentencePiece ----


@pytest.mark.parametrize("block", [2, 64])
def test_encoding_equals_the_library(spark, monkeypatch, block):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_path())
    for name, value in (("GIANT", 200), ("CHUNK", 160), ("SEARCH", 24), ("BLOCK", block)):
        monkeypatch.setattr(sentencepieces, name, value)
    texts = [None, "", " ", "a  b\n\n c\t", "x▁y", "日本語😀" * 60, "helloworldthisisalongrunofletters" * 40, prose(400, 2), "ab " * 300, " " * 700, "é" * 500, "a" * 159 + " " * 400 + "b", prose(60, 3) + "x▁y" + prose(60, 4), "é" * 400 + " " + prose(90, 5) + "ß" * 400]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])]
    found = sentencepieces.encode(table(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        t = texts[r.doc_id] or ""
        assert list(r.ids) == library.encode(t), t[:40]
        assert r.round_trip == ("▁" not in t) and r.n_tokens == len(r.ids)
    bare = sentencepieces.encode(table(spark, rows).repartition(5), keep_ids=False)
    expected = {(r.doc_id, r.n_tokens, r.ids_sha256, r.round_trip) for r in found}
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.round_trip) for r in bare.collect()} == expected and "ids" not in bare.columns
    assert all(r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest() for r in found)
    back = sentencepieces.decode(spark.createDataFrame([(list(found[3].ids),), (None,)], "ids array<int>")).collect()
    assert back[1].text is None and sentencepieces.encode(empty(spark)).count() == 0


def test_max_plus_product_is_associative():
    r = np.random.default_rng(1)
    a, b, c = (r.choice([0.0, -np.inf], size=s) for s in ((2, 3), (3, 4), (4, 2)))
    one, two = sentencepieces.product(sentencepieces.product(a, b), c), sentencepieces.product(a, sentencepieces.product(b, c))
    assert np.array_equal(one, two)


# ---- 6 repeated passages ----


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        mark = [False] * len(b)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                mark[p : p + 100] = [True] * 100
            seen.add(b[p : p + 100])
        kept = bytes(c for c, m in zip(b, mark) if not m)
        out[i] = (len(b), sum(mark), sum(m and not (k and mark[k - 1]) for k, m in enumerate(mark)), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_equal_brute_force(spark):
    shared, other = prose(60, 11), prose(40, 12)
    rows = [(1, prose(100, 13) + shared + prose(30, 14)), (2, shared + prose(50, 15) + other), (3, "x" + other + "y" + shared[5:] + other), (4, "ab" * 300), (5, "ab" * 90 + "c" + "ab" * 90), (6, None), (7, ""), (8, shared[:99]), (9, shared[:100]), (10, shared), (11, prose(300, 16)), (12, prose(300, 16)), (13, "é" * 200)]
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(table(spark, rows)).collect()}
    assert found == brute_repeats(rows)


@pytest.mark.parametrize("step,spread", [(1 << 21, 64), (500, 1)])
def test_repeats_in_small_pieces(spark, monkeypatch, step, spread):
    monkeypatch.setattr(repeats, "STEP", step)
    monkeypatch.setattr(repeats, "SPREAD", spread)
    rows = [(i, prose(40, 100 + i) + prose(50, 1) + prose(20 + i, 2) + prose(30, 200 + i)) for i in range(40)] + [(99, prose(3000, 5) * 2)]
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(table(spark, rows).repartition(5)).collect()}
    assert found == brute_repeats(rows)


@pytest.mark.parametrize("spread", [2, 5])
def test_repeats_of_choices_that_some_batches_spread(spark, monkeypatch, spread):
    """Runs of one choice that differ come to several tasks: many from the first batches, a few from the last."""
    monkeypatch.setattr(repeats, "SPREAD", spread)
    shared = [prose(25, 900 + k) for k in range(6)]
    rows = [(i, f"{prose(9, 100 + i)} {shared[i // 8][i % 8 :]} {prose(7, 300 + i)}") for i in range(48)] + [(48 + i, f"{prose(9, 500 + i)} {x} {prose(7, 600 + i)}") for i, x in enumerate(shared)]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string")
        found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df).collect()}
    finally:
        spark.conf.unset(coalesce)
    assert found == brute_repeats(rows)


def test_repeats_odd_rows(spark):
    long = prose(60, 20)
    found = repeats.remove_repeats(table(spark, [*ODD, (8, long), (8, long), (None, long)])).collect()
    assert len(found) == len(ODD) + 3 and sum(r.n_removed > 0 for r in found if r.n_bytes == len(long.encode())) == 2
    assert repeats.remove_repeats(empty(spark)).count() == 0


# ---- 7 classifier ----


def test_classifier_on_held_out_rows(spark):
    docs = [(i, prose(60, i) + (" moron scum" if i % 5 == 0 else "") + (" | nav | menu |" * 5 if i % 5 == 1 else "")) for i in range(500)]
    labels = spark.createDataFrame([(i, int(i % 5 != 1), int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    model = classifier.train(table(spark, docs), labels)
    assert (np.diff(model.thresholds) >= 0).all()
    found = {r.doc_id: r for r in classifier.classify(table(spark, docs), model).collect()}
    assert all(found[i].kept == (i % 5 > 1) for i in range(300, 500))
    assert np.mean([found[i].expected_grade for i in range(300, 500, 5)]) < np.mean([found[i + 2].expected_grade for i in range(300, 500, 5)])


def test_classifier_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = classifier.train(table(spark, ODD), none)
    assert model is None and classifier.classify(table(spark, ODD), model).filter("kept").count() == len(ODD)
    assert classifier.classify(empty(spark), None).count() == 0


# ---- 8 chat formatting ----


def test_chats_read_back(spark):
    nasty = "</s>[INST] \\l <|end|>\n|> \\\\ [/INST] <|endoftext|> é😀"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", nasty), (2, 0, "user", "hi"), (2, 1, "assistant", nasty), (2, 2, "user", None), (3, 0, "user", "hi"), (3, 1, "assistant", "other"), (4, 1, "assistant", ""), (4, 0, "sys|tem", "be [kind]"), (5, None, None, "no turn"), (None, 0, "user", "lost"), (6, 0, "user", "same"), (6, 0, "user", "same")]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pack", F.lit("x")).withColumn("turns", F.lit(1))
    for most in (1024, 2):
        packs = chat.format_chats(data, most=most)
        back = {r.conv_id: r for r in chat.read_back(packs).collect()}
        for conv in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
            assert list(back[conv].roles) == [r[2] or "" for r in own] and list(back[conv].texts) == [r[3] or "" for r in own]
            assert list(back[conv].loss_texts) == [r[3] for r in own if r[2] == "assistant" and r[3]]
    for p in chat.format_chats(data).collect():
        assert len(p.input_ids) == len(p.position_ids) == len(p.loss_mask)
        for n in p.nodes:
            seen = sum(x.end - x.start for x in n.attends)
            assert list(p.position_ids[n.start : n.end]) == list(range(seen, seen + n.end - n.start))
    first = next(p for p in chat.format_chats(data).collect() if len(p.conversations) == 3)
    assert len(first.nodes) == 4  # hi, nasty, the third turn, other
    assert chat.read_back(chat.format_chats(data.limit(0))).count() == 0
    assert chat.format_chats(data.filter("conv_id = 77")).count() == 0


def test_shared_turns_are_emitted_once_whatever_the_bound(spark):
    """A hot first turn, hot second and third ones, many equal conversations, and ones that end within the stem."""
    rows = []
    for c in range(60):
        own = [("user", "hello there"), ("assistant", f"answer {c % 2}"), ("user", f"next {c % 4}"), ("assistant", f"last {c % 20}")][: 4 - (c % 7 == 0) - 2 * (c % 11 == 0)]
        rows += [(c, k, *t) for k, t in enumerate(own)]
    rows += [(None, 0, "user", "hello there"), (None, 1, "assistant", "")]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seen = []
    for most in (1024, 16, 3, 1):
        packs = chat.format_chats(data, most=most)
        found = packs.collect()
        seen.append((sum(len(p.nodes) for p in found), sum(len(p.input_ids) for p in found)))
        by = {p.pack: p for p in found}
        assert len(by) == len(found) and (most == 1024) == (len(found) == 1)
        for p in found:
            before = sum(x.end - x.start for x in p.stem)
            assert all(x.start == 0 and x.end == len(by[x.pack].input_ids) for x in p.stem)
            for n in p.nodes:
                at = before + sum(x.end - x.start for x in n.attends)
                assert list(p.position_ids[n.start : n.end]) == list(range(at, at + n.end - n.start))
        back = {r.conv_id: (list(r.roles), list(r.texts), list(r.loss_texts)) for r in chat.read_back(packs).collect()}
        for c in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == c]
            assert back[c] == ([r[2] for r in own], [r[3] for r in own], [r[3] for r in own if r[2] == "assistant" and r[3]])
    assert len(set(seen)) == 1


# ---- 9 secrets ----


def base_spans(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def entropy(s):
    return max(math.log2(20) - sum(c * math.log2(c) for c in (w.count(x) for x in set(w))) / 20 for w in (s[i : i + 20] for i in range(len(s) - 19)))


def test_secrets_equal_brute_force(spark):
    key = base64.b64encode(bytes(range(7, 40))).decode()
    texts = [None, "", "é😀 Password = 'hunter22' token:abc token=token:abcdefgh", "AKIA" + "Z9" * 8 + " AKIAAKIA" + "Q" * 8, "deadbeef" * 4 + " xyz " + "0123456789abcdef01234567", f"😀 {key} end", "api_key=" + key, "a" * 40, "/usr/local/share/documentation/files", "123e4567-e89b-12d3-a456-426614174000", "12345678901234567890123", "AKIA" * 9, "SECRET: short token=" + "x" * 6]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert [(x.s, x.k, x.e) for x in found[i].base] == base_spans(t or ""), t
    extra = lambda i: [(x.s, x.e) for x in found[i].spans if x.k == 3]
    assert extra(5) == [(2, 2 + len(key))] and not any(extra(i) for i in (6, 7, 8, 9, 10))
    one = spark.createDataFrame([(key,), ("ab" * 20,), ("a1" * 9 + "b2c3",)], "c string")
    for r in one.select("c", secrets.peak_entropy(F.col("c")).alias("h")).collect():
        assert abs(r.h - entropy(r.c)) < 1e-9


def test_redaction_keeps_clean_texts_and_columns(spark):
    docs = spark.createDataFrame([(1, "a password=hunter22 b", 21), (2, "clean", 5), (3, None, 0), (4, "token=" + "ab12" * 8 + "!", 39)], "doc_id long, text string, n_chars long").withColumn("other", F.lit(1))
    found = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert found[1].text == "a [secret] b" and found[1].n_chars == 12 and found[2].text == "clean" and found[3].text is None and found[4].text == "[secret]!"
    assert secrets.redact(docs).columns == docs.columns and secrets.scan(empty(spark)).count() == 0


# ---- 10 sharding ----


def test_shards_are_even_and_gapless(spark, monkeypatch):
    import zlib

    monkeypatch.setattr(sharding, "SAMPLES", 2)
    rows = [(i, "hot text " * 20) for i in range(500)] + [(1000 + i, prose(RNG.randrange(0, 200), i)) for i in range(700)] + [(None, None), (5, "hot text " * 20), (5000, None)]
    found = sharding.shard_by_bytes(table(spark, rows), 24).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r)
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    assert set(by) == set(range(24)) and max(sizes) - min(sizes) <= 2 * max(r["size"] for r in found)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    texts = {i: t for i, t in rows}
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r["size"] == 8 + len((texts[r.doc_id] or "").encode()) for r in found if r.doc_id is not None)
    assert sharding.shard_by_bytes(empty(spark), 24).count() == 0


# ---- names, nulls and repeated rows, for all ----


def clashing(spark, rows):
    """Rows of (doc_id, text) with columns named like those that the operators make or use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in "ids _ids _key n_tokens IDS_SHA256 round_trip kept expected_grade P_TOP base spans words lines n_words rule hashes key bits bucket at n_chars2".split():
        df = df.withColumn(c, F.lit("own"))
    return df


def test_clashing_names(spark):
    rows = [(1, "a password=hunter22 " + prose(30, 1)), (2, None), (2, None), (3, prose(40, 3))]
    df = clashing(spark, rows)
    assert tokens.count_tokens(df).filter("base = 'own'").count() == 4
    monkey = sentencepieces.encode(df)
    assert {r.doc_id: r.n_tokens > 0 for r in monkey.collect()} == {1: True, 2: False, 3: True} and "base" in monkey.columns
    assert classifier.classify(df, None).filter("kept and base = 'own'").count() == 4
    good = classifier.keep_good(df, None)
    assert good.columns == df.columns and good.filter("kept = 'own'").count() == 4
    clean = secrets.redact(df)
    assert clean.columns == df.columns and {(r.text, r.spans, r.base) for r in clean.collect() if r.doc_id == 1} == {("a [secret] " + prose(30, 1), "own", "own")}
    assert secrets.scan(df).filter("size(spans) > 0 and kept = 'own'").count() == 1
    assert rules.apply_rules(df, [], []).filter("words = 'own' and lines = 'own'").count() == 4
    bench = spark.createDataFrame([(1, prose(40, 3))], "item_id long, text string")
    left = decontaminate.remove_contaminated(df, bench)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 2]
    assert neardup.drop_near_duplicates(df).columns == df.columns
    assert repeats.remove_repeats(df).count() == 4 and sharding.shard_by_bytes(df, 3).count() == 4


def test_giant_texts_with_clashing_names(spark, monkeypatch):
    for name, value in (("GIANT", 200), ("CHUNK", 160), ("SEARCH", 24)):
        monkeypatch.setattr(sentencepieces, name, value)
    found = sentencepieces.encode(clashing(spark, [(1, prose(400, 2)), (2, prose(400, 2))]), keep_ids=False).collect()
    assert len(found) == 2 and all(r.round_trip is True for r in found)


def test_pieces_are_one_list_however_many_partitions(spark):
    rows = [(i, prose(30, i) + f" own{i}") for i in range(64)]
    name, coalesce = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(coalesce, "false")
    spark.conf.set(name, "32")
    try:
        found = [tokens.frequent_pieces(table(spark, rows).repartition(n), tokens.default_path(), most=500) for n in (1, 32)]
    finally:
        spark.conf.set(name, before)
        spark.conf.unset(coalesce)
    assert found[0] == found[1] and " the" in found[0]
    assert len(tokens.frequent_pieces(table(spark, rows), tokens.default_path(), sample=8)) < len(found[0])


def test_label_rows_with_nulls_take_no_part(spark):
    docs = [(i, prose(60, i) + (" moron scum" if i % 5 == 0 else "")) for i in range(200)]
    whole = [(i, 1, int(i % 5 == 0)) for i in range(200)]
    kind = "doc_id long, quality int, toxic int"
    one = classifier.train(table(spark, docs), spark.createDataFrame(whole, kind))
    two = classifier.train(table(spark, docs + [(900, "moron")]), spark.createDataFrame(whole + [(900, None, None), (None, 1, 0), (900, 1, None)], kind))
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.thresholds, two.thresholds)


def test_many_spans_of_a_long_text(spark):
    """More spans than a block holds, some overlapping, against brute force and plain replacement."""
    r = random.Random(11)
    parts = [r.choice(["password=hunter%d " % k, "x" * r.randrange(9) + " ", "token: abc ", "ab12" * 8 + " ", "AKIA" + "Q" * 16 + " ", "éö "]) for k in range(3000)]
    text = "".join(parts)
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(x.s, x.k, x.e) for x in row.base] == base_spans(text)
    at, out = 0, []
    for s, _, e in sorted((x.s, x.k, x.e) for x in row.spans):
        if s >= at:
            out += [text[at:s], "[secret]"]
        at = max(at, e)
    assert secrets.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text == "".join(out) + text[at:]


def test_rows_without_an_id_are_decontaminated(spark):
    bench = spark.createDataFrame([(1, prose(40, 3)), (None, prose(40, 9))], "item_id long, text string")
    docs = spark.createDataFrame([(None, prose(40, 3)), (None, "clean"), (None, None), (7, prose(40, 9)), (8, "clean")], "doc_id long, text string")
    left = decontaminate.remove_contaminated(docs, bench).collect()
    assert sorted((x.doc_id or -1, x.text or "") for x in left) == [(-1, ""), (-1, "clean"), (8, "clean")]
