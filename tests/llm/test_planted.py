"""Secrets planted in prose and their recall; rows alike in text and id across shards."""

import base64
import random

from pyspark.sql import functions as F

from loomstone.llm import secrets, sharding


def test_planted_secrets_are_found_and_other_strings_left_alone(spark):
    r = random.Random(8)
    draw = lambda n, abc="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(r.choice(abc) for _ in range(n))
    b64 = lambda n: base64.b64encode(bytes(r.randrange(256) for _ in range(n))).decode()
    url = lambda n: b64(n).translate(str.maketrans("+/", "-_")).rstrip("=")
    kinds = {"base64": lambda: b64(30), "jwt": lambda: f"{url(27)}.{url(60)}.{url(32)}", "prefixed": lambda: "sk_live_" + draw(32), "letters": lambda: draw(40, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), "HEX": lambda: draw(40, "0123456789ABCDEF")}
    rows = [(f"{k}{i}", f"It was in the house, {make()} they said, é. ") for k, make in kinds.items() for i in range(60)]
    clean = ["q" * 40, "=" * 60, "-" * 25, "0123456789" * 3, "123e4567-e89b-12d3-a456-426614174000", "usr/local/share/applications", "some_long_identifier_in_snake_case", "AbstractSingletonProxyFactory" * 1, "example" + draw(30)]
    rows += [(f"clean{i}", f"See {x} there.") for i, x in enumerate(clean)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    hit = {x.doc_id for x in secrets.scan(df).filter(F.exists("spans", lambda s: s["k"] == 3)).collect()}
    recall = {k: sum(f"{k}{i}" in hit for i in range(60)) / 60 for k in kinds}
    # Letters alone reach their mark of 4.1 bits less often: words of a language must not.
    assert all(x >= (0.7 if k == "letters" else 0.95) for k, x in recall.items()), recall
    assert not [x for x in hit if x.startswith("clean")]


def test_rows_alike_in_all_are_divided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEAST_RANGES", 8)
    rows = [(7, "same text")] * 300 + [(None, "same text")] * 300 + [(i, f"text {i}") for i in range(200)]
    found = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    bytes_of, slots = {}, {}
    for x in found:
        bytes_of[x.shard] = bytes_of.get(x.shard, 0) + x.size
        slots.setdefault(x.shard, []).append(x.slot)
    assert len(found) == 800 and max(bytes_of.values()) - min(bytes_of.values()) <= 2 * 17
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
