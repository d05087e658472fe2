"""Chat formatting into packed prefix trees.

Conversations that begin with the same turns share them: a pack holds a prefix
tree of conversations, whose turns are emitted once, depth-first, as tokens.
Position ids go on from a turn's ancestors, and each turn carries the intervals
of the stream that its ancestors take, which are what it may attend to besides
itself.

A pack groups the conversations of one first turn. Where more than ``PACK``
conversations share a prefix, the tree is divided by depth: each turn that so
many share is a stem, a pack of its own with this one turn, and the subtrees
below the last stem are dealt into packs by their next turn. A pack names the
stems above it, with the intervals of their streams; its positions go on from
theirs. So each shared turn is emitted once, whatever the bound, and no task
holds an unbounded group.

The template marks a turn as ``<|role|>text<|end|>`` and a newline. Inside
roles and texts a backslash, ``<``, ``[`` and ``|`` become two characters each,
so that no text can hold a control string, and back again on reading. Role
mark, text and end are tokenized apart from each other, and the loss mask covers the
texts of the assistant only.

Defined results: rows of a conversation go by turn, then role, then text; a
null text, role or turn counts as empty or first; repeated rows are turns of
their own; conversations with a null id make one conversation; an empty table
gives an empty result; other columns are ignored; a conversation is read as a
whole, so a very long one takes memory in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.batches import slices
from loomstone.session import Scratch, load

#: Conversations that may share a prefix before its turn is a stem.
PACK = 1024
OPEN, CLOSE, END = "<|", "|>", "<|end|>\n"
#: What stands for each character that a control string could begin with.
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "|": "\\p"}
_BACK = {v[1]: k for k, v in ESCAPES.items()}

PACKS = (
    "pack string, stem array<struct<pack:string,start:int,end:int>>, input_ids array<int>, position_ids array<int>, loss_mask array<boolean>, "
    "nodes array<struct<parent:int,start:int,body:int,tail:int,end:int,attends:array<struct<start:int,end:int>>>>, "
    "conversations array<struct<conv_id:bigint,leaf:int>>"
)
_SPAN = [("start", pa.int32()), ("end", pa.int32())]
_PACK_SCHEMA = pa.schema(
    [
        ("pack", pa.string()),
        ("stem", pa.list_(pa.struct([("pack", pa.string()), *_SPAN]))),
        ("input_ids", pa.list_(pa.int32())),
        ("position_ids", pa.list_(pa.int32())),
        ("loss_mask", pa.list_(pa.bool_())),
        ("nodes", pa.list_(pa.struct([("parent", pa.int32()), ("start", pa.int32()), ("body", pa.int32()), ("tail", pa.int32()), ("end", pa.int32()), ("attends", pa.list_(pa.struct(_SPAN)))]))),
        ("conversations", pa.list_(pa.struct([("conv_id", pa.int64()), ("leaf", pa.int32())]))),
    ]
)


def escape(text: str) -> str:
    return re.sub(r"[\\<\[|]", lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_loomstone_chat", {})
    if path not in kept:
        kept[path] = tokenizers.Tokenizer.from_file(path)
        kept[path].encode_special_tokens = True  # special strings of a text stay text
    return kept[path]


def turns(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, its turns as an array of (role, text), and a digest of each of its prefixes."""
    row = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(row))
    own = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.transform(ordered, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    start = F.struct(F.lit("").alias("last"), F.expr("cast(array() as array<string>)").alias("all"))

    def step(state: Column, t: Column) -> Column:
        # A role's length keeps it apart from the text.
        grown = F.sha2(F.concat_ws(" ", state["last"], F.length(t["role"]).cast("string"), F.concat(t["role"], t["text"])), 256)
        return F.struct(grown.alias("last"), F.array_append(state["all"], grown).alias("all"))

    return own.withColumn("prefixes", F.aggregate("turns", start, step, lambda x: x["all"]))


class Encoder:
    """Tokens of role marks, texts and ends; the few marks are encoded once."""

    def __init__(self, path: str):
        self.tokenizer, self.marks = _tokenizer(path), {}

    def mark(self, text: str) -> list[int]:
        if text not in self.marks:
            if len(self.marks) > 4096:
                self.marks.clear()
            self.marks[text] = self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.marks[text]

    def turns(self, own: list[tuple[str, str]]) -> list[tuple[list[int], list[int], list[int]]]:
        bodies = self.tokenizer.encode_batch([escape(text) for _, text in own], add_special_tokens=False)
        return [(self.mark(OPEN + escape(role) + CLOSE), body.ids, self.mark(END)) for (role, _), body in zip(own, bodies)]


def pack_tree(pack: str, rows: list[tuple[int | None, list[tuple[str, str]]]], encoder: Encoder, stem: list[dict] = ()) -> dict:
    """The packed prefix tree of (conv_id, turns) rows, which must be sorted by turns; they go on from ``stem``."""
    nodes: list[dict] = []
    leaves: list[dict] = []
    content: list[tuple[str, str]] = []
    path: list[int] = []  # the nodes that lead to the last one
    for conv_id, own in rows:
        shared = 0
        while shared < min(len(path), len(own)) and content[path[shared]] == own[shared]:
            shared += 1
        del path[shared:]
        for turn in own[shared:]:
            nodes.append({"parent": path[-1] if path else -1})
            path.append(len(content))
            content.append(turn)
        leaves.append({"conv_id": conv_id, "leaf": path[-1] if path else -1})
    before = sum(x["end"] - x["start"] for x in stem)
    ids, positions, loss = [], [], []
    for node, (role, _), parts in zip(nodes, content, encoder.turns(content)):
        above = []
        if node["parent"] >= 0:
            up = nodes[node["parent"]]
            above = list(up["attends"])
            if above and above[-1]["end"] == up["start"]:  # neighbouring intervals are one
                above[-1] = {"start": above[-1]["start"], "end": up["end"]}
            else:
                above.append({"start": up["start"], "end": up["end"]})
        at, start = before + sum(x["end"] - x["start"] for x in above), len(ids)
        for k, part in enumerate(parts):
            ids += part
            loss += [k == 1 and role == "assistant"] * len(part)
        positions += range(at, at + len(ids) - start)
        body = start + len(parts[0])
        node.update(start=start, body=body, tail=body + len(parts[1]), end=len(ids), attends=above)
    return {"pack": pack, "stem": list(stem), "input_ids": ids, "position_ids": positions, "loss_mask": loss, "nodes": nodes, "conversations": leaves}


def _stems(shared: DataFrame, most: int, path: str) -> tuple[DataFrame, DataFrame]:
    """Packs of the turns that more than ``most`` conversations share, and (conv_id, depth, stem): the stems of each conversation.

    ``shared`` has the conversations whose first turn is such a one.
    """
    steps = shared.select("conv_id", F.posexplode("prefixes").alias("k", "prefix"))
    common = steps.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("one")).filter(F.col("n") > most)
    deep = steps.join(common.select("prefix"), "prefix").groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("depth"))
    # One conversation speaks for each stem: its turn, and the prefixes above it.
    speaker = shared.select(F.col("conv_id").alias("one"), "turns", "prefixes")
    found = common.withColumnRenamed("one", "speaker").join(speaker, F.col("speaker").eqNullSafe(F.col("one"))).withColumn("k", F.array_position("prefixes", F.col("prefix")).cast("int"))
    found = found.select("prefix", "k", F.element_at("turns", F.col("k")).alias("turn"), F.slice("prefixes", F.lit(1), F.col("k")).alias("chain"))

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in slices(batches):
            parts = encoder.turns([(t["role"], t["text"]) for t in batch.column("turn").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("prefix"), pa.array([sum(map(len, p)) for p in parts], pa.int32())], ["prefix", "n"])

    sizes = found.select("prefix", "turn").mapInArrow(size, "prefix string, n int")
    above = found.select("prefix", F.posexplode("chain").alias("k", "up")).join(sizes.withColumnRenamed("prefix", "up"), "up")
    link = F.struct(F.concat(F.lit("stem-"), F.col("up")).alias("pack"), F.lit(0).alias("start"), F.col("n").alias("end"))
    chains = above.groupBy("prefix").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", link.alias("link")))), lambda x: x["link"]).alias("stem"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in slices(batches):
            out = [pack_tree("stem-" + r["prefix"], [(None, [(r["turn"]["role"], r["turn"]["text"])])], encoder, r["stem"][:-1]) | {"conversations": []} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema=_PACK_SCHEMA)

    packs = found.select("prefix", "turn").join(chains, "prefix").mapInArrow(build, PACKS)
    deep = deep.withColumnRenamed("conv_id", "other")
    own = shared.join(deep, F.col("conv_id").eqNullSafe(F.col("other"))).select("conv_id", "depth", F.element_at("prefixes", F.col("depth")).alias("last"))
    return packs, own.join(chains.withColumnRenamed("prefix", "last"), "last").join(common.select(F.col("prefix").alias("last"), "n"), "last").select("conv_id", "depth", "last", "stem", "n")


def format_chats(conversations: DataFrame, path: str | None = None, most: int = PACK) -> DataFrame:
    """Packs of conversations, as ``PACKS`` says."""
    path = path or default_path()
    scratch = Scratch(conversations.sparkSession, "chat")
    grouped = scratch.write(turns(conversations), "turns").withColumn("root", F.try_element_at("prefixes", F.lit(1)))
    hot = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("root")
    hot = scratch.write(hot, "hot")
    shared = grouped.join(hot, "root").drop("root")
    plain = grouped.join(hot, "root", "left_anti").select(F.col("root").alias("pack"), "conv_id", "turns", F.expr(_NO_STEM).alias("stem"))

    def build(table: pa.Table) -> pa.Table:
        # What is told of a pack's conversations is the same but for conv_id and turns.
        rows = [(c, [(t["role"], t["text"]) for t in own]) for c, own in zip(table.column("conv_id").to_pylist(), table.column("turns").to_pylist())]
        rows.sort(key=lambda x: (x[1], x[0] is not None, x[0] or 0))
        made = pack_tree(table.column("pack")[0].as_py(), rows, Encoder(path), table.column("stem")[0].as_py())
        return pa.Table.from_pylist([made], schema=_PACK_SCHEMA)

    packs = plain.groupBy("pack").applyInArrow(build, PACKS)
    if hot.isEmpty():
        return packs
    stems, own = _stems(shared, most, path)
    own = scratch.write(own, "own")
    below = shared.join(own.withColumnRenamed("conv_id", "other"), F.col("conv_id").eqNullSafe(F.col("other")))
    # Subtrees of a stem go by their next turn, each as a whole; conversations that end with the stem by their ids.
    after = F.coalesce(F.try_element_at("prefixes", F.col("depth") + 1), F.col("conv_id").cast("string"), F.lit(""))
    part = F.pmod(F.xxhash64(after), F.ceil(F.col("n") * 2 / most))
    rest = F.when(F.size("turns") > F.col("depth"), F.slice("turns", F.col("depth") + 1, F.size("turns"))).otherwise(F.slice("turns", 1, 0))
    below = below.select(F.concat_ws("-", "last", part.cast("string")).alias("pack"), "conv_id", rest.alias("turns"), "stem")
    return packs.unionByName(below.groupBy("pack").applyInArrow(build, PACKS)).unionByName(stems)


_NO_STEM = "cast(array() as array<struct<pack:string,start:int,end:int>>)"
_READ = pa.schema([("conv_id", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("loss_texts", pa.list_(pa.string())), ("formatted_chars", pa.int64())])


def read_back(packs: DataFrame, path: str | None = None) -> DataFrame:
    """Conversations decoded from packs: conv_id, roles, texts, loss_texts and formatted_chars.

    A conversation is the stems above its pack, its leaf's ancestors, as their
    links give them, and the leaf; each is decoded from its own stretch of its
    stream.
    """
    path = path or default_path()
    # A stem's stream is one turn; the packs that name it get it by a join.
    up = packs.filter(F.size("conversations") > 0).select("pack", F.posexplode("stem").alias("k", "s")).select(F.col("pack").alias("of"), "k", F.col("s.pack").alias("pack"))
    node = F.element_at("nodes", 1)
    turn = F.struct("k", F.col("input_ids").alias("ids"), node["body"].alias("body"), node["tail"].alias("tail"), F.element_at("loss_mask", node["body"] + 1).alias("learned"))
    above = up.join(packs.filter(F.size("conversations") == 0).select("pack", "input_ids", "loss_mask", "nodes"), "pack").groupBy(F.col("of").alias("pack")).agg(F.array_sort(F.collect_list(turn)).alias("above"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, marks = _tokenizer(path), {}

        def mark(ids: tuple[int, ...]) -> str:
            if ids not in marks:
                if len(marks) > 4096:
                    marks.clear()
                marks[ids] = tokenizer.decode(list(ids), skip_special_tokens=False)
            return marks[ids]

        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in ("nodes", "conversations", "above", "input_ids", "loss_mask")}
                turns = [(x["ids"], 0, x["body"], x["tail"], len(x["ids"]), bool(x["learned"]) and x["body"] < x["tail"]) for x in r["above"] or ()]
                first = len(turns)
                turns += [(r["input_ids"], n["start"], n["body"], n["tail"], n["end"], n["body"] < n["tail"] and all(r["loss_mask"][n["body"] : n["tail"]])) for n in r["nodes"]]
                bodies = tokenizer.decode_batch([ids[body:tail] for ids, _, body, tail, _, _ in turns], skip_special_tokens=False)
                parts = [(mark(tuple(ids[a:body])), text, mark(tuple(ids[tail:b])), learned) for (ids, a, body, tail, b, learned), text in zip(turns, bodies)]
                out = []
                for c in r["conversations"]:
                    chain, at = [], c["leaf"]
                    while at >= 0:
                        chain.append(first + at)
                        at = r["nodes"][at]["parent"]
                    own = [parts[i] for i in [*range(first), *reversed(chain)]]
                    texts = [unescape(p[1]) for p in own]
                    learned = [t for t, p in zip(texts, own) if p[3]]
                    out.append((c["conv_id"], [unescape(p[0][len(OPEN) : -len(CLOSE)]) for p in own], texts, learned, sum(len(p[0]) + len(p[1]) + len(p[2]) for p in own)))
                for i in range(0, len(out), 512):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out[i : i + 512]), _READ)], schema=_READ)

    with_stems = packs.filter(F.size("conversations") > 0).join(above, "pack", "left")
    return with_stems.select("nodes", "conversations", "above", "input_ids", "loss_mask").mapInArrow(read, "conv_id long, roles array<string>, texts array<string>, loss_texts array<string>, formatted_chars long")


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    """Contract query: what each conversation reads as in the packed output."""
    tricky = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    # Packs are written once: reading them back takes the stems and the rest.
    back = read_back(Scratch(spark, "chats").write(format_chats(rows), "packs"))
    turn = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n")))
    learned = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("roles").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turn, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
     f AS (SELECT *, length(replace(replace(replace(replace(role || text, '\\', '\\\\'), '<', '\\l'), '[', '\\b'), '|', '\\p')) + 12 AS n FROM c),
     g AS (SELECT conv_id, count(*) AS n_turns,
                  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
                  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS l,
                  sum(n) AS formatted_chars
           FROM f GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(t) AS turns_sha256, CAST(length(l) AS BIGINT) AS loss_chars,
       sha256(l) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""
