"""Conversation structure repair: the cheapest edits that bring a conversation into the grammar ``(s?(ua)+)?``.

A forward Viterbi pass over four states (nothing yet, system, user, assistant)
carries the least (cost, audit string) of each; after each turn the layer is
closed with insertions, of which two in a row are the most that can help. Two
audits of equal cost in one state are never such that one begins the other, so
the least of a prefix stays least whatever follows.

Rows are dealt by ranges of (conversation, turn, role, digest of the text) and
sorted. A conversation that lies within one range and has PIECE rows at most is
repaired on the spot. Others, those at the edges of ranges and long ones, are
cut into pieces of PIECE rows: each gives the cheapest edits from every state
to every state, these tables are combined in order, and a second pass walks
the sorted rows beside the audit. So no task holds a conversation's rows,
however many it has; its audit, which is one value of the result, it holds, and
a digest over one conversation is made in one task, row by row.

Defined results: nulls in role or text count as one blank; rows without a turn
come first; rows of one turn are ordered by role, then by the text's SHA-256; a
null conversation id is a conversation of its own; repeated rows are duplicates;
a conversation without rows needs no edit; an empty table gives an empty result;
other columns are ignored; gaps beyond 64 bits are the largest 64-bit integer;
a very long text is held whole while its row is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm import sql
from loomstone.llm.batches import slices
from loomstone.session import Scratch, load

RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a piece.
PIECE = 4096
#: Bytes of text of a conversation that is held whole; a larger one goes by pieces.
HELD = 8 << 20
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: States that a role's initial may follow, and the state it leads to.
AFTER = {"s": ((EMPTY,), SYSTEM), "u": ((EMPTY, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
LEGAL = {"su", "ua", "au"}
SPACES = " \t\n\x0b\x0c\r"

Layer = list[tuple[int, str] | None]
ROW = "conv long, pid int, idx long, turn long, role string, text string, digest string, live boolean"
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _least(a: tuple[int, str] | None, b: tuple[int, str]) -> tuple[int, str]:
    return b if a is None or b < a else a


def closed(layer: Layer) -> Layer:
    """The layer with insertions: two rounds, as no more than two insertions in a row can be cheapest."""
    for _ in range(2):
        grown = list(layer)
        for before, to in (AFTER["u"], AFTER["a"]):
            for s in before:
                if layer[s] is not None:
                    grown[to] = _least(grown[to], (layer[s][0] + INSERT, layer[s][1] + "I"))
        layer = grown
    return layer


def step(layer: Layer, initial: str, faulty: bool, truncated: bool) -> Layer:
    """The layer after one more row; a faulty row must be deleted."""
    grown: Layer = [x and (x[0] + DELETE, x[1] + "D") for x in layer]
    if not faulty:
        extra = TRUNCATED if truncated else 0
        for edit, cost, moves in (("K", extra, [AFTER[initial]] if initial in AFTER else []), ("R", extra + RETYPE, [AFTER["u"], AFTER["a"]])):
            for before, to in moves:
                for s in before:
                    if layer[s] is not None:
                        grown[to] = _least(grown[to], (layer[s][0] + cost, layer[s][1] + edit))
    return closed(grown)


def start() -> Layer:
    return closed([(0, ""), None, None, None])


def accepted(layer: Layer) -> tuple[int, str]:
    return min(x for x in (layer[EMPTY], layer[ASSISTANT]) if x is not None)


class Facts:
    """Counts over rows in order, which add up over pieces."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first = self.last = None

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        self.then([0, 0, 0, 0, int(turn is not None), turn, turn, initial, initial])

    def values(self) -> list:
        return [self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.first_turn, self.last_turn, self.first, self.last]

    def then(self, later: list) -> None:
        """Add the values of the rows that follow."""
        blank, duplicate, truncated, illegal, turns, first_turn, last_turn, first, last = later
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.illegal += illegal + (self.last is not None and first is not None and self.last + first not in LEGAL)
        self.turns += turns - (first_turn is not None and first_turn == self.last_turn)
        self.first_turn, self.last_turn = first_turn if self.first_turn is None else self.first_turn, self.last_turn if last_turn is None else last_turn
        self.first, self.last = first if self.first is None else self.first, self.last if last is None else last

    def report(self, cost: int, audit: str) -> list:
        gaps = 0 if self.first_turn is None else min(self.last_turn - self.first_turn + 1 - self.turns, (1 << 63) - 1)
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit]


def fault(role: str, text: str, again: bool) -> str:
    """The first fault of a row, or nothing; ``again``: role and text stood in the conversation before."""
    body = text.rstrip(SPACES)
    return "blank" if not body else "duplicate" if again else "" if body[-1] in ".!?" else "truncated"


class Walk:
    """The repaired rows of a conversation, as its rows come in order beside its audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, ""

    def _role(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def _out(self, edit: str, role: str, text: str) -> tuple[str, str, str]:
        self.at, self.last = self.at + 1, role[:1]
        return edit, role, text

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self._out("I", self._role(), "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        if edit == "D":
            self.at += 1
        else:
            yield self._out(edit, self._role() if edit == "R" else role, text)


class Digest:
    """SHA-256 of ``role:text`` lines."""

    def __init__(self) -> None:
        self.hash, self.any = hashlib.sha256(), False

    def add(self, rows: Iterator[tuple[str, str, str]]) -> None:
        for _, role, text in rows:
            self.hash.update((("\n" if self.any else "") + role + ":").encode())
            self.hash.update(text.encode())
            self.any = True


class Out:
    """Rows of a fixed schema, in batches of bounded rows and bytes."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, **row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += len(row.get("text") or "") + len(row.get("audit") or "")
        if len(self.rows) >= 4096 or self.bytes > 1 << 20:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        batch, self.rows, self.bytes = pa.RecordBatch.from_pylist(self.rows, schema=self.schema), [], 0
        return batch


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


FIRST = f"{ROW}, kind string, edit string, {REPORT}, sha string"
PIECES = "conv long, pid int, piece long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first string, last string, costs array<long>, audits array<string>"


def _first_pass(rows_wanted: bool):
    """Over sorted rows: whole conversations repaired, rows of all others handed on."""
    names = [c.split()[0] for c in REPORT.split(", ")]

    def whole(conv, held: list, out: Out) -> Iterator[pa.RecordBatch]:
        seen, facts, layer = set(), Facts(), start()
        for turn, role, text in held:
            why = fault(role, text, (role, text) in seen)
            seen.add((role, text))
            facts.add(turn, role[:1], why)
            layer = step(layer, role[:1], why in ("blank", "duplicate"), why == "truncated")
        cost, audit = accepted(layer)
        walk, digest, place = Walk(audit), Digest(), 0
        for made in (*(walk.row(role, text) for _, role, text in held), walk.inserted()):
            if not rows_wanted:
                digest.add(made)
                continue
            for edit, role, text in made:
                yield from out.add(conv=conv, idx=place, role=role, text=text, kind="done", edit=edit)
                place += 1
        if not rows_wanted:
            yield from out.add(conv=conv, kind="done", sha=digest.hash.hexdigest(), **dict(zip(names, facts.report(cost, audit), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, out = TaskContext.get().partitionId(), Out(_schema(FIRST))
        # ``held`` has the rows of the conversation at hand; None once they are handed on as they come.
        conv, held, size, idx, begun = None, None, 0, 0, False

        def hand_on(rows: list) -> Iterator[pa.RecordBatch]:
            nonlocal idx
            for turn, role, text, digest, copies in rows:
                for _ in range(max(copies, 1)):
                    yield from out.add(conv=conv, pid=pid, idx=idx, turn=turn, role=role, text=text if copies else "", digest=digest, live=copies > 0, kind="edge")
                    idx += 1

        for batch in slices(batches, "text"):
            for c, *row in zip(*(batch.column(x).to_pylist() for x in ("conv", "turn", "role", "text", "digest", "copies")), strict=True):
                if not begun or c != conv:
                    if begun and held is not None:
                        yield from whole(conv, [r[:3] for r in held for _ in range(r[4])], out)
                    # The first of a range may have begun in the range before.
                    conv, held, size, idx, begun = c, [] if begun else None, 0, 0, True
                if held is not None:
                    held.append(row)
                    size += len(row[2])
                    if len(held) >= PIECE or size > HELD:
                        yield from hand_on(held)
                        held = None
                else:
                    yield from hand_on([row])
        if held:
            yield from hand_on(held)  # and the last may go on in the next
        yield out.flush()

    return run


def _piece(table: pa.Table) -> pa.Table:
    """One row for the rows of a piece: facts, and the cheapest edits from each state (4 by 4, state by state)."""
    table = table.sort_by("idx")
    facts, layers = Facts(), [[(0, "") if s == t else None for t in range(4)] for s in range(4)]
    for turn, initial, why in zip(*(table.column(c).to_pylist() for c in ("turn", "initial", "why")), strict=True):
        facts.add(turn, initial, why)
        layers = [step(x, initial, why in ("blank", "duplicate"), why == "truncated") for x in layers]
    cells = [x for layer in layers for x in layer]
    key = [table.column(c)[0].as_py() for c in ("conv", "pid", "piece")]
    values = [*key, *facts.values(), [x and x[0] for x in cells], [x and x[1] for x in cells]]
    schema = _schema(PIECES)
    return pa.Table.from_pylist([dict(zip(schema.names, values, strict=True))], schema=schema)


def _unrolled(chain: tuple | None) -> list[str]:
    out = []
    while chain:
        out.append(chain[1])
        chain = chain[0]
    return out[::-1]


def _chain_before(a: tuple | None, b: tuple | None) -> bool:
    """Whether the audit of one chain of parts comes before that of another; they have as many parts."""
    x, y = _unrolled(a), _unrolled(b)
    k = next((i for i in range(len(x)) if x[i] is not y[i] and x[i] != y[i]), len(x))
    return "".join(x[k:]) < "".join(y[k:])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to one report a conversation; the parts of audits are chained, not copied."""
    names, out = [c.split()[0] for c in REPORT.split(", ")], Out(_schema(f"conv long, {REPORT}"))
    conv, facts, paths = None, None, None

    def done() -> Iterator[pa.RecordBatch]:
        best = None
        for s in (EMPTY, ASSISTANT):
            if paths[s] and (best is None or paths[s][0] < best[0] or paths[s][0] == best[0] and _chain_before(paths[s][1], best[1])):
                best = paths[s]
        yield from out.add(conv=conv, **dict(zip(names, facts.report(best[0], "".join(_unrolled(best[1]))), strict=True)))

    for batch in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
        for row in batch.to_pylist():
            if facts is None or row["conv"] != conv:
                if facts is not None:
                    yield from done()
                conv, facts, paths = row["conv"], Facts(), [x and (x[0], (None, x[1])) for x in start()]
            facts.then([row[c] for c in ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first", "last")])
            grown: list = [None] * 4
            for s in range(4):
                for t in range(4):
                    if paths[s] and row["costs"][4 * s + t] is not None:
                        made = paths[s][0] + row["costs"][4 * s + t], (paths[s][1], row["audits"][4 * s + t])
                        if grown[t] is None or made[0] < grown[t][0] or made[0] == grown[t][0] and _chain_before(made[1], grown[t][1]):
                            grown[t] = made
            paths = grown
    if facts is not None:
        yield from done()
    yield out.flush()


def _second_pass(rows_wanted: bool):
    """Over the rows of each conversation, its report before them: repaired rows, or the report with a digest."""
    names = [c.split()[0] for c in REPORT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(_schema(FIRST))
        report, walk, digest, place = None, None, None, 0

        def put(made: Iterator) -> Iterator[pa.RecordBatch]:
            nonlocal place
            if not rows_wanted:
                digest.add(made)
                return
            for edit, role, text in made:
                yield from out.add(conv=report["conv"], idx=place, role=role, text=text, kind="done", edit=edit)
                place += 1

        def done() -> Iterator[pa.RecordBatch]:
            yield from put(walk.inserted())
            if not rows_wanted:
                yield from out.add(conv=report["conv"], kind="done", sha=digest.hash.hexdigest(), **{n: report[n] for n in names})

        for batch in slices(batches, "text"):
            for row in batch.to_pylist():
                if row["audit"] is not None:
                    if report is not None:
                        yield from done()
                    report, walk, digest, place = row, Walk(row["audit"]), Digest(), 0
                elif row["live"]:
                    yield from put(walk.row(row["role"], row["text"]))
        if report is not None:
            yield from done()
        yield out.flush()

    return run


def _repaired(df: DataFrame, copies: Column, rows_wanted: bool) -> DataFrame:
    """The rows of kind ``done`` of both passes; ``df`` has conv_id, turn, role and text, and each row stands ``copies`` times."""
    scratch = Scratch(df.sparkSession, "structure")
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = df.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), copies.cast("int").alias("copies"))
    # Rows alike in all else are told apart by their place, so that a range can end between them.
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("place", F.monotonically_increasing_id())
    order = [F.asc_nulls_first(c) for c in ("conv", "turn", "role", "digest", "place")]
    first = scratch.write(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_first_pass(rows_wanted), FIRST), "first")

    edge = first.filter("kind = 'edge'").select(*[c.split()[0] for c in ROW.split(", ")])
    body = F.rtrim("text", F.lit(SPACES))
    live = edge.filter("live").withColumn("is_blank", body == "").withColumn("ended", F.right(body, F.lit(1)).isin(".", "!", "?"))
    place = F.struct("pid", "idx")
    seen = live.filter("not is_blank").groupBy("conv", "role", "digest").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    seen = seen.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "earliest")
    facts = live.select("conv", "pid", "idx", "turn", "role", "digest", "is_blank", "ended")
    facts = facts.join(seen, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    why = F.when(F.col("is_blank"), "blank").when(F.col("earliest") != place, "duplicate").when(~F.col("ended"), "truncated").otherwise("")
    facts = facts.select("conv", "pid", F.floor(F.col("idx") / PIECE).alias("piece"), "idx", "turn", F.substring("role", 1, 1).alias("initial"), why.alias("why"))
    pieces = facts.groupBy("conv", "pid", "piece").applyInArrow(_piece, PIECES)
    # Conversations of which every row was dropped.
    none = F.array(*[F.when(F.lit(s == t), F.lit(0)).cast("long") for s in range(4) for t in range(4)])
    zero = {c: F.lit(0).cast("long") for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    kinds = {c.split()[0]: c.split()[1] for c in PIECES.split(", ")}
    empty = edge.select("conv").distinct().select("conv", F.lit(-1).alias("pid"), F.lit(-1).cast("long").alias("piece"), *[zero.get(c, F.lit(None).cast(kinds[c])).alias(c) for c in list(kinds)[3:-2]], none.alias("costs"), F.transform(none, lambda x: F.when(x.isNotNull(), F.lit(""))).alias("audits"))
    reports = pieces.unionByName(empty).repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "pid", "piece").mapInArrow(_combine, f"conv long, {REPORT}")
    heads = reports.select("conv", F.lit(-1).alias("pid"), F.lit(-1).cast("long").alias("idx"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("live"), *[c.split()[0] for c in REPORT.split(", ")])
    bodies = edge.select("conv", "pid", "idx", "role", "text", "live", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in REPORT.split(", ")])
    walked = heads.unionByName(bodies).repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "pid", "idx").mapInArrow(_second_pass(rows_wanted), FIRST)
    return first.filter("kind = 'done'").unionByName(walked)


def repaired(df: DataFrame, copies: Column | None = None) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows of every conversation after its cheapest edits, places from 0."""
    out = _repaired(df, F.lit(1) if copies is None else copies, True)
    return out.select(F.col("conv").alias("conv_id"), F.col("idx").alias("place"), "edit", "role", "text")


def report(df: DataFrame, copies: Column | None = None) -> DataFrame:
    """A row for each conversation: its faults, the cost and audit of its cheapest edits, and the digest of the repaired rows."""
    out = _repaired(df, F.lit(1) if copies is None else copies, False)
    return out.select(F.col("conv").alias("conv_id"), *[c.split()[0] for c in REPORT.split(", ")], F.col("sha").alias("repaired_sha256"))


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations damaged by the checksum of ``conv_id:turn``, and how often each row stands."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    out = rows.select("conv_id", "turn", "role", "text", kind.alias("kind"))
    out = out.withColumn("text", text).withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(blank("role")))
    return out, F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)


def op11_structure_repair(spark, sf_dir: str) -> DataFrame:
    """Contract query: all conversations damaged, with their faults and cheapest repair."""
    return report(*damaged(load(spark, sf_dir, "conversations")))


def _sql() -> str:
    """DuckDB SQL of the query: the layer is a list of four strings, cost (12 digits) and audit, folded over a conversation's rows."""

    def let(value: str, body: str) -> str:
        return f"list_transform([{value}], lambda x: {body})[1]"

    def more(state: int, cost: str, edit: str, of: str = "x") -> str:
        x = f"{of}[{state + 1}]"
        return f"(lpad(CAST(CAST({x}[:12] AS BIGINT) + {cost} AS VARCHAR), 12, '0') || {x}[13:] || '{edit}')"

    def grown(to: int) -> str:
        insert = [more(s, str(INSERT), "I") for before, t in (AFTER["u"], AFTER["a"]) if t == to for s in before]
        return f"list_min([{', '.join([f'x[{to + 1}]', *insert])}])"

    def moved(to: int) -> str:
        kept = [f"CASE WHEN NOT r.faulty AND r.initial = '{i}' THEN {more(s, 'r.extra', 'K', 'l')} END" for i, (before, t) in AFTER.items() if t == to for s in before]
        roled = [f"CASE WHEN NOT r.faulty THEN {more(s, f'r.extra + {RETYPE}', 'R', 'l')} END" for i, (before, t) in AFTER.items() if t == to and i != "s" for s in before]
        return f"list_min([{', '.join([more(to, str(DELETE), 'D', 'l'), *kept, *roled])}])"

    once = f"[{', '.join(grown(t) for t in range(4))}]"
    close = lambda layer: let(let(layer, once), once)
    zero = f"['{'0' * 12}', NULL, NULL, NULL]::VARCHAR[]"
    layer = f"list_reduce(rows, lambda l, r: {{'faulty': false, 'initial': '', 'extra': 0, 'role': '', 'text': '', 'layer': {close(f'[{", ".join(moved(t) for t in range(4))}]').replace('l[', 'l.layer[')}}}, {{'faulty': false, 'initial': '', 'extra': 0, 'role': '', 'text': '', 'layer': {close(zero)}}})"
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    crc = sql.crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    next_role = "CASE WHEN w.last = 'u' THEN 'assistant' ELSE 'user' END"
    row = "rows[w.at + 1]"
    # Over the edits: the row at hand, the last initial, and the repaired text so far.
    walked = f"""list_reduce(list_transform(list_filter(string_split(audit, ''), lambda e: e <> ''), lambda e: {{'edit': e, 'at': 0, 'last': '', 'made': NULL::VARCHAR}}), lambda w, e: {{'edit': '', 'at': w.at + CASE WHEN e.edit = 'I' THEN 0 ELSE 1 END,
      'last': CASE e.edit WHEN 'D' THEN w.last WHEN 'K' THEN {row}.initial ELSE left({next_role}, 1) END,
      'made': CASE e.edit WHEN 'D' THEN w.made ELSE concat(w.made || chr(10), CASE e.edit WHEN 'K' THEN {row}.role ELSE {next_role} END, ':', CASE e.edit WHEN 'I' THEN '' ELSE {row}.text END) END}}, {{'edit': '', 'at': 0, 'last': '', 'made': NULL::VARCHAR}})"""
    return f"""
WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations),
     d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
     n AS (SELECT *, rtrim(text, {spaces}) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM d),
     f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
     c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
                  list({{'faulty': fault IN ('blank', 'duplicate'), 'initial': left(role, 1), 'extra': CASE fault WHEN 'truncated' THEN {TRUNCATED} ELSE 0 END, 'role': role, 'text': text, 'layer': NULL::VARCHAR[]}} ORDER BY i) AS rows FROM f GROUP BY conv_id),
     l AS (SELECT *, {layer}.layer AS layer FROM c),
     a AS (SELECT *, CAST(list_min([layer[1], layer[4]])[:12] AS BIGINT) AS cost, list_min([layer[1], layer[4]])[13:] AS audit FROM l),
     w AS (SELECT *, sha256(coalesce({walked}.made, '')) AS repaired_sha256 FROM a),
     o AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       coalesce(repaired_sha256, sha256('')) AS repaired_sha256 FROM o LEFT JOIN w ON o.conv_id IS NOT DISTINCT FROM w.conv_id"""


ORACLE = _sql()
