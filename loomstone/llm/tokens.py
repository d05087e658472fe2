"""Token counts by a map-side two-tier lookup of pre-token lengths.

Tier one is a broadcast table of the token counts of frequent pre-tokens, found
in a sample of about ``SAMPLE`` rows; no pre-token is shuffled. Tier two is a
bounded cache in each Python worker, kept from task to task, which encodes what
the table misses. Both tiers only save work; every count is the library's, and
covers the whole text.

The split into pre-tokens is done by a compiled pattern. A character on whose
class that pattern and the library disagree (their Unicode versions may
differ) sends its whole text to the library, as do added tokens that strip or
that want word borders.

Defined results: a null text counts as empty, with no tokens; repeated rows
each give a row; other columns are kept, but for one named ``n_tokens``, which
the count replaces; an empty table gives an empty result; a very long text
costs in proportion to its length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.batches import slices, without
from loomstone.session import load

#: Entries of the broadcast table, and rows of the sample that it is drawn from (as expected; each row has the same chance).
FREQUENT, SAMPLE = 16_384, 8_192
#: Different pre-tokens that are counted at a time; beyond, the rarer half goes.
COUNTED = 1 << 17
#: Entries that a worker's cache holds before it starts afresh.
CACHE = 400_000
#: Longer texts are split into pre-tokens one at a time.
WHOLE = 1 << 22


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Counts(dict):
    """Pre-token to number of tokens; encodes what it doesn't have."""

    def __init__(self, tokenizer, frequent: dict[str, int]):
        super().__init__(frequent)
        self.tokenizer, self.frequent = tokenizer, frequent

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        n = self[piece] = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        return n


class Splitter:
    """Texts into pre-tokens, as the library's byte-level rule does."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.plain = [a.content for a in added if not (a.lstrip or a.rstrip or a.single_word)]
        self.others = [a.content for a in added if a.lstrip or a.rstrip or a.single_word]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.plain, key=len, reverse=True)))) if self.plain else None
        self.known: set[str] = set()
        self.odd: set[str] = set()

    def agrees(self, text: str) -> bool:
        """True if pattern and library agree on the class of every character."""
        fresh = set(text) - self.known
        for c in fresh:
            probe = f"a{c}1{c}.{c} {c}{c}a"
            theirs = [probe[s:e] for _, (s, e) in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
            if theirs != self.pattern.findall(probe):
                self.odd.add(c)
        self.known |= fresh
        return not self.odd or self.odd.isdisjoint(text)

    def parts(self, text: str) -> tuple[list[str], int] | None:
        """The stretches between added tokens, and the number of these; None if the library must do it."""
        if any(x in text for x in self.others) or not self.agrees(text):
            return None
        if self.cut is None or not any(x in text for x in self.plain):
            return [text], 0
        stretches = self.cut.split(text)
        return stretches, len(stretches) - 1

    def pieces(self, text: str):
        return self.pattern.findall(text) if len(text) <= WHOLE else (m.group() for m in self.pattern.finditer(text))


def _worker(path: str) -> dict:
    """What this worker process keeps between tasks."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_loomstone", {})
    if path not in kept:
        kept[path] = {"splitter": Splitter(path)}
    return kept[path]


def _top(counts: Counter, most: int) -> Counter:
    return Counter(dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]))


def frequent_pieces(df: DataFrame, path: str, text_col: str = "text", most: int = FREQUENT, sample: int = SAMPLE) -> list[str]:
    """The most frequent pre-tokens of about ``sample`` rows, counted in one task: one list, however many partitions ``df`` has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _worker(path)["splitter"]
        counts: Counter = Counter()
        for batch in slices(batches, "t"):
            for text in batch.column(0).to_pylist():
                counts.update(splitter.pieces(text))
                if len(counts) > COUNTED:
                    counts = _top(counts, COUNTED // 2)
        yield pa.RecordBatch.from_arrays([pa.array(list(_top(counts, most)), pa.string())], ["piece"])

    texts = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    share = min(1.0, sample / max(df.count(), 1))
    if share < 1:
        texts = texts.sample(share, seed=1)
    return [r["piece"] for r in texts.repartition(1).mapInArrow(count, "piece string").collect()]


def count_tokens(df: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``: the library's count for each whole text."""
    path = path or default_path()
    pieces = frequent_pieces(df, path, text_col)
    splitter = Splitter(path)
    table = df.sparkSession.sparkContext.broadcast({p: len(e.ids) for p, e in zip(pieces, splitter.tokenizer.encode_batch(pieces, add_special_tokens=False))})
    others = without([c for c in df.columns if c != text_col], ["n_tokens"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _worker(path)
        splitter = own["splitter"]
        if own.get("table") is not table.value:
            own["table"], own["counts"] = table.value, Counts(splitter.tokenizer, table.value)
        lookup = own["counts"].__getitem__
        for batch in slices(batches, text_col):
            found = []
            for text in batch.column(text_col).to_pylist():
                cut = splitter.parts(text) if text else ([], 0)
                if cut is None:
                    found.append(len(splitter.tokenizer.encode(text, add_special_tokens=False).ids))
                else:
                    found.append(cut[1] + sum(sum(map(lookup, splitter.pieces(s))) for s in cut[0]))
            kept = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.int64())], [*others, "n_tokens"])

    schema = df.select(*others).schema.add("n_tokens", "long")
    return df.mapInArrow(count, schema)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """Contract query: bytes and tokens of each document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return count_tokens(docs).withColumn("over_limit", F.col("n_tokens") > 1024)
