"""Quality rules: statistics of each text, and a decision list learned from labels.

Native: SQL functions only. The statistics are expressions over the text's
words; the list is a chain of ``CASE`` conditions over them. Learning collects
the statistics of a bounded sample of labelled rows and grows rules by
sequential covering: a rule gains threshold tests while they raise FOIL's gain
on two thirds of the rows, loses them again while that helps on the rest, and
is kept if it is precise there and on all rows, with a bound of the chance that
it is not; its rows then leave the sample. A rule that is not kept bars the test
it grew from, and the search goes on with the others.

Defined results: a null text has no words; repeated rows each give a row;
without labelled rows the list is empty and only the base rules speak; a label
row without an id, a quality or a verdict on toxicity takes no part; a document
labelled twice counts with its worse label; of equal bounds the first feature's
is taken; other columns are kept, but for those with the name of a statistic,
which it replaces; an empty table gives an empty result; a very long text costs
in proportion to its length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.batches import fresh
from loomstone.llm.text import let, windows, words
from loomstone.session import load

REPEAT = 8
#: The bound of the labelled sample: rows with the smallest hashes of their id.
MAX_TRAIN_ROWS = 20_000
#: Terms of the learned list of terms that mark toxic rows, at most: those with most hits.
MAX_TERMS = 256
#: A term is learned if, of so many terms that mark nothing, none would have its hits with a chance of 0.95.
TERMS_TESTED = 100_000
#: A rule's precision is at least BOUND with a confidence of 95 % (Wilson's bound, one-sided).
BOUND, CONFIDENCE = 0.75, 1.645
FEATURES = ["n_words", "mean_chars", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "n_terms", "mark_share"]


def repeated_words(items: Column) -> Column:
    """Words that lie in a window of eight words found twice or more.

    Only a text that holds a 64-bit window hash twice pays for sorting them:
    equal neighbours in the sorted list give the starts that may repeat, the
    same on their words those that do, and the gaps between these the words
    covered.
    """

    def covered(hashes: Column) -> Column:
        def equal(ranked: Column) -> Column:
            """Starts (field i) of entries whose field h a neighbour shares."""
            same = lambda i, j: F.try_element_at(ranked, j)["h"].eqNullSafe(F.element_at(ranked, i)["h"])
            hit = F.filter(F.sequence(F.lit(1), F.size(ranked)), lambda i: same(i, i + 1) | ((i > 1) & same(i, F.greatest(i - 1, F.lit(1)))))
            return F.transform(F.filter(hit, lambda i: F.size(ranked) > 0), lambda i: F.element_at(ranked, i)["i"])

        def starts(ranked: Column) -> Column:
            spelled = F.transform(equal(ranked), lambda i: F.struct(F.array_join(F.slice(items, i + 1, F.lit(REPEAT)), " ").alias("h"), i.alias("i")))
            return F.sort_array(let(F.sort_array(spelled), equal))

        def total(at: Column) -> Column:
            gap = lambda i: F.least(F.element_at(at, i + 1) - F.element_at(at, i), F.lit(REPEAT))
            inner = F.when(F.size(at) > 1, F.aggregate(F.sequence(F.lit(1), F.size(at) - 1), F.lit(0), lambda s, i: s + gap(i))).otherwise(F.lit(0))
            return F.when(F.size(at) > 0, inner + REPEAT).otherwise(F.lit(0))

        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        sparse = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(sparse, F.lit(0)).otherwise(let(let(ranked, starts), total))

    return let(windows(items, REPEAT, lambda w: F.xxhash64(w)), covered)


def statistics(df: DataFrame, terms: list[str] = ()) -> DataFrame:
    """``df`` with the base statistics and the features of the decision list."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = let(F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != ""), lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    own, all_lines = fresh(df.columns, "_words"), fresh(df.columns, "_lines")
    plain = F.array_distinct(F.transform(F.col(own), lambda w: F.lower(F.btrim(w, F.lit(MARKS)))))
    n = F.greatest(F.size(own), F.lit(1))
    out = df.withColumn(own, words(text)).withColumn(all_lines, lines)
    out = out.withColumns(
        {
            "n_words": F.size(own).cast("long"),
            "word_chars": F.length(F.array_join(own, "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": F.col(f"{all_lines}.dup").cast("long"),
            "n_repeat_words": repeated_words(F.col(own)).cast("long"),
            "distinct_share": F.size(F.array_distinct(own)) / n,
            "n_terms": (F.size(F.array_intersect(plain, F.array(*map(F.lit, terms)))) if terms else F.lit(0)).cast("double"),
        }
    )
    return out.withColumns(
        {
            "mean_chars": F.col("word_chars") / n,
            "symbol_share": F.col("n_symbols") / n,
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col(f"{all_lines}.all"), F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / n,
            "mark_share": F.regexp_count(text, F.lit(r"[.,;:!?]")) / n,
        }
    ).drop(own, all_lines)


#: Marks that may stand around a word.
MARKS = ".,;:!?()[]{}\"'#*$%&|<>"


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    """One threshold test: ``feature >= bound`` or ``feature <= bound``."""

    feature: str
    above: bool
    bound: float

    def column(self) -> Column:
        x = F.col(self.feature).cast("double")
        return x >= F.lit(self.bound) if self.above else x <= F.lit(self.bound)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.bound:g}"


def _cuts(values: list[float], most: int = 48) -> list[float]:
    """Bounds between distinct values, at quantiles of their ranks."""
    ranked = sorted(set(values))
    middle = [(a + b) / 2 for a, b in zip(ranked, ranked[1:])]
    return middle if len(middle) <= most else [middle[i * (len(middle) - 1) // (most - 1)] for i in range(most)]


def least_share(hits: int, n: int, z: float = CONFIDENCE) -> float:
    """Wilson's lower bound of a share of which ``hits`` of ``n`` were seen."""
    if not n:
        return 0.0
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def learn_list(rows: list[tuple[list[float], bool]], precision: float = 0.95, most_rules: int = 12, most_tests: int = 4, support: int = 5, held: list[bool] | None = None) -> list[list[Test]]:
    """Sequential covering over (features, is bad) rows: conjunctions, most precise first found.

    ``held`` marks the rows that only prune; without it every third does.
    Sets of rows are bit sets, so a candidate test costs two ``and``s.
    """
    if not rows:
        return []
    bad = sum(1 << i for i, (_, b) in enumerate(rows) if b)
    prune = sum(1 << i for i in range(len(rows)) if (held[i] if held else i % 3 == 0))
    tests: list[tuple[Test, int]] = []
    for f, name in enumerate(FEATURES):
        ranked = sorted(range(len(rows)), key=lambda i: rows[i][0][f])
        cuts, at, below = _cuts([r[0][f] for r in rows]), 0, 0
        everything = (1 << len(rows)) - 1
        for cut in cuts:
            while at < len(ranked) and rows[ranked[at]][0][f] <= cut:
                below |= 1 << ranked[at]
                at += 1
            tests += [(Test(name, False, cut), below), (Test(name, True, cut), everything & ~below)]
    left, out, barred = (1 << len(rows)) - 1, [], set()
    while len(out) < most_rules and len(barred) < len(tests):
        grow = left & ~prune
        rule: list[tuple[Test, int]] = []
        seed = None
        covered = grow
        while len(rule) < most_tests and covered & ~bad:
            p0, n0 = (covered & bad).bit_count(), covered.bit_count()
            if not p0:
                break
            best = max(
                (((p := (c := covered & mask) & bad).bit_count() * (math.log2(p.bit_count() / c.bit_count()) - math.log2(p0 / n0)) if covered & mask & bad else 0.0), -k)
                for k, (_, mask) in enumerate(tests)
                if rule or k not in barred
            )
            if best[0] <= 1e-9:
                break
            seed = -best[1] if seed is None else seed
            rule.append(tests[-best[1]])
            covered &= rule[-1][1]

        def worth(parts: list[tuple[Test, int]]) -> float:
            rest = left & prune
            for _, mask in parts:
                rest &= mask
            p, n = (rest & bad).bit_count(), rest.bit_count()
            return (p - 4 * (n - p)) / n if n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        covered = left
        for _, mask in rule:
            covered &= mask
        if not rule:
            break
        unseen, own = covered & prune, covered.bit_count()
        exact = lambda s: (s & bad).bit_count() / max(s.bit_count(), 1)
        sure = least_share((covered & bad).bit_count(), own) >= BOUND
        if own < support or not sure or exact(covered) < precision or (unseen and exact(unseen) < precision):
            barred.add(seed)
            continue
        out.append([t for t, _ in rule])
        left &= ~covered
    return out


def learn_terms(labelled: DataFrame) -> list[str]:
    """Words that occur in many toxic rows and in next to no others: at most MAX_TERMS.

    They are found among the rows that aren't ``held``; those that held rows speak against are dropped again.
    """
    plain = F.array_distinct(F.transform(words(F.coalesce("text", F.lit(""))), lambda w: F.lower(F.btrim(w, F.lit(MARKS)))))
    seen = labelled.select(F.col("toxic") == 1, "held", F.explode(plain).alias("term")).toDF("toxic", "held", "term").filter("term <> ''")
    counts = seen.groupBy("term").agg(F.expr("count_if(toxic and not held) as hits"), F.expr("count_if(not held) as n"), F.expr("count_if(toxic and held) as held_hits"), F.expr("count_if(held) as held_n"))
    total, rows = labelled.filter(~F.col("held")).agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    if not 0 < total < rows:
        return []
    # Hits that all lie in toxic rows by chance: (total / rows) ** hits.
    least = max(5, total // 100, math.ceil(math.log(TERMS_TESTED / 0.05) / math.log(rows / total)))
    found = counts.filter((F.col("hits") >= least) & (F.col("hits") >= 0.95 * F.col("n")) & (F.col("held_hits") >= 0.95 * F.col("held_n")))
    return [r["term"] for r in found.orderBy(F.desc("hits"), "term").limit(MAX_TERMS).collect()]


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> tuple[list[str], list[list[Test]]]:
    """Terms and decision list, from ``max_rows`` labelled rows at most."""
    marked = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    sample = marked.orderBy(F.xxhash64(F.lit("rules"), "doc_id"), "doc_id").limit(max_rows)
    # max_rows rows of 24 bytes: bounded, whatever the input.
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # A third prunes: neither terms nor tests are found in it.
    labelled = labelled.withColumn("held", F.pmod(F.xxhash64(F.lit("prune"), "doc_id"), F.lit(3)) == 0)
    terms = learn_terms(labelled)
    rows = statistics(labelled, terms).select("doc_id", "quality", "toxic", "held", *FEATURES).orderBy("doc_id", *FEATURES).collect()
    bad = lambda r: r["quality"] == 0 or r["toxic"] == 1
    return terms, learn_list([([float(r[f]) for f in FEATURES], bad(r)) for r in rows], held=[r["held"] for r in rows])


def verdict(rules: list[list[Test]]) -> Column:
    """The number of the first rule that rejects a row, from 1; null where none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        out = (F if out is None else out).when(test, F.lit(k))
    return F.lit(None).cast("int") if out is None else out.otherwise(F.lit(None).cast("int"))


def apply_rules(docs: DataFrame, terms: list[str], rules: list[list[Test]]) -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``rule`` and ``kept``."""
    out = statistics(docs, terms).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query: base statistics and the verdict on each document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    terms, rules = learn(docs, load(spark, sf_dir, "labels"))
    return apply_rules(docs, terms, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
