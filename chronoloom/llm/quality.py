"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are masks over the stored bits.

``ledger`` keeps measurements and failure bits; ``judge`` applies a policy; ``ablation`` says what each rule of each
policy costs, from the bits alone.  Everything is built-in column expressions.

Null text has no words.  A row is judged by itself, so repeated rows get repeated verdicts and an empty table an empty
ledger.  Only the id and text columns are read; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
GRAM = 5

#: Bit k is the k-th rule, as an SQL condition on the measurements.  Thresholds follow common web-corpus heuristics.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "10 * n_dup_lines > 4 * n_lines",
    "upper_case": "all_upper = 1",
    "word_length": "n_words > 0 AND (word_chars > 15 * n_words OR word_chars < 2 * n_words)",
}


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject a document under it."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
V1 = Policy("v1", (*BASE.rules, "symbols", "repeated_lines"))
V2 = Policy("v2", tuple(RULES))


def _without(text: Column, characters: str) -> Column:
    # Plain replacing is several times faster than translate().
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """Measurements and ``fail_bits`` of every document; with ``keep_row`` also the whole row, as a struct."""
    row = ["row"] if keep_row else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITE))
    empty = F.array().cast("array<string>")
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    words = docs.select(
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if keep_row else []),
        F.col(id_col).alias("doc_id"),
        F.when(trimmed == "", empty).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("words"),
        lines.alias("lines"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        F.when((text == F.upper(text)) & (text != F.lower(text)), 1).otherwise(0).cast("long").alias("all_upper"),
    )
    grams = F.when(
        F.size("words") >= GRAM,
        F.transform(
            F.sequence(F.lit(0), F.size("words") - GRAM),
            lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(GRAM))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = words.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        grams.alias("grams"),
    )
    # Only a text with equal hashes is sorted; equal neighbours are then compared word by word.
    placed = hashed.withColumn(
        "placed",
        F.when(
            F.size(F.array_distinct("grams")) < F.size("grams"),
            F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    last = F.size("placed") - 1

    def both(a: Column, b: Column) -> Column:
        same = (a["h"] == b["h"]) & (F.slice("words", a["i"] + 1, GRAM) == F.slice("words", b["i"] + 1, GRAM))
        return F.when(same, F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))

    found = placed.withColumn(
        "found",
        F.when(
            F.col("placed").isNotNull(),
            F.sort_array(
                F.array_distinct(
                    F.flatten(F.zip_with(F.slice("placed", 1, last), F.slice("placed", 2, last), both))
                )
            ),
        ),
    )
    # Windows found again, in order: each adds the words that the one before has not covered.
    n_repeat = F.aggregate(
        "found",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-GRAM).alias("last")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(GRAM), i - acc["last"])).alias("n"), i.alias("last")
        ),
        lambda acc: acc["n"],
    )
    measured = found.select(
        *row,
        "doc_id",
        "n_words",
        "n_lines",
        "word_chars",
        "n_symbols",
        "all_upper",
        "n_dup_lines",
        F.coalesce(n_repeat, F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    bits = F.lit(0).cast("long")
    for k, fails in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def judge(entries: DataFrame, policy: Policy = V2, name: str = "kept") -> DataFrame:
    """Adds whether a document is kept under a policy."""
    return entries.withColumn(name, F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def accepted(docs: DataFrame, policy: Policy = V2) -> DataFrame:
    """The rows, with all their columns, that a policy keeps."""
    # The filter must stay above the ledger: pushed below it, every measurement would be computed again inside the
    # condition.  Spark moves no filter past a column that is not deterministic.
    entries = ledger(docs, keep_row=True).withColumn("mark", F.monotonically_increasing_id())
    return judge(entries, policy).where("kept AND mark >= 0").select("row.*")


def ablation(entries: DataFrame, policies: tuple[Policy, ...] = (BASE, V1, V2)) -> DataFrame:
    """For each policy and rule: documents it fails, and those kept if only this rule were dropped.

    The ledger is first counted by its bits (at most two to the number of rules), so nothing is evaluated again.
    """
    counts = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    names = list(RULES)
    spec = [(p.version, p.mask, r, 1 << names.index(r)) for p in policies for r in p.rules]
    options = F.array(
        *(
            F.struct(
                F.lit(v).alias("policy"), F.lit(m).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")
            )
            for v, m, r, b in spec
        )
    )
    hit = F.col("fail_bits").bitwiseAND(F.col("o.mask"))
    return (
        counts.withColumn("o", F.explode(options))
        .groupBy(F.col("o.policy").alias("policy"), F.col("o.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit.bitwiseAND(F.col("o.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(hit == F.col("o.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.bit_or(hit).alias("seen_bits"),
        )
    )
