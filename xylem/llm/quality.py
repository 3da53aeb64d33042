"""Rule bitmask ledger: every rule is evaluated once, policies and ablations read the stored bits.

The ledger holds, for each document, the measurements and one failure bit for each rule. A policy is
a named mask over those bits, so a new policy version or an ablation never reads texts again. The
ledger is written to the shared folder; policies and ablations read it there. It is one projection over
the documents: no shuffle, no Python. An ablation shuffles one row for each bit pattern of a task.

Defined cases: a null or blank text has no words, all measurements 0, and fails `few_words`; a very long
text is measured whole; a value that ties with a rule's bound passes; a repeated row gets a row each time;
columns beyond doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import materialise, pinned, whole_text, words

#: Words of a window that counts as repeated when the text holds it twice or more.
WINDOW = 8
MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Bit number = place in this list: a rule is only ever appended.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbol_heavy", "n_symbols > 0.25 * n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    ("odd_word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Versioned policies: a mask over the bits.
POLICIES = {
    "v1": BIT["few_words"] | BIT["repeated_windows"],
    "v2": sum(BIT.values()),
}


def _repeat_columns(df: DataFrame) -> DataFrame:
    """n_repeat_words from `ws`: 64-bit window hashes by doubling (1, 2, 4, 8 words), sorted only if one repeats."""
    width = 1
    df = df.withColumn("h", F.transform("ws", lambda w: F.xxhash64(w)))
    while width < WINDOW:
        df = df.withColumn("h", F.zip_with("h", F.slice("h", F.lit(width + 1), F.greatest(F.size("h"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
        width *= 2
    df = df.withColumn("h", F.slice("h", F.lit(1), F.greatest(F.size("h") - (WINDOW - 1), F.lit(0))))
    repeated = F.size(F.array_distinct("h")) < F.size("h")
    df = df.withColumn("by_hash", F.when(repeated, F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda p, k: F.coalesce(F.get("by_hash", k)["h"] == p["h"], F.lit(False))
    df = df.withColumn("at", F.array_sort(F.array_compact(F.transform("by_hash", lambda p, k: F.when(same(p, k - 1) | same(p, k + 1), p["i"])))))
    covered = F.transform("at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - p, F.lit(WINDOW))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).cast("long"))


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """held: a struct of the columns `keep` of docs (doc_id by default); the measurements as long columns."""
    held = F.struct(*[docs[c] for c in keep or ["doc_id"]]).alias("held")
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(held, whole_text(text).alias("t"))
    df = df.select("held", words(F.col("t")).alias("ws"), F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"))
    df = df.select(
        "held",
        "ws",
        "n_symbols",
        F.size("ws").cast("long").alias("n_words"),
        F.char_length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    return _repeat_columns(df).select("held", *MEASUREMENTS)


def with_bits(measured: DataFrame) -> DataFrame:
    """Add fail_bits: bit k is set if rule k fails."""
    bits: Column = F.lit(0)
    for name, condition in RULES:
        bits = bits + F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0))
    return measured.withColumn("fail_bits", pinned(bits.cast("long")))


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    return with_bits(measure(docs, text, keep))


def stored(docs: DataFrame) -> DataFrame:
    """The ledger of docs, written to the shared folder: doc_id, the measurements, fail_bits."""
    return materialise(ledger(docs).select("held.doc_id", *MEASUREMENTS, "fail_bits"), "ledger")


def passes(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(ledger_rows: DataFrame) -> DataFrame:
    """For each policy and rule: rows kept, rows only this rule rejects, rows kept without the rule.

    One pass counts the bit patterns (at most 2 ** rules of them); the rest is bit algebra on those.
    """
    patterns = ledger_rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    policies = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(m).cast("long").alias("mask")) for p, m in POLICIES.items()]))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for r, b in BIT.items()]))
    rows = patterns.select("fail_bits", "n", policies.alias("p")).select("fail_bits", "n", "p.*", rules.alias("r")).select("fail_bits", "n", "policy", "mask", "r.*")
    rows = rows.where(F.col("mask").bitwiseAND(F.col("bit")) != 0).withColumn("hit", F.col("fail_bits").bitwiseAND(F.col("mask")))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return rows.groupBy("policy", "rule").agg(
        count(F.col("hit") == 0).alias("kept"),
        count(F.col("hit") == F.col("bit")).alias("only_this_rule"),
        count((F.col("hit") == 0) | (F.col("hit") == F.col("bit"))).alias("kept_without"),
    )


def judged(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """One row for each document: measurements, base_failed, kept, fail_bits, n_lines."""
    base = F.col("fail_bits").bitwiseAND(F.lit(POLICIES["v1"])) != 0
    return stored(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & passes(policy)).alias("kept"), "fail_bits", "n_lines",
    )


def keep_passing(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The documents, unchanged, that pass the policy."""
    return ledger(docs, keep=docs.columns).where(passes(policy)).select("held.*")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
n AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY rid),
g AS (SELECT rid, i, string_agg(w, chr(1)) OVER s AS g, count(*) OVER s AS k FROM w WINDOW s AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS times FROM g WHERE k = 8),
c AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS covered FROM r WHERE times >= 2),
rep AS (SELECT rid, sum(covered) AS n_repeat_words FROM c GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN n USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN ln USING (rid)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END) + (CASE WHEN n_symbols > 0.25 * n_words THEN 4 ELSE 0 END)
  + (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END) AS fail_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits::BIGINT AS fail_bits, n_lines::BIGINT AS n_lines FROM b
"""

_BITS = ", ".join(f"('{name}', {bit})" for name, bit in BIT.items())
_MASKS = ", ".join(f"('{name}', {mask})" for name, mask in POLICIES.items())
#: Ablations by judging every document again without the rule.
ABLATION_ORACLE = f"""
WITH ledger AS ({ORACLE}), rules(rule, bit) AS (VALUES {_BITS}), policies(policy, mask) AS (VALUES {_MASKS})
SELECT policy, rule, count(*) FILTER ((fail_bits & mask) = 0) AS kept, count(*) FILTER ((fail_bits & mask) = bit) AS only_this_rule,
  count(*) FILTER ((fail_bits & mask & ~bit) = 0) AS kept_without FROM ledger, policies, rules WHERE (mask & bit) <> 0 GROUP BY policy, rule
"""
