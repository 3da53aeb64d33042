import duckdb
from tests.llm.helpers import by_key, none, odd, rows, words

from xylem.llm import quality


def brute(text):
    ws = words(text)
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_measurements_equal_brute_force(spark):
    got = by_key(quality.judged(odd(spark)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    expected = []
    for r in rows():
        m = brute(r[1])
        expected.append((r[0], *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert got == sorted(expected, key=repr)


def test_empty_table(spark):
    assert quality.judged(none(spark)).count() == 0
    assert quality.ablation(quality.ledger(none(spark))).count() == 0


def test_stage_keeps_columns_and_rows(spark):
    docs = odd(spark)
    kept = quality.keep_passing(docs)
    assert kept.columns == docs.columns
    wanted = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == wanted and 1 in wanted and 9 not in wanted


def test_ablation_equals_reevaluation(spark):
    ledger = quality.ledger(odd(spark))
    bits = [r.fail_bits for r in ledger.collect()]
    for r in quality.ablation(ledger).collect():
        mask, bit = quality.POLICIES[r.policy], quality.BIT[r.rule]
        assert r.kept == sum(not b & mask for b in bits)
        assert r.kept_without == sum(not b & mask & ~bit for b in bits)
        assert r.only_this_rule == sum(b & mask == bit for b in bits)


def test_sql_counterpart(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = ["doc_id", "n_words", "n_repeat_words", "kept", "fail_bits"]
    got = by_key(quality.judged(spark.read.parquet(f"{sf}/documents.parquet")), *names)
    assert got == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({quality.ORACLE})").fetchall(), key=repr)
    ablations = quality.ablation(quality.stored(spark.read.parquet(f"{sf}/documents.parquet")))
    assert by_key(ablations, *ablations.columns) == sorted(con.execute(f"SELECT {', '.join(ablations.columns)} FROM ({quality.ABLATION_ORACLE})").fetchall(), key=repr)


def test_bounds_are_passed(spark):
    """Twenty words are enough; a share of exactly a quarter of symbols too."""
    twenty = " ".join(f"word{k}" for k in range(20))
    docs = spark.createDataFrame([(1, twenty), (2, twenty + " #$%&|"), (3, twenty + " #$%&| <"), (4, " ".join(twenty.split()[:19]))], "doc_id long, text string")
    assert {r.doc_id: r.fail_bits for r in quality.judged(docs).collect()} == {1: 0, 2: 0, 3: quality.BIT["symbol_heavy"], 4: quality.BIT["few_words"]}
