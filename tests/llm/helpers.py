"""Small tables with everything that is odd, and what brute-force versions share."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, n_words long, kept boolean, tk long, pos int, h long, score double, component_id long, bin_id long, held string"
PROSE = "the cat of the house sat on the mat and looked at a bird that sang in the old tree by the river while rain fell"


def rows():
    """Null ids, texts and labels, empty and blank texts, ties, repeated rows, a very long text."""
    texts = [
        (1, PROSE, "en"), (2, PROSE, "en"), (2, PROSE, "en"), (3, None, "en"), (4, "", "en"), (5, " \t\n\x0b ", None), (6, "one", "en"), (7, "one two", "en"), (8, "One TWO three", None),
        (None, PROSE, "en"), (None, None, None), (9, "a b c d e f g h " * 40, "en"), (10, "línea una\nlínea una\nlínea una\nlínea dos y más", "es"), (11, "### $$$ %%% " * 30, "en"),
        (12, " ".join(f"w{i} x{i % 977}" for i in range(60_000)), "en"), (13, "ÄÖÜ ß İ é " * 20 + "\U0001f600 x", "de"), (14, "12 34 56", "en"), (15, "x" * 50_000, "en"),
    ]
    return [(i, t, g, "s", len(t or ""), 1, 2, True, 3, 4, 5, 0.5, 6, 7, "h") for i, t, g in texts]


def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def by_key(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def executed(df):
    """The physical plan as Spark chooses it before it runs."""
    return df._jdf.queryExecution().executedPlan().toString()


def recorded(monkeypatch, module):
    """A list that gets (label, physical plan) of all that the module materialises."""
    plans, write = [], module.materialise

    def noted(df, label):
        plans.append((label, executed(df)))
        return write(df, label)

    monkeypatch.setattr(module, "materialise", noted)
    return plans
