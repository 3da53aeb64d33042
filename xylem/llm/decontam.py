r"""Benchmark decontamination by template canonicalisation.

A text becomes tokens: words and numbers (`5km` is two, `3,000.25` one). In its template numbers, units
behind a number and capitalised words (names, wherever they stand) are typed placeholders, all else is
lower-cased words. Hashes of windows of WIDTH template tokens are joined with those of the benchmark.
Matches of a text and an item on one diagonal (place in the text minus place in the item), or on
diagonals at most NEAR apart, are a run: inserted or lost words don't split the evidence. MIN_RUN
windows, or half of a shorter item's, are enough. Then slots are compared within the matched windows:
within one type each item value must stand for one value of the text and the other way round. Equal
values make an `exact` leak, consistent ones a `reparameterised` one; every run and every diagonal of it
is judged and the best verdict of a text and an item counts.

Case and white space can hide a copy from the template, and windows of placeholders alone say nothing,
so windows of literal lower-case tokens are joined in the same pass; runs of those are `exact`.

Items too short for a window have their own keys: of SHORT to WIDTH - 1 tokens all windows of SHORT
literal tokens, which must be met on one diagonal; a text that is as a whole an item of fewer tokens is
exact; a text whose whole template is that of an item of fewer than WIDTH tokens has its slots compared.

An item is indexed by all of its windows with a plain word. A re-parameterised run must show MIN_WORDS
plain words, or all windows of the item, so that lists of numbers don't pass for a question.

Texts and items are identified by 64-bit hashes while they are compared: copies share one comparison,
no row needs a unique id. The benchmark's windows are broadcast if there are at most BROADCAST_ROWS; the
join shuffles both sides beyond that. Only DataFrame functions are used.

Defined cases: null and empty texts and items match nothing; very long texts are read whole; an item
that is repeated counts once for each item_id; repeated documents get a row each; ties between runs go
to the one with more windows; extra columns of either table are ignored (keep_clean returns them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xylem.llm.common import OWN, materialise, whole_text

WIDTH, MIN_RUN, MIN_WORDS, NEAR = 8, 6, 4, 7
#: Width of the windows of items that are shorter than WIDTH.
SHORT = 4
#: Rows of 8-byte keys (with item, place and numbers, about 40 bytes each) that may be broadcast.
BROADCAST_ROWS = 1_000_000
NUM, UNIT, NAME, JOINT = "\ue000", "\ue001", "\ue002", "\ue003"
HOLDERS = (NUM, UNIT, NAME)
UNITS = (
    "mm cm km kg mg lb lbs oz ml kb mb gb tb kw kwh mph kmh hz mhz ghz m g l s h w v a usd eur gbp euro euros dollar dollars cent cents pound pounds percent mile miles meter meters metre metres gram grams "
    "kilogram kilograms liter liters litre litres hour hours minute minutes second seconds day days week weeks month months year years feet foot inch inches"
).split()
#: Kinds of keys: template windows, literal windows, literal windows of short items, whole literal texts, whole templates.
TEMPLATE, LITERAL, SMALL, WHOLE, WHOLE_TEMPLATE = range(5)


def raw_tokens(text: Column) -> Column:
    """Words and numbers as they are written; parts of a number are held together by JOINT."""
    t = F.regexp_replace(text, F.lit(r"[.,:/](?<=\p{Nd}[.,:/])(?=\p{Nd})"), F.lit(JOINT))
    t = F.regexp_replace(t, F.lit(rf"\p{{Nd}}[\p{{Nd}}{JOINT}]*"), F.lit(" $0 "))
    t = F.when(text.rlike(r"\p{Nd}"), t).otherwise(text)
    return F.filter(F.split(t, rf"[^\p{{L}}\p{{M}}\p{{Nd}}{JOINT}]+"), lambda x: x != "")


def _canonical(raw: Column, x: Column, i: Column) -> Column:
    """Template token of x, which stands at place i of raw."""
    number = lambda x: F.coalesce(x.rlike(r"^\p{Nd}"), F.lit(False))
    unit = F.lower(x).isin(*UNITS) & number(F.get(raw, i - 1))
    return F.when(number(x), NUM).when(unit, UNIT).when(x.rlike(r"^\p{Lu}"), NAME).otherwise(F.lower(x))


def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `raw`, `lit` (lower-case tokens) and `tpl` (the template, one for one)."""
    df = df.withColumn("raw", raw_tokens(whole_text(text)))
    return df.withColumn("lit", F.transform("raw", F.lower)).withColumn("tpl", F.transform("raw", lambda x, i: _canonical(F.col("raw"), x, i)))


KEYS = ("t8", "l8", "l4", "w", "wt")


def with_keys(df: DataFrame) -> DataFrame:
    """Add an array of keys for each kind, made from `raw`; windows by doubling (1, 2, 4, 8 tokens)."""
    df = df.withColumn("t", F.transform("raw", lambda x, i: F.xxhash64(_canonical(F.col("raw"), x, i)))).withColumn("l", F.transform("raw", lambda x: F.xxhash64(F.lower(x), F.lit(1))))
    whole = lambda h, least, most, kind: F.when(F.size(h).between(least, most), F.array(F.xxhash64(F.lit(kind), h))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("w", whole("l", 1, SHORT - 1, WHOLE)).withColumn("wt", whole("t", 1, WIDTH - 1, WHOLE_TEMPLATE))
    of_width = lambda h, width: F.slice(h, F.lit(1), F.greatest(F.size(h) - (width - 1), F.lit(0)))
    width = 1
    while width < WIDTH:
        for h in ("t", "l"):
            df = df.withColumn(h, F.zip_with(h, F.slice(h, F.lit(width + 1), F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
        width *= 2
        if width == SHORT:
            df = df.withColumn("l4", of_width("l", SHORT))
    return df.withColumn("t8", of_width("t", WIDTH)).withColumn("l8", of_width("l", WIDTH))


def item_table(benchmark: DataFrame) -> DataFrame:
    """iid, raw, lit, tpl of each distinct text of the benchmark."""
    texts = benchmark.select(text_key().alias("iid"), whole_text().alias("text")).dropDuplicates(["iid"])
    return with_tokens(texts).drop("text")


def item_windows(items: DataFrame) -> DataFrame:
    """h, iid, kind, ipos, of (windows of this kind in the item), need."""
    keyed, parts = with_keys(items), []
    plain = lambda tokens: F.size(F.filter(tokens, lambda x: ~x.isin(*HOLDERS)))
    for kind, name in enumerate(KEYS):
        rows = keyed.select("iid", "tpl", F.size("lit").alias("size"), F.posexplode(name).alias("ipos", "h"))
        if kind == TEMPLATE:
            rows = rows.where(plain(F.slice("tpl", F.col("ipos") + 1, F.lit(WIDTH))) > 0)
        elif kind == SMALL:
            rows = rows.where(F.col("size") < WIDTH)
        elif kind == WHOLE_TEMPLATE:
            rows = rows.where((plain(F.col("tpl")) > 0) & (plain(F.col("tpl")) < F.size("tpl")))
        parts.append(rows.select("h", "iid", F.lit(kind).alias("kind"), "ipos"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    of = rows.groupBy("iid", "kind").agg(F.count(F.lit(1)).cast("int").alias("of"))
    need = F.when(F.col("kind") < SMALL, F.least(F.lit(MIN_RUN), F.ceil(F.col("of") / 2))).otherwise(F.col("of")).cast("int")
    return rows.join(of.withColumn("need", need), ["iid", "kind"]).select("h", "iid", "kind", "ipos", "of", "need")


def text_key(text: str = "text") -> Column:
    return F.xxhash64(whole_text(text))


def _checked_broadcast(df: DataFrame) -> DataFrame:
    """df, written; with a broadcast hint if its rows are few."""
    df = materialise(df, "decontam")
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def diagonals(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """tk, iid, kind, of, need, diag, at: the item places of the matched windows of each diagonal."""
    small = not windows.where(F.col("kind") == SMALL).isEmpty()
    texts = with_keys(docs.select(text_key().alias("tk"), raw_tokens(whole_text()).alias("raw")))
    texts = texts if small else texts.withColumn("l4", F.array().cast("array<bigint>"))
    ends, columns = F.lit(0), []
    for kind, name in enumerate(KEYS[:-1]):
        ends = ends + F.size(name)
        columns.append(ends.alias(f"e{kind}"))
    places = texts.select("tk", *columns, F.posexplode_outer(F.concat(*KEYS)).alias("pos", "h"))
    met = places.join(windows, "h")
    start = F.lit(0)
    for kind in range(1, len(KEYS)):
        start = F.when(F.col("kind") == kind, F.col(f"e{kind - 1}")).otherwise(start)
    met = met.select("tk", "iid", "kind", "of", "need", (F.col("pos") - start - F.col("ipos")).alias("diag"), "ipos")
    return met.groupBy("tk", "iid", "kind", "of", "need", "diag").agg(F.collect_set("ipos").alias("at"))


def runs(found: DataFrame) -> DataFrame:
    """tk, iid, kind, of, windows, parts (diag, at): runs of near diagonals, and their diagonals alone, with enough windows."""
    by = ["tk", "iid", "kind", "of", "need"]
    order = Window.partitionBy(*by).orderBy("diag")
    near = F.when(F.col("kind") < SMALL, F.lit(NEAR)).otherwise(F.lit(0))
    begins = F.when(F.col("diag") - F.lag("diag").over(order) <= near, 0).otherwise(1)
    chained = found.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order))
    whole = chained.groupBy(*by, "run").agg(F.collect_list(F.struct("diag", "at")).alias("parts"))
    alone = F.transform("parts", lambda p: F.array(p))
    every = whole.select(*by, F.explode(F.when(F.size("parts") > 1, F.concat(F.array("parts"), alone)).otherwise(F.array("parts"))).alias("parts"))
    every = every.withColumn("windows", F.size(F.array_distinct(F.flatten(F.col("parts")["at"]))))
    return every.where(F.col("windows") >= F.col("need")).select("tk", "iid", "kind", "of", "windows", "parts")


def _slots_judged(template_runs: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """tk, iid, windows, of, n_slots, verdict of the runs whose slots agree."""
    wanted = _checked_broadcast(template_runs.select("tk").distinct())
    texts = docs.select(text_key().alias("tk"), "text").join(wanted, "tk", "left_semi").dropDuplicates(["tk"])
    texts = with_tokens(texts).select("tk", F.col("lit").alias("dv"))
    rows = template_runs.join(items.select("iid", F.col("lit").alias("iv"), F.col("tpl").alias("it")), "iid").join(texts, "tk")
    holder = lambda i: F.get("it", i).isin(*HOLDERS)
    covered = lambda at: F.array_distinct(F.flatten(F.transform(at, lambda a: F.sequence(a, F.least(a + (WIDTH - 1), F.size("it") - 1)))))
    one = lambda p: F.transform(F.filter(covered(p["at"]), holder), lambda i: F.struct(F.get("it", i).alias("kind"), F.get("iv", i).alias("i"), F.get("dv", i + p["diag"]).alias("d")))
    plain = F.size(F.filter(covered(F.array_distinct(F.flatten(F.col("parts")["at"]))), lambda i: ~holder(i)))
    rows = rows.select("tk", "iid", "windows", "of", plain.alias("plain"), F.array_distinct(F.flatten(F.transform("parts", one))).alias("slots"))
    pairs, of_item, of_doc = F.size("slots"), *(F.size(F.array_distinct(F.transform("slots", f))) for f in (lambda s: F.struct(s["kind"], s["i"]), lambda s: F.struct(s["kind"], s["d"])))
    enough = (F.col("plain") >= MIN_WORDS) | (F.col("windows") == F.col("of"))
    verdict = F.when(F.forall("slots", lambda s: s["i"] == s["d"]), "exact").when((pairs == of_item) & (pairs == of_doc) & enough, "reparameterised")
    return rows.select("tk", "iid", "windows", "of", pairs.alias("n_slots"), verdict.alias("verdict")).where(F.col("verdict").isNotNull())


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """tk, item_id, windows, n_windows, n_slots, verdict for each text and item that is a leak."""
    items = materialise(item_table(benchmark), "items")
    found = materialise(runs(diagonals(docs, _checked_broadcast(item_windows(items)))), "runs")
    is_literal = F.col("kind").isin(LITERAL, SMALL, WHOLE)
    literal = found.where(is_literal).select("tk", "iid", "windows", "of", F.lit(0).alias("n_slots"), F.lit("exact").alias("verdict"))
    rest = materialise(found.where(~is_literal).join(literal.select("tk", "iid").distinct(), ["tk", "iid"], "left_anti"), "templates")
    both = literal.unionByName(_slots_judged(rest, docs, items))
    best = both.groupBy("tk", "iid").agg(F.max(F.struct((F.col("verdict") == "exact").alias("exact"), "windows", "of", "n_slots", "verdict")).alias("b"))
    named = benchmark.select(text_key().alias("iid"), "item_id").distinct()
    return best.join(named, "iid").select("tk", "item_id", "b.windows", F.col("b.of").alias("n_windows"), "b.n_slots", "b.verdict")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, windows, n_windows, n_slots, verdict: one row for each leaked item of a document."""
    found = _checked_broadcast(leaks(docs, benchmark))
    return docs.select("doc_id", text_key().alias("tk")).join(found, "tk").drop("tk")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, unchanged, without a leak."""
    key = f"{OWN}tk"
    found = _checked_broadcast(leaks(docs, benchmark).select(F.col("tk").alias(key)).distinct())
    return docs.withColumn(key, text_key()).join(found, key, "left_anti").select(*docs.columns)
