import random

import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import none, odd

from xylem.llm import decontam

QUESTION = "If a train leaves the old station at 9 km distance and then Alice walks 12 km to meet Robert near the bridge, how long will Alice need?"
OTHER = "If a train leaves the old station at 7 km distance and then Maria walks 15 km to meet Pedro near the bridge, how long will Maria need?"
MIXED = "If a train leaves the old station at 7 km distance and then Maria walks 15 km to meet Pedro near the bridge, how long will Susan need?"
PLAIN = "the river ran past a mill where nobody had worked since the war and the wheel still turned each spring when the snow came down"


def tokens(text):
    """(kind or None, lower-case token) of each word and number, one character at a time."""
    out, word = [], ""
    for k, c in enumerate((text or "") + " "):
        inside = c in ".,:/" and word[-1:].isdecimal() and text[k + 1 : k + 2].isdecimal()
        if word and not inside and not (c.isalpha() and word[0].isalpha()) and not (c.isdecimal() and word[0].isdecimal()):
            kind = "n" if word[0].isdecimal() else "u" if word.lower() in decontam.UNITS and out and out[-1][0] == "n" else "N" if word[0].isupper() else None
            out.append((kind, word.lower()))
            word = ""
        word += c if inside or c.isalpha() or c.isdecimal() else ""
    return out


def runs(doc, item, width, indexed):
    """Lists of (diagonal, place in the item) of near diagonals, and of each diagonal alone."""
    met = sorted((b - a, a) for a in range(len(item) - width + 1) if indexed(item[a : a + width]) for b in range(len(doc) - width + 1) if doc[b : b + width] == item[a : a + width])
    chains = []
    for d, a in met:
        if not chains or d - chains[-1][-1][0] > decontam.NEAR:
            chains.append([])
        chains[-1].append((d, a))
    return chains + [[x for x in met if x[0] == d] for d in {d for d, _ in met}]


def one_to_one(slots):
    return len(set(slots)) == len({(k, i) for k, i, _ in slots}) == len({(k, d) for k, _, d in slots})


def verdict(text, item_text):
    """What a text and an item are by the definition, without keys or joins."""
    doc, item = tokens(text), tokens(item_text)
    dl, il = [w for _, w in doc], [w for _, w in item]
    dt, it = ([k or w for k, w in x] for x in (doc, item))
    if not il:
        return None
    if len(il) < 4 and dl == il:
        return "exact"
    if 4 <= len(il) < 8 and any(dl[b : b + len(il)] == il for b in range(len(dl))):
        return "exact"
    if any(len({a for _, a in r}) >= min(6, -(-(len(il) - 7) // 2)) for r in runs(dl, il, 8, lambda w: True)):
        return "exact"
    plain = lambda w: [x for x in w if x not in ("n", "u", "N")]
    found = []
    if len(it) < 8 and dt == it and plain(it) and plain(it) != it:
        found = [(True, list(zip(it, il, dl, strict=True)))]
    of = sum(bool(plain(it[a : a + 8])) for a in range(len(it) - 7))
    for r in runs(dt, it, 8, plain):
        places, windows = {(d, a + k) for d, a in r for k in range(8)}, len({a for _, a in r})
        if windows >= min(6, -(-of // 2)):
            enough = windows == of or len(plain([it[i] for i in {i for _, i in places}])) >= 4
            found.append((enough, [(it[i], il[i], dl[i + d]) for d, i in places if it[i] in ("n", "u", "N")]))
    if any(all(i == d for _, i, d in slots) for _, slots in found):
        return "exact"
    return "reparameterised" if any(enough and one_to_one(slots) for enough, slots in found) else None


def brute(docs, items):
    """(doc id, item id) of all leaks; texts that share no three words in a row with an item are passed over."""
    threes = lambda t: {tuple(k or w for k, w in t[a : a + 3]) for a in range(len(t) - 2)}
    out, cut = set(), [(i, t, threes(tokens((t or "").lower())) | threes(tokens(t)), len(tokens(t))) for i, t in items]
    for d, text in docs:
        own = threes(tokens((text or "").lower())) | threes(tokens(text))
        out |= {(d, i) for i, t, parts, n in cut if (n < 3 or parts & own) and verdict(text, t)}
    return out


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, QUESTION), (2, PLAIN), (3, "too short"), (4, None), (2, PLAIN)], "item_id long, text string")


def found(docs, bench):
    return {(r.doc_id, r.item_id): r.verdict for r in decontam.contaminated(docs, bench).collect()}


def test_verdicts(spark, bench):
    docs = spark.createDataFrame([
        (1, f"Some words before. {QUESTION} And after."), (2, f"Text first. {OTHER}"), (3, f"Text first. {MIXED}"), (4, "nothing to see in this text that would match anything at all in there"),
        (5, PLAIN.upper()), (6, f"x y z {PLAIN[:90]}"), (7, "too short"), (8, None), (9, f"{PLAIN} {QUESTION}"), (9, f"{PLAIN} {QUESTION}"), (None, PLAIN),
    ], "doc_id long, text string")
    got = found(docs, bench)
    assert got[1, 1] == "exact" and got[2, 1] == "reparameterised"
    assert got[5, 2] == "exact" and got[6, 2] == "exact" and got[9, 1] == got[9, 2] == "exact" and got[None, 2] == "exact"
    assert got[7, 3] == "exact"  # as a whole
    assert not {4, 8} & {d for d, _ in got}
    # the inconsistent document counts only by windows without placeholders, of which there are too few
    assert (3, 1) not in got
    assert decontam.contaminated(docs, bench).where("doc_id = 9").count() == 4
    kept = decontam.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 8]


def test_every_diagonal_is_judged(spark, bench):
    drill, partial = f"Text first. {MIXED} Then more words. ", QUESTION.split(", how long")[0]
    docs = spark.createDataFrame([(1, drill + QUESTION), (2, drill + OTHER), (3, drill + MIXED), (4, OTHER + " " + QUESTION), (5, f"Text first. {partial}, one asks what Susan at 99 km thinks.")], "doc_id long, text string")
    assert found(docs, bench) == {(1, 1): "exact", (2, 1): "reparameterised", (4, 1): "exact", (5, 1): "exact"}
    assert decontam.contaminated(docs, bench).count() == 4
    assert [r.doc_id for r in decontam.keep_clean(docs, bench).collect()] == [3]


SUM = "what is 12 + 7 + 31 - 5 + 88 - 14 + 9 + 3 in total when all of them count"
OTHER_SUM = "what is 41 + 6 + 52 - 8 + 19 - 27 + 2 + 5 in total when all of them count"
NUMBERS = "3 14 15 92 65 35 89 79 32 38 46 26 43 38 32 79"
SHORT = "capital city of Burkina Faso"


def test_dense_and_short_items(spark):
    items = spark.createDataFrame([(1, SUM), (2, NUMBERS), (3, SHORT), (4, "two words")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, f"We ask {SUM} and more."), (2, f"We ask {OTHER_SUM} and more."), (3, f"Digits are {NUMBERS} and so on"), (4, f"Name the {SHORT.upper()}, please"), (5, SHORT),
        (6, "Digits are 2 71 82 81 82 84 59 4 52 35 36 2 87 47 13 52 and so on"), (7, "capital city of Chad"), (8, "two words"), (9, "add it in total when all of them count"),
    ], "doc_id long, text string")
    assert found(docs, items) == {(1, 1): "exact", (2, 1): "reparameterised", (3, 2): "exact", (4, 3): "exact", (5, 3): "exact", (8, 4): "exact"}


def test_case_breaks_and_names_at_the_start(spark):
    items = spark.createDataFrame([(1, "Tom has 3 apples. Tom buys 4 more of them and gives Mary 2 apples."), (2, QUESTION)], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Ann has 5 apples. Ann buys 9 more of them and gives Rose 8 apples."), (2, "Ann has 5 apples. Tom buys 9 more of them and gives Rose 8 apples."), (3, "x " + QUESTION.lower()), (4, QUESTION.upper()),
        (5, QUESTION.replace(" ", "  \n")), (6, QUESTION.replace("then Alice", "then surely Alice")), (7, OTHER.replace("then Maria", "then surely Maria")),
    ], "doc_id long, text string")
    assert found(docs, items) == {(1, 1): "reparameterised", (3, 2): "exact", (4, 2): "exact", (5, 2): "exact", (6, 2): "exact", (7, 2): "reparameterised"}


def test_every_item_is_found(spark):
    """Items of any length and any share of numbers, word for word in running text and with other numbers."""
    rng, items, docs, expected = random.Random(5), [], [], {}
    word = lambda n: "".join(rng.choice("bcdfghjklnprtvz") + rng.choice("aeiou") for _ in range(n))
    for size in (*range(1, 13), 17, 30, 60):
        for share in (0.0, 0.3, 0.7, 1.0):
            numbers = rng.sample(range(100, 10_000), size)
            item = [str(n) if rng.random() < share else word(3) for n in numbers]
            other = [str(int(x) + 20_000) if x.isdecimal() else x for x in item]
            k, plain = len(items), sum(not x.isdecimal() for x in item)
            items.append((k, " ".join(item)))
            around = ("", "") if size < 4 else ("so we asked them, ", " and they said no")
            docs += [(2 * k, around[0] + " ".join(item) + around[1]), (2 * k + 1, (around[0] if size >= 8 else "") + " ".join(other) + (around[1] if size >= 8 else ""))]
            expected[2 * k, k] = "exact"
            if other == item:
                expected[2 * k + 1, k] = "exact"
            elif plain:
                expected[2 * k + 1, k] = "reparameterised"
    got = found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {k: v for k, v in got.items() if k[0] // 2 == k[1]} == expected


def test_tokens_equal_brute_force(spark):
    texts = [QUESTION, OTHER, "a 1.5km B2 x 3,000.25 kg, Anna-Lena; 12:30 h", "3 . 4 5,x 7/8/ 9mm Mm", "", "ÄÖ über 1"]
    df = decontam.with_tokens(spark.createDataFrame([(t,) for t in texts], "text string"))
    kinds = {decontam.NUM: "n", decontam.UNIT: "u", decontam.NAME: "N"}
    for text, r in zip(texts, df.collect(), strict=True):
        assert [(kinds.get(t), w.replace(decontam.JOINT, "/")) for t, w in zip(r.tpl, r.lit, strict=True)] == [(k, w.translate({ord(c): "/" for c in ".,:"})) for k, w in tokens(text)]


def test_real_tables_equal_brute_force(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert set(found(docs, items)) == expected and expected


def test_odd_and_empty(spark, bench):
    assert found(odd(spark), bench) == {}
    assert found(none(spark), bench) == {}
    assert found(odd(spark), bench.limit(0)) == {}
    assert decontam.keep_clean(odd(spark), bench).count() == odd(spark).count()
