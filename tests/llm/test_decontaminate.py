import random
import re

from lamina.llm import decontaminate as D
from lamina.llm.decontaminate import leaks

WORDS = [a + b + c for a in ("ba", "no", "ti", "re") for b in ("la", "mu", "so") for c in ("n", "st", "k", "ve", "ra")]


# What the method is to do, written without the module: windows of 8 tokens, 6 in line, 80 percent of an item's windows, 2 equal tokens in half of them.
UNITS = {"km", "hours", "hour", "dollars", "kg", "cm"}


def tokens(text):
    return re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+", text or "")


def kind_of(x):
    return "<number>" if x[0].isdigit() else "<name>" if x != x.lower() else "<unit>" if x in UNITS else None


def brute(docs, items):
    out = {}
    for i, it in items:
        a = tokens(it)
        for d, text in docs:
            b = tokens(text)
            w = min(8, len(a))
            n = len(a) - w + 1
            if not a or (w < 4 and len(a) != len(b)):
                continue
            plain = sum(kind_of(x) is None for x in a)
            for shift in range(-len(a), len(b) + 1):
                lined = [k for k in range(n) if 0 <= k + shift <= len(b) - w]
                low = [k for k in lined if [x.lower() for x in a[k : k + w]] == [x.lower() for x in b[k + shift : k + shift + w]]]
                if low and len(low) >= min(n, 6):
                    out[d, i] = max(out.get((d, i), (0, 0)), (1, len(low)))
                t = lambda x: kind_of(x) or x
                same = [k for k in lined if list(map(t, a[k : k + w])) == list(map(t, b[k + shift : k + shift + w]))]
                if w < 8 and (plain < 2 or 2 * plain < w):
                    continue
                equal = [k for k in same if sum(a[k + j].lower() == b[k + shift + j].lower() for j in range(w)) >= (2 if w == 8 else max(2, -(-w // 2)))]
                if same and len(same) >= 0.8 * n and 2 * len(equal) >= len(same):
                    pairs = {(a[k + j].lower(), b[k + shift + j].lower()) for k in same for j in range(w) if kind_of(a[k + j])}
                    if len({p[0] for p in pairs}) == len(pairs) == len({p[1] for p in pairs}):
                        out[d, i] = max(out.get((d, i), (0, 0)), (0, len(same)))
    return {k: ("exact" if e else "template", n) for k, (e, n) in out.items()}


def prose(rng, n):
    return " ".join(rng.choice(WORDS) if rng.random() > 0.12 else rng.choice(["Anna", "Boris", "17", "3.5", "km", "hours"]) for _ in range(n))


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randint(8, 30))) for i in range(12)] + [(12, "too short"), (13, None), (14, ""), (16, "What is the capital of France?"), (17, "nobani tibalast remuve solan bala")]
    question = "Anna walks 12 km to the market and buys 3 apples for 5 dollars while Boris waits 2 hours before Anna returns home"
    items.append((15, question))
    docs = [(100, None), (101, ""), (102, prose(rng, 400))]
    for k, (i, t) in enumerate(items[:12]):
        docs += [(200 + k, f"{prose(rng, 20)} {t} {prose(rng, 30)}"), (300 + k, t.upper().replace(" ", ", ")), (400 + k, " ".join(t.split()[: len(t.split()) // 2]))]
    changed = question.replace("Anna", "Clara").replace("Boris", "David").replace("12", "41").replace("3", "9").replace("5", "8")
    docs += [(500, changed), (501, changed.replace("Clara returns", "David returns")), (502, prose(rng, 50) + " " + changed), (200, docs[3][1])]
    docs += [(600, "so what is, the capital of france then"), (601, "What is the capital of Spain?"), (602, "too short"), (603, "it was too short then"), (604, prose(rng, 9) + " nobani tibalast remuve solan bala " + prose(rng, 9)), (605, "what is the price of Spain")]
    d = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, item_id long")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert want[500, 15] == want[502, 15] and want[500, 15][0] == "template" and (501, 15) not in want
    assert {(600, 16), (601, 16), (602, 12), (604, 17)} == {k for k in want if k[0] >= 600}
    for limit in (D.MAX_BROADCAST, 0):
        monkeypatch.setattr(D, "MAX_BROADCAST", limit)
        got = {(r.doc_id, r.item_id): (r.kind, r.n_windows) for r in leaks(d, b).collect()}
        assert got == want
    assert leaks(d.limit(0), b).count() == leaks(d, b.limit(0)).count() == 0


def test_no_python_and_no_document_shuffle(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    plan = leaks(d, b)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan


def test_items_with_many_slots(spark):
    race = "Tom runs 5 km in 20 minutes, Ann runs 7 km in 30 minutes. Who is faster?"
    capitals = "HOW MANY APPLES DOES TOM HAVE IF ANN GIVES HIM 5 AND HE EATS 2 OF THEM BEFORE LUNCH"
    digits = "1 2 3 4 5 6 7 8 9 10 11 12"
    b = spark.createDataFrame([(1, race), (2, capitals), (3, digits)], "item_id long, text string")
    copy = race.replace("Tom", "Bill").replace("Ann", "Sue").replace("5", "6").replace("20", "25").replace("7", "9").replace("30", "35")
    docs = [(1, "so here it goes: " + copy), (2, capitals.replace("TOM", "BILL").replace("5", "8")), (3, "21 22 23 24 25 26 27 28 29 30 31 32"), (4, "THE RAIN FELL ON A SMALL TOWN WHILE OLD MEN 7 TIMES TOLD 4 BOYS SOME TALES ABOUT SHIPS")]
    docs.append((5, copy.replace("Sue", "Bill")))  # one name for two
    got = {(r.doc_id, r.item_id, r.kind) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()}
    assert {x for x in got if x[1] != 2 or x[0] != 2} == {(1, 1, "template")}
    assert any(x[:2] == (2, 2) for x in got)


def test_values_of_other_lengths(spark):
    question = "Anna walks 12 km to the market and buys 3 apples for 5 dollars while Boris waits 2 hours before Anna returns home"
    twice = "Anna has 3 apples and gives 2 of them to Boris today . Boris has 4 pears and gives 1 of them to Anna today ."
    b = spark.createDataFrame([(1, question), (2, twice)], "item_id long, text string")
    docs = [
        (1, question.replace("Boris", "Mary Ann").replace("12 km", "30 miles")),
        (2, "Question: " + question.replace("Anna", "Mary Ann").replace("3", "7") + " Then more"),
        (3, "so " + question.replace("12", "twelve dozen").replace("Boris", "Carl")),
        (4, question.replace("market", "shop").replace("Anna", "Eve")),
        (5, question.replace("buys", "picks up").replace("Anna", "Eve").replace("5", "9")),
        (6, question.replace("Anna walks", "Clara walks").replace("Boris", "David").replace("Anna returns", "David returns")),  # one name for two
        (7, " ".join(question.split()[:12])),
        (8, twice.replace("Anna", "Eve").replace("Boris", "Mary Ann").replace("4", "8")),
    ]
    got = {(r.doc_id, r.item_id): r.kind for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()}
    assert {(i, j) for i, j in got if i < 6 or i == 8} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 2)}
    assert got[1, 1] == got[2, 1] == got[8, 2] == "template" and "template" not in (got.get((6, 1)), got.get((7, 1)))


def test_planted_items_of_many_kinds(spark):
    """Every re-parameterised item is found: dense in slots, short, with numbers that aren't ASCII digits."""
    rng = random.Random(8)
    names, others = ["Tom", "Ann", "Carl", "Bob"], ["Bill", "Sue", "Dora", "Finn"]
    items, docs = [], []
    for i in range(60):
        n = rng.choice([5, 6, 7, 8, 12, 25])
        words, slots = [rng.choice(WORDS) for _ in range(n)], {}
        for k in rng.sample(range(n), n // 2 if n > 8 else n // 3):
            slots[k] = rng.choice(["name", "number"])
        value = {k: (rng.choice(names) if v == "name" else str(rng.randint(1, 99))) for k, v in slots.items()}
        for at in range(1, n):  # no runs of names, which would be one
            if slots.get(at) == slots.get(at - 1) == "name":
                del slots[at], value[at]
        fresh = {}
        digits = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩") if i % 3 == 0 else {}
        for v in sorted(set(value.values())):
            fresh[v] = others[names.index(v)] if v in names else str(int(v) + 100).translate(digits)
        text = lambda put: " ".join(put(value[k]) if k in value else w for k, w in enumerate(words))
        items.append((i, text(str)))
        docs.append((i, prose(rng, 40).lower() + ". " + text(fresh.get) + " " + prose(rng, 40).lower()))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(d, b).collect()}
    assert {(i, i) for i in range(60)} <= got and len(got) < 65


def test_very_long_texts(spark):
    n = 1 << 20
    worst = ["1.", "1,", "1", "a", "A", "A-", "A ", "a/", "1 km ", "ab ", "é", "\n", "Aa"]
    item = "Anna walks to the market and buys some apples before Boris comes back home again"
    docs = [(k, w * (n // len(w)) + " " + item) for k, w in enumerate(worst)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    b = spark.createDataFrame([(1, item), (2, "1 2 3 4 5 6 7 8 9 10")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(d, b).collect()}
    assert {(k, 1) for k in range(len(worst))} <= got


def test_clashing_names_and_nulls(spark):
    item = "Anna walks to the market and buys some apples before Boris comes back home again"
    d = spark.createDataFrame([(None, item, "x", 1), (1, None, "y", 2), (1, "so " + item, "z", 3), (1, "so " + item, "z", 3)], "doc_id long, text string, __t string, item_id long")
    b = spark.createDataFrame([(None, item, 1), (7, None, 1), (8, item, 1)], "item_id long, text string, doc_id long")
    got = sorted(((r.doc_id, r.item_id, r.kind) for r in leaks(d, b).collect()), key=str)
    assert got == sorted([(a, c, "exact") for a in (None, 1) for c in (None, 8)], key=str)
