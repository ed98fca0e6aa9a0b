import hashlib
import random
import re

from lociweave.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
B = "item_id long, text string, win string, h long, len int"
D = "doc_id long, text string, win string, words string, row long, hits string"


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, n=10):
    wins = {}
    for item, t in items:
        w = words(t)
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + m]), set()).add(item)
    out = []
    for doc, t in docs:
        w, hit, found = words(t), set(), set()
        for win, its in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= its
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (12, "ONE two three four five six seven eight nine TEN"), (3, None), (4, " .,"), (None, "nobody knows"), (5, "Été à la mer")]
LONG = " ".join(f"q{i}" for i in range(3000))
DOCS = [
    (1, "x one, two; three-four five six seven eight nine ten! eleven y"), (2, "a short item and a short  item"), (3, None), (4, ""), (5, "one two three"), (None, "nobody knows"), (6, "été À la mer"),
    (6, "ÉTÉ à la mer"), (7, LONG + " short item " + LONG), (8, "one two three four five six seven eight nine ten " * 40), (9, "one_two three"), (10, "...."), (11, "nothing here"),
]


def frames(spark):
    return spark.createDataFrame([(i, t, "w", "z", 1, "y") for i, t in DOCS], D), spark.createDataFrame([(i, t, "w", 1, 2) for i, t in ITEMS], B)


def test_against_brute_force_both_ways(spark):
    docs, items = frames(spark)
    want = brute(DOCS, ITEMS)
    for most in (dc.BROADCAST_ROWS, 0):
        assert sorted((tuple(r) for r in dc.measure(docs, items, broadcast_rows=most).collect()), key=str) == want


def test_random_texts(spark):
    r = random.Random(4)
    text = lambda k: "".join(r.choice(["a", "B", "c1", "é"]) + r.choice([" ", ", ", "\n"]) for _ in range(k))
    docs, items = [(i, text(r.randrange(40))) for i in range(60)], [(i, text(r.randrange(6))) for i in range(8)]
    got = dc.measure(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), n=4).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(docs, items, 4)


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert dc.measure(docs.limit(0), items).count() == 0
    got = dc.measure(docs, items.limit(0)).collect()
    assert len(got) == len(DOCS) and not any(r["contaminated"] for r in got)


def test_documents_go_and_spans_go(spark):
    docs, items = frames(spark)
    shared = spark.createDataFrame([(1, "clean words"), (1, "a short item"), (None, "short item"), (None, "clean too"), (None, None)], "doc_id long, text string")
    assert {r["text"] for r in dc.decontaminate(shared, items).collect()} == {"clean words", "clean too", None}
    kept = dc.decontaminate(docs, items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 6, 9, 10, 11] and kept.columns == docs.columns
    cut = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs, items, mode="spans").collect() if r["doc_id"] != 6}
    assert cut[1] == "x  y"
    assert cut[2] == "a  and a " and cut[3] is None and cut[11] == "nothing here" and cut[7] == LONG + "  " + LONG
    again = dc.measure(dc.decontaminate(docs, items, mode="spans"), items).collect()
    assert not any(r["contaminated"] for r in again)
