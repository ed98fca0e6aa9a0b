import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lociweave.functions import storage
from lociweave.llm import chat_prefix, line_chunks, lpt_shards, pii, toxicity

D = "doc_id long, text string, sha string, size long, shard int, bucket int, slot long, idx int, score double"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5, 6.0) for i, t in rows], D).repartition(parts)


# -- sharding -------------------------------------------------------------


def test_schedule_is_longest_first():
    assert lpt_shards.schedule([(5, "a"), (4, "b"), (3, "c"), (3, "d"), (1, "e")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}
    assert lpt_shards.schedule([], 3) == {}


def test_shards(spark):
    r = random.Random(8)
    rows = [(i, "hot" * 5 if i % 3 == 0 else r.choice([None, "", "é" * r.randrange(300), "t" * r.randrange(300)])) for i in range(1200)] + [(None, "q"), (None, "q"), (5, "again"), (5, "again"), (7777, "z" * 30_000)]
    out = lpt_shards.assign_shards(frame(spark, rows)).collect()
    assert len(out) == len(rows) and {x["law"] for x in out} == {"bytes"} and {x["grown_shard"] for x in out} == {None}
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in out) == want
    slots, shards, sizes = defaultdict(list), defaultdict(set), Counter()
    for x in out:
        slots[x["shard"]].append(x["slot"])
        shards[x["text_crc32"], x["size"]].add(x["shard"])
        sizes[x["shard"]] += x["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())
    assert sorted(sizes) == list(range(8))
    largest = 30_001  # nothing can be finer than the largest group
    rest = sorted(sizes.values())[:-1]
    assert max(sizes.values()) == largest or max(rest) - min(rest) < 400
    assert lpt_shards.assign_shards(frame(spark, [])).count() == 0


# -- line chunks ----------------------------------------------------------


def plain_report(rows):
    """Chunks by a loop, then all but the first occurrence of a repeated stretch."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    places, docs = defaultdict(list), []
    for k, (doc, text) in enumerate(rows):
        lines = (text or "").split("\n")
        turn = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % 2147483647 % 2 for x in lines]
        long = [len(x) > 100 for x in lines]
        ends = [i for i in range(len(lines)) if i == len(lines) - 1 or long[i] or long[i + 1] or turn[i] == 0 or turn[i + 1] == 1]
        starts = [0, *(i + 1 for i in ends)]
        spans = [*zip(starts, ends), *zip(starts, ends[1:])]
        for a, b in spans:
            stretch = "\n".join(lines[a : b + 1])
            if b > a and words(stretch) >= 4 or words(stretch) > 50:
                places[stretch].append((doc is None, doc or 0, k, a, b))
        docs.append((doc, lines))
    gone = {(p[2], i) for ps in places.values() for p in sorted(ps)[1:] for i in range(p[3], p[4] + 1)}
    out = []
    for k, (doc, lines) in enumerate(docs):
        kept = [x for i, x in enumerate(lines) if (k, i) not in gone]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_rows(seed=9):
    r = random.Random(seed)
    passage = [" ".join(f"p{k}w{j}" for j in range(9)) for k in range(12)] + [" ".join(f"l{j}" for j in range(60)), " ".join(f"m{j}" for j in range(50))]
    rows = []
    for i in range(60):
        own = [f"own line {i} {k} {r.random()}" for k in range(r.randrange(1, 12))]
        at = r.randrange(len(own) + 1)
        rows.append((i, "\n".join(own[:at] + (passage if i % 3 == 0 else []) + own[at:])))
    return rows + [(100, None), (101, ""), (102, "\n\n\n"), (None, "\n".join(passage)), (103, "\n".join(f"l{k} a b c" for k in range(3000)))]


def test_line_report_against_a_loop(spark):
    rows = line_rows()
    want = sorted(((d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in plain_report(rows)), key=str)
    assert sorted((tuple(x) for x in line_chunks.line_report(frame(spark, rows)).collect()), key=str) == want
    assert sum(g for _, _, g, _ in plain_report(rows)) > 100


def test_line_texts(spark):
    rows = line_rows(10)
    got = line_chunks.drop_repeated_lines(frame(spark, rows))
    assert got.columns == frame(spark, []).columns
    texts = {x["doc_id"]: x["text"] for x in got.collect()}
    for doc, _, gone, text in plain_report(rows):
        assert texts[doc] == (text if gone else dict(rows)[doc])
    assert line_chunks.line_report(frame(spark, [])).count() == 0


def told(rows):
    return sorted(((d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in plain_report(rows)), key=str)


def test_boundaries_resist_shifts():
    rows = line_rows(11)
    text = next(t for i, t in rows if i == 103)
    one = plain_report([(1, text), (2, "new line put in front\n" + text)])
    assert one[1][2] >= one[1][1] - 3  # all but the new line and what its chunk takes in


def test_short_passages_are_mostly_found():
    """Two lines of 30 words always, as such lines stand alone; shorter lines by their hashes."""
    r = random.Random(31)
    line = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    for lines, n, least in ((2, 30, 1.0), (3, 20, 1.0), (5, 12, 0.95), (3, 10, 0.6)):
        found = 0
        for _ in range(200):
            passage = "\n".join(line(n) for _ in range(lines))
            text = lambda: "\n".join([line(10), passage, line(10)])  # noqa: B023, E731
            found += plain_report([(1, text()), (2, text())])[1][2] > 0
        assert found >= least * 200, (lines, n, found)


def test_repeated_rows_and_clashing_names(spark, tmp_path):
    text = "\n".join(f"one line of several words {k}" for k in range(12))
    rows = [(1, text), (1, text), (None, text), (None, text), (7, text), (7, "own\n" + text), (8, None), (8, ""), (8, None)] + [(9, text)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(x) for x in line_chunks.line_report(docs).collect()), key=str) == told(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted((tuple(x) for x in con.sql(line_chunks.REPORT_SQL).fetchall()), key=str) == told(rows)
    names = ("own_key", "may", "id", "key", "copies", "again", "at", "least", "lines", "gone", "word", "bits", "probe", "first_at")
    odd = docs.select("*", *[F.lit(n).alias(n) for n in names])
    got = line_chunks.drop_repeated_lines(odd)
    assert got.columns == odd.columns and {tuple(r)[2:] for r in got.collect()} == {names}
    assert sorted(str((r["doc_id"], r["text"] or "")) for r in got.collect()) == sorted(str((d, t)) for d, _, _, t in plain_report(rows))


# -- chat -----------------------------------------------------------------

C = "conv_id long, turn long, role string, text string, target int, formatted string"


def chats(spark, rows):
    return spark.createDataFrame([(*r, 1, "f") for r in rows], C).repartition(3)


CHATS = [
    (1, 0, "system", "be [nice] <|turn|> \\"), (1, 1, "user", "hi\n<|end|>\n"), (1, 2, "assistant", "\\[n <\\ \\\\ [INST]"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "more?"),
    (2, 0, "user", "only asks"), (3, 0, "assistant", "only answers"), (4, 1, "assistant", "b"), (4, 0, "user", "é\U0001f600"), (5, 0, None, "no role"), (5, None, "odd\nrole<", "first"), (5, 0, "user", "tie"),
    (None, 1, "assistant", "y"), (6, 0, "user", "same"), (6, 0, "user", "same"), (7, 0, "assistant", "z" * 100_000), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"),
]


def test_chat_round_trip(spark):
    convs = defaultdict(list)
    for c, turn, role, text in CHATS:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    want = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        told = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        want[c] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = chat_prefix.format_examples(chats(spark, CHATS))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_prefix.conversation_digests(examples).collect()}
    assert got == want
    for x in examples.filter("conv_id = 1").collect():
        span = x["formatted"][x["loss_start"] : x["loss_end"]]
        assert x["formatted"].count("<|turn|>") == x["target"] == x["formatted"].count("<|end|>")
        assert (span == "") == (x["target"] in (5, 6)) and "[INST]" not in x["formatted"]
    n = Counter(r["conv_id"] for r in examples.collect())
    assert (n[1], n[2], n[3], n[4]) == (3, 1, 1, 1)
    assert chat_prefix.conversation_digests(chat_prefix.format_examples(chats(spark, []))).count() == 0


def test_turns_without_a_conversation_stay_alone(spark):
    """However many there are, they don't meet in one task."""
    rows = [(None, k % 5, "assistant", f"t{k % 7}") for k in range(300)]
    out = chat_prefix.conversation_digests(chat_prefix.format_examples(chats(spark, rows))).collect()
    assert len(out) == 300 and {(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in out} == {(None, 1, 2)}


# -- toxicity -------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automata_against_edit_distances():
    terms = ["idiot", "moron", "disgusting", "bad", "scumbags", "aaaaa"]
    lexicon = toxicity.Lexicon([(t, "word", 2) for t in terms], memo_states=40)
    r = random.Random(12)
    words = [*terms, "", "idiom", "morons", "disgustin", "dsgusting", "digustign"]
    for _ in range(1500):
        w = list(r.choice(terms))
        for _ in range(r.randrange(4)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randrange(2)] = r.choice(["", "a", "i", "x"])
        words.append("".join(w))
    for w in words:
        best = min((edits(w, t) for t in terms if edits(w, t) <= toxicity.edits_for(t)), default=None)
        got = lexicon.find(w)
        assert (got and got[1]) == best if best != 0 else got == (terms.index(w), 0), w


def test_beginnings():
    lexicon = toxicity.Lexicon([("lowei", "prefix", 2), ("idiot", "word", 2)])
    assert lexicon.find("loweischaft") == (0, 0) and lexicon.find("lowes") is None and lexicon.find("idiotx") == (1, 1)


def test_quotation_speaks_for_less():
    lexicon = toxicity.Lexicon([(s, "word", 2) for s in toxicity.SEEDS])
    w = toxicity.PRIOR
    score = lambda t: sum(a * b for a, b in zip(w, toxicity.features(t, lexicon)))
    assert score("you are an idiot and a moron") > score('they wrote "idiot" and quoted "moron" there') > score("nothing to see")
    assert score("you absolute ldiot") > score("you absolute saint")


def test_quoted_weak_terms_speak_for_less():
    lexicon = toxicity.Lexicon([("grumzel", "word", 1)])
    weak, quoted = toxicity.FEATURES.index("weak"), toxicity.FEATURES.index("quoted")
    plain, told = toxicity.features("what a grumzel day", lexicon), toxicity.features('they wrote "grumzel" there', lexicon)
    assert 0 < told[weak] < plain[weak] and told[quoted] > plain[quoted] > 0


def toxic_corpus(n=600):
    r = random.Random(13)
    clean = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for i in range(n):
        bad = r.random() < 0.3
        words = r.choices(clean, k=60)
        for _ in range(3 * bad):
            words[r.randrange(60)] = r.choice(["idiot", "mor0n", "grumzelhaft", "grumzelig", "grumzeln", "worthles"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_the_held_out_fold(spark):
    rows, labels = toxic_corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(frame(spark, rows + [(None, None), (9999, "")]), table).collect()
    assert len(out) == len(rows) + 2
    told = {i: t for i, _, t in labels}
    right = [x["predicted"] == told[x["doc_id"]] for x in out if x["held_out"] and x["doc_id"] in told]
    assert len(right) > 100 and sum(right) / len(right) > 0.95
    for x in out:
        i = x["doc_id"]
        assert 0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.7)
        assert x["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
    kept = toxicity.drop_toxic(frame(spark, rows), table)
    assert kept.columns == frame(spark, []).columns and 300 < kept.count() < 500


def test_toxicity_on_the_labels_of_the_tables(spark):
    """Over the labelled rows of the held-out fold, which nothing is learned from."""
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    told = {r["doc_id"]: r["toxic"] for r in read("labels").collect() if r["toxic"] is not None}
    docs = read("documents").join(read("labels").select("doc_id").distinct(), "doc_id", "left_semi")
    out = [(x["score"], x["predicted"], told[x["doc_id"]]) for x in toxicity.score_documents(docs, read("labels")).filter("held_out").collect() if x["doc_id"] in told]
    toxic, clean = [x for x in out if x[2]], [x for x in out if not x[2]]
    assert len(toxic) > 20 and len(clean) > 200
    assert sum(p for _, p, _ in toxic) >= 0.9 * len(toxic) and sum(p for _, p, _ in clean) <= 0.02 * len(clean)
    above = sum((a > b) + (a == b) / 2 for a, _, _ in toxic for b, _, _ in clean) / (len(toxic) * len(clean))
    assert above > 0.95


def test_held_out_labels_change_nothing(spark):
    rows, labels = toxic_corpus(200)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    models = [toxicity.learn(frame(spark, rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped)]
    assert models[0] == models[1]


def test_toxicity_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {x["doc_id"]: x["predicted"] for x in toxicity.score_documents(frame(spark, [(1, "you idiot, you moron, you stupid loser"), (2, "a fine day")]), empty).collect()}
    assert out == {1: 1, 2: 0}
    assert toxicity.score_documents(frame(spark, []), empty).count() == 0


# -- personal data --------------------------------------------------------


def plain_base(text):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (13 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


PII = [
    "mail a.b+c@x-y.example.com, or a@b", "at 10.0.0.256 and 010.1.2.255 and 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111111111111111", "+1 (555) 010-9999 and +12 34 and +123456789012345678",
    "é é a@b.c \U0001f600 +49 30 1234567", "", "no data here", "x@y.z" * 50, "1" * 500, "+" * 50 + "1 2",
]


def test_base_spans():
    r = random.Random(14)
    noise = ["".join(r.choice("0123456789.+-() @ab.") for _ in range(60)) for _ in range(400)]
    for t in [*PII, *noise]:
        assert pii.base_spans(t) == plain_base(t), t


def test_personal_data_rows(spark):
    rows = [(i, t) for i, t in enumerate(PII)] + [(None, None), (3, "b@c.de")]
    out = pii.find_personal_data(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {(x["doc_id"], x["base_sha256"]): x for x in out}
    for i, t in rows:
        base = plain_base(t or "")
        told = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        x = by[i, hashlib.sha256(told.encode()).hexdigest()]
        assert [x["n_email"], x["n_ip"], x["n_card"], x["n_phone"]] == [sum(k == j for k, _, _ in base) for j in range(4)]
        assert set(filter(None, told.split(","))) <= set(x["spans"].split(","))
    assert pii.find_personal_data(frame(spark, [])).count() == 0


def test_added_spans_and_held_out_zones():
    w = pii.fitted()
    hit = missed = extra = 0
    for text, gold in pii._generated(4321, 300):
        base, added = pii.find_spans(text, w)
        got, gold = set(base + added), set(gold)
        hit, missed, extra = hit + len(got & gold), missed + len(gold - got), extra + len(got - gold)
    assert hit / (hit + missed) > 0.9 and hit / (hit + extra) > 0.9
    assert pii.find_spans("john.doe [at] example [dot] com", w)[1] == [(0, 0, 31)]
    assert pii.find_spans("call (555) 123-4567 now", w)[1] == [(3, 5, 19)]
    assert pii.find_spans("on 2024-01-15 12:30:45, order 123456789012, look at this. com", w) == ([], [])


#: Written by hand: (text, the spans in it by kind).
BY_HAND = [
    ("You can reach our office at (212) 555-0147 between nine and five.", [(3, "(212) 555-0147")]),
    ("Call me on 415-555-0198 or write to jane.roe [at] example [dot] org.", [(3, "415-555-0198"), (0, "jane.roe [at] example [dot] org")]),
    ("Tél. 01 42 68 53 00, fermé le lundi.", [(3, "01 42 68 53 00")]),
    ("Rufen Sie uns an: 030/1234567, oder kommen Sie vorbei.", [(3, "030/1234567")]),
    ("mobile: 0171 2345678", [(3, "0171 2345678")]),
    ("Her phone is 650.555.0123, she said.", [(3, "650.555.0123")]),
    ("The server answers on 2001:0db8:85a3:0000:0000:8a2e:0370:7334 only.", [(1, "2001:0db8:85a3:0000:0000:8a2e:0370:7334")]),
    ("ping fe80::1ff:fe23:4567:890a before you start", [(1, "fe80::1ff:fe23:4567:890a")]),
    ("contact: max (at) firma (dot) de", [(0, "max (at) firma (dot) de")]),
    ("mail support[at]shop[dot]com for help", [(0, "support[at]shop[dot]com")]),
    ("paid by card 4111.1111.1111.1111 yesterday", [(2, "4111.1111.1111.1111")]),
    ("fax 212-555-0100, phone 212-555-0101", [(3, "212-555-0100"), (3, "212-555-0101")]),
    ("My number's 1-800-555-0199.", [(3, "1-800-555-0199")]),
    ("WhatsApp 0044 207 9460958 any time", [(3, "0044 207 9460958")]),
    ("Your order 20240115 shipped on 2024-01-15 at 12:30:45.", []),
    ("ISBN 978-3-16-148410-0 has 312 pages, printed 1998-2004.", []),
    ("Version 10.2.1345 of build 77812345 fixes ticket 5512345.", []),
    ("We met at noon. dot matrix printers were there at last.", []),
    ("MAC 00:1a:2b:3c:4d:5e on port 8", []),
]


def test_spans_in_texts_written_by_hand():
    w, hit, missed, extra = pii.fitted(), 0, 0, 0
    for text, want in BY_HAND:
        base, added = pii.find_spans(text, w)
        got = {(k, text[s:e]) for k, s, e in base + added}
        hit, missed, extra = hit + len(got & set(want)), missed + len(set(want) - got), extra + len(got - set(want))
    assert hit >= 0.8 * (hit + missed) and hit >= 0.8 * (hit + extra), (hit, missed, extra)


def test_long_tokens_take_time_in_proportion():
    r = random.Random(16)
    for text in ("a" * 10**6 + "1", "a" * 10**6 + "@b", "1" * 10**6, "".join(r.choice("abcABC012+/") for _ in range(10**6)), "a@" * 400_000, "x [at] " + "a" * 10**6 + " dot com"):
        began = time.process_time()
        pii.find_spans(text, pii.fitted())
        assert time.process_time() - began < 10  # 0.1 to 2 s; minutes where a search is quadratic
    assert pii.find_spans("a" * 10**5 + "@b.cd", pii.fitted())[0] == [(0, 0, 10**5 + 5)]


@pytest.mark.parametrize("sep", [" ", "  ", " - "])
def test_long_lists_are_found_whole(sep):
    numbers = [f"555-200-{1000 + k}" for k in range(200)]
    text = sep.join(numbers)
    base, added = pii.find_spans(text, pii.fitted())
    assert base == [] and [text[s:e] for _, s, e in added] == numbers


def test_decoding_against_all_paths():
    r = random.Random(15)
    for _ in range(60):
        n = r.randint(2, 7)
        segments = [(i, j, 0, []) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]
        scores = [r.uniform(-1, 4) for _ in segments]

        def best(at):
            if at >= n - 1:
                return 0.0
            return max([best(at + 1), *(s - pii.MARGIN + best(j) for (i, j, _, _), s in zip(segments, scores) if i == at)])

        got = sum(scores[k] - pii.MARGIN for k in pii.decode(n, segments, scores))
        assert got == pytest.approx(best(0))


def test_redaction(spark):
    out = {x["doc_id"]: x["text"] for x in pii.redact(frame(spark, [(1, "to a@b.cd, ip 1.2.3.4."), (2, None), (3, "")])).collect()}
    assert out == {1: "to <email>, ip <ip>.", 2: None, 3: ""}


def test_counts_of_words_are_in_few_files(spark, tmp_path, monkeypatch):
    rows, labels = toxic_corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(storage, "stage_folder", lambda spark: f"file://{tmp_path}")
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        toxicity.learn(frame(spark, rows), table)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 1 <= len(list(tmp_path.glob("words-*/part-*"))) <= 16
