import random

import numpy as np

from skyloom.llm.leaks import WORD, Codes, FMIndex, Items, find_leaks, prepare, reduce, removal_spans, suffix_array

DOC, ITEM = "doc_id bigint, text string, item_id string, words int", "item_id bigint, text string, doc_id int"


def sentence(rng, n):
    return " ".join(rng.choice(["".join(rng.choice("abcdefghij") for _ in range(5)), str(rng.randrange(100, 9999))]) for _ in range(n))


def test_index_against_brute_force():
    rng = np.random.default_rng(1)
    for n in (1, 7, 150):
        s = np.r_[np.tile(rng.integers(0, 4, n), 2), 7]
        assert list(suffix_array(s)) == sorted(range(len(s)), key=lambda i: list(s[i:]))
        ask = rng.integers(0, 4, (9, 3))
        a, b = FMIndex(s, 3).search(ask)
        assert sorted(zip(a.tolist(), b.tolist())) == sorted((k, i) for k in range(9) for i in range(len(s) - 2) if list(s[i : i + 3]) == list(ask[k]))


def test_words():
    words = lambda t: [reduce(w) for w in WORD.findall(prepare(t)) if w[0] != "<"]
    assert words("Été <b>in</b>&nbsp;the bogus-\nline 3.5 Ã©tÃ© *x* ″ d&eacute;j&agrave;") == ["t", "in", "the", "bogusline", "3", "5", "t", "x", "~", "dj"]


def test_finds_whole_partial_and_altered_passages(spark):
    rng = random.Random(9)
    item = [sentence(rng, 50) for _ in range(3)] + ["one short item 77 of nine words in all 12"]
    fill = lambda n=80: sentence(rng, n)
    w = item[0].split()
    altered = list(w[10:40])
    for k in (5, 14, 22):
        altered[k] = "changed"
    altered.insert(18, "extra")
    docs = {
        1: fill() + " " + item[0] + " " + fill(), 2: fill() + " " + " ".join(w[20:42]) + " " + fill(), 3: fill() + " " + " ".join(w[20:34]) + " " + fill(), 4: " ".join(altered) + " " + fill(),
        5: item[1].upper().replace(" ", ",\n> "), 6: item[2] + " " + item[0], 7: fill(), 8: None, 9: "", 10: "a b", 11: fill(3000) + " " + item[3], 12: item[3].replace("nine words", "no"), 13: fill(300_000),
    }
    docs[14] = docs[1]
    rows = [(i, t, "x", 1) for i, t in docs.items()]
    its = spark.createDataFrame([(i, t, 1) for i, t in enumerate(item)] + [(8, None, 1), (9, "", 1)], ITEM)
    leaks = find_leaks(spark.createDataFrame(rows, DOC), its)
    got = {(r["doc_id"], r["item_id"]): r for r in leaks.collect()}
    assert set(got) == {(1, 0), (14, 0), (2, 0), (4, 0), (5, 1), (6, 2), (6, 0), (11, 3)}
    r = got[1, 0]
    assert docs[1][r["span_start"] : r["span_end"]] == item[0] and r["words"] == 50
    spans = {r["doc_id"]: r for r in removal_spans(leaks).collect()}
    assert len(spans) == 7 and spans[6]["items"] == [0, 2] and (spans[6]["span_start"], spans[6]["span_end"]) == (0, len(docs[6]))


def test_empty(spark):
    d, i = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    assert find_leaks(d, i).count() == 0
    assert find_leaks(spark.createDataFrame([(1, "a b c d e f g", "x", 1)], DOC), i).count() == 0
    assert removal_spans(find_leaks(d, spark.createDataFrame([(1, "a b c d e f g h", 1)], ITEM))).count() == 0


def test_other_scripts_are_found_word_for_word_and_damaged(spark):
    rng = random.Random(5)
    cyrillic = lambda n: " ".join("".join(rng.choice("абвгдежзиклмнопрст") for _ in range(6)) for _ in range(n))
    latin = sentence(rng, 60).split()
    item = [cyrillic(60), " ".join(x for pair in zip(cyrillic(30).split(), latin) for x in pair), "観測 記録 " * 3 + " ".join(chr(0x4E00 + k) + chr(0x5E00 + k) for k in range(30))]
    w = item[0].split()
    docs = [
        cyrillic(40) + " " + " ".join(w[15:35]) + " " + cyrillic(40), cyrillic(90), " ".join(w[20:34]) + " " + cyrillic(40),
        item[1].encode().decode("latin-1"), sentence(rng, 50), sentence(rng, 50) + " " + " ".join(item[2].split()[5:26]),
    ]
    leaks = find_leaks(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(docs)], DOC), spark.createDataFrame([(i, t, 1) for i, t in enumerate(item)], ITEM))
    got = {(r["doc_id"], r["item_id"]): r for r in leaks.collect()}
    assert set(got) == {(0, 0), (3, 1), (5, 2)}
    assert docs[0][got[0, 0]["span_start"] : got[0, 0]["span_end"]] == " ".join(w[15:35])


def test_three_altered_words_in_twenty(spark):
    rng = random.Random(11)
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) if k % 5 else str(rng.randrange(1000, 9999)) for k in range(60))
    w, docs = item.split(), []
    for altered in ((1, 7, 18), (4, 9, 14), (6, 11, 17), (1, 2, 3), (16, 17, 18), (1, 7, 13, 16), (1, 4, 8, 12, 17)):  # every fifth from 0 on is a figure
        own = w[20:40]
        for k in altered:
            own[k] = "zz" + "qrstuv"[k % 6] * 3
        docs.append(sentence(rng, 40) + " " + " ".join(own) + " " + sentence(rng, 40))
    found = find_leaks(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(docs)], DOC), spark.createDataFrame([(0, item, 1)], ITEM))
    assert {r["doc_id"] for r in found.collect()} == {0, 1, 2, 3, 4}


def test_short_items_are_found_as_they_stand_and_items_go_in_groups(spark):
    docs = [(0, "Ask about Kepler-22 b tonight.", "x", 1), (1, "kepler 22 B", "x", 1), (2, "kepler 23 b", "x", 1), (3, "Звезда, да", "x", 1), (4, "one", "x", 1), (5, "!", "x", 1)]
    items = [(1, "Kepler-22 b", 1), (2, "звезда да", 1), (3, "ONE", 1), (4, "--", 1), (5, "two words", 1)]
    for chars in (20_000_000, 30):
        found = find_leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), group_chars=chars)
        assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(0, 1), (1, 1), (3, 2), (4, 3)]


def test_codes_are_those_of_the_items():
    items = Items([(1, "Alpha 7 звезда β")], 20)
    table = Codes(items.vocabulary)
    assert table.of("alpha <b> 7, звезда β").tolist() == items.codes[0].tolist() and table.of("other иное").tolist() == [0, 3]
