import random

from skyloom.llm.encoding import CHAINS, repair_encoding, undo

FR = ["Le décalage mesuré près de l’étoile était très élevé", "La fenêtre d’observation a été décalée après l’été", "Où était la dérive répétée à côté du relevé"]
PL = ["Jasność gwiazdy spadła później wzrosła", "Część klatek odrzucono, ponieważ światło było zbyt słabe", "Prędkość i błąd określono"]
RU = ["Яркость упала затем выросла", "Прибор остановлен после ветра", "Каталог содержит записей лишь"]
SCHEMA = "doc_id bigint, text string, source string, chains int"


def corpus(rng):
    return [(i, ". ".join(rng.choice(group) for _ in range(4)) + ".", rng.choice(["a", "B-c", None]), 1) for i, group in enumerate([FR, PL, RU] * 100)]


def test_round_trips():
    for text, chain, steps in [("éà", "utf8>west", ("utf-8", "latin-1")), ("ęść", "utf8>cp1250", ("utf-8", "cp1250")), ("Яркость", "cp1251>west", ("cp1251", "latin-1")), ("Яркость", "koi8>cp1251", ("koi8-r", "cp1251"))]:
        assert undo(text.encode(steps[0]).decode(steps[1]), chain) == text
    assert undo("é", "utf8>west") is None and "lost" in CHAINS


def test_finds_and_repairs(spark):
    rng = random.Random(8)
    rows = corpus(rng)
    damage = {
        0: lambda t: t.encode().decode("latin-1"), 3: lambda t: t.encode().decode("latin-1").encode().decode("latin-1"),
        1: lambda t: t.encode("cp1250", "replace").decode("latin-1"), 2: lambda t: t.encode("koi8-r").decode("cp1251"), 5: lambda t: t.encode("cp1251").decode("latin-1"),
        6: lambda t: t.encode().decode("mac_roman"), 9: lambda t: t.encode("latin-1", "ignore").decode("utf-8", "replace"),
    }
    clean = {i: t for i, t, *_ in rows}
    for i in (0, 9):
        clean[i] = clean[i].replace("’", "'")
    rows = [(i, damage[i](clean[i]) if i in damage else t, s, c) for i, t, s, c in rows]
    quoted = (900, "If the page shows “Ã©” instead of “é”, reload it. Ask for Ã¼ there.", "a", 1)
    rows += [quoted, (901, None, "a", 1), (902, "", None, 1), (903, "plain " * 20_000, "a", 1), (904, rows[0][1], "a", 1), (905, "Часть ОБЪЕКТА: ЯРКОСТЬ УПАЛА.", "a", 1)]
    got = {r["doc_id"]: r for r in repair_encoding(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) - {900} == set(damage) | {904}
    for i in (0, 2, 3, 5, 6):
        assert got[i]["text"] == clean[i] and got[i]["restored"]
    assert not got[9]["restored"] and got[904]["text"] == got[0]["text"]
    part = "été. " + "Rien ici. " * 3 + "Le relevé était décalé.".encode().decode("latin-1")
    more = {r["doc_id"]: r["text"] for r in repair_encoding(spark.createDataFrame([*rows, (950, part, "a", 1)], SCHEMA)).collect()}
    assert more[950] == "été. " + "Rien ici. " * 3 + "Le relevé était décalé."


def test_empty(spark):
    assert repair_encoding(spark.createDataFrame([], SCHEMA)).count() == 0
    assert repair_encoding(spark.createDataFrame([(1, None, None, 1), (2, "abc", "x", 1)], SCHEMA)).count() == 0
