"""What the quality rules and the language stage have to reject."""

import random

from seqmine.llm import stages
from seqmine.llm.op4_quality import assess

DATA = "/root/testdata/sf0.01"
POLISH = """Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni
postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej Deklaracji bez względu na
różnice rasy, koloru, płci, języka, wyznania, poglądów politycznych i innych przekonań, narodowości, pochodzenia społecznego, majątku, urodzenia
lub jakiegokolwiek innego stanu. Nie wolno ponadto czynić żadnej różnicy w zależności od sytuacji politycznej, prawnej lub międzynarodowej kraju
lub obszaru, do którego dana osoba przynależy. Każdy człowiek ma prawo do życia, wolności i bezpieczeństwa swej osoby. Nie wolno nikogo czynić
niewolnikiem ani nakładać na nikogo służebności. Nie wolno nikogo torturować lub karać w sposób okrutny."""


def test_quality_rejects_texts_without_common_words(spark):
    rnd = random.Random(3)
    keys = ["cheap", "hotel", "flights", "booking", "insurance", "mortgage", "casino", "loans", "credit", "online", "travel", "holiday", "discount", "airline", "rental", "luxury", "resort", "voucher", "bonus", "poker"]
    listed = " ".join(rnd.choice(keys) for _ in range(240))
    salad = " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(3, 8))) for _ in range(240))
    rows = [(1, listed), (2, salad), (3, POLISH), (4, " ".join("слово" + chr(1072 + i % 30) * (i % 5) + str(i) for i in range(200)))]
    got = {r["doc_id"]: r for r in assess(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert not got[1]["kept"] and not got[2]["kept"] and got[3]["kept"] and got[3]["word_distance"] > 0.2


def test_language_stage_rejects_what_no_language_fits(spark):
    rnd = random.Random(1)
    salad = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(60))
    english = "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience."
    rows = [(-1, salad, None), (-2, POLISH, None), (-3, "Все люди рождаются свободными и равными", None), (-4, english, None), (-5, None, None), (-6, "12 34", None)]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for langs in (["en"], ["en", "de", "fr"], ["en", "de", "fr", "es"]):
        out = stages.language(docs.where(docs.lang.isin(langs)).unionAll(own))
        assert [r["doc_id"] for r in out.where("doc_id < 0").collect()] == [-4], langs


def test_language_stage_without_a_model(spark):
    rows = [(1, "a word", None), (2, None, None), (3, "12 !", None), (4, "é", None)]
    out = stages.language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 4]
