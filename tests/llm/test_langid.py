"""Held-out accuracy of the language, and what is rejected."""

import pytest
from pyspark.sql import functions as F

from lacuna.llm import langid
from lacuna.llm.queries import QUERIES, table

FOREIGN = {
    "pl": "W sobotę rano wszyscy mieszkańcy wsi poszli na targ, żeby kupić świeże warzywa i porozmawiać o pogodzie, która była w tym roku wyjątkowo zła. "
    "Dzieci biegały między straganami, a starsi ludzie siedzieli na ławkach i wspominali dawne czasy, kiedy życie było prostsze.",
    "fi": "Lauantaiaamuna kaikki kylän asukkaat menivät torille ostamaan tuoreita vihanneksia ja juttelemaan säästä, joka oli tänä vuonna poikkeuksellisen huono. "
    "Lapset juoksivat kojujen välissä, ja vanhat ihmiset istuivat penkeillä ja muistelivat menneitä aikoja, jolloin elämä oli yksinkertaisempaa.",
    "ru": "В субботу утром все жители деревни пошли на рынок, чтобы купить свежие овощи и поговорить о погоде.",
    "zh": "星期六早上村里的人都去市场买新鲜蔬菜并谈论天气",
    "junk": "zxqv kjwz qqxz vvkw zzxj wqkx jjvz kxqz vwzq xkjq zqvx wkzj " * 4,
}


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(langid.training_rows(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")))


def test_held_out_accuracy_and_clean_texts_stay(spark, model):
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("lang IS NOT NULL")
    held = docs.where(langid.crc_remainder(F.col("doc_id"), 4) == 2)
    rows = model.predict(held.select("lang", "text")).select("lang", "lang_pred", "rejected").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert sum(r.rejected for r in rows) <= 0.005 * len(rows)


def test_foreign_texts_are_rejected(spark, model):
    docs = spark.createDataFrame(list(FOREIGN.items()), "name string, text string")
    found = {r.name: r for r in model.predict(docs).collect()}
    assert {n for n, r in found.items() if not r.rejected} == set()


def test_defined_cases(spark, model):
    rows = [(1, None), (2, ""), (3, "123 -- 456"), (4, "the " * 400_000), (5, "The cat"), (5, "The cat")]
    found = [r for r in model.predict(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(found) == 6
    for r in found:
        if r.doc_id <= 3:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        assert 0 <= r.score <= 1
    assert model.predict(spark.createDataFrame([], "text string")).count() == 0


def test_nothing_to_learn_from(spark):
    empty = langid.fit(spark.createDataFrame([("x", None), (None, "en"), ("1", "en")], "text string, lang string"))
    found = empty.predict(spark.createDataFrame([("some text",)], "text string")).first()
    assert (found.lang_pred, found.score, found.rejected) == ("und", 0.0, True)


def test_columns_with_clashing_names(spark, model):
    docs = spark.createDataFrame([("some text of words", 1, 2, 3)], "text string, _letters int, score int, `a.b` int")
    found = model.predict(docs)
    assert found.columns == ["text", "_letters", "a.b", "lang_pred", "score", "rejected"]
    assert found.first()["_letters"] == 1


def test_query(spark):
    found = QUERIES["op8_language"].run(spark, "/root/testdata/sf0.001")
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and found.count() == 200


def test_the_driver_gets_no_vectors_of_texts(spark, monkeypatch):
    """Bytes of the tables that reach the driver: those of the centroids, whatever the sample."""
    taken, kind = [], type(spark.range(0))
    for name in ("collect", "toPandas"):
        def spy(self, *args, take=getattr(kind, name)):
            out = take(self, *args)
            rows = out if isinstance(out, list) else out.itertuples(index=False)
            taken.append(sum(len(x) for r in rows for x in r if isinstance(x, (bytes, bytearray))))
            return out

        monkeypatch.setattr(kind, name, spy)
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    model = langid.fit(langid.training_rows(docs))
    assert len(model.centroids) == 4 * len(set(model.languages))
    assert sum(taken) < 1.5 * model.centroids.nbytes
