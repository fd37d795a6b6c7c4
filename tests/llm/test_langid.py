"""Operator 6: held-out accuracy, rejection and edge cases."""

import base64
import random
import zlib

import numpy as np

from pitchside.llm import langid
from pitchside.llm.queries import REGISTRY


def test_held_out_accuracy(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = REGISTRY["op6_langid"](spark, sf_dir).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert not any(r.rejected for r in got)


def test_edges(spark):
    rows = [(i, f"the and of thing {i}", "en", 1.0) for i in range(40)] + [(100 + i, f"der die das und {i}", "de", 2.0) for i in range(40)]
    rows += [(None, "the thing", None, 0.0), (1, None, "en", 0.0), (2, "", "en", 0.0), (3, "123 ?!", "de", 0.0), (4, "東京都 中国語", None, 0.0),
             (5, "das und " * 50_000, None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score_ double")
    model = langid.fit(docs)
    got = {(r.doc_id, r.text[:12] if r.text else r.text): r for r in langid.predict(docs, model).collect()}
    assert {r.lang_pred for r in got.values()} == {"en", "de", "und"}
    for key in ((1, None), (2, ""), (3, "123 ?!")):
        assert (got[key].lang_pred, got[key].score, got[key].rejected) == ("und", 0.0, True)
    assert got[None, "the thing"].lang_pred == "en" and not got[None, "the thing"].rejected
    assert got[5, "das und das "].lang_pred == "de"
    assert got[4, "東京都 中国語"].rejected and got[4, "東京都 中国語"].lang_pred in ("en", "de")


def test_a_language_of_copies_is_learned(spark):
    page = [(i, "una pagina repetida de la casa", "es") for i in range(60_000)]
    junk = [(100_000 + i, f"{i} ?!", "de") for i in range(60_000)]
    rows = [(200_000 + i, f"la casa grande y el perro {chr(97 + i)}", "es") for i in range(20)]
    rows += [(300_000 + i, f"der hund und das haus {chr(97 + i)}", "de") for i in range(20)]
    rows += [(400_000 + i, f"the dog and the house {chr(97 + i)}", "en") for i in range(20)]
    model = langid.fit(spark.createDataFrame(page + junk + rows, "doc_id long, text string, lang string"), sample=8)
    assert set(model.langs) == {"de", "en", "es"}
    asked = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r.lang_pred == r.lang for r in langid.predict(asked, model).collect())


def test_long_junk_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    model, rnd = langid.fit(docs), random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 10)))
    junk = [" ".join(word() for _ in range(k)) for k in (30, 100, 300, 1000)]
    junk += [base64.b64encode(rnd.randbytes(3000)).decode(),
             "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, "
             "ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
             "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı "
             "kardeşlik zihniyeti ile hareket etmelidirler."]
    got = langid.predict(spark.createDataFrame(list(enumerate(junk)), "doc_id long, text string"), model).collect()
    assert [r.doc_id for r in got if not r.rejected] == []
    said = langid.predict(docs, model).select("rejected", "text").collect()
    assert sum(r.rejected for r in said) <= 0.001 * len(said)
    assert not any(r.rejected for r in said if len(r.text.split()) == 1)


def test_no_single_word_is_rejected_at_any_size(spark):
    """What is kept does not depend on how much there is to learn from."""
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text", "lang")
        out = langid.predict(docs, langid.fit(docs)).collect()
        assert not any(r.rejected for r in out if r.text and len(r.text.split()) == 1 and any(c.isalpha() for c in r.text)), sf


def test_clashing_columns(spark):
    rows = [(i, f"the and of thing {i}", "en", "x", 7.0, 1) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double, rejected int")
    out = langid.predict(docs, langid.fit(docs))
    assert sorted(out.columns) == sorted(docs.columns) and {r.lang_pred for r in out.collect()} == {"en"}
    assert langid.predictions(docs).count() == 30
    named = langid.predict(docs.withColumn("_said", docs.doc_id), langid.fit(docs)).collect()
    assert all(r["_said"] == r.doc_id for r in named)


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.rejected) for r in langid.predictions(docs).collect()] == [("und", True)]
    assert langid.predictions(docs.limit(0)).count() == 0


def test_clusters_separate():
    x = np.eye(6, dtype="f4")[[0, 0, 1, 1, 2, 2, 2]] + 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = langid.clusters_of(x, 3)
    assert sorted((x @ c.T).argmax(axis=1).tolist().count(i) for i in range(3)) == [2, 2, 3]
