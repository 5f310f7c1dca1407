import numpy as np
import plain

from loomshift.llm import language, queries

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = queries.op3_language(spark, DATA).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = out[out.held_out]
    print(len(held), (held.lang_pred == held.lang).mean(), out.rejected.sum())
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert (held.lang_pred == held.lang).mean() > 0.97 and out.rejected.mean() < 0.002


def test_foreign_and_junk_documents_go(spark):
    foreign = [
        "De regering heeft vandaag besloten dat alle scholen in het land weer opengaan, zodat de kinderen naar hun klas kunnen gaan en de ouders weer kunnen werken.",
        "Hallitus päätti tänään että kaikki maan koulut avataan uudelleen jotta lapset pääsevät takaisin luokkiinsa ja vanhemmat voivat palata töihinsä.",
        "Rząd postanowił dzisiaj, że wszystkie szkoły w kraju zostaną ponownie otwarte, aby dzieci mogły wrócić do swoich klas, a rodzice znowu mogli pracować.",
        "政府今天决定全国所有学校重新开放，孩子们可以回到教室，家长们也可以像以前一样继续工作。" * 3,
        "Правительство сегодня решило, что все школы страны снова откроются, чтобы дети могли вернуться в классы.",
        "xqzvk jwpqx zzkqj vxwqz kqjxz " * 8,
        "0x7f ### 55 -- 12" * 20,
        "zzkqj vxwqz",
    ]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    planted = spark.createDataFrame([(9_000_000 + i, t, "en", "s", len(t)) for i, t in enumerate(foreign * 2)], docs.schema)
    kept = language.keep_identified(docs.unionByName(planted), queries.language_model(docs))
    assert kept.where("doc_id >= 9000000").count() == 0 and kept.count() >= 0.998 * docs.count()


def test_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["the cat and the dog"] * 10 + ["½", "²", "Ⅳ", "①", "½ a", "12"])], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(docs, language.fit(docs)).collect()}
    assert [got[i].lang_pred for i in range(10, 16)] == ["und", "und", "und", "und", "en", "und"] and got[11].score == 0


def test_cosines_and_verdicts_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = queries.language_model(docs)
    texts = [r.text for r in docs.limit(150).collect()] + ["", "12", "a", "ça va", "zzkqj vxwqz"]
    best, near, fine = language.nearest(texts, model)
    for t, b, x, ok in zip(texts, best, near, fine, strict=True):
        if any(c.isalpha() for c in t):
            cosines, _ = plain.trigram_cosines(t, model)
            assert np.isclose(x, max(cosines), atol=1e-4) and np.isclose(cosines[b], max(cosines), atol=1e-4)
        assert ok == plain.accepted(t, model)


def test_repeated_texts_and_the_bound_of_a_language(spark):
    docs = spark.createDataFrame([(None, "the cat and the dog", "en")] * 300 + [(i, f"the bird number {chr(97 + i % 26)}{chr(97 + i // 26)} sings", "en") for i in range(200)], "doc_id long, text string, lang string")
    model = language.fit(docs, per_language=50)
    assert model.names and set(model.names) == {"en"}
    assert language.identify(docs, model).where("lang_pred = 'en'").count() == 500


def test_nulls_letterless_texts_and_empty_tables(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    rows += [(90, None, "en"), (91, "", None), (92, "12 34 !?", "de"), (93, "und die katze " * 20_000, None), (94, "猫と犬が好きです。" * 40, None)]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, rejected boolean")
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 90, 91, 92, 93)] == ["en", "de", "und", "und", "und", "de"]
    assert got[90].rejected and got[92].rejected and got[94].rejected and not got[93].rejected
    assert {r.doc_id for r in language.keep_identified(docs, model).collect()} == {*range(40), 93}
    none = language.fit(docs.limit(0))
    assert language.identify(docs, none).where("lang_pred = 'und' and rejected").count() == 45
    assert language.identify(docs.limit(0), model).count() == 0 and language.keep_identified(docs, none).count() == 0


def test_trigram_counts_equal_a_plain_loop():
    texts = ["Ab, c!", "é x"]
    found = language.counts_of(texts)
    for t, row in zip(texts, found, strict=True):
        b = "".join(c if c.isalpha() else " " for c in f" {t.lower()} ").encode()
        while b"  " in b:
            b = b.replace(b"  ", b" ")
        assert row.sum() == len(b) - 2
