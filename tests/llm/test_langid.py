import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import langid
from sparkloom.llm import queries_langid
from sparkloom.llm.langid import UNDETERMINED, codewords, drop_rejected, held_out, learned, log_odds, logistic, noisy, train, with_language

DATA = "/root/testdata/sf0.01/documents.parquet"


def plain_grams(data):
    b = [int(langid.FOLD[x]) for x in data]
    pairs = [b[i] * 256 + b[i + 1] for i in range(len(b) - 1)]
    triples = [langid.SIZE + (((b[i] * 65536 + b[i + 1] * 256 + b[i + 2]) * 2654435761) % 2**32 >> 16) for i in range(len(b) - 2)]
    return pairs + triples


def test_log_odds_against_a_loop(monkeypatch):
    monkeypatch.setattr(langid, "CHUNK", 7)
    w = np.random.default_rng(0).normal(size=(2 * langid.SIZE, 3)).astype(np.float32)
    texts = [b"", b"a", b"ab", b"Hello World", "é日本".encode(), b"x" * 50, b"", b"1 2 3"]
    at = np.cumsum([0, *map(len, texts)])
    got = log_odds(w, np.frombuffer(b"".join(texts), np.uint8), at)
    for t, g in zip(texts, got, strict=True):
        own = plain_grams(t)
        assert np.allclose(g, w[own].mean(0) if own else 0, atol=1e-5)
        share = langid.counts(np.frombuffer(t, np.uint8))
        assert np.allclose(share[np.unique(own)] if own else 0, np.bincount(own, minlength=2 * langid.SIZE)[np.unique(own)] / max(1, len(own)) if own else 0)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 11])
def test_codewords_differ(n):
    code = codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n and (n == 1 or all(len(set(c)) == 2 for c in code.T.tolist()))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    got = with_language(docs, model).filter(held_out(F.col("doc_id"))).collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet(DATA)
    wrong = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = (train(d.filter(~held_out(F.col("doc_id")))) for d in (docs, wrong))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_odd_rows(spark, docs_of, odd):
    model = train(spark.read.parquet(DATA))
    got = with_language(docs_of(odd), model).collect()
    assert len(got) == len(odd) and set(docs_of(odd).columns) <= set(got[0].asDict())
    for r in got:
        letter = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == UNDETERMINED) == (not letter) and (letter or (r.score == 0 and r.ambiguous))
    same = [r for r in got if r.doc_id is None]
    assert same[0].lang_pred == same[1].lang_pred


def test_few_languages(docs_of):
    for rows, name in (([(1, "abc", None), (2, None, "en"), (3, "", "en")], UNDETERMINED), ([(1, "abc", "en"), (2, "x", None)], "en")):
        got = with_language(docs_of(rows), train(docs_of(rows))).collect()
        assert {r.lang_pred for r in got if r.text} == {name}
    assert train(docs_of([])) is None and with_language(docs_of([]), None).count() == 0


def test_language_of_few_texts_in_many_copies(spark, prose):
    few = [(prose(k, 20), "de") for k in range(5)]
    rows = spark.createDataFrame([(prose(100 + k, 20), "en") for k in range(60)] + few, "text string, lang string")
    copies = rows.withColumn("times", F.when(F.col("lang") == "de", 5000).otherwise(1))
    docs = copies.select(F.explode(F.sequence(F.lit(1), "times")).alias("doc_id"), "text", "lang")
    taught = [r.lang for r in langid.sampled(docs, "text", "lang", 20).collect()]
    assert taught.count("de") == 5 and 5 <= taught.count("en") <= 40


def test_rows_that_stay(docs_of, prose):
    rows = [(i, prose(i), "en" if i % 2 else "de") for i in range(30)] + [(99, "123 !!"), (98, None), (97, "ü")]
    left = drop_rejected(docs_of(rows))
    assert left.columns == docs_of(rows).columns
    assert sorted(r.doc_id for r in left.collect()) == [*range(30), 97]


def test_noise_is_rejected_and_clean_texts_stay(spark):
    clean = spark.read.parquet(DATA).select("doc_id", "text", "lang")
    noise = ["1 " * 200 + "q" + " 7" * 200, "#$%^ &*() " * 50 + "z", "4f0a9 77b1e " * 30, "zxqv wkjp qqzt vvxk " * 20]
    planted = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(noise)], clean.schema)
    got = {r.doc_id for r in drop_rejected(clean.unionByName(planted)).collect()}
    assert got == {r.doc_id for r in clean.filter("text rlike '\\\\p{L}'").collect()}


def test_without_labels_documents_with_letters_stay(docs_of, prose):
    rows = [(i, prose(i)) for i in range(5)] + [(9, "123 !!"), (8, None)]
    assert sorted(r.doc_id for r in drop_rejected(docs_of(rows)).collect()) == [*range(5)]


def test_texts_of_two_languages_stay(spark):
    clean = spark.read.parquet(DATA).select("doc_id", "text", "lang")
    by = {r.lang: r.text for r in clean.filter("length(text) between 600 and 3000").dropDuplicates(["lang"]).collect()}
    mixed = [(-10 - k, (by["en"][:700] + " " + by[lang][:700]), "en") for k, lang in enumerate(("de", "fr", "es"))]
    many = [(-100 - k, " ".join(r.text for r in pair), pair[0].lang) for k, pair in enumerate(zip(clean.filter("lang = 'en'").limit(40).collect(), clean.filter("lang = 'de'").limit(40).collect()))]
    got = {r.doc_id for r in drop_rejected(clean.unionByName(spark.createDataFrame(mixed + many, clean.schema))).collect()}
    assert {m[0] for m in mixed + many} <= got


def slow_model(rows):
    """Weights, scale, shift and trust of (lang, text) rows, text by text in plain arrays."""
    languages = sorted({x for x, _ in rows})
    shares = [langid.counts(np.frombuffer(t.encode(), np.uint8)) for _, t in rows]
    mean = np.array([np.mean([s for (x, _), s in zip(rows, shares) if x == name], axis=0) for name in languages]) + 1e-6
    code, out = codewords(len(languages)), []
    for c in code.T:
        w = np.clip(np.log(mean[c > 0].mean(0) / mean[c < 0].mean(0)), -4, 4)
        x, y = np.array([w @ s for s in shares]), np.array([c[languages.index(n)] for n, _ in rows])
        a, b = logistic(x, y)
        out.append((w, a, b, ((x * a + b > 0) == (y > 0)).mean()))
    return languages, out


def test_learning_against_a_loop(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(DATA.replace("0.01", "0.001")).filter("length(text) > 0 and length(text) < 2000").dropDuplicates(["text"]).collect()]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(5)
    model, limit = learned(docs)
    languages, bits = slow_model(rows)
    assert model.languages == languages and 0 < limit < np.inf
    for b, (w, scale, shift, right) in enumerate(bits):
        assert np.allclose(model.weights[:, b], w, atol=1e-4)
        assert np.allclose([model.scale[b], model.shift[b]], [scale, shift], rtol=1e-2, atol=1e-2)
    again = learned(docs.repartition(2))
    assert np.array_equal(again[0].weights, model.weights)


def test_what_comes_to_the_driver_does_not_grow_with_texts(spark, prose):
    for size in (50, 5000):
        rows = [(i, prose(i, size), "en" if i % 2 else "de") for i in range(12)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        chosen = langid.sampled(docs, "text", "lang", 1000)
        assert langid.gram_sums(chosen).count() <= 4 * 2 * langid.SIZE
        assert {len(r.odds) for r in langid.odds_of(chosen, np.zeros((2 * langid.SIZE, 3), np.float32)).collect()} == {3}


#: Natural paragraphs: some words of everyday prose in languages with and without labels in the test tables.
NATURAL = {
    "cs": "Dnes ráno jsme šli do lesa a hledali houby. Bylo tam ticho a mlha ležela mezi stromy. Když vyšlo slunce, sedli jsme si na pařez a jedli chléb se sýrem.",
    "la": "Puella in horto ambulat et flores pulchros spectat. Mater eius cenam parat, pater autem ex urbe nondum venit. Servi aquam e fonte portant.",
    "fi": "Aamulla menimme metsään etsimään sieniä. Siellä oli hiljaista ja sumu lepäsi puiden välissä. Kun aurinko nousi, istuimme kannolle ja söimme leipää.",
    "pl": "Rano poszliśmy do lasu szukać grzybów. Było tam cicho, a mgła leżała między drzewami. Kiedy wzeszło słońce, usiedliśmy na pniu i jedliśmy chleb z serem.",
    "ru": "Утром мы пошли в лес искать грибы. Там было тихо, и туман лежал между деревьями. Когда взошло солнце, мы сели на пень и ели хлеб с сыром.",
    "zh": "今天早上我们去树林里找蘑菇。那里很安静，树木之间有雾。太阳出来以后，我们坐在树桩上吃面包和奶酪，然后慢慢走回家。",
    "it": "Stamattina siamo andati nel bosco a cercare funghi. C'era silenzio e la nebbia stava tra gli alberi. Quando è sorto il sole ci siamo seduti a mangiare.",
    "de": "Heute Morgen gingen wir in den Wald, um Pilze zu suchen. Dort war es still, und Nebel lag zwischen den Bäumen. Dann aßen wir Brot mit Käse.",
    "en": "This morning we went to the woods to look for mushrooms. It was quiet there and fog lay between the trees. We sat on a stump and ate bread.",
    "ar": "ذهبنا هذا الصباح إلى الغابة للبحث عن الفطر. كان المكان هادئا والضباب بين الأشجار. وعندما أشرقت الشمس جلسنا وأكلنا الخبز والجبن.",
    "th": "เช้านี้เราไปที่ป่าเพื่อหาเห็ด ที่นั่นเงียบสงบและมีหมอกอยู่ระหว่างต้นไม้ เมื่อดวงอาทิตย์ขึ้นเรานั่งกินขนมปังกับชีส",
}


def test_natural_texts_stay_with_and_without_labels(spark):
    clean = spark.read.parquet(DATA).select("doc_id", "text", "lang")
    texts = [*NATURAL.values(), *(" ".join([t] * 3) for t in NATURAL.values()), "Krk.", "Mr", "q", "日本", "strč prst skrz krk"]
    planted = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(texts)], clean.schema)
    got = {r.doc_id for r in drop_rejected(clean.unionByName(planted)).select("doc_id").collect()}
    assert {-1 - k for k in range(len(texts))} <= got


def test_noise_by_itself():
    r = random.Random(8)
    random_letters = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(120))
    for text in ("asdf jkl; " * 60, "zxqv wkjp qqzt vvxk " * 20, "4f0a9 77b1e " * 30, "1 " * 200 + "q" + " 7" * 200, "#$%^ &*() " * 50 + "z", random_letters, "sdfg hjkl wrtp dfgh jklm cvbn qwrt zxcv mnbv lkjh"):
        assert noisy(text)
    for text in [*NATURAL.values(), "", "a", "Mr. T", "x1", "tsk tsk", "A B C", "http://a.b/c?d=1"]:
        assert not noisy(text)


def test_query(spark):
    """Rows as the contract names them, and held-out labels."""
    data = DATA.rsplit("/", 1)[0]
    got = queries_langid.op7_langid(spark, data)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(DATA).collect()}
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth) and got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    asked = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in asked) > 0.97 * len(asked) and {r.lang_pred for r in rows} <= {*truth.values(), UNDETERMINED}
