import random
import zlib
from collections import Counter

import zstandard

from tallyweave.llm import langid

TONGUES = {"xa": "abcdelmn", "yb": "opqrstuv", "zc": "aeiouxyz"}
WORDS = {lang: ["".join(random.Random(f"{lang}{k}").choice(letters) for _ in range(2 + k % 6)) for k in range(90)] for lang, letters in TONGUES.items()}


def spoken(lang, n):
    return " ".join(random.choice(WORDS[lang]) for _ in range(n))


def classified_by_brute_force(dictionaries, text):
    """Language and acceptance from fresh compressors, one text at a time."""
    plain = langid.letters(text)
    if not plain:
        return "und", False

    def pressed(data, lang, level):
        raw = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=level)
        return len(zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))

    size = {lang: sum(pressed(plain[i : i + 2048], lang, 3) for i in range(0, len(plain), 2048)) for lang in dictionaries}
    one, two = sorted(size.values())[:2]
    sure = two - one > 0.02 * two
    if not sure and len(plain) <= 256:
        behind = langid.carriers(dictionaries)
        size = {lang: sum(pressed(c + plain[1:], lang, 19) - pressed(c, lang, 19) for c in behind) for lang in dictionaries}
        one, two = sorted(size.values())[:2]
        sure = two - one > 0.05 * two
    return min(sorted(size), key=size.__getitem__), sure


def test_letters_keep_marks_and_only_letters_count():
    assert langid.letters("½ ² Ⅷ ①② 12 _-") == b"" and langid.letters(None) == b"" and langid.letters("") == b""
    assert langid.letters("\u0301 \u093f") == b""  # marks alone are no letter
    assert langid.letters("हिन्दी, भाषा 7 Ⅷ").decode() == " हिन्दी भाषा "
    assert langid.letters("E\u0301a B_c4D").decode() == " e\u0301a b c d "


def test_choice_equals_brute_force(spark):
    random.seed(8)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sample = langid.labelled_sample(docs, ~langid.held_out(docs.doc_id))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(10_000 + k, " ".join(random.choice((t or "x").split() or ["x"]) for _ in range(random.randint(1, 5)))) for k, (_, t) in enumerate(rows[:60])]
    got = Counter((r.doc_id, r.lang_pred, r.accepted) for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), sample).collect())
    assert got == Counter((i, *classified_by_brute_force(sample, t)) for i, t in rows)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in langid.languages_of(docs).collect() if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.97 * len(got)
    assert sum(r.accepted for r in got) >= 0.97 * len(got)


def test_language_by_compression(spark):
    random.seed(12)
    rows = [(k, spoken(lang, random.choice([4, 30, 600])), lang) for k in range(240) for lang in [random.choice(list(TONGUES))]]
    rows += [(900, None, "xa"), (901, "", "xa"), (902, " 12 !? ", "yb"), (903, "½ ² Ⅷ", "yb"), (None, spoken("xa", 30), None), (5, spoken("zc", 30), "zc"), (5, spoken("zc", 30), "zc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS accepted", "'x' AS lang_pred")
    found = langid.languages_of(df).collect()
    got = {r.doc_id: r for r in found}
    truth = {i: lang for i, _, lang in rows}
    assert len(found) == len(rows)
    assert {got[i].lang_pred for i in (900, 901, 902, 903)} == {"und"} and not got[902].accepted and not got[903].accepted
    assert got[None].lang_pred == "xa" and not got[None].held_out
    tested = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in tested) and sum(got[i].held_out for i in range(240)) == len(tested)
    assert sum(got[i].lang_pred == truth[i] for i in tested if i != 5) >= 0.95 * len(tested)
    assert all(0 <= r.score <= 1 for r in found)
    kept = langid.accepted_rows(df, langid.labelled_sample(df, df.doc_id.isNotNull()))
    assert kept.columns == df.columns and kept.count() >= 235


def test_narrow_margins_are_rejected(spark):
    random.seed(14)
    labelled = [(k, spoken(lang, 300), lang) for k in range(90) for lang in [list(TONGUES)[k % 3]]]
    other = ["".join(random.choice("fghijkwéß") for _ in range(random.randint(2, 8))) for _ in range(200)]
    mixed = [" ".join(random.choice(WORDS[("xa", "yb")[k % 2]]) for k in range(200)) for _ in range(10)]
    rows = labelled + [(1000 + k, " ".join(random.choices(other, k=100)), None) for k in range(10)] + [(2000 + k, t, None) for k, t in enumerate(mixed)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.accepted for r in langid.languages_of(df).collect()}
    assert all(got[k] for k in range(90))
    assert not any(got[1000 + k] for k in range(10))
    assert sum(got[2000 + k] for k in range(10)) <= 5


def test_more_languages_than_are_held(spark, monkeypatch):
    random.seed(3)
    dictionaries = {lang: langid.letters(spoken(lang, 500)) for lang in TONGUES}
    texts = [spoken(random.choice(list(TONGUES)), random.choice([1, 3, 40])) for _ in range(30)]
    want = langid.Classifier(dictionaries).classify(texts)
    monkeypatch.setattr(langid, "HELD", 1)
    assert langid.Classifier(dictionaries).classify(texts) == want


def test_one_language_none_and_no_rows(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "12", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.languages_of(df).collect()} == {"und"}
    assert [r.doc_id for r in langid.accepted_rows(df, langid.labelled_sample(df, df.doc_id > 0)).collect()] == [1]
    one = spark.createDataFrame([(k, "abc def", "xa") for k in range(9)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.accepted) for r in langid.languages_of(one).collect()} == {("xa", True)}
    assert langid.languages_of(df.limit(0)).collect() == []


def test_very_long_text_counts_to_its_end():
    random.seed(2)
    dictionaries = {lang: langid.letters(spoken(lang, 500)) for lang in TONGUES}
    text = spoken("xa", 100_000) + " " + spoken("yb", 300_000)
    assert langid.Classifier(dictionaries).classify([text])[0][0] == "yb"
