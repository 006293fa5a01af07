import random
from collections import Counter

import brute
import public_tokenizers
from pyspark.sql import functions as F
from test_langid import classified_by_brute_force
from tokenizers import Tokenizer

import corpus_pipeline
from tallyweave.llm import langid, mixing


def test_stages_take_effect(spark, tmp_path):
    random.seed(21)
    words = {"en": ["the", "and", "with", "house", "river", "stone", "light", "under"], "de": ["der", "und", "mit", "haus", "fluss", "stein", "licht", "unter"]}
    make = lambda lang, n: " ".join(random.choice(words[lang]) + random.choice(["", "s", "en", "er"]) for _ in range(n))
    item = make("en", 20)
    rows = [(k, make(lang, 60), lang, f"src{k % 4}", 1) for k in range(120) for lang in [random.choice(["en", "de"])]]
    rows += [(500, rows[0][1], rows[0][2], "src1", 1), (501, rows[1][1] + " more", rows[1][2], "src1", 1), (502, f"{make('en', 40)} {item}", "en", "src2", 1), (503, "1234 !!", "en", "src0", 1), (504, None, "en", "src0", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        kept.append(Counter(r.doc_id for r in docs.collect()))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    ids = {r[0] for r in rows}
    assert not kept[0].keys() & {503, 504} and len(kept[0]) >= len(ids) - 4
    dictionaries = langid.labelled_sample(spark.read.parquet(f"{tmp_path}/documents.parquet"), F.lit(True))
    assert kept[0] == Counter(i for i, t, *_ in rows if classified_by_brute_force(dictionaries, t)[1])
    assert kept[0].keys() - kept[1].keys() == {500, 501} & kept[0].keys()
    assert 502 in kept[1] and kept[1].keys() - kept[2].keys() == {502}
    after = spark.read.parquet(f"{tmp_path}/out2")
    times = {r.doc_id: r.taken // r.size for r in mixing.mix_documents(after).collect() if r.size}
    assert kept[3] == Counter({i: n for i, n in times.items() if n})
    assert kept[4] == kept[3]
    # token shards against the library, stage by stage as the rest: ids in order, an end id each, where each begins
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mixed = sorted(spark.read.parquet(f"{tmp_path}/out3").collect(), key=lambda r: r.doc_id)
    start, want = 0, []
    for r in mixed:
        n = len(library.encode(r.text, add_special_tokens=False).ids) + 1
        want.append((r.doc_id, start, n))
        start += n
    assert [(r.doc_id, r.start, r.n_tokens) for r in sorted(docs.collect(), key=lambda r: r.start)] == want
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == kept[4]
    assert brute.WORD.findall("a b") == ["a", "b"] and corpus_pipeline.ORACLE_SQL is None


def test_empty_and_odd_documents(spark, tmp_path):
    """No rows; and rows with null ids, null texts, repeated rows and columns that operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, "null id of some words", "en", None, 1), (None, None, None, None, None), (1, "one text of some words", "en", "a", 1), (1, "one text of some words", "en", "a", 1), (2, "", "en", "a", 0)]
    for name, rows in (("empty", []), ("odd", odd)):
        folder = f"{tmp_path}/{name}"
        df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS size", "2 AS label", "3 AS `n_words`", "4 AS pattern", "5 AS node", "6 AS h")
        df.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (stage, function) in enumerate(corpus_pipeline.STAGES):
            function(spark, docs, folder).write.parquet(f"{folder}/out{k}")
            docs = spark.read.parquet(f"{folder}/out{k}")
            assert k == 4 or docs.columns == df.columns, stage
        assert docs.count() == 0 if name == "empty" else {r.doc_id for r in docs.collect()} == {None, 1}
