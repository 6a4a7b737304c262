"""The pipeline against brute-force versions of its stages, each on what the one before kept."""

import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_text_operators import brute_components, brute_leaks, brute_lines

import corpus_pipeline
from tallyboard.llm import stages, toxicity


@pytest.fixture(scope="module")
def folder(spark, docs, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 2), int(bool(t) and "new" in t)) for i, t, *_ in corpus]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    words = [(n, " ".join((corpus[i][1] or "").split()[2:25])) for n, i in enumerate((5, 14, 33, 40))]
    spark.createDataFrame(words, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.orderBy("doc_id").collect()]


def test_stages_follow_each_other(spark, docs, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    kept = stages.clean(spark, docs, folder).cache()
    net = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.score(docs, net).where("predicted = 1").collect()}
    every = rows_of(docs)
    assert rows_of(kept) == [r for r in every if r[0] not in bad]

    out = stages.lines(spark, kept, folder).cache()
    texts, gone = brute_lines(rows_of(kept), 2, 40)
    full = {i: sum(bool(s.strip(" ")) for s in (t or "").split("\n")) for i, t in rows_of(kept)}
    want = [(i, texts[i]) for i, _ in rows_of(kept) if not gone.get(i) or gone[i] < full[i]]
    assert rows_of(out) == want and out.columns == docs.columns
    assert out.where("n_chars <> length(text)").count() == 0

    near = stages.near_copies(spark, out, folder).cache()
    first = {i for i, n, c in brute_components(want) if n == 0 or i == c}
    want = [r for r in want if r[0] in first]
    assert rows_of(near) == want

    clear = stages.leaks(spark, near, folder).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    leaking = {i for i, _ in brute_leaks(want, items)}
    want = [r for r in want if r[0] not in leaking]
    assert rows_of(clear) == want and leaking

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert sorted(got) == [i for i, _ in want]
    for i, t in want:
        ids = library.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_stages_on_odd_and_empty_tables(spark, odd, none, folder):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd.withColumn("toxic", F.lit("x")), folder)
        assert 3 <= got.count() <= 6, name
        if name != "byte-level BPE":
            assert got.columns == [*odd.columns, "toxic"]
        assert stage(spark, none, folder).count() == 0


def test_rows_with_one_id_or_none_are_told_apart(spark, folder, tmp_path):
    from conftest import SCHEMA

    same, near = "a b c d e f g h i j k l m n o p q r s t u v w", "another text of some words that is here and there only"
    passage = spark.read.parquet(f"{folder}/benchmark.parquet").where("length(text) > 60").first()["text"]
    rows = [(3, same), (3, same), (8, same), (None, same), (3, near), (None, near), (None, None), (None, "")]
    rows += [(None, "only here with no id at all x y z"), (None, "only here with no id at all x y z")]
    rows += [(9, f"x y {passage} z"), (9, "a clean text that has the id of another one"), (None, f"x {passage}")]
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)
    got = stages.near_copies(spark, df.where("text is null or not text like 'x %'"), folder)
    assert sorted(map(str, rows_of(got))) == sorted(map(str, [
        (3, same), (3, near), (None, None), (None, ""), (None, rows[8][1]), (9, rows[11][1])]))
    clear = stages.leaks(spark, df, folder)
    assert sorted(map(str, rows_of(clear))) == sorted(map(str, [r for r in rows if passage not in (r[1] or "")]))


def test_columns_named_like_the_numbers_keep_their_values(spark, odd, folder):
    rows = odd.withColumns({"n_removed": F.lit("y"), "longest_run": F.lit("z"), "n_lines_": F.lit("w")})
    got = stages.lines(spark, rows, folder)
    assert got.columns == rows.columns
    assert {(r["n_lines"], r["n_removed"], r["longest_run"], r["n_lines_"]) for r in got.collect()} == {("x", "y", "z", "w")}
