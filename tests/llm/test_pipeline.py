"""The corpus pipeline on the smallest tables, its stages one by one."""

import os

import pytest

import corpus_pipeline
from clausegrid.llm import quality, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, is_toxic string, N_LINES int, rest int, __gone int, holder long, fp long"
PROSE = [" ".join(f"w{(k * 37 + j * 11 + j * j) % 997}" for j in range(60)) for k in range(8)]
LINE = "a line that three documents or more have in common"
ODD = [None, "", " \t", PROSE[0], PROSE[0], PROSE[1] + "\n" + LINE, PROSE[2] + "\n" + LINE, PROSE[3] + "\n" + LINE, " ".join(f"x{k}" for k in range(60_000)), "one two " * 5_000]


def odd_documents(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, PROSE[0]), (None, PROSE[4]), (None, None)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "t", 7, 8, 9, 10, 11) for i, t in rows], SCHEMA)


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)


def others_stay(docs, out):
    assert out.columns == docs.columns and {tuple(r) for r in out.select("kept", "is_toxic", "N_LINES", "rest", "__gone", "holder", "fp").collect()} == {("k", "t", 7, 8, 9, 10, 11)}


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(k, 1, 0) for k in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_odd_rows_in_each_stage(spark, labelled):
    docs = odd_documents(spark).cache()
    out = corpus_pipeline.by_quality(spark, docs, labelled)
    others_stay(docs, out)
    assert ids(out) == sorted([3, 3, 4, 5, 6, 7, 8, None], key=str)
    out = corpus_pipeline.by_toxicity(spark, docs, labelled)
    others_stay(docs, out)
    assert ids(out) == ids(docs)  # no label says toxic
    out = corpus_pipeline.by_lines(spark, docs, labelled)
    others_stay(docs, out)
    by_id = {r["doc_id"]: r for r in out.collect()}
    assert ids(out) == ids(docs) and by_id[7]["text"] == ODD[7] and by_id[5]["text"] == PROSE[1] and by_id[5]["n_chars"] == len(PROSE[1]) and by_id[0]["text"] == "" and by_id[8]["text"] == ODD[8]
    out = corpus_pipeline.by_near_duplicates(spark, docs, labelled)
    others_stay(docs, out)
    assert ids(out) == sorted([0, 3, 3, 5, 6, 7, 8, 9, None, None], key=str)
    out = corpus_pipeline.packed(spark, docs, labelled)
    assert sum(r["length"] for r in out.collect()) == sum(1 + len(x) for x in tokens([r["text"] for r in docs.collect()]))


def tokens(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_empty_tables_in_each_stage(spark, labelled):
    docs = odd_documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, labelled)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "line_dedup", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if name != "packing":
            docs = docs.cache()
            assert docs.columns == before.columns and docs.count() <= before.count()
        out[name] = docs
    first = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r["doc_id"] for r in out["quality"].collect()} == {r["doc_id"] for r in quality.assess(first).where("kept").collect()}
    assert out["line_dedup"].count() == out["toxicity"].count()
    left = simhash.similar(out["near_dedup"])
    assert left.where("doc_id <> component_id").count() == 0
    packed = out["packing"].collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in out["near_dedup"].collect()}
    whole = corpus_pipeline.run(spark, SF)
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole.collect())) == sorted(map(key, packed))
