"""The pipeline's decisions against a brute-force version."""

import zlib

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_ops import brute_components, docs_of, texts

import corpus_pipeline as C
from commerce_lake.llm import op1_decontamination, op6_mixing, op9_token_output


def test_stages_keep_columns(spark, tmp_path):
    d = docs_of(spark, texts(40) + ["the quick brown fox and the other animals of the wood were there"] * 2)
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns
        d = out.persist()
    assert set(C.STAGES[-1][1](spark, d, SF).columns) == {"doc_id", "start", "n_tokens", "ids_crc32"}


def test_own_columns_keep_their_values(spark):
    """Columns with the names that operators use inside come out as they went in."""
    own = {"score": -1.5, "lang_pred": "mine", "size": -7, "source_size": -8, "target": -9, "copies": -10, "copy": -11, "mix_source": "mine", "row_key": -2, "group": -3, "class_id": -4, "component_id": -5, "n": -6, "hash": -12}
    d = docs_of(spark, texts(40)).select("doc_id", "text", "lang", "source").withColumns({k: F.lit(v) for k, v in own.items()})
    for _, stage in C.STAGES[:-1]:
        d = stage(spark, d, SF).persist()
        assert {tuple(r)[4:] for r in d.collect()} == {tuple(own.values())}


def test_near_duplicates_are_told_by_row(spark):
    a, b = "one two three four five six seven eight nine ten", "another text with words of its very own and no copies"
    rows = [(5, a), (5, b), (None, a), (None, "a text without any id that stays where it is put"), (7, b), (7, b), (3, ""), (None, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in C.drop_near_duplicates(spark, d, SF).collect()), key=repr)
    assert kept == sorted([(5, a), (5, b), (None, rows[3][1]), (3, ""), (None, "")], key=repr)


@pytest.mark.parametrize("empty", [True])
def test_empty(spark, empty):
    d = docs_of(spark, empty=True)
    for _, stage in C.STAGES:
        assert stage(spark, d, SF).count() == 0


def test_run(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = {r.doc_id: r for r in docs if any(map(str.isalpha, r.text or ""))}
    groups = brute_components([(i, r.text) for i, r in rows.items()], C.SHINGLE, C.PERCENT)
    kept = [i for i in rows if groups[i][1] == i]
    items = op1_decontamination.index_items([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    dirty = {kept[t] for t, _, _ in op1_decontamination.scan([rows[i].text for i in kept], items)}
    clean = spark.createDataFrame([rows[i] for i in kept if i not in dirty])
    tok = Tokenizer.from_file(op9_token_output.default_tokenizer())
    want, start = [], 0
    for r in sorted(op6_mixing.mixed(clean).collect(), key=lambda r: r.doc_id):
        ids = np.array([*tok.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        for _ in range(r.copies):
            want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    assert sorted(tuple(r) for r in C.run(spark, SF).collect()) == want and len(kept) < len(rows) and dirty
