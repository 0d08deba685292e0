"""Every stage of the pipeline, on what its predecessor kept, against brute force."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from recsim.llm import toxicity
from recsim.session import cut_lineage
from tests.llm import test_packing, test_pii, test_simhash, test_substrings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """[(name, rows before, rows after)] of every stage."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = cut_lineage(stage(spark, docs, SF), name)
        if name != "best_fit_packing":
            assert after.columns == docs.columns and after.schema == docs.schema
        out.append((name, docs.collect(), after.collect()))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_stages_are_the_agreed_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "pii", "best_fit_packing"]


def test_toxicity_rejects_what_its_model_calls_toxic(spark, steps):
    before, after = steps["toxicity"]
    model = toxicity.fit_toxicity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if model.score(r.text) < 0.5)
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    kept = {r.doc_id for r in after}
    assert len(clean & kept) > 0.97 * len(clean)


def test_one_document_of_each_group_stays(steps):
    before, after = steps["simhash_near_dedup"]
    comp = test_simhash.brute_components([r.doc_id for r in before], [test_simhash.brute_print(r.text) for r in before], 2)
    assert sorted(r.doc_id for r in after) == sorted(set(comp))


def test_repeated_windows_go(steps):
    before, after = steps["substring_dedup"]
    want = test_substrings.brute([(r.doc_id, r.text) for r in before], 20)
    text = {r.doc_id: r.text for r in before}
    for r in after:
        kept, _, gone = want[r.doc_id]
        assert r.text == (" ".join(kept) if gone else text[r.doc_id])
        assert r.n_chars == len(r.text)


def test_personal_data_is_replaced(steps):
    before, after = steps["pii"]
    text = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        assert not [s for s in test_pii.brute(r.text) if s[0] in ("email", "ip", "card")]
        if not test_pii.brute(text[r.doc_id]):
            assert r.text == text[r.doc_id]


def test_packing_holds_every_token(spark, steps):
    before, after = steps["best_fit_packing"]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    want = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in before}
    rows = [r.asDict() for r in after]
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want
    assert test_packing.check_packing(rows, 4096) <= -(-sum(want.values()) // 4096) + 1


def test_run_gives_the_last_stage(spark, steps):
    _, after = steps["best_fit_packing"]
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == list(after[0].asDict())
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, got.collect())) == sorted(map(key, after))
    assert np.all([r.offset + r.length <= 4096 for r in after])
