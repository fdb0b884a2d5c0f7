"""The pipeline's stages against plain statements, on the smallest table with odd rows and clashing names."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sheafline.llm import quality_classifier, toxicity
from sheafline.llm.common import table
from sheafline.llm.queries import vocabulary
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"
CLASHES = ("kept__id", "component_id", "label", "n")


@pytest.fixture(scope="module")
def docs(spark):
    own = table(spark, SF_DIR, "documents")
    texts = {r.doc_id: r.text for r in own.collect()}
    copied = max((t for t in texts.values() if t), key=len)
    odd = [(-1, None, None, None), (-2, "", "", "s"), (-3, " \n\t", "en", "s"), (-4, copied, "en", "s"), (-5, copied + " more words at the end", "en", "s")]
    extra = spark.createDataFrame([(*r, len(r[1] or "")) for r in odd], "doc_id long, text string, lang string, source string, n_chars long")
    return own.unionByName(extra).withColumns({c: F.lit(1) for c in CLASHES})


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_do_what_their_operators_say(spark, docs):
    labels = table(spark, SF_DIR, "labels")
    good = corpus_pipeline.quality(spark, docs, SF_DIR)
    fine = {r.doc_id for r in quality_classifier.score(docs, labels).where("predicted = 1").collect()}
    assert good.columns == docs.columns and set(texts_of(good)) == fine
    safe = corpus_pipeline.clean(spark, good, SF_DIR)
    mild = {r.doc_id for r in toxicity.score(good, labels).where("predicted = 0").collect()}
    assert safe.columns == docs.columns and set(texts_of(safe)) == mild
    before = texts_of(safe)
    single = corpus_pipeline.near_duplicates(spark, safe, SF_DIR)
    kept = texts_of(single)
    assert single.columns == docs.columns and kept == {d: before[d] for d, _, c in brute.jaccard_components(list(before.items())) if d == c}
    cut = corpus_pipeline.repeated_passages(spark, single, SF_DIR)
    sizes = {d: n - gone for d, n, gone, _, _ in brute.byte_dedup(list(kept.items()))}
    assert cut.columns == docs.columns and {d: len((t or "").encode()) for d, t in texts_of(cut).items()} == sizes
    pieces = corpus_pipeline.packed(spark, cut, SF_DIR).collect()
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    tokenizer.no_padding()
    tokenizer.no_truncation()
    counts = {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in texts_of(cut).items()}
    held = Counter()
    sequences = {}
    for p in pieces:
        held[p.doc_id] += p.length
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert held == counts
    for own in sequences.values():
        assert sum(n for _, n in own) <= 2048
        assert [at for at, _ in sorted(own)] == [sum(n for a, n in own if a < at) for at, _ in sorted(own)]


def test_an_empty_table_goes_through_all_stages(spark, docs):
    own = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        own = stage(spark, own, SF_DIR)
    assert own.count() == 0
