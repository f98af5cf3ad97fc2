"""The pipeline against plain versions of its stages on the smallest tables."""

import string
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from test_near import brute
from wardpanel.llm.common import table
from wardpanel.llm.near_dedup import bin_weights, documents
from wardpanel.llm.pii import Permuter, replace_values
from wardpanel.llm.quality import text_features, train
from wardpanel.llm.queries import pseudonym_key, tokenizer_file

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = train(docs, table(spark, SF, "labels"))
    good = [r for r, s in zip(rows, model.score(text_features([t.encode() for _, t in rows]))) if s >= 0.5]
    assert 0 < len(good) < len(rows)
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    last = {}
    for i, t in sorted(good):
        last[t.translate(lower)] = (i, t)
    unique = sorted(last.values())
    weight = bin_weights(documents(spark.createDataFrame(unique, "doc_id long, text string"), "doc_id", "text"))
    classes = brute(unique, weight, 0.8)
    kept = [(i, t) for i, t in unique if (i, i) in classes]
    assert len(kept) < len(unique) < len(good)
    perm = Permuter(pseudonym_key().encode())
    encoder = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = {i: [*encoder.encode(replace_values(t, perm)[0], add_special_tokens=False).ids, 2] for i, t in kept}
    parts = defaultdict(list)
    for p in corpus_pipeline.run(spark, SF).collect():
        parts[p.doc_id].append((p.start, np.frombuffer(p.ids, dtype="<u4").tolist()))
    assert {i: sum((x for _, x in sorted(v)), []) for i, v in parts.items()} == want


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents").limit(50)
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
