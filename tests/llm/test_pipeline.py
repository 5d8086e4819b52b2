"""The pipeline against its stages' brute-force versions, one after another."""

import random
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

from .conftest import make_words
from .test_exact import brute_groups, brute_hits, brute_lines


def test_pipeline_is_its_stages(spark, tmp_path):
    r = random.Random(11)
    shared = "This passage is long enough and stands in very many of the documents here"
    item = " ".join(make_words(77, 14))
    rows = []
    for i in range(70):
        w = make_words(i % 50 if i % 3 else i, 50)
        text = " ".join(w) + ("\n" + shared if i % 4 == 0 else "") + ("\n" + item if i % 11 == 0 else "")
        rows.append((i, text))
    rows += [(100, None), (101, "1234 !!"), (102, ""), (103, shared)]
    docs = spark.createDataFrame([(i, t, r.choice(["en", "de"]), "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    now = [(i, t) for i, t in rows if t and re.search(r"[^\W\d_]", t)]
    now = [(i, kept) for i, _, _, kept in brute_lines(now)]
    root = brute_groups(now)
    now = [(i, t) for i, t in now if root[i] == i]
    now = [(i, t) for i, t in now if not brute_hits(t, [(1, item)])[1]]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {i: list(x.ids) for i, x in got.items()} == {i: library.encode(t, add_special_tokens=False).ids for i, t in now}
    assert len(corpus_pipeline.STAGES) == 5
    step = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        step = f(spark, step, str(tmp_path))
        assert step.columns == docs.columns, name
