"""Nulls, empty tables, repeated rows and clashing names: every operator gives its defined result."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logweft.llm import bpe, chat, decontam, fingerprint, langid, linededup, neardup, pii, secret_scan, unigram
from logweft.llm.queries import QUERIES, SQL

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet"), (None, "a b"), (2, None)], "item_id long, text string")


@pytest.fixture(scope="module")
def operators(spark, benchmark):
    vocab = unigram.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    forest = secret_scan.train(secret_scan.labelled_findings(spark, 600), trees=3, depth=3)
    return {
        "near": neardup.near_duplicates, "lang": lambda d: langid.identify(d, langid.learn(d)), "lines": linededup.line_report, "pii": pii.find_pii, "secrets": lambda d: secret_scan.find_secrets(d, forest),
        "prints": fingerprint.compare_edited, "plain": fingerprint.fingerprints, "decon": lambda d: decontam.find_contamination(d, benchmark), "count": lambda d: unigram.count_tokens(d, vocab), "bpe": lambda d: bpe.encode(d, PATH, decoded=True),
    }


KEEPING = {"lang": lambda d, b: langid.keep_identified(d, langid.learn(d)), "lines": lambda d, b: linededup.dedup_lines(d), "near": lambda d, b: neardup.keep_first(d), "decon": decontam.remove_contaminated, "spans": decontam.remove_spans}


def test_a_row_for_each_row(odd, odd_rows, operators):
    for name, f in operators.items():
        got = f(odd).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in odd_rows), name


def test_empty_tables(empty, operators, benchmark, spark):
    for name, f in operators.items():
        assert f(empty).count() == 0, name
    for name, f in KEEPING.items():
        got = f(empty, benchmark)
        assert got.count() == 0 and got.columns == empty.columns, name
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_filters_keep_columns(odd, odd_rows, benchmark):
    kept = {name: f(odd, benchmark) for name, f in KEEPING.items()}
    for name, df in kept.items():
        assert df.columns == odd.columns, name
    ids = {name: sorted(str(r.doc_id) for r in df.select("doc_id").collect()) for name, df in kept.items()}
    every = sorted(str(i) for i, _ in odd_rows)
    assert ids["lines"] == ids["spans"] == every
    assert ids["near"] == sorted(["1", "2", "3", "4", "5", "None", "8", "10", "12", "13"])
    assert ids["decon"] == sorted(set(every) - {"10", "11"} | {"6"}) + ["6"] or set(ids["decon"]) == set(every) - {"10", "11"}


def test_nothing_learnt_keeps_every_row(odd, odd_rows):
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    profiles = langid.learn(unlabelled)
    assert profiles == [] and langid.keep_identified(unlabelled, profiles).count() == len(odd_rows)


def test_empty_benchmark(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_contamination(odd, none).where("n_hit > 0").count() == 0
    assert decontam.remove_contaminated(odd, none).count() == odd.count()


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from logweft.llm import common

    none = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(getConf=lambda: none, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        common.work_dir(SimpleNamespace(conf=none, sparkContext=context), "x")
