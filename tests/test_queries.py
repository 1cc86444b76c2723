"""Registered queries against their SQL on the smallest tables; ``check.py`` runs them all."""

import pytest

import __spark_entry__ as entry
import check

FAST = (
    "s3_parse_labelled", "s5_labels_by_position", "t0_tokens", "t2_filter_characters",
    "t3_stop_words_joined", "t4_cleaner_chain", "f2_idf", "f3_tfidf", "f7_document_vectors_shuffled",
    "f9_new_vocabulary", "f13_word_set", "l3_row_updates", "l5_train_batch_shuffled", "l10_predict",
    "l13_naive_bayes_predictions", "l14_logistic_sgd", "e1_weighted_scores", "e7_drift",
    "e8_majority_vote", "p3_text_predictions", "p3_text_topics", "x2_mutual_information",
)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, small, name):
    got = entry.queries()[name](spark, small).toPandas()
    want = check.connect(small).execute(entry.oracle_sql()[name]).df()
    assert check.difference(got, want) == ""


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark, small):
    rows = entry.entry(spark).collect()
    assert rows and {"batch", "topic", "rows", "strength"} <= set(rows[0].asDict())


def test_comparison_has_a_row_per_learner(spark, small):
    rows = entry.queries()["p5_compare_classifiers"](spark, small).collect()
    assert {r["learner"] for r in rows} == {"naive_bayes", "svm_cascade", "pair_votes", "ftrl", "logistic_sgd"}
    assert all(0.0 <= r["accuracy"] <= 1.0 for r in rows)
