"""Rounds of the learners that are fitted step by step."""

from quadrat.operators.learners import base_learners


def test_library_rounds(spark):
    learners = base_learners()
    assert learners["gradient_boosting"].getClassifier().getMaxIter() == 100
    assert learners["linear_svm"].getClassifier().getMaxIter() == 100
