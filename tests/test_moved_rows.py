"""What queries don't move between tasks; catalog tests hold their results to the SQL."""

from momentlens import catalog
from momentlens.operators import chains

SF = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_lexicon_scores_move_no_tokens(spark):
    assert "hashpartitioning(doc_id" not in plan_of(spark, "u3_lexicon_scores")


def test_parts_of_a_grid_need_no_join_by_bins(spark):
    assert "_bin" not in plan_of(spark, "j10_overlapping_parts")


def test_transcripts_are_made_where_the_document_is(spark):
    assert "Exchange" not in plan_of(spark, "s4_transcript_words")


def test_sentences_are_joined_before_they_are_moved(spark):
    moved = [x for x in plan_of(spark, "w17_sentences").splitlines() if "Exchange hashpartitioning" in x and "paragraph" in x]
    assert len(moved) == 1 and "_part" in plan_of(spark, "w17_sentences")


def test_texts_stay_behind_while_paragraphs_are_found(spark, monkeypatch):
    seen, real = [], chains.chained
    monkeypatch.setattr(chains, "chained", lambda rows, *a: seen.append(rows.columns) or real(rows, *a))
    assert catalog.queries()["w19_paragraphs_by_rules"](spark, SF).count() > 0
    assert seen == [["video_id", "row", "to"]]
