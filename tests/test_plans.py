"""What the physical plans may and may not hold."""

import re

import pytest

import __spark_entry__ as entry

PYTHON = {
    "verify_with_similarity",
    "complete_with_fallback",
    "retry_unparsed",
    "answer_questions",
    "assess_quality",
    "stream_states",
    "stream_checked_states",
    "stream_expiry",
    "stream_ingest",
}


def plan(spark, sf_dir, name):
    return entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - PYTHON))
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    for banned in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "CartesianProduct"):
        assert banned not in text
    # The one nested-loop join allowed is with the single row holding the number of documents.
    assert "BroadcastNestedLoopJoin" not in text


def test_text_is_cut_without_a_shuffle_of_chunks(spark, sf_dir):
    from corpusloom.operators.segment import chunk_markdown, chunk_plaintext

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("cast(doc_id as string) document_id", "text")
    for cut in (chunk_markdown, chunk_plaintext):
        text = cut(docs)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_top_k_is_cut_before_the_shuffle(spark, sf_dir):
    text = plan(spark, sf_dir, "rank_relevant")
    assert "WindowGroupLimit" in text and "Partial" in text
    assert text.count("WindowGroupLimit") >= 2


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return sum(line.lstrip(" +-:*(0123456789)").startswith(("Exchange", "BroadcastExchange", "ReusedExchange")) for line in text.splitlines())


def test_context_suggestions_and_outline_shuffle_little(spark, sf_dir):
    from corpusloom.operators import quality as ql
    from corpusloom.plans import corpus
    from corpusloom.plans.catalog import quality as cat
    from corpusloom.session import materialize

    assert 0 < exchanges(entry.queries()["build_context"](spark, sf_dir)) <= 12
    assert exchanges(entry.queries()["section_tree"](spark, sf_dir)) == 0
    found, gaps = materialize(cat.findings(spark, sf_dir), "f"), materialize(cat.gaps(spark, sf_dir), "g")
    out = ql.suggest(cat.suggestions(spark, sf_dir), cat.suggestion_refs(spark, sf_dir), found, gaps, corpus.stored(spark, sf_dir, "chunks"))
    assert 0 < exchanges(out.suggestions) <= 12 and 0 < exchanges(out.refs) <= 12


def test_judged_replies_are_parsed_once(spark, sf_dir):
    from corpusloom.operators import replies as rs
    from corpusloom.plans import corpus
    from corpusloom.session import materialize

    responses = corpus.stored(spark, sf_dir, "responses")
    judged = materialize(rs.judge(responses), "judged")
    for parse in (rs.parse_elements, rs.parse_contradictions, rs.parse_ambiguities, rs.parse_suggestions, rs.parse_answers):
        for df in parse(judged):
            text = df._jdf.queryExecution().executedPlan().toString()
            assert "parse_json" not in text and text.count("Scan parquet") == 1
        plain = parse(responses)[0].collect()
        assert sorted(map(str, plain)) == sorted(map(str, parse(judged)[0].collect()))


def test_replies_need_their_setting(spark, sf_dir):
    from corpusloom.operators import replies as rs
    from corpusloom.plans import corpus

    name = "spark.sql.variant.allowDuplicateKeys"
    responses = corpus.stored(spark, sf_dir, "responses")
    spark.conf.set(name, "false")
    try:
        with pytest.raises(ValueError, match=name):
            rs.parse_types(responses)
    finally:
        spark.conf.set(name, "true")


def test_queries_build_only_the_replies_they_read(spark, sf_dir, monkeypatch):
    from corpusloom.plans import corpus

    for name in ("parse_elements", "parse_suggestions", "extract_model_elements", "quality_failures"):
        monkeypatch.setattr(corpus, "_stored", {})
        entry.queries()[name](spark, sf_dir)
        built = {key[2] for key in corpus._stored}
        assert built and not built & {"questions", "scores", "responses", "replies-scoring", "replies-answer", "replies-type"}


def test_replies_are_built_from_elements_without_their_flagged_copy(spark, sf_dir, monkeypatch):
    from corpusloom.plans import corpus

    flagged = corpus.flagged_elements(spark, sf_dir).drop("verified")
    monkeypatch.setattr(corpus, "_stored", {})
    entry.queries()["parse_suggestions"](spark, sf_dir)
    assert {key[2] for key in corpus._stored} == {"elements", "replies-suggestion"}
    plain = corpus.stored(spark, sf_dir, "elements").drop("verified")
    assert flagged.exceptAll(plain).isEmpty() and plain.exceptAll(flagged).isEmpty()


def test_exact_checks_read_stored_steps(spark, sf_dir):
    for name in ("verify_exact", "finish_answers"):
        text = plan(spark, sf_dir, name)
        assert "parse_json" not in text and "xxhash64(substring" not in text


def test_prompts_with_different_labels_share_the_shuffle_of_texts(spark, sf_dir):
    from corpusloom.plans import corpus, prompts

    chunks = corpus.stored(spark, sf_dir, "chunks")
    shuffled = set()
    for style in ("id", "fields", "tags"):
        text = prompts.labelled_text(chunks, style)._jdf.queryExecution().sparkPlan().toString()
        partial = [line for line in text.splitlines() if "partial_collect_list" in line]
        assert len(partial) == 1
        shuffled.add(re.sub(r"#\d+L?", "", partial[0]))
    assert len(shuffled) == 1


def test_extraction_stores_items_and_not_whole_replies(spark, sf_dir):
    from corpusloom.plans import analysis, corpus
    from corpusloom.plans.catalog import replies as cat

    kept = []
    analysis.extract_model(
        cat.responses(spark, sf_dir, "extraction"),
        corpus.stored(spark, sf_dir, "chunks"),
        cat._markdown(spark, sf_dir),
        settle=lambda df: kept.append(df) or df,
    )
    assert "_items" in kept[0].columns and "_v" not in kept[0].columns
    assert kept[0].where("content != ''").count() == 0


def test_extraction_and_labelled_texts_share_one_shuffle(spark, sf_dir):
    """Texts are shuffled once by document, and not again for their contexts."""
    from corpusloom.plans import corpus, prompts

    chunks, types = corpus.stored(spark, sf_dir, "chunks"), corpus.document_types(spark, sf_dir)
    elements = corpus.stored(spark, sf_dir, "flagged_elements")
    out = prompts.extraction_prompts(chunks, types).unionByName(prompts.ambiguity_prompts(types, elements, chunks))
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    made = [line for line in final.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    assert not any("segment" in line for line in made)
    assert sum("REPARTITION_BY_COL" in line for line in made) == 1
    assert any("ReusedExchange" in line and "REPARTITION_BY_COL" in line for line in final.splitlines())
