import random

from helpers import rows
from pyspark.sql import functions as F
from test_graph import ELS, RELS, els

from corpusloom.model import MAX_SUGGESTIONS, type_schema
from corpusloom.operators.context import budget_direct
from corpusloom.operators import context as cx
from corpusloom.operators import evidence as ev
from corpusloom.operators import quality as ql
from corpusloom.operators.constraints import check_constraints

SUG = "document_id string, suggestion_id string, owner string, pos long, description string, category string, priority string, related_finding_ids array<string>, all_evidence_unverified boolean"
FND = (
    "document_id string, finding_id string, owner string, ord array<bigint>, type string, description string, severity string, "
    "affected_element_ids array<string>, involves_unverified_elements boolean, all_evidence_unverified boolean, from_explicit_relationship boolean"
)
MISS = "document_id string, finding_id string, owner string, ord array<bigint>, classification string, expected_element string, description string, severity string, schema_reference string"


def sugs(spark, priorities, related=lambda i: []):
    return spark.createDataFrame(
        [("a", f"s{i:02d}", f"s:{i}", i, "d", "clarity", p, related(i), False) for i, p in enumerate(priorities)], SUG
    )


def finding(spark, *items):
    return spark.createDataFrame(
        [("a", f[0], f"f:{i}", [0, i], f[1], "words " * 80, f[2], f[3], f[4], False, False) for i, f in enumerate(items)], FND
    )


def test_long_suggestion_lists_are_cut_by_priority(spark):
    rng = random.Random(5)
    short = [rng.choice(["low", "high"]) for _ in range(MAX_SUGGESTIONS)]
    kept = ql.top_suggestions(sugs(spark, short)).orderBy("place").collect()
    assert [r.suggestion_id for r in kept] == [f"s{i:02d}" for i in range(20)]
    long = [rng.choice(["low", "medium", "high"]) for _ in range(33)]
    weight = {"high": 0, "medium": 1, "low": 2}
    want = [f"s{i:02d}" for i in sorted(range(33), key=lambda i: weight[long[i]])][:20]
    assert [r.suggestion_id for r in ql.top_suggestions(sugs(spark, long)).orderBy("place").collect()] == want


def test_high_findings_get_a_suggestion(spark):
    found = finding(spark, ("c1", "contradiction", "high", [], False), ("m1", "ambiguity", "high", [], False), ("l1", "ambiguity", "low", [], False))
    gaps = spark.createDataFrame([("a", "g1", "g:1", [0, 0], "missing", "x", "gap", "high", "prd")], MISS)
    out = ql.cover_high_findings(sugs(spark, ["low"], lambda i: ["m1"]), found, gaps).where("priority = 'high'")
    assert rows(out, "category", "related_finding_ids") == [("completeness", ["g1"]), ("consistency", ["c1"])]
    assert out.agg(F.max(F.length("description"))).first()[0] == 300


def test_unverified_flag_is_only_raised(spark):
    e = els(spark, ("e1", "actor", "A", True), ("e2", "actor", "B", False))
    found = finding(
        spark, ("f1", "ambiguity", "low", ["e1"], True), ("f2", "ambiguity", "low", ["zz"], False), ("f3", "ambiguity", "low", ["zz", "e2"], False)
    )
    got = rows(ql.flag_unverified(found, e), "finding_id", "involves_unverified_elements")
    assert got == [("f1", True), ("f2", False), ("f3", True)]


def test_equal_ids_keep_their_own_flags_references_and_covers(spark):
    e = els(spark, ("e1", "actor", "A", True), ("e2", "actor", "B", False))
    found = finding(spark, ("x", "ambiguity", "high", ["e1"], False), ("x", "ambiguity", "high", ["e2"], False))
    assert rows(ql.flag_unverified(found, e), "owner", "involves_unverified_elements") == [("f:0", False), ("f:1", True)]
    gaps = spark.createDataFrame([], MISS)
    covered = ql.cover_high_findings(sugs(spark, []), found, gaps)
    assert rows(covered, "suggestion_id", "owner") == [(covered.first().suggestion_id, "for:f:0"), (covered.first().suggestion_id, "for:f:1")]
    same = sugs(spark, ["low", "low"]).withColumn("suggestion_id", F.lit("x"))
    ref = "document_id string, owner string, owner_id string, ref_pos int, chunk_id string, page int, section string, evidence string, evidence_verified boolean"
    refs = spark.createDataFrame([("a", "s:1", "x", 0, "c9", None, None, "own", False), ("a", "f:0", "x", 0, "c8", None, None, "other", False)], ref)
    chunks = spark.createDataFrame([("a", "c0", "first text", (None, None), 0)], "document_id string, chunk_id string, text string, structural_context struct<page int, section string>, order int")
    got = ql.suggest(same, refs, found.limit(0), gaps, chunks)
    assert rows(got.refs, "owner", "chunk_id") == [("s:0", "c0"), ("s:1", "c9")]
    checked = got.refs.unionByName(refs.where("owner = 'f:0'")).withColumn("evidence_verified", F.col("chunk_id") == "c0")
    flagged = ev.all_evidence_unverified(got.suggestions, checked, ql.OWNER_KEY)
    assert rows(flagged, "owner", "all_evidence_unverified") == [("s:0", False), ("s:1", True)]


def test_expectations(spark):
    docs = spark.createDataFrame([("a", "prd"), ("g", "generic"), ("e", "prd"), ("u", "memo")], "document_id string, document_type string")
    e = els(spark, ("1", "actor", "Propósito general", True)).unionByName(els(spark, ("1", "proposito", "zzz", True), doc="u"))
    catalogue = type_schema(spark)
    missing = ql.missing_elements(docs, e, catalogue)
    assert rows(missing, "document_id", "expected_element") == [
        ("a", "criterios de éxito"), ("a", "requisitos funcionales"), ("a", "restricciones")
    ]
    assert [r[0] for r in rows(ql.completeness_errors(docs, e, catalogue))] == ["e", "u"]
    accent = els(spark, ("1", "proposito", "zzz", True))
    assert "propósito" in [r[1] for r in rows(ql.missing_elements(docs, accent, catalogue), "document_id", "expected_element")]
    empty_name = els(spark, ("1", "proposito", "", True))
    assert ql.missing_elements(docs, empty_name, catalogue).count() == 0


def test_constraints(spark):
    found = finding(spark, ("f1", "ambiguity", "huge", [], False), ("f2", "ambiguity", "low", [], False))
    out = check_constraints(found, "findings")
    assert rows(out.rejected, "finding_id", "reasons") == [("f1", ["severity not allowed"])]
    assert rows(out.accepted, "finding_id") == [("f2",)]


def sequential_context(elements, edges, scores, budget):
    """(direct, related, edges, tokens) by the rule, one question at a time."""
    by_id = {e["id"]: e for e in elements}

    def cost(e):
        content = e["content"] if e["ok"] else "[UNVERIFIED] " + e["content"]
        return max(1, len(f"{e['id']} {e['type']} {e['name']} {content} {e['ev']}") // 4)

    ranked = sorted((e for e in elements if scores.get(e["id"], 0) > 0), key=lambda e: (-scores[e["id"]], not e["ok"]))[:20]
    ids, used = {e["id"] for e in ranked}, 0
    hop = {t for e in ranked for (s, t, _) in edges if s == e["id"] and t in by_id and t not in ids}
    direct, related, kept = [], [], []
    for e in ranked:
        if used + cost(e) > budget:
            break
        direct.append(e["id"])
        used += cost(e)
    for e in sorted((by_id[i] for i in hop), key=lambda e: (not e["ok"], e["name"], e["id"])):
        if used + cost(e) > budget:
            break
        related.append(e["id"])
        used += cost(e)
    inside, seen = set(direct + related), []
    for i in direct:
        seen += dict.fromkeys(x for x in edges if x[0] == i and x[1] in inside)
    for s, t, k in seen:
        c = max(1, len(f"{s} {t} {k} ") // 4)
        if used + c > budget:
            break
        kept.append((s, t, k))
        used += c
    return sorted(direct), sorted(related), sorted(kept), used, bool(ranked)


def test_context_equals_the_sequential_rule(spark):
    rng = random.Random(6)
    e_rows, r_rows, s_rows, questions, want = [], [], [], [], {}
    for d in range(25):
        doc, n = f"d{d}", rng.randint(0, 40)
        elements = [
            {"id": f"e{i}", "type": "actor", "name": rng.choice("abc"), "content": "c" * rng.randint(1, 80), "ev": "v" * rng.randint(0, 40), "ok": rng.random() < 0.6}
            for i in range(n)
        ]
        edges = []
        for i in range(n):
            for j in range(rng.randint(0, 4)):
                edge = (f"e{i}", f"e{rng.randrange(n + 2)}", rng.choice(["depends_on", "contradicts"]))
                edges.append(edge)
                r_rows.append((doc, i, j, *edge, None))
        e_rows += [(doc, i, e["id"], e["type"], e["name"], e["content"], ("c", None, None, e["ev"]), e["ok"]) for i, e in enumerate(elements)]
        scores = {f"e{i}": rng.randint(0, 4) for i in range(n) if rng.random() < 0.7}
        s_rows += [(f"q{d}", doc, i, k, v) for i, (k, v) in enumerate(scores.items())]
        questions.append((f"q{d}", doc, "?"))
        want[f"q{d}"] = sequential_context(elements, edges, scores, 300)
    out = cx.build_context(
        spark.createDataFrame(questions, "question_id string, document_id string, question string"),
        spark.createDataFrame(e_rows, ELS),
        spark.createDataFrame(r_rows, RELS),
        spark.createDataFrame(s_rows, "question_id string, document_id string, pos int, id string, score int"),
        window_tokens=500,
    )
    chosen, edges = rows(out.elements, "question_id", "role", "id"), rows(out.relations, "question_id", "source_id", "target_id", "type")
    totals = {r.question_id: r.total_tokens for r in out.summary.collect()}
    for q, (direct, related, kept, used, any_) in want.items():
        assert sorted(i for (k, role, i) in chosen if k == q and role == "direct") == direct, q
        assert sorted(i for (k, role, i) in chosen if k == q and role == "related") == related, q
        assert sorted(e[1:] for e in edges if e[0] == q) == kept, q
        assert totals.get(q) == (used if any_ else None)


def test_direct_elements_are_not_cut_below_the_callers_limit(spark):
    rows = [("q", "d", f"e{i}", i + 1, 2) for i in range(30)]
    ranked = spark.createDataFrame(rows, "question_id string, document_id string, id string, rank int, tokens int")
    assert budget_direct(ranked, 1000).count() == 30
    assert budget_direct(ranked, 41).count() == 20
