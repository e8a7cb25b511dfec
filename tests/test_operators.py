"""Units, chunks, alignment, facts, audits, clusters and topics on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.operators import align, audit, chunks, classify, clusters, facts, graphs, metrics, sections, topics
from stemma.operators import units as U


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "s", "en", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, n_chars long")


def test_heading_stack(spark):
    long = "x" * 50
    rows = U.with_sections(U.units(docs(spark, f"{long}\nA\n{long}\nB C\n{long}\nD E F\nG\n{long}"))).orderBy("para_index").collect()
    assert [r.section_path for r in rows] == ["__FRONTMATTER__", "A", "A", "A/B C", "A/B C", "A/B C/D E F", "G", "G"]


def test_anchor_ids(spark):
    rows = U.anchors(U.with_sections(U.units(docs(spark, "same\nsame\nother\nsame")))).orderBy("para_index").collect()
    ids = [r.anchor_id for r in rows]
    assert len(set(ids)) == 4
    again = U.anchors(U.with_sections(U.units(docs(spark, "same\nsame\nother\nsame").repartition(3)))).orderBy("para_index").collect()
    assert ids == [r.anchor_id for r in again]


def test_cut_invariants():
    rng = random.Random(4)
    for _ in range(200):
        texts = ["y" * rng.randint(0, 120) for _ in range(rng.randint(0, 30))]
        groups = chunks.cut(texts, max_tokens=40)
        assert [i for g in groups for i in g] == [i for i, t in enumerate(texts) if t]
        for g in groups:
            assert len(g) == 1 or len("\n".join(texts[i] for i in g)) // 4 <= 40


def test_cut_rows_of_cells():
    cells = [(0, 0)] * 16 + [(0, 1)] * 2 + [None]
    assert [len(g) for g in chunks.cut(["c"] * 19, cells)] == [15, 1, 3]


def test_embedding():
    v = chunks.hashed_embedding("Alpha beta, alpha")
    assert v.shape == (1536,) and np.linalg.norm(v) == pytest.approx(1)
    assert not chunks.hashed_embedding("  ").any()


def test_chunks_cover_units(spark):
    a = U.anchors(U.with_sections(U.units(docs(spark, "Title\n" + "\n".join("word " * 60 + str(i) for i in range(30))))))
    got = chunks.chunks(a, 100).collect()
    assert sorted(i for r in got for i in r.anchor_ids) == sorted(r.anchor_id for r in a.collect())


def test_chunk_numbers_equal_the_rule(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for d in range(60):
        texts = ["y" * rng.randint(0, 90) for _ in range(rng.randint(1, 40))]
        cells = [rng.choice([None, (0, 0), (0, 1), (1, 0)]) if d % 2 else None for _ in texts]
        if d % 3 == 0:
            cells = [(0, i // 20) for i in range(len(texts))]
        rows += [(d, i, "s", t, str(i), c and c[0], c and c[1]) for i, (t, c) in enumerate(zip(texts, cells))]
        want[d] = [[str(i) for i in g] for g in chunks.cut(texts, cells, max_tokens=40)]
    frame = spark.createDataFrame(rows, "doc_id long, para_index int, section_path string, text_norm string, anchor_id string, table_no int, row_no int")
    got = {d: [] for d in want}
    for r in chunks.chunks(frame, 40).orderBy("doc_id", "chunk_no").collect():
        got[r.doc_id].append(r.anchor_ids)
    assert got == want


def test_greedy_is_one_to_one():
    got = align.greedy([(0.9, 0, 1), (0.9, 0, 0), (0.8, 1, 0), (0.7, 1, 1)])
    assert got == [(0.9, 0, 0), (0.7, 1, 1)]


def test_alignment(spark):
    from stemma.plans.versions import exact_matches, pairs_of

    d = docs(spark, "Start here\nThe quick brown fox jumps over the lazy dog again and again today.\nGone forever from this text, which is long enough.", "Start here\nThe quick brown fox leaps across a lazy dog again and again today.\nNew")
    a = U.anchors(U.with_sections(U.units(d)))
    p = pairs_of(a)
    m = align.align(a, p, exact_matches(a, p)).collect()
    assert sorted(r.method for r in m) == ["exact_hash", "fuzzy"]
    s = align.alignment_stats(a, p, align.align(a, p, exact_matches(a, p))).first()
    assert (s.matched, s.changed, s.added, s.removed) == (2, 1, 1, 1)


def test_alignment_equals_brute_force(spark):
    """Small versions: every pair scored in one process, with and without embeddings; changed and deleted units by impact."""
    from stemma.plans.versions import exact_matches, pairs_of

    rng = random.Random(21)
    words = "alpha beta gamma delta study design safety dose visit plan".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = []
    for v in range(6):
        old = [f"Title {v}"] + [say(rng.randint(2, 14)) for _ in range(9)]
        new = [f"Title {v}"] + [t if rng.random() < 0.4 else " ".join(w if rng.random() < 0.8 else rng.choice(words) for w in t.split()) for t in old[1:]]
        texts += ["\n".join(old), "\n".join(new[: rng.randint(5, 10)])]
    a = U.anchors(U.with_sections(U.units(docs(spark, *texts)))).cache()
    p = pairs_of(a).cache()
    assert p.count() == 6
    rows = {}
    for r in a.collect():
        rows.setdefault(r.doc_id, []).append(r)
    c = chunks.chunks(a, 20).withColumn("embedding", chunks.embed(F.col("text"))).cache()
    first = {(r.doc_id, r.anchor_id): r.chunk_id for r in align.unit_chunks(c).collect()}
    vector = {r.chunk_id: np.array(r.embedding) for r in c.collect()}
    exact = exact_matches(a, p).cache()
    done = {(r.from_doc, r.from_anchor) for r in exact.collect()}, {(r.to_doc, r.to_anchor) for r in exact.collect()}
    for given in (None, c):
        want = set()
        for q in p.collect():
            for kind in ("hdr", "p"):
                found, by = [], {}
                for x in rows[q.from_doc]:
                    for y in rows[q.to_doc]:
                        if x.kind != kind or y.kind != kind or (q.from_doc, x.anchor_id) in done[0] or (q.to_doc, y.anchor_id) in done[1]:
                            continue
                        cosine = float(np.clip(vector[first[q.from_doc, x.anchor_id]] @ vector[first[q.to_doc, y.anchor_id]], 0, 1)) if given is not None else 0.0
                        s, method = align.score(x.text_norm, y.text_norm, x.section_path, y.section_path, True, True, cosine)
                        if s >= align.LEAST_SCORE:
                            found.append((s, x.para_index, y.para_index))
                            by[x.para_index, y.para_index] = (x.anchor_id, y.anchor_id, method)
                want |= {(q.from_doc, q.to_doc, *by[i, j][:2], round(s, 5), by[i, j][2]) for s, i, j in align.greedy(found)}
        m = align.align(a, p, exact, given).cache()
        got = {(r.from_doc, r.to_doc, r.from_anchor, r.to_anchor, round(r.score, 5), r.method) for r in m.collect() if r.method != "exact_hash"}
        assert got == want and len(want) > 3
    cites = a.select("anchor_id", F.col("doc_id").cast("string").alias("section")).distinct()
    matched = {(r.from_doc, r.from_anchor): r.score for r in m.collect()}
    removed = p.join(a.select(F.col("doc_id").alias("from_doc"), "anchor_id"), "from_doc").join(m.select("from_doc", F.col("from_anchor").alias("anchor_id")), ["from_doc", "anchor_id"], "left_anti")
    hit = {r.section: (r.reasons, r.anchors) for r in align.impact(m, removed, cites).collect()}
    for q in p.collect():
        changed = sorted(r.anchor_id for r in rows[q.from_doc] if matched.get((q.from_doc, r.anchor_id), 1) < 0.95)
        gone = sorted(r.anchor_id for r in rows[q.from_doc] if (q.from_doc, r.anchor_id) not in matched)
        reasons = ["changed"] * bool(changed) + ["deleted"] * bool(gone)
        assert hit.get(str(q.from_doc), ([], [])) == (reasons, sorted(changed + gone))


def test_zones(spark):
    df = spark.createDataFrame([("Study design",), ("Дизайн исследования",), ("Intro/Sample size calculation",), ("nothing",), ("ROOT",), (None,), ("Ethics/Informed consent",)], "p string")
    got = [r.z.zone for r in df.select(classify.zone_of(F.col("p")).alias("z")).collect()]
    assert got == ["design", "design", "statistics", "unknown", "unknown", "unknown", "ethics"]


SAYINGS = [
    ("Protocol version: 2.0", "protocol_version", "2.0"),
    ("Версия протокола 3.1", "protocol_version", "3.1"),
    ("Protocol No. ABC-123/45", "protocol_id", "ABC-123/45"),
    ("A phase II/III trial", "phase", "II/III"),
    ("Amendment Date: 05 March 2021", "protocol_date", "2021-03-05"),
    ("Дата: 5 марта 2021", "protocol_date", "2021-03-05"),
    ("Protocol date 31.02.2021", "protocol_date", None),
    ("Sponsor: Acme Pharma Ltd. Moscow", "sponsor_name", "Acme Pharma Ltd"),
    ("Sponsor: to be determined", "sponsor_name", None),
    ("randomised in a ratio of 2 to 1", "design.randomization_ratio", "2:1"),
    ("a double-blind study", "design.masking", "double"),
    ("перекрёстное исследование", "design.configuration", "crossover"),
    ("Total N = 120 participants", "planned_n_total", "120"),
    ("Sample size: 1 200 subjects", "planned_n_total", "1200"),
    ("N = 0", "planned_n_total", None),
    ("aged 65-18 years", "age_range", None),
    ("женщины, возраст 18-45", "age_range", "18-45"),
    ("женщины, возраст 18-45", "age_min", "18"),
    ("женщины, возраст 18-45", "gender", "female"),
    ("men and women of any age", "gender", "both"),
    ("males only", "gender", "male"),
    ("a single dose of 2,5 mg/kg", "dosage", "2.5 mg/kg"),
    ("taken orally twice daily", "route", "oral"),
    ("taken orally twice daily", "frequency", "twice_daily"),
    ("Treatment duration: 12 weeks", "treatment_duration", "12 week"),
    ("Период отмывки составит 7 дней", "washout_period", "7 day"),
    ("significance level of 0,05", "alpha", "0.05"),
    ("Primary endpoint: overall survival at two years", "primary", "overall survival at two years"),
    ("PK parameters: Cmax, Tmax and AUC0-t", "pk_parameters", "auc0-t,cmax,tmax"),
    ("120 ml of blood volume of 80 ml", "blood_sampling_volume", "80 ml"),
    ("under fasting conditions", "fasting_condition", "fasting"),
    ("nothing of the kind", None, None),
]


def test_fact_rules(spark):
    df = spark.createDataFrame([(i, str(i), t) for i, (t, _, _) in enumerate(SAYINGS)] + [(99, "n", None)], "doc_id long, anchor_id string, text_norm string")
    got = {(r.doc_id, r.fact_key): r.value for r in facts.arbitrate(facts.extract(df)).collect()}
    assert [(x[0], x[1], got.get((i, x[1]))) for i, x in enumerate(SAYINGS)] == SAYINGS
    assert not any(d in (len(SAYINGS) - 1, 99) for d, _ in got)


def test_preferred_zones_and_core_facts(spark):
    c = spark.createDataFrame([(1, "a", "population", "planned_n_total", 0, 300, "100", 0.9), (1, "b", "population", "planned_n_total", 0, 300, "120", 0.9), (2, "c", "population", "planned_n_total", 0, 300, "80", 0.9)], "doc_id long, anchor_id string, fact_type string, fact_key string, rule int, priority int, value string, confidence double")
    zones = spark.createDataFrame([("a", "statistics"), ("b", "other"), ("c", "other")], "anchor_id string, source_zone string")
    got = facts.prefer_zones(c, zones, {"population": ["statistics"]})
    assert sorted((r.doc_id, r.value, r.confidence) for r in got.collect()) == [(1, "100", 0.95), (2, "80", 0.9)]
    other = spark.createDataFrame([(1, "planned_n_total", "90", 1.0, "z"), (1, "phase", "II", 0.5, "z"), (3, "phase", None, 0.5, "z")], "doc_id long, fact_key string, value string, confidence double, anchor_id string")
    built = facts.core_facts({"anchors": got, "facts": other})
    assert sorted((r.doc_id, r.fact_key, r.value, r.origin, r.evidence) for r in built.collect()) == [(1, "phase", "II", "facts", ["z"]), (1, "planned_n_total", "100", "anchors", ["a"]), (2, "planned_n_total", "80", "anchors", ["c"])]
    saved = spark.createDataFrame([(1, 4), (1, 2)], "doc_id long, facts_version int")
    assert {(r.doc_id, r.facts_version) for r in facts.next_version(saved, built).collect()} == {(1, 5), (2, 1)}


def test_all_rules_compile():
    assert len(facts.rules()) == 33


def test_conflicts(spark):
    e = spark.createDataFrame(
        [(1, "n", "100", "study_design", 0.9), (1, "n", "100", "statistics", 0.9), (1, "n", "120", "study_design", 0.9), (2, "n", "100", "statistics", 0.9), (2, "n", "примерно 120", "other", 0.3), (3, "n", "100", None, 0.9)],
        "doc_id long, fact_key string, value string, source_zone string, confidence double",
    )
    got = {r.doc_id: r for r in facts.conflicts(e, {"n": ["statistics", "study_design"]}).collect()}
    assert got[1].severity == "block" and not got[1].auto_resolve and got[1]["values"] == 2
    assert got[2].severity == "warn" and got[2].auto_resolve and got[2].best == "100"
    assert 3 not in got


def test_upsert(spark):
    cols = "doc_id long, fact_type string, fact_key string, value string, confidence double"
    old = spark.createDataFrame([(1, "t", "a", "x", 0.9, "validated"), (1, "t", "b", "x", 0.9, "extracted"), (1, "t", "c", "x", 0.9, "extracted")], cols + ", status string")
    new = spark.createDataFrame([(1, "t", "a", "y", 0.9), (1, "t", "b", "y", 0.9), (1, "t", "d", "z", 0.9)], cols)
    got = {r.fact_key: (r.value, r.status) for r in facts.upsert(old, new).collect()}
    assert got == {"a": ("x", "validated"), "b": ("y", "needs_review"), "c": ("x", "extracted"), "d": ("z", "extracted")}


def test_audits(spark):
    u = U.units(docs(spark, "TBD fill this\nThe ECG (ECG) is used and the MRI too", "fine"))
    got = {(r.auditor, r.category, r.detail) for r in audit.placeholders(u).union(audit.abbreviations(u)).collect()}
    assert ("placeholder", "tbd", "TBD") in got and ("abbreviation", "missing", "MRI") in got
    issues, failed = audit.run_all({"a": lambda: audit.placeholders(u), "b": lambda: u.select("nope")}, spark)
    assert issues.count() == 1 and set(failed) == {"b"}


def test_clusters():
    x = clusters.tfidf(["study design", "study design plan", "safety data", "safety data set", "zzz"])
    label = clusters.average_linkage(x, 0.6)
    assert label[0] == label[1] != label[2] == label[3]
    assert clusters.merge_centroids(np.array([[1.0, 0], [0.99, 0.01], [0, 1.0]])) == [0, 0, 2]


def _clustered(headings):
    """All headings of a group at once, in one process."""
    distinct = sorted(set(headings))
    x = clusters.tfidf(distinct)
    label = clusters.average_linkage(x, ranks=clusters.tie_ranks(distinct))
    kinds = sorted(set(label))
    centroids = np.array([x[[i for i, c in enumerate(label) if c == k]].mean(axis=0) for k in kinds])
    to = clusters.merge_centroids(centroids)
    label = [to[c] for c in label]
    size = {c: sum(headings.count(h) for h, k in zip(distinct, label) if k == c) for c in set(label)}
    return {frozenset(h for h, k in zip(distinct, label) if k == c) for c in set(label) if size[c] >= 3}


def test_clusters_of_parts_equal_those_of_all(spark):
    rng = random.Random(7)
    pool = ["study", "design", "safety", "data", "plan", "of", "the", "analysis", "set", "visit", "dose"]
    rows = []
    for grp in ("a", "b", None):
        bases = [[rng.choice(pool) for _ in range(rng.randint(2, 7))] for _ in range(25)]
        for _ in range(120):
            one = list(rng.choice(bases))
            if rng.random() < 0.5:
                one.append(rng.choice(pool))
            rows.append((grp, " ".join(one)))
    got = clusters.cluster_headings(spark.createDataFrame(rows, "grp string, text_norm string")).collect()
    for grp in ("a", "b", None):
        mine = [r for r in got if r.grp == grp]
        want = _clustered([h for g, h in rows if g == grp])
        assert len(want) > 3 and {frozenset(r.heading for r in mine if r.cluster_id == c) for c in {r.cluster_id for r in mine} - {None}} == want
    same = clusters.cluster_headings(spark.createDataFrame(rows, "grp string, text_norm string"), alone=3).collect()
    assert sorted((r.grp or "", r.heading, r.cluster_id or "") for r in same) == sorted((r.grp or "", r.heading, r.cluster_id or "") for r in got)
    summed = clusters.summaries(spark.createDataFrame([("a", "x y", 3, "k"), ("a", "x z", 1, "k"), ("a", "q", 1, None)], "grp string, heading string, n long, cluster_id string")).collect()
    assert len(summed) == 1 and summed[0].top_titles == ["x y", "x z"] and summed[0]["size"] == 4
    assert np.allclose(summed[0].embedding, (3 * chunks.hashed_embedding("x y") + chunks.hashed_embedding("x z")) / 4, atol=1e-6)


def test_linkage_in_rounds_equals_that_of_one_task(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join(words[i : i + 9]) for i in range(50)]  # every heading is near its neighbours, ties all along
    loose = [" ".join(rng.choices(words[:12], k=rng.randint(3, 9))) for _ in range(40)]
    both, want = [], {}
    for group, texts in (("chain", sorted(set(chain))), ("loose", sorted(set(loose)))):
        label = clusters.average_linkage(clusters.tfidf(texts), 0.4, clusters.tie_ranks(texts))
        want |= {(group, t): texts[label.index(c)] for t, c in zip(texts, label)}
        both += [(group, t) for t in texts]
        assert len(set(label)) < len(texts)
    rows = clusters.vectors(spark.createDataFrame(both, "grp string, heading string"))
    got = {(r.grp, r.heading): r.cluster for r in clusters.linkage_rounds(rows, 0.4).collect()}
    assert got == {k: want[k] for k in got} and len(got) > 80


def test_most_frequent_terms(spark):
    rng = random.Random(3)
    rows = [(g, f"t{i:03d}", rng.randint(1, 6)) for g in ("a", "b", None) for i in range(rng.randint(5, 60))]
    frame = spark.createDataFrame(rows, "grp string, term string, total long")
    for features in (1, 7, 20, 100):
        want = [x for g in ("a", "b", None) for x in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:features]]
        found = clusters.most_frequent(frame, features, range_rows=5)
        assert sorted(map(str, (tuple(r) for r in clusters.most_frequent(frame, features).collect()))) == sorted(map(str, want))
        assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, want))
        if features == 7:  # ties are numbered by ranges
            assert "[grp" not in "".join(x for x in found._jdf.queryExecution().toString().split("Window ")[1:] if x.startswith("[") and "_range" not in x.split("\n")[0])


def test_contract_drafts(spark):
    df = spark.createDataFrame([("g", "c", ["Study design", "Design of the study", "Study design plan"])], "grp string, cluster_id string, top_titles array<string>")
    d = clusters.contract_drafts(df).first()
    assert d.section == "study_design" and d.must == ["design", "study"] and d.should == [] and '"capture":"heading_block"' in d.draft


def test_contracts_in_all_forms():
    assert sections.required_facts(["a", "b"]) == [{"fact_key": "a", "required": True}, {"fact_key": "b", "required": True}]
    assert sections.required_facts({"facts": ["a"]}) == sections.required_facts([{"fact_key": "a"}]) == [{"required": True, "fact_key": "a"}]
    assert sections.required_facts(None) == sections.required_facts({}) == []
    assert sections.required_facts({"facts": [{"fact_key": "a", "required": False}]}) == [{"required": False, "fact_key": "a"}]
    c = sections.contract({"section": "x", "heading_match": "Study"})
    assert c.must == ("study",) and c.should == () and c.pattern is None
    assert sections.contract({"section": "x", "heading_match": ["A", "B"], "regex": "^z"}).pattern == "^z"


def test_section_maps(spark):
    long = "x" * 50
    a = U.anchors(U.with_sections(U.units(docs(spark, f"Safety\n{long} one\nSafety part\n{long} two\nDesign\n{long} three", f"nothing here\n{long}"))))
    listed = [sections.Contract("safety", ("safety",)), sections.Contract("design", ("design",), pattern="^D"), sections.Contract("parts", ("safety", "part"))]
    maps = sections.map_sections(a, listed).cache()
    text = {r.anchor_id: r.text_norm for r in a.collect()}
    got = {(r.doc_id, r.section): (tuple(text[i].split()[-1] for i in r.anchor_ids), r.confidence, r.status) for r in maps.collect()}
    assert got[0, "safety"] == (("Safety", "one"), 0.6, "needs_review")
    assert got[0, "parts"] == (("part", "two"), 0.8, "mapped")  # the surer map keeps what both claim
    assert got[0, "design"] == (("Design", "three"), 0.9, "mapped")
    assert got[1, "safety"] == ((), 0.0, "needs_review") and maps.filter("doc_id = 1 AND notes = 'no heading match for safety'").count() == 1
    changes = spark.createDataFrame([(0, "safety", ["z"], None), (1, "safety", None, "seen"), (7, "own", ["q"], None)], "doc_id long, section string, anchor_ids array<string>, notes string")
    laid = sections.override(maps, changes).cache()
    got = {(r.doc_id, r.section): r for r in laid.collect()}
    assert got[0, "safety"].anchor_ids == ["z"] and got[0, "safety"].status == "overridden" and got[0, "safety"].confidence == 0.6
    assert got[1, "safety"].anchor_ids == [] and got[1, "safety"].notes == "seen" and got[1, "safety"].mapped_by == "user"
    assert got[7, "own"].confidence == 1.0 and got[0, "parts"].status == "mapped"
    kept = {(r.doc_id, r.section): r for r in sections.rebuild(laid, maps).collect()}
    forced = {(r.doc_id, r.section): r for r in sections.rebuild(laid, maps, force=True).collect()}
    assert kept[0, "safety"].anchor_ids == ["z"] and forced[0, "safety"].anchor_ids != ["z"] and forced[0, "safety"].status == "needs_review"
    assert kept[7, "own"].status == forced[7, "own"].status == "overridden"


def test_topic_maps(spark):
    assigned = spark.createDataFrame([(1, 1, "a", 0.6), (1, 2, "a", 0.8), (1, 3, "b", 0.5), (1, 4, None, None)], "doc_id long, block_no long, topic string, score double")
    members = spark.createDataFrame([(1, b, 10 * b + i, f"u{b}{i}") for b in range(1, 5) for i in range(2)], "doc_id long, block_no long, para_index int, anchor_id string")
    got = {r.topic: (r.blocks, r.anchor_ids, r.confidence) for r in topics.topic_maps(assigned, members).collect()}
    assert got == {"a": ([1, 2], ["u10", "u11", "u20", "u21"], 0.7), "b": ([3], ["u30", "u31"], 0.5)}


def test_numbers_over_ranges(spark):
    from stemma.operators.ordering import numbered

    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i, rng.randrange(5)) for i in range(300)]
    got = numbered(spark.createDataFrame(rows, "g string, id long, r int"), "g", ["r", "id"], "id", range_rows=7).collect()
    assert len(got) == 300
    for g in ("hot", "a", "b", None):
        mine = sorted((r, i) for x, i, r in rows if x == g)
        place = {i: k for k, (_, i) in enumerate(mine)}
        for x in got:
            if x.g == g:
                k = place[x.id]
                assert (x.no, x.previous) == (k + 1, mine[k - 1][1] if k else None)


def test_components(spark):
    rng = random.Random(3)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [(f"m{rng.randrange(30)}", f"m{rng.randrange(30)}") for _ in range(25)]
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    to = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            to[a] = to[b] = min(to[a], to[b])
    assert got == to


def test_topics_see_their_predecessor(spark):
    b = spark.createDataFrame([(1, 1, "Safety", "", "z"), (1, 2, "unclear", "", "z"), (2, 1, "unclear", "", "z")], "doc_id long, block_no long, heading string, text string, zone string")
    got = {(r.doc_id, r.block_no): r.topic for r in topics.assign(b, [{"key": "safety", "aliases": ["safety"], "priors": {"z": 0.9}}]).collect()}
    assert got == {(1, 1): "safety", (1, 2): "safety", (2, 1): None}


@pytest.mark.parametrize("values, p, want", [([5.0], 50, 5.0), ([3.0, 1.0, 2.0], 50, 2.0), ([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0], 90, 9.0), ([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0], 10, 1.0)])
def test_percentiles(spark, values, p, want):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.agg(metrics.p_nearest_rank(F.col("v"), p).alias("x")).first().x == want


def test_percentile_of_nothing(spark):
    assert spark.createDataFrame([], "v double").agg(metrics.p_nearest_rank(F.col("v"), 50).alias("x")).first().x == 0.0


def test_quality_gate(spark):
    r = metrics.quality_gate(spark.createDataFrame([(50, 30, 0.1)], "anchors long, headings long, unknown_rate double")).first()
    assert r.flags == ["few_anchors"] and r.status == "needs_review"


def _topic_walk(blocks, topics):
    """The assignment of one document's blocks (heading, text, zone) in plain Python."""
    out, before = [], None
    for heading, text, zone in blocks:
        h, best = (heading or "").lower(), (0.0, None, 1.0)
        everything = f"{h} {(text or '').lower()}"
        v = chunks.hashed_counts(f"{heading or ''} {text or ''}")
        for t in topics:
            if any(x in h for x in t.get("exclude", ())):
                continue
            words, p = t.get("keywords", []), chunks.hashed_counts(topics_prototype(t))
            norm = np.sqrt(v @ v) * np.sqrt(p @ p)
            e = max(0.0, v @ p) / norm if norm else 0.0
            head = topics.match(heading or "", t.get("aliases", []))
            k = min(0.8, 0.8 * sum(w in everything for w in words) / len(words)) if words else 0.0
            prior = t.get("priors", {}).get(zone, 0.5)
            named = max(head, 0.7 * k)
            s = 0.5 * e + 0.3 * named + 0.2 * prior if e > 0 else 0.5 * named + 0.3 * prior
            s = min(1.0, s + (0.2 if before == t["key"] and head < 0.4 and k < 0.4 else 0.0))
            s = (min(1.0, 1.2 * s) if head > 0.7 else s) * (0.2 if prior < 0.2 else 1.0)
            if s > best[0]:
                best = (s, t["key"], 0.45 if prior >= 0.7 else 0.55)
        before = best[1] if best[1] and best[0] >= best[2] else None
        out.append((before, round(best[0], 9) if before else None))
    return out


class _Topics(list):
    match = staticmethod(topics.heading_match)


topics_prototype = topics.prototype


def test_topics_equal_brute_force(spark):
    rng = random.Random(13)
    words = "safety adverse event dose visit schedule consent risk plan the of study".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    listed = _Topics([{"key": "safety", "aliases": ["adverse events", "safety"], "keywords": ["safety", "risk"], "priors": {"z": 0.8, "y": 0.1}}, {"key": "visits", "keywords": ["visit", "schedule", "dose"], "priors": {"z": 0.3}, "prototype": "visit schedule plan"}, {"key": "other", "aliases": ["consent"], "exclude": ["dose"], "prototype": "consent of the study"}])
    docs_ = {d: [(rng.choice([None, "", say(2), "Adverse event", "SAFETY first"]), rng.choice([None, "", say(8)]), rng.choice(["z", "y", None])) for _ in range(rng.randint(1, 12))] for d in range(40)}
    rows = [(d, i, *b) for d, bs in docs_.items() for i, b in enumerate(bs)]
    got = {(r.doc_id, r.block_no): (r.topic, None if r.score is None else round(r.score, 9)) for r in topics.assign(spark.createDataFrame(rows, "doc_id long, block_no long, heading string, text string, zone string"), listed).collect()}
    want = {(d, i): x for d, bs in docs_.items() for i, x in enumerate(_topic_walk(bs, listed))}
    assert got == want and len({t for t, _ in want.values()}) == 4


def test_numbers_within_a_tolerance(spark):
    rng = random.Random(4)
    number = lambda: rng.choice([0.0, 1.0, -1.0, 100.0, rng.uniform(-5, 5), 10 ** rng.uniform(-3, 6)]) * rng.choice([1, 1, 1.004, 0.996, 1.0101])
    a, b = ([(rng.randint(0, 4), number()) for _ in range(150)] for _ in range(2))
    frame = lambda rows: spark.createDataFrame(rows, "k int, value double")
    for tolerance in (0.005, 0.01, 0.3):
        want = {(k, x) for k, x in a if any(k == j and abs(x - y) <= tolerance * max(abs(x), abs(y)) for j, y in b)}
        assert {(r.k, r.value) for r in audit.within(frame(a), frame(b), ["k"], tolerance).collect()} == want
    text = lambda rows: spark.createDataFrame(rows, "section string, text string")
    got = audit.unsupported_numbers(text([("s", "12 of 300 and -4.5"), ("t", None)]), text([("s", "301 were 12.0"), ("t", "1")])).collect()
    assert [(r.section, r.check, r.value) for r in got] == [("s", "unsupported_number", -4.5)]


def test_facts_of_two_roles(spark):
    rows = [(1, "protocol", "visits", 5.0, None), (1, "consent", "visits", 6.0, None), (1, "consent", "visits", 5.0, None), (2, "protocol", "visits", 5.0, None), (2, "consent", "visits", 6.0, None), (3, "protocol", "blood", 250.0, "ml"), (3, "consent", "blood", 0.25, "L"), (4, "protocol", "blood", 90.0, "ml"), (4, "protocol", "other", 1.0, None), (5, "protocol", "visits", None, None)]
    got = audit.role_differences(spark.createDataFrame(rows, "study int, role string, fact_key string, value double, unit string"), "protocol", "consent", ["visits", "blood"])
    assert sorted((r.study, r.fact_key, r.a, r.b, r.issue) for r in got.collect()) == [(2, "visits", 5.0, 6.0, "differs"), (4, "blood", 90.0, None, "missing")]


def test_limits_by_the_number_of_headings(spark):
    c = [sections.contract({"section": "s", "heading_match": {"must": ["alpha"], "should": ["beta", "gamma"]}})]
    plain = lambda n: [f"Head {i}" for i in range(n)]
    rich = ["Alpha", *plain(30), "Alpha beta gamma"]
    texts = ["\n".join(x) for x in (["Alpha"], ["Alpha", *plain(6), "Alpha beta"], rich, ["Alpha", *plain(31), "Alpha beta"])]
    a = U.anchors(U.with_sections(U.units(docs(spark, *texts))))
    got = {r.doc_id: (r.para_index, r.score, r.sure) for r in sections.best_headings(a, c).collect()}
    assert sorted(got.values()) == sorted([(0, 2, True), (7, 3, True), (31, 4, True), (32, 3, False)])
    maps = {r.doc_id: (r.confidence, r.status) for r in sections.map_sections(a, c).collect()}
    assert sorted(maps.values()) == sorted([(0.6, "needs_review"), (0.7, "mapped"), (0.8, "mapped"), (0.5, "needs_review")])
