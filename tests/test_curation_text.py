"""Greedy de-duplication, diversity pick, text operators."""

from zonepulse.operators import curation as C
from zonepulse.operators import text as Tx
from zonepulse.plans.insights import collect_insights


def _insights(spark, rows):
    schema = ("insight_id string, detector_ord int, emit_a double, category string, title string, metric string, "
              "country string, city string, zone string, severity_score double, summary string, "
              "recommendation_hint string, confidence string, affected_zones_count long")
    return spark.createDataFrame([(str(r[0]), r[1], -float(r[2]), *r[3:]) for r in rows], schema).selectExpr(
        "*", "0.0D AS emit_b", "0 AS emit_rule", "0 AS emit_pair", "CAST(NULL AS STRING) AS emit_type")


def test_greedy_dedup_chain(spark):
    # A(P1,S1) kept; B(P2,S1) dropped by S1; C(P2,S3) kept because B never registered P2
    rows = [
        (1, 1, 1, "trends", "t", "P1", "X", "Y", "Z", 90.0, "S1", "h", None, 1),
        (2, 1, 2, "trends", "t", "P2", "X", "Y", "Z", 80.0, "S1", "h", None, 1),
        (3, 1, 3, "trends", "t", "P2", "X", "Y", "Z", 70.0, "S3", "h", None, 1),
        (4, 3, 1, "correlations", "t", "P1", "X", None, None, 60.0, "S1", "h", None, 1),
        (5, 3, 2, "correlations", "t", "P1", "X", None, None, 50.0, "S1", "h", None, 1),
    ]
    out = C.deduplicate(C.with_priority(_insights(spark, rows)))
    assert sorted(r.insight_id for r in out.collect()) == ["1", "3", "4", "5"]


def test_diversity_phase_two(spark):
    rows = [(i, 0, i, "anomalies", "t", f"m{i}", "X", "Y", f"Z{i}", 100.0 - i, f"s{i}", "h", "high", 1) for i in range(1, 5)]
    rows.append((10, 1, 1, "trends", "t", "m", "X", "Y", "Q", 10.0, "s", "h", None, 1))
    cand = C.limit_per_zone(C.deduplicate(C.with_priority(_insights(spark, rows))), 1)
    sel = C.category_diversity(cand, 5, 2).orderBy("summary_ord").collect()
    assert [r.insight_id for r in sel] == ["1", "10", "2"]


def test_business_terms(spark):
    df = spark.createDataFrame([("Which are the problematic zones?",), ("¿Cuáles son las zonas problemáticas?",),
                                ("Show Lead Penetration by country",), ("problem zones Clarification: done",)], "text string")
    r = Tx.tag_business_terms(df).collect()
    assert [x.term_tag for x in r] == ["problem_zones", "problem_zones", None, None]
    assert r[0].enriched_text.startswith("Which are the problematic zones? Clarification: ")
    assert r[2].enriched_text == "Show Lead Penetration by country"


def test_follow_up_and_carry_forward(spark):
    turns = ["What is the average Lead Penetration by country?", "What about in Mexico?",
             "Which are the top 5 zones with highest Lead Penetration this week?", "Only Wealthy zones.",
             "Show the markdown report", "for it?"]
    df = spark.createDataFrame([(7, i, t) for i, t in enumerate(turns)], "conv_id long, turn long, text string")
    r = Tx.carry_forward_metric(df, chunk=2).orderBy("turn").collect()
    assert [x.follow_up for x in r] == [False, True, False, True, False, True]
    assert [x.resolved_metric for x in r] == ["Lead Penetration", "Lead Penetration", "Lead Penetration",
                                              "Lead Penetration", None, "Lead Penetration"]


def test_mask_and_preview(spark):
    df = spark.createDataFrame([(1, "mail ab@x.org and jdoe@corp.example.com now")], "doc_id long, text string")
    r = Tx.extract_masked_emails(df).orderBy("pos").collect()
    assert [x.masked_email for x in r] == ["a***@x.org", "jd***@corp.example.com"]
    p = Tx.previews(spark.createDataFrame([(1, "  a\t b\n" + "x" * 200)], "id long, text string"), ["id"], max_len=10)
    assert p.collect()[0].preview == "a b xxxxxx..."


def test_insight_summary_formats(make_tables):
    m, o = make_tables([
        ("CO", "Bogota", "Chapinero", "Wealthy", "Prioritized", "Lead Penetration", 1, 100.0),
        ("CO", "Bogota", "Chapinero", "Wealthy", "Prioritized", "Lead Penetration", 0, 130.0),
    ])
    r = collect_insights(m, o).collect()[0]
    assert r.title == "Large WoW improvement in Lead Penetration"
    assert r.summary == "Lead Penetration in Chapinero (Bogota, CO) shows a 30.00% week-over-week improvement."


def test_dedup_compares_whole_summaries(spark):
    long = "s" * 130
    rows = [(i, 0, i, "anomalies", "t", f"m{i}", "X", "Y", "Z", 90.0 - i, long + str(i), "h", "high", 1) for i in range(3)]
    assert C.deduplicate(C.with_priority(_insights(spark, rows))).count() == 3


def test_fold_spells_ligatures_out(spark):
    from zonepulse.functions.text import normalize_for_match

    cases = {"\ufb01ne caf\u00e9": "fine cafe", "1\u00ba \uff21\uff42": "1o ab", "\u00bd\u00df\u4e2d x": "12 x", "plain": "plain"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.n for r in df.select("t", normalize_for_match("t").alias("n")).collect()}
    assert got == cases


def test_email_validity(spark):
    from zonepulse.functions.text import is_email

    cases = {" a@b.c ": True, "a@b": False, "a b@c.d": False, "a@@b.c": False, "": False, None: False, "x@y.z.w": True}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.v for r in df.select("t", is_email("t").alias("v")).collect()} == cases


def test_carry_forward_with_null_keys_and_repeated_turns(spark):
    import random

    rng = random.Random(6)
    say = ["Orders here", "same now", "tell me more about the weather of that place please", "Perfect Orders only", "for it?", None, ""]
    rows = [(rng.choice([None, None, 1, 2]), rng.choice([None, *range(-3, 5010, 7)]), rng.choice(say)) for _ in range(900)]
    rows += [(None, 1, "Lead Penetration?"), (None, 5000, "and now"), (1, 3, "Orders"), (1, 3, "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(5)
    want = []
    for key in {r[0] for r in rows}:
        last = None
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or ""))
        for _, turn, text in own:
            metric = next((m for m in Tx.DEFAULT_METRIC_VOCABULARY if m.lower() in (text or "").lower()), None)
            low = (text or "").strip().lower()
            tokens = low.replace("?", " ").replace(".", " ").split()
            follow = low != "" and (any(m in low for m in Tx.FOLLOW_UP_MARKERS) or len(tokens) <= 5 and bool({*tokens} & {*Tx.SHORT_QUESTION_TOKENS}))
            want.append((key, turn, text, metric or (last if follow else None)))
            last = metric or last
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))
    for chunk in (4096, 3):
        got = Tx.carry_forward_metric(df, chunk=chunk).select("conv_id", "turn", "text", "resolved_metric")
        assert order(map(tuple, got.collect())) == order(want)


def test_greedy_dedup_equals_a_plain_walk(spark):
    import random

    rng = random.Random(9)
    rows = [
        (i, rng.randrange(3), rng.randrange(50), rng.choice(["anomalies", "trends"]), "t", rng.choice(["M1", " m1 ", "M2", "M3", "M4", ""]), "X", "Y",
         rng.choice(["Z1", "z1 ", "Z2", None]), float(rng.randrange(5)), rng.choice(["S1", "s1", "S2", "S3", "S 4"]), "h", None, rng.randrange(9))
        for i in range(400)
    ]
    scored = C.with_priority(_insights(spark, rows))
    walk = [r.asDict() for r in scored.withColumn("zone_key", C.zone_key()).orderBy(*C.rank_order(), "insight_id").collect()]
    seen, stays = {}, []
    squeeze = lambda x: " ".join((x or "").lower().split())
    for r in walk:
        if r["zone_key"]:
            metrics, summaries = seen.setdefault((r["category"], r["zone_key"]), (set(), set()))
            if squeeze(r["metric"]) in metrics or squeeze(r["summary"]) in summaries:
                continue
            metrics.add(squeeze(r["metric"]))
            summaries.add(squeeze(r["summary"]))
        stays.append(r["insight_id"])
    found = C.deduplicate(scored)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and "Pandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.insight_id for r in found.collect()) == sorted(stays)


def test_many_terms_equal_a_plain_search(spark):
    import random

    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcz .+(é") for _ in range(n))
    rules = tuple((f"g{i}", tuple(w for w in (word(rng.randint(3, 7)) for _ in range(4000)) if w == " ".join(w.split()) and w.isascii())) for i in range(3))
    rules = (*rules, ("few", ("(", "z+")))
    texts = [word(rng.randint(0, 14)) for _ in range(600)] + [None, "", " \t", "(", "x" * 5000 + rules[2][1][0]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    found = {r.id: r.term_tag for r in Tx.tag_business_terms(df, rules=rules, clarifications={}).select("id", "term_tag").collect()}
    for i, t in enumerate(texts):
        plain = " ".join((t or "").replace("é", "e").split())
        assert found[i] == next((g for g, words in rules if any(w in plain for w in words)), None), t


def test_fold_equals_unicode_decomposition(spark):
    import random
    import unicodedata

    rng = random.Random(3)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3400), rng.randrange(0xF900, 0xFFFE), rng.randrange(0x1D400, 0x1F300)])) for _ in range(40))
             for _ in range(300)] + ["\ue000\ufb01", "\ue000", "", None]
    from zonepulse.functions.text import fold_accents

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = {r.id: r.n for r in df.select("id", fold_accents("t").alias("n")).collect()}
    want = {i: t and "".join(c for c in unicodedata.normalize("NFKD", t) if c < "\x80") for i, t in enumerate(texts)}
    assert got == want
