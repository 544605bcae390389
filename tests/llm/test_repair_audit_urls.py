"""Conversation repair, filter interaction audit and URL filters against plain versions."""

import hashlib
import itertools
import random
import zlib
from math import factorial

import pyarrow as pa
import pytest

from tests.llm import brute
from tests.llm.conftest import documents, edge_rows, same_rows
from zonepulse.llm import conversation_repair as cr
from zonepulse.llm import filter_audit, url_filter

# ---- conversations ---------------------------------------------------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string, copies string, at string, first string, rows string, conv_key string, digest string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else str(x)
        hit = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if hit == 0:
            continue
        text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def plain_repair(rows, convs):
    """Every sequence of edits by dynamic programming over whole tables of (cost, audit, lines)."""
    out = []
    for conv in dict.fromkeys(convs):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, faults, illegal = set(), [], 0
        for k, (_, _, role, text) in enumerate(own):
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
            illegal += k > 0 and own[k - 1][2][:1] + role[:1] not in ("su", "ua", "au")
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0

        def states_after(initial, state):
            """The state after one more role initial, or None."""
            if initial == "s":
                return "s" if state == "" else None
            if initial == "u":
                return "u" if state in ("", "s", "a") else None
            return "a" if initial == "a" and state == "u" else None

        table = {"": (0, "", ())}

        def with_insertions(table):
            best = dict(table)
            for _ in range(2):
                for state, (cost, audit, lines) in list(best.items()):
                    for role in ("user", "assistant"):
                        to = states_after(role[0], state)
                        if to:
                            new = (cost + 5, audit + "I", (*lines, f"{role}:"))
                            best[to] = min(best.get(to, new), new)
            return best

        table = with_insertions(table)
        for (_, _, role, text), fault in zip(own, faults, strict=True):
            after = {}

            def offer(to, new, after=after):
                if to is not None:
                    after[to] = min(after.get(to, new), new)

            for state, (cost, audit, lines) in table.items():
                offer(state, (cost + 2, audit + "D", lines))
                if fault not in ("blank", "duplicate"):
                    more = 5 * (fault == "truncated")
                    offer(states_after(role[:1], state), (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                    for new_role in ("user", "assistant"):
                        offer(states_after(new_role[0], state), (cost + 1 + more, audit + "R", (*lines, f"{new_role}:{text}")))
            table = with_insertions(after)
        cost, audit, lines = min(table[s] for s in ("", "a") if s in table)
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, brute.sha("\n".join(lines).encode())))
    return out


def conversation_rows():
    rng = random.Random(5)
    say = ["Yes.", "No!", "Why?", "Then go", "x", "", "  \n", "Well. ", None, "漢字。", "So it is.\r\n"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User", "usher"]
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, 3, None, -2, 10**12]), rng.choice(roles[:4]) if rng.random() < 0.7 else rng.choice(roles), rng.choice(say)))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (None, None, None, None)]
    rows += [(500, 1, "user", "The same.")] * 700  # one row, very often
    rows += [(501, t, rng.choice(roles[:5]), rng.choice(say[:5])) for t in range(1500)]  # over several chunks
    rows += [(502, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(900)]
    rows += [(503, 7, "user", "w " * 70_000 + "."), (503, 8, "assistant", "漢" * 90_000)]
    rows += [(504, t, "user", "One text.") for t in range(600)]  # one text at many turns
    rng.shuffle(rows)
    return rows


RESULT = ["conv_id", *(name for name, _ in cr.RESULT)]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], CONV)


def test_repair_of_damaged_conversations(spark):
    rows = conversation_rows()
    found = cr.repair(cr.damaged(conversations(spark, rows)), copies_col="copies")
    assert found.columns == RESULT
    same_rows(found.collect(), plain_repair(plain_damage(rows), [r[0] for r in rows]))


def test_repair_of_rows_as_they_are(spark):
    rows = conversation_rows()
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    same_rows(cr.repair(conversations(spark, rows)).collect(), plain_repair(plain, [r[0] for r in rows]))


def test_repair_of_no_rows(spark):
    assert cr.repair(conversations(spark, [])).collect() == []
    assert cr.repair(cr.damaged(conversations(spark, [])), copies_col="copies").columns == RESULT


def test_a_conversation_that_is_dropped_whole(spark):
    conv = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = cr.repair(cr.damaged(conversations(spark, [(conv, 0, "user", "Hi.")])), copies_col="copies").collect()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", brute.sha(b""))


@pytest.mark.parametrize("chunk_rows", [1, 2, 3, 7])
def test_chunks_give_what_whole_conversations_give(monkeypatch, chunk_rows):
    """Any cut into chunks and streams: the derivations over chunks equal those over rows."""
    rng = random.Random(chunk_rows)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 14)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["A.", "B", "C!", "", "D."])))
    seen, given = set(), []
    for conv, turn, role, text in rows:
        given.append((conv, turn, role, text, 1, (conv, role, text) not in seen))
        seen.add((conv, role, text))
    monkeypatch.setattr(cr, "CHUNK_ROWS", chunk_rows)
    names = ["conv_id", "turn", "role", "text", "copies", "first"]
    done, chunks = [], []
    for at in range(0, len(given), 37):  # streams that end inside conversations
        batch = pa.RecordBatch.from_pylist([dict(zip(names, g, strict=True)) for g in given[at : at + 37]])
        for made in cr._derive_chunks(iter([batch])):
            for r in made.to_pylist():
                (done if r["edges"] is None else chunks).append(r)
    assert chunks
    batch = pa.RecordBatch.from_pylist(chunks, schema=cr.CHUNK)
    for made in cr._derive_conversations(iter([batch])):
        done += made.to_pylist()
    same_rows([tuple(r[c] for c in RESULT) for r in done], plain_repair(rows, [r[0] for r in rows]))


def test_the_agenda_pops_goals_by_cost_then_audit():
    rows = [cr.Row("assistant", "A.", 1, True), cr.Row("user", "B.", 1, True)]
    steps = [list(r.edits()) for r in rows]
    assert list(cr.lightest(steps, 0, cr.GOALS).items()) == [(3, (2, "RR")), (0, (4, "DD"))]
    assert cr.lightest(steps, 0, cr.GOALS, most=1) == {3: (2, "RR")}
    assert list(cr.replay(rows, "RR", 0)) == ["user:A.", "assistant:B."]
    alone = [cr.Row("system", "S.", 1, True)]  # nothing may follow: deleting is cheapest
    assert cr.lightest([list(alone[0].edits())], 0, cr.GOALS, most=1) == {0: (2, "D")}


# ---- filters ---------------------------------------------------------------------------------------------------------


def plain_audit(rows, labels):
    """rows: (doc_id, part, text); every order applied to the rows themselves."""
    smallest = {}
    for i, _, t in rows:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)

    def fails(i, t):
        t = t or ""
        w = brute.words(t)
        return {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and i > smallest[t],
        }

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = {}
    for i, part, t in rows:
        parts.setdefault(part or "", []).append((i, fails(i, t)))
    out = []
    for part, docs in parts.items():
        made = []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if d[1][x]]
                left = [d for d in left if not d[1][x]]
                redundant = sum(f[x] for _, f in docs) - len(gone)
                alone = sum(f[x] and sum(f.values()) == 1 for _, f in docs)
                made.append([part, "".join(order), step, len(left), len(gone), redundant, alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), x])
        total = {x: sum(m[4] for m in made if m[-1] == x) for x in "ABCDE"}
        out += [(*m[:-1], total[m[-1]]) for m in made]
    return out


def audit_rows():
    rng = random.Random(3)
    rows = [(i, None if n % 7 == 3 else "" if n % 7 == 4 else f"s{n % 3}", t) for n, (i, t) in enumerate(edge_rows())]
    for i in range(300):
        text = " ".join(rng.choice(["alpha", "Beta", "GAMMA", "d", "e$", "zeta"][: rng.choice([3, 6])]) + (str(rng.randrange(400)) if rng.random() < 0.6 else "") for _ in range(rng.choice([5, 199, 200, 201, 320])))
        rows.append((100 + i, f"s{i % 3}", text))
        if i % 4 == 0:
            rows.append((90 - i, f"s{i % 2}", text))
    return rows + [(700 + i, "s0", "one text, very often") for i in range(400)]


def audit_labels(rows):
    ids = [i for i, _, _ in rows]
    out = [(i, (n % 3 > 0) * 1, (n % 5 == 0) * 1) for n, i in enumerate(ids) if n % 2]
    return out + [(ids[1], 0, 1), (ids[3], None, None), (None, 1, 1), (10**9, 1, 1)]


def test_filter_audit(spark):
    rows = audit_rows()
    labels = audit_labels(rows)
    docs = spark.createDataFrame([(i, t, p, "x", "x", "x", "x") for i, p, t in rows], "doc_id long, text string, source string, part string, mask string, good string, n string")
    given = spark.createDataFrame([(*x, "x", "x") for x in labels], "doc_id long, quality int, toxic int, good string, first string")
    found = filter_audit.filter_audit(docs, given)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    same_rows(found.collect(), plain_audit(rows, labels))


def test_filter_audit_of_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(no_docs, labels).collect() == []
    found = filter_audit.filter_audit(documents(spark, [(1, "a b"), (2, "a b")]), labels)
    assert found.where("good_lost + toxic_lost > 0").count() == 0 and found.count() == 2 * factorial(5) * 5


def test_letters_are_checked(spark):
    with pytest.raises(ValueError):
        filter_audit.walk(spark.range(0), "AAB")


# ---- URLs ------------------------------------------------------------------------------------------------------------

URLS = [
    None, "", "http://", "no scheme", "http:///p", "http://org", "http://org/", "http://ORG/x", "ftp://a.org/", "http://example.org/es/", "http://example.org/es",
    "http://x.example.org/en/1", "http://x.example.org/en/19?a#b", "http://x.example.org/en/2", "http://badexample.org/es/1", "http://a.com/fr/", "http://a.com/fr",
    "http://a.com/de/x", "http://a.com/de?/de/", "http://a.com#/fr/", "http://a.com/x://b.org/", "HTTP://A.B.C.Example.Org/EN/1", "http://u@h.org:80/", "http://example.org./es/",
    "http://.org/", "http://a.org//es/", "a://b://c.org/x", "http://a.org/\nx?y", "http://ÄB.com/fr/é", "http://com/fr/" + "x" * 50_000, "http://" + "a." * 3000 + "org/",
]
RULES = [
    *url_filter.RULES, ("block", "a.com", "/fr/"), ("allow", "a.com", "/fr/"), ("allow", "b.a.com", ""), ("block", "A.com", "/fr/deep/er"), ("allow", "a.com", "/fr/deep"),
    ("block", "net", ""), ("allow", "x.net", "/a"), ("block", "x.net", "/a/b/"), ("allow", "y.x.net", "/"), ("block", "x.net", "/a/b/c/d/e/f"),
]


def plain_judge(url, rules, default):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [
        (len(h) + len(p), len(h), h + p, v)
        for v, h, p in ((v, h.lower(), p) for v, h, p in rules)
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def urls():
    rng = random.Random(8)
    made = [f"http://{'.'.join(rng.choices(['a', 'b', 'x', 'y', 'example'], k=rng.randint(0, 3)))}.{rng.choice(['com', 'org', 'net'])}/{'/'.join(rng.choices(['fr', 'de', 'es', 'en', '1', 'deep', 'a', 'b', 'c'], k=rng.randint(0, 7)))}" for _ in range(1500)]
    return list(enumerate(URLS + made)) + [(3, "http://a.com/fr/"), (3, "http://a.com/fr/"), (None, "http://a.org/")]


@pytest.mark.parametrize("options", [{}, {"most_entries": 5}, {"most_chars": 60, "default": "block"}])
@pytest.mark.parametrize("rules", [url_filter.RULES, RULES, RULES * 2])
def test_urls(spark, rules, options):
    if options and rules is url_filter.RULES:
        pytest.skip("one block")
    rows = urls()
    pages = spark.createDataFrame([(*r, *["x"] * 4) for r in rows], "page_id long, url string, html string, host string, rule string, verdict string")
    found = url_filter.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string") if options else rules, **options)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    same_rows(found.collect(), [(i, *plain_judge(u, rules, options.get("default", "allow"))) for i, u in rows])


def test_no_pages_or_no_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, url_filter.RULES).collect() == []
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    empty = spark.createDataFrame([], "verdict string, host string, path string")
    assert [tuple(r) for r in url_filter.judge(one, empty, default="block").collect()] == [(1, "a.org", "/", None, "block")]
    with pytest.raises(ValueError):
        url_filter.judge(one, [("deny", "a.org", "/")])
    with pytest.raises(ValueError):
        url_filter.judge(one, [], default="maybe")
