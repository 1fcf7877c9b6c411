"""op2, op4, op5, op6: contracts against brute force on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamwork.llm import neardup, pii, quality, substring
from tests.llm.fixtures import docs, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")


def features(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_features_and_base_rules(spark):
    rows = odd_rows()
    got = quality.judge(docs(spark, rows)).collect()
    expected = Counter((i, *features(t)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == expected
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_host_rates_shrink_and_reject(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "a b c"
    rows = [(i, bad if i % 50 else good, "bad") for i in range(400)] + [(1000 + i, good, "good") for i in range(1000)] + [(5000, bad, "tiny"), (5001, good, "tiny")]
    got = {r.doc_id: r for r in quality.judge(docs(spark, rows)).collect()}
    assert got[0].host_rejected and not got[0].kept and not got[0].base_failed
    assert got[1000].kept and got[5001].kept
    assert got[5000].host_rate < 1.0 and got[5001].host_rate == got[5000].host_rate


def test_host_verdicts_follow_the_prior(spark):
    """One bad host among many; hosts that are all alike, good or poor, lose nothing; URLs count by domain."""
    good, bad = " ".join(f"w{i}" for i in range(40)), "a b c"
    for name, rows, gone in (
        ("one", [(100 * h + i, bad if i % 10 < (8 if h == 3 else 1) else good, f"src{h}") for h in range(20) for i in range(50)], {"src3"}),
        ("alike", [(100 * h + i, bad if (i * 7 + h) % 10 < 6 else good, f"src{h}") for h in range(20) for i in range(50)], set()),
        ("hot", [(i, bad if i % 10 else good, "hot") for i in range(500)] + [(1000 + i, good, f"src{i % 20}") for i in range(1000)], {"hot"}),
        ("few", [(0, bad, "x"), (1, good, "y"), (2, good, "z")], set()),
        ("urls", [(i, bad if i % 10 else good, ("HTTP://u:p@www.Bad.example:80/a", "https://bad.example?q", "http://bad.example")[i % 3]) for i in range(90)] + [(1000 + i, good, f"https://h{i % 20}.org/{i}") for i in range(1000)], {"bad.example"}),
    ):
        got = quality.judge(docs(spark, rows)).collect()
        assert {r.host for r in got if r.host_rejected} == gone, name
        assert all(r.kept == (not r.base_failed and r.host not in gone) for r in got)
        if gone:
            assert any(not r.base_failed and not r.kept for r in got)


@pytest.mark.parametrize("operator", [lambda d: quality.judge(d), lambda d: pii.report(d), lambda d: substring.remove_repeats(d, width_bits=16), lambda d: neardup.near_duplicates(d)])
def test_empty_table(spark, operator):
    assert operator(docs(spark, [])).collect() == []


def brute_cut(rows):
    first = {}
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, 1 << 70), 1 << 69 if i is None else i)
    out = Counter()
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < (1 << 69 if i is None else i) for j in range(50)}
        out[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return out


@pytest.mark.parametrize("width_bits", [16, 22])
def test_substring_dedup_equals_brute_force(spark, width_bits):
    rows = odd_rows()
    got = substring.remove_repeats(docs(spark, rows), width_bits=width_bits).collect()
    assert Counter(map(tuple, got)) == brute_cut(rows)


def brute_components(rows, k, percent=80):
    sets = []
    for i, t, _ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    up = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i, j = rows[a][0], rows[b][0]
            if i is not None and j is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return Counter((i, len(s), None if i is None else root(i)) for (i, _, _), s in zip(rows, sets, strict=True))


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rows = odd_rows()
    got = neardup.near_duplicates(docs(spark, rows), shingle=k).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, k)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_near_duplicate_chain_and_hot_group(spark):
    """A chain of edits links its ends through the middle; a large group of loose copies keeps all its links."""
    import random

    rng = random.Random(2)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice((0, 1, 3, 5, 6))):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "a"))
    got = neardup.near_duplicates(docs(spark, rows), shingle=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 4)


def test_superminhash_estimates_and_fills():
    import numpy as np

    a = np.arange(1, 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = np.concatenate([a[200:], a[:100] ^ np.uint64(12345)])
    sig = neardup.superminhash(np.concatenate([np.sort(a), np.sort(b), a[:1]]), np.array([0, 1000, 1900, 1901]))
    assert (sig != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    true = 800 / 1100
    assert abs((sig[0] == sig[1]).mean() - true) < 0.12
    assert sorted((sig[2] >> np.uint64(40)).tolist()) == list(range(256))  # one element takes each slot at its own level


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-+_% 0129()\né", max_size=60))
def test_base_spans_equal_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_long_texts_take_linear_time():
    import time

    began = time.process_time()
    for text in ("1" * 1_000_000, "1." * 500_000, "0" * 6000 + ".1.2.3", "a@" * 300_000, "+1 " * 300_000, "token=" * 100_000, "x" * 1_000_000 + "@"):
        pii.protected(text)
    assert time.process_time() - began < 20
    assert pii.base_spans("0" * 6000 + ".1.2.3") == [(0, 1, 6006)]


def test_named_secrets_are_spans_and_go(spark):
    text = 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" and API_KEY: abcdefgh12345678 but token short'
    r = pii.report(docs(spark, [(1, text, "a"), (2, "tokens = many of them here", "a")])).orderBy("doc_id").collect()
    assert (r[0].n_secret, r[0].any_span, r[1].n_secret, r[1].any_span) == (2, True, 0, False) and r[0].n_email == r[0].n_card == 0
    assert pii.sanitise(docs(spark, [(1, text, "a")])).first().text == 'token = "[SECRET]" and API_KEY: [SECRET] but token short'


def test_pii_report_and_disclosing_terms(spark):
    names = ["zorblatt", "quimbly"]
    rows = [(i, f"padding{i} words number{i} {names[0]} wrote boss@corp.example.com again{i} and {['alpha', 'beta', 'gamma', 'delta'][i % 4]} left", "a") for i in range(8)]
    rows += [(100 + i, f"and wrote again about padding number words nothing {i} left", "b") for i in range(40)]
    rows += [(500, "call +1 (212) 555-0199 or 10.0.0.256 or 10.0.0.25", None), (501, None, None), (None, "x@y.zz 4111 1111 1111 1111", "a"), (501, "", "a")]
    got = pii.report(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next((t for d, t, _ in rows if d == r.doc_id and d != 501), "") or ""
        plain = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(text))
        assert r.base_sha256 == hashlib.sha256(plain.encode()).hexdigest()
    assert all(r.n_term == 1 and f"term:{rows[r.doc_id][1].index(names[0])}:" in r.spans for r in got if r.doc_id is not None and r.doc_id < 8)
    assert all(r.n_term == 0 for r in got if r.doc_id is None or r.doc_id >= 100)
    clean = {r.doc_id: r for r in pii.sanitise(docs(spark, rows)).collect()}
    assert names[0] not in clean[3].text and "[EMAIL]" in clean[3].text and clean[100].text == rows[8][1]
    assert clean[500].text == "call [PHONE] or 10.0.0.256 or [IP]" and clean[None].text == "[EMAIL] [CARD]"
    assert clean[3].spans == "s" and clean[3].row == "r"


def test_terms_that_disclose_from_afar_and_of_rare_entities(spark):
    filler = " ".join(f"filler common words number{k}" for k in range(12))
    rows = [(i, f"zorblatt {filler} boss@corp.example.com {filler} zorblatt", "a") for i in range(2)] + [(2 + i, f"{filler} zorblatt {i} boss@corp.example.com", "a") for i in range(8)]
    rows += [(50, f"Quimbly {filler} only@one.example.com {filler} quimbly", "a")] + [(100 + i, f"{filler} again{i}", "b") for i in range(4000)]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, rows)).collect()}
    assert not any("zorblatt" in clean[i] for i in range(10)) and "quimbly" not in clean[50].lower()
    assert clean[0].count("filler") == 24 and clean[50].count("[TERM]") == 2 and clean[100] == rows[11][1]


def test_copies_prove_nothing(spark):
    filler = " ".join(f"filler common words number{k}" for k in range(12))
    apart = [(100 + i, f"{filler} again {i}", "b") for i in range(400)]
    once, often = ([(i, f"lonely {filler} only@one.example.com", "a") for i in range(n)] for n in (1, 50))
    got = [{r.doc_id: r.spans for r in pii.report(docs(spark, x + apart)).collect()} for x in (once, often)]
    assert got[0][0] == got[1][0] == got[1][49]


def shuffled_rows(spark, run):
    """What run returns, and the rows that its stages wrote for shuffles."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = max(stages(), default=-1)
    out = run()
    return out, sum(n for i, n in stages().items() if i > before)


@pytest.mark.parametrize("room", [8 << 20, 3000, 0])
def test_pairs_that_cannot_disclose_are_not_shuffled(spark, monkeypatch, room):
    rng = random.Random(11)
    word = lambda k: "w" + "".join(chr(97 + int(c)) for c in f"{k:05d}")
    common = [word(k) for k in range(300)]
    rows = []
    for i in range(400):
        text = common + [word(1000 + int(rng.paretovariate(0.5)) % 3000) for _ in range(20)]
        if i < 80:
            who = rng.choice([i, 100 + i % 20, 200 + i % 5])
            text += [f"who{who}@corp{who}.example.com", word(9000 + who), word(9000 + i % 5)]
        rng.shuffle(text)
        rows.append((i, " ".join(text), "a"))
    spans = {i: pii.protected(t) for i, t, _ in rows}
    entities = {i: {pii.entity(k, t[a:b]) for a, k, b in spans[i]} for i, t, _ in rows}
    terms = {i: {x for x, _, _ in pii.outside(t, spans[i])} for i, t, _ in rows}
    n = Counter(x for _, t, _ in rows for x in set(re.findall(r"[^\W\d_]{4,}", t.lower())))
    ne, both = Counter(e for s in entities.values() for e in s), Counter((e, x) for i in entities for e in entities[i] for x in terms[i])
    rule, total = pii.Disclosure(prior=1.0), len(rows)
    score = lambda e, x: math.log((both[e, x] + rule.prior * ne[e] / total) / (n[x] + rule.prior) * total / ne[e]) / math.log(total / ne[e])
    told = {p for p in both if score(*p) >= rule.generalise}
    want = {(i, a, b) for i, t, _ in rows for x, a, b in pii.outside(t, spans[i]) if any((e, x) in told for e in entities[i])}
    monkeypatch.setattr(pii, "FREQUENT_BYTES", room, raising=False)
    got, moved = shuffled_rows(spark, lambda: pii.spans(docs(spark, rows), rule).collect())
    assert {(r.doc_id, x.start, x.end) for r in got for x in r.spans if x.kind == pii.TERM} == want and len(want) > 50
    assert room < 1 << 20 or moved < len(both)


def test_graph_components(spark):
    from loamwork.llm.graph import connected_components

    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9), (9, 9), (1000, 5)] + [(k, 2000) for k in range(2001, 2100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    up = defaultdict(set)
    for a, b in edges:
        up[a].add(b), up[b].add(a)
    for node in up:
        if up[node] == {node}:
            continue
        seen, todo = {node}, [node]
        while todo:
            todo += (new := up[todo.pop()] - seen)
            seen |= new
        assert got[node] == min(seen)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
