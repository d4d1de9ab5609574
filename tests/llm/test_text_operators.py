"""Quality rules, quality model, PII, decontamination, licences and LM scores against plain versions."""

from __future__ import annotations

import re
import textwrap
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, licenses, pii, pseudo_likelihood, quality_model, quality_rules
from tidemark.llm.tokens import Words, encode

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "é ñ x # $", "a b\nA b\n\na b\n a b", "x " * 40, "one two three four five six seven eight " * 3, "z" * 2_500_000, "#*$%&|<> " * 5]


def frame(spark, texts, extra="n_words long, key string"):
    rows = [(i, t, 1, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:2], f"doc_id long, text string, {extra}")


def base_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_rules_base(spark, small):
    texts = ODD + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = quality_rules.score_quality(frame(spark, texts)).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        n, *rest = base_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 20 or 100 * r.n_repeat_words > 30 * n)
        assert not (r.kept and r.base_failed)


def test_quality_rules_agree_with_labels(spark):
    docs = "/root/testdata/sf0.01/"
    kept = quality_rules.score_quality(spark.read.parquet(f"{docs}documents.parquet")).select("doc_id", "kept", "base_failed")
    rows = kept.join(spark.read.parquet(f"{docs}labels.parquet"), "doc_id").where("NOT base_failed").collect()
    right = np.mean([r.kept == bool(r.quality) for r in rows])
    assert right > 0.95


def test_fit_votes_trusts_the_agreeing_rules():
    n = 3
    votes = {(1, 1, 1): 500, (0, 0, 0): 80, (1, 1, 0): 60, (2, 2, 2): 5, (0, 0, 1): 10}
    patterns = np.array([sum(v * 3 ** (n - 1 - i) for i, v in enumerate(p)) for p in votes])
    post = dict(zip(votes, quality_rules.fit_votes(patterns, np.array(list(votes.values())), n), strict=True))
    assert post[1, 1, 1] > post[1, 1, 0] > 0.5 > post[0, 0, 1] > post[0, 0, 0]


def test_quality_model_on_held_out_ratings(spark):
    d = "/root/testdata/sf0.01/"
    docs = spark.read.parquet(f"{d}documents.parquet")
    labels = quality_model.grades_of(spark.read.parquet(f"{d}labels.parquet"))
    model = quality_model.train(docs, labels.where("doc_id % 3 <> 0"))
    assert (np.diff(model.thresholds) > 0).all()
    rows = quality_model.score_documents(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    clean = [r for r in rows if r.grade == 3]
    poor = [r for r in rows if r.grade < 2]
    assert np.mean([r.kept for r in clean]) > 0.9
    assert np.mean([not r.kept for r in poor]) > 0.8


def test_quality_model_without_two_grades(spark):
    docs = frame(spark, ODD)
    for labels in ([], [(0, 3), (1, 3), (None, 1), (2, None)]):
        model = quality_model.train(docs, spark.createDataFrame(labels, "doc_id long, grade int"))
        assert quality_model.keep_sound(docs, model).count() == docs.count()
        assert quality_model.score_documents(docs, model).where("kept").count() == docs.count()


@pytest.mark.parametrize(
    "text",
    [
        "mail a.b+c@x.example.com, or @x.com a@b and c@d.e.f@g.h",
        "a@@b.co x@y..z .@a.b",
        "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.255 9.9.9",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112 or 41111111111111110",
        "call +1 (614) 555-8001 now +1 +12 34 5 +44 20 7946 0958.",
        "é 10.0.0.1 ü a@b.cd",
    ],
)
def test_base_spans_are_the_patterns_matches(text):
    want = [("email", *m.span()) for m in pii.EMAIL.finditer(text)]
    want += [("ip", *m.span()) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in pii.CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            want.append(("card", *m.span()))
    want += [("phone", *m.span()) for m in pii.PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    assert pii.base_spans(text) == want


def test_pii_learns_contexts(spark):
    texts = [f"word{i} please call me +1 (614) 555-80{i:02d} today" for i in range(20)] + ["well please call me 614-555-9999 today", "the year 202420 was fine", None, ""]
    docs = frame(spark, texts)
    rows = {r.doc_id: r for r in pii.all_spans(docs).collect()}
    at = texts[20].index("614")
    assert [tuple(x) for x in rows[20].spans] == [("phone", at, at + 12)] and not rows[20].base
    assert not rows[21].spans and not rows[22].spans
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[20] == "well please call me [PHONE] today" and clean[3] == "word3 please call me [PHONE] today" and clean[21] == texts[21] and clean[22] is None
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == docs.count()


def test_pii_finds_runs_of_words_and_text_starts(spark):
    texts = [f"word{i} please call me +1 (614) 555-80{i:02d} today" for i in range(20)] + [f"well please write to a{i}@x.example.com soon" for i in range(20)]
    texts += [f"+1 (614) 555-81{i:02d} is the number" for i in range(20)]
    odd = ["please call me 030 123 45 67 today", "please call me (168) 555-5254 today", "please write to jane [at] mail [dot] com soon", "555-1234567 is the number", "in 12 34 rooms"]
    docs = spark.createDataFrame(list(enumerate(texts + odd)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    want = ["please call me [PHONE] today"] * 2 + ["please write to [EMAIL] soon", "[PHONE] is the number", "in 12 34 rooms"]
    assert [clean[len(texts) + i] for i in range(len(odd))] == want


def test_pii_learns_until_nothing_is_new(spark):
    rows = [(f"known{i}", "phone", "a 0", "") for i in range(30)]
    for step in range(6):  # instances of each context vouch for the next one
        rows += [(f"s{step}n{i}", "", f"a {step + j}", "") for i in range(8) for j in (0, 1)]
    found = spark.createDataFrame(rows, "instance string, kind string, left string, right string")
    assert {r.pattern for r in pii.bootstrap(found, min_score=0.5).collect()} >= {f"L a {i}" for i in range(7)}


def plain_bootstrap(found, min_known, min_score):
    """The graph held in sets: patterns by their instances, rounds until nothing is new."""
    kinds, instances = {}, {}
    for kind, instance, left, right in found:
        for p in pii.patterns_of(left, right):
            kinds[p, instance] = max(kinds.get((p, instance), ""), kind)
            instances.setdefault(p, set()).add(instance)
    known = {}
    for (_, i), kind in kinds.items():
        if kind:
            known[i] = min(known.get(i, kind), kind)

    def accepted():
        out = {}
        for p, own in instances.items():
            n = Counter(known[i] for i in own if i in known)
            good = [(c, k) for k, c in n.items() if c >= min_known and c >= min_score * len(own)]
            if good:
                out[p] = max(good)[1]
        return out

    while True:
        good, more = accepted(), {}
        for (p, i), kind in kinds.items():
            if not kind and p in good and i not in known:
                more[i] = min(more.get(i, good[p]), good[p])
        if not more:
            return good
        known |= more


@pytest.mark.parametrize("seed", range(3))
def test_bootstrap_against_plain_sets(spark, seed):
    rng = np.random.default_rng(seed)
    pick = lambda n: int(rng.integers(n))
    rows = []
    for _ in range(1500):
        context = pick(12)
        kind = ["", "", "phone", "email"][pick(4)] if context < 8 else ""
        rows.append((kind, f"{kind}{context // 2 if pick(3) else pick(6)}-{pick(14)}", ["", "a", "a b", "b b"][pick(2) if context % 3 else 2] + f" c{context}", f"r{context % 4}"))
    found = spark.createDataFrame(rows, "kind string, instance string, left string, right string")
    for least, share in ((2, 0.3), (5, 0.8), (3, 0.55)):
        got = {r.pattern: r.kind for r in pii.bootstrap(found, least, share).collect()}
        assert got == plain_bootstrap(rows, least, share)
    got = found.select("left", "right", pii._patterns().alias("p")).distinct().collect()
    assert all(tuple(r.p) == pii.patterns_of(r.left, r.right) for r in got)


def test_pii_by_lookup_and_by_joins(spark, monkeypatch):
    texts = [f"word{i} please call me +1 (614) 555-80{i:02d} today" for i in range(20)] + ["well please call me 614-555-9999 today"] * 3 + ["x " * 300 + "call me 6145559998 today", None, ""]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)] + [(20, texts[20], "m")] * 4, "doc_id long, text string, more string")
    whole = sorted(map(str, pii.all_spans(docs).collect()))
    clean = sorted(map(str, pii.redact(docs).collect()))
    monkeypatch.setattr(pii, "MAX_SENT", 0)
    assert sorted(map(str, pii.all_spans(docs).collect())) == whole
    assert sorted(map(str, pii.redact(docs).collect())) == clean and sum("[PHONE]" in x for x in clean) == 28


@pytest.mark.parametrize("text", ["z" * 400_000 + " a@b.cd 1234", "9" * 300_000 + " x@", "(" * 300_000 + "1 2 3 4 @", "1." * 200_000, "+1" * 200_000, "@" * 200_000 + "1", "a." * 200_000 + "@", "1 " * 200_000, "+5" + "(" * 300_000, "[at]" * 100_000, "5-" * 200_000 + "@"])
def test_long_odd_texts_take_linear_time(text):
    before = time.process_time()
    for _ in pii.contexts(text, pii.base_spans(text)):
        pass
    assert time.process_time() - before < 5


def test_contexts_reach_over_any_gap():
    text = "call" + " " * 500 + "me" + "\n" * 300 + "(6145559998)," + "\t" * 200 + "Today" + "z" * 100
    [(kind, lo, hi, word, left, right)] = pii.contexts(text, [])
    assert (kind, text[lo:hi], word, left, right) == ("", "6145559998", "6145559998", "me (", "),")
    [(_, _, _, word, left, right)] = pii.contexts("a" * 200 + " 61455" + "5" * 90 + " b", [])
    assert len(word) == 64 and left == "(200)" and right == "b"


def test_decontamination(spark, small):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    words = item.split()
    changed = " ".join(w if i not in (4, 11) else "odd" for i, w in enumerate(words))
    texts = [f"before {item} after", f"x {changed.upper().replace(' ', ', ')} y", " ".join(words[:9]) + " and nothing", " ".join(reversed(words)), None, "", f"a {' '.join(words[:13])} b"]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "")], "item_id long, text string")
    docs = frame(spark, texts, "item_id long, key string")
    got = sorted((r.doc_id, r.item_id, r.n_equal) for r in decontaminate.find_leaks(docs, bench).collect())
    assert got == [(0, 1, 16), (0, 1, 16), (1, 1, 14), (1, 1, 14), (6, 1, 13)]
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()) == [2, 3, 4, 5]
    assert decontaminate.find_leaks(docs, bench.where("false")).count() == 0


def test_longest_run():
    rng = np.random.default_rng(0)
    for _ in range(200):
        same = rng.random(int(rng.integers(1, 40))) < 0.75
        n = len(same)
        good = [(j - i) for i in range(n) for j in range(i + 1, n + 1) if same[i] and same[j - 1] and 5 * same[i:j].sum() >= 4 * (j - i)]
        i, j = decontaminate.longest_run(same)
        assert j - i == max(good, default=0)


def test_masks_hit_every_window_with_two_substitutions():
    for a in range(13):
        for b in range(13):
            assert any(all(x - o not in mask for x in (a, b)) for mask in decontaminate.MASKS for o in range(13 - mask[-1]))


def plain_words(text):
    return "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (text or "")).translate({i: i + 32 for i in range(65, 91)}).split()


def plain_leaks(docs, bench):
    """Every alignment of every text and item that a mask hits, and its longest run by trying all."""
    out = []
    for doc, text in docs:
        w = plain_words(text)
        for item_id, item in bench:
            own, best = plain_words(item), None
            for at in range(-len(own), len(w)):
                same = {i for i in range(len(own)) if 0 <= at + i < len(w) and w[at + i] == own[i]}
                inside = [i for i in range(len(own)) if 0 <= at + i < len(w)]
                if not any({o + m for m in mask} <= same for mask in decontaminate.masks_for(len(own)) for o in range(len(own))):
                    continue
                if len(own) <= 13:
                    if len(inside) == len(own) and 5 * len(same) >= 4 * len(own):
                        best = max(best or (0,), (len(same), -at, len(own)))
                    continue
                runs = [(b - a + 1, -a, sum(a <= x <= b for x in same)) for a in inside for b in inside if a <= b and a in same and b in same]
                n, a, equal = max((r for r in runs if 5 * r[2] >= 4 * r[0]), default=(0, 0, 0))
                if n >= 13:
                    best = max(best or (0,), (equal, -(at - a), n))
            if best:
                out.append((doc, -1 if item_id is None else item_id, -best[1], best[2], best[0]))
    return sorted(out)


def leak_cases(seed):
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 60, n)]
    items = [word(int(n)) for n in [1, 2, 3, 5, 7, 8, 9, 10, 11, 12, 13, 14, 20, 30, 30]]
    items[-1] = items[-2]
    docs = []
    for i in range(60):
        own = list(items[int(rng.integers(len(items)))])
        for _ in range(int(rng.integers(0, 4))):
            own[int(rng.integers(len(own)))] = "odd"
        lo = int(rng.integers(0, 3))
        docs.append((i, " ".join(word(int(rng.integers(0, 6))) + own[lo:] + word(int(rng.integers(0, 6))))))
    docs += [(100, None), (101, ""), docs[0], (102, docs[1][1])]
    bench = [(i, " ".join(x)) for i, x in enumerate(items)] + [(None, " ".join(items[9])), (50, None)]
    return docs, bench


@pytest.mark.parametrize("limit", [1 << 22, 10])
@pytest.mark.parametrize("seed", range(2))
def test_leaks_against_brute_force(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)  # small: seeds and windows are joined
    monkeypatch.setattr(decontaminate, "_WIDE_BITS", 20)
    docs, bench = leak_cases(seed)
    frame, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.find_leaks(frame, items).collect())
    assert got == plain_leaks(docs, bench) and got
    bad = {r[0] for r in got}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(frame, items).collect()) == sorted(i for i, _ in docs if i not in bad)


def test_a_large_benchmark_finds_the_same(spark, small, monkeypatch):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    kept = sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 10)
    assert sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect())) == whole and whole
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()) == kept


@pytest.mark.parametrize("n", range(3, 14))
def test_short_items_bear_their_substitutions(n):
    words = [f"w{i}" for i in range(n)]
    index = decontaminate.Index([7], [" ".join(words).encode()])
    allowed = 2 if n >= 10 else 1 if n >= 8 else 0
    for a in range(n):
        for b in range(n):
            changed = {a, b} if allowed == 2 else {a} if allowed else set()
            text = " ".join(["before", *("odd" if i in changed else w for i, w in enumerate(words)), "after"]).encode()
            assert [x[1] for x in index.leaks([text])] == [7], (n, changed)


def test_licences(spark):
    texts = ["first line\nReleased under the MIT License.\nlast", "This work is licensed under the GNU General Public License, version 3.", "a licence to drive a car under version 3 of the rules", None, "", "Licensed under CC BY-NC 4.0."]
    docs = frame(spark, texts)
    rows = licenses.scan_licenses(docs, licenses.train(docs)).collect()
    assert sorted((r.doc_id, r.paragraph, r.family, r.confirmed) for r in rows) == [(0, 1, "MIT", True), (0, 1, "MIT", True), (1, 0, "GPL", True), (1, 0, "GPL", True), (5, 0, "CC-BY-NC", True)]


def test_votes_against_em_by_document():
    """EM over documents one by one gives the posteriors that EM over counts of patterns does."""
    rng = np.random.default_rng(4)
    n, rules = 300, 4
    good = rng.random(n) < 0.6
    votes = np.where(rng.random((n, rules)) < 0.2, quality_rules.ABSTAIN, np.where(rng.random((n, rules)) < 0.85, good[:, None], ~good[:, None]))
    pattern = (votes * 3 ** np.arange(rules - 1, -1, -1)).sum(1)
    patterns, counts = np.unique(pattern, return_counts=True)
    got = dict(zip(patterns.tolist(), quality_rules.fit_votes(patterns, counts, rules).tolist(), strict=True))
    ups, downs = (votes == quality_rules.GOOD).sum(1), (votes == quality_rules.BAD).sum(1)
    post = np.clip((ups + 0.5) / (ups + 3 * downs + 1), 0.02, 0.98)

    def table(floor):
        out = {}
        for c, weight in ((0, 1 - post), (1, post)):
            for r in range(rules):
                row = [sum(weight[i] for i in range(n) if votes[i, r] == v) + 1 for v in range(3)]
                row = [max(x / sum(row), floor) for x in row]
                out[c, r] = [x / sum(row) for x in row]
        return out

    def posterior(t, prior):
        odds = [np.log(prior[1] / prior[0]) + sum(np.log(t[1, r][votes[i, r]] / t[0, r][votes[i, r]]) for r in range(rules)) for i in range(n)]
        return 1 / (1 + np.exp(-np.array(odds)))

    for _ in range(200):
        prior = (((1 - post).sum() + 1) / (n + 2), (post.sum() + 1) / (n + 2))
        t = table(0)
        new = posterior(t, prior)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    want = posterior(table(quality_rules.DOUBT), prior)
    assert max(abs(got[p] - w) for p, w in zip(pattern.tolist(), want.tolist(), strict=True)) < 1e-4


def test_ordinal_fit_reaches_the_optimum():
    """No small change of weights or thresholds makes the penalised likelihood of the cumulative-link model better."""
    rng = np.random.default_rng(5)
    n, width = 300, 8
    x = (rng.random((n, width)) < 0.4).astype(float)
    grade = np.clip(np.round(x @ rng.normal(0, 1.5, width) + rng.logistic(0, 1, n)), -1, 2).astype(int)
    text, feature = np.nonzero(x)
    penalty = 1e-3
    model = quality_model.fit(text, feature, grade, rounds=4000, penalty=penalty, least=1, screen=-1)
    y = np.searchsorted(model.grades, grade)
    scale = 1 / np.sqrt(x.mean(0))

    def loss(w, cuts):
        below = 1 / (1 + np.exp(-(np.concatenate([[-np.inf], cuts, [np.inf]])[None] - (x @ w)[:, None])))
        return -np.log(below[np.arange(n), y + 1] - below[np.arange(n), y]).mean() + penalty * np.abs(w / scale).sum()

    w = model.weights[:width]
    best = loss(w, model.thresholds)
    assert (np.diff(model.thresholds) > 0).all() and np.count_nonzero(w) >= 4
    for _ in range(300):
        cuts = model.thresholds + rng.normal(0, 0.03, len(model.thresholds))
        assert loss(w + rng.normal(0, 0.03, width), model.thresholds) > best - 1e-6 and loss(w, cuts) > best - 1e-6


def test_fitted_rows_are_bounded_after_the_join(spark):
    """An id that is rated once and stands on many rows brings no more rows to the fit than the bound says."""
    docs = spark.createDataFrame([(1, f"words number {i}") for i in range(300)] + [(2, "other text")], "doc_id long, text string")
    rated = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, grade int")
    seen = []
    plain, quality_model.fit = quality_model.fit, lambda *a, **k: seen.append(a) or plain(*a, **k)
    try:
        model = quality_model.train(docs, rated, max_labelled=10)
    finally:
        quality_model.fit = plain
    assert not seen  # the driver fits nothing
    assert len(model.grades) >= 1 and quality_model.score_documents(docs, model).count() == 301
    few = quality_model.train(docs, rated, max_labelled=400, max_marks=5)
    assert len(few.grades) <= 1


SAMPLE = ["plain words of no licence at all", "the author of the work and the rights of man", "a file of the program", "on the use of the library in this version"] * 20


@pytest.fixture(scope="module")
def licence_model():
    return licenses.fit(SAMPLE)


def test_licence_templates_are_told_apart(licence_model):
    own = [(f, x) for f in licenses.FAMILIES for x in (*licenses.TEXTS[f], *(n for n in licenses.NAMES[f] if " " in n))]
    best, probability, similarity = licence_model.classify(encode([x for _, x in own]))
    right = np.array([b < licenses.UNKNOWN and licenses.FAMILIES[b] == f for b, (f, _) in zip(best, own, strict=True)])
    assert right.mean() > 0.97 and (similarity[right] == 1).all() and ((probability > 0) & (probability <= 1)).all()


@pytest.mark.parametrize(
    ("family", "lines"),
    {
        "MIT": ("MIT License", "License: MIT", "Licensed under MIT", "This software may be used under the conditions of the MIT licence"),
        "Apache-2.0": ("Apache License", "Code in this folder falls under version 2 of the Apache license."),
        "GPL": ("GPLv3 or later", "Distributed under the GPL", "GNU GPL v3", "You can copy this under GPL version 2 or any later version"),
        "LGPL": ("LGPL v2.1", "LGPL-2.1"),
        "CC-BY-SA": ("CC BY-SA 3.0 Unported",),
        "MPL-2.0": ("Mozilla Public License Version 2.0", "Mozilla Public License 1.1"),
        "ISC": ("Released under the ISC license",),
        "BSD": ("Usage of the works is permitted under the BSD license",),
        None: (
            "MIT is a university in Boston", "a driving license is required", "EUPL 1.2", "Released under the Foo License", "Licensed under the Open Gaming License", "see the license for details",
            "the public library of general works", "free software is a matter of liberty", "The European Union Public Licence applies to this", "permission is granted to park here", "x", "all rights are equal",
        ),
    }.items(),
)
def test_licence_wordings_held_out(licence_model, family, lines):
    best, probability, _ = licence_model.classify(encode(lines))
    got = [licenses.FAMILIES[b] if b < licenses.UNKNOWN and p >= licenses.MIN_PROBABILITY else None for b, p in zip(best, probability, strict=True)]
    assert got == [family] * len(lines)


def test_wrapped_licences_are_found_as_paragraphs(licence_model):
    def wrap(text, width=60):
        return "\n".join(textwrap.wrap(text, width))

    mit, gpl, bsd = (wrap(licenses.TEXTS[f][0]) for f in ("MIT", "GPL", "BSD"))
    text = f"some words here\nand more\n\n{mit}\n\n \t\nplain words of no licence\n\n{gpl}\n\n{bsd}\nlast\n\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.\n"
    got = [(i, lines, family, similarity >= licenses.MIN_SIMILARITY) for i, _, lines, family, _, similarity in licence_model.scan(encode(["", text, None]))]
    n = [x.count("\n") + 1 for x in (mit, gpl, bsd)]
    assert got == [(1, n[0], "MIT", True), (1, n[1], "GPL", True), (1, n[2] + 1, "BSD", True), (1, 1, "Apache-2.0", True), (1, 1, "MIT", True)]


def test_licence_probabilities_are_the_regressions(licence_model):
    """Against n-grams held as tuples of words and weights summed one by one."""
    m = licence_model
    for line in ("Released under the MIT License", "see the GNU General Public License, see the file", "no word", ""):
        words = plain_words(line)
        own = {tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)}
        logits = m.bias.astype(float)
        for gram in own:
            h = Words([" ".join(gram).encode()]).hash
            x = h[:1]
            for y in h[1:]:
                x = x * licenses._STEP + y
            place = m.place[licenses.bucket(licenses.mix(x + np.uint64(len(gram)) if len(gram) > 1 else x))][0]
            if place >= 0:
                logits = logits + m.weights[place]
        p = np.exp(logits / m.temperature - (logits / m.temperature).max())
        best, top, _ = m.classify([line.encode()])
        assert best[0] == p.argmax() and abs(top[0] - p.max() / p.sum()) < 1e-5


def test_softmax_regression_reaches_the_optimum():
    rng = np.random.default_rng(0)
    n, width = 120, 9
    text, feature = np.nonzero(rng.random((n, width)) < 0.4)
    y, weight = rng.integers(0, licenses.UNKNOWN + 1, n), rng.random(n) + 0.2
    x = np.zeros((n, width))
    x[text, feature] = 1

    def loss(w, b):
        z = x @ w + b
        z = z - z.max(1, keepdims=True)
        return -(weight / weight.sum() * (z[np.arange(n), y] - np.log(np.exp(z).sum(1)))).sum() + 0.005 * (w * w).sum()

    w, b = (v.astype(float) for v in licenses._regress(text, feature, width, y, weight, 3000, 0.01))
    best = loss(w, b)
    for _ in range(200):
        assert loss(w + rng.normal(0, 0.02, w.shape), b + rng.normal(0, 0.02, b.shape)) > best - 1e-6


def lm(docs, most=pseudo_likelihood.TOP, shard_words=3000):
    counts = pseudo_likelihood.count_words(docs)
    known = pseudo_likelihood.lexicon(counts, most)
    return pseudo_likelihood.train(docs, known, shard_words), known, counts


@pytest.mark.parametrize("most", [pseudo_likelihood.TOP, 700, 0])
def test_every_word_has_its_own_probability(spark, small, most):
    """Against one word at a time, with its own neighbours and its share of its symbol by counts held in a dictionary."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 40").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, None), (-1, ""), (-2, "onceonly unheardof"), (-2, "onceonly unheardof")], "doc_id long, text string"))
    network, known, counts = lm(docs, most)
    texts = [(r.doc_id, plain_lower(r.text)) for r in docs.collect()]
    seen = Counter(x for _, own in texts for x in own)
    assert known.total == sum(seen.values()) and known.rest == sum(n for n in seen.values() if n < known.least)
    symbol = dict(zip(seen, known.symbols(Words([" ".join(seen).encode()])).tolist(), strict=True))
    assert len(known.vocabulary) == min(pseudo_likelihood.KNOWN, sum(n >= known.least for n in seen.values()))
    mass = Counter()
    for x, n in seen.items():
        mass[symbol[x]] += n
    got = pseudo_likelihood.score_documents(docs, network, known, counts).collect()
    assert sorted((r.doc_id, r.n_words) for r in got if r.doc_id is not None) == sorted((i, len(own)) for i, own in texts if i is not None)
    want = {}
    for i, own in texts:
        s, total = [symbol[x] for x in own], 0.0
        for k, x in enumerate(own[:300] if len(own) <= 300 else ()):
            around = np.array([[s[k + d] if 0 <= k + d < len(s) else 0] for d in (-2, -1, 1, 2)])
            total += float(network.log_probability(np.array(s[k : k + 1]), around)[0])
            if s[k] > pseudo_likelihood.KNOWN:
                total += np.log(seen[x] / (mass[s[k]] + 1))
        want[i] = total
    for r in got:
        if 0 < r.n_words <= 300:
            assert abs(r.log_likelihood - want[r.doc_id]) < 1e-4 * max(1, abs(want[r.doc_id])) and abs(r.mean_log_likelihood * r.n_words - r.log_likelihood) < 1e-9 * max(1, abs(r.log_likelihood))
        assert (r.mean_log_likelihood is None) == (r.n_words == 0) and (r.n_words or r.log_likelihood == 0)


def plain_lower(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def test_words_that_were_not_counted_have_the_count_left_for_them(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 20")
    new = spark.createDataFrame([(-3, "neverseenword"), (-3, "neverseenword")], "doc_id long, text string")
    for most in (pseudo_likelihood.TOP, 0):
        network, known, counts = lm(docs, most)
        (symbol,) = known.symbols(w := Words([b"neverseenword"]))
        plain = pseudo_likelihood.symbol_logs(network, w, np.array([symbol]))[0]
        want = plain - np.log(known.held[symbol - pseudo_likelihood.KNOWN - 1] + 1)
        rows = pseudo_likelihood.score_documents(new, network, known, counts).collect()
        assert len(rows) == 2 and all(abs(r.log_likelihood - want) < 1e-6 for r in rows)


def test_scores_follow_rows_alone(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id < 9")).unionByName(docs.where("doc_id < 5"))

    def scores(own):
        network, known, counts = lm(own, 900)
        return network.flat, sorted((r.doc_id, r.log_likelihood) for r in pseudo_likelihood.score_documents(own, network, known, counts).collect())

    (one, a), (many, b) = scores(docs.coalesce(1)), scores(docs.repartition(8))
    assert (one == many).all() and np.allclose([x for _, x in a], [x for _, x in b], rtol=1e-9)


def test_training_against_plain_rounds(spark, small, monkeypatch):
    """The same network from a loop over shards and rounds, texts whole or in pieces."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id < 3"))
    monkeypatch.setattr(pseudo_likelihood, "PIECE_WORDS", 100)
    network, known, _ = lm(docs, shard_words=2500)
    shards = 2 * -(-known.total // 5000)
    rows = docs.groupBy("doc_id", "text").count().withColumn("key", F.xxhash64("doc_id", "text")).collect()
    place = lambda *cols: {(r.key, r.p): r.s for r in spark.createDataFrame(list(cols), "key long, p long").withColumn("s", F.pmod(F.xxhash64("key", "p"), F.lit(shards))).collect()}
    own = []
    for r in rows:
        symbols = known.symbols(Words(encode([r.text]), lower=True)).tolist()
        own += [(r.key, p, symbols, lo, r["count"]) for p, lo in enumerate(range(0, len(symbols), 100))]
    where = place(*((k, p) for k, p, *_ in own))
    flat = pseudo_likelihood.Network.start(known.symbol_counts).flat
    for turn in range(2):
        total, words = 0, 0
        for shard in range(turn, shards, 2):
            copy, power = pseudo_likelihood.Network(flat.copy()), np.full(len(flat), 1e-6, np.float32)
            todo = []
            for _, _, symbols, lo, times in sorted((x for x in own if where[x[:2]] == shard), key=lambda x: x[:2]):
                for i in range(lo, min(lo + 100, len(symbols))):
                    todo.append((symbols[i], [symbols[i + d] if 0 <= i + d < len(symbols) else 0 for d in (-2, -1, 1, 2)], times))
            for a in range(0, len(todo), pseudo_likelihood.BATCH):
                s, around, times = zip(*todo[a : a + pseudo_likelihood.BATCH], strict=True)
                copy.learn(np.array(s), np.array(around).T, np.array(times), power)
            n = sum(t for _, _, t in todo)
            total, words = total + copy.flat.astype(float) * n, words + n
        flat = (total / words).astype(np.float32)
    assert shards > 4 and np.abs(network.flat - flat).max() < 1e-5


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    n = 40
    symbols, around, times = rng.integers(1, 200, n), rng.integers(0, 200, (4, n)), rng.integers(1, 4, n)
    network = pseudo_likelihood.Network.start(np.ones(pseudo_likelihood.SYMBOLS))
    own = network.gradient(symbols, around, times)
    mean = lambda flat: float((pseudo_likelihood.Network(flat).log_probability(symbols, around).astype(float) * times).sum() / times.sum())
    used = np.argsort(-np.abs(own))[:: max(1, np.count_nonzero(own) // 60)][:60]
    for i in used:
        up, down = network.flat.copy(), network.flat.copy()
        up[i] += 0.02
        down[i] -= 0.02
        assert abs((mean(up) - mean(down)) / 0.04 - own[i]) < 2e-4 + 0.02 * abs(own[i])


def test_network_is_a_distribution_and_learns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    trained, known, counts = lm(docs, shard_words=20_000)
    start = pseudo_likelihood.Network.start(known.symbol_counts)
    for network in (start, trained):
        p = np.exp(network.log_probability(np.arange(pseudo_likelihood.SYMBOLS), np.zeros((4, pseudo_likelihood.SYMBOLS), np.int64)))
        assert abs(p.sum() - 1) < 1e-3
    mean = lambda n: pseudo_likelihood.score_documents(docs, n, known, counts).agg((F.sum("log_likelihood") / F.sum("n_words"))).first()[0]
    assert mean(trained) > mean(start) + 0.05


def test_pseudo_likelihood_of_odd_rows(spark):
    docs = frame(spark, ODD)
    rows = pseudo_likelihood.score_documents(docs, *lm(docs)).collect()
    assert len(rows) == len(ODD) + 2
    assert all((r.mean_log_likelihood is None) == (r.n_words == 0) for r in rows)
    none = docs.where("false")
    assert pseudo_likelihood.score_documents(none, *lm(none)).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.score_quality(none).count() == 0
    assert pii.all_spans(none).count() == 0 and pii.redact(none).count() == 0
    assert licenses.scan_licenses(none, licenses.train(none)).count() == 0


def test_word_hashes_do_not_depend_on_their_place():
    a = Words([b"one two", b"two  one\n"]).hash
    assert a[0] == a[3] and a[1] == a[2] and a[0] != a[1]
    assert (Words([b"\xc3\xa9 x" * 400_000]).hash[:1] == Words([b"\xc3\xa9 x\xc3\xa9"]).hash[:1]).all()
