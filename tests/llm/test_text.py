"""Packing, mixing and subjects on small corpora."""

import collections
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netspark.llm.bodytext import body_sentences, coded, repaired
from netspark.llm.mixing import mix_sources, reachable
from netspark.llm.packing import close_windows, fill_report, pack, sum_of_squares
from netspark.llm.subjects import leaf_labels, leaf_mixtures, subject_areas
from netspark.llm.tokens import RANKS, encoding, token_counts

needs_ranks = pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer file")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_sum_of_squares_never_overfills(case):
    capacity, sizes = case
    x = np.array(sizes, np.int64)
    w = sum_of_squares(x, capacity)
    c = close_windows(w, x, capacity)
    for where in (w, c):
        if len(x):
            assert np.bincount(where, x).max() <= capacity
    assert len(set(c)) <= len(set(w))


def test_sum_of_squares_is_the_greedy_choice():
    rng = np.random.default_rng(0)
    sizes, cap = rng.integers(1, 20, 200), 30
    levels, windows = [], []
    for s in sizes:
        best = None
        for h in [0, *sorted(set(x for x in levels if 0 < x < cap))]:
            if h + s > cap or (h and h not in levels):
                continue
            after = list(levels)
            if h:
                after[after.index(h)] = h + s
            else:
                after.append(h + s)
            cost = sum(v * v for v in collections.Counter(x for x in after if x < cap).values())
            if best is None or cost < best[0] or (cost == best[0] and h > best[1]):
                best = (cost, h)
        h = best[1]
        if h:
            levels[levels.index(h)] = h + s
        else:
            levels.append(h + s)
        windows.append(h)
    w = sum_of_squares(sizes, cap)
    seen, got = collections.Counter(), []
    for k, s in zip(w, sizes):
        got.append(seen[k])
        seen[k] += s
    assert got == windows


def check_pack(spark, sizes, profiles, **kw):
    s = spark.createDataFrame([(i, n, "x") for i, n in sizes], "doc_id long, n_tokens long, container string")
    p = spark.createDataFrame(profiles, "profile string, capacity_tokens int")
    out = pack(s, p, **kw).collect()
    for name, cap in {x for x in profiles if x[1] and x[1] > 0}:
        rows = [r for r in out if r.profile == name and r.capacity == cap]
        per, place = collections.Counter(), collections.defaultdict(list)
        parts = collections.defaultdict(list)
        for r in rows:
            per[r.container] += r.token_end - r.token_start
            place[r.container].append(r.position)
            parts[r.doc_id].append((r.token_start, r.token_end, r.piece))
        assert not per or max(per.values()) <= cap
        assert all(sorted(v) == list(range(len(v))) for v in place.values())
        want = collections.Counter()
        for i, n in sizes:
            if n and n > 0:
                want[i] += n
        assert {i: sum(b - a for a, b, _ in v) for i, v in parts.items()} == dict(want)
        for i, n in sizes:
            if n and n > 0 and collections.Counter(x for x, _ in sizes)[i] == 1:
                v = sorted(parts[i])
                assert v[0][0] == 0 and v[-1][1] == n and all(a[1] == b[0] for a, b in zip(v, v[1:])) and [x[2] for x in v] == list(range(len(v)))
                assert n > cap or len(v) == 1
    return out


def test_pack_cuts_only_what_exceeds(spark):
    check_pack(spark, [(1, 10), (2, 4), (3, 6), (4, 25), (5, 30), (6, None), (7, 0), (8, -1), (9, 4), (9, 4), (None, 3)], [("a", 10), ("b", 7), ("a", 10), ("z", None), ("y", 0)])


def test_pack_over_shards_and_empty(spark):
    rng = np.random.default_rng(1)
    sizes = [(i, int(n)) for i, n in enumerate(rng.integers(1, 40, 600))]
    out = check_pack(spark, sizes, [("a", 64)], shard_windows=20)
    assert len({r.container.split("-")[1] for r in out}) > 1
    fill = fill_report(pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long"), spark.createDataFrame([("a", 64)], "profile string, capacity_tokens int"))).first()
    assert fill.fill > 0.97
    assert check_pack(spark, [], [("a", 5)]) == [] and check_pack(spark, [(1, 5)], []) == []


@needs_ranks
def test_token_counts_are_those_of_whole_texts(spark):
    texts = [(1, "Hello world", "q"), (2, "", "q"), (3, None, "q"), (4, "a" * 300_000, "q"), (5, "  \n", None), (6, "<|endoftext|>", "q"), (1, "Hello world", "q")]
    df = spark.createDataFrame(texts, "doc_id long, text string, n_tokens string")
    enc = encoding(RANKS)
    want = sorted((i, len(enc.encode_ordinary(t))) for i, t, _ in texts if t)
    assert sorted(tuple(r) for r in token_counts(df, ["doc_id"]).collect()) == want


def test_reachable_spreads_what_is_missing():
    t = {"a": (0.5, 1), "b": (0.3, 1), "c": (0.2, 2), "d": (0.0, 1)}
    g = reachable(t, {"a": 100, "b": 10, "c": 50}, 160)
    assert g["b"] == 10 and g["d"] == 0 and sum(g.values()) == pytest.approx(160)
    assert g["a"] == 100 and g["c"] == pytest.approx(50)


def mixed(spark, docs, targets, **kw):
    s = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, source string, n_tokens long, copies string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mix, report = mix_sources(s, t, **kw)
    return mix.collect(), {r.source: r for r in report.collect()}


def test_mix_meets_shares_and_caps(spark):
    rng = np.random.default_rng(2)
    docs = [(i, [" A", "a", "B", "c"][i % 4], int(n)) for i, n in enumerate(rng.integers(5, 200, 800))] + [(10_000 + i, None, 50) for i in range(40)] + [(20_000, "unlisted", 500), (20_001, "a", None), (20_002, "b", 0)]
    mix, rep = mixed(spark, docs, [("a", 0.3, 1), ("b", 0.5, 3), ("C ", 0.2, 2)])
    caps = {"a": 1, "b": 3, "c": 2}
    assert all(1 <= r.copies <= caps[r.source] for r in mix)
    got = collections.Counter()
    for r in mix:
        got[r.source] += r.n_tokens * r.copies
    total = sum(n or 0 for _, _, n in docs)
    assert sum(got.values()) == pytest.approx(total, rel=0.01)
    for s, w in (("a", 0.3), ("b", 0.5), ("c", 0.2)):
        assert got[s] / sum(got.values()) == pytest.approx(w, abs=0.01)
        assert rep[s].real_share == pytest.approx(got[s] / sum(got.values()), abs=1e-5) and rep[s].reached


def test_mix_reports_what_cannot_be_reached(spark):
    mix, rep = mixed(spark, [(i, "big", 100) for i in range(50)] + [(100, "small", 10)], [("big", 0.5, 2), ("small", 0.4, 3), ("none", 0.1, 5)])
    assert not rep["small"].reached and not rep["none"].reached and rep["none"].mixed_tokens == 0
    assert [r.copies for r in mix if r.source == "small"] == [3]


def test_mix_of_two_thousand_sources(spark):
    rng = np.random.default_rng(5)
    docs = [(i, f"s{i % 2000}", int(n)) for i, n in enumerate(rng.integers(20, 60, 40_000))]
    w = rng.uniform(0.5, 1.5, 2000)
    w /= w.sum()
    mix, rep = mixed(spark, docs, [(f"s{i}", float(x), 3) for i, x in enumerate(w)])
    assert len(rep) == 2000 and all(r.reached for r in rep.values())
    total = sum(n for *_, n in docs)
    assert sum(r.mixed_tokens for r in rep.values()) == pytest.approx(total, rel=0.01)
    for i, x in enumerate(w):
        assert abs(rep[f"s{i}"].mixed_tokens - x * total) <= 61
        assert rep[f"s{i}"].real_share == pytest.approx(x, abs=1e-4)


def test_mix_empty(spark):
    assert mixed(spark, [], [("a", 1.0, 1)])[0] == []
    mix, rep = mixed(spark, [(1, "a", 5)], [])
    assert mix == [] and rep == {}


def test_body_sentences():
    page = "Home · Law · Sport\nThis site sets cookies. Accept all\nCourts and fines\nThe court sat. Art. 5 applies – see no. 7 there!\nEt al\xadso café?\n\nBack to top | x.example"
    assert body_sentences(page) == ["the court sat.", "art. 5 applies – see no. 7 there!", "et also cafe?"]
    assert body_sentences("") == [] and body_sentences("Menu | Law") == []
    assert repaired("GrÃ¼ÃŸe.") == "Grüße."
    assert repaired("Über.") == "Über."
    codes, ends = coded("x." * 100_000)
    assert len(ends) >= 1 and ends[-1] == len(codes)


WORDS = {"law": "court judge statute appeal tribunal verdict", "food": "oven dough spice broth recipe flour"}


def page(rng, subject):
    w = WORDS[subject].split()
    lines = [f"The {rng.choice(w)} and the {rng.choice(w)} came before the {rng.choice(w)}." for _ in range(6)]
    return "Law | Food | Home\n" + " ".join([*lines, "Many people wrote to us."]) + "\nAll rights reserved. x.example"


def test_subjects_of_a_small_corpus(spark):
    rng = np.random.default_rng(3)
    truth = {i: ("law" if i % 2 else "food") for i in range(240)}
    docs = [(i, page(rng, s), 1.0) for i, s in truth.items()] + [(900, "Law | Food\nMany people wrote to us.", 1.0), (901, None, 1.0), (902, "", 1.0), (903, "Law Food Sport", 1.0), (904, page(rng, "law").replace("\nAll", " " + page(rng, "food").split("\n")[1] + "\nAll"), 1.0), (None, page(rng, "law"), 1.0), (905, page(rng, "law"), 1.0), (905, page(rng, "food"), 1.0)]
    labels = [(i, f" {truth[i].upper()}", "ann") for i in range(0, 60)] + [(0, "food", "ann"), (900, "none", "ann"), (None, "law", "ann"), (5, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, share double")
    la = spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    su = spark.createDataFrame([("law",), ("food",)], "subject string")
    got = collections.defaultdict(set)
    for r in subject_areas(d, la, su, leaves=8, max_df=0.6).collect():
        got[r.doc_id].add(r.subject)
    assert sum(got[i] == {s} for i, s in truth.items()) > 230
    assert got[904] == {"law", "food"} == got[905] and got[None] == {"law"} and not any(got[i] for i in (900, 901, 902, 903))
    assert subject_areas(d.limit(0), la, su).count() == 0
    assert subject_areas(d, la.limit(0), su, leaves=4).count() == 0
    assert subject_areas(d, la, su.limit(0)).count() == 0


def test_subjects_come_from_the_tree(spark, monkeypatch):
    """Without the splits, or with a label of no terms and no votes, nothing is told apart."""
    from netspark.llm import subjects as module

    rng = np.random.default_rng(4)
    truth = {i: ("law" if i % 2 else "food") for i in range(120)}
    d = spark.createDataFrame([(i, page(rng, s)) for i, s in truth.items()], "doc_id long, text string")
    la = spark.createDataFrame([(i, truth[i], "ann") for i in range(40)], "doc_id long, subject string, annotator string")
    su = spark.createDataFrame([("law",), ("food",)], "subject string")

    def right():
        return sum(truth[r.doc_id] == r.subject for r in subject_areas(d, la, su, leaves=8, max_df=0.6).collect())

    assert right() > 110
    monkeypatch.setattr(module, "bisect", lambda known, leaves: (module.Tree(), {0: known.count()}))
    assert right() < 70


def test_leaf_labels_and_mixtures():
    counts = np.array([[9.0, 0, 8], [0, 9, 0], [5, 5, 5]])  # term 0 marks leaves 0 and 2, term 1 leaf 1
    labels = leaf_labels(counts, np.array([10.0, 10, 10]), counts.sum(1), 30, top=1)
    assert labels.argmax(0).tolist() == [0, 1, 0]
    mix = leaf_mixtures(np.array([[3.0, 0], [0, 3], [0, 0]]), labels, np.array([10.0, 10, 10]))
    assert mix.sum(1) == pytest.approx(np.ones(3)) and mix[2, 0] > 0.8 and mix[0, 0] > 0.9 > 0.1 > mix[1, 0]


def test_subject_limits_are_errors(spark, monkeypatch):
    from netspark.llm import subjects as module

    d = spark.createDataFrame([(i, "The court sat and the judge wrote.") for i in range(4)], "doc_id long, text string")
    la = spark.createDataFrame([(1, "law", "ann")], "doc_id long, subject string, annotator string")
    su = spark.createDataFrame([("law",), ("food",)], "subject string")
    monkeypatch.setattr(module, "MAX_TERMS", 3)
    with pytest.raises(ValueError, match="terms"):
        subject_areas(d, la, su, max_df=1.0)
    monkeypatch.setattr(module, "MAX_SUBJECTS", 1)
    with pytest.raises(ValueError, match="subjects"):
        subject_areas(d, la, su)
