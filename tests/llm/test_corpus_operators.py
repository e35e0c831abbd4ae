"""Operators over the whole corpus, held against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from leadlens.llm import bag_minhash, line_dedup, mixing
from leadlens.llm.common import components
from tests.llm.tables import edited, prose


def plain_lines(rows):
    """(id, text) -> number of removed lines and text, by comparing every pair of lines."""
    sets, out = [], {}
    for d, t in sorted({(r[0], r[1]) for r in rows}, key=lambda x: (x[0] is not None, x[0] or 0)):
        if t is None:
            out[d, t] = (0, 0, None)
            continue
        stay = []
        for line in t.split("\n"):
            w = frozenset(line.encode().split())
            enough = len(line.encode().split()) >= line_dedup.MIN_WORDS
            alike = enough and any(len(w & x) >= 0.8 * len(w | x) - 1e-12 for x in sets)
            if enough and w not in sets:
                sets.append(w)
            if not alike:
                stay.append(line)
        n = len(t.split("\n"))
        out[d, t] = (n, n - len(stay), "\n".join(stay))
    return out


def test_line_dedup_by_brute_force(docs, none, rows):
    want = plain_lines([r for r in rows if r[0] is not None])
    got = line_dedup.dedup(docs.where("doc_id is not null"))
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_removed"] or set(got.columns) == {*docs.columns, "n_removed"}
    texts = {r[0]: r[1] for r in rows}
    got = got.collect()
    assert len(got) == sum(r[0] is not None for r in rows)
    for r in got:
        assert (r.n_lines, r.n_removed, r.text) == want[r.doc_id, texts[r.doc_id]]
    assert line_dedup.dedup(none).count() == 0
    assert line_dedup.dedup(docs).count() == len(rows)  # null ids too


def test_line_dedup_of_many_near_copies(llm):
    r = random.Random(2)
    base = [f"w{i}" for i in range(40)]
    lines = [" ".join(base[:i] + [f"v{r.randint(0, 3)}"] + base[i + 1:]) for i in range(40) for _ in range(3)]
    lines += [" ".join(r.sample(base, r.randint(2, 8)) + [f"u{r.randint(0, 30)}"]) for _ in range(400)]
    r.shuffle(lines)
    rows = [(i // 3, "\n".join(lines[i:i + 3])) for i in range(0, len(lines), 3)]
    want = plain_lines(rows)
    got = line_dedup.dedup(llm.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    for x in got:
        assert (x.n_lines, x.n_removed, x.text) == want[x.doc_id, texts[x.doc_id]]
    assert sum(x.n_removed for x in got) > 50


def joined_rows(plan):
    """Rows that the joins below and in a plan that has run made."""
    below = sum(joined_rows(plan.children().apply(i)) for i in range(plan.children().size()))
    return below + (plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0)


def test_line_dedup_of_a_crowd_compares_few_pairs(llm, monkeypatch):
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    lines = [" ".join(f"x{r.randint(0, 10 ** 6)}" if r.random() < 0.12 else w for w in base) for _ in range(150)]
    lines += [" ".join(base[:k] + [f"y{i}_{j}" for j in range(90)]) for i in range(40) for k in (0, 8)]  # a common passage
    lines += [" ".join(r.sample([f"u{j}" for j in range(400)], 150)) for _ in range(100)]  # long, of the same words, unlike
    r.shuffle(lines)
    rows = [(i // 2, "\n".join(lines[i:i + 2])) for i in range(0, len(lines), 2)]
    made, real = [], line_dedup.written

    def written(df, name):
        if name == "line_pairs":
            df.collect()
            made.append(joined_rows(df._jdf.queryExecution().executedPlan()))
        return real(df, name)

    monkeypatch.setattr(line_dedup, "written", written)
    old = {k: llm.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    llm.conf.set("spark.sql.adaptive.enabled", "false")
    llm.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    want, texts = plain_lines(rows), dict(rows)
    try:
        got = line_dedup.dedup(llm.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        for k, v in old.items():
            llm.conf.set(k, v)
    assert all((x.n_lines, x.n_removed, x.text) == want[x.doc_id, texts[x.doc_id]] for x in got)
    assert 0 < sum(x.n_removed for x in got) < 100
    assert sum(made) < 60_000, made  # 11,175 pairs of near copies and 4,950 of long lines


def test_line_dedup_finds_sets_that_are_just_alike(llm):
    r, rows = random.Random(3), []
    for n in (4, 5, 6, 9, 13, 24, 39, 40, 99):
        words = [f"v{i}" for i in range(3 * n)]
        for _ in range(12):
            base = r.sample(words, n)
            rows.append((len(rows), " ".join(base)))
            for _ in range(4):  # some words go, others come
                gone = r.randint(0, n // 5)
                line = r.sample(base, n - gone) + [f"z{r.randint(0, 10 ** 9)}" for _ in range(r.choice([0, gone, n // 4]))]
                rows.append((len(rows), " ".join(r.sample(line, len(line)))))
    want = plain_lines(rows)
    got = line_dedup.dedup(llm.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all((x.n_lines, x.n_removed, x.text) == want[x.doc_id, rows[x.doc_id][1]] for x in got)


def test_line_dedup_of_short_lines(llm):
    long = "\u6f22\u5b57" * 400
    rows = [(0, f"Read more\nHome\n\n{long}\na b c"), (1, f"Home\nmore Read\nRead\n \n{long}\nb c"),
            (2, f"{long}x\nRead more now\nHome Home\n\nc b a\na b c d"), (3, "a b c d e\nHome page")]
    got = {x.doc_id: x.text for x in line_dedup.dedup(llm.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: rows[0][1], 1: "Read\n \nb c", 2: f"{long}x\nRead more now\n\na b c d", 3: "Home page"}
    # with a least number of words, shorter lines are left alone
    got = {x.doc_id: x.n_removed for x in line_dedup.dedup(llm.createDataFrame(rows, "doc_id long, text string"), min_words=3).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1}


def plain_classes(texts):
    ids = sorted(texts)
    label = {d: d for d in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if texts[a].split() and texts[b].split() and bag_minhash.overlap(texts[a], texts[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: find(d) for d in ids}


def test_near_duplicates_by_brute_force(docs, none, by_id, rows):
    want = plain_classes({d: (t or "").encode() for d, t in by_id.items()})
    got = bag_minhash.classes(docs).collect()
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert len(got) == len({r[0] for r in rows})
    size = Counter(want.values())
    assert all(r.class_size == size[r.class_id] for r in got if r.doc_id is not None)
    assert bag_minhash.classes(none).count() == 0


def test_near_duplicate_groups_and_chains(llm):
    base = [prose(50 + i, 200) for i in range(4)]
    texts = {}
    for i in range(60):  # a hot group of near copies, chains of growing edits, and apart ones
        texts[i] = edited(base[0], i, 0.012)
    chain = base[1]
    for i in range(60, 75):
        texts[i] = chain
        chain = edited(chain, i, 0.02)
    for i in range(75, 90):
        texts[i] = edited(base[2], i, 0.4)
    texts[90] = texts[91] = base[3]
    want = plain_classes({d: t.encode() for d, t in texts.items()})
    df = llm.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in bag_minhash.classes(df).collect()} == want
    assert len(set(want.values())) < 40


def test_bag_minhash_is_unbiased():
    r = np.random.default_rng(0)
    miss = []
    for _ in range(200):
        h = r.integers(0, 2 ** 63, 60).astype(np.uint64)
        a, b = r.integers(0, 4, 60), r.integers(0, 20, 60)
        b = np.where(r.random(60) < 0.6, a, b)
        doc = np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]
        s = bag_minhash.signatures(doc, np.r_[h[a > 0], h[b > 0]], np.r_[a[a > 0], b[b > 0]].astype(float), 2)
        miss.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(miss)) < 0.015 and np.std(miss) < 0.09


def test_signatures_do_not_depend_on_the_batch():
    words = [prose(i, 30 + 50 * i).encode().split() for i in range(6)] + [[b"a"], [b"a", b"b", b"a", b"b", b"a", b"b", b"a"]]
    every = bag_minhash.signatures(*bag_minhash.shingles(words), len(words))
    for i, w in enumerate(words):
        assert (bag_minhash.signatures(*bag_minhash.shingles([w]), 1)[0] == every[i]).all()


def test_components_of_chains(llm):
    edges = [(i, i + 1) for i in range(0, 40) if i != 20] + [(100, 50), (50, 7), (200, 201)]
    got = {r.id: r.label for r in components(llm.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in [*range(21), 50, 100]) and all(got[i] == 21 for i in range(21, 41)) and got[201] == 200


def plain_targets(size, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(size.values()), set(names), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * size[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
        if not open_:
            return out


def test_mix_targets_and_takes(docs, none, rows):
    got = mixing.mix(docs).collect()
    size = defaultdict(int)
    import re
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in rows:
        size[r[3]] += words(r[1])
    want = plain_targets(size)
    of = {r[0]: r for r in rows}
    assert len(got) == len(rows)
    for r in got:
        s = of[r.doc_id][3] if r.doc_id is not None else None
        if r.doc_id is not None:
            assert r.size == words(of[r.doc_id][1]) and r.source_size == size[s] and r.target == pytest.approx(want[s])
        assert r.taken in (0, r.size, 2 * r.size)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    assert mixing.mix(none).count() == 0


def test_mix_comes_near_its_targets(llm):
    r = random.Random(1)
    rows = [(i, "w " * r.randint(1, 40), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    got = mixing.mix(llm.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    of = {i: s for i, _, s in rows}
    taken, target = Counter(), {}
    for x in got:
        taken[of[x.doc_id]] += x.taken
        target[of[x.doc_id]] = x.target
    assert all(abs(taken[s] - target[s]) < 120 for s in target)


def test_targets_of_uneven_sources(llm):
    for seed in range(5):
        r = random.Random(seed)
        size = {f"s{i}": r.choice([0, 1, 10, 1000, 100000]) for i in range(9)} | {None: 50}
        df = llm.createDataFrame(list(size.items()), "source string, size long")
        got = {x.source: x.target for x in mixing.targets(df).collect()}
        want = plain_targets(size)
        assert got == pytest.approx(want)


@pytest.mark.parametrize("flip", [False, True])
def test_texts_under_one_id_join_their_classes(llm, flip):
    a, b = prose(1, 200), prose(2, 200)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, prose(3, 200))]
    rows = [rows[1], rows[0], *rows[2:]] if flip else rows
    got = {r.doc_id: (r.class_id, r.class_size) for r in bag_minhash.classes(llm.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 1)}


def test_what_is_apart_after_the_rounds_is_compared(llm, monkeypatch):
    """Without any round after the first, the last join alone finds the links between components."""
    monkeypatch.setattr(bag_minhash, "ROUNDS", 1)
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    base = [r.choice(vocab) for _ in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in r.sample(range(150), r.choice([1, 2, 3, 5, 9])):
            w[k] = r.choice(vocab)
        rows.append((i, " ".join(w)))
    want = plain_classes({i: t.encode() for i, t in rows})
    assert {x.doc_id: x.class_id for x in bag_minhash.classes(llm.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    assert len(set(want.values())) > 1


def test_texts_that_are_not_near_bring_no_bags_to_the_last_join(llm, monkeypatch):
    """Copies of one text with so many changes each that no two are alike, though most of each occurs in others."""
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(3000)]
    base = [r.choice(vocab) for _ in range(200)]
    rows = []
    for i in range(50):
        w = list(base)
        for k in range(5 + i % 20, 200, 28):
            w[k] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
    made, real = {}, bag_minhash.written

    def written(df, name):
        out = real(df, name)
        made[name] = out.count()
        return out
    monkeypatch.setattr(bag_minhash, "written", written)
    near = [(50, "first " + rows[0][1])]  # one real link
    got = {x.doc_id: x.class_id for x in bag_minhash.classes(llm.createDataFrame(rows + near, "doc_id long, text string")).collect()}
    assert got == plain_classes({i: t.encode() for i, t in rows + near})
    assert made["buckets"] > 50 and made.get("shared", 0) < 25


def test_rows_of_the_last_join_do_not_grow_with_the_texts(llm, monkeypatch):
    """Rows that hold whole bags, once a band, are cut into so many pieces where buckets are large that the driver cannot hold their tasks."""
    monkeypatch.setattr(bag_minhash, "ROUNDS", 1)
    r = random.Random(8)
    base = [f"w{r.randrange(9000)}" for _ in range(600)]
    rows = []
    for i in range(24):
        w = list(base)
        for k in r.sample(range(600), r.choice([4, 12, 36])):
            w[k] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
    sides, real = [], bag_minhash._sides

    def widest(apart):
        sides.append(max(len(str(x)) for x in apart.drop("sig", "map", "before").collect()))
        return real(apart)
    monkeypatch.setattr(bag_minhash, "_sides", widest)
    got = {x.doc_id: x.class_id for x in bag_minhash.classes(llm.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes({i: t.encode() for i, t in rows})
    assert len(sides) == 2 and max(sides) < 500
