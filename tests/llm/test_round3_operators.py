"""op11, op12 and op13 against brute force, their odd tables, and what their methods promise."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leadlens.llm import periodic_runs, pii_boost, spelling_variants

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# -- op11: personal data ------------------------------------------------------------------------

def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain_pii(text: str) -> dict:
    """The contract's patterns, as it words them."""
    def digits(s):
        return re.sub("[^0-9]", "", s)
    found = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15],
    }
    return found


PII = [
    "mail a.b@c.de, x@y@z.com and a@b.c_d@e.f; not a@b or @c.de", "x" * 3000 + "@" + "y" * 3000 + ".com" + ".a" * 2000, "1.2.3.4.5.6.7.8 and 256.1.1.1, 01.002.0003.255 1.2.3",
    "card 4713332104704538, 4713-3321-0470-4538 and 4713 3321 0470 4538 5 or 4713  3321", "call +1 (499) 555-6503, +49.171.2345678. +1 and +1234567 + 12", "ü😀 +44 20 7946 0958 漢字 1.1.1.1 é b@c.d",
    "9" * 5000, "1" * 15 + " " + "2" * 4, "+" * 50 + "12 34 56 78 9", "10.0.0.1" * 300, ("a@b.cd " + "1.2.3.4 +12345678901 ") * 700, "a@b.c\na@b.c\r\n+1 22 33 44 55", None, "", "clean words only",
]


@pytest.fixture(scope="module")
def trees(llm, docs):
    texts = [(i, f"{w} text number {i} with some words and {i * 7919} things, see 12.05.2011 or call {w} now") for i, w in enumerate(["alpha", "beta", "gamma"] * 60)]
    return pii_boost.train(llm.createDataFrame(texts, "doc_id long, text string"), sample=200)


def check_pii(rows: list[tuple], got: list) -> None:
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    assert len(got) == len(rows)
    for r in got:
        want = []
        for t in texts[r.doc_id]:
            found = plain_pii(t)
            base = ",".join(f"{k}:{s}:{e}" for k in pii_boost.KINDS for s, e in found[k])
            want.append((*(len(found[k]) for k in pii_boost.KINDS), sha(base)))
            if want[-1] == (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256):
                own = r.spans.split(",") if r.spans else []
                assert [s for s in own if not s.startswith("learned")] == (base.split(",") if base else [])
                learned = [tuple(map(int, s.split(":")[1:])) for s in own if s.startswith("learned")]
                assert learned == sorted(learned) and len(learned) == r.n_learned
                spans = sorted([x for k in found.values() for x in k])
                assert all(e <= a or b <= s for s, e in learned for a, b in spans)
                break
        else:
            raise AssertionError((r, want))


def test_op11_by_brute_force(llm, trees):
    rows = list(enumerate(PII))
    r = random.Random(4)
    for i in range(400):
        rows.append((100 + i, "".join(r.choice(["1", "2", "99", ".", "@", "+", " ", "-", "a", "é", "(", ")", ".1.", "+12", "4713332104704538", "b.c"]) for _ in range(r.randint(1, 60)))))
    df = llm.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_pii(rows, pii_boost.digest(pii_boost.scan(df, trees)).collect())


def test_op11_odd_tables(llm, docs, rows, none, trees):
    check_pii([r[:2] for r in rows], pii_boost.digest(pii_boost.scan(docs, trees)).collect())
    out = pii_boost.digest(pii_boost.scan(none, pii_boost.train(none)))
    assert out.collect() == [] and out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_learned"]
    only_null = llm.createDataFrame([(None, None)] * 3, "doc_id long, text string")
    assert [r.spans for r in pii_boost.digest(pii_boost.scan(only_null, pii_boost.train(only_null))).collect()] == [""] * 3


def test_op11_trees_find_what_no_pattern_marks(llm, trees):
    hit = ["Please write to jsmith (at) example (dot) org for more", "Tel: (0171) 555-1234 today", "she said call me on 0171 2345678 please", "card 4713.3321.0470.4538 was used",
           "host fe80:0000:0000:0000:0202:b3ff:fe1e:8329 answered", "his SSN 536-22-8721 leaked"]
    clean = ["it was on 2011-05-12 that they met", "a total of 1.234.567,89 in 2010", "at 12:30:45 it rained", "ISBN 978-3-16-148410-0 is a book", "years 1990-1995 were good",
             "they looked at the house dot by dot", "pages 120-134 and 1 234 567 people", "version 10.15.7.2024 of it", "order no 4829104 came"]
    df = llm.createDataFrame(list(enumerate(hit + clean)), "doc_id long, text string")
    n = {r.doc_id: r.n_learned for r in pii_boost.digest(pii_boost.scan(df, trees)).collect()}
    assert sum(n[i] for i in range(len(hit))) >= len(hit) - 1 and not any(n[i] for i in range(len(hit), len(n)))
    for precision, recall in (trees.held_out[g] for g in pii_boost.GENERATORS):
        assert precision >= pii_boost.PRECISION and recall >= 0.8


def test_op11_expression_equals_trees(llm, trees):
    import numpy as np
    r = np.random.default_rng(2)
    x = r.integers(0, 20, (200, len(pii_boost.FEATURES)))
    df = llm.createDataFrame([tuple(map(int, row)) for row in x], ", ".join(f"{f} int" for f in pii_boost.FEATURES))
    got = [row[0] for row in df.select(trees.expression(F.struct(*df.columns))).collect()]
    assert np.allclose(got, trees.chance(x.astype(float)))


def test_op11_redacts(llm, trees):
    df = llm.createDataFrame([(1, "mail a@b.cd or 1.2.3.4, é +49 171 2345678!"), (2, None), (3, "nothing")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii_boost.redacted(pii_boost.scan(df, trees)).collect()}
    assert got == {1: "mail [email] or [ip], é [phone]!", 2: None, 3: "nothing"}


def test_op11_is_native(llm, trees):
    docs = llm.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = pii_boost.digest(pii_boost.scan(docs, trees))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


# -- op12: spelling variants --------------------------------------------------------------------

def plain_words(rows: list[tuple]) -> Counter:
    out = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode()) if i is not None else 1
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            out[w] += 1
    return out


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows: list[tuple]) -> dict:
    count = {w: n for w, n in plain_words(rows).items() if len(w) >= 7 and n >= 2}
    # words one edit apart agree but for one place of one of them
    shapes = {}
    for w in count:
        for i in range(len(w) + 1):
            shapes.setdefault(w[:i] + "*" + w[i:], set()).add(w)
            shapes.setdefault(w[:i] + "*" + w[i + 1:], set()).add(w)
    close = {w: {v for i in range(len(w) + 1) for x in (w[:i] + "*" + w[i:], w[:i] + "*" + w[i + 1:]) for v in shapes[x] if near(v, w)} for w in count}
    form = {}
    for w, n in count.items():
        best = min(close[w], key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 10 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (form[w], root(w), n, len(close[w]), count[form[w]] if form[w] else None) for w, n in count.items()}


def check_variants(rows: list[tuple], got: list) -> None:
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain_variants(rows) and len(got) == len(plain_variants(rows))


def test_op12_by_brute_force(llm):
    r = random.Random(8)
    letters = "abÉñz"
    stems = ["".join(r.choice(letters[:3] if k % 2 else letters) for _ in range(r.randint(6, 10))) for k in range(60)] + ["aaaaaaa", "aaaaaaaa", "abababab", "bababab", "ababababa"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = r.choice(stems) if r.random() < 0.7 else stems[int(60 * r.random() ** 3)]
            if r.random() < 0.1:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1:], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1:]])
            words.append(w.title() if r.random() < 0.1 else w)
        rows.append((i if i % 9 else None, " ".join(words)))
    check_variants(rows, spelling_variants.variants(llm.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())


def test_op12_chains_of_forms(llm):
    words = [("abcdefgh", 2), ("abcdefghi", 20), ("abcdefghij", 200), ("abcdefghijk", 2000), ("zzzzzzz", 5), ("zzzzzzy", 50), ("zzzzzzx", 50)]
    got = {r.word: (r.form, r.root) for r in spelling_variants.group(llm.createDataFrame(words, "word string, n long")).collect()}
    assert got["abcdefgh"] == ("abcdefghi", "abcdefghijk") and got["abcdefghijk"] == (None, "abcdefghijk")
    assert got["zzzzzzz"] == ("zzzzzzx", "zzzzzzx") and got["zzzzzzy"] == (None, "zzzzzzy")


def test_op12_odd_tables(llm, docs, rows, none):
    check_variants([r[:2] for r in rows], spelling_variants.variants(docs).collect())
    assert spelling_variants.variants(none).collect() == []


def test_op12_pivots_share_no_letter_and_are_the_rarest():
    r = random.Random(3)
    for edits in (1, 2):
        for _ in range(500):
            grams = sorted((r.randrange(9), i) for i in r.sample(range(12), 2 * edits + 1))
            got = spelling_variants.pivots(grams, edits)
            import itertools
            rank = {i: k for k, i in grams}
            sets = [c for c in itertools.combinations(sorted(rank), edits + 1) if all(b - a >= 2 for a, b in zip(c, c[1:]))]
            assert tuple(got) in sets and sum(rank[i] for i in got) == min(sum(rank[i] for i in c) for c in sets)


# -- op13: periodic runs ------------------------------------------------------------------------

def plain_runs(w: list, least: int = 12) -> list[tuple[int, int, int]]:
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s >= max(q, least - q):
                out.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, length, q) for (s, length), q in out.items())


def plain_periodic(i, text) -> tuple:
    w = WORD.findall(text or "")
    n = len(w)
    if i is not None and n:
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def spread(rows: list) -> list:
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("rounds", [0, 1, 16])
def test_op13_runs_by_brute_force(rounds, monkeypatch):
    monkeypatch.setattr(periodic_runs, "ROUNDS", rounds)
    r = random.Random(rounds)
    for _ in range(400):
        docs = []
        for _ in range(r.randint(0, 5)):
            k = r.choice([1, 2, 2, 3, 5, 30])
            d = [b"%d" % r.randrange(k) for _ in range(r.randint(0, 70))]
            for _ in range(r.randint(0, 3)):
                at, q = r.randrange(len(d) + 1), r.randint(1, 14)
                d[at:at] = d[at:at + q] * r.randint(2, 8)
            docs.append(d)
        least = r.choice([12, 12, 2, 5, 30])
        got = periodic_runs.runs_of(docs, least)
        assert [sorted(map(tuple, g.tolist())) for g in got] == [plain_runs(d, least) for d in docs]


def test_op13_query_by_brute_force(llm):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["a", "b", "é", "d\n"]) for _ in range(r.randint(0, 60))) + (" x y z" * r.randint(0, 9))) for i in range(300)]
    rows += [(1000 + i, f"w{i} " * 30 + "tail") for i in range(40)] + [(2000 + i, " ".join(f"u{k}" for k in range(100))) for i in range(40)]
    got = periodic_runs.digest(periodic_runs.find(periodic_runs.planted(llm.createDataFrame(rows, "doc_id long, text string").repartition(3)))).collect()
    assert spread(got) == spread(plain_periodic(*x) for x in rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)


def test_op13_odd_tables(llm, docs, rows, none):
    got = periodic_runs.digest(periodic_runs.find(periodic_runs.planted(docs))).collect()
    short = [r[:2] for r in rows if len(r[1] or "") < 100_000]
    want = spread(plain_periodic(*x) for x in short)
    assert len(got) == len(rows) and set(want) <= {tuple(r) for r in got}
    assert periodic_runs.digest(periodic_runs.find(none)).collect() == []


def test_op13_long_repetitions_take_little_work():
    import time
    start = time.monotonic()
    assert [len(x) for x in periodic_runs.runs_of([[b"a"] * 100_000, [b"a", b"b"] * 40_000])] == [1, 1]
    assert len(periodic_runs.runs_of([([b"a"] * 13 + [b"b"]) * 4000])[0]) == 4001
    assert time.monotonic() - start < 60
