"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

Patterns find values that are assigned to a telling name, access keys and long hex runs; these spans
always stay. Candidates for the network are all other runs of key-like characters that hold a digit,
and those without one that are long and mix upper and lower case. A run may be longer than a key, as a
path is that ends in one, so the network sees windows of ``INSIDE`` characters, ``STRIDE`` apart, over
the whole run, each with the text on either side of it, and the greatest chance of a run's windows is the
run's. The network: one-hot characters, a convolution, rectified, its greatest and mean response over the run and over the context, a dense
layer, a sigmoid. It is written in numpy and trained on labelled findings: the values that the
patterns found (also with their names taken away and their characters drawn anew, so that it learns
keys and not the names beside them) against candidates and words that no pattern marks. Its scores
are calibrated on held-out findings by a logistic fit, and the threshold is the highest at which the
held-out recall stays at ``RECALL`` or more, but not under ``LEAST``.

Labelled findings come from a bounded sample of ``SAMPLE`` documents, those with the least hash of
their id (ids that repeat are all taken), and of ``ROWS`` snippets of a kind; every document is scanned. Nulls and odd rows: a null or empty text has no spans. Texts are
scanned whole. Repeated rows give repeated results. With no findings in the sample, the network
learns from drawn keys alone. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlens.llm.common import slices

#: Documents of the labelled sample, training rows, and the bounds of the threshold.
SAMPLE, ROWS, RECALL, LEAST = 4000, 6000, 0.95, 0.9
KINDS = ("assign", "access", "hex", "network")
# fixed values of the contract
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "api")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")

#: Characters that the network tells apart; all others are one.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 =:\"'+/_.-,;()<>{}[]@#$%&*!?\n"
INSIDE, STRIDE, AROUND, WIDTH, FILTERS, HIDDEN = 40, 20, 16, 4, 24, 16
#: Least length of a run without digits.
LETTERS = 20


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' spans."""
    spans = []
    low = text.lower()
    if any(n in low for n in NAMES):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


_DIGIT, _LOWER, _UPPER = re.compile("[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]")


def candidates(text: str, spans: list) -> list[tuple[int, int]]:
    """Key-like runs that no pattern's span meets."""
    out = []
    for m in RUN.finditer(text):
        s, e = m.span()
        keylike = _DIGIT.search(text, s, e) or (e - s >= LETTERS and _LOWER.search(text, s, e) and _UPPER.search(text, s, e))
        if keylike and not any(a < e and s < b for a, _, b in spans):
            out.append((s, e))
    return out


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """The parts of a run that the network sees, one after the other; the last one ends with the run."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(s, s + INSIDE) for s in (*range(start, end - INSIDE, STRIDE), end - INSIDE)]


_CODE = np.full(128, len(ALPHABET), np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
VOCABULARY, BLANK = len(ALPHABET) + 2, len(ALPHABET) + 1


def coded(text: str, start: int, end: int) -> np.ndarray:
    """Character numbers: context before, a run's or window's characters, context after; blanks fill up."""
    def part(s: str, n: int, right: bool) -> list[int]:
        codes = [int(_CODE[ord(c)]) if ord(c) < 128 else len(ALPHABET) for c in s]
        fill = [BLANK] * (n - len(codes))
        return fill + codes if right else codes + fill
    return np.array(part(text[max(0, start - AROUND):start], AROUND, True)
                    + part(text[start:min(end, start + INSIDE)], INSIDE, False)
                    + part(text[end:end + AROUND], AROUND, False), np.int64)


class Network:
    """The convolutional network; ``weights`` are plain arrays and travel with the task."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.weights = {"filters": r.normal(0, 0.3, (WIDTH, VOCABULARY, FILTERS)), "shift": np.zeros(FILTERS),
                        "dense": r.normal(0, 0.2, (3 * FILTERS, HIDDEN)), "dense_shift": np.zeros(HIDDEN),
                        "out": r.normal(0, 0.2, HIDDEN), "out_shift": np.zeros(1)}
        self.scale, self.offset, self.threshold, self.recall = 1.0, 0.0, 0.5, 0.0

    def forward(self, x: np.ndarray) -> tuple:
        w = self.weights
        n = x.shape[1] - WIDTH + 1
        conv = w["shift"] + sum(w["filters"][k][x[:, k:k + n]] for k in range(WIDTH))
        conv = np.maximum(conv, 0)
        inner = conv[:, AROUND:AROUND + INSIDE - WIDTH + 1]
        outer = np.concatenate([conv[:, :AROUND], conv[:, AROUND + INSIDE - WIDTH + 1:]], axis=1)
        at, at_out = inner.argmax(1), outer.argmax(1)
        f = np.concatenate([np.take_along_axis(inner, at[:, None], 1)[:, 0], inner.mean(1),
                            np.take_along_axis(outer, at_out[:, None], 1)[:, 0]], axis=1)
        h = np.maximum(f @ w["dense"] + w["dense_shift"], 0)
        return h @ w["out"] + w["out_shift"][0], h, f, conv, at, at_out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict:
        w = self.weights
        z, h, f, conv, at, at_out = self.forward(x)
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = {"out": h.T @ d, "out_shift": np.array([d.sum()])}
        dh = np.outer(d, w["out"]) * (h > 0)
        g["dense"], g["dense_shift"] = f.T @ dh, dh.sum(0)
        df = dh @ w["dense"].T
        length = INSIDE - WIDTH + 1
        dc = np.zeros_like(conv)
        inner = dc[:, AROUND:AROUND + length]
        inner += df[:, None, FILTERS:2 * FILTERS] / length
        rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        inner[rows, at, cols] += df[:, :FILTERS]
        place = np.where(at_out < AROUND, at_out, at_out + length)
        dc[rows, place, cols] += df[:, 2 * FILTERS:]
        dc *= conv > 0
        g["shift"] = dc.sum((0, 1))
        n = conv.shape[1]
        gf = np.zeros_like(w["filters"])
        flat = dc.reshape(-1, FILTERS)
        for k in range(WIDTH):
            codes = x[:, k:k + n].ravel()
            order = np.argsort(codes, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0])
            gf[k][codes[order][first]] = np.add.reduceat(flat[order], first, axis=0)
        g["filters"] = gf
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 12, batch: int = 256, seed: int = 5) -> "Network":
        """Adam over shuffled batches; a fifth is held out for calibration and threshold."""
        r = np.random.default_rng(seed)
        order = r.permutation(len(x))
        held, own = order[:len(x) // 5], order[len(x) // 5:]
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(rounds):
            own = r.permutation(own)
            for lo in range(0, len(own), batch):
                part = own[lo:lo + batch]
                step += 1
                for k, g in self.gradients(x[part], y[part]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.weights[k] -= 0.01 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)
        z, t = self.forward(x[held])[0], y[held]
        for _ in range(200):  # logistic fit of label on score, a little damped
            p = 1 / (1 + np.exp(-np.clip(self.scale * z + self.offset, -30, 30)))
            self.scale -= 0.5 * (np.mean((p - t) * z) + 1e-3 * self.scale)
            self.offset -= 0.5 * np.mean(p - t)
        p = np.sort(self.chance(x[held])[t == 1])
        self.threshold = max(LEAST, float(p[int((1 - RECALL) * len(p))])) if len(p) else LEAST
        self.recall = float((p >= self.threshold).mean()) if len(p) else 0.0
        if self.recall < RECALL and len(p):  # the recall comes first
            self.threshold = float(p[int((1 - RECALL) * len(p))])
            self.recall = float((p >= self.threshold).mean())
        return self

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.forward(x)[0] + self.offset, -30, 30)))


KEY_SETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
            "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
            "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
            "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def snippets(text: str, words: int = 40) -> list[tuple[str, int, int, int]]:
    """(label, text around, start, end) of a text's findings (1), other candidates (0) and first
    words (2), with what the network can see of them."""
    spans = patterns(text)
    marked = [(1, s, e) for s, _, e in spans] + [(0, s, e) for s, e in candidates(text, spans)]
    marked += [(2, m.start(), m.end()) for m in itertools.islice(re.finditer(r"[^\s]{6,}", text), words)]
    out = []
    for label, s, e in marked:
        run = text[s:min(e, s + 2 * INSIDE)]
        left = text[max(0, s - AROUND):s]
        out.append((label, left + run + text[e:e + AROUND], len(left), len(left) + len(run)))
    return out


def training_rows(labelled: list[tuple[int, str, int, int]], rows: int = ROWS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Coded rows and labels from snippets."""
    r = random.Random(seed)
    found, other, words = ([x[1:] for x in labelled if x[0] == k] for k in (1, 0, 2))
    r.shuffle(found)
    r.shuffle(other)
    r.shuffle(words)
    x, y = [], []

    def put(t, s, e, label):
        """One of the run's windows."""
        x.append(coded(t, *r.choice(windows(s, e))))
        y.append(label)

    def joined(least: int, most: int) -> str:
        """Words joined as in paths, ids and names."""
        case = r.choice((str, str, str.lower, str.title))
        return r.choice(("-", "_", "/", "+", "=", "")).join(case(r.choice(stems)) for _ in range(r.randint(least, most)))

    stems = [t[s:e] for t, s, e in words[:2000]] or ["word", "report", "page", "Value"]
    plain = [w for w in (re.sub("[^A-Za-z]", "", x) for x in stems) if 2 < len(w) <= 16]
    stems = plain or stems
    n = rows // 6
    for t, s, e in found[:n]:
        put(t, s, e, 1)
    frames = words[:rows] or [("", 0, 0)]
    for i in range(3 * n - min(n, len(found))):  # drawn keys in a found key's or a word's place
        t, s, e = frames[i % len(frames)] if i % 3 or not found else found[i % len(found)]
        key = "".join(r.choices(r.choice(KEY_SETS), k=r.randint(16, 44)))
        lead = tail = ""
        if i % 4 == 0:  # late in a run: at the end of a path, or inside it
            lead = joined(2, 10) + r.choice("/=_-+")
            tail = r.choice(("", "", "/" + joined(1, 4)))
        run = lead + key + tail
        text, at = t[max(0, s - 40):s] + run + t[e:e + 40], min(s, 40)
        # of the run's windows those that hold most of the key
        seen = [(min(b, at + len(lead) + len(key)) - max(a, at + len(lead)), a, b) for a, b in windows(at, at + len(run))]
        best = max(seen)[0]
        _, a, b = r.choice([w for w in seen if w[0] >= min(best, 16)])
        x.append(coded(text, a, b))
        y.append(1)
    for t, s, e in other[:n]:
        put(t, s, e, 0)
    own = [t[s:e] for t, s, e in words[:2000]] or ["word"]
    for i in range(3 * n - min(n, len(other))):  # words, joined words, dates, numbers and paths
        t, s, e = frames[i % len(frames)]
        kind = i % 6
        if kind == 0:
            run = t[s:e]
        elif kind == 1:
            run = r.choice("-_/").join(r.choice(own) for _ in range(r.randint(2, 4))) + r.choice(["", str(r.randint(0, 99))])
        elif kind == 2:
            run = r.choice("-/_").join(str(r.randint(0, 9999)) for _ in range(r.randint(3, 5)))
        elif kind == 3:
            run = "".join(r.choice("0123456789") for _ in range(r.randint(12, 20)))
        else:
            run = joined(3, 14) + r.choice(["", r.choice("-_/=") + str(r.randint(0, 9999))])
        put(t[max(0, s - 40):s] + run + t[e:e + 40], min(s, 40), min(s, 40) + len(run), 0)
    return np.stack(x), np.array(y, float)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Network:
    """A network fitted on the bounded sample."""
    key = F.xxhash64(F.col(id_col).cast("string"))
    ids = [r[0] for r in docs.select(key.alias("k")).orderBy("k").limit(sample).collect()]
    if not ids:
        return Network().fit(*training_rows([]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            rows = [x for t in b.column("text").to_pylist() for x in snippets(t or "")]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int32(), pa.int32()))],
                                             names=["label", "around", "start", "end"])

    found = (docs.where(key <= F.lit(max(ids))).select(F.col(text_col).alias("text"))
             .mapInArrow(run, "label int, around string, start int, end int"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("around", "start"), "around", "start", "end"))
    rows = found.withColumn("rank", rank).where(F.col("rank") <= ROWS).drop("rank").collect()
    return Network().fit(*training_rows(sorted(tuple(r) for r in rows)))


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_network long"


def scan(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, counts by kind, a digest of the patterns' spans, and all spans
    as kind:start:end in code points, by start, then kind."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            found, todo, texts = [], [], b.column("text").to_pylist()
            for i, t in enumerate(texts):
                spans = patterns(t or "")
                found.append(spans)
                todo += [(i, s, e) for s, e in candidates(t or "", spans)]
            extra = [[] for _ in found]
            parts = ((run, w) for run in todo for w in windows(*run[1:]))
            while part := list(itertools.islice(parts, 1024)):  # a run is found by the greatest chance of its windows
                p = network.chance(np.stack([coded(texts[run[0]], *w) for run, w in part]))
                for (i, s, e), _ in itertools.compress(part, (p >= network.threshold).tolist()):
                    extra[i].append((s, 3, e))
            extra = [sorted(set(x)) for x in extra]
            rows = []
            for spans, more in zip(found, extra):
                kinds = [k for _, k, _ in spans]
                base = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
                every = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans + more))
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(base.encode()).hexdigest(), every, len(more)))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), types))],
                                             names=["doc_id", *(c.split()[0] for c in RESULT.split(", "))])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, {RESULT}")
