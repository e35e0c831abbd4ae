"""Personal data: fixed patterns, and boosted trees over wider candidates, in DataFrame functions alone.

Patterns find e-mail addresses, IPv4 addresses, payment cards and international telephone numbers; these
spans always stay. Generators of high recall propose further spans, which overlap those and each other:
``handle`` (addresses with a written "at" or "dot" too), ``number`` (7 to 19 digits in any grouping) and
``colons`` (groups of hex digits). Each candidate gets features of its format (digits, groups,
separators, check digit, parts) and of its context (telling words before it, the characters at its ends).
Gradient-boosted trees give a score, a logistic fit on held-out rows makes it a chance, and each generator has
a threshold: the least chance from which held-out precision is ``PRECISION``. A candidate over it is kept
unless a pattern's span or a likelier candidate overlaps it (ties: the earlier, then the longer).

Positions come from built-in functions: a text split at a pattern's matches gives the pieces between
them, and running sums of the lengths of pieces and matches are the matches' places in code points. Sums run over blocks
of ``BLOCK`` numbers, then over blocks, so that thousands of matches in a text stay cheap. The patterns are
written so that a match never starts inside a run that failed before, which keeps them linear in the text.
Nothing is shuffled but the sample: all work on a document is a projection over its row.

Training: rows are the patterns' spans and the other candidates of a bounded sample of ``SAMPLE`` documents
(those with the least hash of their id; ids that repeat are all taken), at most ``ROWS`` of each label, and
``DRAWN`` spans drawn by rule in places of these documents: spellings of personal data that no pattern
marks, and dates, times, amounts, versions and order numbers, which are none. The trees are fitted on these
rows in the driver, in numpy; the fitted trees are SQL expressions.

Nulls and odd rows: a null or empty text has no spans. Texts are read whole. Repeated rows give repeated
results. Further columns are not read. With an empty table the trees learn from nothing, and no span is added.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import written

#: Documents of the sample, rows of a label, drawn rows; held-out precision that a threshold has to reach.
SAMPLE, ROWS, DRAWN, PRECISION = 2000, 4000, 6000, 0.99
ROUNDS, DEPTH, RATE, BINS = 40, 3, 0.3, 24
BEFORE, AFTER = 24, 8
BLOCK = 256

KINDS = ("email", "ip", "card", "phone")
GENERATORS = ("handle", "number", "colons")
#: The contract's patterns. Where a run of characters failed, none of its later places is tried again (they
#: would fail alike): hence the look-behinds, with \G for a match that the one before ended in.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
GUARDS = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]",
          "handle": r"(?i)@|[(\[]at[)\]]|\x20at\x20", "number": r"[0-9](?:[^A-Za-z0-9]{0,3}[0-9]){6}", "colons": r"[0-9A-Fa-f]:[0-9A-Fa-f]*+:"}
_AT, _DOT = r"(?:@|\x20?[(\[](?i:at)[)\]]\x20?|\x20(?i:at)\x20)", r"(?:\.|\x20?[(\[](?i:dot)[)\]]\x20?|\x20(?i:dot)\x20)"
PROPOSED = {
    "handle": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++" + _AT + r"[A-Za-z0-9-]++(?:" + _DOT + r"[A-Za-z0-9-]++)++",
    "number": r"(?<![0-9])(?:\+|\()?[0-9](?:[\x20()./-]{0,3}[0-9])++",
    "colons": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}+",
}
#: Words before a span that tell what follows; fixed values of this operator.
CONTEXT = {
    "says_phone": r"(?i)\b(tel|phone|telephone|call|mobile|cell|fax|whatsapp|telefon|handy|anruf|rufen|appelez|portable|llame|móvil|tél|téléphone|teléfono)\b",
    "says_mail": r"(?i)\b(e-?mail|mail|contact|write|kontakt|contacto|correo|courriel|reach)\b",
    "says_card": r"(?i)\b(card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|account|iban|konto)\b",
    "says_host": r"(?i)\b(ip|host|address|server|mac|adresse|dirección|login|from)\b",
    "says_person": r"(?i)\b(ssn|social|passport|license|licence|taxpayer|ausweis|nif|dni)\b",
    "says_other": r"(?i)\b(isbn|issn|version|ver|v|page|pages|p|pp|order|no|nr|id|item|date|on|at|since|until|price|eur|usd|total|room|chapter|section)\b",
}


def _running(sizes: Column) -> Column:
    """Running sums before each number of an array, and the whole sum last."""
    def sums(xs: Column) -> Column:
        return F.aggregate(xs, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))
    local = F.transform(blocks, sums)
    offsets = sums(F.transform(local, lambda s: F.element_at(s, -1)))
    return F.flatten(F.zip_with(local, F.slice(offsets, F.lit(1), F.size(offsets) - 1), lambda s, o: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda x: x + o)))


def with_matches(df: DataFrame, text: str, patterns: dict[str, str], prefix: str) -> DataFrame:
    """``df`` with an array (start, end, match) of each pattern's matches, in columns named ``prefix`` and the kind;
    empty where the text is null or its guard finds nothing."""
    kinds = list(patterns)
    # one column a step, so that no step is worked out twice
    found = {f"{prefix}{k}_found": F.when(F.col(text).rlike(GUARDS[k]), F.regexp_extract_all(text, F.lit(patterns[k]), F.lit(0))) for k in kinds}
    df = df.select("*", *(c.alias(n) for n, c in found.items()))
    some = {k: F.size(f"{prefix}{k}_found") > 0 for k in kinds}
    pieces = {k: F.transform(F.split(F.col(text), patterns[k], -1), lambda p: F.length(p)) for k in kinds}
    # pieces and matches in turn: what lies before a match is what the pieces up to it and the earlier matches hold
    sizes = {k: F.flatten(F.zip_with(pieces[k], F.col(f"{prefix}{k}_found"), lambda p, m: F.array(p, F.coalesce(F.length(m), F.lit(0))))) for k in kinds}
    df = df.select("*", *(F.when(some[k], sizes[k]).alias(f"{prefix}{k}_sizes") for k in kinds))
    df = df.select("*", *(F.when(some[k], _running(F.col(f"{prefix}{k}_sizes"))).alias(f"{prefix}{k}_places") for k in kinds))

    def placed(k: str) -> Column:
        at = F.col(f"{prefix}{k}_places")
        return F.transform(f"{prefix}{k}_found", lambda m, i: F.struct(F.get(at, 2 * i + 1).alias("start"), (F.get(at, 2 * i + 1) + F.length(m)).alias("end"), m.alias("match")))

    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    df = df.select("*", *(F.coalesce(F.when(some[k], placed(k)), none).alias(f"{prefix}{k}") for k in kinds))
    return df.drop(*(f"{prefix}{k}_{x}" for k in kinds for x in ("found", "sizes", "places")))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _octets(s: Column) -> Column:
    """Whether all parts between dots are at most 255."""
    return F.forall(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def valid(kind: str, match: Column) -> Column:
    """Whether a pattern's match stays."""
    n = F.length(_digits(match))
    if kind == "ip":
        return _octets(match)
    if kind == "card":
        return n.between(16, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def base_spans(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """``df`` with the patterns' spans that stay, an array (start, end, match) a kind."""
    df = with_matches(df, text, PATTERNS, prefix)
    others = [F.col(f"`{c}`") for c in df.columns if c not in [prefix + k for k in KINDS]]

    def staying(k: str) -> Column:
        return F.filter(prefix + k, lambda s: valid(k, s["match"])).alias(prefix + k)

    return df.select(*others, *map(staying, KINDS))


FEATURES = ("generator", "n_digits", "n_groups", "longest", "shortest", "international", "checked", "dots", "hyphens", "spaces", "slashes", "brackets", "colons",
            "octets", "sign", "spoken", "name_end", "letters", "year", "date", "clock", "length", "joined_before", "joined_after", *CONTEXT)


def features(c: Column) -> Column:
    """The features of a candidate (generator, before, match, after), all integers."""
    m, digits = c["match"], _digits(c["match"])
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, lambda g: F.length(g))

    def count(pattern: str) -> Column:
        return F.length(m) - F.length(F.regexp_replace(m, pattern, ""))

    n = F.length(digits)
    number = c["generator"] == 1
    values = {
        "generator": c["generator"], "n_digits": n, "n_groups": F.size(groups), "longest": F.coalesce(F.array_max(sizes), F.lit(0)),
        "shortest": F.coalesce(F.array_min(sizes), F.lit(0)), "international": m.rlike(r"^(\+|00)"), "checked": number & n.between(13, 19) & F.call_function("luhn_check", digits),
        "dots": count(r"\."), "hyphens": count("-"), "spaces": count(" "), "slashes": count("/"), "brackets": count(r"[()\[\]]"), "colons": count(":"),
        "octets": m.rlike(r"^[0-9]+(\.[0-9]+){3}$") & _octets(m), "sign": m.contains("@"), "spoken": m.rlike(r"(?i)[(\[\x20](at|dot)[)\]\x20]"),
        "name_end": F.length(F.regexp_extract(m, "([A-Za-z]*)$", 1)), "letters": count("[A-Za-z]"), "year": digits.rlike("^(19|20)[0-9]{2}"),
        "date": m.rlike(r"(^|[^0-9])(19|20)[0-9]{2}[-/.][01]?[0-9][-/.][0-3]?[0-9]([^0-9]|$)|(^|[^0-9])[0-3]?[0-9][-/.][0-3]?[0-9][-/.](19|20)?[0-9]{2}([^0-9]|$)"),
        "clock": m.rlike("^[0-2]?[0-9]:[0-5][0-9](:[0-5][0-9])?$"), "length": F.length(m), "joined_before": c["before"].rlike("[A-Za-z0-9.,#$€£_:/=-]$"),
        "joined_after": c["after"].rlike("^[A-Za-z0-9%€$£_:/=-]"),
    } | {k: c["before"].rlike(p) for k, p in CONTEXT.items()}
    return F.struct(*(values[k].cast("int").alias(k) for k in FEATURES))


CANDIDATE = "array<struct<generator:int,start:int,end:int,before:string,match:string,after:string>>"


def candidates(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """``df`` with ``prefix`` + "all": every generator's candidates with the text around them."""
    df = with_matches(df, text, PROPOSED, prefix)

    def framed(k: int, g: str) -> Column:
        spans = F.col(f"{prefix}{g}")
        if g == "number":
            spans = F.filter(spans, lambda s: F.length(_digits(s["match"])).between(7, 19))
        return F.transform(spans, lambda s: F.struct(F.lit(k).alias("generator"), s["start"].alias("start"), s["end"].alias("end"),
                                                     F.substring(F.col(text), F.greatest(s["start"] - BEFORE, F.lit(0)) + 1, F.least(s["start"], F.lit(BEFORE))).alias("before"),
                                                     s["match"].alias("match"), F.substring(F.col(text), s["end"] + 1, F.lit(AFTER)).alias("after")))

    every = F.concat(*(framed(k, g) for k, g in enumerate(GENERATORS)))
    return df.select(*(f"`{c}`" for c in df.columns if c not in [prefix + g for g in GENERATORS]), every.cast(CANDIDATE).alias(f"{prefix}all"))


@dataclass
class Trees:
    """Boosted trees over the features: each tree is a list of nodes (feature, bound, left, right) and leaves (value)."""

    start: float = 0.0
    trees: list = field(default_factory=list)
    scale: float = 1.0
    offset: float = 0.0
    thresholds: list = field(default_factory=lambda: [2.0] * len(GENERATORS))
    held_out: dict = field(default_factory=dict)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> "Trees":
        """Trees on four fifths of the rows; the logistic fit and the thresholds on the rest."""
        if len(set(y.tolist())) < 2:
            return self
        order = np.random.default_rng(seed).permutation(len(x))
        held, own = order[:len(x) // 5], order[len(x) // 5:]
        bounds = [np.unique(np.quantile(x[own, j], np.linspace(0, 1, BINS + 1)[:-1], method="lower")) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(b, x[:, j], side="left") for j, b in enumerate(bounds)], 1)
        p = y[own].mean()
        self.start = math.log(p / (1 - p))
        z = np.full(len(x), self.start)
        for _ in range(ROUNDS):
            chance = 1 / (1 + np.exp(-z[own]))
            tree: list = []
            self._grow(tree, binned, own, y[own] - chance, chance * (1 - chance), np.arange(len(own)), DEPTH, bounds)
            self.trees.append(tree)
            z += self._values(tree, x)
        zh, t = z[held], y[held]
        for _ in range(400):  # logistic fit of label on score, a little damped
            q = 1 / (1 + np.exp(-np.clip(self.scale * zh + self.offset, -30, 30)))
            self.scale -= 0.2 * (np.mean((q - t) * zh) + 1e-3 * self.scale)
            self.offset -= 0.2 * np.mean(q - t)
        chance = self.chance(x[held])
        for g in range(len(GENERATORS)):
            mine = x[held][:, 0] == g
            c, own_t = chance[mine], t[mine]
            by = np.argsort(-c, kind="stable")
            right = np.cumsum(own_t[by]) / np.arange(1, len(by) + 1)
            last = np.r_[np.diff(c[by]) != 0, True] if len(by) else np.zeros(0, bool)  # equal chances go together
            good = np.flatnonzero(last & (right >= PRECISION))
            self.thresholds[g] = max(0.5, float(c[by][good[-1]])) if len(good) else 2.0
            over = c >= self.thresholds[g]
            self.held_out[GENERATORS[g]] = (float(own_t[over].mean()) if over.any() else None, float(over[own_t == 1].mean()) if (own_t == 1).any() else None)
        return self

    def _grow(self, tree: list, binned: np.ndarray, own: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, bounds: list) -> int:
        """Adds the node for ``rows`` and those below it; its number."""
        at = len(tree)
        tree.append(None)
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None, None)
        for j in range(binned.shape[1]) if depth else ():
            b = binned[own[rows], j]
            size = len(bounds[j]) + 1
            gl, hl = np.cumsum(np.bincount(b, grad[rows], size))[:-1], np.cumsum(np.bincount(b, hess[rows], size))[:-1]
            gain = gl ** 2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g ** 2 / (h + 1)
            gain[(hl < 1) | (h - hl < 1)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        if best[1] is None:
            tree[at] = RATE * float(g / (h + 1))
            return at
        left = binned[own[rows], best[1]] <= best[2]
        tree[at] = (best[1], float(bounds[best[1]][best[2]]), self._grow(tree, binned, own, grad, hess, rows[left], depth - 1, bounds),
                    self._grow(tree, binned, own, grad, hess, rows[~left], depth - 1, bounds))
        return at

    def _values(self, tree: list, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))

        def down(at: int, rows: np.ndarray) -> None:
            if isinstance(tree[at], float):
                out[rows] = tree[at]
                return
            j, bound, left, right = tree[at]
            goes = x[rows, j] <= bound
            down(left, rows[goes])
            down(right, rows[~goes])

        down(0, np.arange(len(x)))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((self._values(t, x) for t in self.trees), np.zeros(len(x)))

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.score(x) + self.offset, -30, 30)))

    def expression(self, f: Column) -> Column:
        """The chance as a SQL expression over the features."""
        def node(tree: list, at: int) -> Column:
            if isinstance(tree[at], float):
                return F.lit(tree[at])
            j, bound, left, right = tree[at]
            return F.when(f[FEATURES[j]] <= F.lit(bound), node(tree, left)).otherwise(node(tree, right))

        z = F.aggregate(F.array(F.lit(self.start), *(node(t, 0) for t in self.trees)), F.lit(0.0), lambda a, b: a + b)
        z = F.greatest(F.least(z * self.scale + self.offset, F.lit(30.0)), F.lit(-30.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def drawn(sample: DataFrame, text: str) -> DataFrame:
    """(label, before, match, after, draw): spans drawn by rule, in places of the sample's texts."""
    d = F.lpad(F.abs(F.col("draw")).cast("string"), 19, "7")
    word = F.translate(F.md5(F.col("draw").cast("string")), "0123456789abcdef", "etaoinshrdlumkpy")
    name, host = F.substring(word, 1, 7), F.substring(word, 9, 8)
    hexes = F.md5(F.concat(F.lit("x"), F.col("draw").cast("string")))

    def part(at: int, n: int) -> Column:
        return F.substring(d, at, n)

    def checked(n: int) -> Column:
        """A number of n digits whose check digit is right."""
        return F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.concat(F.lit("4"), part(2, n - 2), k.cast("string"))), lambda s: F.call_function("luhn_check", s))[0]

    def pick(*words: str) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), F.pmod(F.crc32(d.cast("binary")), F.lit(len(words))).cast("int") + 1)

    year, month, day = F.concat(pick("19", "20"), part(3, 2)), F.lpad((F.pmod("draw", F.lit(12)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod("draw", F.lit(28)) + 1).cast("string"), 2, "0")
    phone, card = pick("Tel: ", "phone ", "call me on ", "mobile ", "Telefon: ", "tél. "), pick("card ", "Visa ", "credit card: ", "Karte: ")
    mail, other, none = pick("e-mail ", "contact ", "write to ", "", "mail: "), pick("page ", "version ", "order no ", "item ", "id "), F.lit("")
    card16, card15 = checked(16), checked(15)
    rows = [
        (1, mail, F.concat(name, F.lit(" (at) "), host, F.lit(" (dot) com"))), (1, mail, F.concat(name, F.lit("[at]"), host, F.lit("[dot]org"))),
        (1, mail, F.concat(name, F.lit(" at "), host, F.lit(" dot net"))), (1, mail, F.concat(name, F.lit("(at)"), host, F.lit(".de"))),
        (1, phone, F.concat(F.lit("(0"), part(3, 3), F.lit(") "), part(6, 3), F.lit("-"), part(9, 4))), (1, phone, F.concat_ws("-", part(2, 3), part(5, 3), part(8, 4))),
        (1, phone, F.concat(F.lit("0"), part(3, 3), F.lit(" "), part(6, 7))), (1, phone, F.concat_ws(".", part(2, 3), part(5, 3), part(8, 4))),
        (1, pick("", "Tel: ", "call ", "fax "), F.concat(F.lit("0049 "), part(3, 3), F.lit(" "), part(6, 7))), (1, phone, F.concat(F.lit("0"), part(3, 4), F.lit("/"), part(7, 6))),
        (1, card, F.concat_ws(".", F.substring(card16, 1, 4), F.substring(card16, 5, 4), F.substring(card16, 9, 4), F.substring(card16, 13, 4))),
        (1, card, F.concat_ws(" ", F.substring(card15, 1, 4), F.substring(card15, 5, 6), F.substring(card15, 11, 5))),
        (1, pick("", "ip ", "host "), F.concat_ws(":", *(F.substring(hexes, 1 + 4 * i, 4) for i in range(8)))), (1, pick("", "mac "), F.concat_ws(":", *(F.substring(hexes, 1 + 2 * i, 2) for i in range(6)))),
        (1, pick("SSN ", "social security: ", "ssn: "), F.concat_ws("-", part(2, 3), part(5, 2), part(7, 4))),
        (0, pick("on ", "", "since "), F.concat_ws("-", year, month, day)), (0, none, F.concat_ws(".", day, month, year)), (0, none, F.concat_ws("/", month, day, year)),
        (0, none, F.concat_ws(":", day, part(5, 2), part(7, 2))), (0, pick("", "at "), F.concat_ws(":", day, month, F.lit("00"))),
        (0, none, F.concat_ws(" ", part(2, 2), part(4, 3), part(7, 3))), (0, none, F.concat(F.concat_ws(".", part(2, 2), part(4, 3), part(7, 3)), F.lit(","), part(10, 2))),
        (0, pick("ISBN ", "isbn: "), F.concat_ws("-", F.lit("978"), part(2, 1), part(3, 2), part(5, 6), part(11, 1))), (0, pick("version ", "v", ""), F.concat_ws(".", part(2, 2), part(4, 2), part(6, 3), part(9, 4))),
        (0, none, F.concat_ws("-", year, F.concat(F.lit("20"), part(5, 2)))), (0, other, part(2, 12)), (0, other, part(1, 9)), (0, none, part(1, 16)), (0, none, part(3, 10)),
        (0, none, F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), part(3, 2), part(5, 2))), (0, other, F.concat_ws("-", part(2, 4), part(6, 4))), (0, none, F.concat_ws("/", part(2, 4), part(6, 4))),
        (0, none, F.concat_ws(" ", year, part(2, 4), part(6, 4))), (0, F.lit("look "), F.concat(name, F.lit(" at "), host, F.lit("."), F.substring(word, 17, 6))),
    ]
    column = F.array(*(F.struct(F.lit(label).alias("label"), lead.alias("lead"), span.alias("match")) for label, lead, span in rows))
    at = F.pmod(F.xxhash64("draw"), F.greatest(F.length(text) - 40, F.lit(1))).cast("int")
    frames = sample.withColumn("draw", F.explode(F.transform(F.sequence(F.lit(1), F.lit(max(1, DRAWN // SAMPLE))), lambda i: F.xxhash64(F.col(text), i))))
    around = frames.select("draw", F.substring(F.col(text), at, F.lit(20)).alias("left"), F.substring(F.col(text), at + 20, F.lit(20)).alias("right"), column.alias("rows"))
    one = around.select("draw", "left", "right", F.element_at("rows", (F.pmod("draw", F.lit(len(rows))) + 1).cast("int")).alias("r"))
    lead = F.concat(F.regexp_extract("left", r"^(.*\s|)", 1), "r.lead")
    tail = F.coalesce(F.regexp_extract("right", r"(\s.*)$", 1), F.lit(""))
    return one.select(F.col("r.label").alias("label"), F.concat(lead, "r.match", tail).alias("text"), F.length(lead).alias("from"), (F.length(lead) + F.length("r.match")).alias("to"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Trees:
    """Trees fitted on the bounded sample."""
    key = F.xxhash64(F.col(id_col).cast("string"))
    ids = [r[0] for r in docs.select(key.alias("k")).orderBy("k").limit(sample).collect()]
    if not ids:
        return Trees()
    texts = docs.where(key <= F.lit(max(ids))).where(F.length(text_col) > 0).select(F.col(text_col).alias("text"))
    found = candidates(base_spans(texts, "text", "_b_"), "text", "_c_")
    spans = F.concat(*(F.col(f"_b_{k}") for k in KINDS))
    found = found.select(F.explode("_c_all").alias("c"), spans.alias("spans")).select("c", F.exists("spans", lambda s: (s["start"] < F.col("c.end")) & (F.col("c.start") < s["end"])).cast("int").alias("label"))
    made = candidates(written(drawn(texts, "text"), "pii_drawn"), "text", "_c_").select("label", "from", "to", F.explode("_c_all").alias("c"))
    # of a drawn span the candidate that covers it; what a generator cuts otherwise is no example
    made = made.where((F.col("c.start") <= F.col("from")) & (F.col("c.end") >= F.col("to"))).select("c", "label")
    rows: list = []
    for part, most in ((found.where("label = 1"), ROWS), (found.where("label = 0"), ROWS), (made, DRAWN)):
        part = part.select("label", features(F.col("c")).alias("f")).select("label", "f.*")
        rows += part.orderBy(F.xxhash64(*part.columns), *part.columns).limit(most).collect()
    if not rows:
        return Trees()
    table = np.array([tuple(r) for r in rows], float)
    return Trees().fit(table[:, 1:], table[:, 0])


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


RESULT = "array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id as ``doc_id``, its text as ``text``, the patterns' ``base`` spans by kind, then start, and the
    ``learned`` ones by start, each an array (kind, start, end) in code points, end exclusive."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    df = candidates(base_spans(df, "text", "_b_"), "text", "_c_")
    base = F.concat(*(_named(k, F.col(f"_b_{k}")) for k in KINDS)).cast(RESULT)
    df = df.select("doc_id", "text", base.alias("base"), F.transform("_c_all", lambda c: F.struct(c["generator"].alias("generator"), c["start"].alias("start"), c["end"].alias("end"), features(c).alias("f"))).alias("all"))
    bound = F.array(*map(F.lit, trees.thresholds))
    if not trees.trees:
        return df.select("doc_id", "text", "base", F.array().cast(RESULT).alias("learned"))
    # (-chance, start, -end): the likeliest first
    rated = F.transform("all", lambda c: F.struct((-trees.expression(c["f"])).alias("rank"), c["start"].alias("start"), (-c["end"]).alias("back"), F.get(bound, c["generator"]).alias("bound")))
    df = df.select("doc_id", "text", "base", F.when(F.size("all") > 0, F.filter(rated, lambda c: -c["rank"] >= c["bound"])).alias("over"))
    free = F.filter("over", lambda c: ~F.exists("base", lambda s: (s["start"] < -c["back"]) & (c["start"] < s["end"])))
    df = df.select("doc_id", "text", "base", F.when(F.size("over") > 0, F.array_sort(free)).alias("over"))
    chosen = F.aggregate("over", F.array().cast("array<struct<start:int,end:int>>"), lambda acc, c: F.when(
        F.exists(acc, lambda s: (s["start"] < -c["back"]) & (c["start"] < s["end"])), acc).otherwise(F.concat(acc, F.array(F.struct(c["start"].alias("start"), (-c["back"]).alias("end"))))))
    learned = _named("learned", F.array_sort(chosen)).cast(RESULT)
    return df.select("doc_id", "text", "base", F.coalesce(F.when(F.size("over") > 0, learned), F.array().cast(RESULT)).alias("learned"))


def redacted(found: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of what ``scan`` returns, each stretch of spans replaced by its first span's kind in brackets."""
    spans = F.array_sort(F.transform(F.concat("base", "learned"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def add(acc: Column, s: Column) -> Column:
        overlaps = s["start"] < acc["end"]
        more = F.concat(acc["out"], F.substring(F.col("text"), acc["end"] + 1, s["start"] - acc["end"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(overlaps, acc["out"]).otherwise(more).alias("out"), F.greatest(acc["end"], s["end"]).alias("end"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("end"))
    text = F.aggregate("spans", start, add, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["end"] + 1, F.length("text"))))
    return found.select("doc_id", "text", spans.alias("spans")).select("doc_id", F.when(F.size("spans") > 0, text).otherwise(F.col("text")).alias("text"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from what ``scan`` returns, and the number of learned spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _joined(F.concat("base", "learned")).alias("spans"), F.size("learned").cast("long").alias("n_learned"))
