"""BPE encoding over a trie of distinct words, and decoding.

A batch's texts are cut at single spaces into chunks, which no token of the tokenizer's word
pattern crosses; chunks not met before are cut into words by that pattern, and the distinct new
words go into a trie of bytes. A depth-first walk gives each prefix its state: the last token of
the prefix's encoding. That token is the one, among the tokens that end the prefix, that merges
would leave standing beside the last token of the prefix before it. So the encoding of a prefix is
computed once for all words that share it; a word's ids are read off by stepping back from its end.

Nulls and odd rows: a null text is encoded as an empty one: no ids, and it decodes to "". Any length
of text and of word is encoded whole. Repeated rows give repeated results; further columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.llm.common import ship_file, slices

#: The public word pattern of byte-level BPE vocabularies (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks that a worker remembers; characters of the parts in which longer texts are encoded.
CHUNKS, PART = 300_000, 1 << 20


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable characters: those that are print as
    themselves, the others as the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes and decodes by one vocabulary file of the ``tokenizers`` JSON kind."""

    def __init__(self, text: str):
        import regex

        spec = json.loads(text)
        of = byte_of_char()

        def raw(token: str) -> bytes:
            return bytes(of[c] for c in token)

        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in of for c in t)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        special_bytes = {s.encode() for s in self.special}
        self.bytes_of = {i: b for b, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.rank = {(vocab[raw(a)], vocab[raw(b)]): (r, vocab[raw(a) + raw(b)]) for r, (a, b) in enumerate(merges)}
        self.made_of = {t: (r, a, b) for (a, b), (r, t) in self.rank.items()}  # how each token is made
        made = {t for _, t in self.rank.values()} | {i for b, i in vocab.items() if len(b) == 1}
        self.vocab = {b: i for b, i in vocab.items() if i in made and b not in special_bytes}
        self.single = [self.vocab.get(bytes([b])) for b in range(256)]
        # trie of the tokens read backwards, to find those that end a prefix; -1 holds the id
        self.back: dict = {}
        for b, i in self.vocab.items():
            node = self.back
            for x in reversed(b):
                node = node.setdefault(x, {})
            node[-1] = i
        self.beside: dict[tuple[int, int], bool] = {}
        self.word = regex.compile(PATTERN).findall
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # a space inside a run of white space is no safe place to cut
        self.unsafe = regex.compile(r"\s (?:\s|$)").search
        self.gap = regex.compile(r"(?<=\S) (?=\S)").search
        # (number of ids, ids, decoded bytes) of chunks that stand alone, and of those after a space
        self.plain: dict[str, tuple[int, str, bytes]] = {}
        self.spaced: dict[str, tuple[int, str, bytes]] = {}

    def merged(self, ids: list[int]) -> list[int]:
        """Apply merges, lowest rank and leftmost first."""
        ids = list(ids)
        while len(ids) > 1:
            best = min(((self.rank.get(p, (1 << 60,))[0], i) for i, p in enumerate(zip(ids, ids[1:]))), default=None)
            if best is None or best[0] == 1 << 60:
                break
            i = best[1]
            ids[i:i + 2] = [self.rank[ids[i], ids[i + 1]][1]]
        return ids

    def stand(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a, b of their joined bytes as they are.

        Run backwards: undo the later of the merges that made the two tokens at the border, again
        and again; the border holds unless its pair would have merged before what was undone.
        """
        found = self.beside.get((a, b))
        if found is None:
            if len(self.beside) > 300_000:
                self.beside.clear()
            rank, made_of = self.rank, self.made_of
            left, right, limit, found = a, b, 1 << 60, True
            while True:
                pair = rank.get((left, right))
                if pair is not None and pair[0] < limit:
                    found = False
                    break
                x, y = made_of.get(left), made_of.get(right)
                if x is None and y is None:
                    break
                # of equal merges the leftmost comes first, so one on the left wins a tie
                if y is None or (x is not None and x[0] > y[0]):
                    limit, left = x[0], x[2]
                else:
                    limit, right = y[0] + 1, y[1]
            self.beside[a, b] = found
        return found

    def whole(self, t: int) -> bool:
        """Whether the merges of a token's bytes reach the token."""
        found = self.beside.get((-1, t))
        if found is None:
            found = self.beside[-1, t] = self.merged([self.single[x] for x in self.bytes_of[t]]) == [t]
        return found

    def encode_words(self, words) -> dict[bytes, list[int]]:
        """Ids of each distinct word, by one depth-first walk over their trie.

        The trie is held as the sorted words, each with the length of the prefix that it shares
        with the word before: going to the next word backs up to that depth and descends from
        there, so each node of the trie is met once.
        """
        out: dict[bytes, list[int]] = {}
        back, beside, stand = self.back, self.beside, self.stand
        last, size = [-1], [0]  # of each prefix on the path: its last token, and that token's length
        before = b""
        for w in sorted(words):
            depth, end = 0, len(w)
            for x, y in zip(w, before):
                if x != y:
                    break
                depth += 1
            before = w
            del last[depth + 1:], size[depth + 1:]
            while depth < end:
                depth += 1
                # tokens that end here, by their starts, shortest first
                node, i, ends = back, depth, []
                while i:
                    i -= 1
                    node = node.get(w[i])
                    if node is None:
                        break
                    if -1 in node:
                        ends.append((node[-1], i))
                for t, i in reversed(ends):
                    if i:
                        ok = beside.get((last[i], t))
                        if ok is None:
                            ok = stand(last[i], t)
                    else:
                        ok = self.whole(t)
                    if ok:
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                last.append(t)
                size.append(depth - i)
            ids = []
            while end:
                ids.append(last[end])
                end -= size[end]
            ids.reverse()
            out[w] = ids
        return out

    def chunks(self, text: str) -> tuple[list[str], list[str]]:
        """Pieces of a text between which no word of the pattern lies: those that stand as they
        are, then those that follow a space."""
        if " " not in text:
            return [text], []
        if self.unsafe(text):
            return self.word(text), []
        first, *rest = text.split(" ")
        return [first] if first else [], rest

    def parts(self, text: str) -> Iterator[str]:
        """A text in parts of bounded length, cut between words; special tokens apart."""
        cuts = self.split_special.split(text) if any(s in text for s in self.special) else [text]
        for part in cuts:
            at = 0
            while len(part) - at > PART:
                m = self.gap(part, at + PART)
                if m is None:
                    break
                yield part[at:m.start()]
                at = m.start()
            if at < len(part):
                yield part[at:] if at else part

    def learn(self, plain: set[str], spaced: set[str]) -> None:
        """Make these chunks known; of earlier ones, only these stay where there are too many."""
        new = [(self.plain, c, c) for c in plain if c not in self.plain]
        new += [(self.spaced, c, " " + c) for c in spaced if c not in self.spaced]
        if not new:
            return
        if len(self.plain) + len(self.spaced) + len(new) > CHUNKS:
            for known, keep in ((self.plain, plain), (self.spaced, spaced)):
                stay = {c: known[c] for c in keep if c in known}
                known.clear()
                known.update(stay)
        cut = [(known, c, [w.encode() for w in self.word(text)]) for known, c, text in new]
        ids = self.encode_words({w for _, _, ws in cut for w in ws})
        of = self.bytes_of
        for known, c, ws in cut:
            got = ids[ws[0]] if len(ws) == 1 else [t for w in ws for t in ids[w]]
            known[c] = (len(got), ",".join(map(str, got)), b"".join([of[t] for t in got]))

    def batch(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """(number of ids, ids joined by commas, decoded bytes) of each text.

        The distinct chunks of a batch go into one trie; texts over ``PART`` go part by part.
        """
        cut: list = [None] * len(texts)
        plain: set[str] = set()
        spaced: set[str] = set()
        for i, t in enumerate(texts):
            if len(t) <= PART:
                cut[i] = [(p, None if p in self.special else self.chunks(p)) for p in self.parts(t)]
                for _, c in cut[i]:
                    if c:
                        plain.update(c[0])
                        spaced.update(c[1])
        self.learn(plain, spaced)
        for i, t in enumerate(texts):
            n, ids, raw = 0, [], []
            for p, c in cut[i] if cut[i] is not None else ((p, None) for p in self.parts(t)):
                if p in self.special:
                    got = [(1, str(self.special[p]), p.encode())]
                else:
                    if c is None:
                        c = self.chunks(p)
                        self.learn(set(c[0]), set(c[1]))
                    got = [*map(self.plain.__getitem__, c[0]), *map(self.spaced.__getitem__, c[1])]
                k, x, y = zip(*got)
                n += sum(k)
                ids += x
                raw += y
            if cut[i] is None:
                self.learn(plain, spaced)
            yield n, ",".join(ids), b"".join(raw)

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, s, _ in self.batch([text]) for i in s.split(",") if s]

    def decode(self, ids) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The worker's encoder for a shipped vocabulary file."""
    if name not in _ENCODERS:
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), encoding="utf-8") as f:
            _ENCODERS[name] = Encoder(f.read())
    return _ENCODERS[name]


def ship_vocabulary(spark: SparkSession, path: str) -> str:
    with open(path, "rb") as f:
        return ship_file(spark, f.read(), "vocabulary", ".json")


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
           ids: bool = True, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every text; with ``digests`` their sha256 in their place.

    ``vocabulary`` is the path of a byte-level BPE file in the JSON of the tokenizers library.
    """
    name = ship_vocabulary(docs.sparkSession, vocabulary)
    fields = [f"doc_id {docs.schema[id_col].dataType.simpleString()}", "n_tokens long"]
    if ids:
        fields += ["ids array<int>", "decoded string"]
    if digests:
        fields += ["ids_sha256 string", "decoded_sha256 string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name)
        gc.disable()  # the worker's tables hold no cycles, and walking them costs a third of the time
        for b in slices(batches, "text", 8 << 20):
            texts = [t or "" for t in b.column("text").to_pylist()]
            rows = []
            for n, joined, raw in enc.batch(texts):
                decoded = raw.decode("utf-8", "replace")
                row = [n]
                if ids:
                    row += [np.fromstring(joined, np.int32, sep=",") if n else np.empty(0, np.int32), decoded]
                if digests:
                    row += [hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                rows.append(row)
            kinds = [pa.int64()] + [pa.list_(pa.int32()), pa.string()] * ids + [pa.string()] * 2 * digests
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                                             names=[f.split()[0] for f in fields])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join(fields))
