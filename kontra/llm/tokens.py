"""Operator 2: exact byte-BPE token counts at every prefix by dynamic programming."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontra.llm import textkit as tk

#: White space as the pre-tokeniser's engine has it (Unicode White_Space; no U+001C to U+001F).
_WS = r"\t\n\v\f\r \x85\xa0  -     　"
_SPACE = regex.compile(rf"[{_WS}]+")
#: Up to U+024F the pattern is spelled out for the faster engine; beyond it the library splits.
_BEYOND = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")


def _category(first: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == first)


_L, _N, _S = _category("L"), _category("N"), r"\t\n\v\f\r \x85\xa0"
PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: A blank inside or at the end of a run of white space; before any other blank a piece ends.
_INNER = re.compile(rf"[{_S}] (?=[{_S}]|\Z)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


#: What an entry of a table counts beside its characters, and the characters and entries that a table's share stands for.
ENTRY, CHARACTERS = 16, 24


class Counts(dict):
    """Tokens of a word with a blank before it, kept for words seen of late."""

    def __init__(self, model: Prefixes, most: int):
        self.model, self.most, self.held = model, most, 0

    def __missing__(self, word: str) -> int:
        # words are bounded by their characters, so that long ones can't fill the worker
        if self.held > CHARACTERS * self.most:
            self.clear()
            self.held = 0
        self.held += ENTRY + len(word)
        n = self[word] = self.model.plain(" " + word)
        return n


class Prefixes:
    """Token counts of a byte-level BPE vocabulary, for all prefixes of a text at once.

    For the prefix of each length the table keeps the last token of its encoding.  A
    token t that ends at i is the last one exactly if it may follow the last token of
    the prefix before it, that is if the two, joined and encoded alone, stay the same
    two tokens; one t does, and count[i] = count[i - len(t)] + 1.
    """

    def __init__(self, path: str | None = None, kept: int = 500_000):
        from tokenizers import Tokenizer

        self.path = path or default_path()
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(self.path)
        symbols = byte_symbols()
        to_bytes = lambda s: bytes(symbols[c] for c in s)
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y = to_bytes(a), to_bytes(b)
            self.rank[x, y] = i
            self.made.setdefault(x + y, (i, x, y))
        special = {t["content"] for t in spec["added_tokens"]}
        self.token = sorted(to_bytes(s) for s in spec["model"]["vocab"] if s not in special)
        self.vocab = {t: i for i, t in enumerate(self.token)}
        #: lengths of the tokens that end in three given bytes, longest first; any bytes may end one of two or one
        ends: dict[bytes, set[int]] = {}
        for t in self.token:
            if len(t) > 2:
                ends.setdefault(t[-3:], {1, 2}).add(len(t))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self.special = sorted(special, key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if special else None
        self.pairs: dict[int, bool] = {}
        self.tables: dict[str, bytes | tuple[int, ...]] = {}
        self.kept, self.held = kept, 0
        self.after_blank = Counts(self, 2 * kept)

    def follows(self, a: bytes, b: bytes) -> bool:
        """Whether a and b, joined and encoded alone, stay these two tokens.

        Merges are undone from the last one back.  While x ends the left side and y
        begins the right one, a merge of the two would come first if its rank is below
        that of the merge that ends this state; of equal ranks the left one is first.
        """
        rank, made = self.rank.get, self.made.get
        limit = len(self.rank)
        while True:
            r = rank((a, b))
            if r is not None and r < limit:
                return False
            x, y = made(a), made(b)
            if x is None and y is None:
                return True
            if y is None or (x is not None and x[0] > y[0]):
                limit, a = x[0], x[2]
            else:
                limit, b = y[0] + 1, y[1]

    def table(self, piece: str) -> bytes | tuple[int, ...]:
        """Tokens of every prefix, by characters, of one piece of the pre-tokeniser (entry 0 is for one character)."""
        got = self.tables.get(piece)
        if got is not None:
            return got
        raw = piece.encode("utf-8")
        n = len(raw)
        last, count = [0] * (n + 1), [0] * (n + 1)
        vocab, pairs, lengths = self.vocab.get, self.pairs.get, self.lengths.get
        for i in range(1, n + 1):
            for size in lengths(raw[i - 3 : i], (2, 1)) if i > 2 else (2, 1):
                j = i - size
                if j < 0:
                    continue
                t = vocab(raw[j:i])
                if t is None:
                    continue
                if j:
                    pair = last[j] << 20 | t
                    ok = pairs(pair)
                    if ok is None:
                        if len(self.pairs) > 2 * self.kept:
                            self.pairs.clear()
                        ok = self.pairs[pair] = self.follows(self.token[last[j]], self.token[t])
                    if not ok:
                        continue
                last[i], count[i] = t, count[j] + 1
                break
        if n == len(piece):
            out = count[1:]
        else:
            out = [count[i] for i in range(1, n + 1) if i == n or raw[i] & 0xC0 != 0x80]
        if piece in ("'re", "'ve", "'ll"):
            # cut inside, the mark and the letter are pieces of their own
            out[1] = self.table(piece[0])[0] + self.table(piece[1])[0]
        got = bytes(out) if max(out) < 256 else tuple(out)
        if self.held > CHARACTERS * self.kept:
            self.tables.clear()
            self.held = 0
        self.held += ENTRY + len(piece)
        self.tables[piece] = got
        return got

    def pieces(self, text: str) -> list[str]:
        """The pre-tokeniser's pieces: a contraction, or letters, digits or marks with the blank before them, or white space."""
        if _BEYOND.search(text) is None:
            return PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """(stretch, whether it is a special token) in order."""
        if self.split is None or not any(s in text for s in self.special):
            return [(text, False)] if text else []
        out, at = [], 0
        for m in self.split.finditer(text):
            if m.start() > at:
                out.append((text[at : m.start()], False))
            out.append((m[0], True))
            at = m.end()
        return out + ([(text[at:], False)] if at < len(text) else [])

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        total = 0
        for part, special in self.parts(text):
            if special:
                total += 1
                continue
            if _INNER.search(part) is None and _BEYOND.search(part) is None:
                first, *rest = part.split(" ")
                total += self.plain(first) + sum(map(self.after_blank.__getitem__, rest))
            else:
                total += self.plain(part)
        return total

    def plain(self, text: str) -> int:
        """Tokens of a text without special tokens, piece by piece."""
        known = self.tables.get
        return sum([(known(p) or self.table(p))[-1] for p in self.pieces(text)])

    def ordinary(self, text: str) -> np.ndarray:
        """Tokens of text[:c] for c = 1, 2, ..., for a text without special tokens."""
        out, base = [], 0
        for p in self.pieces(text):
            t = self.table(p)
            out.extend(base + x for x in t)
            base += t[-1]
        counts = np.array(out, dtype=np.int64)
        # a prefix that ends in a run of white space has that run as one piece
        for m in _SPACE.finditer(text):
            if m.end() - m.start() > 1:
                before = counts[m.start() - 1] if m.start() else 0
                counts[m.start() : m.end()] = before + np.array(list(self.table(m[0])))
        return counts

    def every(self, text: str) -> np.ndarray:
        """Tokens of text[:c] for c = 0, 1, ..., len(text), each as the library counts that prefix."""
        out, base, open_part = [np.zeros(1, np.int64)], 0, ""
        for part, special in self.parts(text):
            if special:
                # cut inside a special token, its beginning is ordinary text that goes on from the part before
                joined = self.ordinary(open_part + part[:-1])[len(open_part) :]
                start = base - (self.count(open_part) if open_part else 0)
                out.append(np.append(start + joined, base + 1))
                base, open_part = base + 1, ""
            else:
                got = self.ordinary(part)
                out.append(base + got)
                base, open_part = base + self.count(part), part
        return np.concatenate(out)

    def fits(self, text: str, limit: int) -> int:
        """Characters of the longest prefix of at most ``limit`` tokens."""
        if self.split is not None and self.split.search(text):
            return int(np.flatnonzero(self.every(text) <= limit)[-1])
        # skip whole pieces, then look at the prefixes around the place where the count passes the limit
        base, at, back = 0, 0, [(0, 0)]
        for p in self.pieces(text):
            if base > limit:
                break
            back.append((at, base))
            base, at = base + self.table(p)[-1], at + len(p)
        a, b = back[max(0, len(back) - 4)]
        while a and text[a - 1].isspace():
            i = back.index((a, b))
            a, b = back[i - 1]
        counts = b + self.ordinary(text[a:at])
        ok = np.flatnonzero(counts <= limit)
        return a + int(ok[-1]) + 1 if len(ok) else a


@cache
def _shared(path: str | None) -> Prefixes:
    """One model for all tasks of a Python worker, so that its tables serve them all."""
    return Prefixes(path)


def token_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = 1024, path: str | None = None, prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars of every document, and ``prefix_tokens`` if asked for.

    Counts are those of the tokenizers library for the vocabulary file: no begin or end
    tokens, special strings inside texts are special tokens, nothing truncated.
    ``fit_chars`` is the length in characters of the longest prefix of at most ``limit``
    tokens; ``prefix_tokens[c]`` is the count of the first c characters, so that any
    truncation or budget is answered by a lookup.  Null counts as empty: 0 bytes and
    tokens.  Repeated rows are counted alike, a null doc_id is passed on, and further
    columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _shared(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = [model.count(t) for t in texts]
                fit = [len(t) if c <= limit else model.fits(t, limit) for t, c in zip(texts, n, strict=True)]
                columns = [part.column(0), pa.array(np.diff(tk.buffers(part.column(1))[1])), pa.array(n, pa.int64()), pa.array([c > limit for c in n]), pa.array(fit, pa.int64())]
                names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"]
                if prefixes:
                    columns.append(pa.array([model.every(t) for t in texts], pa.list_(pa.int64())))
                    names.append("prefix_tokens")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint" + ", prefix_tokens array<bigint>" * prefixes
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, schema)


def op2_query(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
