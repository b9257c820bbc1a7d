"""Token counts of every prefix of a text, for a byte-level BPE.

The encoding of a string ends in exactly one token t such that t fits the last token of the encoding of what stands before it
(the pair encodes to itself). So the counts of all prefixes follow from each other: count(p) = count(p without t) + 1,
with the last token kept beside the count. The dynamic program runs inside pre-tokens; prefixes of different pre-tokens
share their states, and a task keeps the results of the words it has met.

The counts of a text are stored as one signed byte per code point: the change of the count when that code point is added.
A running sum gives the exact token count of each prefix, and so truncation and budget answers without encoding again.

Null text counts as empty. Special strings inside a text become one token when they are complete, as the library does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from barloom.llm.common import arrow_rows

#: white space as the tokenizer library sees it (Unicode White_Space)
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
CHUNK = regex.compile(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
SPACE = regex.compile(rf"[{WHITE}]*")
SHORT = 48
#: entries a task keeps at most: words met, prefix states, pairs of tokens
WORDS = 800_000
STATES = 400_000
_counters: dict[str, "PrefixCounter"] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PrefixCounter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenize = library.model.tokenize
        self.vocabulary = frozenset(spec["model"]["vocab"])
        self.reach: dict[str, int] = {}  # longest token that ends in these three letters
        for token in self.vocabulary:
            if len(token) > 2:
                self.reach[token[-3:]] = max(len(token), self.reach.get(token[-3:], 0))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        letters = byte_letters()
        self.letters = {chr(i): "".join(letters[b] for b in chr(i).encode()) for i in range(256)}
        self.table = letters
        self.fit: dict[tuple[str, str], bool] = {}
        self.states: dict[str, tuple[str, int]] = {"": ("", 0)}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def fits(self, before: str, token: str) -> bool:
        key = (before, token)
        known = self.fit.get(key)
        if known is None:
            got = [t.value for t in self.tokenize(before + token)]
            known = self.fit[key] = got == ([before, token] if before else [token])
            if len(self.fit) > STATES:
                self.fit.clear()
        return known

    def inside(self, letters: str) -> list[int]:
        """Counts of the prefixes of length 1, 2, ... of one pre-token given as byte letters."""
        vocabulary, fit, fits, n, reach = self.vocabulary, self.fit, self.fits, len(letters), self.reach.get
        states, lasts, counts, end = self.states, [""], [0], 0
        if n <= SHORT:
            while end < n and (state := states.get(letters[:end + 1])) is not None:
                lasts.append(state[0])
                counts.append(state[1])
                end += 1
        store = n <= SHORT and len(states) < STATES
        while end < n:
            end += 1
            for start in range(max(0, end - reach(letters[end - 3:end], 2)) if end > 2 else 0, end):
                token = letters[start:end]
                if token in vocabulary:
                    known = fit.get((lasts[start], token))
                    if known or known is None and fits(lasts[start], token):
                        lasts.append(token)
                        counts.append(counts[start] + 1)
                        break
            if store:
                states[letters[:end]] = (token, counts[end])
        del counts[0]
        return counts

    def spelled(self, text: str) -> tuple[str, list[int] | None]:
        """Byte letters of a text, and the number of letters up to each code point (None: one each)."""
        if text.isascii():
            if text.isprintable():
                return text.replace(" ", self.table[32]), None
            return "".join([self.table[ord(c)] for c in text]), None
        known = self.letters
        parts = [known.get(c) or self._letters(c) for c in text]
        at, ends = 0, []
        for p in parts:
            at += len(p)
            ends.append(at)
        return "".join(parts), ends

    def _letters(self, c: str) -> str:
        got = self.letters[c] = "".join(self.table[b] for b in c.encode("utf-8", "surrogatepass"))
        return got

    def counts(self, text: str) -> list[int] | bytes:
        """Counts of the prefixes of one pre-token. Many words differ in punctuation alone, so short ones are kept (their counts fit a byte)."""
        known = self.pieces.get(text)
        if known is None:
            letters, ends = self.spelled(text)
            known = self.inside(letters)
            if ends is not None:
                known = [known[e - 1] for e in ends]
            if len(text) <= SHORT and len(self.pieces) < STATES:
                known = self.pieces[text] = bytes(known)
        return known

    def chunk(self, text: str) -> bytes:
        """Changes of the count inside white space followed by other characters."""
        if text.isalpha() or text[0] == " " and text[1:].isalpha():  # one pre-token
            out = self.counts(text)
        else:
            out = []
            blank = SPACE.match(text).end()
            if blank:  # a prefix that ends in the white space has it as one pre-token
                out += self.counts(text[:blank])
            base = 0
            for m in PIECE.finditer(text) if blank < len(text) else ():
                piece = m.group()
                counts = self.counts(piece)
                if m.end() > blank:
                    own = [base + c for c in counts]
                    if len(piece) == 3 and piece[0] == "'" and piece[1:].isalpha():  # cut short, 're is a mark and a letter
                        own[1] = base + counts[0] + self.counts(piece[1])[0]
                    out += own[max(0, blank - m.start()):]
                base += counts[-1]
        return bytes([(b - a) & 255 for a, b in zip([0, *out], out)])

    def changes(self, text: str) -> bytes:
        """Change of the token count with each code point, as signed bytes."""
        parts, at = [], 0
        if self.split is not None:
            for m in self.split.finditer(text):
                before = np.frombuffer(self.ordinary(text[at:m.end() - 1]), np.int8)
                parts.append(before.tobytes())
                parts.append(np.int8(1 - int(before[m.start() - at:].sum())).tobytes())
                at = m.end()
        parts.append(self.ordinary(text[at:]))
        return b"".join(parts)

    def ordinary(self, text: str) -> bytes:
        words, parts = self.words, []
        for piece in CHUNK.findall(text):
            known = words.get(piece)
            if known is None:
                known = self.chunk(piece)
                if len(piece) <= SHORT and len(words) < WORDS:
                    words[piece] = known
            parts.append(known)
        return b"".join(parts)


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def tokens_of_prefix(changes: bytes, length: int) -> int:
    """Tokens of the first ``length`` code points."""
    return int(np.frombuffer(changes, np.int8)[:length].sum())


def longest_prefix(changes: bytes, budget: int) -> int:
    """Code points of the longest prefix with at most ``budget`` tokens."""
    fit = np.flatnonzero(np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64) <= budget)
    return int(fit[-1]) + 1 if len(fit) else 0


PREFIXES = "n_bytes long, n_tokens long, changes binary"


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens and the changes of the count by code point. No exchange."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part, rows = batch.slice(lo, 500), []
                for text in part.column("text").to_pylist():
                    text = text or ""
                    changes = own.changes(text)
                    rows.append((len(text.encode("utf-8", "surrogatepass")), int(np.frombuffer(changes, np.int8).sum(dtype=np.int64)), changes))
                got = arrow_rows(PREFIXES, rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *got.columns], names=["doc_id", *got.schema.names])

    return docs.select("doc_id", "text").mapInArrow(count, T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(PREFIXES).fields]))


def within_budget(prefixes: DataFrame, budget: int) -> DataFrame:
    """Adds over_limit and fit_chars, the code points of the longest prefix within the budget, from stored counts alone."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = [len(c) if n <= budget else longest_prefix(c, budget)  # the whole text is its own longest prefix where it fits
                   for c, n in zip(batch.column("changes").to_pylist(), batch.column("n_tokens").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("doc_id", "n_bytes", "n_tokens")], pa.array(fit, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens", "fit_chars"])

    kind = T.StructType([prefixes.schema["doc_id"], *T._parse_datatype_string("n_bytes long, n_tokens long, fit_chars long").fields])
    return prefixes.mapInArrow(cut, kind).withColumn("over_limit", F.col("n_tokens") > budget)
