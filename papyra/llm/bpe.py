"""Byte-level BPE by a pair occurrence index, with vocabularies of the tokenizers library.

The distinct pieces (what the split pattern finds) of a partition's blocks lie side by side as symbols in linked lists. An index
maps each adjacent pair that has a rank to all its positions. Ranks are applied in ascending order: all positions of
the pair merge at once, and the pairs that come about with the left and right neighbours enter the index. A pair made
of a merged symbol has a higher rank than the merge that made the symbol, so one ascending pass gives what the
merge-by-merge encoding of each piece gives.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import add_columns_by, free_names

#: The split pattern of byte-level vocabularies. Fixed value: it has to equal the library's.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks that an encoder remembers (about 200 bytes each) within a task and between tasks, and the longest of them.
KEPT, RESTING, KEPT_CHARS = 300_000, 100_000, 48
#: Characters of a long text that are chunks at one time.
LONG = 1_000_000
_AWKWARD = re.compile(r" (?:\s|$)")
_CHUNK = re.compile(r"(?= \S)")


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable ones stand for themselves, the others for 256 and up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encodes and decodes as the library does without special tokens added; those written in a text count as themselves."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        model, letters = data["model"], byte_letters()
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        self.bytes = [b""] * (1 + max([*self.vocab.values(), *self.added.values()]))
        for token, i in self.vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order
        self.left, self.right = pairs >> 32, pairs & 0xFFFFFFFF
        self.into = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        self.start = np.array([self.vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; -1 for those without."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers, all pieces at once."""
        if not pieces:
            return []
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes + 1)  # a wall of -1 after each piece
        n = int(ends[-1])
        ids = np.full(n, -1, np.int64)
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        ids[inside] = self.start[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Puts the pairs that begin at these positions into the index."""
            if not len(at):
                return
            left, right = ids[at], ids[after[at]]
            ok = (left >= 0) & (right >= 0)
            at = at[ok]
            r = self.rank(left[ok], right[ok])
            ok = r >= 0
            at, r = at[ok], r[ok]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = [0, *(np.flatnonzero(np.diff(r)) + 1).tolist(), len(r)]
            for k, a, b in zip(r[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
                if k in index:
                    index[k].append(at[a:b])
                else:
                    index[k] = [at[a:b]]
                    heapq.heappush(active, k)

        enter(np.arange(n - 1))
        while active:
            k = heapq.heappop(active)
            found = index.pop(k)
            left, right, new = int(self.left[k]), int(self.right[k]), int(self.into[k])
            at = np.sort(np.concatenate(found) if len(found) > 1 else found[0])
            at = at[(ids[at] == left) & (ids[np.minimum(after[at], n - 1)] == right)]
            if not len(at):
                continue
            if len(at) > 1 and not (new_at := np.diff(at) > 0).all():  # entered twice
                at = at[np.concatenate(([True], new_at))]
            if left == right and len(at) > 1:  # of overlapping places every second, from the left
                near = np.r_[False, after[at[:-1]] == at[1:]]
                begin = np.flatnonzero(~near)
                at = at[(np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))) % 2 == 0]
            gone = after[at]
            ids[at], ids[gone] = new, -2
            then = after[gone]
            after[at] = then
            before[then[then < n]] = at[then < n]
            prior = before[at]
            enter(np.concatenate((prior[prior >= 0], at)))
        keep = ids >= 0
        out = ids[keep].astype("<u4").tobytes()
        stops = (4 * np.cumsum(keep)[ends - 1]).tolist()
        return [out[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def rest(self) -> None:
        """Forgets all chunks but those that came first, which are the common ones."""
        if len(self.known) > RESTING:
            self.known = dict(islice(self.known.items(), RESTING))

    def learn(self, new: set[str], heads: set[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Ids, as little-endian 32-bit integers, of chunks that aren't known, and of heads. A known chunk that is a piece of them isn't merged again."""
        known, find = self.known, self.split.findall
        cut = {c: [" " + c] if c.isalpha() else find(" " + c) for c in new}  # letters alone are one piece
        whole = {c: find(c) for c in heads}
        pieces = set().union(*cut.values(), *whole.values())
        held = {p: known[p[1:]] for p in pieces if p[0] == " " and p[1:] in known}
        rest = list(pieces.difference(held))
        ids = dict(zip(rest, self.merge([p.encode() for p in rest]), strict=True)) | held
        joined = lambda x: ids[x[0]] if len(x) == 1 else b"".join(map(ids.__getitem__, x))
        return {c: joined(x) for c, x in cut.items()}, {c: joined(x) for c, x in whole.items()}

    def chunks(self, text: str) -> list[str]:
        """The text cut before each blank that a character other than white space follows: the head, then chunks without their blanks.

        The pattern always begins a piece there, so chunks can be split into pieces one by one.
        """
        if _AWKWARD.search(text):
            first, *rest = _CHUNK.split(text)
            return [first, *(c[1:] for c in rest)]
        return text.split(" ")

    def segments(self, text: str) -> Iterator[str]:
        """A long text cut where chunks begin, after each LONG characters; added tokens with blanks forbid cuts."""
        at = 0
        while len(text) - at > LONG and not any(" " in x for x in self.added) and (cut := _CHUNK.search(text, at + LONG)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if any(len(t) > LONG for t in texts):
            return [b"".join(y for s in self.segments(t) for y in self.encode_short([s])) for t in texts]
        return self.encode_short(texts)

    def encode_short(self, texts: list[str]) -> list[bytes]:
        """encode() for texts that may be chunks and symbols in memory all at once."""
        own = {c: np.array([i], "<u4").tobytes() for c, i in self.added.items()}
        cut: list[list[list[str]]] = []  # of each text its parts; every second is an added token
        for t in texts:
            parts = self.special.split(t) if self.special and any(x in t for x in self.added) else [t]
            cut.append([[p] if k % 2 else self.chunks(p) for k, p in enumerate(parts)])
        plain = [c for x in cut for c in x[::2]]
        heads = {c[0] for c in plain}
        every = set().union(*(c[1:] for c in plain))
        if len(self.known) > KEPT:
            self.rest()
        known = self.known
        new, first = self.learn(every.difference(known), heads)
        known.update(new)
        get = known.__getitem__
        out = [b"".join([y for k, c in enumerate(x) for y in ((own[c[0]],) if k % 2 else (first[c[0]], *map(get, c[1:])))]) for x in cut]
        for c in new:
            if len(c) > KEPT_CHARS:
                del known[c]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class Loaded:
    """One vocabulary a Python worker, which serves its later tasks; most of what a task has learned of chunks goes at its end."""

    held: dict[str, Bpe] = {}

    @classmethod
    def get(cls, value: str) -> Bpe:
        key = hashlib.sha256(value.encode()).hexdigest()
        if key not in cls.held:
            cls.held.clear()
            cls.held[key] = Bpe(value)
        return cls.held[key]


#: Rows and bytes of text that are encoded together.
ROWS, BYTES = 4096, 1 << 20


def encoded(documents: DataFrame, tokenizer: str, inputs: list[str], use: Callable[[Bpe, list[tuple], list[bytes]], list[tuple]], schema: str) -> DataFrame:
    """``documents`` with columns that ``use`` makes of the encoder, rows of ``inputs`` (the last is the text) and their ids.

    The vocabulary (a fixed file of ``tokenizer``, read on the driver) is broadcast. About a MB of text is Python strings at
    one time, unless one row has more; of such a row a million characters are cut into chunks at one time.
    """
    held = documents.sparkSession.sparkContext.broadcast(spec(tokenizer))

    def make() -> Callable[[list[tuple]], list[tuple]]:
        bpe = Loaded.get(held.value)

        def rows(given: list[tuple]) -> list[tuple]:
            whole = [(*x[:-1], x[-1] or "") for x in given]
            return use(bpe, whole, bpe.encode([x[-1] for x in whole]))

        rows.close = bpe.rest  # type: ignore[attr-defined]
        return rows

    return add_columns_by(documents, inputs, make, schema, ROWS, BYTES)


def encode_table(documents: DataFrame, tokenizer: str, text_col: str = "text", ids: str = "_ids", decoded: str = "_decoded") -> DataFrame:
    """``documents`` with the columns ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (string) after its own.

    A null text counts as empty: no ids, and the empty text decoded. Repeated rows each get their result, an empty table
    gives an empty one, and a long text is encoded whole. A column of ``documents`` that has one of the two names is an error.
    """
    both = lambda bpe, _, found: [(x, bpe.decode(x)) for x in found]
    return encoded(documents, tokenizer, [text_col], both, f"{ids} binary, {decoded} string")


def digests(documents: DataFrame, tokenizer: str, *columns: str) -> DataFrame:
    """``columns`` of ``documents`` with n_tokens, ids_sha256 and decoded_sha256; columns of these names are replaced."""
    added = ("n_tokens", "ids_sha256", "decoded_sha256")
    own = documents.select(*(F.col(f"`{x}`") for x in dict.fromkeys([*(c for c in columns if c not in added), "text"])))
    ids, decoded = free_names(own, "_ids", "_decoded")
    table = encode_table(own, tokenizer, ids=ids, decoded=decoded)
    return table.select(
        *(F.col(f"`{x}`") for x in columns if x not in added),
        (F.octet_length(ids) / 4).cast("bigint").alias("n_tokens"),
        F.sha2(F.col(ids), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"),
    )


