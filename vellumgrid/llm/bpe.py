"""Byte-level BPE by a tokenization automaton.

The automaton reads tokens and accepts exactly the sequences that byte-pair encoding yields. It starts as one state with
an arc to itself for every byte. Merges are compiled in order. The gadget for a merge (u, v): all arcs labelled u lead to
one state q; if q has an arc v, a copy of q without v becomes the new target of all arcs u, and every state with an arc u
gets an arc for the new token, to where v led from q. A state is kept as its parent, the merge that made it and the arc it
lost, so the table grows with the merges and not with states times tokens; `has_arc` follows those three.

A word is read left to right. Each prefix has one tokenization, hence one state; from it the table gives the arcs whose
labels come next in the word. Tokens are read back from the arcs that lead to the end. Decoding emits arc labels.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm.common import slices, table

#: The word split of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words whose tokens a worker remembers in each of two generations, and the longest such word. When the younger is full it
#: becomes the older; a word met again moves to the younger.
REMEMBERED, REMEMBERED_LENGTH = 250_000, 64


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in a vocabulary file: itself where printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@dataclass
class Automaton:
    labels: list[bytes]
    """Arc label of each token id."""
    special: dict[str, int]
    """Tokens matched in the text before it is split."""
    made: np.ndarray
    """Merge that made the token, from 1; 0 for a byte, -1 for a token that no text yields."""
    left: np.ndarray
    target: np.ndarray
    """State that arcs with this label lead to."""
    parent: np.ndarray
    birth: np.ndarray
    lost: np.ndarray
    ids: dict[bytes, int] = field(default_factory=dict)
    longest: int = 0
    known: dict[int, bool] = field(default_factory=dict)
    words: dict[str, bytes] = field(default_factory=dict)
    older: dict[str, bytes] = field(default_factory=dict)

    def ready(self) -> Automaton:
        """With what a worker needs besides the tables."""
        reserved = set(self.special.values())
        self.ids = {x: t for t, x in enumerate(self.labels) if t not in reserved and self.made[t] >= 0}
        self.longest = max(map(len, self.ids), default=0)
        self.prefixes = {x[:k] for x in self.ids for k in range(1, len(x))}
        self.table = tuple(x.tolist() for x in (self.made, self.left, self.parent, self.birth, self.lost, self.target))
        self.split = regex.compile(SPLIT).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda x: [x]
        return self

    def has_arc(self, state: int, token: int) -> bool:
        key = state << 20 | token
        known = self.known.get(key)
        if known is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            known = self.known[key] = _has_arc(state, token, *self.table[:5])
        return known

    def read(self, word: bytes) -> list[int]:
        """Tokens of one word."""
        whole = self.ids.get(word)
        if whole is not None:  # the first state has an arc for every token that can be made
            return [whole]
        n, target, ids, prefixes, known, longest = len(word), self.table[5], self.ids, self.prefixes, self.known, self.longest
        state = [-1] * (n + 1)
        arc = [0] * (n + 1)
        state[0] = 0
        for i in range(n):
            s = state[i]
            for j in range(i + 1, min(n, i + longest) + 1):
                piece = word[i:j]
                if state[j] < 0:
                    token = ids.get(piece)
                    if token is not None:
                        has = known.get(s << 20 | token)
                        if has or has is None and self.has_arc(s, token):
                            state[j], arc[j] = target[token], token
                if piece not in prefixes:
                    break
        out = []
        while n:
            out.append(arc[n])
            n -= len(self.labels[arc[n]])
        return out[::-1]

    def packed(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self.older.get(word)
            if found is None:
                ids = self.read(word.encode())
                found = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) <= REMEMBERED_LENGTH:
                if len(self.words) >= REMEMBERED:
                    self.older, self.words = self.words, {}
                self.words[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text, little-endian unsigned 32-bit."""
        out = []
        for piece in self.cut(text):
            if piece in self.special:
                out.append(np.array([self.special[piece]], "<u4").tobytes())
            elif piece:
                out += map(self.packed, self.split(piece))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The arc labels, joined; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _has_arc(state: int, token: int, made: list[int], left: list[int], parent: list[int], birth: list[int], lost: list[int]) -> bool:
    while state:
        if made[token] >= birth[state]:  # the state came first: it has the arc if it has the one for the left part
            token = left[token]
        elif token == lost[state]:
            return False
        else:
            state = parent[state]
    return True


def compile_merges(path: str) -> Automaton:
    """The automaton of a vocabulary file. Merges whose parts never meet make no gadget, and no text yields their token."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, model = byte_letters(), spec["model"]
    to_bytes = lambda x: bytes(letters[c] for c in x)
    vocab = {to_bytes(k): v for k, v in model["vocab"].items() if all(c in letters for c in k)}
    special = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
    size = 1 + max([*vocab.values(), *special.values()])
    labels = [b""] * size
    for x, t in vocab.items():
        labels[t] = x
    for x, t in special.items():
        labels[t] = x.encode()
    made, left, target = [-1] * size, [0] * size, [0] * size
    for b in range(256):
        made[vocab[bytes([b])]] = 0
    parent, birth, lost = [0], [0], [-1]
    for k, pair in enumerate(model["merges"], 1):
        u, v = (vocab[to_bytes(x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
        token = vocab[labels[u] + labels[v]]
        if made[u] < 0 or made[v] < 0 or not _has_arc(target[u], v, made, left, parent, birth, lost):
            continue
        made[token], left[token], target[token] = k, u, target[v]
        parent.append(target[u])
        birth.append(k)
        lost.append(v)
        target[u] = len(parent) - 1
    return Automaton(labels, special, *(np.array(x, np.int32) for x in (made, left, target, parent, birth, lost)))


_READY: dict[str, Automaton] = {}


def _here(shared, key: str) -> Automaton:
    """The worker's own automaton, made ready once."""
    if key not in _READY:
        _READY.clear()
        _READY[key] = shared.value.ready()
    return _READY[key]


def encode_documents(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded.

    A null or empty text has no tokens. Rows that repeat stay repeated; a null doc_id stays null; other columns are ignored.
    vocabulary: path of the tokenizer file, read by the driver; its tables (bounded by the vocabulary) are broadcast.
    """
    with open(vocabulary, "rb") as f:
        key = hashlib.sha256(f.read()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(compile_merges(vocabulary))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _here(shared, key)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for part in slices(batch):
                n, first, second, every, back = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = machine.encode(text or "")
                    decoded = machine.decode(ids)
                    n.append(len(ids))
                    first.append(sha(ids.tobytes()))
                    second.append(sha(decoded.encode()))
                    if keep_ids:
                        every.append(ids.astype(np.int32))
                        back.append(decoded)
                more = [pa.array(every, pa.list_(pa.int32())), pa.array(back, pa.string())] if keep_ids else []
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string()), *more], names=[x.split(" ")[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(kernel, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
