"""How the tokens of two tokenizers stand for each other, counted over a corpus.

Both tokenizers' tokens are byte ranges of one text. Where both end a token together, the text is cut into groups, and the two
tokens that end there are linked. A linked pair of ids is one int64 (second id in the high half). Each task counts the pairs of
its documents with np.unique; partial counts are sorted by ranges of the key over the cluster, and runs of a key are summed into
sorted shards of keys and counts in the shared folder. The second pass reads the texts again and looks links up by
searchsorted in the memory-mapped shards, so no count passes through the driver, which only holds the first key of each shard and
one maximum for each id of the second vocabulary.

Neither tokenizer joins what stands before a space to what follows, unless white space stands before it. So a text is cut
there and each distinct piece is encoded once for as long as a worker remembers it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm.bpe import byte_letters
from vellumgrid.llm.common import slices, table
from vellumgrid.storage import shared_folder, write_table

#: Pieces of text that a worker remembers, and their code points together.
REMEMBERED, REMEMBERED_CHARS = 400_000, 32 << 20
#: Code points of a text that are split at a time; a longer one is cut where a piece ends.
CHUNK = 1 << 20
#: Rows and bytes of text that are split together.
ROWS, BYTES = 4096, 16 << 20
#: Distinct pairs that a task holds before it sends them.
PAIRS = 2 << 20
#: Bits of a pair's key that hold the first tokenizer's id.
LOW = 32
#: Pieces encoded in one call.
TOGETHER = 4096
#: Pieces up to this length and of letters that have had one class since Unicode 5 are encoded from the rank file, which holds the same merges.
RANKED_LENGTH, RANKED = 1024, re.compile("[\x00-ɏ]*")
#: A space with white space before it. One Unicode version had U+180E as white space.
_AFTER_WHITE = re.compile("[\\s᠎] ")
#: For Arrow: that, a space at either end, and what Python's white space has besides.
_UNEVEN = r"^ | $|[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
#: Before the spaces in front of a word, where the text before them ends in no white space.
_CUT = re.compile("(?<=[^\\s᠎])(?= +[^ ])")
_MARK = "▁"


def pieces_of(text: str) -> list[str]:
    """The pieces of a text that follow a space, without that space; the first follows a space that isn't in the text."""
    if _AFTER_WHITE.search(text) or text[:1] == " " or text[-1:] == " ":
        return [x[1:] for x in _CUT.split(" " + text)]
    return text.split(" ")


def chunks_of(text: str, size: int = CHUNK) -> Iterator[str]:
    """A text in parts of about `size` code points, each cut at the space where a piece ends; that space is left out."""
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start() + 1
    yield text[at:]


@dataclass(frozen=True)
class Tokenizers:
    """Paths of the first tokenizer's file and its ranks, and of the second's model, as each worker reaches them."""

    first: str
    ranks: str
    second: str


class Encoders:
    """Both tokenizers with the bytes of each id."""

    def __init__(self, paths: Tokenizers):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(paths.first)
        self.whole.encode_special_tokens = True
        with open(paths.first, encoding="utf-8") as f:
            spec = json.load(f)
        with open(paths.ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.first = [b""] * (1 + max(vocab.values()))
        for token, k in vocab.items():
            self.first[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.other = sentencepiece.SentencePieceProcessor(model_file=paths.second)
        names = [self.other.id_to_piece(k) for k in range(self.other.get_piece_size())]
        self.second = [bytes([int(x[3:5], 16)]) if self.other.is_byte(k) else x.replace(_MARK, " ").encode() for k, x in enumerate(names)]
        #: Whether no token of the second joins what stands before a space to it.
        self.cuts = not any(re.search(f"[^{_MARK}]{_MARK}", x) for x in names)
        a, b = ([str(k) for k in range(len(t))] for t in (self.first, self.second))
        #: A token as it is written inside and at the end of its side of a group.
        self.written = [x + "," for x in a] + [x + "|" for x in a] + [x + "," for x in b] + [x + ";" for x in b]
        self.first_size, self.second_size = (np.array([len(x) for x in t]) for t in (self.first, self.second))

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, ...]:
        """Ids and numbers of ids of both, one piece at a time; a piece that doesn't come back from both has none."""
        a = [x.ids for x in self.whole.encode_batch([" " + x for x in pieces], add_special_tokens=False)]
        b = self.other.encode(pieces, num_threads=1)
        for k, x in enumerate(pieces):
            own = (" " + x).encode()
            if b"".join(map(self.first.__getitem__, a[k])) != own or b"".join(map(self.second.__getitem__, b[k])) != own:
                a[k] = b[k] = []
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(pieces)) for ids in (a, b))
        return *(np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((a, n_a), (b, n_b))), n_a, n_b

    def _together(self, pieces: list[str]) -> tuple[np.ndarray, ...]:
        """As `_each`, for pieces that can follow each other in one text: both tokenizers end a token where a piece ends."""
        text = " ".join(pieces)
        own = (" " + text).encode()
        if RANKED.fullmatch(text):
            a, b = self.ranked(" " + text), self.other.encode(text)
            if b"".join(map(self.first.__getitem__, a)) == own and b"".join(map(self.second.__getitem__, b)) == own:
                a, b = np.array(a, np.int64), np.array(b, np.int64)
                ends = np.cumsum(np.fromiter(map(len, map(str.encode, pieces)), np.int64, len(pieces)) + 1)
                at = [np.searchsorted(np.cumsum(size[ids]), ends) for ids, size in ((a, self.first_size), (b, self.second_size))]
                return a, b, *(np.diff(x, prepend=-1) for x in at)
        return self._each(pieces)

    def encode(self, pieces: list[str]) -> tuple[list[str], tuple[np.ndarray, ...]]:
        """The pieces in the order taken, and ids and numbers of ids of both."""
        alone = [x for x in pieces if len(x) > RANKED_LENGTH or x[:1] == " " or x[-1:].isspace()]
        if alone:
            apart = set(alone)
            pieces = [x for x in pieces if x not in apart]
        parts = [self._together(pieces[k : k + TOGETHER]) for k in range(0, len(pieces), TOGETHER)]
        parts += [self._each(alone[k : k + TOGETHER]) for k in range(0, len(alone), TOGETHER)]
        return pieces + alone, tuple(np.concatenate(x) for x in zip(*parts))


_ENCODERS: dict[Tokenizers, Encoders] = {}


def _encoders(paths: Tokenizers) -> Encoders:
    """A worker's own tokenizers, read once."""
    if paths not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[paths] = Encoders(paths)
    return _ENCODERS[paths]


class Pieces:
    """Pieces that a task has met, by number, with their tokens and links in arrays.

    look_up: from distinct sorted keys to their counts and whether each is the highest of its second id; without it, only keys are
    held. A piece whose bytes don't come back from both tokenizers is bad.
    """

    def __init__(self, encoders: Encoders, look_up: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None):
        self.encoders, self.look_up = encoders, look_up
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.bad: set[int] = set()
        self.chars = 0
        self.keys: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.facts = np.zeros((0, 5), np.int64)
        self.more: list[np.ndarray] = []
        self.groups: list[str] = []

    def forget(self) -> None:
        if self.full:
            self.clear()

    @property
    def full(self) -> bool:
        return len(self.number) >= REMEMBERED or self.chars >= REMEMBERED_CHARS

    def split(self, text: str) -> list[str]:
        return pieces_of(text) if self.encoders.cuts else [text]

    def chunks(self, text: str) -> Iterator[str]:
        return chunks_of(text) if self.encoders.cuts else iter([text])

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode those of the distinct pieces that aren't known."""
        new = [x for x in pieces if x not in self.number]
        if not new:
            return
        e, low = self.encoders, len(self.number)
        new, (flat_a, flat_b, n_a, n_b) = e.encode(new)
        self.bad.update((low + np.flatnonzero(n_a == 0)).tolist())
        self.number.update(zip(new, range(low, low + len(new))))
        self.chars += sum(map(len, new))
        # no token is without bytes, so ends rise strictly, and a piece ends where both end a token
        end_a, end_b = np.cumsum(e.first_size[flat_a]), np.cumsum(e.second_size[flat_b])
        at = np.searchsorted(end_b, end_a)
        at_a = np.flatnonzero(end_b[np.minimum(at, len(end_b) - 1)] == end_a) if len(end_b) else np.zeros(0, np.int64)
        at_b = at[at_a]
        keys = flat_b[at_b] << LOW | flat_a[at_a]
        links = np.bincount(np.repeat(np.arange(len(new)), n_a)[at_a], minlength=len(new))
        self.keys.append(keys)
        self.links.append(links)
        if self.look_up is None:
            return
        distinct, back = np.unique(keys, return_inverse=True)
        count, best = (x[back] for x in self.look_up(distinct))
        owner = np.repeat(np.arange(len(new)), links)
        add = lambda x: np.bincount(owner, x, len(new)).astype(np.int64)
        total = np.zeros(len(new), np.int64)
        np.add.at(total, owner, count)
        self.more.append(np.stack([n_a, n_b, links, add(best), total], axis=1))
        # tokens in the order they are written: of each group those of the first tokenizer, then those of the second
        group_a, group_b = (np.searchsorted(x, np.arange(n)) for x, n in ((at_a, len(flat_a)), (at_b, len(flat_b))))
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        last_a, last_b = np.zeros(len(flat_a), bool), np.zeros(len(flat_b), bool)
        last_a[at_a] = last_b[at_b] = True
        size_a, size_b = len(e.first), len(e.second)
        code = np.concatenate([flat_a + last_a * size_a, flat_b + last_b * size_b + 2 * size_a])[order]
        written = list(map(e.written.__getitem__, code.tolist()))
        ends = np.cumsum(n_a + n_b).tolist()
        self.groups += ["".join(written[i:j]) for i, j in zip([0, *ends[:-1]], ends)]

    def good(self, rows: np.ndarray) -> bool:
        return not self.bad or self.bad.isdisjoint(rows.tolist())

    def meet(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """Place and pieces of each text that isn't null, empty, longer than a chunk, or bad."""
        size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
        usual = (size > 0) & (size <= CHUNK)
        if self.encoders.cuts:
            plain = usual & ~pc.fill_null(pc.match_substring_regex(texts, _UNEVEN), True).to_numpy(zero_copy_only=False)
        else:
            plain = np.zeros(len(texts), bool)
        other = np.flatnonzero(usual & ~plain)
        split = [self.split(texts[k].as_py()) for k in other.tolist()]
        at = np.flatnonzero(plain)
        lists = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(words)
        self.learn(set(chain.from_iterable(split)))
        every = self.rows(words)[coded.indices.to_numpy()]
        ends = np.cumsum(pc.list_value_length(lists).to_numpy()).tolist()
        for k, i, j in zip(at.tolist(), [0, *ends[:-1]], ends):
            if self.good(every[i:j]):
                yield k, every[i:j]
        for k, words in zip(other.tolist(), split):
            rows = self.rows(words)
            if self.good(rows):
                yield k, rows

    def rows(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))

    def measured(self) -> np.ndarray:
        """Of each piece: tokens of both, links, best links, sum of counts."""
        if self.more:
            self.facts, self.more = np.concatenate([self.facts, *self.more]), []
        return self.facts

    def pair_counts(self, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and their counts, where piece k was met times[k] times."""
        keys, links = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.keys, self.links))
        return summed(keys, np.repeat(times, links))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts; keys without a count are left out."""
    distinct, back = np.unique(keys[counts > 0], return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, back, counts[counts > 0])
    return distinct, total


def long_texts(texts: pa.Array) -> list[int]:
    return np.flatnonzero(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False) > CHUNK).tolist()


class Tally:
    """Counts of linked pairs over the texts that a task reads."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.times = np.zeros(0, np.int64)
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _met(self, rows: list[np.ndarray]) -> None:
        """Pieces of texts without a bad one; what has been met goes to the pairs when the pieces are too many to keep."""
        if rows:
            more = np.bincount(np.concatenate(rows), minlength=len(self.times))
            more[: len(self.times)] += self.times
            self.times = more
        if self.pieces.full:
            self._flush()

    def _flush(self) -> None:
        times = np.zeros(len(self.pieces.number), np.int64)
        times[: len(self.times)] = self.times
        keys, counts = self.pieces.pair_counts(times)
        self.keys, self.counts = summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        self.pieces.clear()
        self.times = np.zeros(0, np.int64)

    def short(self, texts: pa.Array) -> None:
        self._met([rows for _, rows in self.pieces.meet(texts)])

    def long(self, text: str) -> None:
        """A text by chunks: first whether any piece is bad, then all of them."""
        for counted in (False, True):
            for c in self.pieces.chunks(text):
                words = self.pieces.split(c)
                self.pieces.learn(set(words))
                rows = self.pieces.rows(words)
                if not self.pieces.good(rows):
                    return
                self._met([rows] * counted)

    def sent(self) -> pa.RecordBatch:
        self._flush()
        out = pa.RecordBatch.from_arrays([pa.array(self.keys), pa.array(self.counts)], names=["key", "n"])
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        return out


def count_pairs(docs: DataFrame, paths: Tokenizers) -> DataFrame:
    """(key, n): partial counts of linked pairs over the texts of docs; a key may come from several tasks."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(Pieces(_encoders(paths)))
        for batch in batches:
            for part in slices(batch, ROWS, BYTES):
                tally.short(part.column(0))
                for x in long_texts(part.column(0)):
                    tally.long(part.column(0)[x].as_py())
                if len(tally.keys) > PAIRS:
                    yield tally.sent()
        yield tally.sent()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(kernel, "key long, n long")


@dataclass(frozen=True)
class Shards:
    """Sorted shards of pair counts: their first keys, their files, and the highest count of each id of the second vocabulary."""

    folder: str
    first: np.ndarray
    names: tuple[str, ...]
    best: np.ndarray


def write_shards(counts: DataFrame) -> Shards:
    """Sort partial counts (key, n) by ranges over the cluster, sum runs of a key, and write each range as two files of int64.

    Files have a name of their own for each attempt of a task, and only those of attempts that ended well are listed. The folder must
    be one that pyarrow opens. To the driver come a row for each shard and a number for each second id.
    """
    folder = f"{shared_folder(counts.sparkSession)}/vellumgrid-pairs-{uuid.uuid4().hex}"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = arrow_fs.FileSystem.from_uri(folder)
        name = uuid.uuid4().hex
        opened: list = []
        first, ids, highest = 0, [], []

        def put(keys: np.ndarray, n: np.ndarray) -> None:
            nonlocal first
            if not len(keys):
                return
            if not opened:
                store.create_dir(base, recursive=True)
                opened.extend(store.open_output_stream(f"{base}/{name}.{kind}") for kind in ("keys", "counts"))
                first = int(keys[0])
            for out, x in zip(opened, (keys, n)):
                out.write(x.astype("<i8").tobytes())
            second = keys >> LOW
            begin = np.flatnonzero(np.diff(second, prepend=-1))
            ids.append(second[begin])
            highest.append(np.maximum.reduceat(n, begin))

        last = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            key, n = (np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate(last))
            if not len(key):
                continue
            begin = np.flatnonzero(np.diff(key, prepend=-1))
            key, n = key[begin], np.add.reduceat(n, begin)
            put(key[:-1], n[:-1])
            last = key[-1:], n[-1:]  # the next batch may go on with this key
        put(*last)
        for out in opened:
            out.close()
        if opened:
            ids, highest = np.concatenate(ids), np.concatenate(highest)
            order = np.argsort(ids, kind="stable")
            begin = np.flatnonzero(np.diff(ids[order], prepend=-1))
            yield pa.RecordBatch.from_pydict({"first": [first], "name": [name], "ids": [ids[order][begin].astype("<i8").tobytes()], "highest": [np.maximum.reduceat(highest[order], begin).astype("<i8").tobytes()]})

    ranged = counts.repartitionByRange("key").sortWithinPartitions("key")
    found = sorted((r["first"], r["name"], bytes(r["ids"]), bytes(r["highest"])) for r in ranged.mapInArrow(kernel, "first long, name string, ids binary, highest binary").collect())
    ids, highest = (np.frombuffer(b"".join(x[k] for x in found), "<i8") for k in (2, 3))
    best = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    np.maximum.at(best, ids, highest)
    return Shards(folder, np.array([x[0] for x in found], np.int64), tuple(x[1] for x in found), best)


class Lookup:
    """Counts of pairs from memory-mapped shards; each is opened when a key falls into it."""

    def __init__(self, shards: Shards):
        self.shards = shards
        self.store, self.base = arrow_fs.FileSystem.from_uri(shards.folder)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.open:
            paths = [f"{self.base}/{self.shards.names[k]}.{kind}" for kind in ("keys", "counts")]
            local = isinstance(self.store, arrow_fs.LocalFileSystem)
            self.open[k] = tuple(np.frombuffer((pa.memory_map(p) if local else self.store.open_input_file(p)).read_buffer(), "<i8") for p in paths)
        return self.open[k]

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of distinct sorted keys, and whether each is the highest of its second id."""
        count = np.zeros(len(keys), np.int64)
        at = 0
        while at < len(keys):
            k = bisect_right(self.shards.first, keys[at]) - 1
            end = int(np.searchsorted(keys, self.shards.first[k + 1])) if k + 1 < len(self.shards.first) else len(keys)
            held, n = self._shard(k)
            count[at:end] = n[np.searchsorted(held, keys[at:end])]
            at = end
        return count, count == self.shards.best[keys >> LOW]


def align(docs: DataFrame, paths: Tokenizers) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text is encoded after a space of its own. Texts that are null, empty or don't come back from the bytes of both tokenizers' tokens
    have no tokens: zeros and ''. Strings of special tokens in a text are plain text. Rows that repeat count each time and come
    back each; a null doc_id stays null; other columns are ignored. n_best counts ties. As no token is without bytes, the tokens that
    end together are two, so a group has one link.
    """
    return look_up_links(docs, paths, write_shards(write_table(count_pairs(docs, paths), "pair-counts")))


def look_up_links(docs: DataFrame, paths: Tokenizers, shards: Shards) -> DataFrame:
    """The second pass of `align`: all texts again, each link with its corpus-wide count."""
    shared = docs.sparkSession.sparkContext.broadcast(shards)  # bounded by shards and the second vocabulary
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(_encoders(paths), Lookup(shared.value))
        nothing = (np.zeros(5, np.int64), "")

        def measured(units: Iterable[np.ndarray]) -> tuple[np.ndarray, str]:
            total, digest, before = np.zeros(5, np.int64), hashlib.sha256(), ""
            for rows in units:
                if not pieces.good(rows):
                    return nothing
                total += pieces.measured()[rows].sum(axis=0)
                written = before + "".join(map(pieces.groups.__getitem__, rows.tolist()))
                digest.update(written[:-1].encode())
                before = written[-1:]
            return total, digest.hexdigest()

        def learned(text: str) -> Iterator[np.ndarray]:
            for c in pieces.chunks(text):
                words = pieces.split(c)
                pieces.forget()
                pieces.learn(set(words))
                yield pieces.rows(words)

        for batch in batches:
            for part in slices(batch, ROWS, BYTES):
                texts = part.column(1)
                found = [nothing] * len(texts)
                for k, rows in pieces.meet(texts):
                    found[k] = measured([rows])
                for k in long_texts(texts):
                    found[k] = measured(learned(texts[k].as_py()))
                pieces.forget()
                facts = np.array([x[0] for x in found], np.int64).reshape(-1, 5)
                columns = (facts[:, 0], facts[:, 1], facts[:, 2], facts[:, 2], facts[:, 3], facts[:, 4])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c.copy()) for c in columns), pa.array([x[1] for x in found], pa.string())], names=["doc_id", *names, "groups_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(kernel, "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", groups_sha256 string")


def public_pair() -> Tokenizers:
    import public_tokenizers

    return Tokenizers(*map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level against piece tokens over all documents; see `align`."""
    return align(table(spark, sf_dir, "documents"), public_pair())
