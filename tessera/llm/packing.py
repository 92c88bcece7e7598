"""Operator 3, packing: lexical retrieval packing with sharded BM25 indexes.

Texts are tokenised by a public byte-level BPE vocabulary, and each is closed
by one separator id. Whole windows of a long text are sequences of their own;
what remains of each text, its tail, is packed. Tails are dealt to shards by
their rarest ids, so that lexical neighbours meet. Each shard has an inverted
index over the ids of its tails, with BM25 weights from document frequencies of
the whole corpus. All distinct ids of a seed are its query. A seed takes the window; the best unused neighbours for the
seed follow until it is full, the last cut to fit, and what is left of it is
the next seed. Where no neighbour shares an id, the next unused tail follows.
What a shard has left at its end is cut into powers of two, which need no
padding.

Terms are token ids, so the frequency table has at most as many rows as the
vocabulary: that bounds what is broadcast. Shards are ranges of the sorted
tails, so equal tails and frequent ids never pile up in one.

Defined cases: a null text counts as empty and is one separator; rows that
repeat an id are packed one by one; ties in score go to the earlier tail;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table, text_of, written

WINDOW = 1024
SEPARATOR = 0
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: A character that isn't white space, then a blank: no token of the vocabulary's pattern crosses the place before the blank.
BREAK = "([^\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]) "
MARK = "\x00"
BLOCK = 20_000  # words tokenised in one string
PARTITIONS = 10_000  # of the tails at most, whose bounds the driver draws


@cache
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path))


@cache
def added_tokens(path: str) -> dict[str, int]:
    """The whole tokens that the vocabulary finds in texts before all else, from its JSON form."""
    with open(path.removesuffix(".tiktoken") + ".json") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def vocabulary_path() -> str:
    """The ranks of the same vocabulary as byte_bpe_50k.json, which is slower to apply."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def token_sizes(path: str) -> np.ndarray:
    """The bytes of each id."""
    e = encoding(path)
    return np.array([len(e.decode_single_token_bytes(i)) for i in range(e.max_token_value + 1)], np.int64)


def encode_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words one after another, and how many each has. Words that
    begin with a blank are tokenised in long strings, as no token crosses the
    place before the blank; bytes tell whose the ids are."""
    sizes, added = token_sizes(path), added_tokens(path)
    parts, counts = [], []

    def encode(text: str) -> list[int]:
        return encoding(path).encode(text, allowed_special="all") if any(t in text for t in added) else encoding(path).encode_ordinary(text)

    i = 0
    while i < len(words):
        j = i + 1
        while j < len(words) and j < i + BLOCK and words[j][:1] == " " and not words[j - 1][-1:].isspace():
            j += 1
        ids = np.array(encode("".join(words[i:j])), np.int64)
        ends = np.cumsum([len(w.encode()) for w in words[i:j]])
        upto = np.searchsorted(np.cumsum(sizes[ids]), ends, side="right")
        parts.append(ids)
        counts.append(np.diff(upto, prepend=0))
        i = j
    return np.concatenate([*parts, np.empty(0, np.int64)]).astype(np.uint32), np.concatenate([*counts, np.empty(0, np.int64)])


def encode_batch(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch, and where each text's begin; every distinct word of
    the batch is tokenised once."""
    if pc.any(pc.match_substring(texts, MARK)).as_py():  # the mark is in a text: take whole texts
        lists = pa.array([[t] for t in texts.to_pylist()], pa.list_(texts.type))
    else:
        lists = pc.split_pattern(pc.replace_substring_regex(texts, BREAK, f"\\1{MARK} "), MARK)
    begins = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    words = lists.flatten().dictionary_encode()
    del lists  # the texts' words, once more as large as the texts
    flat, size = encode_words(words.dictionary.to_pylist(), path)
    at = words.indices.to_numpy()
    table = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)])), pa.array(flat))
    out = table.take(words.indices).flatten().to_numpy() if len(at) else flat
    upto = np.concatenate([[0], np.cumsum(size[at])])
    return out, upto[begins]


def slices(batch: pa.RecordBatch, most: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with texts of about ``most`` bytes together."""
    block = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) // most
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for i, j in zip(edges[:-1], edges[1:]):
        yield batch.slice(i, j - i)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def tokenised(docs: DataFrame, path: str, window: int) -> DataFrame:
    """The pieces that fill a window, and one tail (``ids`` not null) a text at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 33
        for batch in batches:
            for part in slices(batch):
                flat, upto = encode_batch(part.column("text"), path)
                out: tuple[list, ...] = ([], [], [], [], [], [], [])
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    ids = np.append(flat[upto[i] : upto[i + 1]], np.uint32(SEPARATOR))
                    n = len(ids)
                    for start in range(0, n, window):
                        own = ids[start : start + window]
                        if full := len(own) == window:
                            sequence += 1
                        row = (doc_id, start, len(own), crc(own) if full else None, n, sequence if full else None, None if full else own.astype("<u4").tobytes())
                        for column, value in zip(out, row):
                            column.append(value)
                types = (pa.int64(),) * 6 + (pa.binary(),)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, ids binary")


def ids_of(ids: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u4") for x in ids]


def frequencies(tails: DataFrame) -> DataFrame:
    """``id, n``: in how many tails each id occurs; each task sends its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for ids in ids_of(batch.column("ids")):
                own = np.unique(ids)
                if len(own) and own[-1] >= len(counts):
                    counts = np.concatenate([counts, np.zeros(int(own[-1]) + 1 - len(counts), np.int64)])
                counts[own] += 1
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], ["id", "n"])

    return tails.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


class Index:
    """A BM25 inverted index of one shard's tails."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        sets = [np.unique(x, return_counts=True) for x in tails]
        size = np.array([len(s[0]) for s in sets], np.int64)
        term = np.concatenate([s[0] for s in sets]).astype(np.int64)
        count = np.concatenate([s[1] for s in sets]).astype(np.float64)
        tail = np.repeat(np.arange(len(tails)), size)
        length = np.array([len(x) for x in tails], np.float64)[tail]
        weight = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean))
        by = np.argsort(term, kind="stable")
        self.tail, self.weight, self.n = tail[by], weight[by], len(tails)
        self.terms, heads = np.unique(term[by], return_index=True)
        self.heads = np.append(heads, len(by))
        self.queries = [s[0] for s in sets]  # all distinct ids of each tail
        # Ids in an eighth of the tails or more, so at most eight times those of a mean tail, have a whole row of weights.
        at = np.repeat(np.arange(len(self.terms)), own := np.diff(self.heads))
        self.row = np.where(common := own * 8 >= self.n, np.cumsum(common) - 1, -1)
        self.rows = np.zeros((int(common.sum()), self.n))
        self.rows[self.row[at[common[at]]], self.tail[common[at]]] = self.weight[common[at]]

    def scores(self, i: int) -> np.ndarray:
        """Of every tail for the query that tail ``i`` makes."""
        at = np.searchsorted(self.terms, self.queries[i])
        row = self.row[at]
        out = self.rows[row[row >= 0]].sum(axis=0)
        if len(rare := at[row < 0]):
            spans = [slice(self.heads[t], self.heads[t + 1]) for t in rare]
            out += np.bincount(np.concatenate([self.tail[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        return out


def ranked(score: np.ndarray, first: int = 32) -> Iterator[int]:
    """All places of a positive score, best first, ties by place. Few windows
    need more than ``first``, so the others are sorted only when asked for."""
    least = -np.partition(-score, first - 1)[first - 1] if len(score) > first else 0.0
    for part in ((score > 0) & (score >= least), (score > 0) & (score < least)):
        at = np.flatnonzero(part)
        yield from at[np.argsort(-score[at], kind="stable")].tolist()


def pack_shard(tails: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (tail, from, to) over the tails of a shard."""
    index = Index(tails, idf, mean)
    left = np.array([len(x) for x in tails])
    done = np.zeros(len(tails), np.int64)
    unused = np.ones(len(tails), bool)
    out, seed, following = [], 0, 0
    while True:
        if seed is None:
            while following < len(tails) and not unused[following]:
                following += 1
            if following == len(tails):
                return out
            seed = following
        sequence, room, carried, near = [], window, None, None
        current = seed
        while True:
            unused[current] = False
            take = min(room, int(left[current]))
            sequence.append((current, int(done[current]), int(done[current]) + take))
            done[current] += take
            left[current] -= take
            room -= take
            if left[current]:
                carried = current
            if not room:
                break
            if near is None:
                near = ranked(np.where(unused, index.scores(seed), 0.0))
            current = next(near, None)
            if current is None:
                while following < len(tails) and not unused[following]:
                    following += 1
                if following == len(tails):
                    break
                current = following
        out.append(sequence)
        seed = carried


def powers(sequence: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """A sequence cut into sequences whose lengths are powers of two."""
    total = sum(b - a for _, a, b in sequence)
    rest = list(sequence)
    for bit in range(total.bit_length() - 1, -1, -1):
        if not (need := total & (1 << bit)):
            continue
        part = []
        while need:
            tail, a, b = rest[0]
            take = min(need, b - a)
            part.append((tail, a, a + take))
            need -= take
            rest[0:1] = [(tail, a + take, b)] if a + take < b else []
        yield part


def packed(docs: DataFrame, *, window: int = WINDOW, shard_tails: int = 2000, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    pieces = written(tokenised(rows, vocabulary or vocabulary_path(), window), "pieces")
    tails = pieces.filter("ids is not null")
    count, total = tails.agg(F.count("*"), F.sum("length")).first()
    frequent = frequencies(tails).toPandas()  # at most a row for each id of the vocabulary
    df = np.zeros(int(frequent["id"].max()) + 1 if len(frequent) else 1)
    df[frequent["id"]] = frequent["n"]
    idf = np.log1p((count - df + 0.5) / (df + 0.5)).astype(np.float32)
    idf[SEPARATOR] = 0  # it closes every tail, so sharing it makes no neighbour
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    mean = (total or 1) / max(count, 1)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(x) for x in ids_of(batch.column("ids"))]
            first = [x[np.argsort(-shared.value[x], kind="stable")[:8]] for x in own]
            # The two least of the eight rarest ids: similar tails mostly agree in them.
            keys = [np.sort(x).tolist()[:2] for x in first]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "start", "doc_tokens", "ids")), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[-1] for k in keys], pa.int64())], ["doc_id", "start", "doc_tokens", "ids", "k0", "k1"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        sequence = (1 << 62) + ((task.partitionId() if task else 0) << 33)
        held = None
        for batch in batches:
            held = pa.concat_batches([held, batch]) if held is not None else batch
            while held is not None and held.num_rows >= shard_tails:
                yield (done := shard(held.slice(0, shard_tails), sequence))
                sequence += done.num_rows
                held = held.slice(shard_tails)
        if held is not None and held.num_rows:
            yield shard(held, sequence)

    def shard(rows: pa.RecordBatch, sequence: int) -> pa.RecordBatch:
        tails = ids_of(rows.column("ids"))
        doc_id, start, tokens = (rows.column(k).to_pylist() for k in ("doc_id", "start", "doc_tokens"))
        out: tuple[list, ...] = ([], [], [], [], [], [], [])
        for filled in pack_shard(tails, shared.value, mean, window):
            whole = sum(b - a for _, a, b in filled) == window
            for part in (filled,) if whole else powers(filled):
                offset = 0
                for tail, a, b in part:
                    for column, value in zip(out, (doc_id[tail], start[tail] + a, b - a, crc(tails[tail][a:b]), tokens[tail], sequence, offset)):
                        column.append(value)
                    offset += b - a
                sequence += 1
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # Written, as the bounds of the ranges are drawn from it first. A partition holds one shard after another.
    keyed = written(tails.mapInArrow(rarest, "doc_id long, start long, doc_tokens long, ids binary, k0 long, k1 long"), "keyed")
    dealt = keyed.repartitionByRange(max(1, min(-(-count // shard_tails), PARTITIONS)), "k0", "k1", "doc_id", "start").sortWithinPartitions("k0", "k1", "doc_id", "start")
    rest = dealt.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(pack, PIECES)
    return pieces.filter("ids is null").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset")).union(rest)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
