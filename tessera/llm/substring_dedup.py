"""Operator 10, substring dedup: one compressed FM-index per shard, searched
backwards over a wavelet tree.

A window is ``span`` consecutive words. Shards are cut by content, so that any
two equal windows meet in one shard and no document is streamed past every
index of the corpus:

1. Documents of one word sequence form a class; only its smallest id goes on.
   Every window of the others starts in it, too.
2. Each window has an anchor, the grams' least hash in it (a minimizer), which
   depends on its words alone. Anchors that one document has alone are left out:
   no window with them occurs elsewhere.
3. Consecutive windows of one anchor form a run. Equal runs are merged, and runs
   are dealt to shards by their anchor. Runs of an anchor that more than
   ``hot`` documents share are cut into single windows, dealt by their own
   hash, so that no shard grows with a passage that the whole corpus shares.
4. Each shard indexes its runs: suffixes sorted up to 64 words, the
   Burrows-Wheeler transform of the word numbers in a wavelet tree of packed
   bits with counts, and for each interval of equal windows the least id of a
   document. Then all runs are streamed through it from right to left. A step
   extends the interval of the last ``span - 1`` words by one word; the interval
   of ``span`` words that results has matches of the threshold's length, and is
   widened to ``span - 1`` words for the next step.
5. A window whose interval has a smaller id than its document's is a repeat;
   the words it covers go.

Defined cases: null texts have no words; texts of under ``span`` words lose
nothing; a window that recurs only within its document stays; rows that
repeat an id are one document for the search, so repeats of that id alone go
nowhere, and each row loses the words of its own text; a row without an id is
no document and loses nothing; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import digest, table, text_of, written
from tessera.llm.minhash import WordHashes

SPAN = 50
GRAM = 10
DEPTH = 64  # words that suffixes are sorted by; at least SPAN
U = np.uint64


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def word_hashes(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), U, len(words))


def anchors_of(h: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``span`` words the hash and the place of its anchor."""
    n = len(h) - gram + 1
    grams = np.zeros(n, U)
    for i in range(gram):
        grams = (grams ^ h[i : i + n]) * U(0x9E3779B97F4A7C15)
        grams ^= grams >> U(32)
    width = span - gram + 1
    place = np.empty(n - width + 1, np.int64)
    for i in range(0, len(place), 1 << 16):  # bounded scratch memory for very long texts
        part = sliding_window_view(grams[i : i + (1 << 16) + width - 1], width)
        place[i : i + len(part)] = part.argmin(axis=1)
    place += np.arange(len(place))
    return grams[place].view(np.int64), place


def runs_of(place: np.ndarray) -> np.ndarray:
    """The starts of the runs of windows with one anchor, and their end."""
    return np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]])


class WaveletTree:
    """Ranks over numbers below ``2**bits``: a level for each bit from the
    highest, numbers with a 0 there moved before those with a 1."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.bits, self.n = bits, len(values)
        self.words, self.counts, self.zeros = [], [], []
        for b in range(bits - 1, -1, -1):
            bit = ((values >> b) & 1).astype(bool)
            packed = np.zeros(len(values) // 64 + 1, U)
            packed.view(np.uint8)[: (len(values) + 7) // 8] = np.packbits(bit, bitorder="little")
            ones = np.bitwise_count(packed)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(ones[:-1], dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(values) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])
        symbols = np.arange(1 << bits)
        self.start = self._descend(symbols, np.zeros(1 << bits, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            block = at >> 6
            mask = (U(1) << (at & 63).astype(U)) - U(1)
            ones = self.counts[level][block] + np.bitwise_count(self.words[level][block] & mask)
            bit = (symbol >> (self.bits - 1 - level)) & 1
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before position ``at``."""
        return self._descend(symbol, at) - self.start[symbol]


class FMIndex:
    """An index of runs of word numbers, each closed by 0, and of the least
    document for every interval of ``span`` words."""

    def __init__(self, text: np.ndarray, doc: np.ndarray, span: int) -> None:
        n, self.span = len(text), span
        rank, kept, h = np.unique(text, return_inverse=True)[1].astype(np.int64), {1: text.astype(np.int64)}, 1
        order = None
        while h < DEPTH:
            after = np.zeros(n, np.int64)
            after[: n - h] = rank[h:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            h *= 2
            kept = {h: rank.copy(), **{k: v for k, v in kept.items() if 2 * k > h // 2}} if h < DEPTH else kept
        self.first, self.last = self._classes(order, kept[DEPTH // 2], span - 1 - DEPTH // 2)
        starts, _ = self._classes(order, kept[DEPTH // 2], span - DEPTH // 2)
        heads = np.unique(starts)
        self.least = np.minimum.reduceat(doc[order], heads)[np.searchsorted(heads, starts)]
        counts = np.bincount(text)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.tree = WaveletTree(text[order - 1], max(1, int(text.max()).bit_length()))

    @staticmethod
    def _classes(order: np.ndarray, half: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix in order the first and the end of those with the
        same ``DEPTH // 2 + shift`` words."""
        n = len(order)
        second = half[np.minimum(order + shift, n - 1)]
        new = np.concatenate([[True], (half[order[1:]] != half[order[:-1]]) | (second[1:] != second[:-1])])
        heads = np.flatnonzero(new)
        size = np.diff(np.concatenate([heads, [n]]))
        return np.repeat(heads, size), np.repeat(heads + size, size)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of a pattern with one more word at its left."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.before[symbol] + both[: len(symbol)], self.before[symbol] + both[len(symbol) :]

    def stream(self, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For every position the least document with the window that starts
        there; runs go through side by side, the longest first."""
        out = np.full(len(text), np.iinfo(np.int64).max)
        by = np.argsort(-length, kind="stable")
        start, length = start[by], length[by]
        low, high = np.zeros(len(by), np.int64), np.full(len(by), len(text), np.int64)
        for step in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -step, side="left"))
            at = start[:live] + length[:live] - 1 - step
            low, high = self.extend(text[at], low[:live], high[:live])
            if step >= self.span - 1:  # the interval has matches of the full length
                out[at] = self.least[low]
                low, high = self.first[low], self.last[low]
        return out


def first_documents(runs: DataFrame, span: int) -> DataFrame:
    """``run_key, firsts``: for each run of a partition, which is a shard, the
    least document of each of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if shard is None:
            return
        hashes, parts = WordHashes(), []
        for words in shard.column("words"):
            parts += [word_hashes(words.as_py().split(b" "), hashes), np.zeros(1, U)]
        length = np.array([len(x) for x in parts[::2]], np.int64)
        text = np.concatenate(parts)
        ends = np.zeros(len(text), bool)
        start = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
        ends[start + length] = True
        number = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
        number[ends] = 0
        number = np.unique(number, return_inverse=True)[1].astype(np.int64)
        doc = np.repeat(shard.column("doc_id").to_numpy(), length + 1)
        firsts = FMIndex(number, doc, span).stream(number, start, length)
        windows = length - span + 1
        flat = np.concatenate([firsts[s : s + w] for s, w in zip(start, windows)])
        keys = shard.column("run_key").combine_chunks()
        for i in range(0, len(keys), 4096):
            w = windows[i : i + 4096]
            base = int(windows[:i].sum())
            offsets = np.concatenate([[0], np.cumsum(w)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[base : base + int(w.sum())]))
            yield pa.RecordBatch.from_arrays([keys[i : i + 4096], lists], ["run_key", "firsts"])

    return runs.select("run_key", "doc_id", "words").mapInArrow(run, "run_key binary, firsts array<long>")


def substring_dedup(docs: DataFrame, *, span: int = SPAN, gram: int = GRAM, hot: int = 1000, shard_words: int = 600_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, text_sha256, starts`` for each row of
    ``docs``: ``starts`` are the places of the repeated windows, null where all
    words or none go."""
    if not gram < span <= DEPTH - 1 or span < DEPTH // 2 + 2:
        raise ValueError(f"span must lie between {DEPTH // 2 + 2} and {DEPTH - 1}, and gram below it")
    # Rows that repeat an id are told apart by the digest of their text.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), digest(text_of(text_col)).alias("key"))

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, keys, shas, anchors, offsets = [], [], [], [np.empty(0, np.int64)], [0]
            for text in batch.column("text"):
                words = words_of(text.as_py())
                joined = b" ".join(words)
                n.append(len(words))
                keys.append(hashlib.blake2b(joined, digest_size=16).digest())
                shas.append(hashlib.sha256(joined).hexdigest())
                if len(words) >= span:
                    anchors.append(np.unique(anchors_of(word_hashes(words, hashes), span, gram)[0]))
                    offsets.append(offsets[-1] + len(anchors[-1]))
                else:
                    offsets.append(offsets[-1])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(anchors)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(shas), lists], ["doc_id", "key", "n_words", "seq_key", "sha", "anchors"])

    outlines = written(rows.mapInArrow(outline, "doc_id long, key binary, n_words long, seq_key binary, sha string, anchors array<long>"), "outlines")
    classes = written(outlines.filter(f"n_words >= {span} and doc_id is not null").groupBy("seq_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1").select("seq_key", "rep"), "classes")
    placed = outlines.join(classes, "seq_key", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("rep"), F.lit(False)))

    own = placed.filter(f"not copy and n_words >= {span} and doc_id is not null").select("doc_id", "key", F.explode("anchors").alias("anchor"))
    shared = own.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("first <> last")
    shared = written(shared.select("anchor", (F.col("n") > hot).alias("is_hot")), "shared")
    wanted = own.join(shared, "anchor").groupBy("doc_id", "key").agg(F.collect_set(F.struct("anchor", "is_hot")).alias("wanted"))
    wanted = wanted.select("doc_id", "key", F.transform("wanted", lambda w: w["anchor"]).alias("anchors"), F.transform("wanted", lambda w: w["is_hot"]).alias("is_hot"))
    texts = written(rows.join(wanted, ["doc_id", "key"]).select("doc_id", "key", "text", "anchors", "is_hot"), "texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        names = ["doc_id", "key", "start", "route", "run_key", "n", "words"]
        types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for doc_id, own_key, text, wanted, is_hot in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "key", "text", "anchors", "is_hot"))):
                words, hot_of = words_of(text), dict(zip(wanted, is_hot))
                anchor, place = anchors_of(word_hashes(words, hashes), span, gram)
                edges = runs_of(place)
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    if (known := hot_of.get(route := int(anchor[a]))) is None:
                        continue
                    for i, j in ((a, b),) if not known else ((i, i + 1) for i in range(a, b)):
                        run = b" ".join(words[i : j + span - 1])
                        key = hashlib.blake2b(run, digest_size=16).digest()
                        for column, value in zip(out, (doc_id, own_key, i, int.from_bytes(key[:8], "little", signed=True) if known else route, key, j - i, run)):
                            column.append(value)
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)
                    out = ([], [], [], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)

    runs = written(texts.mapInArrow(cut, "doc_id long, key binary, start long, route long, run_key binary, n long, words binary"), "runs", compression="zstd")
    contents = written(runs.groupBy("run_key").agg(F.min("doc_id").alias("doc_id"), F.first("route").alias("route"), F.first("n").alias("n"), F.first("words").alias("words")), "contents", compression="zstd")
    total = contents.agg(F.sum(F.col("n") + span)).first()[0] or 0
    shards = contents.repartition(int(total // shard_words) + 1, "route")
    firsts = written(first_documents(shards, span), "firsts", compression="zstd")

    # Windows stay together in the array of their run, so a row is a run and not a window.
    hits = runs.select("doc_id", "key", "start", "run_key").join(firsts, "run_key")
    repeated = F.filter(F.transform("firsts", lambda first, i: F.when(first < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull())
    hits = hits.select("doc_id", "key", repeated.alias("starts")).filter(F.size("starts") > 0)
    repeats = written(hits.groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_set("starts"))).alias("starts")), "repeats")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas = [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
                words = words_of(text)
                keep = kept_mask(len(words), starts, span)
                removed.append(int(len(words) - keep.sum()))
                shas.append(hashlib.sha256(b" ".join(words[i] for i in np.flatnonzero(keep))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(removed, pa.int64()), pa.array(shas), batch.column("starts")], ["doc_id", "key", "removed", "sha_left", "starts"])

    changed = texts.select("doc_id", "key", "text").join(repeats, ["doc_id", "key"]).mapInArrow(rest, "doc_id long, key binary, removed long, sha_left string, starts array<long>")
    changed = changed.dropDuplicates(["doc_id", "key"])  # rows that repeat id and text
    out = placed.drop("anchors").join(changed, ["doc_id", "key"], "left")
    gone = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0)))
    sha = F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha_left", "sha"))
    return out.select("doc_id", "n_words", gone.cast("long").alias("n_removed"), sha.alias("kept_sha256"), F.when(~F.col("copy"), F.col("starts")).alias("starts"))


def kept_mask(n: int, starts: list[int], span: int) -> np.ndarray:
    """Which of ``n`` words no repeated window covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.asarray(starts, np.int64), 1)
    np.add.at(edge, np.asarray(starts, np.int64) + span, -1)
    return np.cumsum(edge[:n]) == 0


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM g) WHERE first < doc_id
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM r
), k AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN c USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
