"""Evaluation texts that leak into a corpus, found with an FM-index over each shard."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arqueo.session import empty, ship, written

#: Every how many places of the text the index keeps a suffix position.
SAMPLE = 16
#: Words after which a shard is closed.
SHARD_WORDS = 1_000_000
#: Phrases that a search of all shards takes at a time.
BLOCK_PHRASES = 100_000
_WORD = re.compile(r"[^\W_]+")


@cache
def _dropped() -> dict[int, None]:
    """Marks and invisible characters, for str.translate."""
    return {i: None for i in range(0x110000) if unicodedata.combining(chr(i)) or unicodedata.category(chr(i)) in ("Cf", "Mn")}


def words(text: str | None) -> list[str]:
    """The runs of letters or digits, without letter case, accents, full-width forms and invisible characters."""
    if not text:
        return []
    if not text.isascii():
        return _WORD.findall(unicodedata.normalize("NFKD", text).translate(_dropped()).casefold())
    return _WORD.findall(text.lower())


def word_hashes(ws: list[str]) -> np.ndarray:
    """64 bits for each word, by which all shards and phrases know it."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in ws], np.uint64).view(np.int64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling; a round only sorts the suffixes that are still tied. s ends with a symbol smaller than all others."""
    n = len(s)
    bits = max(1, int(s.max()).bit_length())
    k = min(n, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(k):
        key <<= bits
        key[: n - j] |= s[j:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(tied):
            return order
        p = order[tied]
        after = np.where(p + k < n, rank[np.minimum(p + k, n - 1)], -1)
        o = np.lexsort((after, rank[p]))
        p, a, b = p[o], rank[p][o], after[o]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        order[tied], head[tied] = p, new
        rank[p] = np.maximum.accumulate(np.where(new, tied, 0))
        k *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, in as many steps as a symbol has bits."""

    def __init__(self, s: np.ndarray, bits: int) -> None:
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (s >> b) & 1
            ones = np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32)
            zeros = len(s) - int(ones[-1])
            self.levels.append((b, ones, zeros))
            s = np.concatenate((s[bit == 0], s[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end; both are arrays."""
        begin, end = np.zeros_like(end), end.copy()
        for b, ones, zeros in self.levels:
            one = ((symbol >> b) & 1).astype(bool)
            begin = np.where(one, zeros + ones[begin], begin - ones[begin])
            end = np.where(one, zeros + ones[end], end - ones[end])
        return end - begin


class FMIndex:
    """Of a sequence of symbols from 1 on, which this class ends with a 0; or of what ``dump`` kept of one."""

    def __init__(self, s: np.ndarray | None, alphabet: int, kept: tuple[bytes, bytes, bytes] | None = None) -> None:
        if s is not None:
            s = np.concatenate((s, [0])).astype(np.int64)
            sa = suffix_array(s)
            self.bwt = s[sa - 1]
            self.sampled = sa % SAMPLE == 0
            self.positions = sa[self.sampled]
        else:
            self.bwt, self.positions = (np.frombuffer(x, np.int32).astype(np.int64) for x in kept[:2])
            self.sampled = np.unpackbits(np.frombuffer(kept[2], np.uint8), count=len(self.bwt)).astype(bool)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(self.bwt, minlength=alphabet + 1))))
        self.alphabet = alphabet

    def __getattr__(self, name: str):
        # What only searches need.
        if name == "tree":
            self.tree = WaveletMatrix(self.bwt, max(1, int(self.alphabet).bit_length()))
            return self.tree
        if name == "place":
            self.place = np.cumsum(self.sampled) - 1
            return self.place
        raise AttributeError(name)

    def dump(self) -> tuple[bytes, bytes, bytes]:
        return self.bwt.astype(np.int32).tobytes(), self.positions.astype(np.int32).tobytes(), np.packbits(self.sampled).tobytes()

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase (a row of phrases), for all phrases at a time, from their ends."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        live = np.arange(len(phrases))
        for c in phrases.T[::-1]:
            x = c[live]
            lo[live] = self.first[x] + self.tree.rank(x, lo[live])
            hi[live] = self.first[x] + self.tree.rank(x, hi[live])
            live = live[lo[live] < hi[live]]
        dead = np.ones(len(phrases), bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text of suffixes: steps back to a sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            hit = self.sampled[at]
            out[open_[hit]] = self.positions[self.place[at[hit]]] + steps[open_[hit]]
            open_, at = open_[~hit], at[~hit]
            c = self.bwt[at]
            rows[open_] = self.first[c] + self.tree.rank(c, at)
            steps[open_] += 1
        return out


def shard_index(corpus: DataFrame, doc_id: str, text: str, n_words: int) -> DataFrame:
    """The FM-indexes of a corpus, one row for each shard of about SHARD_WORDS words: ids and starts of its documents, its vocabulary
    (hashes of words in order, whose places are the symbols) and the index. Documents of fewer than n_words words are left out.

    It doesn't depend on what is searched for: written once, it serves any number of evaluation sets. The corpus isn't shuffled.
    """
    kind = corpus.schema[doc_id].dataType.simpleString()
    docs = corpus.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")

    def shard(ids: list, seqs: list, vocabulary: dict[str, int]):
        import pandas as pd

        hashes = word_hashes(list(vocabulary))
        order = np.argsort(hashes)
        symbol = np.empty(len(order), np.int64)
        symbol[order] = np.arange(len(order)) + 2
        symbol = np.append(symbol, 1)  # a separator ends each document
        starts = np.cumsum([0, *map(len, seqs)])
        index = FMIndex(symbol[np.concatenate(seqs)], len(order) + 1)
        return pd.DataFrame([(ids, starts.astype(np.int32).tobytes(), hashes[order].tobytes(), *index.dump())], columns=["ids", "starts", "vocabulary", "bwt", "positions", "sampled"])

    def run(batches):
        ids, seqs, vocabulary, size = [], [], {}, 0
        for batch in batches:
            for i, t in zip(batch["doc_id"], batch["text"], strict=True):
                ws = words(t)
                if len(ws) < n_words:
                    continue
                seqs.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws] + [-1], np.int64))
                ids.append(i)
                size += len(ws) + 1
                if size >= SHARD_WORDS:
                    yield shard(ids, seqs, vocabulary)
                    ids, seqs, vocabulary, size = [], [], {}, 0
        if ids:
            yield shard(ids, seqs, vocabulary)

    return docs.mapInPandas(run, f"ids array<{kind}>, starts binary, vocabulary binary, bwt binary, positions binary, sampled binary")


def phrases_of(items: DataFrame, item_id: str, text: str, n_words: int) -> DataFrame:
    """item_id, phrase (the hashes of n_words consecutive words) and key of every phrase of the items."""
    kind = items.schema[item_id].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for batch in batches:
            ids, out = [], []
            for i, t in zip(batch["item_id"], batch["text"], strict=True):
                h = word_hashes(words(t))
                if len(h) >= n_words:
                    windows = np.unique(np.lib.stride_tricks.sliding_window_view(h, n_words), axis=0)
                    ids += [i] * len(windows)
                    out += list(windows)
            if ids:
                yield pd.DataFrame({"item_id": ids, "phrase": out})

    x = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    return x.mapInPandas(run, f"item_id {kind}, phrase array<bigint>").distinct().withColumn("key", F.xxhash64("phrase"))


def leaked_spans(corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, n_words: int = 12) -> DataFrame:
    """The stretches of corpus texts that share ``n_words`` consecutive words with evaluation texts.

    Each task gathers documents into shards and writes an FM-index of each (``shard_index``). The items' phrases are a table as
    well; they go to the shards in blocks of about BLOCK_PHRASES, one row that is broadcast, and each block reads the written indexes again, but no text.
    All phrases of a block are searched backward at a time through the wavelet matrix; those with a word that a shard lacks drop out at once.
    Occurrences are located from sampled suffix positions, joined with the items of their phrases, and overlapping or adjoining ones of
    one item merged. A text with fewer words than a phrase holds none; null and empty texts and items give no rows. Words and
    phrases count as equal if their 64-bit hashes are. Result: doc_id, item_id, first_word, last_word (places among the document's words, from 0).
    """
    ship(corpus.sparkSession)
    kind = corpus.schema[doc_id].dataType.simpleString()
    owners = written(phrases_of(items, item_id, item_text, n_words), "phrases")
    distinct = owners.select("phrase", "key").distinct()
    n_blocks = -(-distinct.count() // BLOCK_PHRASES)
    index = written(shard_index(corpus, doc_id, text, n_words), "shards") if n_blocks else None
    blocks = distinct.groupBy(F.pmod("key", F.lit(max(1, n_blocks))).alias("block")).agg(F.flatten(F.collect_list("phrase")).alias("phrases"), F.collect_list("key").alias("keys"))
    blocks = written(blocks, "blocks") if n_blocks else None
    schema = f"doc_id {kind}, key bigint, place int"
    found = empty(corpus.sparkSession, schema)
    for b in range(n_blocks):
        # One row of at most about BLOCK_PHRASES phrases.
        both = index.crossJoin(F.broadcast(blocks.filter(F.col("block") == b).drop("block")))
        found = found.union(both.mapInPandas(_search(n_words), schema))
    hits = found.distinct().join(owners.select("item_id", "key"), "key").select("doc_id", "item_id", "place").distinct()
    w = Window.partitionBy("doc_id", "item_id").orderBy("place")
    new = F.coalesce(F.col("place") > F.lag("place").over(w) + n_words, F.lit(True))
    runs = hits.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w))
    spans = runs.groupBy("doc_id", "item_id", "run").agg(F.min("place").alias("first_word"), (F.max("place") + (n_words - 1)).alias("last_word"))
    return spans.drop("run")


def _search(n: int):
    def run(batches):
        import pandas as pd

        for batch in batches:
            for r in batch.itertuples(index=False):
                vocabulary = np.frombuffer(r.vocabulary, np.int64)
                phrases = np.asarray(r.phrases, np.int64).reshape(-1, n)
                symbols = np.minimum(np.searchsorted(vocabulary, phrases), len(vocabulary) - 1)
                whole = np.flatnonzero((vocabulary[symbols] == phrases).all(axis=1))
                if not len(whole):
                    continue
                index = FMIndex(None, len(vocabulary) + 1, (r.bwt, r.positions, r.sampled))
                lo, hi = index.search(symbols[whole] + 2)
                hit = np.flatnonzero(hi > lo)
                if not len(hit):
                    continue
                which = np.repeat(hit, hi[hit] - lo[hit])
                at = index.locate(np.concatenate([np.arange(lo[k], hi[k]) for k in hit]))
                starts = np.frombuffer(r.starts, np.int32)
                doc = np.searchsorted(starts, at, "right") - 1
                yield pd.DataFrame({"doc_id": np.asarray(r.ids, object)[doc], "key": np.asarray(r.keys, np.int64)[whole[which]], "place": (at - starts[doc]).astype(np.int32)})

    return run
