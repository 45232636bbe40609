"""Evaluation texts leaking into training text: greedy string tiling.

Seeds are windows of `least` words. The windows of the test items are a table of
(hash, item); documents are read once, whatever the size of the test set, and
those with windows in a Bloom filter of that table go on to a join on the hash.
Every pair of a document and an item that share a window is then tiled."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_keys
from ..session import cut, rows_written, ship

if TYPE_CHECKING:
    import numpy as np
    import pandas as pd

WORD = re.compile(r"[A-Za-z0-9_]+")
#: Bits of the filter for each window of the test items, and its bounds: at most
#: 64 MB go to the executors. A larger test set lets more documents through to
#: the join, which decides.
BITS, LEAST_BITS, MOST_BITS = 32, 16, 29
_SEGMENT = 15  # bits of a filter segment's size
#: Words that are hashed at once.
_CHUNK = 1 << 20
#: Parts into which the documents of a hot window are split.
SALT = 32
#: Pairs that one task tiles.
PAIRS = 500

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPREAD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)


def words(text: str | None) -> list[str]:
    """Longest runs of A-Z, a-z, 0-9 and underscore, in lower case."""
    return [w.lower() for w in WORD.findall(text)] if text else []


class _Codes(dict):
    """Word -> 64-bit code."""

    def __missing__(self, w: str) -> int:
        b = w.encode()
        code = (zlib.crc32(b) << 32 | zlib.crc32(b + b"\x00", 0x5BD1E995)) * 0xFF51AFD7ED558CCD % (1 << 64)
        if len(self) < 300_000:
            self[w] = code
        return code


_CODES = _Codes()


def windows(texts: list[str | None], m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hash) of all windows of m words: Karp-Rabin hashes modulo 2^64, for
    many texts at once by running sums."""
    import numpy as np

    get, codes, lens, ids = _CODES.__getitem__, [], [], []

    def hashes():
        c = np.array(codes, dtype=np.uint64)
        n = len(c)
        up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, _INVERSE, dtype=np.uint64)
        up[:1] = down[:1] = 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * np.cumprod(up))])
        size = np.array(lens)
        whole = np.repeat(np.cumsum(size), size)  # where each word's text ends
        at = np.flatnonzero(np.arange(n) + m <= whole)
        return np.repeat(np.array(ids), size)[at], (sums[at + m] - sums[at]) * np.cumprod(down)[at]

    for i, t in enumerate(texts):
        w = list(map(get, WORD.findall(t.lower()))) if t else []
        if len(w) < m:
            continue
        codes += w
        lens.append(len(w))
        ids.append(i)
        if len(codes) >= _CHUNK:
            yield hashes()
            codes, lens, ids = [], [], []
    if codes:
        yield hashes()


def _bit(h: np.ndarray, k: int, spread: int) -> np.ndarray:
    """The place of each hash in a filter of 2^k bits."""
    import numpy as np

    return (h * np.uint64(spread)) >> np.uint64(64 - k)


def _filter(seeds: DataFrame, n: int) -> tuple[bytes, int]:
    """A Bloom filter of seeds.h, made on the executors segment by segment; and
    the number of its bits as a power of two."""
    import numpy as np

    k = min(MOST_BITS, max(LEAST_BITS, (BITS * max(1, n) - 1).bit_length()))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        bits = np.zeros(1 << (k - 3), np.uint8)
        for b in batches:
            h = b["h"].to_numpy().astype(np.uint64)
            for at in (_bit(h, k, x) for x in _SPREAD):
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (np.uint64(1) << (at & np.uint64(7))).astype(np.uint8))
        for s, seg in enumerate(bits.reshape(-1, 1 << (_SEGMENT - 3))):
            if seg.any():
                yield pd.DataFrame({"s": [s], "bits": [seg.tobytes()]})

    def unite(b: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        seg = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in b["bits"]])
        return pd.DataFrame({"s": b["s"][:1], "bits": [seg.tobytes()]})

    parts = seeds.select("h").mapInPandas(mark, "s int, bits binary").groupBy("s").applyInPandas(unite, "s int, bits binary")
    out = bytearray(1 << (k - 3))
    for s, seg in parts.collect():  # at most 2^MOST_BITS bits
        out[s << (_SEGMENT - 3) : (s + 1) << (_SEGMENT - 3)] = seg
    return bytes(out), k


def _seeds(m: int):
    """For mapInPandas over items (k, t, i): their distinct windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        for b in batches:
            i = b["i"].to_numpy()
            for at, h in windows(b["t"].tolist(), m):
                yield pd.DataFrame({"h": h.astype(np.int64), "i": i[at]}).drop_duplicates()

    return run


def _candidates(sent, k: int, m: int):
    """For mapInPandas over documents: those with windows in the filter, and the
    distinct hashes of these windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        bits = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            got: dict[int, np.ndarray] = {}
            for at, h in windows(b["text"].tolist(), m):
                for x in _SPREAD:
                    p = _bit(h, k, x)
                    on = (bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    at, h = at[on], h[on]
                    if not len(h):
                        break
                for t in np.unique(at):
                    got[int(t)] = np.unique(h[at == t]).astype(np.int64)
            rows = sorted(got)
            if rows:
                yield b.iloc[rows].assign(hs=[got[i].tolist() for i in rows])

    return run


def tile(doc: list[str], item: list[str], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word lists: the longest match of free words
    is marked first, the earliest of equally long ones, until no free match of
    `least` words is left; words of a tile belong to it alone. Returns (place in
    document, place in item, length).

    Matches are kept as runs along diagonals, so a text of one repeated word
    has as many as it has places, not as it has pairs of places. Only stretches
    of the document that are made of the item's words are looked at."""
    import numpy as np

    vocab: dict[str, int] = {}
    b = np.array([vocab.setdefault(w, len(vocab) + 1) for w in item], dtype=np.int32)
    a = np.array([vocab.get(w, 0) for w in doc], dtype=np.int32)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (a > 0).astype(np.int8), [0]])))
    heap: list[tuple[int, int, int]] = []
    for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if end - start < least:
            continue
        part = a[start:end]
        n = len(part)
        run = np.zeros(n + 1, dtype=np.int32)  # run[d + 1]: length of the match that ends at d, p
        for p in range(len(b) + 1):
            new = np.zeros(n + 1, dtype=np.int32)
            if p < len(b):
                new[1:] = np.where(part == b[p], run[:-1] + 1, 0)
            # a match ends where its diagonal does not go on; the last column has no next
            ends = np.flatnonzero(run[1:] >= least)
            if len(ends):
                over = ends[(ends + 1 >= n) | (new[np.minimum(ends + 2, n)] == 0)]
                for d in over.tolist():
                    k = int(run[d + 1])
                    heap.append((-k, start + d - k + 1, p - k))
            run = new
    heapq.heapify(heap)
    in_doc, in_item = np.zeros(len(a), bool), np.zeros(len(b), bool)
    out: list[tuple[int, int, int]] = []
    free = len(b)
    while heap and free >= least:
        k, d, p = heapq.heappop(heap)
        k = -k
        taken = in_doc[d : d + k] | in_item[p : p + k]
        if not taken.any():
            in_doc[d : d + k] = in_item[p : p + k] = True
            free -= k
            out.append((d, p, k))
            continue
        cut_at = np.flatnonzero(np.diff(np.concatenate([[1], taken.astype(np.int8), [1]])))
        for x, y in zip(cut_at[::2].tolist(), cut_at[1::2].tolist()):
            if y - x >= least:
                heapq.heappush(heap, (x - y, d + x, p + x))
    return out


def _tiler(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for b in batches:
            rows = []
            for doc, text, item, t in zip(b["doc_id"], b["text"], b["item_id"], b["t"]):
                w = words(t)
                got = tile(words(text), w, least)
                if got:
                    rows.append((doc, item, len(got), max(x[2] for x in got), sum(x[2] for x in got), len(w)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_tiles", "longest", "covered", "item_words"])

    return run


def tile_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 12, least_hot: int = 10_000) -> DataFrame:
    """(doc_id, item_id, n_tiles, longest, covered, item_words): every pair of a
    document and a test item that share a run of at least `least` words.

    Documents are read once, as a whole; only those that may share a window are
    written and joined, by the windows' hashes, those of hot windows in parts. An
    id with several texts counts with each. Rows without id, and null or empty
    texts, match nothing. covered counts the item's words in tiles, whatever
    their order, so a reordered copy is covered as well."""
    spark = docs.sparkSession
    ship(spark)
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    it = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("t")).where(F.col("item_id").isNotNull() & F.col("t").isNotNull()).distinct()
    it = cut(it.withColumn("i", F.monotonically_increasing_id()), "items")
    seeds = cut(it.select("t", "i").mapInPandas(_seeds(least), "h long, i long"), "seeds")
    bits, k = _filter(seeds, rows_written(seeds))
    sent = spark.sparkContext.broadcast(bits)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    cand = d.mapInPandas(_candidates(sent, k, least), f"doc_id {kinds[0]}, text string, hs array<bigint>")
    cand = cut(cand.withColumn("d", F.monotonically_increasing_id()), "candidates")
    left, right = cand.select("d", F.explode("hs").alias("h")), seeds.select(F.col("h").alias("_h"), "i")
    hot = hot_keys(left, "h", least=least_hot)
    if hot:  # a window that many documents share is joined in parts
        left = left.withColumn("salt", F.when(F.col("h").isin(hot), F.pmod(F.hash("d"), F.lit(SALT))).otherwise(0))
        last = F.when(F.col("_h").isin(hot), SALT - 1).otherwise(0)
        right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
        pairs = left.join(right, (F.col("h") == F.col("_h")) & (F.col("salt") == F.col("_salt")))
    else:
        pairs = left.join(right, F.col("h") == F.col("_h"))
    pairs = cut(pairs.select("d", "i").distinct(), "pairs")
    # tiling is work by the pair, not by the byte
    pairs = pairs.repartition(rows_written(pairs) // PAIRS + 1)
    full = pairs.join(cand.select("d", "doc_id", "text"), "d").join(it, "i").select("doc_id", "text", "item_id", "t")
    return full.mapInPandas(_tiler(least), f"doc_id {kinds[0]}, item_id {kinds[1]}, n_tiles int, longest int, covered int, item_words int")
