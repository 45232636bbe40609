"""Mixing sources to target weights: raking and calibrated sampling."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, ship

if TYPE_CHECKING:
    import numpy as np
    import pandas as pd

#: Bound of what the driver takes: combinations of source, language and topic.
MOST_CELLS = 200_000
#: Steps of the score by which documents of a source are taken.
STEPS = 4096


# Fixed value: how byte-level BPE vocabularies of this family split text before
# merging.
_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=4)
def _counter(path: str):
    """A function from texts to token counts for a tokenizer file: .tiktoken
    (ranks of a byte-level BPE), .json (tokenizers) or .model (sentencepiece)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [len(encode(x)) for x in texts]
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """docs with text replaced by n_tokens (a column of that name goes). Null and
    empty texts have 0 tokens."""
    keep = [f for f in docs.schema.fields if f.name not in (text, "n_tokens")]
    schema = T.StructType([*keep, T.StructField("n_tokens", T.LongType())])
    names = [f.name for f in keep]
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _counter(tokenizer)
        for b in batches:
            got = b[names].copy()
            got["n_tokens"] = count(b[text].fillna("").tolist()) if len(b) else []
            got["n_tokens"] = got["n_tokens"].astype("int64")
            yield got

    return docs.mapInPandas(run, schema)


def rake(tokens: np.ndarray, levels: Sequence[np.ndarray], targets: Sequence[np.ndarray], caps: np.ndarray, rounds: int = 300, near: float = 1e-9) -> np.ndarray:
    """Iterative proportional fitting with upper bounds. tokens: of each cell;
    levels: per margin the level of each cell; targets: per margin the tokens
    wanted of each level; caps: the largest weight of each cell. Returns each
    cell's weight (expected copies). The first margin is met last and, where the
    bounds allow, exactly; the others as nearly as it and the bounds allow."""
    import numpy as np

    w = np.minimum(1.0, caps)

    def fit(lv: np.ndarray, want: np.ndarray) -> None:
        # what is too much comes off all cells of a level; what is missing is
        # shared by the cells below their bound
        for _ in range(60):
            got = np.bincount(lv, weights=w * tokens, minlength=len(want))
            free = w < caps * (1 - 1e-12)
            room = np.bincount(lv[free], weights=(w * tokens)[free], minlength=len(want))
            down = np.divide(want, got, out=np.ones(len(want)), where=got > 0)
            up = np.divide(want - got + room, room, out=np.ones(len(want)), where=room > 0)
            new = np.where((want < got)[lv], w * down[lv], np.where(free, w * up[lv], w))
            new = np.minimum(new, caps)
            if np.allclose(new, w, rtol=1e-12, atol=0):
                break
            w[:] = new

    for _ in range(rounds):
        before = w.copy()
        for lv, want in list(zip(levels, targets))[1:]:
            fit(lv, want)
        fit(levels[0], targets[0])
        if np.max(np.abs(w - before)) < near:
            break
    return w


class Mixture:
    """A mixture of documents (doc_id, source, lang, topic, n_tokens) for targets
    (source, target_share, max_repeats).

    Sources without a target, and documents of no source, take no part. Listed
    sources without tokens cannot reach their share: their part is spread over
    the others in proportion, and the report shows both. total is the wished
    size in tokens; by default the largest at which no source needs more than
    max_repeats copies of its documents. lang and topic keep the shares they
    have among all tokens of the listed sources, as far as the targets allow."""

    def __init__(self, sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 1) -> None:
        import numpy as np

        self.seed = seed
        rows = [r for r in targets.select("source", "target_share", "max_repeats").collect() if r[0] is not None]
        self.share, self.cap = {}, {}
        for s, a, m in rows:  # a source listed twice adds up and takes the larger cap
            self.share[s] = self.share.get(s, 0.0) + max(0.0, a or 0.0)
            self.cap[s] = max(self.cap.get(s, 0), int(m or 0))
        sized = sized.select("doc_id", "source", "lang", "topic", "n_tokens")
        self.sized = sized.where(F.col("source").isin(list(self.share)) & (F.col("n_tokens") > 0) & F.col("doc_id").isNotNull())
        cells = self.sized.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        got = cells.limit(MOST_CELLS + 1).collect()
        if len(got) > MOST_CELLS:
            raise ValueError(f"more than {MOST_CELLS} combinations of source, lang and topic: use coarser topics")
        self.keys = [(r[0], r[1], r[2]) for r in got]
        tokens = np.array([r[3] for r in got], dtype=float)
        self.have: dict[str, float] = {}
        for (s, _, _), t in zip(self.keys, tokens):
            self.have[s] = self.have.get(s, 0.0) + t
        able = {s: a for s, a in self.share.items() if self.have.get(s) and a > 0 and self.cap[s] > 0}
        whole = sum(able.values())
        self.want: dict[str, float] = {}
        self.weights = np.zeros(len(got))
        if not able:
            return
        most = min(self.cap[s] * self.have[s] * whole / a for s, a in able.items())
        self.total = most if total is None else float(total)
        self.want = {s: self.total * a / whole for s, a in able.items()}
        margins = []
        for i in range(3):
            names = sorted({k[i] for k in self.keys}, key=lambda x: (x is None, x or ""))
            at = {x: j for j, x in enumerate(names)}
            lv = np.array([at[k[i]] for k in self.keys])
            if i == 0:
                want = np.array([self.want.get(x, 0.0) for x in names])
            else:
                want = np.bincount(lv, weights=tokens, minlength=len(names)) / tokens.sum() * self.total
            margins.append((lv, want))
        caps = np.array([float(self.cap[k[0]]) if k[0] in able else 0.0 for k in self.keys])
        self.weights = rake(tokens, [m[0] for m in margins], [m[1] for m in margins], caps)

    def _weighted(self) -> DataFrame:
        """Documents with their calibrated weight w, base copies, and the score
        by which one more copy is given."""
        spark = self.sized.sparkSession
        rows = [(*k, float(w), self.cap[k[0]]) for k, w in zip(self.keys, self.weights)]
        cells = spark.createDataFrame(rows, "_s string, _l string, _t string, w double, cap int")
        j = self.sized.join(F.broadcast(cells), (F.col("source") == F.col("_s")) & F.col("lang").eqNullSafe(F.col("_l")) & F.col("topic").eqNullSafe(F.col("_t")))
        u = F.pmod(F.xxhash64("doc_id", F.lit(self.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        base = F.floor("w")
        step = F.floor((F.col("w") - base - u) * STEPS).cast("int")
        step = F.when(base >= F.col("cap"), F.lit(None)).otherwise(step)
        return j.select("doc_id", "source", "lang", "topic", "n_tokens", "w", base.cast("int").alias("base"), step.alias("step"))

    def sample(self) -> DataFrame:
        """(doc_id, source, n_tokens, copies): documents with their copies."""
        return self._copies().select("doc_id", "source", "n_tokens", "copies")

    def _copies(self) -> DataFrame:
        """sample() with lang and topic.

        A document of weight w gets floor(w) copies and one more with the
        probability of the rest, by a hash of its id; the cut of each source's
        score is then set so that its tokens come as near to the target as the
        documents allow. Only sums of at most 2 x 4096 steps a source are
        gathered; documents are never sorted or moved."""
        x = self._weighted()
        sums = x.groupBy("source", "step").agg(F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * F.col("base")).alias("b")).collect()
        cut = {}
        for s in self.want:
            mine = [r for r in sums if r[0] == s]
            left = self.want[s] - sum(r[3] for r in mine)
            best, at, acc = abs(left), STEPS * 2, 0.0
            for r in sorted((r for r in mine if r[1] is not None), key=lambda r: -r[1]):
                acc += r[2]
                if abs(left - acc) < best:
                    best, at = abs(left - acc), r[1]
            cut[s] = at
        if not cut:
            return x.select("doc_id", "source", "lang", "topic", "n_tokens", F.lit(0).alias("copies")).where(F.lit(False))
        at = F.create_map(*[F.lit(v) for kv in cut.items() for v in kv])[F.col("source")]
        copies = F.col("base") + F.coalesce((F.col("step") >= at).cast("int"), F.lit(0))
        return x.select("doc_id", "source", "lang", "topic", "n_tokens", copies.cast("int").alias("copies")).where(F.col("copies") > 0)

    def report(self) -> DataFrame:
        """Per listed source, and per language and topic of the listed sources'
        texts (margin and level tell which): target_share, what there was, what
        was taken, the actual share and the most copies of a document. A source
        without tokens keeps its target in the report and its share is 0; targets
        of languages and topics are their shares of all tokens there are."""
        x = self._copies()
        used = [F.count(F.lit(1)).alias("docs_used"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_repeats")]
        out = None
        for m in ("source", "lang", "topic"):
            got = x.groupBy(F.col(m).alias("_l")).agg(*used)
            have = self.sized.groupBy(F.col(m).alias("level")).agg(F.sum("n_tokens").alias("tokens_available"))
            if m == "source":
                rows = [(k, float(a), int(self.cap[k])) for k, a in sorted(self.share.items())]
                t = self.sized.sparkSession.createDataFrame(rows, "_s string, target_share double, max_repeats int")
                have = t.join(have, F.col("_s") == F.col("level"), "left").select(F.col("_s").alias("level"), "target_share", "max_repeats", F.coalesce("tokens_available", F.lit(0)).alias("tokens_available"))
            else:
                whole = float(sum(self.have.values()) or 1)
                have = have.select("level", (F.col("tokens_available") / F.lit(whole)).alias("target_share"), F.lit(None).cast("int").alias("max_repeats"), "tokens_available")
            j = have.join(got, F.col("level").eqNullSafe(F.col("_l")), "left")
            j = j.select(F.lit(m).alias("margin"), "level", "target_share", "max_repeats", "tokens_available", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("docs_used", "tokens", "most_repeats")])
            out = j if out is None else out.unionByName(j)
        out = cut(out, "shares")
        total = out.where("margin = 'source'").agg(F.sum("tokens")).first()[0] or 0
        return out.withColumn("actual_share", F.col("tokens") / F.lit(float(total)) if total else F.lit(0.0))
