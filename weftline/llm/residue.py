"""Template residue, filler and error pages: positive-unlabelled naive Bayes.

Passages are lines and sentences outside code and quotations, and, for every
unfilled placeholder, the slot it stands in: the placeholder with the word on
either side. Trusted passages - slots, and passages that begin with the words of
a known error, notice or filler - are positive, all others unlabelled;
expectation-maximization fits the words of both kinds on a bounded sample. The
fitted model alone then decides on every passage of every record: the lists say
what it learns from, not what is found."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

if TYPE_CHECKING:
    import numpy as np
    import pandas as pd

#: Feature buckets of the model: its size on the driver and in each task.
BUCKETS = 1 << 16
ROUNDS = 6
#: Bound of what the model is fitted on: about so many characters of documents
#: taken by a hash of their id. Of a document longer than a hundredth of it so
#: many passages, spread over its whole length, are taken. All documents are
#: scored, as a whole.
SAMPLE_CHARS = 32_000_000

# Delimiters of placeholders, with what may stand between them.
_NAME = r"[A-Za-z][A-Za-z0-9_]*"
_WORDS = r"[A-Za-z][A-Za-z0-9_ ]{0,40}"
PLACEHOLDERS = [
    r"\{\{-?\s*[A-Za-z][\w.]*\s*-?\}\}",
    r"\{%-?\s*[A-Za-z][\w. ]*\s*-?%\}",
    rf"<%=?\s*{_NAME}\s*%>",
    rf"\$\{{{_NAME}\}}",
    rf"\$\({_NAME}\)",
    rf"#\{{{_NAME}\}}",
    rf"%\({_NAME}\)[sdf]",
    rf"%%{_NAME}%%",
    rf"@@{_NAME}@@",
    r"(?<!\w)__[A-Z][A-Z0-9_]*?__(?!\w)",
    rf"\[\[\s*{_NAME}\s*\]\]",
    rf"<<\s*{_NAME}\s*>>",
    rf"«{_NAME}»",
    r"<(?:insert|add|your|enter|fill in)\s[\w ]{1,40}>",
    r"<[A-Z][A-Z0-9_]+>",
    r"\[(?:[Yy]our|[Ii]nsert|[Aa]dd|[Ee]nter)\s[\w ]{1,40}\]",
    r"\[[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*\](?!\()",
    rf"(?<![\w$#%]){{{_NAME}}}",
    r"\((?:add|insert|enter|fill in)\s[a-z_]+\)",
]
#: Words of filler text in place of content.
FILLER_WORDS = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum asdf qwer blah xxxx".split()
)
#: Trusted records: passages that begin with such words are error pages,
#: notices or filler whatever else stands around them.
TRUSTED = [
    r"(?:error\s+)?[45]\d\d\b(?=\s*(?:-|:|–|error|upstream|not found|bad gateway|forbidden|internal|service))",
    r"error [45]\d\d\b",
    r"page not found\b",
    r"access (?:is )?denied(?:[.!]|$)",
    r"toegang geweigerd\b",
    r"zugriff verweigert\b",
    r"acc[eè]s refus[eé]\b",
    r"acceso denegado\b",
    r"service (?:is )?(?:temporarily )?(?:down|unavailable)\b",
    r"(?:your )?session has (?:ended|expired)\b",
    r"(?:please )?(?:turn on|enable|activate) (?:java)?scripts?\b",
    r"you need to enable (?:java)?script",
    r"javascript (?:is|must be) (?:required|enabled|disabled)",
    r"noscript\b",
    r"this (?:app|page|site) (?:does not|doesn't) work without (?:js|javascript|scripts?)\b",
    r"bitte aktivieren sie javascript",
    r"activez (?:les scripts|javascript)",
    r"activ[ae] (?:los scripts|javascript)",
    r"zet (?:scripts|javascript) aan",
    r"seite nicht gefunden",
    r"page introuvable",
    r"pagina niet gevonden",
    r"p[áa]gina no encontrada",
    r"(?:placeholder|dummy|sample|filler) (?:copy|text|paragraph|content)\b.{0,40}$",
    r"blindtext\b",
    r"texte provisoire\b",
    r"voorbeeldtekst\b",
    r"texto de ejemplo\b",
    r"description goes here",
    r"to be filled in\b",
]

_PH = re.compile("|".join(PLACEHOLDERS))
#: A sign without which no placeholder can be there.
_PH_SIGN = re.compile(r"[{<\[$%#@«(]|__")
_TRUSTED = re.compile("(?:" + "|".join(TRUSTED) + ")", re.I)
_FENCE = re.compile(r"(?m)^[^\w\n]*(```|~~~)[^\n]*\n.*?(?:^[^\w\n]*\1[^\n]*$|\Z)", re.S)
_QUOTED = re.compile(r"`+[^`\n]+`+|\"[^\"\n]{0,200}\"|“[^”\n]{0,200}”")
_IDENT = re.compile(r"\b(?:[A-Za-z]\w*\.)+[A-Za-z]\w*\b|\b[A-Za-z]+_\w+\b")
#: A name as a title, with text behind it on the same line: line ends are lost
#: there, so a known phrase begins a passage of its own.
_TITLE = re.compile(r"(?m)^(\W*#\s+\x02)[ \t]+(\w.*)$")
_INNER = re.compile(r"\s+(?=[A-Z])(?=(?i:" + "|".join(TRUSTED) + "))")
_BREAK = r"[\n\r]+|(?<=[.!?]) +"
_SPLIT = re.compile(_BREAK)
_WORD = re.compile(r"[^\W\d_]+|\d+|\x01|\x02|[|@#%{}<>\[\]]")
_REAL = re.compile(r"[^\W_]|[\x02|@#%{}<>\[\]]")
_TOKEN = re.compile(_WORD.pattern + "|" + _BREAK)
_LEAD = re.compile(r"^[\s\-*>#|0-9.)]*")


def visible(text: str) -> str:
    """The text without code and quotations, in which placeholders and error
    messages are talked about, not left over. Placeholders become \\x01; names
    with dots or underscores, and quotations, \\x02."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "`" in text or '"' in text or "“" in text:
        text = _QUOTED.sub(" \x02 ", text)
    if _PH_SIGN.search(text):
        text = _PH.sub("\x01", text)
    text = _IDENT.sub("\x02", text)
    return _TITLE.sub(lambda m: m[1] + "\n" + _INNER.sub("\n", m[2]), text) if "#" in text else text


def passages(text: str | None) -> list[str]:
    """Lines and sentences of the visible text that hold a word."""
    return [p for p in _SPLIT.split(visible(text or "")) if _WORD.search(p)]


def trusted(passage: str, known: re.Pattern = _TRUSTED) -> bool:
    """Whether a passage is an error, notice or filler by the lists. A name of a
    table or column makes it prose about something."""
    if "\x02" in passage:
        return False
    body = passage.strip() if re.match(r"\W*[45]\d\d\b", passage) else _LEAD.sub("", passage)
    if known.match(body.lstrip(" -*>#|")):
        return True
    w = [x.lower() for x in _WORD.findall(body) if x[0].isalpha()]
    return len(w) >= 3 and sum(x in FILLER_WORDS for x in w) >= 0.8 * len(w)


class _Codes(dict):
    """Token -> 32-bit code; numbers are one word, breaks are 0."""

    def __missing__(self, t: str) -> int:
        c = t[0]
        if c in "\n\r ":
            code = 0
        elif c.isdigit():
            code = zlib.crc32(b"0")
        else:
            code = zlib.crc32(t.encode("utf-8", "surrogatepass")) or 1
        if len(self) < 300_000:
            self[t] = code
        return code


_CODES = _Codes()
_HOLE = zlib.crc32(b"\x01")


def encode(texts: list[str | None], seen: bool = False):
    """Passages of texts (as visible() gives them, if seen) as numbers: doc (which text each is of), slot (whether
    it is the slot of a placeholder), size (its words), feats (hashed words and
    word pairs of all passages, one after the other) and owner (the passage of
    each feature). Placeholders count in their slots only."""
    import numpy as np

    get, codes, lens = _CODES.__getitem__, [], []
    for t in texts:
        if t:
            c = list(map(get, _TOKEN.findall((t if seen else visible(t)).lower())))
            c.append(0)
        else:
            c = [0]
        codes += c
        lens.append(len(c))
    c = np.array(codes, dtype=np.uint64)
    n = len(c)
    text_of = np.repeat(np.arange(len(texts)), lens)
    stop, hole = c == 0, c == _HOLE
    seg = np.cumsum(stop) - stop  # the segment each token belongs to; its break closes it
    word = ~stop & ~hole
    size = np.bincount(seg, weights=word, minlength=int(seg[-1]) + 1 if n else 0).astype(np.int64)
    doc_of_seg = text_of[np.flatnonzero(stop)] if n else np.zeros(0, np.int64)
    used = size > 0
    number = np.cumsum(used) - 1
    bucket = lambda a: (a % BUCKETS).astype(np.int64)
    pair = lambda a, b: bucket((a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40))
    at = np.flatnonzero(word)
    two = np.flatnonzero(word[:-1] & word[1:]) if n else at
    holes = np.flatnonzero(hole)
    first = int(used.sum())
    slot_id = first + np.arange(len(holes))
    before = holes[(holes > 0) & ~stop[holes - 1]] if len(holes) else holes
    after = holes[~stop[holes + 1]] if len(holes) else holes
    rank = {int(h): i for i, h in enumerate(holes)}
    of = lambda hs: np.array([first + rank[int(h)] for h in hs], dtype=np.int64)
    feats = [bucket(c[at]), pair(c[two], c[two + 1]), bucket(c[holes]), pair(c[before - 1], c[before]), pair(c[after], c[after + 1])]
    owner = [number[seg[at]], number[seg[two]], slot_id, of(before), of(after)]
    doc = np.concatenate([doc_of_seg[used], text_of[holes]])
    slot = np.concatenate([np.zeros(first, bool), np.ones(len(holes), bool)])
    return doc, slot, np.concatenate([size[used], np.zeros(len(holes), np.int64)]), np.concatenate(feats), np.concatenate(owner)


def _thinned(text: str, most: int) -> str:
    """text, or passages of it of about `most` characters in all."""
    if len(text) <= most:
        return text
    part = most / len(text) * (1 << 32)
    return "\n".join(p for i, p in enumerate(passages(text)) if i * 2654435761 % (1 << 32) < part)


def _sampled(known: re.Pattern, most: int):
    """For mapInPandas over texts: their encoded passages, a row per batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        for b in batches:
            texts = [visible(_thinned(t, most)) for t in b["text"] if t]
            if not texts:
                continue
            doc, slot, _, feats, owner = encode(texts, True)
            sure = slot.copy()
            marks = [trusted(p, known) for t in texts for p in _SPLIT.split(t) if _REAL.search(p)]
            sure[: len(marks)] = marks
            raw = [x.astype(k).tobytes() for x, k in ((doc, np.int32), (slot, np.int8), (sure, np.int8), (feats, np.int32), (owner, np.int32))]
            yield pd.DataFrame([raw], columns=["doc", "slot", "sure", "feats", "owner"])

    return run


class Model:
    """Log-likelihood ratios of the features and the share of residue passages."""

    def __init__(self, llr: np.ndarray, prior: float) -> None:
        self.llr, self.prior = llr, prior

    def posteriors(self, n: int, doc, slot, feats, owner, inner: int = 4):
        """Of each passage the probability that it is residue. A document mixes
        both kinds in a share of its own, with a Beta prior of two passages at
        the corpus rate; share and probabilities are brought into line by a few
        inner rounds. A slot has even odds to begin with, and says nothing about
        the passages beside it."""
        import numpy as np

        # word pairs repeat what words say: the sum is tempered
        score = np.clip(np.bincount(owner, weights=self.llr[feats], minlength=len(doc)) * 0.5, -30, 30)
        per = np.bincount(doc[~slot], minlength=n)
        share = np.full(n, self.prior)
        p = np.zeros(len(doc))
        for _ in range(inner):
            s = np.clip(np.where(slot, 0.5, share[doc]), 1e-6, 1 - 1e-6)
            p = 1 / (1 + np.exp(-(score + np.log(s / (1 - s)))))
            share = (2 * self.prior + np.bincount(doc, weights=np.where(slot, 0.0, p), minlength=n)) / (2 + per)
        return p


def fit(docs: DataFrame, rounds: int = ROUNDS, sample_chars: int = SAMPLE_CHARS, known: re.Pattern = _TRUSTED) -> Model:
    """The model from a bounded sample of docs (doc_id, text); `known` says which
    passages are trusted. Its size does not grow with the corpus."""
    import numpy as np

    ship(docs.sparkSession)
    most = max(1, sample_chars // 100)
    total = docs.agg(F.sum(F.least(F.length("text"), F.lit(most)))).first()[0] or 0
    part = min(1.0, sample_chars / total) if total else 0.0
    pick = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)))
    got = pick.select("text").mapInPandas(_sampled(known, most), "doc binary, slot binary, sure binary, feats binary, owner binary").collect()
    llr, prior = np.zeros(BUCKETS), 0.01
    if not got:
        return Model(llr, prior)
    cols, n, m = [[] for _ in range(5)], 0, 0
    for r in got:
        x = [np.frombuffer(b, k) for b, k in zip(r, (np.int32, np.int8, np.int8, np.int32, np.int32))]
        for i, v in enumerate((x[0] + n, x[1] > 0, x[2] > 0, x[3], x[4] + m)):
            cols[i].append(v)
        n += int(x[0].max(initial=-1)) + 1
        m += len(x[0])
    del got
    doc, slot, sure, feats, owner = map(np.concatenate, cols)
    del cols
    per = np.maximum(np.bincount(doc[~slot], minlength=n), 1)
    for k in range(rounds):
        if k:
            p = Model(llr, prior).posteriors(n, doc, slot, feats, owner)
        else:
            # what stands in one document with trusted errors or filler starts at
            # their share of it, everything else as content
            p = (np.bincount(doc, weights=sure & ~slot, minlength=n) / per)[doc]
        p = np.where(sure, 1.0, p)
        w = p[owner]
        pos, neg = np.bincount(feats, weights=w, minlength=BUCKETS), np.bincount(feats, weights=1 - w, minlength=BUCKETS)
        prior = min(0.5, max(1e-4, float(p[~slot].mean()) if (~slot).any() else 0.01))
        a, used = 0.5, np.count_nonzero(pos + neg)
        llr = np.log((pos + a * prior) / (pos.sum() + a * prior * used)) - np.log((neg + a) / (neg.sum() + a * used))
        llr[(pos + neg) == 0] = 0.0
    return Model(llr, prior)


def _decide(model: Model, listed: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        for b in batches:
            n = len(b)
            if not n:
                continue
            texts = b["text"].tolist()
            doc, slot, size, feats, owner = encode(texts)
            p = model.posteriors(n, doc, slot, feats, owner)
            words = np.bincount(doc, weights=size, minlength=n)
            bad = np.bincount(doc, weights=size * p, minlength=n)
            holes = np.bincount(doc, weights=slot & (p > 0.5), minlength=n)
            out = {"doc_id": b["doc_id"], "n_words": words.astype("int64"), "placeholders": holes.astype("int64"), "share": np.round(np.divide(bad, words, out=np.zeros(n), where=words > 0), 6)}
            if listed:
                out["listed"] = [any(trusted(x) for x in passages(t)) for t in texts]
            yield pd.DataFrame(out)

    return run


def residue_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, sample_chars: int = SAMPLE_CHARS, model: Model | None = None, listed: bool = False) -> DataFrame:
    """(doc_id, n_words, placeholders, share): per record the words outside code,
    the slots that the model takes for unfilled placeholders, and the share of
    words in passages it takes for residue; with `listed` also whether a passage
    is on the lists, which decides nothing.

    The model is fitted on a bounded sample (fit()); then every record is read
    once, as a whole. Null and empty texts score 0; ids may repeat; rows without
    id are left out."""
    ship(docs.sparkSession)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    model = model or fit(d, rounds, sample_chars)
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInPandas(_decide(model, listed), f"doc_id {kind}, n_words long, placeholders long, share double" + (", listed boolean" if listed else ""))


def residue_records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.25, rounds: int = ROUNDS, **kw) -> DataFrame:
    """residue_scores with `kind`: 'placeholder' if an unfilled placeholder is
    left, else 'residue' if at least `least` of the words outside code are
    residue, else null."""
    s = residue_scores(docs, doc_id, text, rounds, **kw)
    return s.withColumn("kind", F.when(F.col("placeholders") > 0, "placeholder").when(F.col("share") >= least, "residue"))
