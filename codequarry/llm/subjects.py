"""Subject areas of documents by anchored non-negative matrix factorization.

The document-term matrix V (words and word pairs) is factored as V ~ H W by alternating multiplicative updates under the
Kullback-Leibler divergence, until a round adds less than TOLERANCE to the likelihood. Its columns are an exact dictionary
of all terms that are not too rare, so its width follows the corpus. One component is anchored to each subject: its row of W is seeded with the words
of people's labels and of the scope note, labelled documents may only use the components of their labels and the
background, and the seeds' counts stay in every update. Free background components take up what all texts share. A
document's row of H, fitted to the final W, is its subject mixture.

A remark in passing is told from the matter of a text by the words around it: sentences that bear a subject outside the
labels of a labelled document, against those that bear a subject within, give the weight of every word (naive Bayes).
In the final fits V holds the terms of sentences that bear a subject, each sentence as much as it is likely to be no
remark; the anchored components are fitted again to these, without the background, which is no longer in V.

V is never held in one place: texts are read twice, for the dictionary and for a table of numbers in the shared folder,
which has a row for each slice of some thousand documents; each update broadcasts W and reduces partial sums of W in blocks. The dictionary is bounded: a term stays if it occurs in at least LEAST_DOCUMENTS
documents and in one of RAREST documents, so there are never more terms than RAREST times the distinct terms of an average
document, whatever the number of documents.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.session import spread, width, workspace

#: A term has to occur in this many documents, and in one of so many.
LEAST_DOCUMENTS, RAREST = 3, 100_000
BACKGROUND = 6
#: Rounds of updates end when one adds less than this to the mean log-likelihood of a term, in nats.
TOLERANCE = 0.005
INNER = 5
SETTLED = 1e-3
#: Labelled documents that at most take part in seeding, remark words and thresholds: the first by a hash of doc_id.
MAX_LABELLED = 20_000
BLOCK = 4096

_WORD = re.compile(r"[^\W\d_]+")
# Texts are cut at bytes: `.` stands for all marks that end a sentence before a blank, `-` for what is neither that nor a
# letter. Bytes beyond ASCII stay, to be looked at once for every different token.
_SIMPLE = bytes(ord(" ") if x in b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f " else ord(".") if x in b".!?" else x if x in b"\n\x02" or x > 127 or chr(x).isalpha() else ord("-") for x in range(256))
_APART = bytes(ord(" ") if x in b".-" else x for x in range(256))
_WIDE_BLANK = re.compile(rb"([.!?])(?:\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_FOLD = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue"})


def _plain(word: str) -> str:
    """Lower case, without accents and without the `s` of a plural."""
    low = word.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKD", low.translate(_FOLD)).encode("ascii", "ignore").decode()
    if len(low) > 3 and low.endswith("s") and not low.endswith("ss"):
        low = low[:-1]
    return low


class _Tokens(dict):
    """Numbers of the tokens met so far; 0 ends a sentence, 1 a text. A token has the words from `first[i]` to `first[i + 1]`."""

    def __init__(self):
        self.first = array("q", [0, 0, 0])
        self.words: list[bytes] = []
        # Checksums of the word and of the word with a space behind it.
        self.codes, self.spaced = array("I"), array("I")

    def __missing__(self, token: bytes) -> int:
        if token in (b"\x01", b"\x02"):
            self[token] = token[0] - 1
            return token[0] - 1
        for found in _WORD.findall(token.decode("utf-8", "surrogatepass")):
            for part in [found] if found.islower() or len(found) < 3 else _CAMEL.split(found):
                word = _plain(part).encode()
                if len(word) >= 2:
                    self.words.append(word)
                    self.codes.append(zlib.crc32(word))
                    self.spaced.append(zlib.crc32(word + b" "))
        self.first.append(len(self.words))
        self[token] = known = len(self.first) - 2
        return known


_tokens = _Tokens()
_KEPT_TOKENS = 200_000
_SHIFTED = 32  # bytes of a second word for which tables are kept


@functools.cache
def _shifts() -> np.ndarray:
    """What the checksum of some bytes becomes by n further bytes of zero, by n and by each byte of the checksum: checksums
    are linear, so that of two strings in a row is the shifted first one XOR the second one."""
    nothing = [zlib.crc32(bytes(n)) for n in range(_SHIFTED)]
    return np.array([[[zlib.crc32(bytes(n), v << (8 * b)) ^ nothing[n] for v in range(256)] for b in range(4)] for n in range(_SHIFTED)], np.uint32)


def featurized(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit codes of the words and neighbouring word pairs of texts, the number of the sentence each stands in, which goes
    on from text to text, and the number of codes of each text."""
    global _tokens
    if len(_tokens) > _KEPT_TOKENS:
        _tokens = _Tokens()
    every = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    joined = b"\x02".join([*every, b""])
    if joined.count(b"\x02") > len(every):
        joined = b"\x02".join([*(x.replace(b"\x02", b"-") for x in every), b""])
    if not joined.isascii():
        joined = _WIDE_BLANK.sub(rb"\1 ", joined)
    joined = joined.translate(_SIMPLE).replace(b"\n", b". ").replace(b". ", b" \x01 ").replace(b"\x02", b" \x02 ").translate(_APART)
    at = np.fromiter(map(_tokens.__getitem__, joined.split()), np.int64)
    first = np.array(_tokens.first)
    n_words = (first[1:] - first[:-1])[at]
    token = np.repeat(np.arange(len(at)), n_words)
    word = np.arange(len(token)) + np.repeat(first[at] - (np.cumsum(n_words) - n_words), n_words)
    unit = np.cumsum(at <= 1).astype(np.int32)[token]
    pair = np.flatnonzero(unit[1:] == unit[:-1]) + 1
    plain = np.array(_tokens.codes, np.uint32)[word]
    before, behind = np.array(_tokens.spaced, np.uint32)[word[pair - 1]], word[pair]
    n = np.array([len(w) for w in _tokens.words], np.int64)[behind]
    table, short = _shifts().ravel(), np.minimum(n, _SHIFTED - 1) << 10
    both = plain[pair]
    for b in range(4):
        both = both ^ table[short + (b << 8) + ((before >> np.uint32(8 * b)) & np.uint32(255))]
    for i in np.flatnonzero(n >= _SHIFTED):
        both[i] = zlib.crc32(_tokens.words[behind[i]], int(before[i]))
    # A pair follows its second word.
    n_codes = np.ones(len(word), np.int64)
    n_codes[pair] = 2
    ends = np.cumsum(n_codes)
    codes = np.empty(len(word) + len(pair), np.uint32)
    codes[ends - n_codes] = plain
    codes[ends[pair] - 1] = both
    by_text = np.bincount((np.cumsum(at == 1))[token], weights=n_codes, minlength=len(texts))[: len(texts)].astype(np.int64)
    return (codes ^ np.uint32(1 << 31)).view(np.int32), np.repeat(unit, n_codes), by_text


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """32-bit codes of the words and neighbouring word pairs of a text, and the number of the sentence each stands in."""
    return featurized([text])[:2]


# ---------------------------------------------------------------- the factorization, on one batch of documents


class Sparse:
    """Rows of V: for each entry its document, the number of its term and its value; entries are sorted by document."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_docs: int):
        self.rows, self.columns, self.values, self.n_docs = rows, columns, values, n_docs

    @classmethod
    def of(cls, codes: list[np.ndarray], term_weight: np.ndarray | None = None) -> Sparse:
        """Log-damped counts times the weight of the term; terms of weight 0 are left out."""
        docs = np.repeat(np.arange(len(codes), dtype=np.int64), [len(c) for c in codes])
        if not len(docs):
            return cls(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32), len(codes))
        keys, n = np.unique((docs << 32) | np.concatenate(codes), return_counts=True)
        r, c, x = (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32), np.log1p(n).astype(np.float32)
        if term_weight is not None:
            x = x * term_weight[c]
            keep = x > 0
            r, c, x = r[keep], c[keep], x[keep]
        return cls(r, c, x, len(codes))


def _ordered(keys: np.ndarray, most: int) -> np.ndarray:
    """np.argsort(keys, kind="stable") for numbers from 0 to `most`; plain sorting is faster, so places travel with the keys."""
    bits = len(keys).bit_length()
    if most.bit_length() + bits > 62:
        return np.argsort(keys, kind="stable")
    return np.sort((keys.astype(np.int64) << bits) | np.arange(len(keys))) & ((1 << bits) - 1)


#: Entries of V that are worked on together, as many as their rows of W stay in a core's cache.
_TOGETHER = 8000


def _of_like_length(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Documents with entries in groups of about the same length."""
    docs = _ordered(lengths, int(lengths.max(initial=0)))[np.count_nonzero(lengths == 0) :]
    lo = 0
    while lo < len(docs):
        # The longest counts for all; lengths ascend.
        n = lengths[docs[lo : lo + _TOGETHER]]
        hi = lo + max(1, int(np.searchsorted(n * np.arange(1, len(n) + 1), _TOGETHER, "right")))
        hi = min(hi, lo + max(1, int(np.searchsorted(n, n[0] + max(4, n[0] // 4), "right"))))
        yield docs[lo:hi]
        lo = hi


def fit_mixtures(
    v: Sparse, w: np.ndarray, allowed: np.ndarray | None = None, inner: int | None = INNER, model: np.ndarray | None = None
) -> np.ndarray:
    """Rows of H for fixed W (terms x components, columns adding up to 1); zero for documents without terms.

    `inner` updates, or with None as many as it takes until one changes less than SETTLED of the whole. `model` gets the
    values of H W for the entries of V.
    """
    out = np.zeros((v.n_docs, w.shape[1]), np.float32)
    lengths = np.bincount(v.rows, minlength=v.n_docs)
    starts = np.cumsum(lengths) - lengths
    groups = []

    def load(docs):
        # Documents are filled up with entries of value 0, which add nothing.
        n = lengths[docs]
        within = np.arange(n.max())
        there = within < n[:, None]
        at = np.minimum(starts[docs][:, None] + within, len(v.rows) - 1)
        h = np.ones((len(docs), w.shape[1]), np.float32) if allowed is None else allowed[docs].astype(np.float32)
        return docs, at, there, v.values[at] * there, np.take(w, v.columns[at], axis=0), h

    def step(x, wv, h):
        said = np.matmul(wv, h[:, :, None])[:, :, 0]
        np.maximum(said, 1e-12, out=said)
        np.divide(x, said, out=said)
        return h * np.matmul(said[:, None, :], wv)[:, 0]

    def keep(docs, at, there, wv, h):
        out[docs] = h
        if model is not None:
            model[at[there]] = np.matmul(wv, h[:, :, None])[:, :, 0][there]

    for docs in _of_like_length(lengths):
        docs, at, there, x, wv, h = load(docs)
        if inner is None:
            groups.append([docs, at, there, x, wv, h])
            continue
        for _ in range(inner):
            h = step(x, wv, h)
        keep(docs, at, there, wv, h)
    while groups:
        moved = whole = 0.0
        for g in groups:
            last, g[5] = g[5], step(g[3], g[4], g[5])
            moved += float(np.abs(g[5] - last).sum())
            whole += float(g[5].sum())
        if moved <= SETTLED * whole:
            for docs, at, there, _, wv, h in groups:
                keep(docs, at, there, wv, h)
            break
    return out


def add_terms(v: Sparse, h: np.ndarray, w: np.ndarray, into: np.ndarray, model: np.ndarray | None = None) -> None:
    """Add the numerator of the update of W for these documents; `model` has the values of H W, if they are known."""
    if not len(v.rows):
        return
    if model is None:
        model = np.einsum("ij,ij->i", h[v.rows], w[v.columns])
    columns, sums = by_column(v, h, v.values / np.maximum(model, 1e-12))
    into[columns] += sums * w[columns]


def likelihood(v: Sparse, h: np.ndarray, model: np.ndarray) -> float:
    """The log-likelihood of these documents' terms, each weighing its value, from the values of H W."""
    if not len(v.rows):
        return 0.0
    model = model / np.maximum(h.sum(1), 1e-12)[v.rows]
    return float((v.values * np.log(np.maximum(model, 1e-12))).sum(dtype=np.float64))


def by_column(v: Sparse, of_docs: np.ndarray, factor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different columns of V's entries, and for each the sum of its documents' rows, times the entries' factors."""
    order = _ordered(v.columns, int(v.columns.max(initial=0)))
    c, rows = v.columns[order], v.rows[order]
    x = np.ones(len(rows), np.float32) if factor is None else factor[order]
    starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    lengths = np.diff(np.r_[starts, len(c)])
    out = np.empty((len(starts), of_docs.shape[1]), np.float32)
    for group in _of_like_length(lengths):
        n = lengths[group]
        within = np.arange(n[-1])
        at = np.minimum(starts[group][:, None] + within, len(rows) - 1)
        out[group] = np.matmul((x[at] * (within < n[:, None]))[:, None, :], np.take(of_docs, rows[at], axis=0))[:, 0]
    return c[starts], out


def add_shares(v: Sparse, h: np.ndarray, into: np.ndarray) -> None:
    """Add the documents' mixtures (rows of h, as shares) to their terms, and in the last column their number."""
    mass = h.sum(1)
    keep = mass[v.rows] > 0
    if keep.any():
        shares = np.c_[h / np.maximum(mass, 1e-30)[:, None], np.ones(len(h))].astype(np.float32)
        columns, sums = by_column(Sparse(v.rows[keep], v.columns[keep], v.values[keep], v.n_docs), shares)
        into[columns] += sums


def normalized(w: np.ndarray) -> np.ndarray:
    w = w + 1e-4
    return (w / w.sum(0)).astype(np.float32)


# ---------------------------------------------------------------- sentences

BEARS = 0.6  # a sentence bears a subject if one of its terms stands for it with this weight
# A document is about a subject from this share of its row of H, and from this amount (a sentence that is no remark adds 1).
# These hold while W is fitted; for the answer both are chosen anew, so that they agree best with the labelled documents.
SHARE, LEAST = 0.17, 0.5
#: So many labelled documents are needed for choosing.
ENOUGH = 200


def sharpened(t: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """What a term stands for, from the mean mixtures of its documents: lift over the corpus, squared, adding up to 1."""
    prior = np.maximum(np.average(t, axis=0, weights=frequency + 1e-9), 1e-9)
    x = (t / prior) ** 2 * prior
    x /= np.maximum(x.sum(1, keepdims=True), 1e-12)
    x[frequency < 2] = 0
    return x.astype(np.float32)


def weighted(codes: list[np.ndarray], units: list[np.ndarray], stands: np.ndarray, remark: np.ndarray) -> Sparse:
    """Rows of V for the final fit: every sentence that bears a subject adds as much as it is likely to be no remark.

    A sentence's amount is dealt to its terms by what they stand for, whatever the subject: one that bears two subjects
    adds to the terms of both. Sentences that bear none add nothing, so a row adds up to its document's sentences of matter.
    """
    docs = np.repeat(np.arange(len(codes), dtype=np.int64), [len(c) for c in codes])
    if not len(docs):
        return Sparse.of(codes)
    every = np.concatenate(codes)
    # Sentences of all documents in one row of numbers: a sentence's number starts anew with each document.
    unit = docs * (1 << 32) + np.concatenate(units)
    first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    keys, at = np.unique((docs << 32) | every, return_inverse=True)
    v = Sparse((keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32), np.zeros(len(keys), np.float32), len(codes))
    return of_matter(v, at, first, stands.max(1), remark)


def of_matter(v: Sparse, at: np.ndarray, first: np.ndarray, top: np.ndarray, remark: np.ndarray) -> Sparse:
    """`weighted` for documents whose words are the entries `at` of V, in sentences that start at `first`; `top` is the
    greatest weight with which a term stands for a subject."""
    if not len(at):
        return Sparse(v.rows[:0], v.columns[:0], v.values[:0], v.n_docs)
    greatest, of_remark = top[v.columns], remark[v.columns]
    bears = np.maximum.reduceat(greatest[at], first) >= BEARS
    odds = of_remark[at]
    total, n = np.add.reduceat(odds, first), np.add.reduceat((odds != 0).astype(np.float32), first)
    likely = bears / (1 + np.exp(np.clip(total / np.sqrt(np.maximum(n, 1)) - 1.5, -30, 30)))
    part = (greatest**2)[at]
    amount = likely / np.maximum(np.add.reduceat(part, first), 1e-9)
    part = part * np.repeat(amount, np.diff(np.r_[first, len(at)]))
    x = np.bincount(at, weights=part, minlength=len(v.rows)).astype(np.float32)
    keep = x > 0
    return Sparse(v.rows[keep], v.columns[keep], x[keep], v.n_docs)


def about(h: np.ndarray, share: float = SHARE, least: float = LEAST) -> np.ndarray:
    """Which subjects a text is about, from its row of H."""
    return (h >= least) & (h >= share * h.sum(1, keepdims=True))


def thresholds(h: np.ndarray, mask: np.ndarray) -> tuple[float, float]:
    """The share and amount with which the rows of H of labelled documents agree best with their labels (F1)."""
    if len(h) < ENOUGH:
        return SHARE, LEAST
    best = (-1.0, SHARE, LEAST)
    for share in np.arange(0.05, 0.41, 0.01):
        for least in np.arange(0.1, 2.01, 0.1):
            said = about(h, share, least)
            both = (said & (mask > 0)).sum()
            best = max(best, (2 * both / max(1, said.sum() + mask.sum()), float(share), float(least)))
    return best[1:]


def remark_odds(counts: np.ndarray, stands: np.ndarray) -> np.ndarray:
    """Log odds of each word for remarks (column 1 of counts) against matter (column 0); 0 for words of subjects."""
    matter, remarks = counts[:, 0], counts[:, 1]
    odds = np.log((remarks + 0.5) / (remarks.sum() + 1000)) - np.log((matter + 0.5) / (matter.sum() + 1000))
    odds[(matter + remarks < 3) | (stands.max(1) >= 0.5 * BEARS)] = 0
    return odds.astype(np.float32)


# ---------------------------------------------------------------- over all documents

_PARTS = ("docs", "langs", "named", "lengths", "terms", "counts", "words", "sentences", "at")
_SLICES = f"known boolean, kinds string, {', '.join(f'{x} binary' for x in _PARTS)}"
#: Tasks that hold a partial sum of W, for each core, and at most (or as many as the cluster has cores); each sends W's size
#: of numbers.
WAVES, MAX_PARTIALS = 4, 2048
_SLICE = 400_000  # codes worked on at a time
_HELD = 2_000_000  # different terms that a task counts before it gives its counts away


def featurize(documents: DataFrame, labels: DataFrame, subjects: list[str], languages: list[str]) -> DataFrame:
    """doc_id, lang (its number in `languages`, -1 for others), labels (the numbers of the subjects, empty for none at all,
    NULL for unlabelled), and the text, of which each pass works out the codes: they are longer than the text."""
    number = F.create_map(*[x for i, s in enumerate(subjects) for x in (F.lit(s), F.lit(i))])
    known = labels.where("doc_id IS NOT NULL AND subject IS NOT NULL")
    # Other names than those of subjects say "none": a set of them is empty. A set has at most one number a subject.
    by_doc = known.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.try_element_at(number, F.col("subject")))).alias("labels"))
    by_doc = by_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    # At most MAX_LABELLED rows of an identifier and a few numbers: a bounded side.
    rows = spread(documents.where("doc_id IS NOT NULL").select("doc_id", "text", "lang")).join(F.broadcast(by_doc), "doc_id", "left_outer")
    lang = F.lit(-1)
    for i, name in enumerate(languages):
        lang = F.when(F.col("lang") == name, i).otherwise(lang)
    return rows.select("doc_id", lang.alias("lang"), "labels", "text")


def common_languages(documents: DataFrame) -> list[str]:
    """The most frequent languages, one for each background component at most; `und` says that there is none."""
    counts = documents.where("lang IS NOT NULL AND lang NOT IN ('und', '')").groupBy("lang").count()
    return [r["lang"] for r in counts.orderBy(F.desc("count"), "lang").limit(BACKGROUND).collect()]


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of texts in pieces of a bounded number of bytes, or single texts."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 8 * _SLICE, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _differ(keys: np.ndarray) -> np.ndarray:
    """Where sorted keys begin anew."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def dictionary(table: DataFrame, n_docs: int) -> np.ndarray:
    """The codes of all terms that are not too rare, sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A code and its count are one number, the code above.
        held: list[np.ndarray] = []
        n_held = 0

        def summed() -> np.ndarray:
            both = np.sort(np.concatenate([*held, np.zeros(0, np.int64)]))
            first = _differ(both >> 31)
            sums = np.add.reduceat(both & 0x7FFFFFFF, first) if len(first) else first
            return (both[first] & ~0x7FFFFFFF) | np.minimum(sums, 0x7FFFFFFF)

        def given(sums: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch({"code": pa.array((sums >> 31).astype(np.int32)), "n": pa.array(sums & 0x7FFFFFFF)})

        for batch in batches:
            for part in _pieces(batch):
                codes, _, lengths = featurized(part.column("text").to_pylist())
                docs = np.repeat(np.arange(len(lengths)), lengths)
                keys = np.sort((docs << 32) | codes.view(np.uint32))
                once = np.sort(keys[_differ(keys)].astype(np.uint32).view(np.int32))
                first = _differ(once)
                held.append((once[first].astype(np.int64) << 31) | np.diff(np.r_[first, len(once)]))
                n_held += len(first)
                if n_held > _HELD:
                    held = [summed()]
                    n_held = len(held[0])
                    if 2 * n_held > _HELD:
                        yield given(held.pop())
                        n_held = 0
        yield given(summed())

    least = max(LEAST_DOCUMENTS, -(-n_docs // RAREST))
    counts = table.select("text").mapInArrow(count, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    return np.sort(counts.where(F.col("n") >= least).select("code").toPandas()["code"].to_numpy(np.int32))


class _Dictionary:
    """Finds codes in the sorted `known`: codes are checksums, so their first bits tell about where."""

    def __init__(self, known: np.ndarray):
        self.known = np.r_[known.astype(np.int64), np.int64(1) << 40]
        self.drop = 32 - min(24, (4 * len(known) + 1).bit_length())
        self.begin = np.searchsorted(known, (np.arange(1 << (32 - self.drop)) << self.drop) - (1 << 31)).astype(np.int32)

    def places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each code in the dictionary, and which of them are in it."""
        codes = codes.astype(np.int64)
        at = self.begin[(codes + (1 << 31)) >> self.drop]
        found = self.known[at]
        behind = np.flatnonzero(found < codes)
        while len(behind):
            at[behind] += 1
            found[behind] = self.known[at[behind]]
            behind = behind[found[behind] < codes[behind]]
        return at, found == codes


def _numbers(codes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each code in the dictionary, and which of them are in it."""
    return _Dictionary(known).places(codes)


def numbered(table: DataFrame, codes, n_subjects: int) -> DataFrame:
    """Slices of `table`, of labelled documents or of others, with the numbers of terms in the dictionary; other terms are left
    out. A slice has each document's different terms with their counts, and for each of its words, sentence by sentence, which
    of them it is. Numbers are kept as short as those of the slice allow: `kinds` names their types."""

    def packed(known: bool, **parts: np.ndarray) -> pa.RecordBatch:
        short = {x: a if x == "docs" else a.astype(np.min_scalar_type(int(a.max(initial=0)))) for x, a in parts.items()}
        row = {"known": pa.array([known]), "kinds": pa.array(["".join(short[x].dtype.char for x in _PARTS)])}
        return pa.record_batch(row | {x: pa.array([short[x].tobytes()], pa.binary()) for x in _PARTS})

    def slices(part: pa.RecordBatch, known: bool, find: _Dictionary) -> Iterator[pa.RecordBatch]:
        every, units, lengths = featurized(part.column("text").to_pylist())
        ids = part.column("doc_id").to_numpy()
        langs = part.column("lang").to_numpy() + 1
        marks = np.zeros((len(ids), n_subjects), np.uint8)
        for i, own in enumerate(part.column("labels").to_pylist() if known else []):
            marks[i, own] = 1
        at, there = find.places(every)
        ends = np.cumsum(lengths)
        most_codes = -(-len(every) // max(1, -(-len(every) // _SLICE)))  # slices of about the same size
        lo = 0
        while lo < len(ids):
            from_code = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, from_code + most_codes, "right")))
            own = slice(from_code, ends[hi - 1])
            kept = there[own]
            number, unit = at[own][kept].astype(np.int64), units[own][kept]
            doc = np.repeat(np.arange(hi - lo), lengths[lo:hi])[kept]
            most = len(find.known)
            keys = doc * most + number
            order = _ordered(keys, (hi - lo) * most)
            keys = keys[order]
            first = _differ(keys)
            n_terms = np.bincount(keys[first] // most, minlength=hi - lo)
            # A word's term, counted from its document's first.
            place = np.empty(len(order), np.int64)
            place[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))
            place -= (np.cumsum(n_terms) - n_terms)[doc]
            sentence = _differ(unit)
            yield packed(
                known, docs=ids[lo:hi], langs=langs[lo:hi], named=marks[lo:hi] if known else marks[:0], lengths=n_terms, terms=keys[first] % most,
                counts=np.diff(np.r_[first, len(keys)]), words=np.bincount(doc, minlength=hi - lo), sentences=np.diff(np.r_[sentence, len(unit)]), at=place,
            )
            lo = hi

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Dictionary(codes.value)
        for batch in batches:
            for part in _pieces(batch):
                known = part.column("labels").is_valid()
                for of_known in (False, True):
                    if len(own := part.filter(known if of_known else pa.compute.invert(known))):
                        yield from slices(own, of_known, find)

    return table.mapInArrow(encode, _SLICES)


class Slice:
    """Documents of a slice; its parts are unpacked when they are asked for."""

    def __init__(self, row: dict, n_subjects: int):
        self.row, self.n_subjects = row, n_subjects
        self.known = bool(row["known"])

    def part(self, name: str) -> np.ndarray:
        return np.frombuffer(self.row[name], np.dtype(self.row["kinds"][_PARTS.index(name)]))

    @functools.cached_property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs, dtype=np.int32), self.lengths)

    @functools.cached_property
    def lengths(self) -> np.ndarray:
        return self.part("lengths").astype(np.int64)

    @property
    def n_docs(self) -> int:
        return len(self.lengths)

    @functools.cached_property
    def mask(self) -> np.ndarray:
        """The labels of the documents as 0 and 1."""
        return self.part("named").reshape(-1, self.n_subjects).astype(np.int64) if self.known else np.zeros((self.n_docs, self.n_subjects), np.int64)

    def allowed(self, n_background: int) -> np.ndarray | None:
        """The components that the documents may use; None: all."""
        return np.c_[self.mask, np.ones((self.n_docs, n_background))].astype(np.float32) if self.known else None

    def terms(self, weight: np.ndarray | None = None) -> Sparse:
        """Rows of V of these documents: their log-damped counts times the weight of the term; terms of weight 0 are left out."""
        c, n = self.part("terms").astype(np.int32), self.part("counts")
        x = np.log1p(np.arange(int(n.max(initial=0)) + 1)).astype(np.float32)[n] if n.itemsize < 4 else np.log1p(n).astype(np.float32)
        rows = self.rows
        if weight is not None:
            x = x * weight[c]
            if not x.all():
                keep = x > 0
                rows, c, x = rows[keep], c[keep], x[keep]
        return Sparse(rows, c, x, self.n_docs)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word the entry of V that it is, and where its sentences start."""
        starts = np.cumsum(self.lengths) - self.lengths
        n = self.part("sentences").astype(np.int64)
        return self.part("at") + np.repeat(starts, self.part("words")), np.cumsum(n) - n


def slices_of(batches: Iterator[pa.RecordBatch], n_subjects: int) -> Iterator[Slice]:
    for b in batches:
        columns = {x: b.column(x) for x in b.schema.names}
        for i in range(b.num_rows):
            yield Slice({x: c[i].as_buffer() if x in _PARTS else c[i].as_py() for x, c in columns.items()}, n_subjects)


def _reduced(table: DataFrame, size: int, n_columns: int, n_subjects: int, add, parts: tuple[str, ...]) -> np.ndarray:
    """The sum over all documents of what `add(into, slice)` puts into an array of size x n_columns; the slices have the `parts`.

    Every task sums into its own array; the arrays' blocks are summed by block number, and the sum, whose size
    does not depend on the number of documents, comes to the driver.
    """
    n_blocks = -(-size // BLOCK)
    cores = table.sparkSession.sparkContext.defaultParallelism

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = np.zeros((n_blocks * BLOCK, n_columns), np.float64)
        for part in slices_of(batches, n_subjects):
            add(into, part)
        blocks = into.reshape(n_blocks, BLOCK, n_columns)
        for k in range(n_blocks):
            if blocks[k].any():
                yield pa.record_batch({"block": pa.array([k], pa.int32()), "data": pa.array([blocks[k].astype(np.float32).tobytes()], pa.binary())})

    partials = table.select("known", "kinds", *parts).coalesce(max(min(MAX_PARTIALS, WAVES * cores), cores)).mapInArrow(partial, "block int, data binary")
    out = np.zeros((n_blocks, BLOCK, n_columns))
    for row in _block_sums(partials, n_blocks).collect():
        out[row.block] = np.frombuffer(row.data, np.float64).reshape(BLOCK, n_columns)
    return out.reshape(n_blocks * BLOCK, n_columns)[:size]


def _block_sums(partials: DataFrame, n_blocks: int) -> DataFrame:
    """The sum of the partial blocks of each block number, read as a stream."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, data in zip(b["block"], b["data"], strict=True):
                x = np.frombuffer(data, np.float32)
                sums[block] = sums[block] + x if block in sums else x.astype(np.float64)
        yield pd.DataFrame({"block": list(sums), "data": [x.tobytes() for x in sums.values()]})

    # One block number is at most one array of BLOCK x components; a task has only those it was dealt.
    return partials.repartition(max(1, min(width(partials.sparkSession), n_blocks)), "block").mapInPandas(stream, "block int, data binary")


def subject_areas(
    spark: SparkSession, documents: DataFrame, labels: DataFrame, subjects: list[tuple[str, str]], tolerance: float = TOLERANCE, inner: int = INNER
) -> DataFrame:
    """doc_id, subject, share: the subject areas of every document, by the method of this module.

    `documents`: doc_id (unique), text, lang; `labels`: doc_id, subject (any other name than those of `subjects` says
    "none of them"); `subjects`: names and scope notes, a fixed list. Nulls: rows without doc_id are left out; NULL or
    blank texts have no subject; a NULL or unknown lang only leaves the text out of seeding the background. Labels of
    unknown documents, repeated and contradictory ones are no special case: a document's labels are put together. Texts
    are read whole. Without subjects or documents the result is empty.
    """
    names = [s for s, _ in subjects]
    n_sub, k_all = len(names), len(names) + BACKGROUND
    empty = "doc_id bigint, subject string, share double"
    if not names:
        return spark.createDataFrame([], empty)
    sc, folder = spark.sparkContext, workspace(spark, "subjects")
    languages = common_languages(documents)
    texts = featurize(documents, labels, names, languages)
    by_lang = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().collect()}  # one row for each language seeded
    n_docs = max(1, sum(by_lang.values()))
    codes = dictionary(texts, n_docs)
    size, n_lang = max(1, len(codes)), max(1, len(languages))
    # Labelled documents lie apart, so that passes over them read no others. Blocks of rows are kept small: a row is large.
    writer = numbered(texts, sc.broadcast(codes), n_sub).write.partitionBy("known").option("compression", "zstd")
    writer.option("parquet.block.size", 32 << 20).option("parquet.page.size.row.check.min", 4).parquet(f"{folder}/terms")
    table = spark.read.schema(_SLICES).parquet(f"{folder}/terms")

    # One pass for everything the start needs: document frequency, frequency and masses by language, seeds.
    def start(into, part):
        v, lang = part.terms(), part.part("langs").astype(np.int64) - 1
        if not len(v.rows):
            return
        of_docs = np.c_[np.ones(len(lang)), np.full(len(lang), part.known), part.known & (part.mask.sum(1) == 0), lang[:, None] == np.arange(n_lang)]
        columns, sums = by_column(v, of_docs.astype(np.float32))
        into[columns, : 3 + n_lang] += sums
        by_value = np.c_[lang[:, None] == np.arange(n_lang), part.mask if part.known else part.mask[:, :0]].astype(np.float32)
        columns, sums = by_column(v, by_value, v.values)
        into[columns, 3 + n_lang : 3 + n_lang + by_value.shape[1]] += sums

    of_terms = ("named", "lengths", "terms", "counts")
    first = _reduced(table, size, 3 + 2 * n_lang + n_sub, n_sub, start, (*of_terms, "langs"))
    frequency = first[:, 0]
    weight = np.where(frequency > 0, np.log(n_docs / np.maximum(frequency, 1)) / 3, 0).clip(0).astype(np.float32)
    seeds = first[:, 3 + 2 * n_lang :] * weight[:, None]
    # Words that people mostly found in texts of no subject: alone in a short text they would stand for whatever it is.
    idle = (first[:, 1] >= 3) & (first[:, 2] >= 0.5 * first[:, 1])
    for k, (name, note) in enumerate(subjects):
        at, known = _numbers(features(f"{name} {note or ''}")[0], codes)
        np.add.at(seeds[:, k], at[known], 1.0)
    rng = np.random.default_rng(7)
    w0 = np.zeros((size, k_all))
    w0[:, :n_sub] = seeds
    for b in range(BACKGROUND):
        g = b % n_lang
        usual = np.minimum(1, first[:, 3 + g] / max(1, by_lang.get(g, 0)))
        w0[:, n_sub + b] = first[:, 3 + n_lang + g] * weight * usual * rng.uniform(0.8, 1.2, size) + 1e-5
    w = normalized(w0)
    b_weight = sc.broadcast(weight)

    last = -np.inf
    while True:
        b_w = sc.broadcast(w)

        def update(into, part, b_w=b_w):
            v = part.terms(b_weight.value)
            model = np.empty(len(v.rows), np.float32)
            h = fit_mixtures(v, b_w.value, part.allowed(BACKGROUND), inner, model)
            add_terms(v, h, b_w.value, into[:, :k_all], model)
            into[0, k_all] += likelihood(v, h, model)
            into[0, k_all + 1] += v.values.sum(dtype=np.float64)

        sums = _reduced(table, size, k_all + 2, n_sub, update, of_terms)
        fit = sums[0, k_all] / max(1e-9, sums[0, k_all + 1])
        sums = sums[:, :k_all]
        sums[:, :n_sub] += 2 * seeds
        w = normalized(sums)
        b_w.unpersist()
        if fit - last < tolerance:
            break
        last = fit
    b_w = sc.broadcast(w)

    # What each term stands for: the mean subject mixture of its documents.
    def stand(into, part):
        h = fit_mixtures(part.terms(b_weight.value), b_w.value, part.allowed(BACKGROUND), inner)
        add_shares(part.terms(), h[:, :n_sub], into)

    def smoothed(sums):
        total = sums[:, :n_sub].sum(0)
        prior = total / max(1e-9, total.sum())
        found = sharpened((sums[:, :n_sub] + 0.5 * prior) / (sums[:, n_sub:] + 0.5), frequency)
        found[idle] = 0
        return found

    stands = smoothed(_reduced(table, size, n_sub + 1, n_sub, stand, of_terms))
    of_places = (*of_terms, "words", "sentences", "at")
    labelled = table.where("known")
    for again in range(3):
        b_stands, b_top = sc.broadcast(stands), sc.broadcast(stands.max(1))

        def around(into, part, b_stands=b_stands):
            s, (at, first) = b_stands.value, part.places()
            if not len(at):
                return
            v = part.terms()
            context, mask = s.max(1) < 0.5 * BEARS, part.mask
            ends = np.r_[first[1:], len(at)]
            for j in np.flatnonzero(np.maximum.reduceat(s.max(1)[v.columns][at], first) >= BEARS):
                own = at[first[j] : ends[j]]
                words = np.unique(v.columns[own])
                subject = s[v.columns[own]].max(0).argmax()
                into[words[context[words]], 1 - mask[v.rows[own[0]], subject]] += 1

        remark = remark_odds(_reduced(labelled, size, 2, n_sub, around, of_places), stands)
        b_remark = sc.broadcast(remark)
        if again == 2:
            break

        # The anchored rows of W are fitted again to what the sentences say, from what the terms stand for; what all
        # texts share is no longer in these V, so they need no background. The same mixtures tell anew what terms stand for.
        b_w = sc.broadcast(normalized(stands * frequency[:, None]))

        def refine(into, part, b_w=b_w, b_top=b_top, b_remark=b_remark):
            every = part.terms()
            v = of_matter(every, *part.places(), b_top.value, b_remark.value)
            model = np.empty(len(v.rows), np.float32)
            h = fit_mixtures(v, b_w.value, part.allowed(0), None, model)
            add_terms(v, h, b_w.value, into[:, :n_sub], model)
            told = part.known & (part.mask.sum(1) > 0)
            h[~about(h)] = 0
            h[told] = part.mask[told]
            add_shares(every, h, into[:, n_sub:])

        sums = _reduced(table, size, 2 * n_sub + 1, n_sub, refine, of_places)
        w = normalized(sums[:, :n_sub])
        stands = smoothed(sums[:, n_sub:])
    b_w = sc.broadcast(w)

    def mixtures(part):
        return fit_mixtures(of_matter(part.terms(), *part.places(), b_top.value, b_remark.value), b_w.value, inner=None)

    def rows_of_labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices_of(batches, n_sub):
            h, mask = mixtures(part), part.mask
            yield pa.record_batch({"h": pa.array([x.tobytes() for x in h], pa.binary()), "mask": pa.array([x.tobytes() for x in mask], pa.binary())})

    # At most MAX_LABELLED rows of as many numbers as there are subjects.
    known = labelled.select("known", "kinds", *of_places).mapInArrow(rows_of_labelled, "h binary, mask binary").collect()
    h_known = np.array([np.frombuffer(r.h, np.float32) for r in known]).reshape(-1, n_sub)
    share_from, least = thresholds(h_known, np.array([np.frombuffer(r["mask"], np.int64) for r in known]).reshape(-1, n_sub))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices_of(batches, n_sub):
            n = mixtures(part)
            total = n.sum(1)
            doc, subject = np.nonzero(about(n, share_from, least))
            found = {"doc_id": pa.array(part.part("docs")[doc], pa.int64()), "subject": pa.array([names[k] for k in subject], pa.string())}
            yield pa.record_batch(found | {"share": pa.array((n[doc, subject] / total[doc]).astype(np.float64))})

    return table.select("known", "kinds", "docs", *of_places).mapInArrow(answer, empty)
