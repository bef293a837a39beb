"""Row-local text and embedding comparisons.

Both sides of a pair already sit in one row, so nothing here shuffles. Tokenising and the final
formulas are native columns; only subsequence lengths, n-gram overlaps and token-by-token cosines
are Arrow UDFs, because as array lambdas they cost the square of the text length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stemming import porter_stem
from .text import SPACES

MAX_ORDER = 4
WORDS_PER_PACK = 200_000
COSINE_ROWS = 2_048
MOST_COSINES = 1 << 20  # of rows that are matched together

_COUNT = T.LongType()
_LCS = T.StructType([T.StructField(n, _COUNT) for n in ("lcs", "n_pred", "n_ref")])
_OVERLAP = T.StructType(
    [T.StructField(n, T.ArrayType(_COUNT)) for n in ("matches", "totals")]
    + [T.StructField(n, _COUNT) for n in ("n_pred", "n_ref")]
)
_MATCH = T.StructType([T.StructField(n, T.DoubleType()) for n in ("precision", "recall", "f1")])
LONG_TOKEN = 3  # Fixed value: tokens longer than this are stemmed.


# --- ROUGE-L -----------------------------------------------------------------------------------


def rouge_words(text: Column) -> Column:
    """Lower-case ASCII letters and digits, everything else a blank; words joined by one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def common_length(left: list[str], right: list[str]) -> int:
    """Length of the longest common subsequence, with one bit per word of ``left``."""
    where: dict[str, int] = {}
    for index, word in enumerate(left):
        where[word] = where.get(word, 0) | (1 << index)
    full = (1 << len(left)) - 1
    row = full
    for word in right:
        hit = row & where.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(left) - row.bit_count()


def stem_words(words: list[str]) -> list[str]:
    return [porter_stem(w) if len(w) > LONG_TOKEN else w for w in words]


def _lcs_udf(stem: bool):
    @F.pandas_udf(_LCS)
    def lcs(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
        rows = []
        for p, r in zip(pred, ref):
            left, right = (p or "").split(), (r or "").split()
            if stem:
                left, right = stem_words(left), stem_words(right)
            rows.append((common_length(left, right), len(left), len(right)))
        return pd.DataFrame(rows, columns=["lcs", "n_pred", "n_ref"])

    return lcs


def lcs_counts(pred: Column, ref: Column, stem: bool = True) -> Column:
    """Common subsequence length and word counts of both texts."""
    return _lcs_udf(stem)(rouge_words(pred), rouge_words(ref))


def rouge_f(counts: Column) -> Column:
    """F-measure of precision ``lcs/n_pred`` and recall ``lcs/n_ref``."""
    precision = counts["lcs"] / counts["n_pred"].cast("double")
    recall = counts["lcs"] / counts["n_ref"].cast("double")
    return F.when(
        (counts["lcs"] > 0) & (counts["n_pred"] > 0) & (counts["n_ref"] > 0),
        F.lit(2.0) * precision * recall / (precision + recall),
    ).otherwise(F.lit(0.0))


def stem_tokens(words: Column) -> Column:
    """Stem every word of a blank-separated text (words of three letters and less stay)."""

    @F.pandas_udf(T.StringType())
    def stem(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else " ".join(stem_words(t.split())))

    return stem(words)


# --- BLEU --------------------------------------------------------------------------------------

# The public 13a tokenisation, in this order.
TOKEN_13A_TEXT = (("<skipped>", ""), ("-\n", ""), ("\n", " "))
TOKEN_13A_ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
TOKEN_13A_PATTERNS = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)


def _spaced_13a(text: Column) -> Column:
    """The text with white space between its 13a tokens."""
    out = F.rtrim(text, F.lit(SPACES))
    for old, new in TOKEN_13A_TEXT + TOKEN_13A_ENTITIES:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pattern, new in TOKEN_13A_PATTERNS:
        out = F.regexp_replace(out, pattern, new)
    return out


def tokens_13a(text: Column) -> Column:
    """13a tokens joined by one blank."""
    return F.trim(F.regexp_replace(_spaced_13a(text), r"(?U)[\s\x1c-\x1f]+", " "))


def ngram_overlaps(preds: list[list[str]], refs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Clipped n-gram matches and n-gram counts of ``preds``, one row per pair and column per order.

    Works on all pairs of a batch at once: words become numbers, an n-gram is the pair of its first
    n-1 words' number and its last word's number, renumbered per order.
    """
    n_rows = len(preds)
    texts = preds + refs
    sizes = np.fromiter((len(t) for t in texts), dtype="int64", count=len(texts))
    words, _ = pd.factorize(np.asarray([w for t in texts for w in t], dtype=object))
    text_no = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))  # words to the end of the text
    n_words = int(words.max()) + 1 if len(words) else 1
    matches = np.zeros((n_rows, MAX_ORDER), dtype="int64")
    grams, at = words, np.arange(len(words))
    for order in range(1, MAX_ORDER + 1):
        if order > 1:
            longer = left[at] >= order
            grams, at = grams[longer], at[longer]
            grams, _ = pd.factorize(grams * n_words + words[at + order - 1])
        if not len(at):
            break
        is_pred = text_no[at] < n_rows
        row = np.where(is_pred, text_no[at], text_no[at] - n_rows)
        keys, distinct = pd.factorize(row * (int(grams.max()) + 1) + grams)
        have = np.bincount(keys[is_pred], minlength=len(distinct))
        want = np.bincount(keys[~is_pred], minlength=len(distinct))
        owner = np.empty(len(distinct), dtype="int64")
        owner[keys] = row
        matches[:, order - 1] = np.bincount(owner, weights=np.minimum(have, want), minlength=n_rows)
    totals = np.maximum(sizes[:n_rows, None] - np.arange(MAX_ORDER)[None, :], 0)
    return matches, totals


@F.pandas_udf(_OVERLAP)
def _overlap_udf(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    # Texts are split and counted together up to some number of words, told from their characters (a
    # word and its blank have two at least, five about), so memory does not follow the batch.
    pack = np.cumsum([len(p or "") + len(r or "") for p, r in zip(pred, ref)]) // (5 * WORDS_PER_PACK)
    matches, totals, n_pred, n_ref = [], [], [], []
    for rows in np.split(np.arange(len(pred)), np.flatnonzero(np.diff(pack)) + 1):
        # str.split() cuts at any Unicode white space.
        left, right = ([(t or "").split() for t in side.iloc[rows]] for side in (pred, ref))
        n_pred += map(len, left)
        n_ref += map(len, right)
        hit, total = ngram_overlaps(left, right)
        matches += hit.tolist()
        totals += total.tolist()
    return pd.DataFrame({"matches": matches, "totals": totals, "n_pred": n_pred, "n_ref": n_ref})


def bleu_counts(pred: Column, ref: Column) -> Column:
    return _overlap_udf(_spaced_13a(pred), _spaced_13a(ref))


def bleu_score(counts: Column) -> Column:
    """Sentence BLEU-4 in [0, 1] with exponential smoothing.

    An order whose n-grams all miss counts as 1/(2^k n) for the k-th such order. A text too short
    for an order, or without any match, scores 0.
    """
    log_sum = F.lit(0.0)
    misses = F.lit(0.0)
    for order in range(MAX_ORDER):
        hit, total = counts["matches"][order], counts["totals"][order].cast("double")
        misses = misses + F.when(hit == 0, F.lit(1.0)).otherwise(F.lit(0.0))
        share = F.when(hit == 0, F.lit(1.0) / (F.pow(F.lit(2.0), misses) * total)).otherwise(hit / total)
        log_sum = log_sum + F.log(share)
    n_pred, n_ref = counts["n_pred"].cast("double"), counts["n_ref"].cast("double")
    brevity = F.when(n_pred < n_ref, F.exp(F.lit(1.0) - n_ref / n_pred)).otherwise(F.lit(1.0))
    scored = (counts["totals"][MAX_ORDER - 1] > 0) & (counts["matches"][0] > 0)
    return F.when(scored, brevity * F.exp(log_sum / F.lit(float(MAX_ORDER)))).otherwise(F.lit(0.0))


# --- greedy embedding match --------------------------------------------------------------------


def greedy_match(cand: np.ndarray, ref: np.ndarray) -> tuple[float, float, float]:
    """Mean best cosine from each side to the other, and their harmonic mean."""
    if not len(cand) or not len(ref):
        return 0.0, 0.0, 0.0
    left, right = _unit(cand), _unit(ref)
    best_left, best_right = [], np.full(len(right), -np.inf)
    for at in range(0, len(left), COSINE_ROWS):
        cosines = left[at : at + COSINE_ROWS] @ right.T
        best_left.append(cosines.max(axis=1))
        best_right = np.maximum(best_right, cosines.max(axis=0))
    precision, recall = float(np.concatenate(best_left).mean()), float(best_right.mean())
    both = precision + recall
    return precision, recall, 2 * precision * recall / both if both else 0.0


def _unit(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(lengths == 0, 1.0, lengths)


def _matrix(rows) -> np.ndarray:
    if rows is None or not len(rows):
        return np.empty((0, 0))
    return np.asarray([np.asarray(r, dtype="float64") for r in rows])


def _stacked(rows) -> tuple[np.ndarray, np.ndarray]:
    """All vectors of the rows below each other, and how many each row has."""
    sizes = np.array([0 if r is None else len(r) for r in rows], dtype="int64")
    full = [r for r, n in zip(rows, sizes) if n]
    if all(isinstance(r, np.ndarray) and r.ndim == 2 for r in full):
        return np.concatenate(full).astype("float64"), sizes
    return np.array([v for r in full for v in r], dtype="float64"), sizes


def match_rows(cand, ref) -> list[tuple[float, float, float]]:
    """``greedy_match`` of each row's two lists of vectors.

    Rows of like sizes are matched together: shorter lists repeat their last vector, which moves no
    maximum and is left out of the means.
    """
    cand, ref = list(cand), list(ref)
    out = np.zeros((len(cand), 3))
    full = [i for i, (c, r) in enumerate(zip(cand, ref)) if c is not None and r is not None and len(c) and len(r)]
    if not full:
        return list(map(tuple, out.tolist()))
    try:
        (left, n_left), (right, n_right) = (_stacked([side[i] for i in full]) for side in (cand, ref))
        alike = left.ndim == right.ndim == 2 and left.shape[1] == right.shape[1]
    except ValueError:  # widths differ from row to row
        alike = False
    if not alike:
        return [greedy_match(_matrix(c), _matrix(r)) for c, r in zip(cand, ref)]
    left, right = _unit(left), _unit(right)
    from_left, from_right = np.cumsum(n_left) - n_left, np.cumsum(n_right) - n_right
    kinds: dict[tuple[int, int], list[int]] = {}
    for at, (n, m) in enumerate(zip(n_left.tolist(), n_right.tolist())):
        kinds.setdefault(((n - 1).bit_length(), (m - 1).bit_length()), []).append(at)
    for members in kinds.values():
        wide, high = int(n_left[members].max()), int(n_right[members].max())
        step = MOST_COSINES // (wide * high)
        if not step:
            for at in members:
                own = left[from_left[at] : from_left[at] + n_left[at]], right[from_right[at] : from_right[at] + n_right[at]]
                out[full[at]] = greedy_match(*own)
            continue
        for begin in range(0, len(members), step):
            some = np.array(members[begin : begin + step])
            n, m = n_left[some][:, None], n_right[some][:, None]
            i, j = np.arange(wide)[None], np.arange(high)[None]
            rows = left[from_left[some][:, None] + np.minimum(i, n - 1)]
            columns = right[from_right[some][:, None] + np.minimum(j, m - 1)]
            cosines = rows @ columns.transpose(0, 2, 1)
            precision = np.where(i < n, cosines.max(axis=2), 0.0).sum(axis=1) / n[:, 0]
            recall = np.where(j < m, cosines.max(axis=1), 0.0).sum(axis=1) / m[:, 0]
            both = precision + recall
            f1 = np.where(both == 0, 0.0, 2 * precision * recall / np.where(both == 0, 1.0, both))
            out[np.array(full)[some]] = np.stack([precision, recall, f1], axis=1)
    return list(map(tuple, out.tolist()))


@F.pandas_udf(_MATCH)
def greedy_match_udf(cand: pd.Series, ref: pd.Series) -> pd.DataFrame:
    rows = match_rows(cand, ref)
    return pd.DataFrame(rows, columns=["precision", "recall", "f1"])
