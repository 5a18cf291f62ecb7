"""Severity of abusive, hateful or sexual language by cumulative-link ordinal regression (p8).

A document's severity is that of its worst sentence. Sentences become sparse hashed features that
survive odd spellings; one weight vector is shared by all thresholds, and the thresholds turn the score into the
probability of each grade.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.runtime import spread

SLOTS = 1 << 18
GRADES = 3
LABELLED = 8_000
LONG, WINDOW, STEP = 18, 12, 6
CUTOFF, BLOCK = 0.35, 256

SPLIT = re.compile(r"(?:[.!?…]+[\"'»”)]*\s+)|\n+\s*(?:[-*>#]+\s+|\d+\.\s+)*")
# Characters that stand in for letters.
STAND_IN = str.maketrans("$@0134578€£", "saoieastbel")
LOOKALIKE = str.maketrans("аеорсухікмтвнѕјԁɡαοερνιτκ", "aeopcyxikmtbhsjdgaoepvitk")
TOKEN = re.compile(r"[^\W_]+(?:[*#@$!_•.·'’\-]+[^\W_]+)*[*#$]*|[*#$@][\w*#$@\-]+")
MASKED = re.compile(r"([^\W\d_])([*#•_\-]{2,}|[*#•])([^\W\d_]*)")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def number(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass"))


def plain(text: str) -> str:
    """Lower case without accents, invisible characters or look-alike letters; compatible forms folded."""
    if text.isascii():
        return text.lower()
    text = INVISIBLE.sub("", unicodedata.normalize("NFKD", text))
    return "".join(c for c in text if not unicodedata.combining(c)).lower().translate(LOOKALIKE)


def word_forms(token: str) -> tuple[str, tuple[str, ...]]:
    """The word a token most likely spells, and names of its own features."""
    marks = []
    m = MASKED.search(token)
    if m and (len(m[2]) > 1 or m[2] in "*#•") and (m[3] or "*" in m[2]):
        word = f"{token[: m.start() + 1]}?{m[3][-3:]}"
        return word, (f"m:{word}", f"m:{m[1]}?{m[3][-1:]}", "masked")
    digits = sum(c.isdigit() or c in "$@€£!" for c in token)
    word = re.sub(r"[.·•*_'’!\-]", "", token)
    if digits:
        if any(c.isalpha() for c in token) and not re.search(r"[a-z]+-\d+$|\d{3}|^\d+[a-z]{1,2}$|^v?\d", token):
            word = word.translate(STAND_IN)
            marks.append("swapped")
        elif not any(c.isalpha() for c in token):
            return "<n>", ()
    word = re.sub(r"([^\W\d_])\1{2,}", r"\1", word)
    grams = tuple(f"c:{p[i : i + 4]}" for p in (f"<{word}>",) for i in range(len(p) - 3)) if len(word) > 3 else ()
    return word, (*marks, *grams)


def sentences(text: str | None) -> list[str]:
    """The sentences and list items of a text; long ones as overlapping windows of words, so that none is left out."""
    out = []
    for s in SPLIT.split(text or ""):
        if s and s.strip():
            words = s.split()
            if len(words) <= LONG:
                out.append(s)
            else:
                out += [" ".join(words[i : i + WINDOW]) for i in range(0, len(words) - WINDOW + STEP, STEP)]
    return out


KEPT = 64


@lru_cache(maxsize=200_000)
def _known(token: str) -> tuple[int, tuple[int, ...]]:
    word, own = word_forms(token)
    return number(word), tuple(number(f) % SLOTS for f in dict.fromkeys(own))


def token_numbers(token: str) -> tuple[int, tuple[int, ...]]:
    """The number of the word a token spells and the slots of its own features; short tokens are remembered."""
    return _known(token) if len(token) <= KEPT else _known.__wrapped__(token)


def spelt(sentence: str) -> list[str]:
    """Tokens of a sentence in plain letters; letters set apart by spaces are one word."""
    run, joined = [], []
    for t in TOKEN.findall(plain(sentence)):
        if len(t) == 1 and t.isalpha():
            run.append(t)
            continue
        if run:
            joined += ["".join(run)] if len(run) > 3 else run
            run = []
        joined.append(t)
    if run:
        joined += ["".join(run)] if len(run) > 3 else run
    return joined


START, END, BIAS = number("^"), number("$"), number("bias") % SLOTS


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, sentence of each slot, text of each sentence) of all sentences of some texts.

    A sentence has the distinct hashed features of its words, of pairs of neighbours and next neighbours, of the words' character
    pieces and marks, and one that all share.
    """
    words, size, own, pieces, text_of = [], [], [], [], []
    for i, text in enumerate(texts):
        for s in sentences(text):
            before, n = len(own), 2
            words.append(START)
            for t in spelt(s):
                word, slots = token_numbers(t)
                words.append(word)
                own.extend(slots)
                n += 1
            words.append(END)
            size.append(n)
            pieces.append(len(own) - before)
            text_of.append(i)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    w, at = np.array(words, dtype=np.uint64), np.repeat(np.arange(len(size)), size)
    place = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
    real = (place > 0) & (place < np.repeat(size, size) - 1)
    one = mixed(w + np.uint64(1 << 40))
    near, far = at[1:] == at[:-1], (at[2:] == at[:-2]) & real[2:] & real[:-2]
    two = mixed(one[:-1] * np.uint64(3) + one[1:])
    three = mixed(one[:-2] * np.uint64(5) + one[2:])
    where = [at[real], at[:-1][near], at[:-2][far], np.repeat(np.arange(len(size)), pieces), np.arange(len(size))]
    slot = [(x % np.uint64(SLOTS)).astype(np.int64) for x in (one[real], two[near], three[far])] + [np.array(own, dtype=np.int64), np.full(len(size), BIAS)]
    key = np.sort(np.concatenate(where) * SLOTS + np.concatenate(slot))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key % SLOTS, key // SLOTS, np.array(text_of)


class Ordinal:
    """Shared weights, ascending thresholds: P(grade >= k) = sigmoid(score - threshold_k)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The score of each text's worst sentence; texts without any have minus infinity."""
        slot, sentence, text = features(texts)
        out = np.full(len(texts), -np.inf)
        if len(slot):
            z = np.bincount(sentence, self.weights[slot], len(text)) / np.sqrt(np.bincount(sentence, minlength=len(text)))
            np.maximum.at(out, text, z)
        return out

    def reach(self, scores: np.ndarray) -> np.ndarray:
        """Probability of each grade from 1 up, or a higher one, for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def fit(texts: list[str | None], grades: np.ndarray, rounds: int = 130, ridge: float = 2e-5, seed: int = 8) -> Ordinal:
    """Fit on whole documents. The pooling over sentences hardens from average to worst while the fit runs.

    Without any text, or with one grade only, the model scores everything alike.
    """
    flat, own, doc = features(texts)
    if not len(flat) or len(set((grades > 0).tolist())) < 2:
        return Ordinal(np.zeros(SLOTS, np.float32), np.full(GRADES - 1, 20.0 * (not len(grades) or grades.max() == 0) - 10.0))
    kept, doc = np.unique(doc, return_inverse=True)
    y, many = grades[kept], len(doc)
    n = np.bincount(own, minlength=many)
    value = (1 / np.sqrt(n))[own]
    used, col = np.unique(flat, return_inverse=True)
    w, theta = np.zeros(len(used)), np.array([0.0, 1.0])
    sum_w, sum_t = np.full(len(used), 1e-8), np.full(GRADES - 1, 1e-8)
    starts = np.searchsorted(doc, np.arange(len(kept)))
    for r in range(rounds):
        hard = 0.5 + 5.5 * min(1.0, r / (rounds * 0.6))
        z = np.bincount(own, w[col] * value, minlength=many)
        top = np.maximum.reduceat(z, starts)
        e = np.exp(hard * (z - top[doc]))
        share = e / np.add.reduceat(e, starts)[doc]
        score = np.add.reduceat(share * z, starts)
        p = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -50, 50)))
        miss = p - (y[:, None] > np.arange(GRADES - 1)[None, :])
        pull = miss.sum(axis=1) / (GRADES - 1)
        # softmax pooling: the worst sentence carries most of the gradient
        g = np.bincount(col, (pull[doc] * share * (1 + np.clip(hard * (z - score[doc]), -1, 1)))[own] * value, minlength=len(used)) / len(kept) + ridge * w
        t = -miss.mean(axis=0)
        sum_w += g * g
        sum_t += t * t
        w -= 0.5 * g / np.sqrt(sum_w + 1e-10)
        theta = np.sort(theta - 0.3 * t / np.sqrt(sum_t))
    weights = np.zeros(SLOTS, dtype=np.float32)
    weights[used] = w
    return Ordinal(weights, theta)


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> list:
    """(text, grade) of at most ``most`` rated documents, in the order of a hash of their id.

    Null ratings and repeated rows don't count. Grade 0: nobody calls it abusive; 1: raters differ; 2: all do.
    """
    votes = labels.where("doc_id is not null and abusive is not null").select("doc_id", "rater", "abusive").distinct()
    mean = votes.groupBy("doc_id").agg(F.avg("abusive").alias("mean"))
    grade = F.when(F.col("mean") <= 0, 0).when(F.col("mean") >= 1, GRADES - 1).otherwise(1)
    rows = mean.select("doc_id", grade.alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "grade").orderBy("doc_id").collect()


def train(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Ordinal:
    """Fit on the driver, on a bounded sample of rated documents; nothing else is bounded."""
    rows = labelled(docs, labels, most)
    return fit([r.text for r in rows], np.array([r.grade for r in rows], dtype=np.int64))


def scored(docs: DataFrame, model: Ordinal, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``severity`` (the expected grade, 0 to 2) and ``chance`` (probability of grade 1 or more).

    Every row is scored by its whole text; null, empty and blank texts have severity 0. Repeated rows stay, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = list(keep)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                level = shared.value.reach(shared.value.scores(part.column(len(keep)).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(level.sum(axis=1)), pa.array(level[:, 0].copy())], [*keep, "severity", "chance"])

    kinds = dict(docs.dtypes)
    return spread(docs.select(*keep, "text")).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", severity double, chance double")


def rates(marked: DataFrame, by: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """Documents, flagged documents, their share and the mean severity of each group; null is a group of its own."""
    flag = F.count_if(F.col("chance") >= cutoff)
    return marked.groupBy(by).agg(F.count("*").alias("documents"), flag.alias("flagged"), (flag / F.count("*")).alias("rate"), F.avg("severity").alias("mean_severity"))
