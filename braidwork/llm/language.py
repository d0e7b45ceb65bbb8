"""Language labels for documents and mixed-language segments (problem 4): error-correcting output codes over
binary n-gram classifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of a language in a label column: ISO 639 codes and the English name. Fixed values.
NAMES = {
    "en": ("en", "eng", "english"), "de": ("de", "deu", "ger", "german"), "fr": ("fr", "fra", "fre", "french"), "es": ("es", "spa", "spanish"),
    "pt": ("pt", "por", "portuguese"), "ru": ("ru", "rus", "russian"),
}
WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
PARAGRAPH = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
END = re.compile(r"[.!?…][)\]\"'’”»]*\s*$")
DIM = 4096


def label_column(label: Column) -> Column:
    """The language that a label names, or null: a code with or without region, or an English name, in any case."""
    low = F.lower(F.trim(label))
    base = F.regexp_extract(low, r"^([a-z]+)(?:[-_][a-z0-9]+)*$", 1)
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(base.isin(*names[:-1]) | (low == names[-1]), F.lit(code)).otherwise(out)
    return out


def sentence_words(paragraph: str) -> list[str]:
    """Lower-cased words of a paragraph's sentences: of its lines that end as a sentence does and have four words,
    or have eight words, more than three between commas and no field marks; and more letters than twice their digits.
    Headings, titles, names, contact data and lists have none."""
    out: list[str] = []
    for line in paragraph.split("\n"):
        words = WORDS.findall(line)
        ends = END.search(line)
        if len(words) < (4 if ends else 8) or not ends and ("|" in line or "@" in line or len(words) <= 3 * (line.count(",") + 1)):
            continue
        if sum(map(len, words)) > 2 * sum(map(str.isdigit, line)):
            out += [w.lower() for w in words]
    return out


def features(word: str) -> list[int]:
    """Hashed n-grams of 1 to 4 characters of a word with its boundaries."""
    w = f"^{word}$"
    out = []
    for n in (1, 2, 3, 4):
        for i in range(len(w) - n + 1):
            h = n
            for c in w[i : i + n]:
                h = (h * 1000003 ^ ord(c)) & 0xFFFFFFFF
            out.append((h ^ h >> 13) % DIM)
    return out


def codewords(classes: int, bits: int) -> np.ndarray:
    """A codeword of +1 and -1 per class: of all ways to part the classes, the ``bits`` most even ones."""
    splits = [np.where(np.isin(np.arange(classes), (0, *rest)), 1, -1) for k in range(classes - 1) for rest in combinations(range(1, classes), k)]
    splits.sort(key=lambda s: abs(int(s.sum())))
    return np.array(splits[:bits], dtype="float32").T


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # classes x bits
    weights: np.ndarray  # DIM x bits
    bias: np.ndarray
    trust: np.ndarray  # per bit
    margin: float = 1.0  # loss difference to the next language below which a result is ambiguous
    known: dict[str, int] = field(default_factory=dict, repr=False)
    rows: np.ndarray | None = field(default=None, repr=False)
    n: int = 0

    def __getstate__(self):
        return {**self.__dict__, "known": {}, "rows": None, "n": 0}

    def vectors(self, words: list[str]) -> np.ndarray:
        """Summed classifier weights of the words; each different word is computed once per task's process."""
        if self.rows is None or self.n > 300_000:
            self.known, self.rows, self.n = {}, np.zeros((1024, self.code.shape[1] + 1), dtype="float32"), 0
        known, at = self.known, []
        for w in words:
            i = known.get(w)
            if i is None:
                if self.n == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                f = features(w)
                i = known[w] = self.n
                self.rows[i, :-1] = self.weights[f].sum(axis=0)
                self.rows[i, -1] = len(f)
                self.n += 1
            at.append(i)
        return self.rows[at].sum(axis=0)

    def classify(self, words: list[str]) -> tuple[str, float, bool]:
        """Language, confidence 0..1, whether it is ambiguous: the codeword of least trust-weighted logistic loss."""
        v = self.vectors(words)
        f = v[:-1] / v[-1] * SCALE + self.bias
        loss = (np.logaddexp(0, -self.code * f) * self.trust).sum(axis=1)
        best = int(loss.argmin())
        p = np.exp(loss[best] - loss)
        rest = np.delete(loss, best)
        return self.langs[best], float(1 / p.sum()), bool(rest.min() - loss[best] < self.margin)


#: Weight of a text's mean n-gram vector.
SCALE = 20.0


def fit(texts: list[tuple[str, str]], bits: int = 15, rounds: int = 3, steps: int = 60, most: int = 1500) -> Model:
    """A model from ``(text, label)`` pairs whose labels may be wrong.

    The texts' paragraphs take their text's label; ``rounds`` times, multinomial n-gram counts by language relabel
    them, which corrects wrong labels and mixed texts while most labels are right. Then a logistic classifier per bit
    is fitted to at most ``most`` paragraphs.
    """
    langs = sorted({l for _, l in texts} & set(NAMES))
    if len(langs) < 2:
        raise ValueError("labelled texts of two languages at least are needed")
    rows, y = [], []
    memo: dict[str, np.ndarray] = {}
    for text, label in texts:
        for p in PARAGRAPH.split(text):
            words = sentence_words(p)
            if len(words) < 6:
                continue
            at = np.concatenate([memo.setdefault(w, np.array(features(w))) for w in words])
            rows.append(np.bincount(at, minlength=DIM).astype("float32"))
            y.append(langs.index(label))
            if len(rows) >= most:
                break
        if len(rows) >= most:
            break
    x, lab = np.array(rows), np.array(y)
    for _ in range(rounds):
        counts = np.stack([x[lab == k].sum(axis=0) for k in range(len(langs))]) + 0.5
        logp = np.log(counts / counts.sum(axis=1, keepdims=True))
        lab = (x @ logp.T).argmax(axis=1)
    x = x / x.sum(axis=1, keepdims=True) * SCALE
    code = codewords(len(langs), bits)
    t = code[lab]
    share = np.bincount(lab, minlength=len(langs)) / len(lab)
    each = (1 / np.maximum(share, 1e-6) / len(langs))[lab][:, None]
    w, b = np.zeros((DIM, code.shape[1]), "float32"), np.zeros(code.shape[1], "float32")
    g2 = np.full_like(w, 1e-6)
    for _ in range(steps):
        f = x @ w + b
        g = -t * each / (1 + np.exp(np.clip(t * f, -30, 30))) / len(x)
        gw = x.T @ g + 1e-3 * w
        g2 += gw * gw
        w -= 0.5 * gw / np.sqrt(g2)
        b -= 0.5 * g.sum(axis=0)
    error = np.mean((x @ w + b) * t <= 0, axis=0)
    trust = np.log((1 - error + 1e-3) / (error + 1e-3))
    return Model(langs, code, w.astype("float32"), b, (trust / trust.mean()).astype("float32"))


def fit_on(tables: list[tuple[DataFrame, str, str, str]], sample: int = 1500) -> Model:
    """A model from ``(table, id, text, label)``: of each table, ``sample`` rows whose label names a language are
    taken by a hash of their id. That is the bound of the sample; it is read by the driver."""
    texts = []
    for df, key, text, label in tables:
        rows = df.select(F.xxhash64(key).alias("h"), F.col(text).alias("t"), label_column(F.col(label)).alias("l")).where(F.col("l").isNotNull())
        # tasks send no more than three times the sample together: the lowest hashes of all are among the lowest share
        share = min(1.0, 3.0 * sample / max(1, rows.count()))
        low = rows.where((F.col("h") <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.lit(True)) & (F.length("t") > 0))
        texts += [(r["h"], r["t"], r["l"]) for r in low.orderBy("h", "t").limit(sample).collect()]
    return fit([(t, l) for _, t, l in sorted(texts, key=lambda r: r[0])])


def segments(text: str | None, model: Model) -> list[tuple[str, float, bool, int]]:
    """``(lang, confidence, ambiguous, paragraphs)`` of each longest run of paragraphs of one language.

    A paragraph without sentences goes with the one before, at the start with the one after. The confidence is
    that of the run's words together. Null, empty and wordless texts have no segment.
    """
    runs: list[list] = []  # [lang, words, paragraphs]
    waiting = 0
    for p in PARAGRAPH.split(text.replace("\r\n", "\n").strip("\n")) if text else ():
        words = sentence_words(p)
        if not words:
            if runs:
                runs[-1][2] += 1
            else:
                waiting += 1
            continue
        lang = model.classify(words)[0]
        if runs and runs[-1][0] == lang:
            runs[-1][1] += words
            runs[-1][2] += 1
        else:
            runs.append([lang, words, 1 + waiting])
            waiting = 0
    out = []
    for lang, words, n in runs:
        best, confidence, ambiguous = model.classify(words)
        out.append((lang, confidence if best == lang else 1 - confidence, ambiguous or best != lang, n))
    return out


def label_segments(df: DataFrame, key: str, text: str, label: str, model: Model, name: str) -> DataFrame:
    """``record_table, record_id, segment_no, lang, confidence, ambiguous, n_segments, named`` of every segment.

    ``named`` is the language that the record's label names, or null. Rows with a null key are dropped; repeated rows
    give equal rows, of which one is kept.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = "record_id long, segment_no int, lang string, confidence double, ambiguous boolean, n_segments int, named string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            out = []
            for i, t, l in zip(b["__id"].tolist(), b["__text"].tolist(), b["__named"].tolist()):
                s = segments(t, m)
                out += [(i, k, lang, conf, amb, len(s), l) for k, (lang, conf, amb, _) in enumerate(s, 1)]
            yield pd.DataFrame(out, columns=["record_id", "segment_no", "lang", "confidence", "ambiguous", "n_segments", "named"])

    rows = df.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).cast("long").alias("__id"), F.col(text).alias("__text"), label_column(F.col(label)).alias("__named"))
    return rows.mapInPandas(run, schema).distinct().select(F.lit(name).alias("record_table"), "*")


def wrong_labels(found: DataFrame) -> DataFrame:
    """The segments of records that have several, or whose label does not name the language of the only one."""
    return found.where((F.col("n_segments") > 1) | ~F.col("named").eqNullSafe(F.col("lang"))).select("record_table", "record_id", "segment_no", "lang")
