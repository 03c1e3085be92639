"""Licence scan: a trained paragraph classifier with a calibrated unknown class, confirmed by templates.

A paragraph is a line of text with a word; one of more than ``SPAN`` words is seen in overlapping pieces of that many.  Sparse word
1- to 3-grams feed a multinomial logistic regression over licence families and ``unknown``, trained on ``license_table`` with
deterministic variations; its temperature is calibrated on held-out variations and so is the probability that a prediction needs
(``held_out_templates`` says how it does on wordings that it has never seen, which templates couldn't confirm anyway).
A prediction counts only if the templates of its family confirm it: at least ``CONFIRM`` of the paragraph's informative
3-grams are in one of them, or at least ``CONTAIN`` of a template's 3-grams are in the paragraph.

A paragraph without any template 3-gram can't be confirmed whatever its score, so only the others are scored.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, table, texts
from .license_table import PROSE, TEMPLATES

SPAN, CONFIRM, CONTAIN, VARIANTS, SEED = 64, 0.5, 0.6, 12, 1
PRECISION = 0.97
UNKNOWN = "unknown"
#: A-Z lower-cased, other ASCII than letters and digits to a space, line feeds to a mark of their own.
_FOLD = bytes(1 if c == 10 else c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str) -> list[str]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).replace(b"\x01", b" ").decode("utf-8", "surrogatepass").split(" ")


def _clean(text: str) -> list[str]:
    return [w for w in words(text) if w]


def grams(own: list[str]) -> list[str]:
    return [*own, *map(" ".join, zip(own, own[1:])), *map(" ".join, zip(own, own[1:], own[2:]))]


def training_rows(seed: int = SEED, variants: int = VARIANTS) -> tuple[list[list[str]], list[str], list[int]]:
    """Word lists, their families, and a group number for each template (variants share it)."""
    rng = random.Random(seed)
    common = sorted({w for x in PROSE for w in _clean(x)})
    odd = ["".join(rng.choice("aeiourstlnmdh") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    rows, names, groups = [], [], []

    def add(own, name, group):
        rows.append(own), names.append(name), groups.append(group)

    group = 0
    for family, notices in TEMPLATES.items():
        for notice in notices:
            own = _clean(notice)
            add(own, family, group)
            for _ in range(variants):
                new = [w for w in own if rng.random() > 0.06] or own
                if len(new) > 16 and rng.random() < 0.5:  # a line of wrapped text
                    k = rng.randrange(len(new) - 9)
                    new = new[k : k + rng.randint(9, 16)]
                fill = lambda: [rng.choice(odd + common) for _ in range(rng.randint(0, 6))]
                add(fill() + new + fill(), family, group)
            group += 1
    every = sorted({w for own in rows for w in own})
    for sentence in PROSE:
        own = _clean(sentence)
        for _ in range(variants):
            k = rng.randrange(max(1, len(own) - 4))
            add(own[: len(own) - k] if rng.random() < 0.5 else own[k:], UNKNOWN, group)
        group += 1
    for _ in range(40):  # salad of template words in no order, and of anything else
        for _ in range(6):
            add([rng.choice(every if rng.random() < 0.3 else odd + common) for _ in range(rng.randint(1, 40))], UNKNOWN, group)
        group += 1
    return rows, names, groups


class Model:
    """Logistic regression over n-grams, its calibration, and the templates' 3-grams."""

    def __init__(self, seed: int = SEED):
        rows, names, groups = training_rows(seed)
        self.classes = [*TEMPLATES, UNKNOWN]
        counts: dict[str, int] = {}
        for own, name in zip(rows, names):
            for g in set(grams(own)):
                counts[g] = counts.get(g, 0) + 1
        self.index = {g: k for k, g in enumerate(sorted(g for g, n in counts.items() if n >= 2))}
        y = np.array([self.classes.index(x) for x in names])
        # every fourth variant is held out
        held = np.arange(len(rows)) % 4 == 3
        x = [self._features(own) for own in rows]
        self._train([f for f, h in zip(x, held) if not h], y[~held])
        self.temperature, self.least = 1.0, 0.0
        z = np.array([self._logits(*f) for f, h in zip(x, held) if h])
        self.temperature = min((float(t) for t in np.geomspace(0.2, 5, 60)), key=lambda t: self._loss(z / t, y[held]))
        p = _softmax(z / self.temperature)
        best, top = p.argmax(1), p.max(1)
        known = best != len(self.classes) - 1
        right = best == y[held]
        # the least probability from which on held-out predictions of a family are right often enough
        for t in np.linspace(0.3, 0.95, 27):
            chosen = known & (top >= t)
            if chosen.any() and right[chosen].mean() >= PRECISION:
                break
        self.least = float(t)
        self.held_out = {"accuracy": float(right.mean()), "precision": float(right[known & (top >= self.least)].mean()), "recall": float((right & known & (top >= self.least)).sum() / (y[held] != len(self.classes) - 1).sum())}
        self.templates = {f: [set(zip(o, o[1:], o[2:])) or {tuple(o)} for o in map(_clean, notices)] for f, notices in TEMPLATES.items()}
        self.seen = {t for sets in self.templates.values() for s in sets for t in s}
        self.vocab = {w.encode(): k + 1 for k, w in enumerate(sorted({w for t in self.seen for w in t}))}
        pack = lambda t: sum(self.vocab[w.encode()] << (20 * k) for k, w in enumerate(t))
        self.packed = np.array(sorted(pack(t) for t in self.seen), np.int64)
        self.short = any(len(t) < 3 for t in self.seen)

    def _features(self, own: list[str]) -> tuple[np.ndarray, float]:
        found = sorted({self.index[g] for g in grams(own) if g in self.index})
        return np.array(found, np.int64), 1 / np.sqrt(max(1, len(own)))

    def _logits(self, found: np.ndarray, scale: float) -> np.ndarray:
        return self.weight[found].sum(0) * scale + self.bias

    @staticmethod
    def _loss(z: np.ndarray, y: np.ndarray) -> float:
        p = _softmax(z)
        return float(-np.log(p[np.arange(len(y)), y] + 1e-12).mean())

    def _train(self, x: list[tuple[np.ndarray, float]], y: np.ndarray, rounds: int = 300, rate: float = 2.0, decay: float = 2e-4) -> None:
        """Full-batch gradient descent with momentum; the same weights on every run."""
        n, c, v = len(x), len(self.classes), len(self.index)
        row = np.repeat(np.arange(n), [len(f) for f, _ in x])
        col = np.concatenate([f for f, _ in x])
        val = np.repeat([s for _, s in x], [len(f) for f, _ in x])
        self.weight, self.bias = np.zeros((v, c)), np.zeros(c)
        speed, target = np.zeros((v, c)), np.eye(c)[y]
        begin = np.flatnonzero(np.diff(np.concatenate(([-1], row))))
        order = np.argsort(col, kind="stable")
        cuts = np.flatnonzero(np.diff(np.concatenate(([-1], col[order]))))
        for _ in range(rounds):
            z = np.zeros((n, c))
            z[row[begin]] = np.add.reduceat(self.weight[col] * val[:, None], begin, axis=0)
            error = (_softmax(z + self.bias) - target) / n
            grad = np.zeros((v, c))
            grad[col[order][cuts]] = np.add.reduceat(error[row[order]] * val[order, None], cuts, axis=0)
            speed = 0.9 * speed - rate * (grad + decay * self.weight)
            self.weight += speed
            self.bias -= rate * error.sum(0)

    def predict(self, own: list[str]) -> tuple[str, float, float]:
        """Family or ``unknown``, its calibrated probability, and the agreement with the family's templates."""
        p = _softmax(self._logits(*self._features(own))[None, :] / self.temperature)[0]
        k = int(p.argmax())
        family, top = self.classes[k], float(p[k])
        if family == UNKNOWN or top < self.least:
            return UNKNOWN, top, 0.0
        agree = self.agreement(own, family)
        return (family, top, agree) if agree > 0 else (UNKNOWN, top, 0.0)

    def agreement(self, own: list[str], family: str) -> float:
        """The best share of common 3-grams, if one of the two shares is enough; else 0."""
        mine = set(zip(own, own[1:], own[2:])) or {tuple(own)}
        best = 0.0
        for template in self.templates[family]:
            both = len(mine & template)
            if both / len(mine) >= CONFIRM and both >= min(2, len(template)) or both / len(template) >= CONTAIN:
                best = max(best, both / len(mine), both / len(template))
        return best

    def paragraphs(self, text: str) -> tuple[int, list[tuple[str, int, int, float, float]]]:
        """Paragraphs of a text, and of those with a family its name, start, end (code points), probability, agreement."""
        raw = text.encode("utf-8", "surrogatepass").translate(_FOLD)
        own = raw.replace(b"\x01", b" \x01 ").split()
        ids = np.fromiter((self.vocab.get(w, -1 if w == b"\x01" else 0) for w in own), np.int64, len(own))
        breaks = ids == -1
        n = int(np.count_nonzero(~breaks & np.concatenate(([True], breaks[:-1])))) if len(ids) else 0
        ids = np.maximum(ids, 0)
        hit = np.zeros(len(ids), bool)
        if len(ids) >= 3:
            a, b, c = ids[:-2], ids[1:-1], ids[2:]
            at = np.flatnonzero((a > 0) & (b > 0) & (c > 0))
            key = a[at] | b[at] << 20 | c[at] << 40
            place = np.minimum(np.searchsorted(self.packed, key), len(self.packed) - 1)
            hit[at[self.packed[place] == key]] = True
        if self.short and len(ids):  # notices of one or two words stand alone in their line
            hit |= (ids > 0) & np.concatenate(([True], breaks[:-1]))
        if not hit.any():
            return n, []
        line_of = np.cumsum(breaks)
        lines, starts, found = text.split("\n"), [0], []
        for x in lines:
            starts.append(starts[-1] + len(x) + 1)
        for k in np.unique(line_of[hit]).tolist():
            for s, e in _pieces(lines[k]):
                family, p, agree = self.predict(_clean(lines[k][s:e]))
                if family != UNKNOWN:
                    found.append((family, starts[k] + s, starts[k] + e, round(p, 4), round(agree, 4)))
        return n, found


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _pieces(line: str, span: int = SPAN) -> list[tuple[int, int]]:
    """The line without its margins, or overlapping pieces of a long one."""
    at = [m.span() for m in _WORD.finditer(line)]
    if len(at) <= span:
        s = len(line) - len(line.lstrip())
        return [(s, len(line.rstrip()))] if at else []
    step = span // 2
    return [(at[k][0], at[min(k + span, len(at)) - 1][1]) for k in range(0, len(at) - step, step)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def held_out_templates(folds: int = 4, seed: int = SEED) -> dict[str, float]:
    """Accuracy, and precision and recall of families, where whole templates are held out with all their variations.

    Half a minute; ``Model.held_out`` is of held-out variations of templates that the model knows.
    """
    rows, names, groups = training_rows(seed)
    made = Model.__new__(Model)
    made.classes, own = [*TEMPLATES, UNKNOWN], np.array(groups) % folds
    counts: dict[str, int] = {}
    for x in rows:
        for g in set(grams(x)):
            counts[g] = counts.get(g, 0) + 1
    made.index = {g: k for k, g in enumerate(sorted(g for g, n in counts.items() if n >= 2))}
    y, x = np.array([made.classes.index(n) for n in names]), [made._features(r) for r in rows]
    best = np.zeros(len(rows), np.int64)
    for fold in range(folds):
        made._train([f for f, k in zip(x, own) if k != fold], y[own != fold])
        best[own == fold] = [int(made._logits(*f).argmax()) for f, k in zip(x, own) if k == fold]
    known, right, last = best != len(made.classes) - 1, best == y, len(made.classes) - 1
    return {"accuracy": float(right.mean()), "precision": float(right[known].mean()), "recall": float((right & known).sum() / (y != last).sum())}


@lru_cache(maxsize=2)
def model(seed: int = SEED) -> Model:
    """The trained model; a few seconds, once a process."""
    return Model(seed)


_NOTICE = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64()), ("agreement", pa.float64())]))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_paragraphs, notices``: the licence notices of each row with place, probability and agreement.

    Null and empty texts have no paragraphs; repeated rows each get a row; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model())

    def run(batch):
        made = [sent.value.paragraphs(x) for x in texts(batch)]
        notices = [[dict(zip(("family", "start", "end", "p", "agreement"), x)) for x in found] for _, found in made]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([n for n, _ in made], pa.int64()), pa.array(notices, _NOTICE)], ["doc_id", "n_paragraphs", "notices"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_paragraphs long, notices array<struct<family: string, start: int, end: int, p: double, agreement: double>>")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: licence families and notices of every document."""
    found = scan(table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["family"]))), ",")
    places = F.array_join(F.transform("notices", lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", "n_paragraphs", F.size("notices").cast("long").alias("n_notices"), names.alias("families"), places.alias("notices"), F.round(F.array_min(F.transform("notices", lambda x: x["p"])), 3).alias("least_p"))
