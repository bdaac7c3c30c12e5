"""Toxicity: a subsequence string kernel, Nyström landmarks and a support vector machine."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 4000  # most labelled documents that the classifier is fitted on
SPAN = 5  # most characters that a subsequence of three may stretch over
DECAY = 0.6  # weight of each character skipped
LANDMARKS = 96  # most landmarks of either kind
SLICE_CHARS = 2_000_000
CACHE = 300_000  # words whose scores a task remembers
# characters that stand for letters inside a word: fixed values
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
EDGE = ".,;:!?\"'()[]{}<>|*#%&$=-_/\\"


def plain_word(token: str) -> str:
    """The letters of a lower-case token; characters put between or in place of them are undone."""
    core = token.strip(EDGE)
    if core.isalpha() or not core:
        return core
    letters = sum(c.isalpha() for c in core)
    if 2 * letters >= len(core):
        core = core.translate(LOOKALIKE)
    return "".join(c for c in core if c.isalpha())


def spelled_words(letters: list[str]) -> Iterator[str]:
    """Words of runs of three or more single letters ("i d i o t"); `letters` has "" where a run ends."""
    run: list[str] = []
    for c in [*letters, ""]:
        if c:
            run.append(c)
        else:
            if len(run) > 2:
                yield "".join(run)
            run = []


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """`(rows, keys, weights)`: the gapped three-character subsequences of "^word$", for words of like length.

    The kernel of two words is the sum over common subsequences of the product
    of their weights. Words are grouped by length, none is cut.
    """
    sizes = np.array([len(w) for w in words])
    width = 8
    low = -1
    while low < sizes.max(initial=0):
        rows = np.flatnonzero((sizes > low) & (sizes <= width))
        for at in range(0, len(rows), 4000):
            part = rows[at : at + 4000]
            code = np.array([f"^{words[i]}$" for i in part], f"U{width + 2}").view(np.uint32).reshape(len(part), -1).astype(np.int64)
            code = np.where(code > 0, 1 + code % 1021, 0)
            keys, weights = [], []
            for j in range(1, SPAN):
                for k in range(j + 1, SPAN):
                    a, b, c = code[:, : -k or None], code[:, j : code.shape[1] - k + j], code[:, k:]
                    keys.append(np.where((a > 0) & (b > 0) & (c > 0), (a << 20) | (b << 10) | c, 0))
                    weights.append(np.full(keys[-1].shape[1], DECAY ** (k - 2)))
            if keys:
                yield part, np.concatenate(keys, 1), np.concatenate(weights)
        low, width = width, width * 2


@dataclass
class Kernel:
    """Normalised kernel values of words against landmarks."""

    landmarks: list[str]
    keys: np.ndarray = field(init=False)
    maybe: np.ndarray = field(init=False)
    table: np.ndarray = field(init=False)

    def __post_init__(self):
        entries: dict[int, dict[int, float]] = {}
        norms = np.zeros(len(self.landmarks))
        for mark, text in enumerate(self.landmarks):
            for at in range(len(text)):
                for j in range(1, SPAN):
                    for k in range(j + 1, SPAN):
                        if at + k < len(text):
                            a, b, c = (1 + ord(text[i]) % 1021 for i in (at, at + j, at + k))
                            own = entries.setdefault(a << 20 | b << 10 | c, {})
                            own[mark] = own.get(mark, 0.0) + DECAY ** (k - 2)
        for own in entries.values():
            for mark, v in own.items():
                norms[mark] += v * v
        self.keys = np.array(sorted(entries), np.int64)
        self.maybe = np.zeros(1 << 18, bool)  # most subsequences are no landmark's: a cheap first test
        self.maybe[self.bucket(self.keys)] = True
        self.table = np.zeros((len(self.keys) + 1, len(self.landmarks)), np.float32)
        for row, key in enumerate(self.keys.tolist()):
            for mark, v in entries[key].items():
                self.table[row, mark] = v / max(norms[mark], 1e-12) ** 0.5

    @staticmethod
    def bucket(keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B1 >> 14) & ((1 << 18) - 1)

    def values(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        if len(self.keys):
            for rows, at, weights, norm in self.lookup(words):
                sums = np.zeros((len(rows), len(self.landmarks)), np.float32)
                for p in range(at.shape[1]):
                    sums += np.float32(weights[p]) * self.table[at[:, p]]
                out[rows] = sums / norm[:, None]
        return out

    def lookup(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """`(rows, table rows of each subsequence, its weight, norm)` of the words that share any with a landmark."""
        for rows, keys, weights in subsequences(words):
            at = np.full(keys.shape, len(self.keys))
            some = np.nonzero(self.maybe[self.bucket(keys)])
            found = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
            at[some] = np.where(self.keys[found] == keys[some], found, len(self.keys))
            live = np.flatnonzero((at < len(self.keys)).any(1))
            norm = np.sqrt((keys[live] > 0) @ weights**2)
            yield rows[live], at[live], weights, np.maximum(norm, 1e-12)


@dataclass
class Classifier:
    """Word scores (kernel, Nyström map and SVM folded into one vector) and the document level."""

    kernel: Kernel
    weights: np.ndarray
    bias: float
    document: np.ndarray  # weights of `document_features`
    prior: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        """The machine is linear in the kernel values and those in the subsequences: each has one number."""
        gains = np.append(self.kernel.table[:-1] @ self.weights, 0.0)
        out = np.full(len(words), self.bias)
        if len(self.kernel.keys):
            for rows, at, weights, norm in self.kernel.lookup(words):
                out[rows] += (gains[at] @ weights) / norm
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.document, -30, 30)))


def document_features(scores: np.ndarray) -> np.ndarray:
    """Best three word scores, how many are positive, and the length of a document."""
    best = np.full(3, -2.0)
    if len(scores):
        top = np.sort(np.partition(scores, -3)[-3:] if len(scores) > 3 else scores)[::-1]
        best[: len(top)] = top
    best = np.clip(best, -2, 2)
    return np.array([1.0, *best, np.log1p((scores > 0).sum()), np.log1p(len(scores))])


def solve_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float) -> np.ndarray:
    """Linear SVM with squared hinge loss by Newton steps; the last column of `x` is the bias."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        active = y * (x @ w) < 1
        xa, ca = x[active], cost[active]
        new = np.linalg.solve(xa.T @ (xa * ca[:, None]) + ridge * np.eye(x.shape[1]), xa.T @ (ca * y[active]))
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def solve_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def affixes(word: str) -> set[str]:
    """What a landmark can be: the word itself, its beginnings and its ends."""
    full = f"^{word}$"
    return {full} | {full[:n] for n in range(5, min(10, len(full)))} | {full[-n:] for n in range(5, min(10, len(full)))}


def toxic_landmarks(bags: list[set[str]], toxic: list[bool]) -> list[str]:
    """Strings that tell toxic documents; each stands for words of theirs that the ones before it do not match."""
    spread = sum(toxic) / max(1, len(toxic))
    bad, good = Counter(), Counter()
    marks_of: dict[str, set[str]] = {}
    for bag, is_toxic in zip(bags, toxic):
        if is_toxic:
            bad.update({m for w in bag for m in marks_of.setdefault(w, affixes(w))})
    least = max(2, int(0.002 * len(toxic)))
    bad = Counter({m: n for m, n in bad.items() if n >= least})
    for bag, is_toxic in zip(bags, toxic):
        if not is_toxic:
            good.update({m for w in bag for m in (marks_of.get(w) or affixes(w)) if m in bad})
    # precise and far above chance
    usable = {m for m, n in bad.items() if n / (n + good[m]) > max(0.7, 2 * spread) and n > 3 * (n + good[m]) * spread}
    holders: dict[str, set[tuple[int, str]]] = {m: set() for m in usable}
    for i, (bag, is_toxic) in enumerate(zip(bags, toxic)):
        if is_toxic:
            for w in bag:
                for m in marks_of[w] & usable:
                    holders[m].add((i, w))
    chosen, covered = [], set()
    while len(chosen) < LANDMARKS and holders:
        new = {m: len(own - covered) for m, own in holders.items()}
        best = max(holders, key=lambda m: (new[m] * (1 - 4 * good[m] / bad[m]), len(m), m))
        if new[best] < least:
            break
        chosen.append(best)
        covered |= holders.pop(best)
    return chosen


def variants(word: str) -> list[str]:
    """A word with one inner character missing, doubled or pushed apart by another."""
    inner = range(1, len(word) - 1)
    return [v for i in inner for v in (word[:i] + word[i + 1 :], word[:i] + word[i] + word[i:], word[:i] + "x" + word[i:])]


def word_sentences(text: str) -> list[list[str]]:
    """The words of each sentence, spelled-out ones included."""
    out = []
    for sentence in SENTENCE.split(text.lower()):
        words = [plain_word(t) for t in sentence.split()]
        spelled = list(spelled_words([w if len(w) == 1 else "" for w in words]))
        out.append([w for w in words if len(w) > 1] + spelled)
    return out


def fit(rows: list[tuple[str, bool]], rounds: int = 3) -> Classifier:
    """Fit on labelled texts.

    A document's label is its sentences' label: all sentences of a clean
    document are clean, and of a toxic one at least the sentence with its
    highest scoring word is toxic. That word is the sentence's witness; the
    machine is trained on witnesses against the words of clean sentences, and
    witnesses are chosen again by the machine for a few rounds.
    """
    texts = dict.fromkeys(rows)  # copies teach nothing new
    bags = [{w for s in word_sentences(t) for w in s} for t, _ in texts]
    toxic = [bool(x) for _, x in texts]
    prior = (sum(toxic) + 0.5) / (len(toxic) + 1)
    marks = toxic_landmarks(bags, toxic)
    if not marks:
        return Classifier(Kernel([]), np.zeros(0), -1.0, np.array([np.log(prior / (1 - prior)), 0, 0, 0, 0, 0]), prior)
    clean = Counter(w for bag, x in zip(bags, toxic) if not x for w in bag)
    words = sorted({w for bag in bags for w in bag})
    number = {w: i for i, w in enumerate(words)}
    near = np.concatenate([Kernel(marks).values(words[i : i + 20000]).max(1) for i in range(0, len(words), 20000)])
    often = np.array([clean[w] for w in words])
    # landmarks of the other kind: clean words nearest to the toxic ones, and the most frequent
    hard = [words[i] for i in np.argsort(-(near * (often > 0)), kind="stable")[: LANDMARKS // 2]]
    common = [w for w, _ in sorted(clean.items(), key=lambda p: (-p[1], p[0]))[: LANDMARKS // 4]]
    landmarks = marks + [f"^{w}$" for w in dict.fromkeys(hard + common)]
    kernel = Kernel(landmarks)
    gram = np.array([kernel_row(kernel, m) for m in landmarks])
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    use = values > 1e-4
    nystrom = vectors[:, use] / np.sqrt(values[use])
    # words that share nothing with a landmark are all the same point; the near ones matter
    kept = np.flatnonzero((near > 0.25) | (often >= 20))
    mapped = np.concatenate([kernel.values([words[j] for j in kept[i : i + 20000]]) @ nystrom for i in range(0, len(kept), 20000)])
    place = {int(j): i for i, j in enumerate(kept)}
    members = [np.array(sorted(place[number[w]] for w in bag if number[w] in place), np.int64) for bag in bags]
    score = near[kept].astype(float)
    x = np.hstack([mapped, np.ones((len(kept), 1))])
    w = None
    for _ in range(rounds):
        witness = Counter(int(m[score[m].argmax()]) for m, t in zip(members, toxic) if t and len(m) and score[m].max() > (0.5 if w is None else -0.5))
        if not witness:
            break
        pos = np.array(sorted(witness))
        neg = np.flatnonzero(often[kept] > 0)
        cost = np.concatenate([[witness[int(i)] for i in pos], often[kept][neg]]).astype(float)
        cost[: len(pos)] *= 4
        # the witnesses as they look with a character too few or too many
        bent = [(v, witness[int(i)]) for i in pos for v in variants(words[kept[i]])]
        bent_x = np.hstack([kernel.values([v for v, _ in bent]) @ nystrom, np.ones((len(bent), 1))])
        sides = np.concatenate([np.ones(len(pos)), -np.ones(len(neg)), np.ones(len(bent))])
        cost = np.concatenate([cost, [0.5 * n for _, n in bent]])
        w = solve_svm(np.concatenate([x[pos], x[neg], bent_x]), sides, cost, 1.0)
        score = x @ w
    if w is None:
        return Classifier(kernel, np.zeros(len(landmarks)), -1.0, np.array([np.log(prior / (1 - prior)), 0, 0, 0, 0, 0]), prior)
    model = Classifier(kernel, (nystrom @ w[:-1]), float(w[-1]), np.zeros(6), prior)
    all_scores = np.concatenate([model.word_scores(words[i : i + 20000]) for i in range(0, len(words), 20000)])
    rows_of = [np.array([number[w] for s in word_sentences(t) for w in s], np.int64) for t, _ in texts]
    features = [document_features(all_scores[rows]) for rows in rows_of]
    # each toxic document once more with its telling words bent, so that the document level knows their scores too
    told = [int(i) for i in np.flatnonzero(all_scores > 0)]
    forms = {i: variants(words[i]) or [words[i]] for i in told}
    flat = iter(model.word_scores([v for i in told for v in forms[i]]).tolist())
    bent_scores = {i: [next(flat) for _ in forms[i]] for i in told}
    answers = [*toxic]
    for n, (rows, is_toxic) in enumerate(zip(rows_of, toxic)):
        if is_toxic and (all_scores[rows] > 0).any():
            scores = [bent_scores[i][n % len(bent_scores[i])] if i in bent_scores else all_scores[i] for i in rows.tolist()]
            features.append(document_features(np.array(scores)))
            answers.append(True)
    model.document = solve_logistic(np.array(features), np.array(answers, float))
    return model


def kernel_row(kernel: Kernel, landmark: str) -> np.ndarray:
    """Normalised kernel of a landmark, which may lack one of its ends, with all landmarks."""
    own = Kernel([landmark])
    rows = np.searchsorted(kernel.keys, own.keys)
    return own.table[:-1, 0] @ kernel.table[rows]


class Scorer:
    """Scores whole texts; remembers word scores for the length of a task."""

    def __init__(self, model: Classifier):
        self.model = model
        self.known: dict[str, float | None] = {}  # None: a single letter
        self.letter: dict[str, str] = {}

    def learn(self, tokens: set[str]) -> None:
        if len(self.known) > CACHE:
            self.known, self.letter = {}, {}
            return
        fresh = [t for t in tokens if t not in self.known]
        plain = [plain_word(t) for t in fresh]
        words = list(dict.fromkeys(w for w in plain if len(w) > 1))
        score = dict(zip(words, self.model.word_scores(words).tolist())) if words else {}
        for t, w in zip(fresh, plain):
            self.known[t] = None if len(w) == 1 else score.get(w, float("nan"))
            if len(w) == 1:
                self.letter[t] = w

    def score(self, texts: list[str | None]) -> np.ndarray:
        lists = [(t or "").lower().split() for t in texts]
        tokens = {w for ws in lists for w in ws}
        self.learn(tokens)
        if tokens and not self.known:  # the memory was full and has been emptied
            self.learn(tokens)
        features = np.empty((len(texts), 6))
        for i, ws in enumerate(lists):
            found = [self.known[w] for w in ws]
            scores = np.array([s for s in found if s is not None])
            scores = scores[~np.isnan(scores)]
            if None in found:
                spelled = list(spelled_words([self.letter[w] if s is None else "" for w, s in zip(ws, found)]))
                if spelled:
                    scores = np.concatenate([scores, self.model.word_scores(spelled)])
            features[i] = document_features(scores)
        return self.model.probability(features)


def labelled_rows(docs: DataFrame, labels: DataFrame, training: Column, limit: int = SAMPLE_DOCS) -> DataFrame:
    """At most `limit` labelled texts `(text, toxic)`, the first in hash order of their ids."""
    marked = labels.filter(F.col("toxic").isin(0, 1) & training).select("doc_id", "toxic").distinct()
    # labels of one document that disagree teach nothing
    marked = marked.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_max")).filter("toxic = _max")
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id", "toxic")
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").filter(F.col("text").isNotNull())
    return rows.select("text", (F.col("toxic") == 1).alias("toxic"))


def labelled_sample(docs: DataFrame, labels: DataFrame, training: Column, limit: int = SAMPLE_DOCS) -> list[tuple[str, bool]]:
    """The rows of `labelled_rows` as a sorted list."""
    return sorted((r.text, r.toxic) for r in labelled_rows(docs, labels, training, limit).collect())


def fit_in_task(sample: DataFrame) -> Classifier:
    """`fit` on the bounded `sample(text, toxic)` in one task: the driver sees the model, not the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["text"], r["toxic"]) for b in batches for r in b.to_pylist())
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(rows))], pa.binary())})

    done = sample.select("text", "toxic").repartition(1).mapInArrow(work, "model binary").first()
    return fit([]) if done is None else pickle.loads(done.model)


def score_toxicity(docs: DataFrame, model: Classifier) -> DataFrame:
    """`docs` with a column `score`, the probability that the text is toxic.

    Whole texts are scored, in slices of bounded size, and nothing is
    shuffled. A null or empty text is a document without words and gets the
    score of one. All columns of `docs` are kept (one named `score` is
    replaced); equal texts have equal scores; an empty table gives an empty
    table.
    """
    docs = docs.drop("score")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            texts = b.column("text")
            lengths = [len(t.as_py() or "") for t in texts]
            first, size = 0, 0
            for i, n in enumerate(lengths):
                size += n
                if size >= SLICE_CHARS or i == len(lengths) - 1:
                    part = b.slice(first, i + 1 - first)
                    score = pa.array(scorer.score(part.column("text").to_pylist()), pa.float64())
                    yield pa.RecordBatch.from_arrays([*part.columns, score], [*part.schema.names, "score"])
                    first, size = i + 1, 0

    return docs.mapInArrow(work, _with_score(docs))


def _with_score(docs: DataFrame) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["score double"])
