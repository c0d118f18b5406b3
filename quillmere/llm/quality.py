"""Quality rules by line sequence labelling.

A linear-chain conditional random field with two labels (content, boilerplate) is trained here on a bounded sample of labelled documents: the
`sample` documents with the lowest hash of their id in each quality class, and of each its first `sample_lines` lines within its first
`sample_chars` characters. Labels are known for documents alone, so those of lines are inferred (hard EM): the lines of a good document are
content; of a poor one at least one is boilerplate, and which ones is what the field says at the time. The first field has no transitions and
takes all lines of a poor document for boilerplate; each further one is trained, by gradient ascent on the exact conditional likelihood, on the lines
as the one before labels them. Transitions have a prior of their own, as chains of one label would otherwise forbid any change. Viterbi decoding labels the
lines of every whole document; the share of its words in content lines decides.

Defined results: null or empty text: no words, base_failed. Null doc_id: kept. Repeated rows: a row each. Empty table:
no rows. No usable labels (missing class or empty table): a field of fixed weights, FALLBACK. Very long texts: read and labelled whole, one at a time (the sample's bounds are for training alone). Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.batches import documents, id_text, map_docs

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SAMPLE = 1500
SAMPLE_LINES = 60
SAMPLE_CHARS = 40_000
#: Fields trained after the first, and the weight of the prior on transitions against that on features.
FIELDS = 3
STEP_RIDGE = 10.0
CONTENT_SHARE = 0.5
N_FEATURES = 11
#: Weights where nothing can be learnt: symbols, capitals and repeats speak against content.
FALLBACK = (np.array([2.0, -8.0, -6.0, -6.0, -4.0, -2.0, 0.5, 0.0, 0.0, 0.5, 0.0]), np.array([[0.5, -0.5], [-0.5, 0.5]]))


def features(words: list[str], line: str, again: bool, before: set[str]) -> list[float]:
    """What a line shows; all between 0 and about 1. before: words of the line before."""
    n, size = len(words), len(line)
    counts = set(words)
    symbols = sum(map(line.count, SYMBOLS))
    upper = sum(w.isupper() for w in words)
    return [
        1.0,
        min(symbols / n, 2.0) / 2,
        1 - len(counts) / n,
        upper / n,
        line.count("!") / n if n > 1 else 0.0,
        1.0 if again else 0.0,
        1.0 if line.rstrip()[-1:] in ".?!:;" else 0.0,
        min(n, 60) / 60,
        min(size / n, 20) / 20,
        sum(w.islower() for w in words) / n,
        len(counts & before) / len(counts),
    ]


def lines_of(text: str) -> Iterator[tuple[list[str], str, bool]]:
    """(words, line, whether an equal line came before) of the lines with a word."""
    seen: set[str] = set()
    for line in text.split("\n"):
        words = split(line)
        if words:
            yield words, line, line in seen
            seen.add(line)


def split(text: str) -> list[str]:
    """Words [^\\x20\\x09-\\x0D]+; str.split would also cut at other spaces."""
    return [w.decode() for w in text.encode().split()] if not text.isascii() or any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


def measured(text: str) -> tuple[list[list[float]], list[int], int]:
    """Features and word counts of the lines, and how many lines repeat an earlier one."""
    rows, sizes, dups, before = [], [], 0, set()
    for words, line, again in lines_of(text):
        rows.append(features(words, line, again, before))
        sizes.append(len(words))
        dups += again
        before = set(words)
    return rows, sizes, dups


def viterbi(scores: np.ndarray, step: np.ndarray) -> list[int]:
    """Labels (0 content, 1 boilerplate) of a sequence. scores: content against boilerplate, per line."""
    (s00, s01), (s10, s11) = step.tolist()
    a, b, back = 0.0, 0.0, []
    for k, x in enumerate(scores.tolist()):
        if k:
            to0, to1 = (a + s00 < b + s10), (a + s01 < b + s11)
            a, b = (b + s10 if to0 else a + s00), (b + s11 if to1 else a + s01)
            back.append((to0, to1))
        a += x
    label = int(b > a)
    out = [label]
    for at in reversed(back):
        label = int(at[label])
        out.append(label)
    return out[::-1]


class Chains:
    """Line features of the training documents, all first lines, then all second ones, and so on; the longest documents come first, so that those
    with a line k are the first count[k]."""

    def __init__(self, sequences: list[np.ndarray], poor: np.ndarray):
        order = np.argsort([-len(s) for s in sequences], kind="stable")
        self.poor = poor[order]
        size = np.array([len(sequences[k]) for k in order])
        self.count = [int((size > k).sum()) for k in range(int(size.max()))]
        self.begin = np.append(0, np.cumsum(self.count))
        self.doc = np.concatenate([np.arange(n) for n in self.count])
        self.x = np.zeros((int(size.sum()), N_FEATURES))
        for d, k in enumerate(order):
            self.x[self.begin[: size[d]] + d] = sequences[k]
        # both classes count alike, and documents within a class
        self.weight = np.where(self.poor, 0.5 / max(self.poor.sum(), 1), 0.5 / max((~self.poor).sum(), 1)) / size
        self.size = size
        self.after = np.concatenate([np.arange(n) + self.begin[k + 1] for k, n in enumerate(self.count[1:])]) if len(self.count) > 1 else np.zeros(0, np.int64)
        self.before = np.concatenate([np.arange(n) + self.begin[k] for k, n in enumerate(self.count[1:])]) if len(self.count) > 1 else np.zeros(0, np.int64)

    def marginals(self, w: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chance of content for each line, and of each pair of labels for each line and the next, by forward and backward sums."""
        e = np.stack([self.x @ w, np.zeros(len(self.x))], -1)
        alpha, beta = e.copy(), np.zeros_like(e)
        at = lambda k: slice(self.begin[k], self.begin[k + 1])
        for k in range(1, len(self.count)):
            own, last = alpha[at(k)], alpha[at(k - 1)][: self.count[k]]
            own += np.logaddexp(last[:, :1] + step[0], last[:, 1:] + step[1])
        ends = alpha[self.begin[self.size - 1] + np.arange(len(self.size))]
        total = np.logaddexp(ends[:, 0], ends[:, 1])[self.doc]
        for k in range(len(self.count) - 2, -1, -1):
            nxt = e[at(k + 1)] + beta[at(k + 1)]
            beta[at(k)][: self.count[k + 1]] = np.logaddexp(step[:, 0] + nxt[:, :1], step[:, 1] + nxt[:, 1:])
        content = np.exp(alpha[:, 0] + beta[:, 0] - total)
        return content, np.exp(alpha[self.before][:, :, None] + step + (e + beta)[self.after][:, None, :] - total[self.before][:, None, None])

    def ascend(self, params: np.ndarray, labels: np.ndarray, rounds: int, rate: float, ridge: float, chained: bool) -> np.ndarray:
        """Weights (features of content against boilerplate; transitions) by Adam on the log-likelihood of the labels (1: boilerplate)."""
        per = self.weight[self.doc]
        want = (labels == 0).astype(float)
        pair = np.zeros(4)
        np.add.at(pair, 2 * labels[self.before] + labels[self.after], per[self.before])
        prior = ridge * np.append(np.ones(N_FEATURES), np.full(4, STEP_RIDGE))
        first, second = 0.0, 0.0
        for t in range(1, rounds + 1):
            w, step = params[:N_FEATURES], params[N_FEATURES:].reshape(2, 2)
            if chained:
                content, joint = self.marginals(w, step)
                gs = pair - (per[self.before] @ joint.reshape(-1, 4))
            else:
                content, gs = 1 / (1 + np.exp(-(self.x @ w))), np.zeros(4)
            g = np.append(((want - content) * per) @ self.x, gs) - prior * params
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            params = params + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        return params

    def inferred(self, params: np.ndarray) -> np.ndarray:
        """The lines' labels under the field: those of good documents content, of poor ones Viterbi's, one boilerplate line at least."""
        labels = np.zeros(len(self.x), np.int64)
        for d in np.flatnonzero(self.poor):
            lines = self.begin[: self.size[d]] + d
            scores = self.x[lines] @ params[:N_FEATURES]
            own = viterbi(scores, params[N_FEATURES:].reshape(2, 2))
            if not any(own):
                own[int(scores.argmin())] = 1
            labels[lines] = own
        return labels


def train(sequences: list[np.ndarray], labels: list[int], rounds: int = 60, rate: float = 0.15, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """The weights of features (content against boilerplate) and of transitions, from documents' lines and labels (1: poor)."""
    chains = Chains(sequences, np.array(labels) == 1)
    params = chains.ascend(np.zeros(N_FEATURES + 4), chains.poor[chains.doc].astype(np.int64), 2 * rounds, rate, ridge, False)
    for _ in range(FIELDS):
        params = chains.ascend(params, chains.inferred(params), rounds, rate, ridge, True)
    return params[:N_FEATURES], params[N_FEATURES:].reshape(2, 2)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES, sample_chars: int = SAMPLE_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Train on at most 2 * sample labelled documents, taken to the driver with at most sample_lines lines and sample_chars characters each. Where
    doc_ids repeat, hashes of id and text choose among the rows, so that the model is the same in every run."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().filter("quality in (0, 1)").distinct()
    h = F.xxhash64("doc_id", "quality")
    chosen = marked.filter("quality = 0").orderBy(h, "doc_id").limit(sample).unionByName(marked.filter("quality = 1").orderBy(h, "doc_id").limit(sample))
    cut = F.substring(F.array_join(F.slice(F.split("text", "\n"), 1, sample_lines), "\n"), 1, sample_chars)
    met = id_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", cut.alias("text"))  # chosen is bounded by the sample
    rows = met.orderBy(F.xxhash64("doc_id", "quality", "text"), "doc_id", "quality", "text").limit(2 * sample).collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.text or ""))
    sequences, wanted = [], []
    for r in rows:
        if x := measured(r.text or "")[0]:
            sequences.append(np.array(x[:sample_lines]))
            wanted.append(1 - r.quality)
    return train(sequences, wanted) if len(set(wanted)) == 2 else FALLBACK


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows that stand twice or more in the text, the first included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    n, end = 0, 0
    for k, w in enumerate(windows):
        if counts[w] > 1:
            n += k + 3 - max(k, end)
            end = k + 3
    return n


RULES = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_share double, n_lines bigint, n_content_lines bigint"


def rules(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], share: float = CONTENT_SHARE) -> DataFrame:
    """The base figures, the verdict and the content share of every document."""
    weights, step = model

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for i, text in rows:
            yield (i, *judge(text, weights, step, share))

    return map_docs(docs, run, RULES, binary=False)


def judge(text: str, weights: np.ndarray, step: np.ndarray, share: float) -> tuple:
    x, sizes, dups = measured(text)
    words = split(text)
    n = len(words)
    repeats = repeated_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    content, labels = 0.0, []
    if x:
        labels = viterbi(np.array(x) @ weights, step)
        content = sum(s for s, y in zip(sizes, labels, strict=True) if y == 0) / n
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dups, repeats, failed, not failed and content >= share, content, len(labels), labels.count(0)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return rules(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
