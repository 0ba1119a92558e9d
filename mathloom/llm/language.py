"""Language identification by a linear-chain conditional random field over words.

Each word's emission comes from its affixes, character n-grams and a learned
lexicon; learned transitions tie neighbours. Forward-backward gives each word's
language distribution in code-switched text; a document's score of a language is the
mean over its words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, held_out_bucket, private

SLOTS = 1 << 16
UNDETERMINED = "und"
#: New words that are scored at once; each has some 20 slots.
MOST_NEW = 8192
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ASCII_WORD = re.compile("[a-z]+")


def _slot(values: np.ndarray, kind: int) -> np.ndarray:
    """Slots of some 64-bit values of one kind of feature."""
    x = values + np.uint64(kind * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(48)).astype(np.int64) & (SLOTS - 1)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, how many each word has) of lower-case words, none of them empty, word by word.

    A word has itself, its affixes of 1 to 3 letters (border included), its n-grams of
    2 and 3 letters, and its letters beyond ASCII; what comes twice in a word counts twice.
    All words are taken side by side, as one row of code points with borders between them.
    """
    row = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    long = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(long)
    first = ends - long
    inside = np.arange(len(row)) - np.repeat(first, long)  # place in the word
    left = np.repeat(ends, long) - np.arange(len(row))  # letters from here on
    padded = np.concatenate((row, np.zeros(3, np.uint64)))
    two = (row << np.uint64(21)) | padded[1:-2]
    three = (two << np.uint64(21)) | padded[2:-1]
    four = three * np.uint64(0x100000001B3) + padded[3:]
    whole = np.add.reduceat(_mixed(row, inside), first)
    beyond = row > 0x7F
    has_four = long > 3
    every = np.arange(len(words))
    owner = np.repeat(every, long)
    parts = [
        (every, _slot(whole, 1)),
        (owner[left >= 2], _slot(two[left >= 2], 2)),
        (owner[left >= 3], _slot(three[left >= 3], 3)),
        (every, _slot(two[first], 4)),
        (every, _slot(three[first], 5)),
        (every[has_four], _slot(four[first[has_four]], 6)),
        (every, _slot(two[ends - 2], 7)),
        (every, _slot(three[ends - 3], 8)),
        (every[has_four], _slot(four[ends[has_four] - 4], 9)),
        (owner[beyond], _slot(row[beyond], 10)),
    ]
    counts = [np.bincount(o, minlength=len(words)) for o, _ in parts]
    sizes = np.sum(counts, axis=0)
    slots = np.empty(int(sizes.sum()), np.int64)
    free = np.cumsum(sizes) - sizes
    for (o, s), n in zip(parts, counts):
        slots[free[o] + np.arange(len(o)) - (np.cumsum(n) - n)[o]] = s
        free += n
    return slots, sizes


def _mixed(row: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """A value of each letter and its place, whose sum tells words apart."""
    x = (row + (inside.astype(np.uint64) << np.uint64(21))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    return x * np.uint64(0x94D049BB133111EB)


@dataclass
class ChainModel:
    languages: list[str]
    emission: np.ndarray  # SLOTS x languages
    transition: np.ndarray  # languages x languages, log weights
    lexicon: dict[str, np.ndarray] = field(default_factory=dict)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Emissions of lower-case words, a row each."""
        slots, sizes = word_features(words)
        rows = np.add.reduceat(self.emission[slots], np.cumsum(sizes) - sizes) / np.sqrt(sizes)[:, None]
        for i, w in enumerate(words):
            if w in self.lexicon:
                rows[i] += self.lexicon[w]
        return rows

    def posteriors(self, scores: np.ndarray, first: np.ndarray, block: int = 256) -> np.ndarray:
        """Language distribution of each word; `first` marks words that start a document.

        The words of all documents form one chain whose links into a first word are
        cut. Blocks of words are multiplied out side by side, the block borders are
        then passed through in order, and the insides are filled side by side.
        """
        n, k = scores.shape
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        moves = np.exp(self.transition - self.transition.max())
        pad = -n % block
        e = np.concatenate((e, np.ones((pad, k)))).reshape(-1, block, k)
        cut = np.concatenate((first, np.ones(pad, bool))).reshape(-1, block)
        blocks = len(e)
        even = np.full((k, k), 1.0 / k)
        # word by word, so that a step reads what lies together; links are cut in few blocks of a step
        at = np.ascontiguousarray(e.transpose(1, 0, 2))
        cuts = [np.flatnonzero(column) for column in cut.T]

        def moved_by(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
            return (rows.reshape(-1, k) @ by).reshape(rows.shape)

        def forward_step(rows: np.ndarray, j: int) -> np.ndarray:
            """rows (blocks, m, k): distributions before word j of the blocks -> after it."""
            moved = moved_by(rows, moves)
            if len(cuts[j]):
                moved[cuts[j]] = rows[cuts[j]].sum(axis=2, keepdims=True) * even[0]
            moved *= at[j][:, None, :]
            return moved

        def backward_step(rows: np.ndarray, j: int) -> np.ndarray:
            """rows (blocks, m, k): weights after word j -> before it."""
            weighed = rows * at[j][:, None, :]
            moved = moved_by(weighed, moves.T)
            if len(cuts[j]):
                moved[cuts[j]] = np.repeat(weighed[cuts[j]].sum(axis=2, keepdims=True) / k, k, axis=2)
            return moved

        def scaled(x: np.ndarray) -> np.ndarray:
            x /= np.maximum(x.reshape(blocks, -1).max(axis=1), 1e-300)[:, None, None]
            return x

        through = np.repeat(np.eye(k)[None], blocks, axis=0)
        for j in range(block):
            through = scaled(forward_step(through, j))
        enter = np.empty((blocks, 1, k))
        leave = np.empty((blocks, 1, k))
        state = even[0].copy()
        for b in range(blocks):
            enter[b, 0] = state
            state = state @ through[b]
            state /= state.sum()
        state = np.ones(k)
        for b in range(blocks - 1, -1, -1):
            leave[b, 0] = state
            state = through[b] @ state
            state /= state.sum()
        ahead = np.empty((blocks, block, k))
        rows = enter
        for j in range(block):
            rows = scaled(forward_step(rows, j))
            ahead[:, j] = rows[:, 0]
        rows = leave
        for j in range(block - 1, -1, -1):
            ahead[:, j] *= rows[:, 0]
            rows = scaled(backward_step(rows, j))
        out = ahead.reshape(-1, k)[:n]
        return out / out.sum(axis=1, keepdims=True)


def words_of(text: str | None) -> list[str]:
    """Runs of letters (with their marks) of a whole text in lower case; unspaced scripts give a word a sentence."""
    if not text:
        return []
    return (ASCII_WORD if text.isascii() else WORD).findall(text.lower())


class Labeller:
    """Applies a model to texts; scores of frequent words are kept, up to a bounded number of them."""

    def __init__(self, model: ChainModel, most_known: int = 100_000, most_letters: int = 2_000_000):
        self.model, self.most_known, self.most_letters = model, most_known, most_letters
        self.letters = 0
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages)))

    def scores(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.most_known or self.letters > self.most_letters:
            self.known.clear()
            self.letters = 0
            self.table = self.table[:1024].copy()
        new = sorted(set(words).difference(self.known))
        if new:
            size = len(self.known)
            if size + len(new) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros((size + len(new), self.table.shape[1]))))[: 2 * (size + len(new))]
            for begin in range(0, len(new), MOST_NEW):
                some = new[begin : begin + MOST_NEW]
                self.table[size + begin : size + begin + len(some)] = self.model.word_scores(some)
            self.known.update(zip(new, range(size, size + len(new))))
            self.letters += sum(map(len, new))
        return self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def documents(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text: the language with the highest mean share, the first by name at ties."""
        split = [words_of(t) for t in texts]
        flat = [w for words in split for w in words]
        if not flat or not self.model.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        sizes = np.array([len(w) for w in split])
        ends = np.cumsum(sizes)
        first = np.zeros(len(flat), bool)
        first[(ends - sizes)[sizes > 0]] = True
        worded = np.flatnonzero(sizes)
        means = np.add.reduceat(self.model.posteriors(self.scores(flat), first), (ends - sizes)[worded], axis=0) / sizes[worded, None]
        means = np.round(np.clip(means, 0.0, 1.0), 9)  # so that equal texts have equal scores, whatever stands beside them
        out = [(UNDETERMINED, 0.0)] * len(texts)
        for i, mean in zip(worded.tolist(), means):
            best = int(mean.argmax())
            out[i] = (self.model.languages[best], float(mean[best]))
        return out


def fit_chain(texts: list[tuple[str, str]], epochs: int = 3, lexicon: int = 400, length: int = 32, batch: int = 32, rate: float = 0.05, seed: int = 11) -> ChainModel:
    """A chain fitted by Adam on the conditional likelihood of word labels, from a bounded list of (text, language).

    A word's label is the language of its text. Texts are cut into stretches, and
    stretches of different texts are strung together at random, so that the
    transitions are learned from code-switched sequences. The lexicon holds the
    `lexicon` most frequent words of each language; all other words are known by their parts.
    """
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in texts})
    k = len(languages)
    model = ChainModel(languages, np.zeros((SLOTS, k)), np.zeros((k, k)))
    if k == 0:
        return model
    counts: dict[str, np.ndarray] = {}
    stretches = []
    for text, lang in texts:
        words = words_of(text)
        label = languages.index(lang)
        for w in words:
            counts.setdefault(w, np.zeros(k))[label] += 1
        at = 0
        while at < len(words):
            size = int(rng.integers(4, 2 * length))
            stretches.append((words[at : at + size], label))
            at += size
    if not stretches:
        return model
    totals = np.maximum(sum(counts.values()), 1)
    chosen = {w for j in range(k) for w in sorted(counts, key=lambda w: (-counts[w][j], w))[:lexicon] if counts[w][j] > 1}
    for w in chosen:
        rates = np.log((counts[w] + 0.5) / (totals + 1))
        model.lexicon[w] = np.clip(rates - rates.mean(), -2, 2)
    known = sorted(counts)
    all_slots, all_sizes = word_features(known)
    slots_of = dict(zip(known, np.split(all_slots, np.cumsum(all_sizes)[:-1])))
    moments = [np.zeros((SLOTS, k)), np.zeros((SLOTS, k)), np.zeros((k, k)), np.zeros((k, k))]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(stretches))
        for at in range(0, len(order), batch):
            words = [w for i in order[at : at + batch] for w in stretches[i][0]]
            labels = np.array([stretches[i][1] for i in order[at : at + batch] for _ in stretches[i][0]])
            lists = [slots_of[w] for w in words]
            sizes = np.array([len(s) for s in lists])
            slots = np.concatenate(lists)
            root = np.sqrt(sizes)
            scores = np.add.reduceat(model.emission[slots], np.concatenate(([0], np.cumsum(sizes)[:-1]))) / root[:, None]
            scores += np.array([model.lexicon.get(w, np.zeros(k)) for w in words])
            node, edge = _marginals(scores, model.transition)
            node[np.arange(len(labels)), labels] -= 1
            np.subtract.at(edge, (labels[:-1], labels[1:]), 1)
            grad = np.repeat(node / root[:, None], sizes, axis=0) / batch
            used, inverse = np.unique(slots, return_inverse=True)
            g = np.stack([np.bincount(inverse, grad[:, j], len(used)) for j in range(k)], axis=1) + 1e-4 * model.emission[used]
            step += 1
            for target, where, gradient, m, s in ((model.emission, used, g, *moments[:2]), (model.transition, slice(None), edge / batch, *moments[2:])):
                m[where] = 0.9 * m[where] + 0.1 * gradient
                s[where] = 0.99 * s[where] + 0.01 * gradient**2
                target[where] -= rate * m[where] / (1 - 0.9**step) / (np.sqrt(s[where] / (1 - 0.99**step)) + 1e-8)
    return model


def _marginals(scores: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node marginals and summed edge marginals of one sequence, by forward-backward."""
    n, k = scores.shape
    e, moves = np.exp(scores - scores.max(axis=1, keepdims=True)), np.exp(transition - transition.max())
    ahead, back = np.empty((n, k)), np.ones((n, k))
    ahead[0] = e[0] / e[0].sum()
    for t in range(1, n):
        row = (ahead[t - 1] @ moves) * e[t]
        ahead[t] = row / row.sum()
    for t in range(n - 2, -1, -1):
        row = moves @ (e[t + 1] * back[t + 1])
        back[t] = row / row.sum()
    node = ahead * back
    node /= node.sum(axis=1, keepdims=True)
    right = e[1:] * back[1:]
    norm = np.einsum("ti,ij,tj->t", ahead[:-1], moves, right)
    edge = np.einsum("ti,ij,tj->ij", ahead[:-1] / norm[:, None], moves, right)
    return node, edge


def train_languages(docs: DataFrame, most_rows: int = 600, folds: int = 3, held_out: int = 1, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> ChainModel:
    """A chain fitted on texts with a non-null language outside the held-out fold.

    The fit sees the whole texts of at most about `most_rows` rows, chosen by a hash of
    the id (a bound of the fit alone).
    """
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL").where(held_out_bucket("doc_id", folds) != held_out)
    sample = bounded_sample(known, "doc_id", most_rows, "language")
    rows = sample.select("text", "lang", F.xxhash64("doc_id", "text").alias("at")).orderBy("at", "lang").collect()
    return fit_chain([(r["text"], r["lang"]) for r in rows])


def identify(docs: DataFrame, model: ChainModel, text: str = "text", batch_chars: int = 500_000) -> DataFrame:
    """docs and the columns lang_pred and lang_score, for every row.

    Whole texts are labelled. Null texts and texts without a letter give `und` and 0;
    so does every text if the model has no language. Columns of docs with these
    names are replaced; repeated rows come back as often; an empty table gives an empty one.
    """
    new = ("lang_pred", "lang_score")
    kept = [c for c in docs.columns if c not in new]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS rows and the lexicon

    def label(batches):
        labeller = Labeller(shared.value)
        for batch in batches:
            found: list = []
            held: list = []
            size = 0
            for value in batch.column(len(kept)):
                held.append(value.as_py())
                size += len(held[-1] or "")
                if size >= batch_chars:
                    found += labeller.documents(held)
                    held, size = [], 0
            found += labeller.documents(held)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*kept, *new])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias(private(docs, "__text"))).mapInArrow(label, f"{fields}, lang_pred string, lang_score double")
