"""Toxicity by weak supervision.

Voters are words and word beginnings (a lexicon, and others found in labelled rows), each at a level: present,
dense (at least DENSE of the words) or heavy (dense and more than once); and patterns of the text. A
generative model of the voters and of the given labels, fitted by expectation maximisation on labelled and
unlabelled documents alike, estimates each one's rates among toxic and clean documents and their correlations
given the class; correlated voters share their weight, and where no label is given it has no vote. A logistic
classifier of the votes and of a text's style is trained on the posterior labels and scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm.learning import bounded_sample, held_out, learnable
from millrace.llm.storage import Work

#: insults that vote whether or not the labelled rows hold them
LEXICON = (
    "asshole bastard bitch clown creep cretin degenerate disgusting douchebag dumbass filth freak garbage idiot imbecile loser lowlife moron parasite pathetic "
    "pig retard scum slut stupid trash vermin whore worthless arschloch abschaum dummkopf hurensohn missgeburt schlampe trottel vollidiot wichser "
    "abruti connard connasse cretin encule imbecile ordure pourriture salaud salope basura cabron escoria gilipollas idiota imbecil pendejo puta zorra"
).split()
PREFIXES = (4, 5, 6)
LEVELS = 3
DENSE = 0.01
PATTERNS = ("shouting", "exclaiming", "masked")
#: what the classifier sees besides the votes
STYLE = ("capitals", "marks", "words", "word length")
#: documents with fewer of a voter are no evidence for it
SUPPORT = 5


def word_features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of whole words lower-cased (A-Z), then features with their documents: those hashes and ones of beginnings of 4, 5 and 6 bytes.

    A feature's two low bits tell its kind: 3 a whole word, else the place of its length in PREFIXES. The two
    bits above are 0 here; voters have their level there.
    """
    low = K.LOWER[data]
    start, end = K.runs(K.WORD[low], offsets)
    prefix = K.prefix_sums(low)
    words = K.span_hash(prefix, start, end)
    doc = np.searchsorted(offsets, start, side="right") - 1
    features, docs = [(words & ~np.uint64(15)) | np.uint64(3)], [doc]
    for k, n in enumerate(PREFIXES):
        long = end - start >= n
        features.append((K.span_hash(prefix, start[long], start[long] + n) & ~np.uint64(15)) | np.uint64(k))
        docs.append(doc[long])
    return words, np.concatenate(features), np.concatenate(docs)


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.lower().encode(), np.uint8)
    return int(K.span_hash(K.prefix_sums(raw), np.array([0]), np.array([len(raw)]))[0]) & ~15 | 3


def patterns(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Pattern votes of each document: mostly capitals; three exclamation marks in a row; letters masked by asterisks."""
    n = len(offsets) - 1
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (upper, lower)]
    up, lo = (s[offsets[1:]] - s[offsets[:-1]] for s in sums)
    out = np.zeros((n, len(PATTERNS)), bool)
    out[:, 0] = (up > 3 * lo) & (up >= 20)
    if len(data) >= 4:
        bang = data == 33
        star = data == 42
        alpha = upper | lower
        for k, hit in ((1, bang[:-3] & bang[1:-2] & bang[2:-1]), (2, alpha[:-3] & star[1:-2] & star[2:-1] & alpha[3:])):
            where = np.flatnonzero(hit)
            doc = np.searchsorted(offsets, where, side="right") - 1
            out[doc[where + 3 < offsets[doc + 1] + (k == 1)], k] = True
    return out


def style(offsets: np.ndarray, data: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """(n, 4) numbers of about 0 to 1: share of capitals among A-Z and a-z, of ! and ? a word, the logarithm of the words, the bytes a word."""
    sums = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in ((data >= 65) & (data <= 90), (data >= 97) & (data <= 122), (data == 33) | (data == 63))]
    up, low, marks = (s[offsets[1:]] - s[offsets[:-1]] for s in sums)
    words = np.maximum(n_words, 1)
    return np.stack([up / np.maximum(up + low, 1), np.minimum(marks / words, 1), np.log1p(n_words) / 10, np.minimum(np.diff(offsets) / words / 10, 2)], 1)


def levels(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(n, LEVELS): which levels a feature reaches that occurs ``count`` times among ``words`` words."""
    dense = count >= DENSE * words
    return np.stack([count > 0, dense, dense & (count > 1)], 1)


class Voters:
    """Features with their level bits, sorted, followed by the patterns."""

    def __init__(self, features: np.ndarray):
        self.features = np.unique(np.asarray(features, np.uint64))
        level = ((self.features >> np.uint64(2)) & np.uint64(3)).astype(np.int64)
        self.base, at = np.unique(self.features & ~np.uint64(12), return_inverse=True)
        self.place = np.full((len(self.base), LEVELS), -1)
        self.place[at, level] = np.arange(len(self.features))
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.base >> np.uint64(4) & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.size = len(self.features) + len(PATTERNS)

    def votes(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, voter) pairs, each once, and the number of words of each document."""
        words, feature, doc = word_features(offsets, data)
        n_words = np.bincount(doc[: len(words)], minlength=len(offsets) - 1)
        maybe = np.flatnonzero(self.sieve[(feature >> np.uint64(4) & np.uint64(0xFFFF)).astype(np.int64)])
        feature, doc = feature[maybe], doc[maybe]
        at = np.minimum(np.searchsorted(self.base, feature), len(self.base) - 1)
        hit = self.base[at] == feature
        both, count = np.unique(doc[hit] * len(self.base) + at[hit], return_counts=True)
        doc, at = both // len(self.base), both % len(self.base)
        voter = np.where(levels(count, n_words[doc]), self.place[at], -1)
        row, level = np.nonzero(voter >= 0)
        pd, pk = np.nonzero(patterns(offsets, data))
        return np.concatenate([doc[row], pd]), np.concatenate([voter[row, level], len(self.features) + pk]), n_words


def choose_words(docs: list[np.ndarray], toxic: np.ndarray) -> list[int]:
    """Features that tell toxic from clean documents, each judged on toxic documents that the earlier ones leave unexplained.

    ``docs``: distinct features of each document. Ties go to whole words at the lowest level, then to longer beginnings at the highest.
    """
    feature = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
    if not len(feature):
        return []
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    known, inv = np.unique(feature, return_inverse=True)
    clean = np.bincount(inv, weights=~toxic[owner], minlength=len(known))
    hits = np.bincount(inv, weights=toxic[owner], minlength=len(known))
    worth = hits >= np.maximum(SUPPORT, 12 * clean)
    keep = worth[inv]
    inv, owner = inv[keep & toxic[owner]], owner[keep & toxic[owner]]
    kind, level = (known & np.uint64(3)).astype(np.int64), (known >> np.uint64(2) & np.uint64(3)).astype(np.int64)
    special = kind * LEVELS + np.where(kind == 3, -level, level)
    open_docs, out = toxic.copy(), []
    while True:
        left = np.bincount(inv[open_docs[owner]], minlength=len(known))
        score = left - 3 * clean
        best = int(np.lexsort((known, -special, -score))[0])
        if left[best] < SUPPORT or score[best] < SUPPORT:
            break
        out.append(int(known[best]))
        open_docs[owner[inv == best]] = False
    return out


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25, together: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class for each row, voters' rates by class (2 x voters) and their shared weights, and the label's rates.

    The given label (0, 1, or -1 for none) is one more voter, right at least as often as not; without one it
    abstains. Rates are taken from labelled rows for ``rounds`` rounds and then, ``together`` rounds, from all: not
    longer, since of many unlabelled rows the two classes that fit best need not be toxic and clean. In an
    unlabelled row a voter that does not fire abstains too, and only silence, where none fires, speaks for a
    clean document: voters are far from independent there, so many absences prove little. A voter never fires more readily on clean
    documents than on toxic ones: where the estimates say so, it has one rate and no say. A voter's weight is one
    over the sum of its correlations, given the class, with all voters (its own 1 included).
    """
    fires = votes.astype(float)
    given, silent = labels >= 0, ~votes.any(1)
    post = np.where(labels == 1, 0.9, 0.1)
    share = given.astype(float)
    rates = np.zeros((2, votes.shape[1]))
    weight = np.ones(votes.shape[1])
    label_rate = np.array([0.1, 0.9])
    for k in range(rounds + together):
        if k == rounds:
            share = np.ones(len(labels))
        cls = np.stack([1 - post, post]) * share
        size = cls.sum(1, keepdims=True)
        rates = (cls @ fires + 0.05) / (size + 1.0)
        same = rates[0] > rates[1]
        rates[:, same] = (fires[:, same].T @ share / share.sum()).clip(1e-6, 1 - 1e-6)
        quiet = np.sort((cls @ silent + 0.5) / (size[:, 0] + 1.0))[::-1]
        label_rate = np.clip((cls[:, given] @ labels[given] + 0.5) / (cls[:, given].sum(1) + 1.0), [0.001, 0.5], [0.5, 0.999])
        shared = np.zeros((votes.shape[1],) * 2)
        for c in range(2):
            centred = (fires - rates[c]) * np.sqrt(cls[c])[:, None]
            cov = centred.T @ centred / max(size[c, 0], 1.0)
            dev = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            shared += np.maximum(cov / np.outer(dev, dev), 0) * size[c, 0] / size.sum()
        np.fill_diagonal(shared, 1.0)
        shared[shared < 0.2] = 0
        weight = 1.0 / shared.sum(1)
        # labelled rows were drawn by class, so they and the others have each a share of toxic ones
        prior = np.clip(np.where(given, post[given].mean() if given.any() else 0.5, post[~given].mean() if not given.all() else 0.5), 1e-3, 1 - 1e-3)
        absent = np.where(given, (1 - fires) @ (weight * np.log((1 - rates[1]) / (1 - rates[0]))), silent * np.log(quiet[1] / quiet[0]))
        logit = np.log(prior / (1 - prior)) + fires @ (weight * np.log(rates[1] / rates[0])) + absent
        logit += np.where(labels == 1, np.log(label_rate[1] / label_rate[0]), np.where(given, np.log((1 - label_rate[1]) / (1 - label_rate[0])), 0.0))
        post = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
    return post, rates, weight, label_rate


def logistic(x: np.ndarray, y: np.ndarray, ridge: np.ndarray | float = 0.05, rounds: int = 40) -> np.ndarray:
    """Weights and intercept (last) of a ridge logistic regression on soft labels, by Newton steps; ``ridge`` may differ by column."""
    x = np.hstack([x.astype(float), np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), 1e-3)
    penalty[:-1] = ridge
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """``weights``: one a voter, one a number of style, and the intercept."""

    def __init__(self, voters: Voters, weights: np.ndarray, accuracies: dict):
        self.voters, self.weights, self.accuracies = voters, weights, accuracies

    def score(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        doc, voter, n_words = self.voters.votes(offsets, data)
        z = np.bincount(doc, weights=self.weights[voter], minlength=len(offsets) - 1) + self.weights[-1]
        z += style(offsets, data, n_words) @ self.weights[self.voters.size : -1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = 3000, clean_rows: int = 6000, unlabelled_rows: int = 3000) -> Model:
    """A model from about ``toxic_rows`` + ``clean_rows`` labelled learnable documents at most, and ``unlabelled_rows`` others of that fold; without labels, the lexicon decides alone.

    A document labelled more than once counts as toxic if any label says so. Near copies in the sample count
    once: of documents with an equal least hash of four-word windows, the one with the smallest id stays.
    """
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(learnable() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = bounded_sample(marked, "toxic", {0: clean_rows, 1: toxic_rows})
    fold = docs.where(learnable()).select("doc_id")
    place = F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    others = fold.where(place < min(1.0, unlabelled_rows / max(1, fold.count()))).distinct().join(marked, "doc_id", "left_anti")
    sample = sample.select("doc_id", "toxic").unionByName(others.select("doc_id", F.lit(-1).alias("toxic")))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")  # bounded by the parameters

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = K.text_bytes(batch.column(1))
            out = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                at, raw = np.array([0, b - a]), data[a:b]
                words, found, _ = word_features(at, raw)
                grams = K.combine(words, 4)
                least = [(K.mix(grams ^ np.uint64(s)).min(initial=np.uint64(0xFFFFFFFFFFFFFFFF))).tobytes() for s in (1, 2)] if len(grams) else [words.tobytes()] * 2
                found, count = np.unique(found, return_counts=True)
                reached, level = np.nonzero(levels(count, np.full(len(count), len(words))))
                out.append((*least, (found[reached] | (level.astype(np.uint64) << np.uint64(2))).tobytes(), patterns(at, raw)[0].tobytes(), style(at, raw, np.array([len(words)]))[0].tobytes()))
            cols = [pa.array(list(c), pa.binary()) for c in zip(*out)] if out else [pa.array([], pa.binary())] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], ["doc_id", "toxic", "least1", "least2", "features", "patterns", "style"])
        K.release()

    work = Work(docs.sparkSession, "toxicity")
    sampled = work.keep(rows.select("doc_id", "text", "toxic").mapInArrow(features, "doc_id bigint, toxic int, least1 binary, least2 binary, features binary, patterns binary, style binary"), "sample")
    seen: tuple[set, set] = (set(), set())
    kept = set()
    for r in sorted(sampled.select("doc_id", "toxic", "least1", "least2").collect(), key=lambda r: r.doc_id):
        keys = (bytes(r.least1), r.toxic), (bytes(r.least2), r.toxic)
        if keys[0] not in seen[0] and keys[1] not in seen[1]:
            kept.add(r.doc_id)
        for s, k in zip(seen, keys):
            s.add(k)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic in (0, 1):  # unlabelled rows find no voters
                mine = [np.frombuffer(f, np.uint64) for d, t, f in zip(*(c.to_pylist() for c in batch.columns)) if t == toxic and d in kept]
                if mine:
                    found, n = np.unique(np.concatenate(mine), return_counts=True)
                    n = pa.array(n)
                    none = pa.array(np.zeros(len(found), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), n if toxic else none, none if toxic else n], ["feature", "hits", "clean"])

    counts = sampled.select("doc_id", "toxic", "features").mapInArrow(count, "feature bigint, hits bigint, clean bigint").groupBy("feature").agg(F.sum("hits").alias("hits"), F.sum("clean").alias("clean"))
    telling = counts.where((F.col("hits") >= SUPPORT) & (F.col("hits") >= 12 * F.col("clean"))).select("feature").toArrow().column(0).to_numpy().view(np.uint64)
    wanted = np.unique(np.concatenate([telling, np.array(sorted(map(word_hash, LEXICON)), np.uint64)]))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = [np.intersect1d(np.frombuffer(f, np.uint64), wanted).tobytes() for f in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(few, pa.binary()), batch.column(3), batch.column(4)], ["doc_id", "toxic", "features", "patterns", "style"])

    got = sampled.select("doc_id", "toxic", "features", "patterns", "style").mapInArrow(reduce, "doc_id bigint, toxic int, features binary, patterns binary, style binary").collect()
    work.drop(work.root)
    kept = [(r.toxic, np.frombuffer(r.features, np.uint64), np.frombuffer(r.patterns, bool), np.frombuffer(r.style)) for r in sorted(got, key=lambda r: r.doc_id) if r.doc_id in kept]
    labels_given = np.array([t for t, *_ in kept], int)
    given = np.flatnonzero(labels_given >= 0)
    found = choose_words([kept[i][1] for i in given], labels_given[given] == 1)
    voters = Voters(np.array(sorted({*map(word_hash, LEXICON), *found}), np.uint64))
    votes = np.zeros((len(kept), voters.size), bool)
    for i, (_, f, p, _) in enumerate(kept):
        votes[i, : len(voters.features)] = np.isin(voters.features, f)
        votes[i, len(voters.features) :] = p
    if not (0 < (labels_given == 1).sum() < len(given)):  # nothing to tell apart: every lexicon word settles it
        weights = np.r_[np.full(len(voters.features), 6.0), np.zeros(len(PATTERNS) + len(STYLE)), -3.0]
        return Model(voters, weights, {})
    post, rates, shared, label_rate = label_model(votes, labels_given)
    numbers = np.stack([x for *_, x in kept])
    weights = logistic(np.hstack([votes, numbers]), post, np.r_[np.full(voters.size, 0.05), np.full(len(STYLE), 1.0)])
    never = ~votes.any(0)  # a lexicon word that the sample lacks keeps the lexicon's typical weight
    known = votes[:, : len(voters.features)].any(0)
    typical = np.median(weights[: len(voters.features)][known]) if known.any() else 6.0
    weights[: len(voters.features)][~known] = max(typical, 0.0)
    weights[: voters.size][never & (np.arange(voters.size) >= len(voters.features))] = 0.0
    return Model(voters, weights, {"rates": rates, "shared": shared, "label": label_rate})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``docs``; predicted is 1 from a score of 0.7 on.

    Whole texts are scored; a null text scores as an empty one. Repeated rows are repeated and extra columns
    ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = K.text_bytes(batch.column(2))
            out = np.zeros(len(batch))
            for i, j in K.slices(offsets):
                out[i:j] = shared.value.score(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array((out >= 0.7).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        K.release()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns kept, whatever their names, by a model trained on ``docs`` and ``labels``.

    A null text is judged as an empty one, a null id is never learned from; repeated rows go or stay together.
    Empty tables: nothing goes, or the lexicon decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = K.text_bytes(batch.column(at))
            out = np.zeros(len(batch), bool)
            for i, j in K.slices(offsets):
                out[i:j] = shared.value.score(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]) < 0.7
            yield batch.filter(pa.array(out))
        K.release()

    return docs.mapInArrow(run, docs.schema)
