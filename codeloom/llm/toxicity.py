"""Toxicity scores after noisy-channel deobfuscation.

Words written with digits and symbols for letters, with drawn-out letters or with gaps between letters become
character lattices; Viterbi decoding under a character language model restores them. The restored text
is scored by words that labelled rows show to be toxic, with a logistic curve over their weights; the other words' leaning ranks texts
that are alike in those.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialize, ship, steps, text_or_empty
from codeloom.llm.ngram_join import jaccard_components

# Letters that digits and symbols stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
#: Parts of the labelled sample; the curve is fitted to each with the words of the others.
FOLDS = 4
_ANY = "abcdefghijklmnopqrstuvwxyz"
_EDGE = ".,;:!?\"'()[]{}<>#%&*$|…-_~`«»“”’"
_LETTER = r"[^\W\d_]"
_DRAWN = re.compile(rf"({_LETTER})\1\1")
_STARS = re.compile(r"\*{9,}")
_DOTTED = re.compile(r"\w(?:[.\-_*~]\w){2,}")
_GAPPED = re.compile(r"(?<!\S)[\w@$!|+](?:[ \t][\w@$!|+]){2,}(?!\S)")
_STANDINS = re.escape("".join(LOOKALIKES))
_MIXED = re.compile(rf"(?:{_LETTER}[{_STANDINS}*]+{_LETTER})|(?:^[{_STANDINS}]{_LETTER}{{2}})|(?:{_LETTER}{{2}}[{re.escape(''.join(c for c in LOOKALIKES if c not in '!$'))}]$)|(?:[a-z][$]$)")


def trigrams(words: dict[str, float]) -> Counter[str]:
    """The trigrams of words with their marks of start and end, weighted by the words' numbers."""
    three: Counter[str] = Counter()
    for word, n in words.items():
        padded = f"^^{word}$"
        for i in range(2, len(padded)):
            three[padded[i - 2 : i + 1]] += n
    return three


@dataclass
class CharacterModel:
    """A trigram model of words, with bigrams and unigrams behind it."""

    three: dict[str, float] = field(default_factory=dict)
    two: dict[str, float] = field(default_factory=dict)
    floor: float = -9.0

    @staticmethod
    def of(words: dict[str, float]) -> CharacterModel:
        return CharacterModel.of_trigrams(trigrams(words))

    @staticmethod
    def of_trigrams(three: dict[str, float]) -> CharacterModel:
        two, context, first = Counter(), Counter(), Counter()
        for gram, n in three.items():
            context[gram[:2]] += n
            two[gram[1:]] += n
            first[gram[1]] += n
        return CharacterModel({k: math.log(0.8 * v / context[k[:2]] + 0.2 * two[k[1:]] / first[k[1]]) for k, v in three.items()}, {k: math.log(0.2 * v / first[k[0]]) for k, v in two.items()})

    def step(self, before: str, letter: str) -> float:
        found = self.three.get(before + letter)
        return found if found is not None else self.two.get(before[1] + letter, self.floor)


def decode(observed: str, model: CharacterModel) -> str:
    """The likeliest word behind ``observed``.

    Each character may stand for itself or, if it is a stand-in, for a letter that it looks like; ``*`` may stand for any
    letter; separators may vanish, and so may a letter that repeats the one before. Runs of over eight ``*`` are read as eight.
    """
    observed = _STARS.sub("*" * 8, observed)
    ways: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
    previous = ""
    for c in observed:
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, 0.0))
        elif c in LOOKALIKES:
            options += [(x, -1.0) for x in LOOKALIKES[c]]
        elif c == "*":
            options += [(x, -3.0) for x in _ANY]
        skip = None if c.isalpha() and c != previous else -0.5 if c == previous or not c.isalnum() and c not in LOOKALIKES else -4.0
        found: dict[str, tuple[float, str]] = {}
        for state, (score, path) in ways.items():
            if skip is not None and score + skip > found.get(state, (-math.inf, ""))[0]:
                found[state] = (score + skip, path)
            for letter, cost in options:
                key, value = state[1] + letter, score + cost + model.step(state, letter)
                if value > found.get(key, (-math.inf, ""))[0]:
                    found[key] = (value, path + letter)
        ways, previous = found or ways, c
    return max(((score + model.step(state, "$"), path) for state, (score, path) in ways.items()), default=(0.0, ""))[1]


def obfuscated(token: str) -> bool:
    return bool(_DRAWN.search(token) or _DOTTED.fullmatch(token) or (_MIXED.search(token) and any(map(str.isalpha, token))))


def restore_token(token: str, model: CharacterModel) -> list[str]:
    """The words of a lower-case token without white space."""
    plain = token.strip(_EDGE)
    if plain.isalpha() and not _DRAWN.search(plain):
        # A single stand-in at an edge may be a letter; runs of symbols are marks.
        if len(token) - len(plain) == 1 and token[0] == "$":
            return [plain, decode(token, model)]
        return [plain]
    core = token.strip("".join(c for c in _EDGE if c not in "$!|(")) if obfuscated(token) else plain
    core = re.sub(r"([^\w\s])\1+$", "", core)
    if obfuscated(core):
        return [decode(core, model)]
    return [w for w in re.split(r"[\W_]+", token) if w]


def restore(text: str, model: CharacterModel) -> str:
    """The lower-case text with its obfuscated words restored and marks at word edges left out."""
    lower = _GAPPED.sub(lambda m: " " + decode(re.sub(r"\s", "", m.group()), model) + " ", text.lower())
    return " ".join(w for t in lower.split() for w in restore_token(t, model))


@dataclass
class ToxicModel:
    weights: dict[str, float]
    letters: CharacterModel
    bias: float
    slopes: tuple[float, float]
    #: How far other words lean to toxic rows.
    leaning: dict[str, float] = field(default_factory=dict)

    def features(self, hits: Iterable[str]) -> tuple[float, float]:
        """The sum of the toxic words' weights, in tens and damped, and the number of different ones."""
        found = [self.weights[w] for w in hits]
        return 10 * math.log1p(sum(found) / 10), math.log1p(len(found))

    def score(self, hits: Iterable[str], leaning: float = 0.0) -> float:
        """``leaning``, the mean of a text's words, moves the log-odds by at most a half."""
        a, b = self.features(hits)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slopes[0] * a + self.slopes[1] * b)) - 0.5 * math.tanh(leaning)))


class Reader:
    """Reads the words of texts; tokens met before are remembered, up to a bound.

    With a vocabulary only its words are given, and the others' ``leaning`` is summed.
    """

    def __init__(self, vocabulary: Collection[str] | None, letters: CharacterModel, leaning: dict[str, float] | None = None, most: int = 500_000):
        self.vocabulary, self.letters, self.leaning, self.most = vocabulary, letters, leaning or {}, most
        self.known: dict[str, tuple[list[str], float]] = {}
        long = [w for w in vocabulary or () if len(w) >= 4]
        self.inside = re.compile("|".join(map(re.escape, sorted(long, key=len, reverse=True)))) if long else None

    def read(self, text: str) -> tuple[set[str], float]:
        """The distinct words of the restored text, of the vocabulary if there is one, and the mean leaning of its tokens."""
        lower = text.lower()
        tokens = set(lower.split())
        if len(self.known) > self.most:
            self.known.clear()
        for token in tokens.difference(self.known):
            found = restore_token(token, self.letters)
            leaning = sum(self.leaning.get(w, 0.0) for w in found)
            self.known[token] = (found if self.vocabulary is None else [w for w in found if w in self.vocabulary], leaning)
        out, total = set(), 0.0
        for found, leaning in map(self.known.__getitem__, sorted(tokens)):
            total += leaning
            if found:
                out.update(found)
        if self.inside is not None or self.vocabulary is None:
            for run in _GAPPED.findall(lower):
                whole = decode(re.sub(r"\s", "", run), self.letters)
                out.update([whole] if self.vocabulary is None else self.inside.findall(whole))
        return out, total / max(1, len(tokens))

    def words(self, text: str) -> set[str]:
        return self.read(text)[0]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients, the intercept first, by Newton steps."""
    z = np.c_[np.ones(len(x)), x]
    w = np.zeros(z.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def word_weights(counts: list[tuple[str, int, int]], positives: int, negatives: int, evidence: float) -> dict[str, float]:
    """Log-odds of the words that occur in toxic rows clearly more often: G² of ``evidence`` at least."""
    found = {}
    for word, p, n in counts:
        expected = (p + n) * positives / max(1, positives + negatives)
        if p > expected:
            other = (p + n) - expected
            g = 2 * (p * math.log(p / expected) + (n * math.log(n / other) if n else 0.0))
            # Two rows more than were seen stand against every word, so that rare words weigh less than frequent ones.
            weight = math.log((p + 0.5) / (positives + 1)) - math.log((n + 2) / (negatives + 4))
            if g >= evidence and weight >= 1.5:
                found[word] = min(weight, 8.0)
    return found


def letter_statistics(docs: DataFrame, text_col: str = "text", held_words: int = 500_000) -> tuple[dict[str, float], int]:
    """The trigrams of the words of all documents, with their counts, and the number of documents.

    A document counts each of its tokens once; obfuscated tokens are left out. A task holds about ``held_words`` distinct tokens
    before it folds them. Trigrams are summed before the driver gets them: as many as the alphabets allow.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter[str] = Counter()
        rows = 0

        def given() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for token, n in tokens.items():
                plain = token.strip(_EDGE)
                if not (_DRAWN.search(plain) or obfuscated(token) or obfuscated(plain)):
                    for word in re.split(r"[\W_]+", plain):
                        if word:
                            words[word] += n
            found = trigrams(words)
            found[""] = rows
            tokens.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["gram", "n"])

        for part in steps(batches, "text"):
            rows += part.num_rows
            for text in part.column("text").to_pylist():
                tokens.update(set(text.lower().split()))
            if len(tokens) > held_words:
                yield given()
                rows = 0
        yield given()

    counted = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = {r["gram"]: float(r["n"]) for r in counted.collect()}
    return found, int(found.pop("", 0))


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 20_000, lexicon_words: int = 5000, leaning_words: int = 20_000, evidence: float = 16.0
) -> ToxicModel:
    """A model from at most ``sample_rows`` labelled rows, those whose id's hash is least; copies and near copies (components of ``jaccard_components``) of one label count once, and of rows that repeat an id the least text.

    The character model is made from the words of all of ``docs``; labelled rows are restored by it before they are counted, and the toxic
    words found then join it. Without rows of both labels the model scores every text alike, at
    the rate of the label. The driver gets the distinct trigrams of all words, at most ``lexicon_words`` toxic words and ``leaning_words``
    frequent ones, with their counts, and a pair of numbers for each sampled row.
    """
    ship(docs.sparkSession)
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64(id_col, F.lit(23)), id_col).limit(sample_rows)
    rows = docs.join(F.broadcast(chosen), id_col).select(F.col(id_col).cast("long").alias("id"), "y", text_or_empty(text_col).alias("text"))  # at most sample_rows ids
    rows = rows.groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text"))  # of rows that repeat an id, the least text
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "toxic-rows")

    letters, documents = letter_statistics(docs, text_col)
    plain_letters = CharacterModel.of_trigrams(letters)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(None, plain_letters)
        for part in steps(batches, "text"):
            words = [sorted(reader.words(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), part.column("y"), pa.array(words, pa.list_(pa.string()))], ["row", "id", "y", "words"])

    # Of near copies with one label, the row with the least id stands for all.
    near = jaccard_components(rows, words=5, percent=75, id_col="row").select("row", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.lit(-1)).alias("component"))
    first = rows.select("row", "id", "y").join(near, "row").groupBy("component", "y").agg(F.min(F.struct("id", "row")).alias("first")).select("first.row")
    sample = rows.mapInArrow(read, "row long, id long, y int, words array<string>")
    sample = materialize(sample.join(first, "row", "left_semi").withColumn("fold", F.pmod(F.xxhash64("id", F.lit(29)), F.lit(FOLDS))), "toxic-distinct")
    totals: dict[int, list[int]] = {f: [0, 0] for f in range(FOLDS)}
    for r in sample.groupBy("fold", "y").count().collect():
        totals[r["fold"]][r["y"]] += r["count"]
    counts = [F.sum(((F.col("fold") == f) & (F.col("y") == y)).cast("int")).alias(f"c{f}{y}") for f in range(FOLDS) for y in (0, 1)]
    words = sample.select("fold", "y", F.explode("words").alias("w")).groupBy("w").agg(*counts, F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    words = materialize(words.where("n >= 3"), "toxic-words")
    positives, negatives = (sum(t[y] for t in totals.values()) for y in (1, 0))
    likely = words.where("p >= 3").withColumn("lift", F.expr("p * p / n")).orderBy(F.desc("lift"), "w").limit(lexicon_words).collect()
    weights = word_weights([(r["w"], r["p"], r["n"] - r["p"]) for r in likely], positives, negatives, evidence)
    if not positives or not negatives or not weights:
        rate = (positives + 0.5) / (positives + negatives + 1)
        return ToxicModel({}, plain_letters, math.log(rate / (1 - rate)), (0.0, 0.0))
    # A toxic word has the weight of 200 rows of the sample, in proportion to all documents.
    scale = max(1.0, documents / (positives + negatives))
    for gram, n in trigrams(dict.fromkeys(weights, 200.0 * scale)).items():
        letters[gram] = letters.get(gram, 0.0) + n
    frequent = words.orderBy(F.desc("n"), "w").limit(leaning_words).select("w", "n", "p").collect()
    leaning = {r["w"]: max(-2.0, min(2.0, math.log((r["p"] + 1) / (positives + 2)) - math.log((r["n"] - r["p"] + 1) / (negatives + 2)))) for r in frequent}
    # The curve is fitted to rows scored with the words of the other folds.
    others = {
        f: word_weights([(r["w"], r["p"] - r[f"c{f}1"], r["n"] - r["p"] - r[f"c{f}0"]) for r in likely], positives - totals[f][1], negatives - totals[f][0], evidence * (FOLDS - 1) / FOLDS)
        for f in range(FOLDS)
    }
    vocabulary = sorted({w for own in others.values() for w in own})
    held = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")
    model = ToxicModel(weights, CharacterModel.of_trigrams(letters), 0.0, (1.0, 1.0), leaning)
    x, y = [], []
    for r in sample.select("fold", "y", F.array_intersect("words", held).alias("hits")).collect():
        fold = ToxicModel(others[r["fold"]], model.letters, 0.0, (1.0, 1.0))
        x.append(fold.features([w for w in r["hits"] if w in fold.weights]))
        y.append(r["y"])
    fitted = fit_logistic(np.array(x), np.array(y, float), ridge=0.1)
    model.bias, model.slopes = float(fitted[0]), (max(0.0, float(fitted[1])), max(0.0, float(fitted[2])))
    return model


def score_documents(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, toxic_words) of every row, from its whole text: the score from 0 to 1 and the toxic words found.

    A null text counts as empty. Nothing but the text is read. Equal texts score alike. No shuffle.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.weights, model.letters, model.leaning)
        for part in steps(batches, "text"):
            read = [reader.read(t) for t in part.column("text").to_pylist()]
            found = [sorted(f) for f, _ in read]
            scores = [model.score(f, leaning) for f, (_, leaning) in zip(found, read)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.string()))], ["id", "score", "toxic_words"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, score double, toxic_words array<string>").withColumnRenamed("id", id_col)
