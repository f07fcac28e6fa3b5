"""Problem 7: consensus from several annotators' labels, assisted by item features.

A regularised softmax classifier over hashed item features and one confusion matrix per annotator
are fitted jointly by expectation-maximisation: the classifier's output is the prior of an item's
label, the confusion matrices turn the labels given into evidence, and the posteriors re-estimate
both.  Items stay distributed; each round is one pass in which every task returns partial sums
whose number depends on annotators, classes and features, never on items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

FEATURES = 512  # places of hashed words
#: The fit ends when no probability and no weight moves by TOLERANCE; not having ended after ROUNDS is an error.
ROUNDS = 200
TOLERANCE = 1e-4
#: An annotator's confusion matrix is drawn towards their one overall accuracy by so many labels,
#: and that accuracy towards chance by so many.
MATRIX_PRIOR = 20.0
ACCURACY_PRIOR = 2.0
#: L2 penalty of the classifier, in items.
RIDGE = 20.0
#: The model goes to every task: more annotators or lists of allowed labels than these, or more numbers in all,
#: are an error, not a cut.
MOST_ANNOTATORS, MOST_LISTS, MOST_NUMBERS = 100_000, 1_000, 20_000_000
AI = "(ai)"


def plain_label(column: Column | str) -> Column:
    """Label in upper case, outer blanks off, inner blanks, hyphens and underscores as one underscore."""
    c = F.upper(F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"^[\s\h_-]+|[\s\h_-]+$", ""))
    return F.regexp_replace(c, r"[\s\h_-]+", "_")


def valid_votes(sheet: DataFrame) -> DataFrame:
    """(reference, classes, annotator, label, n): valid labels with the weight they count.

    A ``review_id`` counts once, in the smallest of its rows; the AI counts once per reference (several
    AI labels share that one vote).  Labels outside the row's allowed list, null references and
    null lists give no vote; a null annotator is one annotator called ``(unknown)``.
    """
    rows = sheet.select(
        "review_id", "reference", F.split(F.col("allowed_human_labels"), "/").alias("allowed"), "ai_label", "human_label", "reviewer", "second_pass_label", "second_pass_reviewer"
    ).filter("reference is not null and allowed is not null")
    rows = rows.withColumn("spelt", F.filter(F.transform("allowed", lambda x: F.trim(x)), lambda x: x != ""))
    rows = rows.withColumn("classes", F.array_sort(F.array_distinct(F.transform("spelt", plain_label)))).drop("allowed", "spelt")
    name = lambda c: F.coalesce(F.nullif(F.lower(F.trim(F.col(c))), F.lit("")), F.lit("(unknown)"))
    human = F.struct(plain_label("human_label").alias("label"), name("reviewer").alias("annotator"))
    second = F.struct(plain_label("second_pass_label").alias("label"), name("second_pass_reviewer").alias("annotator"))
    once = (
        rows.filter("review_id is not null")
        .groupBy("reference", "review_id")
        .agg(F.min(F.struct("classes", human.alias("h"), second.alias("s"))).alias("v"))
        .select("reference", "v.classes", F.explode(F.array("v.h", "v.s")).alias("v"))
        .select("reference", "classes", "v.annotator", "v.label")
        .filter("label is not null and array_contains(classes, label)")
        .groupBy("reference", "classes", "annotator", "label")
        .agg(F.count("*").cast("double").alias("n"))
    )
    ai = rows.select("reference", "classes", plain_label("ai_label").alias("label")).filter("array_contains(classes, label)").distinct()
    ways = ai.groupBy("reference", "classes").agg(F.count("*").alias("c"))
    ai = ai.join(ways, ["reference", "classes"]).select("reference", "classes", F.lit(AI).alias("annotator"), "label", (1 / F.col("c")).alias("n"))
    return once.unionByName(ai)


def item_features(sheet: DataFrame, columns: list[str]) -> DataFrame:
    """(reference, features): hashed words of an item's cells, each with its column, in FEATURES places."""
    words = F.concat(*(F.transform(F.split(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w, c=c: F.concat(F.lit(f"{c}="), w)) for c in columns))
    each = sheet.filter("reference is not null").select("reference", F.explode(words).alias("f")).filter("not endswith(f, '=')")
    place = F.pmod(F.xxhash64("f"), F.lit(FEATURES - 1)).cast("int") + 1  # place 0 is the intercept
    return each.select("reference", place.alias("f")).groupBy("reference").agg(F.collect_set("f").alias("features"))


@dataclass
class Model:
    annotators: dict[str, int]
    classes: dict[tuple[str, ...], int] = field(default_factory=dict)
    confusion: list[np.ndarray] = field(default_factory=list)  # per class list: log P [annotator, true, given]
    weights: list[np.ndarray] = field(default_factory=list)  # per class list: [FEATURES, class]

    def posteriors(self, batch: pd.DataFrame) -> Iterator["Scored"]:
        """The items of a coded batch, one class list after the other."""
        place = batch["place"].to_numpy()
        for k in range(len(self.weights)):
            rows = np.flatnonzero(place == k)
            if not len(rows):
                continue
            own = batch.iloc[rows]
            feature_of, feature = _flat(own["features"])
            vote_of, annotator = _flat(own["annotators"])
            given, n = _flat(own["given"])[1], _flat(own["n"])[1].astype(np.float64)
            logit = np.repeat(self.weights[k][:1], len(rows), 0)
            np.add.at(logit, feature_of, self.weights[k][feature])
            evidence = logit.copy()
            np.add.at(evidence, vote_of, n[:, None] * self.confusion[k][annotator, :, given])
            yield Scored(k, rows, _softmax(logit), _softmax(evidence), feature_of, feature, vote_of, annotator, given, n)


@dataclass
class Scored:
    place: int
    rows: np.ndarray
    prior: np.ndarray
    post: np.ndarray
    feature_of: np.ndarray
    feature: np.ndarray
    vote_of: np.ndarray
    annotator: np.ndarray
    given: np.ndarray
    n: np.ndarray


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(item, value) of every entry of a column of arrays; null is an empty array."""
    filled = [x if x is not None else () for x in lists]
    size = np.fromiter(map(len, filled), np.int64, len(filled))
    return np.repeat(np.arange(len(filled)), size), np.concatenate([np.asarray(x) for x in filled if len(x)] or [np.empty(0, np.int64)])


def _softmax(logit: np.ndarray) -> np.ndarray:
    e = np.exp(logit - logit.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


CODED = "reference string, place int, features array<int>, annotators array<int>, given array<int>, n array<double>"


def _coded(annotators: dict[str, int], lists: list[tuple[str, ...]]):
    """Items with annotators, labels and class lists as numbers, once for all rounds."""
    place = {c: k for k, c in enumerate(lists)}

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = [tuple(c) for c in batch["classes"]]
            yield pd.DataFrame(
                {
                    "reference": batch["reference"],
                    "place": [place[c] for c in names],
                    "features": batch["features"],
                    "annotators": [[annotators[v["annotator"]] for v in votes] for votes in batch["votes"]],
                    "given": [[c.index(v["label"]) for v in votes] for c, votes in zip(names, batch["votes"])],
                    "n": [[v["n"] for v in votes] for votes in batch["votes"]],
                }
            )

    return code


SUMS = "kind string, place int, a int, b int, c int, value double"


def _entries(kind: str, place: int, array: np.ndarray) -> pd.DataFrame:
    where = np.nonzero(array)
    index = [*where, *[np.zeros(len(where[0]), np.int64)] * (3 - len(where))]
    return pd.DataFrame({"kind": kind, "place": place, "a": index[0], "b": index[1], "c": index[2], "value": array[where]})


def _partial_sums(model: Model):
    """Expected counts and gradients of a task's items."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = [np.zeros_like(c).transpose(0, 2, 1).copy() for c in model.confusion]  # [annotator, given, true]
        grads = [np.zeros_like(w) for w in model.weights]
        for batch in batches:
            for s in model.posteriors(batch):
                apart = s.post - s.prior
                grads[s.place][0] += apart.sum(0)
                np.add.at(grads[s.place], s.feature, apart[s.feature_of])
                np.add.at(counts[s.place], (s.annotator, s.given), s.n[:, None] * s.post[s.vote_of])
        for k in range(len(counts)):
            yield _entries("confusion", k, counts[k].transpose(0, 2, 1))
            yield _entries("gradient", k, grads[k])

    return sums


def _together(lists: int):
    """How often two features meet in an item, of a task's items, per class list."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = [np.zeros((FEATURES, FEATURES)) for _ in range(lists)]
        for batch in batches:
            for place, features in zip(batch["place"], batch["features"]):
                f = np.concatenate(([0], features if features is not None else [])).astype(np.int64)
                met[place][np.ix_(f, f)] += 1
        for k in range(lists):
            yield _entries("together", k, met[k])

    return sums


def _summed(coded: DataFrame, sums) -> pd.DataFrame:
    """The sums over all tasks; their number depends on annotators, classes and features, never on items."""
    return coded.mapInPandas(sums, SUMS).groupBy("kind", "place", "a", "b", "c").agg(F.sum("value").alias("value")).toPandas()


def _filled(sums: pd.DataFrame, kind: str, like: list[np.ndarray]) -> list[np.ndarray]:
    out = [np.zeros_like(x) for x in like]
    for k, x in enumerate(out):
        part = sums[(sums["kind"] == kind) & (sums["place"] == k)]
        x[tuple(part[c] for c in "abc"[: x.ndim])] = part["value"]
    return out


def _inverse(m: np.ndarray) -> np.ndarray:
    """Inverse of a positive definite matrix, by elimination: a driver's threaded solver may compete with its tasks for cores."""
    a, out = m.copy(), np.eye(len(m))
    for k in range(len(m)):
        pivot = a[k, k]
        a[k] /= pivot
        out[k] /= pivot
        column = a[:, k].copy()
        column[k] = 0
        rows = np.flatnonzero(column)
        a[rows] -= column[rows, None] * a[k]
        out[rows] -= column[rows, None] * out[k]
    return out


def _confusions(counts: list[np.ndarray]) -> list[np.ndarray]:
    """Smoothed log confusion matrices from expected counts of all class lists."""
    right = sum(np.einsum("akk->a", c) for c in counts)
    total = sum(c.sum((1, 2)) for c in counts)
    # chance level of what the annotator was asked
    chance = sum(c.sum((1, 2)) / c.shape[1] for c in counts) / np.maximum(total, 1e-9)
    accuracy = np.clip((right + ACCURACY_PRIOR * np.where(total > 0, chance, 0.5)) / (total + ACCURACY_PRIOR), 0.01, 0.99)
    out = []
    for c in counts:
        k = c.shape[1]
        if k == 1:
            out.append(np.zeros_like(c))
            continue
        coin = np.where(np.eye(k, dtype=bool), accuracy[:, None, None], (1 - accuracy[:, None, None]) / (k - 1))
        smooth = c + MATRIX_PRIOR * coin
        out.append(np.log(smooth / smooth.sum(2, keepdims=True)))
    return out


def fit_consensus(sheet: DataFrame, feature_columns: list[str], rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, Scratch]:
    """(items, annotators, scratch).

    ``items``: ``reference``, ``consensus_label`` (in the spelling of the allowed list), ``confidence``,
    ``agreement`` (share of its valid labels that equal the consensus), ``n_labels``, ``ai_label``.
    ``annotators``: ``annotator``, ``reliability`` (expected share of labels that are right), ``n_labels``.
    Ties go to the label that sorts first.  Items without a valid label are left out.
    """
    spark = sheet.sparkSession
    scratch = Scratch(spark, "consensus")
    votes = scratch.table(valid_votes(sheet))
    # an item holds each annotator and label once, so its list is bounded by those, not by its rows
    items = votes.groupBy("reference", "classes").agg(F.array_sort(F.collect_list(F.struct("annotator", "label", "n"))).alias("votes"))
    items = scratch.table(items.join(item_features(sheet, feature_columns), "reference", "left"))
    names = [r[0] for r in votes.select("annotator").distinct().orderBy("annotator").limit(MOST_ANNOTATORS + 1).collect()]
    if len(names) > MOST_ANNOTATORS:
        raise ValueError(f"more than {MOST_ANNOTATORS} annotators")
    lists = [tuple(r[0]) for r in items.select("classes").distinct().orderBy("classes").limit(MOST_LISTS + 1).collect()]
    if len(lists) > MOST_LISTS or sum(len(names) * len(c) ** 2 for c in lists) + len(lists) * FEATURES**2 > MOST_NUMBERS:
        raise ValueError(f"{len(names)} annotators and {len(lists)} lists of labels make a model of more than {MOST_NUMBERS} numbers")
    model = Model({a: k for k, a in enumerate(names)}, {c: k for k, c in enumerate(lists)})
    coded = scratch.table(items.mapInPandas(_coded(model.annotators, lists), CODED))
    model.weights = [np.zeros((FEATURES, len(c))) for c in lists]
    # start: every annotator right in seven of ten
    start = [np.where(np.eye(len(c), dtype=bool), 0.7, 0.3 / max(1, len(c) - 1))[None].repeat(len(names), 0) for c in lists]
    model.confusion = [np.log(s / s.sum(2, keepdims=True)) for s in start]
    counts = start
    if lists:
        # the curvature of a softmax is at most half of how features meet, so these steps always go uphill
        together = _filled(_summed(coded, _together(len(lists))), "together", [np.zeros((FEATURES, FEATURES)) for _ in lists])
        bound = [_inverse(0.5 * t + RIDGE * np.eye(FEATURES)) for t in together]
        for _ in range(rounds):
            sums = _summed(coded, _partial_sums(model))
            counts, grads = _filled(sums, "confusion", model.confusion), _filled(sums, "gradient", model.weights)
            confusion = _confusions(counts)
            weights = [w + np.einsum("ij,jk->ik", h, g - RIDGE * w) for w, g, h in zip(model.weights, grads, bound)]
            change = max(np.abs(np.exp(a) - np.exp(b)).max() for a, b in zip(confusion, model.confusion))
            change = max(change, *(np.abs(a - b).max() for a, b in zip(weights, model.weights)))
            model = Model(model.annotators, model.classes, confusion, weights)
            if change < TOLERANCE:
                break
        else:
            raise RuntimeError(f"the fit still moves by {change:.2g} after {rounds} rounds")
        counts = _filled(_summed(coded, _partial_sums(model)), "confusion", model.confusion)
    final = model

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in final.posteriors(batch):
                best = s.post.round(12).argmax(1)
                total, same = np.zeros(len(s.rows)), np.zeros(len(s.rows))
                np.add.at(total, s.vote_of, s.n)
                np.add.at(same, s.vote_of, s.n * (s.given == best[s.vote_of]))
                labels = np.array(lists[s.place], object)
                yield pd.DataFrame(
                    {"reference": batch["reference"].to_numpy()[s.rows], "plain": labels[best], "confidence": s.post[np.arange(len(best)), best], "agreement": same / total, "n_labels": total}
                )

    decided = coded.mapInPandas(decide, "reference string, plain string, confidence double, agreement double, n_labels double")
    spelling = (
        sheet.filter("reference is not null")
        .select("reference", F.explode(F.split("allowed_human_labels", "/")).alias("s"))
        .select("reference", plain_label("s").alias("plain"), F.trim("s").alias("consensus_label"))
        .groupBy("reference", "plain")
        .agg(F.min("consensus_label").alias("consensus_label"))
    )
    ai = sheet.filter("reference is not null").groupBy("reference").agg(F.min(plain_label("ai_label")).alias("ai_label"))
    result = decided.join(spelling, ["reference", "plain"]).join(ai, "reference")
    right = sum(np.einsum("akk->a", c) for c in counts) if lists else np.zeros(0)
    total = sum(c.sum((1, 2)) for c in counts) if lists else np.zeros(0)
    people = spark.createDataFrame(
        pd.DataFrame({"annotator": pd.Series(names, dtype=str), "reliability": right / np.maximum(total, 1e-9), "n_labels": total}).round(6),
        "annotator string, reliability double, n_labels double",
    )
    return result, people, scratch
