"""Toxicity: a linear classifier on words and word beginnings of whole texts, kept indifferent to swapped identity terms.

Each labelled row that names a group is also looked at with the term swapped for others of its kind; the squared
change of the score is added to the loss, so that neutral mentions of a group carry no weight of their own.

Edge cases: a null, empty or wordless text gets the base rate's score. Without labels of both kinds the score is the
share of toxic labels (0 without any). A document with several labels counts as toxic if one of them says so. Repeated
rows are scored alike. Columns named like an output are replaced by it; all other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import fresh, quoted, returns_memory, slices, trim_memory, unit_hash
from flowloom.llm.learn import FTRL
from flowloom.llm.text import normalized, words_of

#: Bounds of the labelled rows the weights are fitted on, and of the features they may use.
FIT_TOXIC, FIT_CLEAN, FIT_FEATURES = 1_500, 3_000, 200_000
#: Besides whole words, their first bytes are features, so that stems count in all their forms.
PREFIXES = (4, 5, 6, 7, 8)
EPOCHS = 2
SWAP_WEIGHT = 4.0
#: Words for groups of people; a term may be swapped for any other of its line.
IDENTITY_TERMS = (
    "woman man girl boy transgender nonbinary", "women men girls boys",
    "christian muslim jew buddhist hindu atheist", "christians muslims jews buddhists hindus atheists",
    "gay straight lesbian bisexual queer", "black white asian latino arab african",
    "american mexican chinese german french spanish polish turkish indian russian", "immigrant refugee foreigner native",
    "disabled deaf blind autistic", "frau mann", "frauen männer", "christ muslim jude", "christen muslime juden",
    "femme homme", "femmes hommes", "chrétien musulman juif", "mujer hombre", "mujeres hombres", "cristiano musulmán judío",
)


@dataclass
class ToxicityModel:
    """Sorted feature hashes, two weights each (for the logarithm of the count and for the density), the intercept."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float


def features_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature hash, text, words of each text): one entry per word and per prefix that a word has."""
    words, offsets, *heads = words_of(column, PREFIXES)
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(column)), sizes)
    found = np.concatenate([words, *heads])
    owner = np.tile(text, 1 + len(heads))
    return found[found != 0], owner[found != 0], sizes


def values_of(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The two values of a feature: log count, and density in occurrences per 50 words, at most 3."""
    return np.stack([np.log1p(counts), np.minimum(50 * counts / np.maximum(words, 1), 3.0)], axis=-1)


def hashes_of_terms(line: str) -> list[np.ndarray]:
    """For each term its features, the whole word first."""
    return [features_of(pa.array([term]))[0] for term in line.split()]


def swap_ways(groups: list[list[np.ndarray]]) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """By the hash of each whole term, what a swap with another of any of its groups takes away and brings."""
    ways: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for group in groups:
        for term in group:
            ways.setdefault(int(term[0]), []).extend((np.setdiff1d(term, o), np.setdiff1d(o, term)) for o in group if o is not term)
    return {term: found for term, found in ways.items() if found}


def swap_change(found: np.ndarray, n: np.ndarray, size: int, times: int, lost: np.ndarray, won: np.ndarray) -> np.ndarray:
    """What the swap of a term that occurs `times` times takes from the values of the features `lost` and `won`."""
    both = np.concatenate([lost, won])
    at = np.minimum(np.searchsorted(found, both), len(found) - 1)
    before = np.where(found[at] == both, n[at], 0)
    after = np.maximum(before + np.repeat([-times, times], [len(lost), len(won)]), 0)
    return (values_of(before, np.full(len(both), size)) - values_of(after, np.full(len(both), size))).ravel()


@returns_memory
def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
    toxic: int = FIT_TOXIC,
    clean: int = FIT_CLEAN,
    identity: tuple[str, ...] = IDENTITY_TERMS,
) -> ToxicityModel:
    """Learn from `labels` (key, label of 0 or 1), all of which are training rows.

    The fit takes about `toxic` and `clean` rows, drawn by hash of the id; their ids are few enough to broadcast. One task
    trains on them, and only the model reaches the driver.
    """
    known = (
        labels.filter(F.col(quoted(key)).isNotNull() & F.col(quoted(label)).isin(0, 1))
        .groupBy(F.col(quoted(key)).alias("k"))
        .agg(F.max(quoted(label)).cast("int").alias("y"))
    )
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        base = np.clip(bad / max(bad + good, 1), 1e-6, 1 - 1e-6)
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros((0, 2)), float(np.log(base / (1 - base))))
    share = F.when(F.col("y") == 1, min(1.0, toxic / bad)).otherwise(min(1.0, clean / good))
    drawn = F.broadcast(known.filter(unit_hash("toxicity", F.col("k")) < share).limit(2 * (toxic + clean)))
    rows = docs.select(F.col(quoted(key)).alias("k"), normalized(F.col(quoted(text))).alias("t")).join(drawn, "k").select("y", "t").limit(4 * (toxic + clean))

    groups = [hashes_of_terms(line) for line in identity]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in slices(batches, "t", max_rows=256):
            found, text, sizes = features_of(part.column(1))
            order = np.argsort(text, kind="stable")
            cuts = np.searchsorted(text[order], np.arange(part.num_rows + 1))
            for a, b, size, y in zip(cuts[:-1], cuts[1:], sizes.tolist(), part.column(0).to_pylist(), strict=True):
                features, n = np.unique(found[order[a:b]], return_counts=True)
                yield features, n.astype(np.int32), size, y

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the fit depends on the order, so it mustn't depend on that of the tasks
        model = _train(sorted(counted(batches), key=_place), groups, bad / good)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.features.tobytes()], pa.binary()), pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.intercept])],
            names=["features", "weights", "intercept"],
        )
        del model
        trim_memory()

    found = rows.coalesce(1).mapInArrow(trained, "features binary, weights binary, intercept double").collect()
    if not found:
        return _train([], groups, bad / good)
    return ToxicityModel(np.frombuffer(found[0].features, np.uint64), np.frombuffer(found[0].weights, np.float64).reshape(-1, 2), found[0].intercept)


def _place(example: tuple) -> tuple:
    found, _, size, y = example
    return size, y, int(np.bitwise_xor.reduce(found)) if len(found) else 0


def _train(examples: list[tuple], groups: list[list[np.ndarray]], odds: float) -> ToxicityModel:
    seen, counts = np.unique(np.concatenate([e[0] for e in examples] or [np.zeros(0, np.uint64)]), return_counts=True)
    often = np.flatnonzero(counts >= 3)
    often = often[np.argsort(-counts[often], kind="stable")[:FIT_FEATURES]]
    features = np.unique(np.concatenate([seen[often], *[term for group in groups for term in group]]))
    swaps = swap_ways(groups)
    model, draw = FTRL(2 * len(features), 2, alpha=0.1, l1=4.0, l2=0.1), np.random.default_rng(0)
    rows = []
    for found, n, size, y in examples:
        at = np.minimum(np.searchsorted(features, found), len(features) - 1)
        hit = features[at] == found
        named = [(w, int(n[i])) for term, w in swaps.items() if (i := np.searchsorted(found, np.uint64(term))) < len(found) and int(found[i]) == term]
        rows.append((at[hit].astype(np.int32), n[hit], y, named))
    for _ in range(EPOCHS):
        for i in draw.permutation(len(rows)):
            (used, times_used, y, named), (found, n, size, _) = rows[i], examples[i]
            values = values_of(times_used, np.full(len(used), size)).ravel().astype(np.float32)
            model.fit_row((2 * used[:, None] + np.arange(2)).ravel(), values, y)
            for ways, times in named:
                lost, won = ways[draw.integers(len(ways))]
                change = swap_change(found, n, size, times, lost, won)
                at = np.searchsorted(features, np.concatenate([lost, won]))
                pair = (2 * at[:, None] + np.arange(2)).ravel()
                model.push(pair, 2 * SWAP_WEIGHT * change[:, None] * (change @ model.weights(pair))[None, :])
    weights, intercepts = model.dense()
    slope, intercept = (weights[:, 1] - weights[:, 0]).reshape(-1, 2), intercepts[1] - intercepts[0]
    used = np.flatnonzero(slope.any(axis=1))
    n_bad = sum(e[3] for e in examples)
    shift = np.log(odds) - np.log(max(n_bad, 1) / max(len(examples) - n_bad, 1))
    return ToxicityModel(features[used], slope[used], float(intercept + shift))


def scores_of(column: pa.Array, model: ToxicityModel) -> np.ndarray:
    total = np.full(len(column), model.intercept)
    if len(model.features):
        found, text, sizes = features_of(column)
        at = np.minimum(np.searchsorted(model.features, found), len(model.features) - 1)
        hit = model.features[at] == found
        both, counts = np.unique(text[hit] * len(model.features) + at[hit], return_counts=True)
        owner, slot = both // len(model.features), both % len(model.features)
        np.add.at(total, owner, (values_of(counts, sizes[owner]) * model.weights[slot]).sum(axis=1))
    return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score", below: float | None = None) -> DataFrame:
    """`docs` with the chance that each whole text is toxic; with `below`, only the rows whose score is lower."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    words = fresh(docs, "words")
    rows = docs.select(*[F.col(quoted(c)) for c in kept], normalized(F.col(quoted(text))).alias(words))
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, words):
            found = pa.array(scores_of(part.column(part.num_columns - 1), model))
            out = pa.RecordBatch.from_arrays([*part.columns[:-1], found], names=[*kept, name])
            yield out if below is None else out.filter(pa.array(found.to_numpy() < below))

    return rows.mapInArrow(run, schema)
