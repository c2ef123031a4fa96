"""Language identification: multinomial logistic regression on TF-IDF character n-grams, trained with FTRL.

Edge cases: a text that is null or holds no letter is `und` with score 0. Training rows without a label, text or
letter are passed over; without any training row everything is `und`. Labels are learned as they are, so ties in the
scores go to the first label in sorted order. Repeated rows count as often as they occur. Texts are read whole,
however long. `known` tells texts whose n-grams are about as common as those of the training rows; gibberish and
unlearned languages have rarer ones. A short text is taken for an ordinary one as far as its n-grams are few, a text without
letters is not known, and without a training row nothing is. Columns named like an output are replaced by it; all other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import fresh, quoted, returns_memory, slices, summed, trim_memory, unit_hash
from flowloom.llm.learn import FTRL, softmax, temperature
from flowloom.llm.text import char_grams, letters

SLOTS = 1 << 13
ORDERS = (1, 2, 3)
#: Bound of the labelled rows the weights are fitted on; document frequencies cover every training row.
FIT_ROWS = 6_000
CALIBRATION_SHARE = 0.2
EPOCHS = 2
#: N-grams that a text needs for its own rarity to weigh as much as the usual one, and how far above the rarest of the sample
#: it may be, as a share of that one's distance from the usual.
FEW, BEYOND = 60, 0.25


@dataclass
class LanguageModel:
    """`languages` in sorted order; `weights` is slots x languages."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    intercepts: np.ndarray
    temperature: float
    usual: float = 0.0
    limit: float = 0.0


def rarity(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, sum of their weights) per text."""
    return counts.sum(axis=1).astype(np.float64), counts @ idf


def shrunk(n: np.ndarray, total: np.ndarray, usual: float) -> np.ndarray:
    """Mean weight of a text's n-grams, where `FEW` more of the usual weight are added."""
    return (total + FEW * usual) / (n + FEW)


def counts_of(column: pa.Array) -> np.ndarray:
    slot, text = char_grams(column, ORDERS, SLOTS)
    return np.bincount(text * SLOTS + slot, minlength=len(column) * SLOTS).reshape(len(column), SLOTS)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = np.log1p(counts.astype(np.float32)) * idf.astype(np.float32)
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.maximum(norms, 1e-12)[:, None]


def prepared(docs: DataFrame, text: str, columns: list[str]) -> tuple[DataFrame, str]:
    name = fresh(docs, "letters")
    found = F.when(F.col(quoted(text)).rlike(r"\p{L}"), letters(F.col(quoted(text))))
    return docs.select(*[F.col(quoted(c)) for c in columns], found.alias(name)), name


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """(documents per slot, documents), over every row with letters."""
    rows, name = prepared(docs, text, [])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(SLOTS + 1, dtype=np.int64), 0
        for part in slices(batches, name, 1 << 19, 128):
            found[:SLOTS] += (counts_of(part.column(0)) > 0).sum(axis=0)
            n += part.num_rows
        found[SLOTS] = n
        slot = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(found[slot])], names=["slot", "n"])

    sums = summed(rows.filter(F.col(quoted(name)).isNotNull()).mapInArrow(count, "slot long, n long"), SLOTS + 1)
    return sums[:SLOTS], int(sums[SLOTS])


@returns_memory
def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", rows: int = FIT_ROWS) -> LanguageModel:
    """Learn from the rows of `docs`, all of which are training rows.

    Weights and temperature come from at most about `rows` rows, drawn by hash with equal shares per language; one task trains
    on them, and only the model reaches the driver. The number of languages must be small (their counts reach the driver).
    """
    known = docs.filter(F.col(quoted(label)).isNotNull() & F.col(quoted(text)).rlike(r"\p{L}"))
    sizes = {r[0]: r[1] for r in known.groupBy(quoted(label)).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(SLOTS), np.zeros((SLOTS, 0)), np.zeros(0), 1.0)
    frequency, n = document_frequencies(known, text)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    each = max(rows // len(languages), 8)
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, each / sizes[lang])))])
    draw = unit_hash("langid", F.col(quoted(key)), F.xxhash64(quoted(text)))
    sample, name = prepared(known.filter(draw < share[F.col(quoted(label))]).limit(2 * each * len(languages)), text, [label])

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = []
        for part in slices(batches, name, 1 << 19, 128):
            counts = counts_of(part.column(1))
            for row, n, total, lang in zip(tfidf(counts, idf), *rarity(counts, idf), part.column(0).to_pylist(), strict=True):
                slots = np.flatnonzero(row).astype(np.int32)
                drawn.append((slots, row[slots], languages.index(lang), float(n), float(total)))
        model = _train(drawn, languages, idf)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.intercepts.tobytes()], pa.binary()), *(pa.array([x]) for x in (model.temperature, model.usual, model.limit))],
            names=["weights", "intercepts", "temperature", "usual", "limit"],
        )
        del drawn, model
        trim_memory()

    found = sample.coalesce(1).mapInArrow(trained, "weights binary, intercepts binary, temperature double, usual double, limit double").collect()
    if not found:
        return _train([], languages, idf)
    weights, intercepts, *numbers = found[0]
    return LanguageModel(languages, idf, np.frombuffer(weights, np.float32).reshape(SLOTS, -1), np.frombuffer(intercepts, np.float64), *numbers)


def _train(drawn: list[tuple], languages: list[str], idf: np.ndarray) -> LanguageModel:
    """The model from rows of (slots, values, position of the language, n-grams, sum of their weights), in any order."""
    drawn.sort(key=lambda row: (row[0].tobytes(), row[1].tobytes(), row[2]))
    order = np.random.default_rng(0).permutation(len(drawn))
    held = int(len(drawn) * CALIBRATION_SHARE) if len(drawn) >= 10 * len(languages) else 0
    model = FTRL(SLOTS, len(languages), alpha=1.0, l1=0.02, l2=0.02)
    for _ in range(EPOCHS):
        for slots, values, target, *_ in (drawn[i] for i in order[held:]):
            model.fit_row(slots, values.astype(np.float64), target)
    weights, intercepts = model.dense()
    scores = np.array([drawn[i][1].astype(np.float64) @ weights[drawn[i][0]] + intercepts for i in order[:held]]).reshape(held, len(languages))
    fitted = temperature(scores, np.array([drawn[i][2] for i in order[:held]], dtype=np.int64))
    grams, totals = (np.array([row[c] for row in drawn]) for c in (3, 4))
    usual = float(totals.sum() / max(grams.sum(), 1))
    rarest = float(shrunk(grams, totals, usual).max(initial=usual))
    return LanguageModel(languages, idf, weights.astype(np.float32), intercepts, fitted, usual, rarest + BEYOND * (rarest - usual))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", language: str = "lang_pred", score: str = "score", known: str | None = None) -> DataFrame:
    """`docs` with the likeliest language of each whole text and its calibrated probability.

    `known` names one more column: whether the text's n-grams are as common as those of learned texts.
    """
    added = [(language, T.StringType()), (score, T.DoubleType()), *([(known, T.BooleanType())] if known else [])]
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n, _ in added}]
    rows, name = prepared(docs, text, kept)
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(*a) for a in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, name, 1 << 19, 128):
            column = part.column(part.num_columns - 1)
            best, sure, common = ["und"] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows, dtype=bool)
            if model.languages:
                counts = counts_of(column)
                scores = tfidf(counts, model.idf) @ model.weights + model.intercepts
                chance = softmax(scores / model.temperature)
                spelled = column.is_valid().to_numpy(zero_copy_only=False)
                if known:
                    common = spelled & (shrunk(*rarity(counts, model.idf), model.usual) <= model.limit)
                sure = np.where(spelled, chance.max(axis=1), 0.0)
                best = [model.languages[i] if k else "und" for i, k in zip(chance.argmax(axis=1), spelled, strict=True)]
            found = [pa.array(best, pa.string()), pa.array(sure, pa.float64()), *([pa.array(common)] if known else [])]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *found], names=[*kept, *[n for n, _ in added]])

    return rows.mapInArrow(run, schema)


def held_out(key: str, mod: int, remainder: int):
    """Is crc32 of the id as text, modulo `mod`, the given remainder? False for a null id."""
    return F.coalesce(F.crc32(F.col(quoted(key)).cast("string")) % mod == remainder, F.lit(False))
