"""Benchmark decontamination by latent semantic retrieval, then subsequence and answer checks.

Documents are cut into overlapping passages of two blocks of `STRIDE` words. Term weights are inverse document
frequencies over all documents. A randomised SVD of the TF-IDF rows of the benchmark's items and of all passages gives
every benchmark word a latent vector and so a score for every item; a passage whose latent dot product with an item is
large enough for what a passage can hold of that item is a candidate. The passages' rows are multiplied by a random
matrix of one sign per passage (`BUCKETS` rows): the scan that counts the words adds every passage to one of these rows.
Candidates are verified on the words around the passage: by the longest common subsequence with the item, and, where
that leaves room for a paraphrase, by the item's closing words, which hold its answer.

Each SVD covers `FIT_ITEMS` items, fewer than its rank, so that the basis keeps them however large the benchmark is.
The documents are read twice for every `ITEMS` items or so, so what a task needs is bounded.

Edge cases: null and empty texts, and items without words, match nothing. Items of fewer than `SHORT` words must occur
whole and are looked up by their own words, without the SVD. Repeated items and documents are judged alike. Columns named like an output are replaced by it; all other columns
stay. Empty tables give clean documents, or none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import fresh, quoted, saved, slices, unit_hash
from flowloom.llm.text import PRIME, mix, normalized, words_of

STRIDE = 24
RANK = 160
#: Rows of the sketch of all passages.
BUCKETS = 128
#: Passages that `fit_rows` draws.
FIT_PASSAGES = 6_000
#: Items of a pass over the documents, and of an SVD: half of its rank, which leaves the other half to the passages.
ITEMS, FIT_ITEMS = 2_000, 80
#: Share of the latent energy of an item's words in a passage that makes a candidate, see `reach`.
HELD = 0.3
#: Share of an item's words in order: surely a copy; a paraphrase if the closing words are there too.
COPY, PARAPHRASE, ANSWER_WORDS, ANSWER = 0.75, 0.5, 6, 0.6
SHORT = 8


@dataclass
class Corpus:
    """What an SVD needs of all documents: sorted words, documents that hold each, a sketch row per word, all documents."""

    words: np.ndarray
    frequency: np.ndarray
    sketch: np.ndarray
    n_docs: int


@dataclass
class Lookup:
    """Sorted distinct hashes, with the largest number behind them, and the place of the first one for each value of their first bits."""

    words: np.ndarray
    begins: np.ndarray
    shift: np.uint64
    steps: int

    @classmethod
    def of(cls, words: np.ndarray) -> Lookup:
        bits = min(max(len(words), 1).bit_length() + 4, 22)
        shift = np.uint64(64 - bits)
        begins = np.searchsorted(words, np.arange(1 << bits, dtype=np.uint64) << shift).astype(np.int32)
        steps = int(np.diff(begins, append=len(words)).max())
        return cls(np.append(words, np.uint64(2**64 - 1)), begins, shift, steps)

    def __reduce__(self) -> tuple:
        # the table of first bits is made again where it is used
        return Lookup.of, (self.words[:-1],)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the words that are listed, their places in the list)"""
        at = self.begins[words >> self.shift]
        for _ in range(self.steps - 1):
            at += self.words[at] < words
        hit = np.flatnonzero(self.words[at] == words)
        place = at[hit]
        listed = place < len(self.words) - 1
        return (hit, place) if listed.all() else (hit[listed], place[listed])


@dataclass
class Block:
    """The items of one SVD: places of their words in the lookup, those of each item, a score per word and item, the least sum of a candidate passage."""

    words: np.ndarray
    items: list[np.ndarray]
    scores: np.ndarray
    least: np.ndarray


@dataclass
class Index:
    """The items of a pass: the short ones by length (sorted hashes of all their words, positions), the others in the order of the blocks."""

    short: dict[int, tuple[np.ndarray, np.ndarray]]
    openings: np.ndarray
    lookup: Lookup | None
    blocks: list[Block]
    ids: list
    texts: list[np.ndarray]


def blocks_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of every block of `STRIDE` words."""
    counts = -(-np.diff(offsets) // STRIDE)
    text = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return offsets[text] + within * STRIDE, text


def latent(owner: np.ndarray, at: np.ndarray, n_blocks: int, scores: np.ndarray) -> np.ndarray:
    """Sum over each block of the scores of its words; `owner` is the block of each word, in order, and `at` its row."""
    out = np.zeros((n_blocks, scores.shape[1]), dtype=np.float32)
    if len(at):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        sizes = np.diff(np.append(first, len(at)))
        order = np.argsort(-sizes, kind="stable")
        first, sizes = first[order], sizes[order]
        # the first words of all blocks, then the second ones, and so on; the blocks with most words stand in front
        total = scores[at[first]]
        for i in range(1, int(sizes[0])):
            n = np.searchsorted(-sizes, -i)
            total[:n] += scores[at[first[:n] + i]]
        out[owner[first]] = total
    return out


def joined(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of each block and the next of its text, positions): the last block of a longer text starts no passage."""
    follows = np.zeros(len(text), dtype=bool)
    follows[:-1] = text[1:] == text[:-1]
    alone = np.ones(len(text), dtype=bool)
    alone[1:] = text[1:] != text[:-1]
    at = np.flatnonzero(follows | alone)
    total = values[at]
    total[follows[at]] += values[at[follows[at]] + 1]
    return total, at


def corpus_of(docs: DataFrame, vocabulary: np.ndarray, text: str, key: str) -> Corpus:
    """Counts and sketch over all documents and passages. A passage's row has each word's count over the root of its own words'
    number; it is added, with a random sign, to the bucket its id, text and place give."""
    rows = docs.select(F.xxhash64(quoted(key), quoted(text)).alias("h"), normalized(F.col(quoted(text))).alias("t"))
    size = len(vocabulary)
    schema = "word long, n long, row binary"

    def batch(frequency: np.ndarray, sketch: np.ndarray, kind: type) -> pa.RecordBatch:
        word = np.flatnonzero(frequency)
        return pa.RecordBatch.from_arrays(
            [pa.array(word), pa.array(frequency[word]), pa.array([r.tobytes() for r in sketch[word].astype(kind)], pa.binary())], names=["word", "n", "row"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last entry counts the documents
        frequency, sketch = np.zeros(size + 1, dtype=np.int64), np.zeros((size + 1) * BUCKETS)
        lookup = Lookup.of(vocabulary)
        for part in slices(batches, "t", max_rows=256):
            frequency[size] += part.num_rows
            words, offsets = words_of(part.column(1))
            if not len(words):
                continue
            hit, slot = lookup.hits(words)
            starts, owner = blocks_of(offsets)
            block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))[hit]
            held = np.zeros((part.num_rows, size), dtype=bool)
            held[owner[block], slot] = True
            frequency[:size] += held.sum(axis=0)
            total, begins = joined(np.bincount(block, minlength=len(starts)), owner)
            ids = part.column(0).to_numpy().view(np.uint64)
            draw = mix(mix(ids[owner[begins]]) + (starts[begins] - offsets[owner[begins]]).astype(np.uint64))
            weight, bucket = np.zeros(len(starts)), np.zeros(len(starts), dtype=np.int64)
            weight[begins] = np.where(draw >> np.uint64(63), 1.0, -1.0) / np.sqrt(np.maximum(total, 1))
            bucket[begins] = (draw % np.uint64(BUCKETS)).astype(np.int64)
            row = slot.astype(np.int64) * BUCKETS
            np.add.at(sketch, row + bucket[block], weight[block])
            # a block is also the second one of the passage that begins before it
            second = np.flatnonzero((block > 0) & (owner[block - 1] == owner[block]))
            before = block[second] - 1
            np.add.at(sketch, row[second] + bucket[before], weight[before])
        yield batch(frequency, sketch.reshape(size + 1, BUCKETS), np.float32)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, sketch = np.zeros(size + 1, dtype=np.int64), np.zeros((size + 1, BUCKETS))
        for part in batches:
            word = part.column(0).to_numpy()
            np.add.at(frequency, word, part.column(1).to_numpy())
            for w, row in zip(word.tolist(), part.column(2).to_pylist(), strict=True):
                sketch[w] += np.frombuffer(row, np.float32)
        yield batch(frequency, sketch, np.float64)

    found = rows.mapInArrow(count, schema).repartition("word").mapInArrow(add, schema).toArrow()
    frequency, sketch = np.zeros(size + 1, dtype=np.int64), np.zeros((size + 1, BUCKETS))
    word = found.column(0).to_numpy()
    frequency[word] = found.column(1).to_numpy()
    for w, row in zip(word.tolist(), found.column(2), strict=True):
        sketch[w] = np.frombuffer(row.as_buffer(), np.float64)
    return Corpus(vocabulary, frequency[:size], sketch[:size], int(frequency[size]))


def singular_vectors(passages: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Right singular vectors (words x rank) of the sketched TF-IDF rows of all passages and those of the items; the items weigh
    as much as the passages altogether."""
    energy = float((passages * passages).sum())
    unit = items / np.linalg.norm(items, axis=1, keepdims=True)
    rows = np.vstack([passages, unit * (np.sqrt(energy / len(items)) if energy else 1.0)])
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return vectors[:RANK][values[:RANK] > 1e-9 * values[0]].T


def fit_rows(docs: DataFrame, n_words: int, text: str, key: str) -> DataFrame:
    """A sample of texts to try things on; no operator takes it, an SVD is fitted on all passages."""
    share = min(1.0, FIT_PASSAGES * STRIDE / max(n_words, 1))
    sample = docs.filter(unit_hash("svd", F.col(quoted(key))) < share).select(normalized(F.col(quoted(text))).alias("t"), F.lit(False).alias("whole")).filter("t is not null")
    # only the drawn rows move; the scan keeps its own tasks
    return saved(sample.repartition(4), "fit")


def reach(n: np.ndarray) -> np.ndarray:
    """Words of a run of n words that the best passage holds at least, wherever the run begins."""
    return np.minimum(np.minimum(n, (n + STRIDE) / 2), 2 * STRIDE)


def build(texts: list[np.ndarray], corpus: Corpus) -> Block:
    """The scores of one SVD's items (hashed words)."""
    vocabulary = np.unique(np.concatenate(texts))
    own = np.searchsorted(corpus.words, vocabulary)
    weights = np.log((1 + corpus.n_docs) / (1 + corpus.frequency[own])) + 1
    counts = np.array([np.bincount(np.searchsorted(vocabulary, t), minlength=len(vocabulary)) for t in texts])
    vectors = singular_vectors(corpus.sketch[own].T * weights, counts * weights)
    lifted = vectors * weights[:, None]
    places = [np.searchsorted(vocabulary, t) for t in texts]
    scores = (lifted @ np.array([lifted[at].sum(axis=0) for at in places]).T).astype(np.float32)
    # what the basis has kept of an item is what its copies can reach
    kept = np.array([scores[at, i].sum() for i, at in enumerate(places)])
    sizes = np.array([len(t) for t in texts])
    return Block(own, [own[at] for at in places], scores, (HELD * kept * reach(sizes) / sizes).astype(np.float32))


def common_subsequence(item: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's words."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    state = full
    for w in words.tolist():
        mask = masks.get(w)
        if mask:
            hit = state & mask
            state = ((state + hit) | (state - hit)) & full
    return len(item) - bin(state).count("1")


def is_leak(item: np.ndarray, words: np.ndarray) -> tuple[bool, float]:
    share = common_subsequence(item, words) / len(item)
    if len(item) < SHORT:
        return share == 1.0 and any((words[i : i + len(item)] == item).all() for i in range(len(words) - len(item) + 1)), share
    if share >= COPY:
        return True, share
    if share < PARAPHRASE:
        return False, share
    tail = item[-ANSWER_WORDS:]
    return common_subsequence(tail, words) / len(tail) >= ANSWER, share


def runs_of(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """One hash for the n words from each position."""
    value = np.zeros(len(at), dtype=np.uint64)
    for j in range(n):
        value = mix(value * np.uint64(PRIME) + words[at + j])
    return value


def short_items(texts: list[np.ndarray]) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(hashes and positions of the items of each length below `SHORT`, their first words)"""
    out = {}
    for n in range(1, SHORT):
        own = np.array([i for i, t in enumerate(texts) if len(t) == n], dtype=np.int64)
        if len(own):
            keys = runs_of(np.concatenate([texts[i] for i in own]), np.arange(len(own)) * n, n)
            order = np.argsort(keys, kind="stable")
            out[n] = keys[order], own[order]
    return out, np.unique(np.array([t[0] for t in texts if len(t) < SHORT], dtype=np.uint64))


def whole_matches(words: np.ndarray, offsets: np.ndarray, index: Index, found: list[dict[int, float]]) -> None:
    """Add the short items that occur whole."""
    if not len(index.openings):
        return
    begins = np.flatnonzero(np.isin(words, index.openings))
    text = np.searchsorted(offsets, begins, "right") - 1
    for n, (keys, items) in index.short.items():
        inside = begins + n <= offsets[text + 1]
        run = runs_of(words, begins[inside], n)
        low, high = np.searchsorted(keys, run), np.searchsorted(keys, run, "right")
        hit = np.flatnonzero(high > low)
        for t, a, b in zip(text[inside][hit].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
            found[t].update((i, 1.0) for i in items[a:b].tolist())


def holding(slots: np.ndarray, near: np.ndarray, item: np.ndarray, own: list[np.ndarray], n_words: int) -> np.ndarray:
    """Which candidates have so many of their item's words in their range of words, wherever, that a common subsequence can be long enough.

    `slots` has the place in the lookup of each word of the slice (`n_words` for others), `near` the ranges, `own` the places of each item's words.
    """
    enough = np.zeros(len(item), dtype=bool)
    # a table of words per candidate and the words of all ranges stay small
    step = max(min((4 << 20) // (n_words + 1), (1 << 20) // max(int((near[:, 1] - near[:, 0]).max()), 1)), 1)
    for low in range(0, len(item), step):
        begin, end = near[low : low + step].T
        sizes = end - begin
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
        present = np.zeros((len(sizes), n_words + 1), dtype=bool)
        present[row, slots[at]] = True
        words = [own[i] for i in item[low : low + step].tolist()]
        lengths = np.array([len(w) for w in words])
        held = present[np.repeat(np.arange(len(words)), lengths), np.concatenate(words)]
        enough[low : low + step] = np.add.reduceat(held, np.cumsum(lengths) - lengths, dtype=np.int64) >= PARAPHRASE * lengths
    return enough


def matches(column: pa.Array, index: Index) -> list[dict[int, float]]:
    """For each text, the positions of the items found in it and the shares of their words."""
    found: list[dict[int, float]] = [{} for _ in range(len(column))]
    words, offsets = words_of(column)
    if not len(words):
        return found
    whole_matches(words, offsets, index, found)
    if not index.blocks:
        return found
    starts, text = blocks_of(offsets)
    hit, place = index.lookup.hits(words)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))[hit]
    n_words = len(index.lookup.words) - 1
    slots = np.full(len(words), n_words, dtype=np.int32)
    slots[hit] = place
    # the short items come first
    first = sum(len(items) for _, items in index.short.values())
    for block in index.blocks:
        rows = np.full(n_words, -1, dtype=np.int32)
        rows[block.words] = np.arange(len(block.words))
        row = rows[place]
        known = np.flatnonzero(row >= 0)
        sums, at = joined(latent(owner[known], row[known], len(starts), block.scores), text)
        p, item = np.divmod(np.flatnonzero(sums >= block.least), len(block.least))
        if len(p):
            begin = at[p]
            lengths = np.array([len(t) for t in block.items])[item]
            low = np.maximum(offsets[text[begin]], starts[begin] - lengths)
            high = np.minimum(offsets[text[begin] + 1], starts[begin] + 2 * STRIDE + lengths)
            # no subsequence is longer than the number of the item's words that occur at all
            likely = np.flatnonzero(holding(slots, np.stack([low, high], axis=1), item, block.items, n_words))
            for t, i, a, b in zip(text[begin[likely]].tolist(), (first + item[likely]).tolist(), low[likely].tolist(), high[likely].tolist(), strict=True):
                if found[t].get(i, 0.0) == 1.0:
                    continue
                leak, share = is_leak(index.texts[i], words[a:b])
                if leak:
                    found[t][i] = max(share, found[t].get(i, 0.0))
        first += len(block.least)
    return found


def indexes(docs: DataFrame, benchmark: DataFrame, text: str, key: str, item: str, item_text: str) -> Iterator[Index]:
    items = benchmark.select(F.col(quoted(item)).alias("i"), F.trim(normalized(F.col(quoted(item_text)))).alias("t")).filter("t <> ''")
    passes = -(-items.count() // ITEMS)
    if not passes:
        return
    for b in range(passes):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == b).toArrow()
        own = sorted(zip(*(c.to_pylist() for c in rows.columns), strict=True), key=lambda row: (row[1].count(" ") + 1 >= SHORT, str(row)))
        texts = [words_of(pa.array([t]))[0] for _, t in own]
        long = np.arange(sum(len(t) < SHORT for t in texts), len(own))
        parts = [slice(part[0], part[-1] + 1) for part in np.array_split(long, -(-len(long) // FIT_ITEMS) or 1) if len(part)]
        corpus = corpus_of(docs, np.unique(np.concatenate([texts[i] for i in long])), text, key) if parts else None
        if own:
            lookup = Lookup.of(corpus.words) if corpus else None
            yield Index(*short_items(texts), lookup, [build(texts[p], corpus) for p in parts], [i for i, _ in own], texts)


def flag(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` with `contaminated`, `items` (ids found, sorted) and `best_share` of an item's words found in order."""
    added = ("items", "best_share", "contaminated")
    kept = [c for c in docs.columns if c.lower() not in added]
    nothing = (F.array().cast("array<long>"), F.lit(0.0), F.lit(False))
    out = docs.select(*[F.col(quoted(c)) for c in kept], *[value.alias(name) for value, name in zip(nothing, added, strict=True)])
    for index in indexes(docs, benchmark, text, key, item, item_text):
        out = _flagged(out, index, text, [*kept, *added])
    return out


def _flagged(docs: DataFrame, index: Index, text: str, columns: list[str]) -> DataFrame:
    words = fresh(docs, "words")
    rows = docs.withColumn(words, normalized(F.col(quoted(text))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, words):
            found = matches(part.column(part.num_columns - 1), index)
            before, best, known = (part.column(part.num_columns - i).to_pylist() for i in (4, 3, 2))
            ids = [sorted({*b, *(index.ids[i] for i in f if index.ids[i] is not None)}) for b, f in zip(before, found, strict=True)]
            share = [max([b, *f.values()]) for b, f in zip(best, found, strict=True)]
            leak = [k or bool(f) for k, f in zip(known, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-4], pa.array(ids, pa.list_(pa.int64())), pa.array(share, pa.float64()), pa.array(leak)], names=columns)

    return rows.mapInArrow(run, T.StructType([docs.schema[c] for c in columns]))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item, with their columns as they are."""
    out = docs
    for index in indexes(docs, benchmark, text, key, item, item_text):
        out = _cleaned(out, index, text)
    return out


def _cleaned(docs: DataFrame, index: Index, text: str) -> DataFrame:
    words = fresh(docs, "words")
    names = docs.columns
    rows = docs.withColumn(words, normalized(F.col(quoted(text))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, words):
            free = pa.array([not f for f in matches(part.column(part.num_columns - 1), index)])
            yield pa.RecordBatch.from_arrays(part.columns[:-1], names=names).filter(free)

    return rows.mapInArrow(run, docs.schema)
