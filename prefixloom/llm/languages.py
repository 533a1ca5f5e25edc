"""Language identification: a linear-chain conditional random field over the words of a text.

Every word has a label, its language. A word's features are its affixes (1 to 3 characters at the start, 1 to 4 at the
end), its character n-grams (2 and 3, with its ends marked), all hashed into 2**16 slots of which each language has a
weight, and its place in the lexicons: for each language, whether its sampled texts have the word at least twice and
hold most of its uses. Learned transitions say how likely the language changes from a word to the next. Forward-backward
gives every word's probabilities, so code-switched text is labelled word by word; a text's language is the one with
the largest mean probability over its words with a letter, and the score is that mean.

Fit, on the driver, from at most FIT_TEXTS whole texts per language of at most FIT_BYTES bytes each, drawn by a hash of
the key (a row per key); half of them make the lexicons, the other half the training sequences, so that a word's being in a lexicon
is learned on words that did not make it. A training sequence strings stretches of texts together, mostly of one language
and at times of several. Gradients of the exact sequence likelihood come from the same forward-backward.

Labelling takes whole texts in one narrow pass. The words of a slice of texts are cut into blocks; a block's product of
transition matrices carries the probabilities from block to block, so steps in Python depend on the block size
and the number of blocks of the longest text. Memory is about 20 bytes per word and language of a slice, or of one long text.
The model (2**16 weights per language) travels with the task; languages are taken as few.

Null texts and texts without a letter are ``und`` with score 0, and so is every text if no row has a language. With one
language known every other text has that one. Words without a letter count as neutral. Ties go to the first language in the order of names.
Repeated rows get equal results; an old column of the same name is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder, table, with_columns

BITS = 16
SLOTS = 1 << BITS
FIT_TEXTS = 300
FIT_BYTES = 8_192
LENGTH = 40  # words of a training sequence
AT_ONCE = 48
STEPS = 400
RATE = 0.2
DECAY = 1e-6
BLOCK = 128
PACK = 16_384  # words whose features are computed together
SLICE = 2 << 20
UNKNOWN = "und"


def slots_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed affixes and n-grams of every word, one word after another, and where each word's begin (and the end)."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    after = (starts + lengths)[owner] - np.arange(len(codes))  # characters from here to the word's end
    hashes = {1: codes}
    for size in (2, 3, 4):
        hashes[size] = hashes[size - 1][:len(codes) - size + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[size - 1:] + np.uint64(1)
    found, of = [], []

    def add(spots: np.ndarray, size: int, kind: int) -> None:
        mixed = (hashes[size][spots] + np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        found.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
        of.append(owner[spots])

    for size in (2, 3):
        add(np.flatnonzero(after >= size), size, 10 * size)
    for size in (1, 2, 3):
        add(starts[lengths >= size + 2] + 1, size, 10 * size + 1)
    for size in (1, 2, 3, 4):
        add((starts + lengths)[lengths >= size + 2] - 1 - size, size, 10 * size + 2)
    of, found = np.concatenate(of), np.concatenate(found)
    return found[np.argsort(of, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))])


def has_letter(word: str) -> bool:
    return word.isalpha() or any(c.isalpha() for c in word)


def words_of(text: str) -> list[str]:
    """The words of a text in lower case."""
    return text.lower().split()


def forward_backward(emit: np.ndarray, starts: np.ndarray, first: np.ndarray, change: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word the forward and backward vectors (each up to a factor) and the probabilities of the labels.

    emit (words, labels) holds the positive factors of all sequences one after another, starts where they begin (and
    the end), first the factors of the first label, change those of a transition. No sequence may be empty.
    """
    size = emit.shape[1]
    lengths = np.diff(starts)
    blocks = -(-lengths // block)
    first_block = np.concatenate([[0], np.cumsum(blocks)])
    owner = np.repeat(np.arange(len(lengths)), blocks)
    place = np.arange(first_block[-1]) - first_block[owner]
    begin = starts[owner] + place * block
    held = np.minimum(block, starts[owner + 1] - begin)
    lead = place == 0
    # blocks by falling length: step t concerns the first live[t] of them
    order = np.argsort(-held, kind="stable")
    live = np.searchsorted(-held[order], -np.arange(held.max()), "left") if len(held) else np.zeros(0, int)
    begin, lead_of = begin[order], lead[order]

    # the product of a block: row = label before the block, column = label of its last word
    product = np.broadcast_to(np.eye(size), (len(order), size, size)).copy()
    for t, many in enumerate(live.tolist()):
        step = (product[:many] @ change) * emit[begin[:many] + t][:, None, :]
        if t == 0:
            step[lead_of[:many]] = (first * emit[begin[:many][lead_of[:many]]])[:, None, :]
        product[:many] = step / step.sum(axis=(1, 2), keepdims=True)
    back_in_order = np.empty(len(order), np.int64)
    back_in_order[order] = np.arange(len(order))
    product = product[back_in_order]
    before = np.full((len(order), size), 1.0 / size)  # forward vector of the word before a block
    after = np.full((len(order), size), 1.0)  # what comes after a block, for its last word
    for k in range(1, int(blocks.max(initial=0))):
        here = first_block[:-1][blocks > k] + k
        step = np.einsum("nl,nlm->nm", before[here - 1], product[here - 1])
        before[here] = step / step.sum(axis=1, keepdims=True)
        last = first_block[1:][blocks > k] - 1 - k
        step = np.einsum("nlm,nm->nl", product[last + 1], after[last + 1])
        after[last] = step / step.sum(axis=1, keepdims=True)
    forward, backward = np.empty_like(emit), np.empty_like(emit)
    now = before[order]
    for t, many in enumerate(live.tolist()):
        step = (now[:many] @ change) * emit[begin[:many] + t]
        if t == 0:
            step[lead_of[:many]] = first * emit[begin[:many][lead_of[:many]]]
        now[:many] = step / step.sum(axis=1, keepdims=True)
        forward[begin[:many] + t] = now[:many]
    now, held_of = after[order], held[order]
    for t in range(len(live) - 1, -1, -1):
        many = int(live[t])
        inner = held_of[:many] - 1 > t  # the last word of a block starts from what comes after
        spot = begin[:many][inner] + t + 1
        step = (now[:many][inner] * emit[spot]) @ change.T
        now[:many][inner] = step / step.sum(axis=1, keepdims=True)
        backward[begin[:many] + t] = now[:many]
    both = forward * backward
    return forward, backward, both / both.sum(axis=1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # float32, (slots and one lexicon place per language, languages)
    lexicon: dict[str, int]  # word -> number of its language
    first: np.ndarray
    change: np.ndarray

    def unary(self, words: list[str]) -> np.ndarray:
        """The summed weights of every word; words without a letter have none."""
        out = np.zeros((len(words), len(self.languages)))
        for at in range(0, len(words), PACK):
            part = words[at:at + PACK]
            slots, edge = slots_of(part)
            summed = np.concatenate([np.zeros((1, out.shape[1])), np.cumsum(self.weights[slots], axis=0, dtype=float)])
            out[at:at + PACK] = summed[edge[1:]] - summed[edge[:-1]]
        known = np.array([self.lexicon.get(w, -1) for w in words], np.int64)
        out[known >= 0] += self.weights[SLOTS + known[known >= 0]]
        return out * np.fromiter(map(has_letter, words), bool, len(words))[:, None]

    def shares(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label probabilities of all words one text after another, which have a letter, and where texts begin (and the end)."""
        number: dict[str, int] = {}
        spot = np.fromiter((number.setdefault(w, len(number)) for words in texts for w in words), np.int64)
        starts = np.cumsum([0] + [len(words) for words in texts])
        if not len(spot):
            return np.zeros((0, len(self.languages))), np.zeros(0, bool), starts
        emit = factors(self.unary(list(number)))[spot]
        filled = np.concatenate([starts[:-1][np.diff(starts) > 0], starts[-1:]])
        share = forward_backward(emit, filled, np.exp(self.first), np.exp(self.change))[2]
        return share, np.fromiter(map(has_letter, number), bool, len(number))[spot], starts

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of every text."""
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        share, lettered, starts = self.shares([words_of(t) for t in texts])
        total = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(share * lettered[:, None], axis=0)])
        many = np.concatenate([[0], np.cumsum(lettered)])
        total, many = total[starts[1:]] - total[starts[:-1]], many[starts[1:]] - many[starts[:-1]]
        best = total.argmax(axis=1)
        score = np.minimum(1.0, total[np.arange(len(texts)), best] / np.maximum(many, 1))
        return [(self.languages[k], float(s)) if m else (UNKNOWN, 0.0) for k, s, m in zip(best.tolist(), score, many.tolist())]

    def label_words(self, texts: list[str]) -> list[list[str]]:
        """The most probable language of every word of every text."""
        split = [words_of(t) for t in texts]
        if not self.languages:
            return [[UNKNOWN] * len(words) for words in split]
        share, lettered, starts = self.shares(split)
        names = [self.languages[k] if letter else UNKNOWN for k, letter in zip(share.argmax(axis=1).tolist(), lettered.tolist())]
        return [names[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def factors(logits: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(logits - logits.max(axis=1, keepdims=True), -50, 0))


def lexicons(texts: list[tuple[list[str], int]], size: int) -> dict[str, int]:
    """Words used at least twice whose uses are mostly of one language."""
    counts: dict[str, np.ndarray] = {}
    for words, label in texts:
        for w in filter(has_letter, words):
            counts.setdefault(w, np.zeros(size, np.int32))[label] += 1
    return {w: int(c.argmax()) for w, c in counts.items() if c.sum() >= 2 and 2 * c.max() > c.sum()}


def sequences(texts: list[tuple[list[str], int]], rng: np.random.Generator, many: int, size: int) -> tuple[list[list[str]], np.ndarray]:
    """Training sequences of LENGTH words: most from one language, a third changing language."""
    by_label = [[w for w, label in texts if label == k and w] for k in range(size)]
    known = [k for k in range(size) if by_label[k]]
    rows, labels = [], np.zeros((many, LENGTH), np.int64)
    for i in range(many):
        mixes, row = rng.random() < 1 / 3, []
        label = known[rng.integers(len(known))]
        while len(row) < LENGTH:
            words = by_label[label][rng.integers(len(by_label[label]))]
            want = min(LENGTH - len(row), int(rng.integers(4, 20)) if mixes else LENGTH)
            at = int(rng.integers(max(1, len(words) - want + 1)))
            got = words[at:at + want]
            labels[i, len(row):len(row) + len(got)] = label
            row += got
            if mixes:
                label = known[rng.integers(len(known))]
        rows.append(row)
    return rows, labels


def gradients(emit: np.ndarray, labels: np.ndarray, first: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of the mean negative log-likelihood per sequence: by word and label, first label, transition."""
    many, length = labels.shape
    size = len(first)
    starts = np.arange(many + 1) * length
    forward, backward, share = forward_backward(emit, starts, np.exp(first), np.exp(change))
    slope = share.copy()
    slope[np.arange(len(slope)), labels.ravel()] -= 1
    head = slope.reshape(many, length, size)[:, 0].sum(axis=0)
    a = forward.reshape(many, length, size)[:, :-1]
    b = (backward * emit).reshape(many, length, size)[:, 1:]
    pair = a[:, :, :, None] * np.exp(change) * b[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    move = pair.sum(axis=(0, 1))
    np.subtract.at(move, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
    return slope / many, head / many, move / many


def fit(rows: list[tuple[str, str]], steps: int = STEPS, seed: int = 5) -> Model:
    """A model from (text, language) pairs; the same for the same pairs."""
    languages = sorted({lang for _, lang in rows})
    size = len(languages)
    model = Model(languages, np.zeros((SLOTS + size, size), np.float32), {}, np.zeros(size), np.zeros((size, size)))
    texts = [(words_of(t), languages.index(lang)) for t, lang in rows]
    seen = [0] * size
    halves: tuple[list, list] = ([], [])
    for words, label in texts:
        if any(map(has_letter, words)):
            halves[seen[label] % 2].append((words, label))
            seen[label] += 1
    training, model.lexicon = halves[0], lexicons(halves[1], size)
    if size < 2 or not training:
        return model
    number: dict[str, int] = {}
    for words, _ in training:
        for w in words:
            number.setdefault(w, len(number))
    vocabulary = list(number)
    slots, edge = slots_of(vocabulary)
    lettered = np.fromiter(map(has_letter, vocabulary), bool, len(vocabulary))
    known = np.array([model.lexicon.get(w, -1) for w in vocabulary], np.int64)
    counts = np.where(lettered, np.diff(edge), 0)
    rng = np.random.default_rng(seed)
    square = [np.full(model.weights.shape, 1e-8), np.full(size, 1e-8), np.full((size, size), 1e-8)]
    for _ in range(steps):
        words, labels = sequences(training, rng, AT_ONCE, size)
        spot = np.fromiter((number[w] for row in words for w in row), np.int64)
        # (row, slot) of all features of these words, then of their lexicon places
        many = counts[spot]
        row = np.repeat(np.arange(len(spot)), many)
        column = slots[np.repeat(edge[spot] - np.cumsum(many) + many, many) + np.arange(len(row))].astype(np.int64)
        listed = np.flatnonzero(known[spot] >= 0)
        row, column = np.concatenate([row, listed]), np.concatenate([column, SLOTS + known[spot[listed]]])
        taken = model.weights[column]
        logits = np.stack([np.bincount(row, weights=taken[:, k], minlength=len(spot)) for k in range(size)], axis=1)
        by_word, head, move = gradients(factors(logits), labels, model.first, model.change)
        used, at = np.unique(column, return_inverse=True)
        slope = np.stack([np.bincount(at, weights=by_word[row, k], minlength=len(used)) for k in range(size)], axis=1)
        slope += DECAY * model.weights[used]
        square[0][used] += slope**2
        model.weights[used] -= (RATE * slope / np.sqrt(square[0][used])).astype(np.float32)
        square[1] += head**2
        model.first -= RATE * head / np.sqrt(square[1])
        square[2] += move**2
        model.change -= RATE * move / np.sqrt(square[2])
    return model


def fit_rows(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = FIT_TEXTS) -> list[tuple[str, str]]:
    """The bounded sample of the fit as (text, language), the same on every run."""
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("l"), held_out.alias("out"))
    rows = rows.filter(~F.col("out") & F.col("l").isNotNull() & F.col("t").isNotNull() & (F.octet_length("t") <= FIT_BYTES))
    known = rows.select("l", F.xxhash64(F.col("k").cast("string"), "t").alias("h"))
    # of a frequent language only about three times the rows that are wanted go into its window: a share of the hash's range
    counts = known.groupBy("l").agg(F.approx_count_distinct("h").alias("n"))
    share = F.least(F.lit(1.0), F.lit(3.0 * most + 100) / F.col("n"))
    few = known.join(F.broadcast(counts), "l").filter(F.pmod("h", F.lit(1 << 32)) <= share * (1 << 32)).select("l", "h").distinct()
    nth = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    drawn = few.withColumn("nth", nth).filter(F.col("nth") <= most).select("l", "h")
    chosen = rows.withColumn("h", F.xxhash64(F.col("k").cast("string"), "t")).join(F.broadcast(drawn), ["l", "h"])
    got = chosen.groupBy("l", "h").agg(F.min("t").alias("t")).collect()
    return [(r["t"], r["l"]) for r in sorted(got, key=lambda r: (r["l"], r["h"]))]


def predicted(docs: DataFrame, model: Model, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the language of every whole text and its score."""

    def compute(column: pa.Array) -> list:
        got = model.predict([t.as_py() or "" for t in column])
        return [[g[0] for g in got], [g[1] for g in got]]

    return with_columns(docs, text, {out: T.StringType(), score: T.DoubleType()}, compute, SLICE)


def labelled_words(docs: DataFrame, model: Model, text: str = "text", out: str = "word_langs") -> DataFrame:
    """docs with an array of the most probable language of every word (``und`` where it has no letter)."""

    def compute(column: pa.Array) -> list:
        return [model.label_words([t.as_py() or "" for t in column])]

    return with_columns(docs, text, {out: T.ArrayType(T.StringType())}, compute, SLICE)


def op12_languages(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = remainder(4, 2)(F.col("doc_id"))
    model = fit(fit_rows(docs, held_out))
    got = predicted(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
