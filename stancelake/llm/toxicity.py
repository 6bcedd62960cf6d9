"""Convolutional text classifier for toxicity, trained and applied with numpy.

A word is the sum of hashed embeddings of itself and of its beginnings, so that words never seen in
training share what was learnt of their stem. Filters of several widths run over the whole text, each is
max-pooled over all positions, and a linear layer gives the logit. A convolution over summed embeddings is
a sum of table rows, so one product of the embedding table with all filters is made once, and a text costs
only look-ups.

Each language has its own threshold, put in the widest gap of held-back training rows; the language is
guessed from the text by common words. Scores are shifted so that 0.5 is the threshold everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.llm import graph, sampling, text

#: Rows of the embedding table, its width, filters for each width, filter widths, and prefix bytes hashed beside the word.
TABLE, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 16, 8, 8, (1, 2, 3), (4, 5)

#: Words worked on at once; texts of a mini-batch.
PART, BATCH = 40_000, 64

#: Text of a part that one task learns; numbers of a slice of a sum; labels that go to all tasks instead of texts to
#: their labels; steps of a logit of 1 that thresholds are told apart by.
PART_BYTES, SLICE, MOST_BROADCAST, STEPS = 16 << 20, 9 << 12, 2_000_000, 1000

#: Documented bounds of the training sample of `train`: rows of each label, and bytes of text beyond which fewer whole rows are
#: drawn, though not under LEAST_EACH of either label.
MOST_EACH, MOST_BYTES, LEAST_EACH = 3_000, 64 << 20, 200

# Very common words by which a language is guessed.
COMMON_WORDS = {
    "en": "the of and to in is that it with was for",
    "fr": "le la les de des et un une que qui dans pour",
    "de": "der die das und ist von mit den ein nicht zu",
    "es": "el los las y que en con por una para del",
}


def _word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, 1 + prefixes) table rows, the hash of each word, and the number of its text."""
    data = text.lower_ascii(data)
    starts, ends, of = text.word_spans(data, offsets, text.ALNUM)
    spans = text.SpanHash(data)
    whole = spans.of(starts, ends)
    columns = [whole >> np.uint64(48)]
    for size in PREFIXES:
        columns.append(text.mixed(spans.of(starts, np.minimum(ends, starts + size)) + np.uint64(size)) >> np.uint64(48))
    return np.stack(columns, axis=1).astype(np.int32) & (TABLE - 1), whole, of


def _common() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of COMMON_WORDS and, for each, the languages that have it."""
    by: dict[int, list[int]] = {}
    for k, words in enumerate(COMMON_WORDS.values()):
        for word in words.split():
            raw = np.frombuffer(word.encode(), np.uint8)
            by.setdefault(int(text.SpanHash(raw).of(np.array([0]), np.array([len(raw)]))[0]), []).append(k)
    keys = np.array(sorted(by), np.uint64)
    flags = np.zeros((len(keys), len(COMMON_WORDS)), np.float32)
    for i, key in enumerate(keys):
        flags[i, by[int(key)]] = 1
    return keys, flags


def languages(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """For each text the number of the language with most common words; len(COMMON_WORDS) if there are none."""
    keys, flags = _common()
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    hit = keys[at] == hashes
    counts = np.zeros((n, flags.shape[1]), np.float32)
    np.add.at(counts, of[hit], flags[at[hit]])
    return np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), flags.shape[1])


@dataclass(frozen=True)
class Model:
    """pieces[w, j] is the table of look-ups for position j of the filters of width w."""

    look_ups: np.ndarray
    bias: np.ndarray
    top: np.ndarray
    top_bias: float
    thresholds: np.ndarray
    scale: float

    def logits(self, ids: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        pooled, _ = pool(self.look_ups, self.bias, ids, of, n)
        return pooled @ self.top + self.top_bias

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        ids, hashes, of = _word_ids(data, offsets)
        n = len(offsets) - 1
        z = (self.logits(ids, of, n) - self.thresholds[languages(hashes, of, n)]) * self.scale
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def pool(look_ups: np.ndarray, bias: np.ndarray, ids: np.ndarray, of: np.ndarray, n: int, where: bool = False, upto: int | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Largest activation of every filter in every text, at least 0, and the position it was found at.

    A filter that reaches past the end of its text sees nothing there. Many words are worked on in parts, of whole
    texts or of one long text, so that memory does not grow with their number. `upto`: the positions that count, of
    a part that has the words behind it too.
    """
    if len(ids) > PART and of[0] != of[-1]:
        # cut between texts, about the middle
        cut = int(np.searchsorted(of, of[len(of) // 2], "left")) or int(np.searchsorted(of, of[0], "right"))
        row = int(of[cut])
        a, at_a = pool(look_ups, bias, ids[:cut], of[:cut], row, where)
        b, at_b = pool(look_ups, bias, ids[cut:], of[cut:] - row, n - row, where)
        return np.concatenate([a, b]), np.concatenate([at_a, np.where(at_b >= 0, at_b + cut, -1)]) if where else None
    if len(ids) > PART and upto is None:
        # one text: each part sees as many words behind it as the widest filter reaches
        row, out = int(of[0]), np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        at = np.full(out.shape, -1, np.int64) if where else None
        for start in range(0, len(ids), PART):
            part = ids[start : start + PART + max(WIDTHS) - 1]
            a, at_a = pool(look_ups, bias, part, np.zeros(len(part), np.int64), 1, where, PART)
            if where:
                at[row] = np.where(a[0] > out[row], at_a[0] + start, at[row])
            out[row] = np.maximum(out[row], a[0])
        return out, at
    rows = look_ups[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        rows += look_ups[ids[:, k]]
    out = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
    at = np.full(out.shape, -1, np.int64) if where else None
    if not len(ids):
        return out, at
    present, first = np.unique(of, return_index=True)
    column = 0
    for w, width in enumerate(WIDTHS):
        acts = rows[:, column : column + FILTERS] + bias[w * FILTERS : (w + 1) * FILTERS]
        for j in range(1, width):
            column += FILTERS
            if len(ids) > j:
                acts[:-j] += rows[j:, column : column + FILTERS] * (of[j:] == of[:-j])[:, None]
        column += FILTERS
        acts = acts[:upto]
        best = np.maximum.reduceat(acts, first, axis=0)
        mine = slice(w * FILTERS, (w + 1) * FILTERS)
        out[present, mine] = np.maximum(best, 0)
        if where:
            for i, (row, a, b) in enumerate(zip(present, first, [*first[1:], len(ids)])):
                peak = a + acts[a:b].argmax(axis=0)
                at[row, mine] = np.where(best[i] > 0, peak, -1)
    return out, at


def start(odds: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Weights before the first step: the first dimension is the log-odds of a table row, which all filters see alike."""
    columns = sum(WIDTHS) * FILTERS
    params = {
        "emb": rng.normal(0, 0.02, (TABLE, DIM)).astype(np.float32),
        "filters": rng.normal(0, 0.4, (DIM, columns)).astype(np.float32),
        "bias": np.zeros(len(WIDTHS) * FILTERS, np.float32),
        "top": np.abs(rng.normal(0, 0.2, len(WIDTHS) * FILTERS)).astype(np.float32),
        "top_bias": np.zeros(1, np.float32),
    }
    params["emb"][:, 0] += 0.3 * odds
    params["filters"][0] = 0.5
    return params


def descend(params: dict[str, np.ndarray], ids: list[np.ndarray], y: np.ndarray, counts: tuple[int, int], epochs: int, rate: float, rng: np.random.Generator) -> np.ndarray:
    """Adam over mini-batches of these texts, on `params` themselves; returns which table rows were moved.

    counts: texts with label 1 and 0 among all that are learnt, of which these may be a part. Either label weighs half.
    """
    offsets_of = [(w, j) for w, width in enumerate(WIDTHS) for j in range(width)]
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    ones, zeros = counts
    moved, step = np.zeros(TABLE, bool), 0
    for _ in range(epochs if len(y) else 0):
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            have = np.zeros(TABLE, bool)
            for i in batch:
                have[ids[i]] = True
            of = np.repeat(np.arange(len(batch)), [len(ids[i]) for i in batch])
            # look-ups only of the table rows that this batch has
            used = np.flatnonzero(have)
            number = (np.cumsum(have) - 1).astype(np.int32)
            local = np.concatenate([number[ids[i]] for i in batch])
            table = params["emb"][used] @ params["filters"]
            pooled, at = pool(table, params["bias"], local, of, len(batch), where=True)
            z = pooled @ params["top"] + params["top_bias"]
            weight = np.where(y[batch] == 1, 0.5 / ones if ones else 0, 0.5 / zeros if zeros else 0) * (ones + zeros) / len(batch)
            dz = ((1 / (1 + np.exp(-z)) - y[batch]) * weight).astype(np.float32)
            grads = {"top": pooled.T @ dz + 1e-3 * params["top"], "top_bias": dz.sum(keepdims=True)}
            dact = dz[:, None] * params["top"] * (at >= 0)
            grads["bias"] = dact.sum(axis=0)
            g_table = np.zeros_like(table)
            for k, (w, j) in enumerate(offsets_of):
                mine, cols = slice(w * FILTERS, (w + 1) * FILTERS), np.arange(k * FILTERS, (k + 1) * FILTERS)
                where = at[:, mine] + j
                inside = (at[:, mine] >= 0) & (where < len(of))
                inside &= of[np.where(inside, where, 0)] == np.arange(len(batch))[:, None]
                r, c = np.nonzero(inside)
                for column in range(local.shape[1]):
                    np.add.at(g_table, (local[where[r, c], column], cols[c]), dact[:, mine][r, c])
            grads["filters"] = params["emb"][used].T @ g_table
            g_emb = g_table @ params["filters"].T
            step += 1
            b1, b2 = 1 - 0.9**step, 1 - 0.999**step
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                params[k] -= rate * (first[k] / b1) / (np.sqrt(second[k] / b2) + 1e-8)
            # rows that no filter peaked at have no gradient and stay
            hit = used[np.abs(g_table).any(axis=1)]
            g = g_emb[np.abs(g_table).any(axis=1)]
            first["emb"][hit] = 0.9 * first["emb"][hit] + 0.1 * g
            second["emb"][hit] = 0.999 * second["emb"][hit] + 0.001 * g**2
            params["emb"][hit] -= rate * (first["emb"][hit] / b1) / (np.sqrt(second["emb"][hit] / b2) + 1e-8)
            moved[hit] = True
    return moved


def fit(ids: list[np.ndarray], langs: np.ndarray, y: np.ndarray, epochs: int = 6, least_steps: int = 400, rate: float = 0.01, seed: int = 5) -> Model:
    """Adam over mini-batches of texts with balanced labels; every sixth text is kept back for thresholds.

    With one label only, every text scores as that label's share says: 0 or 1 examples give 0.5.
    """
    rng = np.random.default_rng(seed)
    kept = np.arange(len(y)) % 6 == 5
    train = np.flatnonzero(~kept)
    params = start(log_odds([ids[i] for i in train], y[train]), rng)
    epochs = max(epochs, least_steps // max(1, len(train) // BATCH))
    ones, zeros = int((y[train] == 1).sum()), int((y[train] == 0).sum())
    if ones and zeros:
        descend(params, [ids[i] for i in train], y[train], (ones, zeros), epochs, rate, rng)
    look_ups = params["emb"] @ params["filters"]
    model = Model(look_ups, params["bias"], params["top"], float(params["top_bias"][0]), np.zeros(len(COMMON_WORDS) + 1, np.float32), 1.0)
    back = np.flatnonzero(kept)
    z = np.zeros(0)
    if len(back):
        z = model.logits(np.concatenate([ids[i] for i in back]), np.repeat(np.arange(len(back)), [len(ids[i]) for i in back]), len(back))
    return Model(look_ups, params["bias"], params["top"], model.top_bias, calibrate(z, langs[back], y[back] == 1, y[back] == 0), 1.0)


def log_odds(ids: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Of each table row, how much likelier a text with label 1 has it than one with label 0; near 0 for rows in few texts."""
    have = np.zeros((2, TABLE), np.float32)
    for row, label in zip(ids, y):
        have[label, np.unique(row)] += 1
    return odds_of(have, int((y == 1).sum()), int((y == 0).sum()))


def odds_of(have: np.ndarray, ones: int, zeros: int) -> np.ndarray:
    """The log-odds of log_odds, from the number of texts with label 0 and 1 that have each table row."""
    odds = np.log((have[1] + 0.5) / (1 + ones)) - np.log((have[0] + 0.5) / (1 + zeros))
    return odds * have.sum(axis=0) / (have.sum(axis=0) + 2)


def calibrate(z: np.ndarray, langs: np.ndarray, ones: np.ndarray, zeros: np.ndarray, least: int = 8) -> np.ndarray:
    """Per language the middle of the best cut by balanced accuracy; with under `least` texts of a label, the cut over all.

    ones, zeros: texts of either label with that logit and language.
    """

    def cut(mine: np.ndarray) -> float:
        order = np.argsort(z[mine], kind="stable")
        of_z = z[mine][order]
        below_bad, below_good = np.append(0, np.cumsum(ones[mine][order])), np.append(0, np.cumsum(zeros[mine][order]))
        gain = below_good / max(1, below_good[-1]) - below_bad / max(1, below_bad[-1])
        best = np.flatnonzero(gain >= gain.max() - 1e-12)
        edges = np.concatenate([[of_z[0] - 1], (of_z[1:] + of_z[:-1]) / 2, [of_z[-1] + 1]])
        gaps = np.concatenate([[0], np.diff(of_z), [0]])
        return float(edges[best[np.argmax(gaps[best])]])

    enough = lambda mine: min(ones[mine].sum(), zeros[mine].sum()) >= least
    every = np.ones(len(z), bool)
    common = cut(every) if enough(every) else 0.0
    return np.array([cut(langs == k) if enough(langs == k) else common for k in range(len(COMMON_WORDS) + 1)], np.float32)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Instead of the column text, the language of each (lang) and the table rows of its words (words)."""
    for batch in batches:
        for part in text.steps(batch, "text"):
            ids, hashes, of = _word_ids(*text.joined(part.column("text")))
            cuts = np.searchsorted(of, np.arange(part.num_rows + 1))
            lang = languages(hashes, of, part.num_rows).astype(np.int32)
            packed = [ids[a:b].astype(np.uint16).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            rest = [c for c in part.schema.names if c != "text"]
            columns = [*(part.column(c) for c in rest), pa.array(lang), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*rest, "lang", "words"])


def _words(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16).reshape(-1, 1 + len(PREFIXES)) for x in column]


def train(documents: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_each: int = MOST_EACH, seed: int = 11) -> Model:
    """Fits on the driver to texts whose ids are in `labelled` (id, label 0 or 1), at most about `most_each` of either label.

    A quick model for a bounded sample; train_whole learns all labelled texts, and op6 and the pipeline use that. The sample is drawn by a hash of the id, so what is broadcast and what the driver gets is bounded. Of texts that
    share an id one is learnt. Texts are learnt whole: where those of the sample are over MOST_BYTES, fewer rows are
    drawn.
    """
    labelled = labelled.where("id IS NOT NULL").dropDuplicates(["id", "label"])
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}

    def drawn(most: int) -> DataFrame:
        one, two = (sampling.about(labelled.where(F.col("label") == label), ["id"], most, seed + label, counts.get(label, 0)) for label in (0, 1))
        return one.union(two)

    def texts_of(chosen: DataFrame) -> DataFrame:
        rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
        return sampling.one_each(rows, "id", "label", "text").select(F.col("id").cast("string").alias("id"), "label", "text")

    rows = texts_of(drawn(most_each))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > MOST_BYTES:
        share = MOST_BYTES / size
        rows = texts_of(drawn(max(min(LEAST_EACH, most_each), int(min(most_each, max(counts.values())) * share))))

    got = rows.mapInArrow(_pack, "id string, label int, lang int, words binary").toArrow().sort_by([("id", "ascending"), ("words", "ascending")])
    return fit(_words(got.column("words")), got.column("lang").to_numpy(), got.column("label").to_numpy().astype(np.int64))


def train_whole(documents: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 6, least_steps: int = 400, rate: float = 0.01, part_bytes: int = PART_BYTES, seed: int = 5) -> Model:
    """Fits to every text whose id is in `labelled` (id, label 0 or 1), however many; ids of both labels do not count.

    Log-odds, weights and thresholds are of all these texts; a sixth, by a hash of the id, is kept back from the first
    two for the third. Texts are dealt to parts of about `part_bytes` by a hash of the id. In each round the
    weights go to all tasks, which descend on their parts, and what they changed is averaged: over all parts by their
    texts, for a table row over the parts that moved it. A single part needs one round. Parts, not partitions, decide
    the result. The driver gets sums of the weights' size. Of texts that share an id one is learnt.
    """
    spark = documents.sparkSession
    labelled = sampling.agreed(labelled.where("label IN (0, 1)"), "label", "id")
    rows = _labelled_texts(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), labelled)
    rows = rows.withColumn("kept", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(6)) == 5)
    one, zero = F.col("label") == 1, F.col("label") == 0
    got = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(one & ~F.col("kept")), F.count_if(zero & ~F.col("kept"))).first()
    size, ones, zeros = (int(x) for x in got)
    parts = max(1, -(-size // part_bytes))

    place = [F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(parts)).cast("int").alias("part"), F.xxhash64(F.lit(seed + 2), "id").alias("place")]
    packed = rows.select(*place, "label", "kept", "text").mapInArrow(_pack, "part int, place long, label int, kept boolean, lang int, words binary")
    dealt = graph.cut(packed.repartition(parts, "part").sortWithinPartitions("part", "place", "words"))
    learnt = dealt.where("NOT kept").select("part", "label", "words")

    have = _summed(learnt, _counted) if ones + zeros else np.zeros(2 * TABLE)
    params = start(odds_of(have.reshape(2, TABLE), ones, zeros), np.random.default_rng(seed))
    batches = max(1, (ones + zeros) // (parts * BATCH))
    if parts == 1:
        epochs, rounds = max(rounds, least_steps // batches), 1
    else:
        epochs = max(1, least_steps // (rounds * batches))
    for k in range(rounds if ones and zeros else 0):
        shared = spark.sparkContext.broadcast(params)
        params = _apply(params, _summed(learnt, _descended(shared, (ones, zeros), epochs, rate, [seed, k])))
        shared.destroy()

    model = Model(params["emb"] @ params["filters"], params["bias"], params["top"], float(params["top_bias"][0]), np.zeros(len(COMMON_WORDS) + 1, np.float32), 1.0)
    steps = dealt.where("kept").select("label", "lang", "words").mapInArrow(_steps_of(spark.sparkContext.broadcast(model)), "lang int, step int, label int")
    back = steps.groupBy("lang", "step").agg(F.count_if(one).alias("ones"), F.count_if(zero).alias("zeros")).toArrow().to_pandas()
    thresholds = calibrate(back["step"].to_numpy() / STEPS, back["lang"].to_numpy(), back["ones"].to_numpy(), back["zeros"].to_numpy())
    return replace(model, thresholds=thresholds)


def _labelled_texts(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """(id, label, text) of the rows (id, text) that have a label, one for each id. Texts move only where ids repeat or labels are many."""
    few = labelled.count() <= MOST_BROADCAST
    have = rows.join(F.broadcast(labelled) if few else labelled, "id").select("id", "label", "text")
    repeated = graph.cut(have.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    if repeated.isEmpty():
        return have
    return have.join(repeated, "id", "left_anti").unionByName(sampling.one_each(have.join(repeated, "id", "left_semi"), "id", "label", "text"))


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(part, table rows of each of its texts, labels) of rows that are in order of their part."""
    mine, ids, y = None, [], []
    for batch in batches:
        part = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                if part[a] != mine and ids:
                    yield mine, ids, np.concatenate(y)
                    ids, y = [], []
                mine = int(part[a])
                ids += _words(batch.column("words").slice(a, b - a))
                y.append(batch.column("label").slice(a, b - a).to_numpy().astype(np.int64))
    if ids:
        yield mine, ids, np.concatenate(y)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Of each part, how many of its texts with label 0 and 1 have each table row."""
    for part, ids, y in _by_part(batches):
        have = np.zeros((2, TABLE), np.float32)
        for row, label in zip(ids, y):
            have[label, np.unique(row)] += 1
        yield part, have.ravel()


def _descended(shared, counts: tuple[int, int], epochs: int, rate: float, seed: list[int]) -> Callable:
    """Of each part: for each table row 1 and how far it moved, or zeros if it did not; its texts, and times those how far the other weights moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for part, ids, y in _by_part(batches):
            params = {k: v.copy() for k, v in shared.value.items()}
            moved = descend(params, ids, y, counts, epochs, rate, np.random.default_rng([*seed, part]))
            rows = np.hstack([moved[:, None], params["emb"] - shared.value["emb"]]).astype(np.float32)
            rest = [(params[k] - shared.value[k]).ravel() * len(y) for k in params if k != "emb"]
            yield part, np.concatenate([rows.ravel(), *rest, [len(y)]]).astype(np.float32)

    return run


def _apply(params: dict[str, np.ndarray], total: np.ndarray) -> dict[str, np.ndarray]:
    """`params` after the mean of what the parts of _descended changed."""
    rows, rest = total[: TABLE * (1 + DIM)].reshape(TABLE, 1 + DIM), total[TABLE * (1 + DIM) :]
    out, at = {"emb": (params["emb"] + rows[:, 1:] / np.maximum(1, rows[:, :1])).astype(np.float32)}, 0
    for k, v in params.items():
        if k != "emb":
            out[k] = (v + rest[at : at + v.size].reshape(v.shape) / max(1, rest[-1])).astype(np.float32)
            at += v.size
    return out


def _summed(rows: DataFrame, of_parts: Callable) -> np.ndarray:
    """Sum of the vectors that `of_parts` gives for the parts of `rows`; added in order of the parts, by slices in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, vector in of_parts(batches):
            cuts = [vector[a : a + SLICE] for a in range(0, len(vector), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([part] * len(cuts), pa.int32()), pa.array([x.tobytes() for x in cuts], pa.binary())], ["slice", "part", "values"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, total = None, None
        pair = lambda: pa.RecordBatch.from_arrays([pa.array([mine], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "values"])
        for batch in batches:
            for k, raw in zip(batch.column("slice").to_pylist(), batch.column("values")):
                values = np.frombuffer(raw.as_buffer(), np.float32).astype(np.float64)
                if k == mine:
                    total += values
                else:
                    if total is not None:
                        yield pair()
                    mine, total = k, values
        if total is not None:
            yield pair()

    slices = rows.mapInArrow(run, "slice int, part int, values binary").repartition("slice").sortWithinPartitions("slice", "part")
    got = slices.mapInArrow(add, "slice int, values binary").toArrow().sort_by("slice")
    return np.concatenate([np.zeros(0), *(np.frombuffer(x.as_buffer(), np.float64) for x in got.column("values"))])


def _steps_of(shared) -> Callable:
    """The logit of each text in whole steps, 1/STEPS each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _words(batch.column("words"))
            z = np.zeros(0)
            if ids:
                z = shared.value.logits(np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(x) for x in ids]), len(ids))
            step = np.clip(np.rint(z * STEPS), -30 * STEPS, 30 * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(step), batch.column("label")], ["lang", "step", "label"])

    return run


def probability(model: Model, spark: SparkSession) -> Callable[[Column], Column]:
    """Text column -> double in (0, 1): 0.5 or more is toxic. Null texts count as empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts):
        out = [np.zeros(0)]
        batch = pa.RecordBatch.from_arrays([pa.Array.from_pandas(texts, type=pa.large_string())], ["text"])
        for part in text.steps(batch, "text"):
            out.append(shared.value.probabilities(*text.joined(part.column("text"))))
        return pd.Series(np.concatenate(out))

    return of


def score(documents: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of `documents` and a double in (0, 1): 0.5 or more is toxic. Null texts count as empty. No shuffle.

    Where `documents` has a column `score_col` already it stays, and the new one gets underscores behind its name.
    Repeated rows are scored alike, an empty table stays empty.
    """
    return documents.select("*", probability(model, documents.sparkSession)(F.col(text_col)).alias(text.free_name(documents.columns, score_col)))
