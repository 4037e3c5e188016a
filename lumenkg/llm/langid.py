"""Language identification by multilingual mixture inference.

A document is a mixture of languages: each of its character trigrams comes from one language, drawn by
the document's proportions, or from uniform noise. Expectation-maximisation finds the proportions for
sets of one, two, ... languages, as long as the penalised likelihood rises, then without those that are
not worth their penalty; the set with the highest penalised likelihood is taken. Trigram
counts are summed per partition before the shuffle, so what is shuffled and sent to the driver is
bounded by the number of languages and of trigram classes, whatever the size of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal

#: Classes that trigrams are hashed to.
CLASSES = 1 << 16
#: Languages that a model may hold, unless more are asked for; it takes 256 KB for each on the driver and every executor.
MOST_LANGUAGES = 256
#: Added to each count.
SMOOTHING = 0.2
#: Rounds of expectation-maximisation, and nats a language costs for each doubling of the trigrams.
ROUNDS, PENALTY = 10, 6.0
#: Trigrams that are worked on at once.
CHUNK = 400_000

_LETTERS = np.array([ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(128)], dtype=np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def trigrams(text: str) -> np.ndarray:
    """Classes of the trigrams of letters, sorted. ASCII characters that are no letters separate words; the ends of the text do, too."""
    a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    a = np.where(a < 128, _LETTERS[np.minimum(a, 127)], a)
    blank = a == 32
    a = np.concatenate([a[:1], a[1:][~(blank[1:] & blank[:-1])]])
    if len(a) < 3:
        return np.empty(0, dtype=np.uint16)
    h = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77) + a[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return np.sort((h >> np.uint32(16)).astype(np.uint16), kind="stable")


@dataclass(frozen=True)
class Model:
    """languages: sorted. likelihood: CLASSES rows; a column for each language and a last one for noise."""

    languages: list[str]
    likelihood: np.ndarray


def train(docs: DataFrame, text: str = "text", lang: str = "lang", most_languages: int = MOST_LANGUAGES) -> Model:
    """Count the trigrams of all rows with a text and a language, by language. More languages than most_languages are an error.

    Null texts or languages teach nothing; an empty text is a row without trigrams; rows that repeat each
    other count each time; very long texts count as a whole; an empty table makes a model without languages;
    other columns are not read.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(name, np.zeros(CLASSES, dtype=np.int64))
                own += np.bincount(trigrams(t), minlength=CLASSES)
        for name, own in sums.items():
            there = own.nonzero()[0]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(there), pa.string()), pa.array(there.astype(np.int32)), pa.array(own[there])], names=["lang", "class", "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna().mapInArrow(frugal(count), "lang string, class int, n long")
    # at most CLASSES rows a language reach the driver
    found = rows.groupBy("lang", "class").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list("class").alias("classes"), F.collect_list("n").alias("ns")).limit(most_languages + 1).collect()
    if len(found) > most_languages:
        raise ValueError(f"more than {most_languages} languages: the model would be too large to send to every executor")
    found.sort(key=lambda r: r["lang"])
    columns = []
    for r in found:
        n = np.full(CLASSES, SMOOTHING)
        n[np.array(r["classes"], dtype=np.int64)] += r["ns"]
        columns.append(n / n.sum())
    columns.append(np.full(CLASSES, 1 / CLASSES))
    return Model([r["lang"] for r in found], np.stack(columns, axis=1).astype(np.float32))


def _fit(p: np.ndarray, n: np.ndarray, starts: np.ndarray, owner: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some rounds, from those given (a zero stays zero), and the log-likelihood at their start of the last round."""
    total = np.add.reduceat(n, starts)
    for _ in range(rounds):
        joint = p * share[owner]
        whole = joint.sum(axis=1)
        likelihood = np.add.reduceat(n * np.log(whole), starts)
        joint *= (n / whole)[:, None]
        share = np.add.reduceat(joint, starts, axis=0) / total[:, None]
    return share, likelihood


#: Language with the largest share, its share among the languages of the set, share of noise, and all languages of the set with their shares.
Found = tuple[str, float, float, dict[str, float]]


def infer(model: Model, texts: list[str]) -> list[Found]:
    """What is found in texts that have trigrams."""
    grams = [trigrams(t) for t in texts]
    out: list[Found] = []
    at = 0
    while at < len(grams):
        upto, size = at, 0
        while upto < len(grams) and (upto == at or size + len(grams[upto]) <= CHUNK):
            size += len(grams[upto])
            upto += 1
        out += _infer(model, grams[at:upto])
        at = upto
    return out


class _Batch:
    """Trigrams of some documents: n of each class a document, likelihoods p, first row of each document."""

    def __init__(self, p: np.ndarray, n: np.ndarray, starts: np.ndarray):
        self.p, self.n, self.starts = p, n, starts
        self.ends = np.append(starts[1:], len(n))
        self.owner = np.repeat(np.arange(len(starts)), self.ends - starts)
        self.size = np.add.reduceat(n, starts)

    def of(self, docs: np.ndarray) -> _Batch:
        if len(docs) == len(self.starts):
            return self
        sizes = self.ends[docs] - self.starts[docs]
        begins = np.cumsum(sizes) - sizes
        rows = np.repeat(self.starts[docs] - begins, sizes) + np.arange(sizes.sum())
        return _Batch(self.p[rows], self.n[rows], begins)

    def fitted(self, sets: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Proportions within the sets (booleans by document and language), from those given, and the penalised likelihood."""
        start = np.zeros_like(share)
        start[:, :-1] = np.where(sets, share[:, :-1] + 0.01, 0)
        start[:, -1] = share[:, -1] + 0.01
        start /= start.sum(axis=1, keepdims=True)
        found, likelihood = _fit(self.p, self.n, self.starts, self.owner, start, rounds)
        return found, likelihood - PENALTY * sets.sum(axis=1) * np.log2(self.size + 1)


def _infer(model: Model, grams: list[np.ndarray]) -> list[Found]:
    every = np.concatenate(grams)
    doc = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    new = np.ones(len(every), dtype=bool)
    new[1:] = (every[1:] != every[:-1]) | (doc[1:] != doc[:-1])
    first = new.nonzero()[0]
    n = np.diff(np.append(first, len(every))).astype(np.float32)
    batch = _Batch(model.likelihood[every[first]], n, np.searchsorted(doc[first], np.arange(len(grams))))
    k, docs = len(model.languages), len(grams)
    share, _ = _fit(batch.p, n, batch.starts, batch.owner, np.full((docs, k + 1), 1 / (k + 1), dtype=np.float32), ROUNDS)
    rank = np.argsort(np.argsort(-share[:, :k], axis=1, kind="stable"), axis=1, kind="stable")
    best, chosen = np.full(docs, -np.inf), np.zeros((docs, k + 1), dtype=np.float32)

    def tried(some: np.ndarray, sets: np.ndarray, shares: np.ndarray, rounds: int) -> np.ndarray:
        """Take the sets for those of the documents where they are better than what they have; these documents."""
        found, value = batch.of(some).fitted(sets, shares, rounds)
        better = value > best[some]
        best[some[better]], chosen[some[better]] = value[better], found[better]
        return some[better]

    some = np.arange(docs)
    for m in range(1, k + 1):  # one language more, where the one before was worth it
        some = tried(some, rank[some] < m, share[some], ROUNDS if m > 1 else ROUNDS // 2)
        if not len(some):
            break
    some = np.flatnonzero((chosen[:, :k] > 0).sum(axis=1) > 2)
    while len(some):  # one less, where that is better
        sets = chosen[some, :k] > 0
        sets[np.arange(len(some)), np.where(sets, chosen[some, :k], np.inf).argmin(axis=1)] = False
        some = tried(some, sets, chosen[some], ROUNDS)
        some = some[(chosen[some, :k] > 0).sum(axis=1) > 2]
    whole = np.maximum(chosen[:, :k].sum(axis=1, keepdims=True), 1e-9)
    own = np.minimum(chosen[:, :k] / whole, 1.0)
    top = own.argmax(axis=1)
    return [(model.languages[a], float(s[a]), float(z), {model.languages[i]: float(s[i]) for i in s.nonzero()[0]}) for a, s, z in zip(top, own, chosen[:, k], strict=True)]


def _predict(model: Model, texts: list[str | None]) -> list[Found]:
    known = [k for k, t in enumerate(texts) if model.languages and has_letter(t)]
    out: list[Found] = [("und", 0.0, 1.0, {})] * len(texts)
    for k, found in zip(known, infer(model, [texts[k] for k in known]), strict=True):
        out[k] = found
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", prefix: str = "lang_") -> DataFrame:
    """docs with ``pred``, ``score``, ``noise`` (share of trigrams that no language accounts for) and ``mixture`` (share of each language of the set), their names after prefix, in place of columns of those names.

    Null texts, texts without a letter and all texts where the model has no language are ``und`` with
    score 0, noise 1 and no mixture. Of languages with equal shares the first by name is taken. Long texts
    are judged as a whole, repeated rows each for itself; other columns are kept, and an empty table gives
    no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = {f"{prefix}pred": "string", f"{prefix}score": "double", f"{prefix}noise": "double", f"{prefix}mixture": "map<string,double>"}
    out = docs.select(*[c for c in docs.columns if c not in added]).withColumns({c: F.lit(None).cast(kind) for c, kind in added.items()})

    def run(batches):
        for batch in batches:
            found = _predict(sent.value, batch.column(text).to_pylist())
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.map_(pa.string(), pa.float64()))
            put = {name: pa.array([list(f[k].items()) if k == 3 else f[k] for f in found], kind) for k, (name, kind) in enumerate(zip(added, kinds, strict=True))}
            yield pa.RecordBatch.from_arrays([put.get(name, column) for name, column in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    return out.mapInArrow(frugal(run), out.schema)


def fold(key: Column, folds: int = 5) -> Column:
    """CRC-32 of the key as text, modulo folds; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def predictions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, languages (share of each). Learnt from rows with a fold other than 0 and a language."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = train(rows.where(fold(F.col("doc_id"), folds) != 0))
    found = identify(rows.select("doc_id", "text", (fold(F.col("doc_id"), folds) == 0).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_mixture").alias("languages"))


def accepted(docs: DataFrame, most_noise: float = 0.5, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents in some known language: not ``und``, and at most the share most_noise of noise. Learnt from all labelled rows of docs.

    Null texts, and those without a letter, are ``und`` and go; rows that repeat each other stay or go
    together; a tie goes to the language that comes first by name; very long texts are read as a whole; an empty
    table stays empty, and with no labelled row none is accepted. All columns stay; none may begin with __langid_.
    """
    found = identify(docs, train(docs, text, lang), text, prefix="__langid_")
    return found.where((F.col("__langid_pred") != "und") & (F.col("__langid_noise") <= most_noise)).select(*docs.columns)
