"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model gives each document evidence from its own text. Hosts, and paths within hosts, get Beta
posteriors from the evidence of all their documents: a host is shrunk towards the whole corpus, a path towards its host,
the more the fewer documents they have. How strongly is estimated from the corpus by the method of moments. A document's
final log-odds are its own plus what its site (without itself) says beyond the whole corpus.

Toxicity is judged from words alone: words and beginnings of words that labelled toxic documents have far more often than other labelled
documents are telling, and a second logistic model weighs how many of them a text has. Toxic documents are rejected whatever their quality.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quillspark.llm.text import REMEMBERED, gram_hashes, word_hashes
from quillspark.session import durable, sized

#: At most so many labelled documents are used to fit the model (those with the smallest hashes of doc_id).
SAMPLE = 20_000
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
MARKS, STOPS = b"#$%&*|<>{}[]=~^_@\\/+", b".,;:"
FEATURES, MARKS_OF_WORDS = 14, 4
#: At most so many telling words and beginnings are kept (those with the strongest evidence).
TELLING = 4096
#: They are sought among those of at least so many labelled documents.
SEEN = 2
#: Letters of the beginnings of words that are looked at beside whole words.
BEGINNINGS = (4, 5, 6, 7)
#: Logarithm of the odds against one being telling by chance, beyond the number looked at.
BEYOND_CHANCE = 3.0
#: A-Z in lower case, all other ASCII but a-z a space.
_WORDS = bytes(b if b in LETTERS and b > 90 else b + 32 if b in UPPER else 32 for b in range(256))


def features(blob: bytes) -> list[float]:
    """Shape of a text: lengths, shares of kinds of bytes, repetition. Empty texts get zeros and a flag."""
    n, words = len(blob), blob.split()
    if not words:
        return [1.0] + [0.0] * (FEATURES - 1)

    def share(kind: bytes) -> float:
        return (n - len(blob.translate(None, kind))) / n

    lines = [x for x in blob.split(b"\n") if x]
    count = Counter(words)
    total = len(words)
    letters = share(LETTERS)
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False)) / total
    return [
        0.0,
        np.log1p(total),
        n / total,
        letters,
        share(UPPER) / max(letters, 1e-3),
        share(DIGITS),
        share(MARKS),
        share(STOPS),
        (blob.count(b"!") + blob.count(b"?")) / total,
        np.log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        np.log(len(count)) / max(1.0, np.log(total)) if total > 1 else 1.0,
        count.most_common(1)[0][1] / total,
        repeated,
    ]


def letter_words(blob: bytes) -> list[bytes]:
    """Runs of letters (all beyond ASCII counts as such), only A-Z lower-cased."""
    return blob.translate(_WORDS).split()


class Telling(dict):
    """Weight of each word: that of its most telling form, 0 for none; so many words are remembered, others looked up anew."""

    def __init__(self, weights: dict[str, int]) -> None:
        super().__init__()
        self.weights = weights

    def __reduce__(self) -> tuple:
        return Telling, (self.weights,)

    def __missing__(self, word: bytes) -> int:
        text = word.decode(errors="replace")
        forms = [text, *(f"{text[:n]}*" for n in BEGINNINGS if len(text) >= n)]
        weight = max((self.weights.get(f, 0) for f in forms), default=0)
        if len(self) < REMEMBERED:
            self[word] = weight
        return weight

    def marks(self, words: set[bytes]) -> list[float]:
        """Whether a text's distinct words have any weight, and their weights' sum: as it is, its logarithm, and for its number of words."""
        total = sum(map(self.__getitem__, words)) / 1000
        return [float(total > 0), min(total, 30.0), np.log1p(total), total / max(1, len(words)) ** 0.5]


def word_forms(words: Column) -> Column:
    """Distinct words and their beginnings, which end in a star."""

    def begin(n: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    return F.array_distinct(F.concat(words, *map(begin, BEGINNINGS)))


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(quality, toxic: 0, 1 or null; x: shape; alike: long; words: distinct) of labelled documents, kept in the shared folder.

    alike is the smallest hash of a text's 5-word shingles, which most near copies of it share.
    """
    toxic = F.col("toxic") if "toxic" in labels.columns else F.lit(None).cast("int")
    some = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("quality"), (F.max(toxic) > 0).cast("int").alias("toxic"))
    some = some.where("quality IS NOT NULL OR toxic IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so the broadcast has at most `sample` rows
    schema = "doc_id bigint, quality int, toxic int, x array<double>, alike bigint, words array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(3).cast(pa.binary())]
            x = pa.array([features(t) for t in texts], pa.list_(pa.float64()))
            hashes, starts = word_hashes(texts)
            alike = np.zeros(len(texts), np.uint64)
            for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                if b > a:
                    alike[i] = gram_hashes(hashes[a:b], min(5, b - a)).min()
            words = pa.array([sorted(w.decode() for w in set(letter_words(t))) for t in texts], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], x, pa.array(alike.view(np.int64)), words], names=["doc_id", "quality", "toxic", "x", "alike", "words"])

    rows = docs.join(F.broadcast(some), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic", "text")
    return durable(rows.mapInArrow(run, schema).orderBy("doc_id", F.xxhash64("words", "x")).limit(sample))


def telling_words(rows: DataFrame, most: int = TELLING) -> dict[str, int]:
    """Words and beginnings (with a star) that toxic documents have more often than chance explains, and their log-odds in thousandths; near copies count once.

    One of a toxic and b other documents scores the log-likelihood ratio of a / (a + b) to the toxic share of all documents,
    and must beat the number that are looked at.
    """
    rows = rows.where("toxic IS NOT NULL").groupBy("toxic", "alike").agg(F.min_by("words", F.struct("doc_id", "words")).alias("words"))
    bad, total = rows.agg(F.sum("toxic"), F.count("*")).first()
    if not bad or bad == total:
        return {}
    share = bad / total
    forms = durable(rows.select("toxic", F.explode(word_forms(F.col("words"))).alias("form")).groupBy("form").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).where(F.col("n") >= SEEN))
    a, n = F.col("a"), F.col("n")
    score = a * F.log(a / n / share) + F.when(n > a, (n - a) * F.log((n - a) / n / (1 - share))).otherwise(0.0)
    weight = F.log((a + 0.5) / (bad + 1)) - F.log((n - a + 0.5) / (total - bad + 1))
    enough = float(np.log(max(1, forms.count()))) + BEYOND_CHANCE
    best = forms.where(a > n * share).select("form", score.alias("score"), F.round(weight * 1000).cast("int").alias("weight")).where((F.col("score") >= enough) & (F.col("weight") > 0))
    return {r["form"]: r["weight"] for r in best.orderBy(F.desc("score"), "form").limit(most).collect()}


class Model:
    """Logistic regression on standardized features and their squares, fitted by Newton steps with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        if not len(x) or y.min() == y.max():  # nothing to tell apart: the share of good ones, smoothed
            self.mean = self.scale = None
            self.weights = np.array([np.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
            return
        x = self._wide(x)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        a = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        w, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    @staticmethod
    def _wide(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, x**2])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.weights[0])
        return np.clip(self.weights[0] + ((self._wide(x) - self.mean) / self.scale) @ self.weights[1:], -20, 20)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Model, Model, Telling]:
    """Models of quality (from shapes) and toxicity (from marks), and the telling words, of labels (doc_id, quality, toxic: 0 or 1; nulls and a lack of toxic are left out)."""
    rows = labelled(docs, labels, sample)
    telling = Telling(telling_words(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [telling.marks({w.encode() for w in words}) for words in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    known = rows.where("quality IS NOT NULL").select("doc_id", F.col("quality").alias("y"), "x").orderBy("doc_id", "x").collect()
    words = rows.where("toxic IS NOT NULL").select(F.col("toxic").alias("y"), "words").mapInArrow(run, "y int, x array<double>").orderBy("y", "x").collect() if telling.weights else []
    quality = Model(np.array([r["x"] for r in known], float).reshape(-1, FEATURES), np.array([float(r["y"]) for r in known]))
    return quality, Model(np.array([r["x"] for r in words], float).reshape(-1, MARKS_OF_WORDS), np.array([float(r["y"]) for r in words])), telling


def _strength(groups: DataFrame) -> float:
    """How many documents the prior of these groups (n, s: sum of probabilities) is worth, by the method of moments."""
    r = groups.where("n >= 2").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.count("*").alias("g"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not r["g"] or r["g"] < 2:
        return 1e6
    mean = min(max(r["s"] / r["n"], 1e-6), 1 - 1e-6)
    between = r["q"] - r["n"] * mean**2  # weighted squares of the group means about the whole mean
    spread = (between - (r["g"] - 1) * mean * (1 - mean)) / (r["n"] - r["nn"] / r["n"])
    return float(np.clip(mean * (1 - mean) / spread - 1, 1.0, 1e6)) if spread > 0 else 1e6


def _log_odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(p / (1 - p))


def _row_key(host: Column, path: Column, text: Column) -> list[Column]:
    """Two hashes (key_a, key_b) of all that a decision depends on."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (host, path, text)]
    return [F.xxhash64(*parts).alias("key_a"), F.xxhash64(F.lit(1), *parts).alias("key_b")]


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Quality of every document: its own evidence, its site's posteriors, both together, and the decision.

    docs needs doc_id and text, and what host and path (within the host) are made of: source and lang unless given.
    labels needs doc_id and quality, and may have toxic. Returns doc_id, evidence (probability from the text alone), host_posterior,
    path_posterior, quality (probability), toxicity (probability), keep (quality >= threshold and toxicity < 0.5), key_a and key_b (hashes of host, path and text, on which alone the decision depends).

    Without toxic labels of both kinds, or without words that tell them apart beyond chance, toxicity is 0. So few labels (some 50 toxic ones are enough
    for the given tables) reject nothing for toxicity.

    A null host or path is a site of its own. Null texts count as empty. Rows with a null or repeated doc_id are
    judged one by one. Without labels of both kinds all texts give the same evidence. Empty tables give empty results.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    own = docs.select(F.col("doc_id").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), *_row_key(host, path, F.col("text")), F.col("text").alias("text"))
    model, toxic, telling = fit(own, labels, sample)
    schema = own.drop("text").schema.add("odds", "double").add("toxicity", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(batch.num_columns - 1).cast(pa.binary())]
            x = np.array([features(t) for t in texts], float).reshape(-1, FEATURES)
            toxicity = np.zeros(len(texts))
            if telling.weights:
                toxicity = 1 / (1 + np.exp(-toxic.log_odds(np.array([telling.marks(set(letter_words(t))) for t in texts], float).reshape(-1, MARKS_OF_WORDS))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.log_odds(x), pa.float64()), pa.array(toxicity, pa.float64())], names=schema.fieldNames())

    scored = durable(own.mapInArrow(run, schema).withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit("")), "p": 1 / (1 + F.exp(-F.col("odds")))}))
    # sums of rounded values, so that they don't depend on the order of rows
    paths = durable(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.col("p").cast("decimal(20,12)")).cast("double").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum(F.col("s").cast("decimal(38,12)")).cast("double").alias("hs"))
    total = paths.agg(F.sum("n"), F.sum(F.col("s").cast("decimal(38,12)")).cast("double")).first()
    mean = float(total[1] / total[0]) if total[0] else 0.5
    k_host, k_path = _strength(hosts.select(F.col("hn").alias("n"), F.col("hs").alias("s"))), _strength(paths)
    sites = paths.join(hosts, "host")
    both = scored.join(sites, ["host", "path"])
    p = F.col("p")
    host_posterior = (F.col("hs") - p + k_host * mean) / (F.col("hn") - 1 + k_host)
    path_posterior = (F.col("s") - p + k_path * host_posterior) / (F.col("n") - 1 + k_path)
    odds = F.col("odds") + _log_odds(path_posterior) - float(np.log(max(mean, 1e-9) / max(1 - mean, 1e-9)))
    quality = 1 / (1 + F.exp(-odds))
    return both.select("doc_id", p.alias("evidence"), host_posterior.alias("host_posterior"), path_posterior.alias("path_posterior"), quality.alias("quality"), "toxicity", ((quality >= threshold) & (F.col("toxicity") < 0.5)).alias("keep"), "key_a", "key_b")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs, with all columns, without those that the classifier rejects.

    Rows are told apart by source, lang and text, so a row that shares its doc_id with a rejected one stays; rows without doc_id are judged too.
    """
    rejected = sized(classify(docs, labels, threshold=threshold).where("NOT keep").select("key_a", "key_b").distinct())
    key_a, key_b = _row_key(docs["source"], docs["lang"], docs["text"])
    return docs.join(rejected, (key_a == rejected["key_a"]) & (key_b == rejected["key_b"]), "left_anti")
