"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The lexicon is learned from labelled rows: words and word beginnings that occur far oftener in toxic texts. Two
halves of the rows learn a lexicon each, and a half's features for the trees use the lexicon of the other, so
the trees see the lexicon as it will be on new texts. Trees are grown on three quarters of the rows and
calibrated on the rest. Learning takes about TRAIN_ROWS labelled rows at most; scoring reads every whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import is_held_out, pick, raw_texts, slices
from gaugeworks.session import checkpointed

TRAIN_ROWS, LEXICON_UNITS, LEAST_TOXIC, LEAST_LOG_ODDS, THRESHOLD = 20_000, 5000, 4, 2.0, 0.3
STARTS = (4, 5, 6, 7)

# Words of second-person address in the languages of the tables.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deiner deinem deinen ihr euch euer eure tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros vuestro vuestra".split()
)
# Signs that stand for letters.
LOOKALIKES = str.maketrans("013457@$!|", "oieastasii")

FEATURES = (
    "hit_rate", "hits", "distinct_hits", "weight_rate", "top_weight", "second_person_rate", "hits_near_second_person",
    "capital_rate", "shouted_rate", "punctuation_rate", "exclamation_rate", "obfuscation_rate", "words", "word_length",
)


def bare(word: str) -> str:
    """Lower-cased, without signs around it."""
    low = word.lower()
    if low.isalnum():
        return low
    a, b = 0, len(low)
    while a < b and not low[a].isalnum():
        a += 1
    while b > a and not low[b - 1].isalnum():
        b -= 1
    return low[a:b]


def is_obfuscated(core: str) -> bool:
    """A bare word of letters with digits or signs between them, other than a hyphen or an apostrophe."""
    return not core.isalpha() and any(c.isalpha() for c in core) and any(not c.isalpha() and c not in "-'’" for c in core)


def plain(word: str) -> str:
    """The letters that an obfuscated word stands for; else the bare word."""
    core = bare(word)
    return "".join(c for c in core.translate(LOOKALIKES) if c.isalpha()) if is_obfuscated(core) else core


def units(word: str) -> list[str]:
    """The word as a whole, and its beginnings."""
    return [word, *(f"{word[:n]}-" for n in STARTS if len(word) > n)] if len(word) >= 3 else []


class WordFacts(dict):
    """The row of each word in a table of facts; forgets all when it holds `most` words."""

    def __init__(self, lexicon: dict[str, float], most: int = 200_000):
        self.lexicon, self.most = lexicon, most
        self.table = np.zeros((1024, 9))

    def __missing__(self, raw: bytes) -> int:
        word = raw.decode(errors="replace")
        core = plain(word)
        weight = max((self.lexicon[u] for u in units(core) if u in self.lexicon), default=0.0)
        letters = len(core) if core.isalpha() and bare(word) == core else sum(c.isalpha() for c in word)
        capitals = 0 if word.islower() else sum(c.isupper() for c in word)
        signs = 0 if word.isalnum() else sum(not c.isalnum() for c in word)
        row = len(self)
        if row == len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        self.table[row] = (
            weight, weight > 0, core in SECOND_PERSON, letters, capitals, letters > 1 and capitals == letters,
            signs, word.count("!") + word.count("?") if signs else 0, is_obfuscated(bare(word)),
        )
        self[raw] = row
        return row

    def features(self, text: bytes) -> list[float]:
        words = text.split()
        n = len(words)
        if not n:
            return [0.0] * len(FEATURES)
        if len(self) > self.most:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, n)
        f = self.table[rows]
        weight, hit, second, letters, capitals, shouted, signs, exclaimed, odd = f.sum(0)
        near = 0
        if hit and second:
            at = np.flatnonzero(f[:, 2])
            for h in np.flatnonzero(f[:, 1]):
                k = np.searchsorted(at, h)
                near += min([abs(int(x) - int(h)) for x in at[max(0, k - 1) : k + 1]]) <= 3
        return [
            hit / n, log(1 + hit), log(1 + len(np.unique(rows[f[:, 1] > 0]))) if hit else 0.0, weight / n, f[:, 0].max(), second / n, float(near),
            capitals / max(letters, 1), shouted / n, signs / n, exclaimed / n, odd / n, log(1 + n), letters / n,
        ]


@dataclass
class Model:
    """What learning found. trees is None where the labels hold one class only; then every score is `base`."""

    lexicon: dict[str, float]
    trees: object
    isotonic: object
    base: float


def _labelled(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(doc_id, text, toxic, half, calibrate) of about `rows` rows at most, none held out."""
    marks = pick(labels, doc_id=id_col, toxic=label_col).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~is_held_out())
    marks = marks.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = marks.count()
    spread = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30))
    part = F.lit(True) if n <= rows else spread < int(rows / n * (1 << 30))
    texts = pick(docs, doc_id=id_col, text=text_col).where("doc_id IS NOT NULL").where(~is_held_out()).where(part)
    deal = F.pmod(F.xxhash64("doc_id", F.lit("deal")), F.lit(8))
    met = texts.join(marks.where(part), "doc_id")
    return met.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic", (deal % 2).cast("int").alias("half"), (deal >= 6).alias("calibrate"))


def _unit_counts(train: DataFrame) -> DataFrame:
    """(unit, half, toxic, n): texts of each half and class that hold a unit, for units of enough toxic texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text, half, toxic in zip(raw_texts(batch, "text"), batch.column("half").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = {plain(w.decode(errors="replace")) for w in set(text.split())}
                counts.update((u, half, toxic) for u in {u for w in words for u in units(w)})
        keys = list(counts)
        yield pa.RecordBatch.from_pydict({
            "unit": pa.array([k[0] for k in keys], pa.string()), "half": pa.array([k[1] for k in keys], pa.int32()),
            "toxic": pa.array([k[2] for k in keys], pa.int32()), "n": pa.array([counts[k] for k in keys], pa.int64()),
        })

    parts = train.select("text", "half", "toxic").mapInArrow(work, "unit string, half int, toxic int, n long")
    case = lambda half, toxic: F.coalesce(F.sum(F.when((F.col("half") == half) & (F.col("toxic") == toxic), F.col("n"))), F.lit(0)).alias(f"n{half}{toxic}")
    table = parts.groupBy("unit").agg(*[case(h, t) for h in (0, 1) for t in (0, 1)])
    ratio = (F.col("n01") + F.col("n11") + 0.5) / (F.col("n00") + F.col("n10") + 0.5)
    return table.where(F.col("n01") + F.col("n11") >= LEAST_TOXIC).orderBy(F.desc(ratio), F.desc(F.col("n01") + F.col("n11")), "unit").limit(LEXICON_UNITS)


def _lexicon(rows: list, size: dict[tuple[int, int], int], halves: tuple[int, ...]) -> dict[str, float]:
    """Log odds of the units that are far oftener in the toxic texts of the named halves."""
    out = {}
    toxic, other = (sum(size.get((h, t), 0) for h in halves) for t in (1, 0))
    for r in rows:
        a, b = (sum(r[f"n{h}{t}"] for h in halves) for t in (1, 0))
        odds = log((a + 0.5) / (toxic + 1)) - log((b + 0.5) / (other + 1))
        if a >= LEAST_TOXIC * len(halves) / 2 and odds >= LEAST_LOG_ODDS:
            out[r["unit"]] = odds
    return out


def _with_features(rows: DataFrame, lexicons: list[dict[str, float]], keep: list[str]) -> DataFrame:
    """keep and features. Rows use the lexicon at their `half`, or the only one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = [WordFacts(x) for x in lexicons]
        for batch in batches:
            for part in slices(batch, "text"):
                which = part.column("half").to_pylist() if len(lexicons) > 1 else [0] * part.num_rows
                found = [facts[k].features(t) for k, t in zip(which, raw_texts(part, "text"), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found, pa.list_(pa.float64()))], [*keep, "features"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(work, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", features array<double>")


def _margin(trees, rows: DataFrame) -> DataFrame:
    """rows with raw, the trees' score before calibration, from 0 to 1."""
    scored = trees.transform(rows.withColumn("x", array_to_vector("features")))
    return scored.withColumn("raw", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction", "features")


def learn(
    docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rounds: int = 20
) -> Model:
    """Learn from labelled rows that are not held out. A row whose label or id is null teaches nothing; a null
    text counts as empty; of several labels of one id the highest counts."""
    train = checkpointed(_labelled(docs, labels, rows, id_col, text_col, label_col))
    size = {(r.half, r.toxic): r["count"] for r in train.groupBy("half", "toxic").count().collect()}
    toxic, all_rows = sum(n for (_, t), n in size.items() if t == 1), sum(size.values())
    base = toxic / all_rows if all_rows else 0.0
    counts = [r.asDict() for r in _unit_counts(train).collect()]
    whole = _lexicon(counts, size, (0, 1))
    crossed = [_lexicon(counts, size, (1,)), _lexicon(counts, size, (0,))]
    grown = checkpointed(_with_features(train, crossed, ["toxic", "half", "calibrate"])).coalesce(8).cache()
    classes = {(r.calibrate, r.toxic) for r in grown.select("calibrate", "toxic").distinct().collect()}
    if not {(False, 0), (False, 1)} <= classes:
        return Model(whole, None, None, base)
    vectors = grown.withColumn("features", array_to_vector("features")).withColumn("toxic", F.col("toxic").cast("double"))
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=rounds, maxDepth=3, stepSize=0.3, maxBins=32, minInstancesPerNode=5, seed=1)
    model = trees.fit(vectors.where(~F.col("calibrate")))
    model.setFeaturesCol("x")
    checks = _margin(model, grown.where("calibrate") if {(True, 0), (True, 1)} <= classes else grown)
    # texts of one leaf share a score; they are one point of their mean and number
    points = checks.groupBy("raw").agg(F.avg("toxic").alias("toxic"), F.count(F.lit(1)).cast("double").alias("n"))
    fitted = IsotonicRegression(labelCol="toxic", featuresCol="raw", weightCol="n").fit(points)
    grown.unpersist()
    return Model(whole, model, fitted, base)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the calibrated probability that each whole text is toxic, 0 to 1.

    Texts of one calibrated step keep the trees' order by a hundredth of their uncalibrated score. A null text
    is scored as empty. Repeated rows are scored each. An empty table gives no rows.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    if model.trees is None:
        return rows.select("doc_id", F.lit(model.base).alias("score"))
    raw = _margin(model.trees, _with_features(rows, [model.lexicon], ["doc_id"]))
    mixed: Column = F.col("prediction") * 0.99 + F.col("raw") * 0.01
    return model.isotonic.transform(raw).select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed)).alias("score"))
