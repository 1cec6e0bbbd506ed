"""Language identification with error-correcting output codes.

Every language has a codeword; for each of its bits a binary classifier over character n-grams tells the languages
with a one from those with a zero. A text is given the language whose codeword has the least loss: per bit the
logistic loss of the classifier's margin, weighted by how often that classifier is right for that language on the
training rows. If the two best codewords are closer than `AMBIGUOUS`, the result is flagged.

Features: letters of the lower-case text as bytes (all else is a blank), runs of two to four of them, hashed to 2^15
buckets per length. A bit's classifier is the log ratio of the n-grams' mean frequency in the languages on
either side, so a frequent language has no more say than a rare one.

Training rows are those with text, a label and a remainder of crc32(key) that is not held out: their different texts, at most about
`TRAIN_ROWS` per language, chosen by a hash of the text. Equal texts are one row, so repeated rows or keys neither break the bound nor
push a language out. At most `MAX_LANGUAGES` labels are learned, the most frequent ones by different texts; others are never
predicted. Both bounds are parameters. The counts are made by Spark, and buckets x languages numbers reach the driver, under 400 MB at
the bound. Prediction covers every row and the whole text.

Rules: a null text or one without a letter is `und` with score 0; so is every text if there is nothing to learn from; with
one language learned, every other text has it with score 1; a null key is held out; of equal losses the first
language in alphabetical order wins; repeated rows are predicted each; other columns are ignored; an empty table gives an
empty result; keys may be of any type.

As a filter (`keep_identified`) the decoding decides only what is written where a label is null; whether a row stays is decided by its
letters alone.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.tables import stored

LENGTHS, BUCKET_BITS = (2, 3, 4), 15
BUCKETS = len(LENGTHS) << BUCKET_BITS
TRAIN_ROWS, SMOOTHING, SHARPNESS, AMBIGUOUS = 10_000, 0.5, 4.0, 0.5
MAX_LANGUAGES = 500
UNKNOWN = "und"
_SLICE = 1 << 16
_LETTER = re.compile(r"[^\W\d_]")
_KEEP = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def grams(text: str):
    """Bucket numbers of the n-grams of a whole text, in slices of bounded size."""
    data = _KEEP[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    for at in range(0, len(data), _SLICE):
        x = data[at:at + _SLICE + max(LENGTHS) - 1].astype(np.uint32)
        out, code = [], x
        for i, n in enumerate(range(2, max(LENGTHS) + 1)):
            if len(x) < n:
                break
            code = (code[:-1] << np.uint32(8)) | x[n - 1:]
            own = min(len(code), _SLICE)
            if n in LENGTHS:
                h = code[:own] * np.uint32(0x9E3779B1)
                out.append((h >> np.uint32(32 - BUCKET_BITS)) + np.uint32(i << BUCKET_BITS))
        if out:
            yield np.concatenate(out)


def has_letter(text) -> bool:
    """Whether there is a character of a letter category."""
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 per language: all ways to part them for up to five, else the best of seeded random codes."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        parts = range(1, 2**(n - 1))
        return np.array([[1 if c >> i & 1 else -1 for c in parts] for i in range(n)], np.int8)
    draw, best, apart = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = draw.choice(np.array([-1, 1], np.int8), (n, int(np.ceil(10 * np.log2(n)))))
        d = (code[:, None] != code[None]).sum(2) + 10**6 * np.eye(n, dtype=int)
        if d.min() > apart and (np.abs(code.sum(0)) < n).all():
            best, apart = code, d.min()
    return best


@dataclass
class Model:
    languages: list
    code: np.ndarray      # languages x bits
    weights: np.ndarray   # buckets x bits
    trust: np.ndarray     # languages x bits, rows add up to the number of bits

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1]), 0
        for g in grams(text):
            total += self.weights[g].sum(0, dtype=np.float64)
            n += len(g)
        return total / max(n, 1)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        return (self.trust * np.logaddexp(0, -SHARPNESS * self.code * margins)).sum(1)

    def predict(self, text):
        """language, score, ambiguous."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, False
        loss = self.losses(self.margins(text))
        best = int(loss.argmin())
        p = np.exp(loss[best] - loss)
        rest = np.delete(loss, best)
        return self.languages[best], float(1 / p.sum()), bool(len(rest) and rest.min() - loss[best] < AMBIGUOUS)


def _count(batches):
    counts = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for g in grams(text.as_py()):
                own += np.bincount(g, minlength=BUCKETS)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])],
                                         names=["lang", "gram", "n"])


def _hits(model):
    """Rows on which each bit's classifier is right, per language."""
    def run(batches):
        m, right = model.value, {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                own = right.setdefault(lang, np.zeros(m.code.shape[1] + 1))
                own[:-1] += m.margins(text.as_py()) * m.code[m.languages.index(lang)] > 0
                own[-1] += 1
        for lang, own in right.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(range(len(own)), pa.int32()), pa.array(own)],
                                             names=["lang", "bit", "n"])
    return run


def _held_out(key):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, key="doc_id", text="text", lang="lang", rows_per_language=TRAIN_ROWS, max_languages=MAX_LANGUAGES) -> Model:
    spark = docs.sparkSession
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~_held_out(key))
    labelled = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"),
                               F.xxhash64(F.col(text).cast("string")).alias("h"))
    sizes = labelled.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["lang"]: r["n"] for r in sizes.orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    if not sizes:
        return Model([], codewords(0), np.zeros((BUCKETS, 0), np.float32), np.ones((0, 0)))
    share = spark.createDataFrame([(k, int(min(1.0, rows_per_language / n) * (1 << 30))) for k, n in sizes.items()], "lang string, share long")
    chosen = labelled.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share"))
    sample = stored(chosen.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text"), "labelled")
    found = sample.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    freq = np.full((len(languages), BUCKETS), SMOOTHING)
    freq[found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), found["gram"].to_numpy(int)] += found["n"].to_numpy()
    freq /= freq.sum(1, keepdims=True)
    code = codewords(len(languages))
    weights = np.stack([np.log(freq[c > 0].mean(0)) - np.log(freq[c < 0].mean(0)) for c in code.T], 1).astype(np.float32) \
        if code.shape[1] else np.zeros((BUCKETS, 0), np.float32)
    model = Model(languages, code, weights, np.ones(code.shape))
    if code.shape[1]:
        sent = spark.sparkContext.broadcast(model)
        right = np.zeros((len(languages), code.shape[1] + 1))
        for r in sample.mapInArrow(_hits(sent), "lang string, bit int, n double").groupBy("lang", "bit").agg(F.sum("n").alias("n")).collect():
            right[languages.index(r["lang"]), r["bit"]] = r["n"]
        trust = (right[:, :-1] + 1) / (right[:, -1:] + 2)
        model.trust = trust / trust.mean(1, keepdims=True)
    return model


def _predict(model):
    def run(batches):
        m = model.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column("text")]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"),
                 *(pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_())))],
                names=[*(c for c in batch.schema.names if c != "text"), "lang_pred", "score", "ambiguous"])
    return run


def identify(docs: DataFrame, model: Model, key="doc_id", text="text") -> DataFrame:
    """`key`, held_out, lang_pred, score (0 to 1), ambiguous of every row; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("key"), _held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(_predict(sent), f"key {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("key", key)


def _keep(model, text, lang):
    def run(batches):
        m = model.value
        for batch in batches:
            texts = [t.as_py() for t in batch.column(text).cast(pa.string())]
            found = [m.predict(t) for t in texts]
            # where nothing could be learned, only texts without a letter are known to be in no language
            kept = [g != UNKNOWN or not m.languages and has_letter(t) for (g, _, _), t in zip(found, texts)]
            if lang:
                at, old = batch.schema.get_field_index(lang), batch.column(lang)
                new = pa.array([None if g == UNKNOWN or unsure else g for g, _, unsure in found], pa.string()).cast(old.type)
                batch = batch.set_column(at, batch.schema.field(at), pc.coalesce(old, new))
            yield batch.filter(pa.array(kept, pa.bool_()))
    return run


def keep_identified(docs: DataFrame, model: Model, text="text", lang=None) -> DataFrame:
    """`docs` without the rows that are in no language: those without text or without a letter. `lang` names a column whose
    nulls are filled with the prediction, unless that is ambiguous."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(sent, text, lang), docs.schema)
