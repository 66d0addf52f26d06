"""Language identification in two steps: the family first, then linear SVMs between each two languages of it.

A text is lower-cased; runs of other characters than letters become one space; its UTF-8 bytes give counts of hashed
2-, 3- and 4-grams, whose square roots, scaled to length one, are the features. One-versus-one linear SVMs
(squared hinge loss) separate the families, and others the languages of one family; pairs vote.
"""

from __future__ import annotations

import math
import re
from itertools import combinations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_rows, small_batches

#: Features; the most training documents a language (a bounded, hash-ordered sample of the labelled rows).
FEATURES, SAMPLE = 1 << 13, 500
UNDETERMINED = "und"
#: Pieces of a text of which half at least must be certain where the whole isn't, and the least words of a piece.
PIECES, PIECE_WORDS = 8, 20
#: ISO 639-1 codes by family; a code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ca es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "as bn gu hi kn ml mr ne or pa si ta te ur",
    "semitic": "am ar he mt",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt ug uz",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "east asian": "ja ko zh",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_OTHERS = re.compile(r"[\W\d_]+")
#: The former leaves numerals that aren't letters, as in fractions.
_NO_LETTERS = regex.compile(r"[^\p{L}]+")


def family(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].lower(), lang)


def features(text: str | None) -> np.ndarray | None:
    """The feature vector; None for a text without a letter."""
    line = _OTHERS.sub(" ", (text or "").lower())
    line = (line if line.isascii() else _NO_LETTERS.sub(" ", line)).strip()
    if not line:
        return None
    b = np.frombuffer(f" {line} ".encode(), np.uint8).astype(np.uint32)
    two = b[:-1] << 8 | b[1:]
    grams = [two, two[:-1] << 8 | b[2:]]
    if len(b) > 3:
        grams.append(two[:-2] << 16 | two[2:])
    # the factor spreads the bytes over the upper bits; the added number keeps the orders apart
    at = np.concatenate([((g + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761)) >> np.uint32(32 - 13) for k, g in enumerate(grams)])
    x = np.sqrt(np.bincount(at, minlength=FEATURES).astype(np.float32))
    return x / np.linalg.norm(x)


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 20.0, steps: int = 80) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2/2 + cost * mean(max(0, 1 - y(xw+b))^2), classes weighted alike, by accelerated gradient steps."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, v, b, vb = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.0, 0.0
    rate = 1.0 / (1.0 + 4.0 * cost)
    for k in range(steps):
        pull = cost * 2 * share * y * np.maximum(0, 1 - y * (x @ v + vb))
        new, newb = v + rate * (pull @ x - v), vb + rate * float(pull.sum())
        m = k / (k + 3)
        v, vb = new + m * (new - w), newb + m * (newb - b)
        w, b = new, newb
    return w, b


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The model of rows (text, lang) with neither null; of each language, about `sample` distinct texts are used, dealt by a hash.

    The counts of languages cover the distinct texts of all rows, as 64-bit hashes. The sample is gathered on the driver.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = rows.select("lang", F.xxhash64("text").alias("h")).distinct()
    counts = {r.lang: r["count"] for r in hashed.groupBy("lang").count().collect()}
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))) for lang, n in sorted(counts.items())], F.lit(0.0)) if counts else F.lit(0.0)
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < share * 1_000_003)
    chosen = drawn.select("lang", "text").dropDuplicates().limit(2 * sample * max(1, len(counts)))
    found = [(r.lang, features(r.text)) for r in chosen.toLocalIterator()]
    langs = sorted({lang for lang, _ in found})
    x, y = np.array([v for _, v in found], np.float32), np.array([lang for lang, _ in found], object)
    families = sorted({family(lang) for lang in langs})
    of = np.array([family(lang) for lang in y], object)

    def pairs(names, kind):
        return {(a, b): train_svm(x[use := (kind == a) | (kind == b)], np.where(kind[use] == a, 1, -1).astype(np.float32)) for a, b in combinations(names, 2)}

    inner = {f: pairs([lang for lang in langs if family(lang) == f], y) for f in families}
    return {"langs": {f: [lang for lang in langs if family(lang) == f] for f in families}, "families": pairs(families, of), "inner": inner}


def _vote(names: list[str], svms: dict, x: np.ndarray) -> tuple[str, float]:
    """The name with the most won pairs (ties: larger margins) and the least certainty of its pairs."""
    won: dict[str, list[float]] = {n: [] for n in names}
    for (a, b), (w, bias) in svms.items():
        m = float(x @ w) + bias
        won[a].append(m)
        won[b].append(-m)
    best = max(names, key=lambda n: (sum(m > 0 for m in won[n]), sum(won[n]), n))
    return best, min((1 / (1 + math.exp(-min(50.0, max(-50.0, 4 * m)))) for m in won[best]), default=1.0)


def _steps(model: dict, text: str | None) -> tuple[str, float, float]:
    """The language and the certainties of its family and of itself within it."""
    x = features(text)
    if x is None or not model["langs"]:
        return UNDETERMINED, 0.0, 0.0
    of, p = _vote(list(model["langs"]), model["families"], x)
    lang, q = _vote(model["langs"][of], model["inner"][of], x)
    return lang, p, q


def predict_one(model: dict, text: str | None) -> tuple[str, float]:
    lang, p, q = _steps(model, text)
    return lang, p * q


def predict(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1, the certainty) of each row of (doc_id, text), whole texts.

    Null texts and those without a letter are `und` with score 0, as is all without any training row. Repeated rows and
    ids are predicted alike. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # pairs of languages x FEATURES

    def make():
        own = sent.value
        return lambda doc_id, text: (doc_id, *predict_one(own, text))

    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    """Those whose id's crc32 isn't a multiple of 5."""
    return docs.where(~held_out("doc_id", 5, 0))


def certain(model: dict, text: str | None, least: float) -> bool:
    """Whether both steps are as certain of the text, or, as a text may have several languages one after the other, of half of its pieces."""
    lang, p, q = _steps(model, text)
    if lang == UNDETERMINED or min(p, q) >= least:
        return lang != UNDETERMINED
    words = text.split()
    size = max(PIECE_WORDS, -(-len(words) // PIECES))
    if len(words) < 2 * size:
        return False
    found = [_steps(model, " ".join(words[k : k + size])) for k in range(0, len(words) - size // 2, size)]
    return 2 * sum(lang != UNDETERMINED and min(p, q) >= least for lang, p, q in found) >= len(found)


def accepted(docs: DataFrame, model: dict, least: float = 0.0) -> DataFrame:
    """`docs`, all columns, without rows whose language is undetermined or of which a step's certainty is below `least` (see `certain`).

    A winner of all its pairs has 0.5 at least in both steps; texts of no learnt language are a little above that.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [certain(sent.value, t, least) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield batch.filter(pa.array(found, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
