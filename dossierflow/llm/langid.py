"""Language identification: the family first, then the language within it.

Texts become hashed counts of one- to three-byte sequences over letters. A
linear support vector machine for each pair of families chooses the family;
within it, one for each pair of languages votes. All machines are fitted on the
driver on a bounded sample of labelled rows: at most ``PER_LANGUAGE`` of each
language and ``SAMPLE_ROWS`` in all, which the languages share evenly.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh

DIMS = 1 << 12
PER_LANGUAGE = 300
SAMPLE_ROWS = 19_200
UNKNOWN = "und"
#: Language families by ISO 639-1 code; other codes are a family of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "finnic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk uz",
    "semitic": "ar he mt am",
    "indic": "hi bn mr ur pa gu ne",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_PLAIN = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: str | None) -> np.ndarray | None:
    """Square roots of hashed counts, of length one; None for a null text or one without letters."""
    if not text or not any(map(str.isalpha, text)):
        return None
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split()) + b" "
    counts = np.zeros(DIMS)
    for at in range(0, len(raw), 1 << 20):
        b = np.frombuffer(raw[at : at + (1 << 20) + 2], dtype=np.uint8).astype(np.uint32)
        one, two = b[: 1 << 20], b[:-1][: 1 << 20] * np.uint32(263) + b[1:][: 1 << 20]
        three = b[:-2][: 1 << 20] * np.uint32(65599) + b[1:-1][: 1 << 20] * np.uint32(263) + b[2:][: 1 << 20]
        for n, h in enumerate((one, two, three)):
            h = ((h + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761)) >> np.uint32(32 - 12)
            counts += np.bincount(h, minlength=DIMS)
    root = np.sqrt(counts)
    return (root / np.linalg.norm(root)).astype(np.float32)


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 300, c: float = 200.0) -> tuple[np.ndarray, float]:
    """Squared-hinge linear support vector machine; ``y`` is 1 or -1. Accelerated gradient steps, classes weighed alike."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * c
    w, y, weight = np.zeros(x.shape[1] + 1, dtype=x.dtype), y.astype(x.dtype), weight.astype(x.dtype)  # the bias comes last
    look, t, rate = w.copy(), 1.0, x.dtype.type(1.0 / (1.0 + 4.0 * weight.sum()))
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ look[:-1] + look[-1]))
        pull = weight * slack * y
        new = look - rate * (look - 2 * np.append(x.T @ pull, pull.sum()))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + x.dtype.type((t - 1) / t2) * (new - w), new, t2
    return w[:-1].astype(np.float32), float(w[-1])


@dataclass
class Machines:
    """One machine for each pair of ``labels``; the label with most votes wins, ties by margin, then by name."""

    labels: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS), dtype=np.float32))
    biases: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def fit(cls, x: np.ndarray, names: np.ndarray) -> Machines:
        labels = sorted(set(names.tolist()))
        made = []
        for a, b in itertools.combinations(labels, 2):
            own = (names == a) | (names == b)
            made.append(_svm(x[own], np.where(names[own] == a, 1.0, -1.0)))
        return cls(labels, np.array([w for w, _ in made], dtype=np.float32).reshape(-1, DIMS), np.array([b for _, b in made]))

    def choose(self, x: np.ndarray) -> tuple[str, float]:
        """The label and the logistic score of its least clear victory."""
        if len(self.labels) == 1:
            return self.labels[0], 1.0
        margins = self.weights @ x + self.biases
        votes, sums = dict.fromkeys(self.labels, 0), dict.fromkeys(self.labels, 0.0)
        pairs = list(itertools.combinations(self.labels, 2))
        for (a, b), m in zip(pairs, margins.tolist(), strict=True):
            votes[a if m >= 0 else b] += 1
            sums[a], sums[b] = sums[a] + m, sums[b] - m
        best = max(self.labels, key=lambda n: (votes[n], sums[n]))
        least = min(m if a == best else -m for (a, b), m in zip(pairs, margins.tolist(), strict=True) if best in (a, b))
        return best, float(1 / (1 + np.exp(-np.clip(4 * least, -30, 30))))


@dataclass
class LanguageModel:
    families: Machines | None
    languages: dict[str, Machines]

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text)
        if x is None or self.families is None:
            return UNKNOWN, 0.0
        family, sure = self.families.choose(x)
        language, within = self.languages[family].choose(x)
        return language, sure * within


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on rows with a language that are not held out, at most ``per_language`` of each and ``sample_rows`` in all.

    The sample is drawn by a hash of the id. Every language has the same
    share of it, at least a row, so none is left out; more than
    ``sample_rows`` languages are an error. Texts without letters teach
    nothing; without any labelled rows every text is ``und``. Rows with a null
    id are not learnt from, as they cannot be told from held-out ones.
    """
    base = docs.select(col(id_col).cast("string").alias("id"), col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang"), held_out(id_col).alias("held"))
    known = base.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~F.col("held"))
    sizes = known.groupBy("lang").count().limit(sample_rows + 1).collect()  # a row for each language
    if not sizes:
        return LanguageModel(None, {})
    if len(sizes) > sample_rows:
        raise ValueError(f"more than {sample_rows} languages")
    per_language = min(per_language, sample_rows // len(sizes))
    # a hash below the language's share keeps about per_language rows, so the exact cut sorts few of them
    span = 1 << 30
    shares = {r["lang"]: min(span, int(span * (per_language * 1.5 + 20) / r["count"])) for r in sizes}
    share = F.element_at(F.create_map(*[F.lit(v) for pair in shares.items() for v in pair]), F.col("lang"))
    drawn = known.withColumn("h", F.xxhash64("id").bitwiseAND(F.lit(span - 1))).where(F.coalesce(F.col("h") < share, F.lit(False)))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(lang, h, i, *_packed(x)) for lang, h, i, t in zip(batch["lang"], batch["h"], batch["id"], batch["text"], strict=True) if (x := features(t)) is not None]
            yield pd.DataFrame(rows, columns=["lang", "h", "id", "at", "x"])

    found = drawn.select("lang", "h", "id", "text").mapInPandas(vectors, "lang string, h long, id string, at binary, x binary")
    order = Window.partitionBy("lang").orderBy("h", "id", "at", "x")
    sample = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("lang", "h", "at", "x").collect()  # at most sample_rows vectors, without their zeros
    if not sample:
        return LanguageModel(None, {})
    sample.sort(key=lambda r: (r["lang"], r["h"], bytes(r["at"]), bytes(r["x"])))
    x = np.zeros((len(sample), DIMS), dtype=np.float32)
    for row, r in zip(x, sample, strict=True):
        row[np.frombuffer(r["at"], dtype=np.uint16)] = np.frombuffer(r["x"], dtype=np.float32)
    lang = np.array([r["lang"] for r in sample], dtype=object)
    del sample
    family = np.array([FAMILY_OF.get(n.split("-")[0].lower(), n) for n in lang], dtype=object)
    return LanguageModel(Machines.fit(x, family), {f: Machines.fit(x[family == f], lang[family == f]) for f in sorted(set(family.tolist()))})


def _packed(x: np.ndarray) -> tuple[bytes, bytes]:
    at = np.flatnonzero(x)
    return at.astype(np.uint16).tobytes(), x[at].tobytes()


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``' id (and columns in ``keep``) with ``lang_pred`` and ``score``, over whole texts.

    ``und`` with score 0 for null texts and texts without letters. Repeated
    rows and ids have a row each; an empty table gives an empty result. Kept
    columns of these names would clash and are an error.
    """
    keep = [c for c in (keep or []) if c not in (id_col, text_col)]
    if clash := {"lang_pred", "score"} & {c.lower() for c in (id_col, *keep)}:
        raise ValueError(f"columns clash: {sorted(clash)}")
    said = _said(docs.select(id_col, text_col, *keep), model, text_col, "lang_pred", "score")
    return said.select(id_col, text_col, *keep, "lang_pred", "score")


def _said(docs: DataFrame, model: LanguageModel, text_col: str, name: str, score: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size for given languages

    @F.pandas_udf("struct<lang string, score double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        return pd.DataFrame([own.predict(t) for t in texts], columns=["lang", "score"])

    said = fresh("said", docs)
    out = docs.withColumn(said, predict(col(text_col).cast("string")))
    return out.withColumns({name: F.col(f"{said}.lang"), score: F.col(f"{said}.score")}).drop(said)


def drop_unidentified(docs: DataFrame, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows in no language: ``und``, or a score below ``least``; all columns stay, repeated rows each for itself."""
    lang, score = fresh("lang_pred", docs), fresh("score", docs)
    said = _said(docs, fit(docs, id_col, text_col, lang_col), text_col, lang, score)
    return said.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*[col(c) for c in docs.columns])
