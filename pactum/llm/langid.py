"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.words import returning_memory, slices, utf8

#: Families of closely related languages by their ISO 639-1 codes; any other code is a family of its own.
FAMILIES = {
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd", "gv", "kw"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "indic": ("as", "bn", "gu", "hi", "mr", "ne", "or", "pa", "sd", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "malayic": ("id", "jv", "ms", "su"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro", "sc"),
    "semitic": ("am", "ar", "he", "mt", "ti"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "turkic": ("az", "ba", "kk", "ky", "tk", "tr", "tt", "ug", "uz"),
    "uralic": ("et", "fi", "hu", "se"),
}
BITS = 12
#: ASCII bytes other than letters count as a space.
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
#: Bytes whose features are summed in one step.
PIECE = 65_536
#: Texts of more bytes are predicted whole but not learned from.
MAX_TRAINING_BYTES = 200_000
#: What all languages together may bring to the driver, about: rows and bytes.
MAX_SAMPLE_ROWS, MAX_SAMPLE_BYTES = 8_000, 48_000_000


def _grams(data: np.ndarray) -> np.ndarray:
    """The hashed feature of the three bytes that start at each position."""
    c = _CLASS[data]
    code = c[:-2] | (c[1:-1] << np.uint32(8)) | (c[2:] << np.uint32(16))
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _prepared(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, has a letter) of the lower-cased texts, each between two spaces."""
    text = column.cast(pa.large_string()).fill_null("")
    letter = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
    padded = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.utf8_lower(text), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    return *utf8(padded), letter


def _svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 12) -> tuple[np.ndarray, float, float, float]:
    """(w, bias, slope, shift): a linear SVM by dual coordinate descent, and a logistic fit of its margins."""
    rng = np.random.default_rng(11)
    n = len(y)
    w, bias, alpha = np.zeros(x.shape[1], dtype=np.float32), 0.0, np.zeros(n)
    norm = np.einsum("ij,ij->i", x, x) + 1
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum()))) * c
    for _ in range(epochs):
        for i in rng.permutation(n):
            new = min(max(alpha[i] - (y[i] * (float(x[i] @ w) + bias) - 1) / norm[i], 0.0), weight[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += np.float32(step) * x[i]
                bias += step
                alpha[i] = new
    margin = x @ w + bias
    slope, shift = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        gap = p - np.where(y > 0, 0.98, 0.02)
        slope = max(0.05, slope - 0.5 * float((gap * margin).mean()))
        shift -= 0.5 * float(gap.mean())
    return w, bias, slope, shift


class Model:
    """Families and languages with the linear functions that separate them, over one feature scale."""

    def __init__(self, langs: list[str], family_of: dict[str, str], counts: np.ndarray, labels: np.ndarray) -> None:
        self.langs, self.family_of = langs, family_of
        self.families = sorted({family_of[x] for x in langs})
        counts /= np.maximum(counts.sum(axis=1, keepdims=True), 1)
        scale = (1 / np.sqrt(counts.mean(axis=0) + 1e-5)).astype(np.float32)
        counts *= scale
        x = counts
        fams = np.array([self.families.index(family_of[langs[i]]) for i in labels])
        self.tasks: list[tuple] = []
        fits = []
        if len(self.families) > 1:
            # Two families need one function, more need one each against the rest.
            for f in range(1 if len(self.families) == 2 else len(self.families)):
                fits.append(_svm(x, np.where(fams == f, 1.0, -1.0)))
                self.tasks.append(("family", f))
        for f, name in enumerate(self.families):
            inside = [i for i, lang in enumerate(langs) if family_of[lang] == name]
            for a, b in combinations(inside, 2):
                own = (labels == a) | (labels == b)
                fits.append(_svm(x[own], np.where(labels[own] == a, 1.0, -1.0)))
                self.tasks.append(("pair", f, a, b))
        self.weights = np.stack([w * scale for w, *_ in fits], axis=1).astype(np.float32) if fits else np.zeros((1 << BITS, 0), np.float32)
        self.bias, self.slope, self.shift = (np.array([fit[k] for fit in fits]) for k in (1, 2, 3))

    def _sums(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of each row, the weights of the features that begin from ``start`` up to ``stop``, summed a piece of the data at a time."""
        total = np.zeros((len(start), self.weights.shape[1]))
        if not self.tasks:
            return total
        for a in range(0, len(data) - 2, PIECE):
            b = min(a + PIECE, len(data) - 2)
            gain = np.zeros((b - a + 1, total.shape[1]))
            np.cumsum(self.weights[_grams(data[a : b + 2])], axis=0, dtype=np.float64, out=gain[1:])
            # Rows follow one another, so those that reach into the piece do too.
            own = slice(np.searchsorted(stop, a, "right"), np.searchsorted(start, b, "left"))
            total[own] += gain[np.clip(stop[own], a, b) - a] - gain[np.clip(start[own], a, b) - a]
        return total

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language numbers, scores from 0 to 1) of the rows."""
        rows = len(offsets) - 1
        stop = np.maximum(offsets[1:] - 2, offsets[:-1])
        total = self._sums(data, offsets[:-1], stop)
        margin = total / np.maximum(stop - offsets[:-1], 1)[:, None] + self.bias
        chance = 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))
        family = np.ones((rows, len(self.families)))
        within = np.ones((rows, len(self.langs)))
        rivals = np.zeros(len(self.langs))
        points = np.zeros((rows, len(self.langs)))
        for k, task in enumerate(self.tasks):
            if task[0] == "family":
                family[:, task[1]] = chance[:, k]
                if len(self.families) == 2:
                    family[:, 1] = 1 - chance[:, k]
            else:
                points[:, task[2]] += chance[:, k]
                points[:, task[3]] += 1 - chance[:, k]
                rivals[[task[2], task[3]]] += 1
        family /= np.maximum(family.sum(axis=1, keepdims=True), 1e-12)
        best_family = family.argmax(axis=1)
        many = rivals > 0
        within[:, many] = points[:, many] / rivals[many]
        own = np.array([self.families.index(self.family_of[x]) for x in self.langs])
        best = np.where(own[None, :] == best_family[:, None], within, -1).argmax(axis=1)
        at = np.arange(rows)
        return best, family[at, best_family] * within[at, best]


def train(docs: DataFrame, per_language: int = 600, families: dict[str, tuple[str, ...]] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from a sample of about ``per_language`` labelled rows of each language, drawn by a hash of the id.

    Rows with a null text or language, and texts over MAX_TRAINING_BYTES, are not learned from.  The
    sample is all that comes to the driver: of many languages, or of long texts, fewer rows of each are
    drawn, so that it has about MAX_SAMPLE_ROWS rows and MAX_SAMPLE_BYTES bytes at most.  None if there is
    none.  Rows that repeat an id are drawn alike; other columns play no part.
    """
    family_of = {lang: name for name, group in (families or FAMILIES).items() for lang in group}
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.octet_length(text_col) <= MAX_TRAINING_BYTES))
    draw = F.pmod(F.xxhash64(F.lit("langid"), id_col), F.lit(1 << 30))
    counts = {r[0]: (r[1], r[2]) for r in rows.groupBy(lang_col).agg(F.count("*"), F.sum(F.octet_length(text_col))).collect()}
    if not counts:
        return None
    keep = None
    for lang, (n, held) in counts.items():
        share = min(min(per_language, MAX_SAMPLE_ROWS / len(counts)) / n, MAX_SAMPLE_BYTES / len(counts) / max(held, 1), 1.0)
        one = (F.col(lang_col) == lang) & (draw < int((1 << 30) * share))
        keep = one if keep is None else keep | one
    small = rows.where(keep)
    sample = small.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("id")).orderBy("lang", "id").toArrow()
    langs = sorted(set(sample["lang"].to_pylist()))
    if not langs:
        return None
    data, offsets, _ = _prepared(sample["text"].combine_chunks())
    features = np.zeros((sample.num_rows, 1 << BITS), dtype=np.float32)
    for i in range(sample.num_rows):
        features[i] = np.bincount(_grams(data[offsets[i] : offsets[i + 1]]), minlength=1 << BITS) if offsets[i + 1] - offsets[i] > 2 else 0
    labels = np.array([langs.index(x) for x in sample["lang"].to_pylist()])
    return Model(langs, {x: family_of.get(x, x) for x in langs}, features, labels)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ``keep`` columns, lang_pred, score) of every row's whole text.

    ``und`` with score 0 if the text is null, empty or has no letter, and for every row if nothing could
    be learned, and an empty table gives an empty result.  Only the text is looked at, the whole of it,
    however long it is: its features are summed in pieces of PIECE bytes.  Repeated rows are predicted alike; of equal chances the
    family, and the language in it, that comes first in code point order wins.  Columns that are not named play
    no part, whatever they are called.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            _, raw_at = utf8(column)
            for start, stop in slices(raw_at):
                part = column.slice(start, stop - start)
                data, offsets, letter = _prepared(part)
                if own is None:
                    names, score = np.full(stop - start, "und", dtype=object), np.zeros(stop - start)
                else:
                    best, score = own.predict(data, offsets)
                    names = np.where(letter, np.array(own.langs, dtype=object)[best], "und")
                    score = np.where(letter, score, 0.0)
                cols = [batch.column(i).slice(start, stop - start) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    first = docs.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first.schema.fields[:-1])
    return first.mapInArrow(returning_memory(predict), f"{kinds}, lang_pred string, score double")
