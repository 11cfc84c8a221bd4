"""Quality rules: distribution divergence from language references, besides a few counted rules.

A document has two histograms: shares of its characters by class, and shares of its words among the common words of a
language (all others in one bin). References are learned from the whole corpus: per language the mean of its documents'
histograms, over the ``COMMON`` words of at most ``SHORT`` letters that most documents hold. Means are sums of integers, so
they do not depend on how rows are dealt. The distance is Jensen-Shannon (square root of the divergence, base 2, 0 to 1).
A document is compared with the reference of its language; with the nearest one if it has none. A text of fewer than
``LEAST_CHARACTERS`` bytes is too rough to judge and never rejected for a distance; the word distance needs ``LEAST_JUDGED`` words.

Both distances are judged together: their sum may lie ``SPREADS`` times the way from the tenth percentile to the median above
the median, among the different sums of texts of the same reference and the same power of two of words (short texts are
farther from any reference). Only the lower half sets the bound, so up to about a third of junk hardly moves it. Groups of fewer than
``LEAST_GROUP`` different sums have the fixed bound ``MOST_DISTANCE`` from ``LEAST_WORDS`` words on. No distance may exceed its own maximum.

Every language tag of the corpus has a reference, a row of ``COMMON`` words and some classes.

Nulls and odd input: a null text has no words and fails the base rule; null languages count towards no reference but a
pooled one of all documents; repeated rows are judged each; an empty table gives no rows. Other columns stay, those named
like a result column are replaced.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraygraph.llm.tables import query, read, set_aside, with_arrow
from fraygraph.llm.words import alphanumeric_words, window_hashes, word_hashes
from fraygraph.session import store

COMMON = 40
SHORT = 5
LEAST_CHARACTERS = 200
LEAST_WORDS = 60
LEAST_JUDGED = 30
LEAST_GROUP = 30
SPREADS = 3
LEAST_SPREAD = 0.02
BINS = 1000
MOST_DISTANCE = 0.5
MOST_CLASS_DISTANCE = 0.32
MOST_WORD_DISTANCE = 0.45
SCALE = 1 << 30
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
# Classes of bytes: blank, lower case, upper case, digit, sentence mark, symbol, first byte of a longer code point, other.
MARKS = b".,;:!?'\"()-"
CLASSES = np.full(256, 7, np.int64)
for _class, _bytes in enumerate((BLANKS, range(97, 123), range(65, 91), range(48, 58), MARKS)):
    CLASSES[list(_bytes)] = _class
CLASSES[[b for b in range(33, 127) if CLASSES[b] == 7]] = 5
CLASSES[0xC0:] = 6
N_CLASSES = 8
CONTINUATION = slice(0x80, 0xC0)
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double, base_failed boolean, kept boolean"


def class_shares(data: bytes) -> np.ndarray:
    """Shares of the code points of UTF-8 ``data`` by class."""
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    by_byte[CONTINUATION] = 0
    counts = np.bincount(CLASSES, by_byte, N_CLASSES)
    return counts / max(1, counts.sum())


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two share vectors."""
    m = (p + q) / 2
    total = 0.0
    for x in (p, q):
        own = x > 0
        total += float(np.sum(x[own] * np.log2(x[own] / m[own]))) / 2
    return min(1.0, max(0.0, total)) ** 0.5


def reference_sums(documents: DataFrame) -> DataFrame:
    """(lang, key, docs, share): over all documents long enough, summed integer shares of classes and short words.

    ``key`` is 0x00 and the class number, or a word. Rows under the null language are the pooled reference.
    """

    def run(batches):
        for batch in batches:
            docs: dict[tuple, int] = defaultdict(int)
            shares: dict[tuple, int] = defaultdict(int)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = alphanumeric_words(text)
                if len(words) < LEAST_WORDS:
                    continue
                found = [(b"\0%d" % k, s) for k, s in enumerate(class_shares(text.encode()).tolist())]
                found += [(w, n / len(words)) for w, n in Counter(w for w in words if len(w) <= SHORT or (len(w) <= 4 * SHORT and len(w.decode()) <= SHORT)).items()]
                for key, share in found:
                    docs[lang, key] += 1
                    shares[lang, key] += round(share * SCALE)
            keys = list(docs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()),
                    pa.array([docs[k] for k in keys], pa.int64()), pa.array([shares[k] for k in keys], pa.int64()),
                ],
                names=["lang", "key", "docs", "share"],
            )

    parts = documents.select("lang", "text").mapInArrow(run, "lang string, key binary, docs long, share long")
    sums = [F.sum("docs").alias("docs"), F.sum(F.col("share").cast("decimal(38,0)")).alias("share")]
    return parts.groupBy("lang", "key").agg(*sums)


class Reference:
    """Class shares and common-word shares of a language."""

    def __init__(self, classes: np.ndarray, words: list[bytes], shares: list[float]):
        self.classes = classes
        self.words = {w: i for i, w in enumerate(words)}
        self.shares = np.array([*shares, max(0.0, 1 - sum(shares))])
        self.bounds: dict[int, float] = {}

    def distances(self, classes: np.ndarray, words: Counter, n_words: int) -> tuple[float, float]:
        own = np.zeros(len(self.shares))
        for word in self.words.keys() & words.keys():
            own[self.words[word]] = words[word] / n_words
        own[-1] = max(0.0, 1 - own.sum())
        return distance(classes, self.classes), distance(own, self.shares)


def size_class(n_words: int) -> int:
    """The power of two of the words of a text; all texts from 1,024 words on are one class."""
    return min(10, n_words.bit_length() - 1)


def compare(data: bytes, words: list[bytes], lang: str | None, references: dict[str | None, Reference]) -> tuple | None:
    """(language of the reference, class distance, word distance or None) of a text; None if it is not compared."""
    if not references or len(data) < LEAST_CHARACTERS:
        return None
    names = [lang] if lang is not None and lang in references else list(references)
    classes, counts, n = class_shares(data), Counter(words), max(1, len(words))
    found = [(*references[k].distances(classes, counts, n), k) for k in names]
    of_class, of_words, name = min(found, key=lambda f: f[0] + f[1])
    return name, of_class, of_words if len(words) >= LEAST_JUDGED else None


def learn_bounds(documents: DataFrame, references: dict[str | None, Reference]) -> None:
    """Set the bounds of ``references`` by size class, from the different sums of distances of ``documents``."""

    def run(batches):
        for batch in batches:
            rows = set()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = alphanumeric_words(text)
                if len(words) < LEAST_JUDGED:
                    continue
                if found := compare((text or "").encode(), words, lang, references):
                    rows.add((found[0], size_class(len(words)), round((found[1] + found[2]) * SCALE)))
            kinds = (pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, kinds)], names=["lang", "size", "sum"])

    # Copies have equal sums and count once, else the copies of one text would set the bound of all.
    sums = documents.select("text", "lang").mapInArrow(run, "lang string, size int, sum long").distinct()
    bins = sums.groupBy("lang", "size", F.floor(F.col("sum") * BINS / SCALE).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("lang", "size")  # at most 2 * BINS rows
    bins = bins.withColumn("below", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
    at = [F.min(F.when(F.col("below") >= F.col("total") * share, F.col("bin"))).alias(name) for share, name in ((0.1, "low"), (0.5, "middle"))]
    for r in bins.filter(F.col("total") >= LEAST_GROUP).groupBy("lang", "size").agg(*at).collect():
        references[r.lang].bounds[r.size] = (r.middle + 1) / BINS + SPREADS * max(LEAST_SPREAD, (r.middle - r.low) / BINS)


def too_far(of_class: float | None, of_words: float | None, n_words: int, bounds: dict[int, float]) -> bool:
    if (of_class or 0) > MOST_CLASS_DISTANCE or (of_words or 0) > MOST_WORD_DISTANCE:
        return True
    if of_class is None or of_words is None:
        return False
    bound = bounds.get(size_class(n_words), MOST_DISTANCE if n_words >= LEAST_WORDS else None)
    return bound is not None and of_class + of_words > bound


def learn_references(documents: DataFrame) -> dict[str | None, Reference]:
    """References by language and, under None, of all documents; a small table of shares."""
    sums = store(reference_sums(documents)).withColumn("is_class", F.substring("key", 1, 1) == F.lit(b"\0"))
    pooled = sums.groupBy("key", "is_class").agg(F.sum("docs").alias("docs"), F.sum("share").alias("share"))
    pooled = pooled.select(F.lit(None).cast("string").alias("lang"), "key", "is_class", "docs", "share")
    by_lang = sums.filter("lang IS NOT NULL")
    common = Window.partitionBy("lang", "is_class").orderBy(F.desc("docs"), "key")
    ranked = by_lang.unionByName(pooled).withColumn("_n", F.row_number().over(common))
    rows = defaultdict(list)
    for row in ranked.filter(F.col("_n") <= COMMON).collect():  # at most COMMON + N_CLASSES rows a language
        rows[row.lang].append(row)
    found = {}
    for lang, own in rows.items():
        classes = np.zeros(N_CLASSES)
        words, shares = [], []
        total = max(r.docs for r in own if r.is_class)
        for r in sorted(own, key=lambda r: bytes(r.key)):
            share = int(r.share) / SCALE / total
            if r.is_class:
                classes[int(bytes(r.key)[1:])] = share
            else:
                words.append(bytes(r.key))
                shares.append(share)
        found[lang] = Reference(classes / max(classes.sum(), 1e-12), words, shares)
    if found:
        learn_bounds(documents, found)
    return found


def repeated_words(words: np.ndarray, width: int = 5) -> int:
    """Words, given by their hashes, inside windows of ``width`` words that occur twice or more in the text."""
    if len(words) <= width:
        return 0
    windows = window_hashes(words, width)
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[place] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    edges[starts] += 1
    edges[starts + width] -= 1
    return int(np.count_nonzero(np.cumsum(edges)[:-1] > 0))


def judge(documents: DataFrame, references: dict[str | None, Reference]) -> DataFrame:
    """``documents`` (text, lang) plus the counts, the two distances (null if not compared), base_failed and kept."""
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(texts, langs):
        rows = []
        for text, lang in zip(texts, langs):
            data = (text or "").encode()
            words = word_hashes(data)
            lines = [x for x in data.split(b"\n") if x.strip(BLANKS)]
            repeats = repeated_words(words)
            blanks = len(data) - len(data.translate(None, BLANKS))
            symbols = len(data) - len(data.translate(None, SYMBOLS))
            base_failed = len(words) < 10 or 100 * repeats > 20 * len(words)
            normal = alphanumeric_words(text)
            name, of_class, of_words = compare(data, normal, lang, references) or (None, None, None)
            far = of_class is not None and too_far(of_class, of_words, len(normal), references[name].bounds)
            rows.append((
                len(words), len(text or "") - blanks, symbols, len(lines) - len(set(lines)), repeats, of_class, of_words,
                base_failed, not base_failed and not far,
            ))
        return {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return with_arrow(documents, ["text", "lang"], RESULT, run)


def keep_good(documents: DataFrame, references: dict[str | None, Reference] | None = None) -> DataFrame:
    """The kept documents, with the columns of ``documents``."""
    references = learn_references(documents) if references is None else references
    apart, back = set_aside(documents, RESULT)
    return back(judge(apart, references).filter("kept"))


@query("op7_quality_rules")
def _(spark, sf):
    documents = read(spark, sf, "documents", "doc_id", "text", "lang")
    found = judge(documents, learn_references(documents))
    return found.select("doc_id", *[c.split()[0] for c in RESULT.split(", ")])
