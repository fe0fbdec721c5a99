"""Quality rules: distribution divergence from language references, with the base counts and limits.

One Python pass gives each whole text its counts, its histograms' distances from fixed references, and its verdict.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import by_bytes, table, text_of

#: Common words by language; a histogram has a place for each of the listed words of any language, and one for all others.
COMMON = {
    "en": "the of and to in a is that it for was on as with be by this from or are at an not have he she they which but had his her its were been has their all one we you",
    "fr": "de la le les et des en un une du que est pour qui dans par sur pas au il elle plus ne se ce avec son sa sont ou nous vous mais leur aux été cette",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me",
    "it": "di e il la che in un a per è una sono del non con da le dei si al come più nel della ma gli alla anche ha delle",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou",
    "nl": "de het een van en in is dat op te zijn met voor niet aan er om ook als dan maar bij uit nog naar heeft ze of door",
}
#: Marks that stand alone between blanks count as common words too: running text has few of them.
MARKS = "| - – — • · * & / : ; # > < = + % $ _ ~ ^ @ ! ? . , ( ) [ ] { }"
WORDS = sorted({w for ws in (*COMMON.values(), MARKS) for w in ws.split()})
CLASSES = ("lower", "upper", "letter", "digit", "space", "punctuation", "symbol", "other")
SYMBOLS = "#*$%&|<>"
SPACE = "\t\n\x0b\x0c\r "
#: Base limits of the contract.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: References, the same whatever is judged. Running text of any listed language has about these shares of the classes, and
#: this share of listed words, which fall off with their rank in the list as ranks of words do.
CLASS_SHARES = (0.775, 0.025, 0.0, 0.005, 0.168, 0.025, 0.001, 0.001)
COMMON_SHARE, RANK_OFFSET = 0.42, 2
#: Guards: characters from which classes are judged, and words from which more than the lack of common words is.
JUDGED_CHARS, JUDGED_WORDS = 200, 100
#: The most distance kept, what a short text may lie farther off (this much over the root of its words), and the share of
#: a reference's distance from a text without common words that is never kept.
CLASS_DISTANCE, WORD_DISTANCE, SHORT, WORD_MOST = 0.18, 0.42, 0.5, 0.98


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point."""
    kinds = {"Ll": 0, "Lu": 1, "Nd": 3, "Zs": 4, "Zl": 4, "Zp": 4}
    first = {"L": 2, "M": 2, "N": 3, "P": 5, "S": 6}
    out = np.full(0x110000, 7, np.uint8)
    for c in range(0x30000):
        k = unicodedata.category(chr(c))
        out[c] = kinds.get(k, first.get(k[0], 7))
    for c in SPACE:
        out[ord(c)] = 4
    for c in SYMBOLS + "@^~=+\\_`{}[]":
        out[ord(c)] = 6
    return out


def counts(text: str) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the class counts and the common-word counts."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    dup = 0
    if len(lines) > 1:
        lines = [x for x in lines if x.strip(SPACE)]
        dup = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        hit = np.zeros(n + 3, bool)
        at = np.array([i for i, w in enumerate(windows) if often[w] > 1])
        hit[at] = hit[at + 1] = hit[at + 2] = True
        repeated = int(hit.sum())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    classes = np.bincount(class_table()[codes], minlength=8).tolist()
    seen = Counter(words)
    common = [seen.get(w, 0) for w in _encoded()]
    return n, chars, symbols, dup, repeated, classes, [*common, n - sum(common)]


@lru_cache(maxsize=1)
def _encoded() -> list[bytes]:
    return [w.encode() for w in WORDS]


@lru_cache(maxsize=16)
def reference(lang: str) -> tuple[np.ndarray, np.ndarray | None, float]:
    """The class and word shares of a language, and how far a text without common words lies from the latter.

    Of an unlisted language letters of any case and blanks are one class (scripts may have neither), and no words are known.
    """
    classes = np.array(CLASS_SHARES) / sum(CLASS_SHARES)
    if lang not in COMMON:
        return folded(classes), None, 0.0
    own = COMMON[lang].split()
    share = 1 / (np.arange(len(own)) + RANK_OFFSET)
    words = np.zeros(len(WORDS) + 1)
    for w, x in zip(own, COMMON_SHARE * share / share.sum(), strict=True):
        words[WORDS.index(w)] += x
    words[-1] = 1 - words.sum()
    return classes, words, distance(np.eye(len(words))[-1], words)


def folded(classes: np.ndarray) -> np.ndarray:
    return np.array([classes[[0, 1, 2, 4]].sum(), *classes[[3, 5, 6, 7]]])


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, 0 to 1, of two distributions; only places where ``p`` has something need logarithms."""
    at = np.flatnonzero(p)
    a, b = p[at], q[at]
    m = (a + b) / 2
    some = b > 0
    total = (a * np.log2(a / m)).sum() + (b[some] * np.log2(b[some] / m[some])).sum() + (1 - b.sum())
    return math.sqrt(max(0.0, total / 2))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(text: str, lang: str | None) -> tuple:
    """The counts, base_failed, kept and the two distances (None: not judged) of one text.

    Kept is a text that passes the base limits and lies near its language's references. Classes are judged from
    JUDGED_CHARS characters on, words from JUDGED_WORDS on; a shorter text of a listed language fails by its words only
    if it has next to none of the common ones. Words that lie too far from the language's own are held against every
    other listed one's.
    """
    n, chars, symbols, dup, repeated, classes, words = counts(text)
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    ref_classes, ref_words, none = reference(lang if lang in COMMON else "und")
    far_classes = far_words = None
    bad, more = failed, SHORT / math.sqrt(max(n, 1))
    if len(text) >= JUDGED_CHARS:
        shares = np.array(classes) / len(text)
        far_classes = distance(shares if ref_words is not None else folded(shares), ref_classes)
        bad |= far_classes > CLASS_DISTANCE + more
    if ref_words is not None and n:
        limit = min(WORD_DISTANCE + more, WORD_MOST * none) if n >= JUDGED_WORDS else WORD_MOST * none
        shares = np.array(words) / n
        far_words = distance(shares, ref_words)
        if far_words >= limit:  # it may be in another listed language, whole or in part
            far_words = min(distance(shares, reference(x)[1]) for x in COMMON)
        bad |= far_words >= limit
    return n, chars, symbols, dup, repeated, failed, not bad, far_classes, far_words


def verdicts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """k0, k1, … (the columns ``keep``), the counts, base_failed, kept and the two distances of every row of ``docs``.

    A row's verdict is its own: references are fixed, so no other row moves it and nothing is shuffled. A null text has
    none of anything; a null or unlisted language, or no column ``lang``, is judged by folded classes alone; an empty
    table gives an empty one; repeated rows are judged each.
    """
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, names, strict=True)], _lang(docs).alias("lang"), text_of("text").alias("text"))
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, len(keep) + 1):
            made = [judge(t.as_py(), x) for t, x in zip(b.column(len(keep) + 1), b.column(len(keep)).to_pylist(), strict=True)]
            cols = list(zip(*made, strict=True)) if made else [()] * len(types)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*names, *RESULT])

    kind = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema[: len(keep)]) + ", ".join(f"{c} {t}" for c, t in zip(RESULT, ["long"] * 5 + ["boolean"] * 2 + ["double"] * 2, strict=True))
    return rows.mapInArrow(run, kind)


RESULT = (*COUNTS, "base_failed", "kept", "class_distance", "word_distance")


def _lang(docs: DataFrame) -> Column:
    return F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep; nothing is shuffled.

    Null texts have no words, so fail; repeated rows are judged each; an empty table gives an empty one; columns of any
    name and type pass as they are.
    """
    at, lang = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, at):
            langs = [None] * b.num_rows if lang is None else b.column(lang).to_pylist()
            yield b.filter(pa.array([judge(t.as_py() or "", x)[6] for t, x in zip(b.column(at), langs, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return verdicts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"]).withColumnRenamed("k0", "doc_id")
