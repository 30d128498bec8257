"""Quality rules by distribution divergence.

Each document's histogram of character classes, and its histogram of common words, is compared with references of
its language by the Jensen-Shannon distance (base 2, so between 0 and 1). References are summed over all documents
that pass the base rules. A document too short for a stable histogram is not judged by it.

Null text: no words, so the base rules reject it. Null, empty or unlisted language: the nearest reference counts, of which
one is that of all such documents.
Documents are judged one by one, so repeated rows get equal verdicts. An empty table gives an empty result. Other
columns don't matter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import IS_SEPARATOR, Words, hashes, per_text, segments, slices, swept

#: Frequent words of each language, the bins of the common-word histograms.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he this are or from at which but have an they you were",
    "fr": "de la le et les des en un du une que est dans qui par pour au il sur ne se pas plus ce avec sont entre ou elle son",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si",
}


@dataclass(frozen=True)
class QualityRules:
    """``max_chars``, ``max_common`` and ``max_sum`` bound the two distances and their sum, each from so many characters or words on."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_chars: float = 0.3
    max_common: float = 0.42
    max_sum: float = 0.46
    min_chars_judged: int = 200
    min_words_judged: int = 80


BINS = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
#: Classes: 0 lower, 1 upper, 2 digit, 3 white space, 4 sentence marks, 5 other ASCII marks, 6 beyond ASCII, 7 continuation bytes, not counted.
CLASS = np.full(256, 5, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 0, 1, 2
CLASS[IS_SEPARATOR] = 3
CLASS[list(b".,;:'\"?()-")] = 4
CLASS[192:], CLASS[128:192] = 6, 7
N_CLASSES = 7


def _word_codes() -> np.ndarray:
    data = np.frombuffer("".join(BINS).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in BINS])
    return hashes(data, np.concatenate([[0], ends[:-1]]), ends)


def _distinct_lines(words: Words) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line."""
    starts, ends = segments(words.data, words.offsets, NEWLINE)
    inside = np.concatenate([[0], np.cumsum(~IS_SEPARATOR[words.data])])
    filled = inside[ends] > inside[starts]
    starts, ends = starts[filled], ends[filled]
    text = np.searchsorted(words.offsets, starts, "right") - 1
    code = hashes(words.data, starts, ends)
    order = np.lexsort((code, text))
    again = np.zeros(len(order), bool)
    again[1:] = (code[order][1:] == code[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.bincount(text[order][again], minlength=len(words.counts))


def _repeated_words(words: Words) -> np.ndarray:
    """Per text: words covered by a 3-word window that occurs at least twice in the text."""
    at, code = words.runs(3)
    text = words.document()
    order = np.lexsort((code, text[at]))
    a, c, t = at[order], code[order], text[at][order]
    same = (c[1:] == c[:-1]) & (t[1:] == t[:-1])
    twice = np.zeros(len(a), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(words.hash), bool)
    for k in range(3):
        covered[a[twice] + k] = True
    return per_text(covered, words.first)


def measures(texts: pa.Array, rules: QualityRules) -> dict[str, np.ndarray]:
    """The base rules' figures and both histograms (rows: texts) of a slice."""
    words = Words(texts)
    n, size = len(words.counts), len(BINS) + 1
    leads = (words.data & 0xC0) != 0x80
    out = {
        "n_words": words.counts.astype(np.int64),
        "word_chars": per_text(leads & ~IS_SEPARATOR[words.data], words.offsets),
        "n_symbols": per_text(SYMBOLS[words.data], words.offsets),
        "n_dup_lines": _distinct_lines(words).astype(np.int64),
        "n_repeat_words": _repeated_words(words),
    }
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * out["n_words"])
    chars = np.empty((n, N_CLASSES), np.int64)
    kinds = CLASS[words.data]
    for k in range(N_CLASSES):
        chars[:, k] = per_text(kinds == k, words.offsets)
    lower = Words(texts, lower=True)
    codes = _word_codes()
    order = np.argsort(codes)
    place = np.searchsorted(codes[order], lower.hash).clip(max=len(codes) - 1)
    found = codes[order][place] == lower.hash
    bins = np.where(found, order[place], size - 1)
    common = np.bincount(lower.document() * size + bins, minlength=n * size).reshape(n, size)
    return out | {"chars": chars, "common": common}


def distances(histograms: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row from ``reference``; an empty row has distance 0."""
    total = histograms.sum(axis=1, keepdims=True)
    p = np.divide(histograms, total, out=np.tile(reference, (len(histograms), 1)).astype(float), where=total > 0)
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(reference > 0, reference * np.log2(reference / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def references(docs: DataFrame, rules: QualityRules) -> dict[str, dict[str, list[float]]]:
    """Both reference histograms of each listed language ('' for the rest): sums over all documents that pass the base rules.

    What comes to the driver is (languages + 1) x bins sums, whatever the size of the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], np.ndarray] = {}
        for piece in slices(batches):
            found = measures(piece.column("text"), rules)
            langs = np.array([x if x in COMMON_WORDS else "" for x in piece.column("lang").to_pylist()], dtype=object)
            for lang in set(langs):
                rows = (langs == lang) & ~found["base_failed"]
                for kind in ("chars", "common"):
                    sums[lang, kind] = sums.get((lang, kind), 0) + found[kind][rows].sum(axis=0)
        rows = [(lang, kind, k, int(v)) for (lang, kind), total in sums.items() for k, v in enumerate(total)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.string(), pa.int32(), pa.int64()))], ["lang", "kind", "bin", "n"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    counted = docs.select(F.col("text"), lang.alias("lang")).mapInArrow(swept(count), "lang string, kind string, bin int, n long")
    out: dict[str, dict[str, list[float]]] = {}
    for r in counted.groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n")).collect():
        sizes = {"chars": N_CLASSES, "common": len(BINS) + 1}
        out.setdefault(r["lang"], {}).setdefault(r["kind"], [0.0] * sizes[r["kind"]])[r["bin"]] = float(r["n"])
    shares = {lang: {kind: [v / sum(h) for v in h] for kind, h in kinds.items() if sum(h)} for lang, kinds in out.items()}
    return {lang: kinds for lang, kinds in shares.items() if len(kinds) == 2}


def judge(piece: pa.RecordBatch, refs: dict, rules: QualityRules) -> dict[str, np.ndarray]:
    """Figures, both distances and the verdict for each row of a slice."""
    found = measures(piece.column("text"), rules)
    n = piece.num_rows
    langs = piece.column("lang").to_pylist() if "lang" in piece.schema.names else [None] * n
    for kind in ("chars", "common"):
        each = {x: distances(found[kind], np.array(refs[x][kind])) for x in refs}
        nearest = np.min(list(each.values()), axis=0) if each else np.zeros(n)
        found[f"js_{kind}"] = np.array([each[x][i] if x and x in each else nearest[i] for i, x in enumerate(langs)], dtype=float).reshape(n)
    odd = (found["js_chars"] > rules.max_chars) & (found["chars"].sum(axis=1) >= rules.min_chars_judged)
    odd |= ((found["js_common"] > rules.max_common) | (found["js_chars"] + found["js_common"] > rules.max_sum)) & (found["n_words"] >= rules.min_words_judged)
    found["kept"] = ~found["base_failed"] & ~odd
    return found


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, js_chars double, js_common double"


def score(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """doc_id, the base figures, both distances and ``kept`` for each row of ``docs`` (doc_id, text, optionally lang)."""
    refs = json.dumps(references(docs, rules))
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = json.loads(refs)
        for piece in slices(batches):
            found = judge(piece, known, rules)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(found[x]) for x in names)], ["doc_id", *names])

    wanted = [F.col(x) for x in ("doc_id", "text", "lang") if x in docs.columns]
    return docs.select(*wanted).mapInArrow(swept(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def keep(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged."""
    refs = json.dumps(references(docs, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = json.loads(refs)
        for piece in slices(batches):
            yield piece.filter(pa.array(judge(piece, known, rules)["kept"]))

    return docs.mapInArrow(swept(run), docs.schema)
