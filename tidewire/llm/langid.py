"""Problem 10: language of documents and of each stretch within them.

Multinomial naive Bayes over hashed character n-grams.  The log-probability matrix (2**16 hashed
n-grams by languages, 4 bytes each: a fixed size whatever the data) is broadcast; each Arrow batch
is scored in numpy with one gather and one segmented sum over all its sentences.

A text is cut into lines and sentences.  Link, tag, rights and number lines, lone names and short
quoted phrases are no sentences.  Adjoining sentences of one language form a segment.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textforms import same_form

HASH_BITS = 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.1
#: The classifier is fitted on at most so many labelled samples and documents of each language: a
#: stated bound of its training rows, on which nothing else depends.
SAMPLES_PER_LANGUAGE = 20_000
DOCUMENTS_PER_LANGUAGE = 200
#: A labelled document is learnt from if this share of its sentences already has its label.
AGREEING = 0.8
#: Natural-log odds that count as certain are reached by length; n-grams overlap, so the evidence
#: of a sentence is divided by the number of orders before it becomes a confidence.
TEMPER = len(ORDERS)
#: A sentence below this confidence goes with its document.
SURE = 0.9

# Three-letter codes and words for "not known".
THREE_LETTERS = {
    "vie": "vi", "eng": "en", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "deu": "de", "ger": "de", "ind": "id", "zho": "zh",
    "chi": "zh", "jpn": "ja", "kor": "ko", "msa": "ms", "may": "ms", "nld": "nl", "dut": "nl", "ita": "it", "rus": "ru", "tha": "th",
}
UNKNOWN = {"", "und", "unknown", "unk", "none", "null", "nan", "n/a", "na", "?", "-", "xx", "zxx", "mis", "mul", "other", "auto"}

_LINE = re.compile(r"[^\r\n]+")
_STOP = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*(?=\s)|(?<=[。！？])[”’」』）]*")
_LINK = re.compile(r"(?:https?://|www\.)\S+|[#@]\S+|©.*|\S+@\S+\.\S+")
_QUOTED = re.compile(r"[“\"«„「『(（\[‘][^”\"»“」』)）\]’]{1,80}[”\"»“」』)）\]’]")
_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile(r"[぀-ヿ㐀-䶿一-鿿]")
_LINK_SIGN = re.compile(r"//|www\.|[#@©]")
_QUOTE_SIGN = re.compile(r"[“\"«„「『(（\[‘]")


def label_code(label: str | None) -> str | None:
    """Two-letter code of a stored label, None if it is missing or a word for unknown."""
    plain = (label or "").strip().lower()
    if plain in UNKNOWN:
        return None
    head = re.split(r"[-_\s]", plain)[0]
    return THREE_LETTERS.get(head, head)


def bare_accents(text: str) -> str:
    flat = unicodedata.normalize("NFD", text.replace("đ", "d").replace("Đ", "D"))
    return unicodedata.normalize("NFC", "".join(c for c in flat if unicodedata.category(c) != "Mn"))


def sentences(text: str | None) -> Iterator[tuple[int, int, str]]:
    """(start, end, text to score) of each full sentence; null and empty texts have none.

    A full sentence has at least three words that are no names, outside short quotations (five
    ideographs in scripts without blanks).
    """
    for line in _LINE.finditer(text or ""):
        at = line.start()
        cuts = [0, *(m.end() for m in _STOP.finditer(line.group())), len(line.group())]
        for a, b in zip(cuts, cuts[1:]):
            raw = line.group()[a:b]
            if raw.strip() and (plain := scored_text(raw)):
                yield at + a + len(raw) - len(raw.lstrip()), at + b, plain


def scored_text(raw: str) -> str | None:
    """The part of a sentence that tells its language, None if it is no full sentence.

    Of neighbouring words with a capital, all but a first word of the sentence are taken for names.
    """
    s = same_form(raw)
    if _LINK_SIGN.search(s):
        s = _LINK.sub(" ", s)
    if _QUOTE_SIGN.search(s):
        s = _QUOTED.sub(lambda m: " " if short(m.group()) else m.group(), s)
    found = _WORD.findall(s)
    if len(_HAN.findall(s)) < 5:
        small = [w[0].islower() for w in found]
        if sum(small) < 3:
            return None
        known = [True, *small, True]  # the ends of a sentence are no names
        found = [w for k, w in enumerate(found) if k == 0 or small[k] or (known[k] or k == 1) and known[k + 2]]
    return " ".join(found).lower() or None


def short(phrase: str) -> bool:
    return len(_WORD.findall(phrase)) <= 4 and len(_HAN.findall(phrase)) < 9


def gram_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-gram ids of all texts, first id of each text); each text is framed by blanks."""
    data = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    left = np.cumsum(size)[np.repeat(np.arange(len(texts)), size)] - np.arange(len(data)) if len(data) else np.empty(0, np.int64)
    ids, keep = [], []
    rolled = np.zeros(len(data), np.uint64)
    for k in range(max(ORDERS)):
        shifted = np.concatenate((data[k:], np.zeros(min(k, len(data)), np.uint64)))
        rolled = rolled * np.uint64(0x100000001B3) + shifted + np.uint64(k + 1)
        if k + 1 in ORDERS:
            mixed = rolled * np.uint64(0x9E3779B97F4A7C15)
            ids.append((mixed >> np.uint64(64 - HASH_BITS)).astype(np.int64))
            keep.append(left > k)
    ids, keep = np.stack(ids, 1), np.stack(keep, 1)
    per_place = keep.sum(1)
    starts = np.concatenate(([0], np.cumsum(size)))[:-1]
    firsts = np.concatenate(([0], np.cumsum(per_place)))[starts] if len(data) else np.empty(0, np.int64)
    return ids[keep], firsts


@dataclass
class LanguageModel:
    languages: list[str]
    logp: np.ndarray  # float32 [2**HASH_BITS, languages]

    def score(self, texts: list[str], chunk: int = 4096) -> np.ndarray:
        """Log likelihood [texts, languages]."""
        out = np.zeros((len(texts), len(self.languages)), np.float64)
        for k in range(0, len(texts), chunk):
            ids, firsts = gram_ids(texts[k : k + chunk])
            out[k : k + chunk] = np.add.reduceat(self.logp[ids], firsts, axis=0)
        return out

    def confidences(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, len(self.languages)))
        s = self.score(texts) / TEMPER
        s = np.exp(s - s.max(1, keepdims=True))
        return s / s.sum(1, keepdims=True)


def _fit_sentences(by_language: dict[str, list[str]]) -> LanguageModel:
    languages = sorted(by_language)
    counts = np.full((1 << HASH_BITS, len(languages)), SMOOTHING)
    for k, lang in enumerate(languages):
        plain = by_language[lang]
        bare = [b for t in plain if (b := bare_accents(t)) != t]  # as some publishers write
        for group in (plain, bare):
            if group:
                np.add.at(counts[:, k], gram_ids(group)[0], 1.0)
    return LanguageModel(languages, np.log(counts / counts.sum(0)).astype(np.float32))


def fit(samples: pd.DataFrame, labelled: pd.DataFrame | None = None) -> LanguageModel:
    """Model from clean samples (lang, sample_text) and, in a second step, labelled documents
    (lang, text), whose labels may be wrong: only those are learnt from in which the first model finds
    the label in AGREEING of the sentences.  Null or blank languages and texts are left out.
    """
    by_language: dict[str, list[str]] = {}
    for lang, text in samples[["lang", "sample_text"]].dropna().itertuples(index=False):
        if code := label_code(lang):
            by_language.setdefault(code, []).extend(t for _, _, t in sentences(text))
    by_language = {k: v for k, v in by_language.items() if v}
    if not by_language:
        raise ValueError("no labelled sample")
    model = _fit_sentences(by_language)
    if labelled is None:
        return model
    for lang, text in labelled[["lang", "text"]].dropna().itertuples(index=False):
        code, found = label_code(lang), [t for _, _, t in sentences(text)]
        if code not in by_language or not found:
            continue
        best = model.confidences(found).argmax(1)
        if (best == model.languages.index(code)).mean() >= AGREEING:
            by_language[code].extend(found)
    return _fit_sentences(by_language)


def _bounded(rows: DataFrame, code: F.Column, text: str, most: int) -> pd.DataFrame:
    """At most ``most`` rows of each language, chosen by a hash of the text."""
    from pyspark.sql import Window

    keyed = rows.select(code.alias("lang"), text, F.pmod(F.xxhash64(text), F.lit(1 << 30)).alias("_h")).filter("lang is not null")
    sizes = keyed.groupBy("lang").agg(F.count("*").alias("_c"))
    near = keyed.join(sizes, "lang").filter(F.col("_h") < F.lit(float(1 << 30)) * (2 * most + 20) / F.col("_c"))
    first = Window.partitionBy("lang").orderBy("_h", text)
    return near.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= most).select("lang", text).toPandas()


def fit_from_tables(samples: DataFrame, documents: DataFrame) -> LanguageModel:
    """``fit`` on bounded rows of both tables; labels of languages without samples are ignored."""
    clean = _bounded(samples, label_code_column("lang"), "sample_text", SAMPLES_PER_LANGUAGE)
    known = sorted(set(clean["lang"]))
    labelled = documents.withColumn("_code", label_code_column("lang")).filter(F.col("_code").isin(known))
    return fit(clean, _bounded(labelled, F.col("_code"), "text", DOCUMENTS_PER_LANGUAGE))


SEGMENTS = "doc_id long, label string, segment_no int, start int, length int, lang string, confidence double, sentences int, doc_languages int"


def language_segments(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per stretch of a document in one language: place in the text, language, confidence
    (mean over its sentences, weighted by length) and number of sentences.

    Documents without a full sentence, empty and null texts give no row; null ids are kept as null.
    A sentence whose own confidence is low takes the document's leading language if that
    language is its second choice, so one odd line does not split a text.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            found = [(k, a, b, t) for k, text in enumerate(batch["text"]) for a, b, t in sentences(text)]
            if not found:
                continue
            p = m.confidences([f[3] for f in found])
            s = pd.DataFrame({"k": [f[0] for f in found], "a": [f[1] for f in found], "b": [f[2] for f in found]})
            size = np.fromiter((len(f[3]) for f in found), np.float64, len(found))
            best, conf = p.argmax(1), p.max(1)
            weight = np.zeros((len(batch), len(m.languages)))
            np.add.at(weight, s["k"].to_numpy(), p * size[:, None])
            lead = weight.argmax(1)[s["k"].to_numpy()]
            second = np.argsort(p, 1)[:, -2] if p.shape[1] > 1 else best
            follow = (conf < SURE) & (second == lead)
            best = np.where(follow, lead, best)
            conf = p[np.arange(len(p)), best]
            s["lang"], s["w"], s["cw"] = best, size, conf * size
            new = (s["k"] != s["k"].shift()) | (s["lang"] != s["lang"].shift())
            s["run"] = new.cumsum()
            runs = s.groupby("run", sort=True).agg(k=("k", "first"), a=("a", "first"), b=("b", "last"), lang=("lang", "first"), w=("w", "sum"), cw=("cw", "sum"), n=("a", "size"))
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].to_numpy()[runs["k"]],
                    "label": batch["lang"].to_numpy()[runs["k"]],
                    "segment_no": runs.groupby("k").cumcount() + 1,
                    "start": runs["a"],
                    "length": runs["b"] - runs["a"],
                    "lang": np.array(m.languages)[runs["lang"]],
                    "confidence": (runs["cw"] / runs["w"]).round(6),
                    "sentences": runs["n"],
                    "doc_languages": runs.groupby("k")["lang"].transform("nunique"),
                }
            )

    return documents.select("doc_id", "text", "lang").mapInPandas(segments, SEGMENTS)


def document_languages(segments: DataFrame) -> DataFrame:
    """(doc_id, label, n_languages, lang, confidence, sentences): one row per document and language."""
    return segments.groupBy("doc_id", "label", F.col("doc_languages").alias("n_languages"), "lang").agg(
        F.sum("sentences").cast("int").alias("sentences"), (F.sum(F.col("confidence") * F.col("sentences")) / F.sum("sentences")).alias("confidence")
    )


def label_code_column(label: str) -> F.Column:
    """``label_code`` in Catalyst."""
    plain = F.lower(F.trim(F.coalesce(F.col(label), F.lit(""))))
    head = F.split(plain, r"[-_\s]")[0]
    pairs = F.create_map(*(F.lit(x) for kv in THREE_LETTERS.items() for x in kv))
    return F.when(plain.isin(*UNKNOWN), None).otherwise(F.coalesce(F.try_element_at(pairs, head), head))


def relabelled(segments: DataFrame) -> DataFrame:
    """Documents whose label is missing or wrong, or that hold several languages."""
    code = label_code_column("label")
    return document_languages(segments).filter(code.isNull() | (F.col("n_languages") > 1) | (code != F.col("lang")))
