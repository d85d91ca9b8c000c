"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence meet in one posterior over the languages and "und" (none of them):

- the text: multinomial likelihood of its letter trigrams, hashed into ``BINS`` bins, lower-cased, with runs of
  other characters as one space; "und" holds all bins alike likely, so letters in no language's order fall to it.
  Trigrams overlap, so their evidence is counted by a third;
- a declared language (a markup ``lang`` attribute, or a table's own column): right with a given probability;
- the address suffix of a host ("de", "fr"): right with a given probability; generic suffixes say nothing;
- a prior of the host, smoothed by that of its domain, smoothed by that of all rows: counts of the languages that
  the texts alone favour, by grouped aggregation over all rows.

The trigram model is trained on all rows that declare one of the languages: every task counts its own trigrams
into one table of ``languages x BINS``, the tables are summed, and the sum (fixed size) is broadcast. Host priors
are broadcast while there are at most ``MOST_HOSTS`` of them, and joined otherwise; there a hot host's rows are
split by adaptive skew handling.

Defined results: null or letterless text has no text evidence: if nothing else speaks for a language, it is "und";
null declarations, suffixes and hosts are no evidence; null hosts share the global prior; equal posteriors go to the
language listed first; repeated rows get the same result; extra columns stay, those named ``lid_language``, ``lid_confidence`` and
``lid_text_language`` are replaced; texts are worked whole, a piece at a time; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean, store

BINS = 1 << 14
LANGUAGES = ("en", "de", "fr", "es")
UND = "und"
MOST_HOSTS = 20_000
CHUNK = 1 << 16  # characters worked at a time

# Country suffixes and the language they speak for.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}

CODES = 1 << 17  # code points with letters of their own; those above count as white space


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point the lower-case letter that it stands for, a space for what is no letter."""
    out = np.full(CODES, 32, np.uint64)
    for c in range(CODES):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < CODES else c
    return out


def trigrams(text: str | None) -> Iterator[np.ndarray]:
    """The bins of all letter trigrams of a text, CHUNK characters at a time. Runs of other characters are one space, as are both ends."""
    if not text:
        return
    table, held = letters(), np.array([32], np.uint64)
    for at in range(0, len(text), CHUNK):
        part = text[at : at + CHUNK]
        raw = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.concatenate([held, table[np.where(raw < CODES, raw, 32)], np.array([32] if at + CHUNK >= len(text) else [], np.uint64)])
        c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
        held = c[-2:]
        if len(c) >= 3:
            h = (c[:-2] * np.uint64(0x9E3779B1) ^ c[1:-1] * np.uint64(0x85EBCA77)) * np.uint64(0xC2B2AE3D) + c[2:] * np.uint64(0x27D4EB2F)
            h ^= h >> np.uint64(29)
            yield ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64)


def add_counts(total: np.ndarray, texts: Iterable[str | None]) -> None:
    """Adds the texts' trigrams to one row of counts."""
    held, size = [], 0
    for t in texts:
        for h in trigrams(t):
            held.append(h)
            size += len(h)
            if size >= CHUNK:
                total += np.bincount(np.concatenate(held), minlength=BINS)
                held, size = [], 0
    if held:
        total += np.bincount(np.concatenate(held), minlength=BINS)


def train(docs: DataFrame, text: str, declared: Column, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Log-probabilities (languages x BINS), from all rows that declare a language."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BINS), np.int64)
        place = {x: i for i, x in enumerate(languages)}
        for b in batches:
            said = b.column(1).to_pylist()
            for lang, row in place.items():
                add_counts(total[row], (t.as_py() for t, x in zip(b.column(0), said) if x == lang))
        lang, bin_ = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bin_), pa.array(total[lang, bin_])], ["lang", "bin", "n"])

    counts = docs.select(F.col(text).alias("text"), declared.alias("declared")).mapInArrow(run, "lang long, bin long, n long")
    table = np.zeros((len(languages), BINS))
    rows = counts.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()  # languages x BINS rows at most
    table[rows["lang"].to_numpy(int), rows["bin"].to_numpy(int)] = rows["n"].to_numpy(float)
    smooth = table + 0.5 + 1e-6 * table.sum(axis=1, keepdims=True) / BINS
    return np.log(smooth / smooth.sum(axis=1, keepdims=True))


def likelihoods(text: Column, model: np.ndarray) -> Column:
    """array<double>: log-likelihood of the text in each language, less that in "und"; null without letters."""
    above = [np.ascontiguousarray(row) for row in (model - np.log(1 / BINS)) / 3]

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            sums = [[row.take(h).sum() for row in above] for h in trigrams(t)]
            out.append(np.sum(sums, axis=0) if sums else None)
        return pd.Series(out, dtype=object)

    # Not deterministic in name only: else a filter on the result would be moved below and work every text twice.
    return run.asNondeterministic()(text)


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def domain_of(host: Column) -> Column:
    """The last two labels; a host of one label is its own domain."""
    return F.element_at(F.split(F.regexp_replace(host, r"^.*\.([^.]+\.[^.]+)$", "$1"), "/"), 1)


def markup_language(html: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1), F.lit("")))


def page_text(html: Column) -> Column:
    """What a reader sees: without comments, scripts, styles and tags, with references resolved. What is never closed goes to the end."""
    gone = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)|<[a-z/!?][^<>]*(?:>|\z)", " ")

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unescape(t))

    return run(gone)


def suffix_language(host: Column, suffixes: dict[str, str] = SUFFIXES) -> Column:
    table = F.create_map(*(F.lit(x) for kv in suffixes.items() for x in kv))
    return F.element_at(table, F.regexp_extract(host, r"\.([a-z]+)$", 1))


def identify(docs: DataFrame, text: str = "text", *, declared: Column | None = None, host: Column | None = None, languages: tuple[str, ...] = LANGUAGES, keep: list[str] | None = None,
             trust_declared: float = 0.9, trust_suffix: float = 0.8, und_prior: float = 0.01, weight: float = 20.0) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``lid_language`` and ``lid_confidence``, the posterior of that language (fused), and
    ``lid_text_language``, what the text alone favours (null without letters). Texts are scored once: what is kept is written with its likelihoods."""
    lean(docs)
    k = len(languages)
    none = F.lit(None).cast("string")
    declared, host = none if declared is None else declared, none if host is None else host
    model = train(docs, text, declared, languages)
    names = F.array(*map(F.lit, (*languages, UND)))
    own = [c for c in docs.columns if c not in ("lid_language", "lid_confidence", "lid_text_language") and (keep is None or c in keep)]
    said, at, ll, score, prior_host, prior, domain = fresh(docs.columns, "declared__", "host__", "ll__", "score__", "prior_host__", "prior__", "domain__")

    def best(scores: Column) -> Column:
        return F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))

    extra = store(docs.select(*own, declared.alias(said), host.alias(at), likelihoods(F.col(text), model).alias(ll)), "likelihoods")
    alone = F.concat(ll, F.array(F.lit(0.0)))
    # Priors: global, domain, host. Texts of every row vote for what they favour alone.
    votes = extra.where(F.col(ll).isNotNull()).select(F.col(at).alias("host"), best(alone).alias("language")).groupBy("host", "language").agg(F.count("*").alias("n")).where("language <> 'und'")
    hosts = votes.groupBy("host").agg(*(F.sum(F.when(F.col("language") == x, F.col("n")).otherwise(0)).cast("double").alias(f"n{i}") for i, x in enumerate(languages)))
    hosts = store(hosts, "hosts").withColumn(domain, domain_of(F.col("host")))
    ns = [F.col(f"n{i}") for i in range(k)]
    total = [F.lit(float(x or 0)) for x in hosts.agg(*(F.sum(n) for n in ns)).first()]
    all_total = sum(total[1:], total[0])
    world = [(n + 1.0) / (all_total + float(k)) for n in total]
    in_domain = hosts.groupBy(domain).agg(*(F.sum(n).alias(f"d{i}") for i, n in enumerate(ns)))
    sum_of = lambda xs: sum(xs[1:], xs[0])
    ds = [F.col(f"d{i}") for i in range(k)]
    smoothed = hosts.where("host is not null").join(in_domain, domain).select(
        F.col("host").alias(prior_host),
        F.array(*((n + weight * ((d + weight * w) / (sum_of(ds) + weight))) / (sum_of(ns) + weight) for n, d, w in zip(ns, ds, world))).alias(prior),
    )
    few = smoothed.limit(MOST_HOSTS + 1).count() <= MOST_HOSTS
    joined = extra.join(F.broadcast(smoothed) if few else smoothed, F.col(at) == F.col(prior_host), "left")

    def spoken(what: Column, trust: float) -> list[Column]:
        """Log-likelihood of a statement in each language and in und; nothing where it names none of them."""
        knows = what.isin(*languages)
        per = [F.when(knows, F.when(what == x, F.lit(float(np.log(trust)))).otherwise(F.lit(float(np.log((1 - trust) / max(k - 1, 1)))))).otherwise(F.lit(0.0)) for x in languages]
        return [*(F.coalesce(p, F.lit(0.0)) for p in per), F.when(knows, F.lit(float(np.log(1 / k)))).otherwise(F.lit(0.0))]

    d, s = spoken(F.col(said), trust_declared), spoken(suffix_language(F.col(at)), trust_suffix)
    priors = [F.log(F.coalesce(F.get(prior, F.lit(i)), w)) + float(np.log(1 - und_prior)) for i, w in enumerate(world)] + [F.lit(float(np.log(und_prior)))]
    heard = [F.coalesce(F.get(ll, F.lit(i)), F.lit(0.0)) for i in range(k)] + [F.lit(0.0)]
    # Without letters, a prior alone is no sign of a language.
    blank = F.col(ll).isNull() & F.coalesce(~F.col(said).isin(*languages), F.lit(True)) & suffix_language(F.col(at)).isNull()
    scored = joined.withColumn(score, F.array(*(h + x + y + p for h, x, y, p in zip(heard, d, s, priors))))
    low = F.array_max(score)
    share = F.lit(1.0) / F.aggregate(score, F.lit(0.0), lambda a, x: a + F.exp(x - low))
    return scored.select(
        *own,
        F.when(blank, F.lit(UND)).otherwise(best(F.col(score))).alias("lid_language"),
        F.when(blank, F.lit(1.0)).otherwise(share).alias("lid_confidence"),
        F.when(F.col(ll).isNotNull(), best(alone)).alias("lid_text_language"),
    )


def accepted(identified: DataFrame, languages: tuple[str, ...] = LANGUAGES, least: float = 0.5) -> DataFrame:
    """Rows in one of the languages with at least that posterior, without the columns of ``identify``."""
    kept = identified.where(F.col("lid_language").isin(*languages) & (F.col("lid_confidence") >= least) & F.col("lid_text_language").isNotNull())
    return kept.drop("lid_language", "lid_confidence", "lid_text_language")
