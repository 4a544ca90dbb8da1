"""Language of pages by Bayesian evidence fusion.

log P(language | page) = text likelihood + log P(declared | language) + log P(suffix | language) + log prior(language | host).

* Text: letter trigrams of the visible text under one model per language, counted over all ``documents`` with a language.
  Overlapping trigrams are not independent, so a text counts as ``weight`` times its trigrams, ``most`` trigrams at most.
* Declared: the language of the html element or of a content-language or locale element, as far as there is one.
* Address suffix: the last label of the host.
* Host: pages of a host, smoothed by those of its domain, these by all pages; a page's own vote is left out.

The last three are estimated from all pages by grouped sums of text posteriors, combined before the shuffle, so no host or
suffix is gathered in a task. Only numbers move between stages, no page.

Null html, url and texts without letters leave their evidence out; with no evidence at all the prior of all pages decides. Ties go to
the first language in alphabetical order. Repeated rows are judged each. Without documents no page has a language (null); an
empty table gives no rows. Only page id, url and html are read.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import arrow_map, flat, slices, text_or_empty, type_of
from lodestone.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELLS = 1 << 14
HIDDEN = re.compile(r"<!--.*?-->|<(script|style|nav|noscript|template)\b.*?</\1\s*>|<[^>]*>", re.IGNORECASE | re.DOTALL)
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})|http-equiv\s*=\s*[\"']?content-language[\"']?[^>]*?content\s*=\s*[\"']?([A-Za-z]{2,3})"
                      r"|og:locale[\"'][^>]*?content\s*=\s*[\"']?([A-Za-z]{2,3})", re.IGNORECASE)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every trigram of letters and word ends; other bytes count as one blank."""
    data, offsets = flat(pc.utf8_lower(texts.cast(pa.large_string())))
    letter = (data >= 97) & (data <= 122) | (data >= 128)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the blank after a word
    row = np.searchsorted(offsets, np.flatnonzero(keep), "right") - 1
    code = np.where(letter, data, 32)[keep].astype(np.uint32)
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA77) + code[2:] * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    inside = row[2:] == row[:-2]
    return row[:-2][inside], (h >> np.uint32(18))[inside].astype(np.int64)


def visible(page: str) -> str:
    return html.unescape(HIDDEN.sub(" ", page))


def declared(page: str) -> str | None:
    found = DECLARED.search(page)
    return next(g for g in found.groups() if g).lower() if found else None


def text_model(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and log P(cell | language), from all rows with a language."""
    rows = docs.select(text_or_empty(text_column).alias("text"), docs[f"`{lang_column}`"].cast("string").alias("lang")).where("lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            row, cell = trigrams(batch.column("text"))
            names = batch.column("lang").dictionary_encode()
            code = names.indices.to_numpy()[row]
            for k, name in enumerate(names.dictionary.to_pylist()):
                total[name] = total.get(name, 0) + np.bincount(cell[code == k], minlength=CELLS)
        for name, counts in total.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen), pa.array(counts[seen])], ["lang", "cell", "n"])

    table = arrow_map(rows, count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    counts = np.full((len(langs), CELLS), 0.5)
    if langs:
        where = {name: k for k, name in enumerate(langs)}
        counts[[where[x] for x in table.column("lang").to_pylist()], table.column("cell").to_numpy()] += table.column("n").to_numpy()
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def _softmax(values: Column) -> Column:
    shifted = F.transform(values, lambda v: F.exp(v - F.array_max(values)))
    return F.transform(shifted, lambda e: e / F.aggregate(shifted, F.lit(0.0), lambda t, x: t + x))


def _plus(*parts: Column) -> Column:
    total = parts[0]
    for part in parts[1:]:
        total = F.zip_with(total, part, lambda a, b: a + b)
    return total


def _log(values: Column) -> Column:
    return F.transform(values, lambda v: F.log(v))


def languages(pages: DataFrame, docs: DataFrame, weight: float = 0.25, most: int = 400, strength: float = 5.0, id_column: str = "page_id",
              url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, suffix, host) per row of ``pages``."""
    spark, kind = pages.sparkSession, type_of(pages, id_column)
    langs, table = text_model(docs)
    count = len(langs)
    rows = pages.select(pages[f"`{id_column}`"].alias("page_id"), pages[f"`{url_column}`"].cast("string").alias("url"), text_or_empty(html_column).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1))
    rows = rows.select("page_id", host.alias("host"), "html")
    model = spark.sparkContext.broadcast(table)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            sources = batch.column("html").to_pylist()
            row, cell = trigrams(pa.array([visible(s) for s in sources], pa.string()))
            size = np.bincount(row, minlength=len(sources))
            scale = weight * np.minimum(size, most) / np.maximum(size, 1)
            ll = np.stack([np.bincount(row, model.value[k][cell], minlength=len(sources)) * scale for k in range(count)], axis=1) if count else np.zeros((len(sources), 0))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), pa.array([declared(s) for s in sources], pa.string()),
                                              pa.array(ll.tolist(), pa.list_(pa.float64()))], ["page_id", "host", "declared", "ll"])

    seen = arrow_map(rows, read, f"page_id {kind}, host string, declared string, ll array<double>")
    domain, suffix = F.substring_index("host", ".", -2), F.substring_index("host", ".", -1)
    if not count:
        return seen.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"),
                           F.lit(None).cast("string").alias("text_lang"), "declared", suffix.alias("suffix"), "host")
    seen = cut_lineage(seen.withColumns({"vote": _softmax(F.col("ll")), "domain": domain, "suffix": suffix, "told": F.coalesce("declared", F.lit(""))}))

    def votes() -> Column:
        return F.array(*[F.sum(F.get("vote", F.lit(k))) for k in range(count)])

    overall = [v or 0.0 for v in seen.agg(votes().alias("v")).first()["v"]]
    whole = sum(overall) + 1e-9
    base = F.array(*[F.lit((v + 0.1) / (whole + 0.1 * count)) for v in overall])

    def prior(own: Column, votes_of: str, above: Column) -> Column:
        left = F.zip_with(F.col(votes_of), own, lambda v, o: F.greatest(v - o, F.lit(0.0)))
        total = F.aggregate(left, F.lit(0.0), lambda t, x: t + x)
        return F.zip_with(left, above, lambda v, p: (v + strength * p) / (total + strength))

    # Likelihood of what a page declares and of its suffix: share of a language's votes that come with it.
    joined = seen
    for level in ("told", "suffix", "domain", "host"):
        joined = joined.join(seen.groupBy(level).agg(votes().alias(f"{level}_votes")), level)
    n_told = F.lit(20.0)  # unseen combinations weigh as one vote among so many
    share = F.array(*[F.lit(v + 1.0) for v in overall])

    def given_lang(votes_of: str) -> Column:
        left = F.zip_with(F.col(votes_of), F.col("vote"), lambda v, o: F.greatest(v - o, F.lit(0.0)))
        return F.zip_with(left, share, lambda v, n: (v + n / (n + n_told)) / (n + 1.0))

    of_domain = prior(F.col("vote"), "domain_votes", base)
    of_host = prior(F.col("vote"), "host_votes", of_domain)
    none = F.array(*[F.lit(0.0)] * count)
    declared_part = F.when(F.col("told") == "", none).otherwise(_log(given_lang("told_votes")))
    suffix_part = F.when(F.col("suffix") == "", none).otherwise(_log(given_lang("suffix_votes")))
    prior_part = F.when(F.col("host") == "", _log(base)).otherwise(_log(of_host))
    fused = joined.withColumn("p", _softmax(_plus(F.col("ll"), declared_part, suffix_part, prior_part)))
    names = F.array(*[F.lit(x) for x in langs])

    def best(values: Column) -> Column:
        return F.get(names, (F.array_position(values, F.array_max(values)) - 1).cast("int"))

    return fused.select("page_id", best(F.col("p")).alias("lang"), F.array_max("p").alias("probability"), best(F.col("vote")).alias("text_lang"),
                        "declared", "suffix", "host")
