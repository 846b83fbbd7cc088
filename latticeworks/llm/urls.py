"""URL filters: rules by host and path, and boosted trees on lexical features for the urls that no rule fits.

The trees learn from labelled urls. Where none are given, the rules' own verdicts are the labels of the urls they fit. These say little of other urls: the trees
then don't see the top-level domain, by which rules tell urls apart, and judge by lexical features alone; ``held_out`` says how well.

Statistics of suffixes (shares of blocked urls) that a row learns from come from rows of other hosts' folds, so that no row's own label is among its features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import utf8
from .gbt import Trees, fit


#: The suffixes of host and path that have statistics; folds of hosts.
SUFFIXES, FOLDS = ("top", "kind"), 5


@dataclass(frozen=True)
class Rule:
    """``block`` or ``allow`` a host with all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path; both empty for a null url or one without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    n, size = len(offsets) - 1, np.diff(offsets)
    return size, np.bincount(np.repeat(np.arange(n), size) * 256 + data, minlength=n * 256).reshape(n, 256)


def _rates(column: pa.Array, known: dict[str, tuple[float, float]]) -> np.ndarray:
    """Share of blocked urls and of all urls in the sample, for each row's suffix."""
    coded = column.dictionary_encode()
    table = np.array([known.get(x, (np.nan, 0.0)) for x in coded.dictionary.to_pylist()] or [(np.nan, 0.0)], float)
    return table[coded.indices.to_numpy(zero_copy_only=False)]


def features(batch: pa.RecordBatch, suffixes: dict[str, dict[str, tuple[float, float]]]) -> np.ndarray:
    """Length, depth, digit ratio, entropy, parameter counts, and statistics of the host's and the path's suffix."""
    out = []
    for name in ("url", "host", "path"):
        size, h = _counted(batch.column(name))
        share = h / np.maximum(size, 1)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            entropy = -np.where(share > 0, share * np.log2(share), 0).sum(axis=1)
        digits = h[:, 48:58].sum(axis=1)
        out += [size, digits, digits / np.maximum(size, 1), entropy, h[:, ord("-")] + h[:, ord("_")], h[:, ord(".")], h[:, ord("/")], h[:, ord("%")]]
        if name == "url":
            out += [h[:, ord("?")], h[:, ord("&")], h[:, ord("=")], h[:, ord("#")]]
    table = [_rates(batch.column(c), suffixes[c]) for c in SUFFIXES if c in suffixes]
    return np.column_stack([*out, *table]).astype(float)


def _view(pages: DataFrame) -> DataFrame:
    host, path = parts(F.col("url"))
    own = pages.withColumns({"url": F.coalesce(F.col("url"), F.lit("")), "host": host, "path": path})
    return own.withColumns({"top": F.substring_index("host", ".", -1), "kind": F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1)})


@dataclass
class Model:
    trees: Trees
    suffixes: dict[str, dict[str, tuple[float, float]]]

    def blocked(self, batch: pa.RecordBatch) -> np.ndarray:
        """The probability of ``block``."""
        return self.trees.score(features(batch, self.suffixes))


def _shares(batch: pa.RecordBatch, y: np.ndarray, rows: np.ndarray, suffixes: tuple[str, ...]) -> dict[str, dict[str, tuple[float, float]]]:
    """For each suffix, the share of blocked urls, smoothed, and of all urls, among some rows."""
    out = {}
    for c in suffixes:
        sums: dict[str, list[float]] = {}
        for x, v in zip(batch.column(c).take(pa.array(rows)).to_pylist(), y[rows]):
            s = sums.setdefault(x, [0.0, 0])
            s[0] += v
            s[1] += 1
        out[c] = {x: ((b + 1) / (n + 2), n / max(len(rows), 1)) for x, (b, n) in sums.items()}
    return out


def _sample(urls: DataFrame, rows: int) -> tuple[pa.RecordBatch | None, np.ndarray, np.ndarray]:
    """Labelled urls, chosen by a hash; which are blocked; and each one's fold, by its host."""
    labelled = urls.select("url", "verdict").where(F.col("verdict").isin("block", "allow"))
    sample = labelled.orderBy(F.xxhash64("url"), "url", "verdict").limit(rows)  # so many rows, whatever the input
    view = _view(sample).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("long"))
    got = pa.Table.from_pandas(view.toPandas(), preserve_index=False).combine_chunks()
    y = np.array([v == "block" for v in got["verdict"].to_pylist()], float)
    batch = got.select(["url", "host", "path", *SUFFIXES]).to_batches()[0] if len(y) else None
    return batch, y, got["fold"].to_numpy().astype(np.int64) if len(y) else np.zeros(0, np.int64)


def _learnt(batch: pa.RecordBatch | None, y: np.ndarray, fold: np.ndarray, rows: np.ndarray, suffixes: tuple[str, ...]) -> Model:
    if batch is None or not len(rows):
        return Model(fit(np.zeros((0, 32)), y[rows]), {c: {} for c in suffixes})
    x, own = [], []
    for f in np.unique(fold[rows]):
        own.append(rows[fold[rows] == f])
        x.append(features(batch.take(pa.array(own[-1])), _shares(batch, y, rows[fold[rows] != f], suffixes)))
    return Model(fit(np.concatenate(x), y[np.concatenate(own)]), _shares(batch, y, rows, suffixes))


def train(urls: DataFrame, rows: int = 20_000, suffixes: tuple[str, ...] = SUFFIXES) -> Model:
    """Learn from ``rows`` labelled urls, chosen by a hash. urls: url, verdict (``block`` or ``allow``)."""
    batch, y, fold = _sample(urls, rows)
    return _learnt(batch, y, fold, np.arange(len(y)), suffixes)


def held_out(urls: DataFrame, rows: int = 20_000, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[float, float]:
    """The share of labelled urls that are judged right by trees that learnt from other hosts alone, and the share of the more frequent verdict."""
    batch, y, fold = _sample(urls, rows)
    right = 0.0
    for f in np.unique(fold):
        model, own = _learnt(batch, y, fold, np.flatnonzero(fold != f), suffixes), np.flatnonzero(fold == f)
        right += float(((model.blocked(batch.take(pa.array(own))) >= 0.5) == (y[own] == 1)).sum())
    return right / max(len(y), 1), max(y.mean(), 1 - y.mean()) if len(y) else 0.0


def _judged(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("page_id", "host", "path", "rule", "said")], pa.array(model.blocked(batch))], names=["page_id", "host", "path", "rule", "said", "score"])

    return run


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """One row for each page: page_id, host, path, rule (the longest that fits, or null), verdict (its, else ``block`` where
    the score is at least ``threshold``), score.

    pages: page_id, url. A null url, and one without ``://``, has an empty host and path. Repeated rows are judged alike. An
    empty table gives no rows. labelled: url, verdict; without it, the rules' verdicts on the urls they fit are learnt from, and the top-level domain isn't.
    Without labelled urls of both kinds, the score is the share of blocked ones. Other columns are left out.
    """
    view = _view(pages.select("page_id", "url"))
    rule, said = matched(F.col("host"), F.col("path"), rules)
    view = view.withColumns({"rule": rule, "said": said})
    model = train(view.select("url", F.col("said").alias("verdict")), suffixes=("kind",)) if labelled is None else train(labelled)
    kind = view.schema["page_id"].dataType.simpleString()
    scored = view.mapInArrow(_judged(model), f"page_id {kind}, host string, path string, rule string, said string, score double")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
