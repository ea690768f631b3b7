"""Problem 9: mixing sources to target weights.

Method: iterative proportional fitting. Token weights of the cells (source,
language, kind) are raked to the source, language and kind marginals; every
document then is used a number of times drawn from its calibrated weight.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import materialise, ship_package

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The usual split of byte-level BPE vocabularies: contractions, letters, numbers, signs, spaces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows of one sampling stratum; a window never holds more than about this many.
STRATUM = 20_000
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The public tokenizer at ``path``, one for each Python worker."""
    if path not in _ENCODERS:
        import tiktoken

        if not Path(path).is_file():
            raise FileNotFoundError(f"no tokenizer at {path}: name one that every executor can read by the option spark.quillmark.tokenizer or the parameter")
        lines = Path(path).read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(df: DataFrame, column: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Add ``n_tokens``, the length of ``column`` in tokens (null and empty texts: 0); the text itself is dropped."""
    ship_package(df.sparkSession)
    rest = [c for c in df.columns if c != column]
    schema = ", ".join([f"`{c}` {dict(df.dtypes)[c]}" for c in rest] + ["n_tokens bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for b in batches:
            texts = b.column(len(rest)).to_pylist()
            n = [len(e.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), pa.array(n, pa.int64())], names=[*rest, "n_tokens"])

    return df.select(*rest, column).mapInArrow(run, schema)


def source_name(c: Column) -> Column:
    """One spelling of a source: trimmed, lower case, joined by ``_``."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_\-]+", "_")


def language_name(c: Column) -> Column:
    """Primary subtag in lower case; what is no two- or three-letter tag is ``und``."""
    tag = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(F.coalesce(tag, F.lit("")) == "", "und").otherwise(tag)


def rake(tokens: np.ndarray, axes: list[np.ndarray], shares: list[np.ndarray], cap: np.ndarray, total: float, rounds: int = 200) -> np.ndarray:
    """Uses of each cell (0..cap) so that the marginals of ``tokens * uses`` meet ``shares * total``.

    Iterative proportional fitting with an upper bound: after each scaling, uses
    are clipped to ``cap``. The first axis is fitted last, so it is met best.
    """
    uses = np.ones(len(tokens))
    for _ in range(rounds):
        before = uses.copy()
        for k in [*range(1, len(axes)), 0]:
            want = shares[k] * total
            for _ in range(20 if k == 0 else 1):
                have = np.bincount(axes[k], tokens * uses, len(want))
                factor = np.divide(want, have, out=np.ones_like(want), where=have > 0)
                uses = np.minimum(uses * factor[axes[k]], cap)
                if np.abs(factor - 1).max() < 1e-9:
                    break
        if np.abs(uses - before).max() < 1e-9:
            break
    return uses


#: Rows of targets that may be given; a table with more is refused, not cut.
MOST_TARGETS = 10_000


def mix(documents: DataFrame, targets: DataFrame, *, key: str = "doc_id", column: str = "text", tokenizer: str | None = None, seed: int = 7) -> DataFrame:
    """Documents to use, with ``source``, ``n_tokens`` and ``uses`` (1..max_repeats).

    ``targets`` holds source, target_share and max_repeats; shares are scaled to
    sum to 1. The size of the mix is the largest at which no source needs more
    than max_repeats uses of its tokens, so shares are met in full. Sources
    without a target, null sources and documents without tokens are left out. A
    target source without documents can't be met: its share goes to the others in
    proportion, and ``reached_shares`` lists it with a share of 0. The
    language and kind marginals aim at what the sources hold together, as far as
    the source shares and caps allow.

    Documents are drawn by systematic sampling along their token counts in strata
    of bounded size, so realised shares differ from the fitted ones by a few
    documents of a stratum at most, and a source of any size is spread over tasks.
    """
    spark = documents.sparkSession
    tokenizer = tokenizer or spark.conf.get("spark.quillmark.tokenizer", TOKENIZER)
    kind = F.coalesce(F.lower(F.trim("content_kind")), F.lit("")) if "content_kind" in documents.columns else F.lit("")
    base = documents.select(F.col(key), source_name(F.col("source")).alias("source"), language_name(F.col("lang")).alias("lang"), kind.alias("kind"), column)
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").dropna().limit(MOST_TARGETS + 1).collect()
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} sources have a target")
    goal = {r.source: r for r in wanted}
    known = base.filter(F.col("source").isin(list(goal))) if goal else base.limit(0)
    counted = materialise(token_counts(known, column, tokenizer).filter("n_tokens > 0"), "tokens")
    # One row for each (source with a target, language tag, kind): dimension values, not documents.
    cells = counted.groupBy("source", "lang", "kind").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).toPandas()
    schema = "source string, lang string, kind string, expected double, strata int"
    if cells.empty:
        fitted = spark.createDataFrame([], schema)
    else:
        codes = [cells[c].astype("category").cat for c in ("source", "lang", "kind")]
        axes = [c.codes.to_numpy().astype(int) for c in codes]
        tokens = cells.tokens.to_numpy(float)
        own = [np.bincount(a, tokens) for a in axes]
        names = list(codes[0].categories)
        share = np.array([max(0.0, goal[s].target_share) for s in names])
        share = share / share.sum()
        cap = np.array([float(max(0, goal[s].max_repeats)) for s in names])
        total = min((own[0][i] * cap[i] / share[i] for i in range(len(names)) if share[i] > 0), default=0.0)
        uses = rake(tokens, axes, [share, own[1] / own[1].sum(), own[2] / own[2].sum()], cap[axes[0]], total)
        rows = [(s, g, k, float(u), int(n // STRATUM + 1)) for s, g, k, u, n in zip(cells.source, cells.lang, cells.kind, uses, cells.docs)]
        fitted = spark.createDataFrame(rows, schema)
    at = F.xxhash64(F.lit(seed), F.col(key))
    drawn = counted.join(fitted, ["source", "lang", "kind"]).withColumn("stratum", F.pmod(at, F.col("strata")))
    cell = ["source", "lang", "kind", "stratum"]
    w = Window.partitionBy(*cell).orderBy("n_tokens", at, key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A start of its own for every stratum: the same for all of its rows.
    start = F.pmod(F.xxhash64(F.lit(seed), *cell), F.lit(1_000_003)) / F.lit(1_000_003.0)
    upto = F.row_number().over(w) * F.col("expected") + start
    times = F.floor(upto + 1e-9) - F.floor(upto - F.col("expected") + 1e-9)
    return drawn.withColumn("uses", times.cast("long")).filter("uses > 0").select(key, "source", "n_tokens", "uses")


def reached_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target source the share reached, the tokens used and the most uses of a document."""
    goal = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens_used"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    total = Window.partitionBy()
    joined = goal.join(got, "source", "left").na.fill(0, ["tokens_used", "documents", "most_uses"])
    share = F.try_divide(F.col("tokens_used"), F.sum("tokens_used").over(total))
    return joined.withColumn("reached_share", F.coalesce(share, F.lit(0.0))).select("source", "target_share", "reached_share", "tokens_used", "documents", "most_uses", "max_repeats")
