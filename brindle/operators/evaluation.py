"""How near a generated text comes to an expected one.

Texts are cut into tokens natively: runs of letters, digits and underscores, and every other sign but
white space. A small helper in Arrow batches counts, for each pair, the longest common subsequence of
tokens and the clipped matches of runs of one to four tokens; the scores are native. The syntax-tree and
data-flow parts of the metric that the evaluation used need a parser of a language and aren't here.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from brindle.functions import lcs

ORDER = 4
#: Tokens of pairs that a task has as Python objects at a time; a pair of more is alone.
SLICE_TOKENS = 1 << 17
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"


def tokens(text: str | Column) -> Column:
    """The tokens of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def matched(a: list[str], b: list[str]) -> list[int]:
    """Of one to ORDER tokens, how many runs of ``a`` are matched in ``b``, each of b's used once."""
    runs = lambda x, n: Counter(zip(*[x[i:] for i in range(n)], strict=False))
    return [(runs(a, n) & runs(b, n)).total() for n in range(1, ORDER + 1)]


def slices(batch: pa.RecordBatch, lists: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, in order, with SLICE_TOKENS elements of their lists at most, or one row."""
    upto = np.cumsum(sum(np.asarray(pa.compute.list_value_length(batch.column(c)), np.int64) for c in lists))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_TOKENS, "right")))
        yield batch.slice(at, end - at)
        at = end


def token_overlap(pairs: DataFrame, generated: str, expected: str, keep: list[str]) -> DataFrame:
    """Columns ``keep``, n_generated, n_expected, common (length of the longest common subsequence) and matches (by length of run)."""
    own = pairs.select(*keep, tokens(generated).alias("__a"), tokens(expected).alias("__b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, ("__a", "__b")):
                both = list(zip(*(batch.column(c).to_pylist() for c in ("__a", "__b")), strict=True))
                columns = [[len(a) for a, _ in both], [len(b) for _, b in both], [lcs.length(a, b) for a, b in both]]
                counts = pa.array([matched(a, b) for a, b in both], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(c, pa.int64()) for c in columns], counts], [*keep, "n_generated", "n_expected", "common", "matches"])

    schema = own.select(*keep).schema.add("n_generated", "long").add("n_expected", "long").add("common", "long").add("matches", ArrayType(LongType()))
    return own.mapInArrow(run, schema)


def common_ratio() -> Column:
    """Twice the common tokens over all tokens; 1 for two texts without any."""
    n = F.col("n_generated") + F.col("n_expected")
    return F.when(n > 0, 2 * F.col("common") / n).otherwise(F.lit(1.0))


def precision_score() -> Column:
    """The geometric mean of the clipped precisions of runs of one to ORDER tokens, a run longer than one counted once more on both sides, times exp(1 - expected / generated) for a shorter text. 0 without a matching token; 1 for two texts without tokens."""
    logs = []
    for n in range(1, ORDER + 1):
        more = 0 if n == 1 else 1
        runs = F.greatest(F.col("n_generated") - (n - 1), F.lit(0)) + more
        logs.append(F.log(F.try_divide((F.get("matches", F.lit(n - 1)) + more).cast("double"), runs)) / ORDER)
    short = F.when(F.col("n_generated") < F.col("n_expected"), F.exp(1 - F.try_divide(F.col("n_expected").cast("double"), F.col("n_generated")))).otherwise(1.0)
    score = F.when(F.get("matches", F.lit(0)) > 0, F.exp(sum(logs[1:], logs[0])) * short).otherwise(0.0)
    return F.when((F.col("n_generated") == 0) & (F.col("n_expected") == 0), F.lit(1.0)).otherwise(score)
