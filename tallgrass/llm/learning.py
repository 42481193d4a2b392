"""Bounded samples of labelled rows for the classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPAN = 1 << 31
#: Labels that are classes of a model: the most frequent ones, so many at most (ties: the smaller label). Rows of other labels teach nothing.
CLASSES = 256
#: Bytes of a text beyond which it is drawn the less often the longer it is, so that a sample of n rows is of n times so many bytes at most on average. Texts are never cut.
LONG = 1 << 16


def seldom(draw: Column, text: Column, long: int = LONG) -> Column:
    """Whether a row stays in a sample for its length: always up to `long` bytes, beyond with a probability of long / bytes, by bits of its draw that don't decide whether it is sampled."""
    return F.pmod(F.xxhash64(draw), F.lit(_SPAN)) * F.octet_length(text) < F.lit(float(long) * _SPAN)


def class_sample(rows: DataFrame, label: str, key: list[str], *, per_class: int, classes: int = CLASSES) -> tuple[DataFrame, int]:
    """A sample of about per_class rows of each class, and the number of rows that it is bounded by. The `classes` most frequent labels are classes.

    A row's membership depends on a hash of its key columns and its label's count alone, so nothing is shuffled but the counts, and a rerun takes the same rows. Null labels are never sampled. The result has a column _draw to order by.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(classes).collect()
    draw = F.pmod(F.xxhash64(*key), F.lit(_SPAN))
    if not counts:
        return rows.limit(0).withColumn("_draw", draw), per_class
    below = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(_SPAN, int(per_class / r["count"] * _SPAN) + 1))])
    return rows.where(draw < F.try_element_at(below, F.col(label))).withColumn("_draw", draw), int(1.25 * per_class * len(counts))
