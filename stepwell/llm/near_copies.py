"""Near copies: SimHash fingerprints first, then what they can't reach, all by exact Jaccard similarity.

Fingerprints of five-word shingles are linked by covering masks, as in `simhash`, and every
pair they give is compared exactly.  At 4/5 fingerprints differ in about ten bits of 64, and
covering tables of radius ten are 2,047, so they can't give all links: the join of
`jaccard_join` then searches for those between the components that SimHash has made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm import simhash
from stepwell.llm.jaccard_join import join_components

WIDTH = 5
JACCARD = (4, 5)
#: Bits in which fingerprints differ that are compared ahead of the join.
RADIUS = 4


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, uid, component_id (the least doc_id reachable, itself included).

    Words are runs of non-white-space with A-Z lower-cased; a text of fewer than
    ``width`` words is one shingle; texts without a word are equal.  Documents are
    linked at a Jaccard similarity of 4/5 or more between their sets of shingles,
    which are compared by 64-bit hashes.  A null doc_id is never the least unless no
    other is reachable.  Extra columns are ignored; the table may be empty.
    """
    found = join_components(docs, id_col, text_col, width, JACCARD, lambda texts, reps: simhash.candidates(texts, reps, width, RADIUS))
    least = found.filter("n_shingles = 0").agg(F.min("doc_id")).first()[0]
    component = F.when(F.col("n_shingles") == 0, F.lit(least).cast("long")).otherwise(F.col("component_id"))
    return found.select("doc_id", "uid", component.alias("component_id"))
