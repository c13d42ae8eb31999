"""Natural-language intent over a query log drawn from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import intent as N
from ..sources import bridge as B
from ..sources.store import stored
from .catalog_queries import vis
from .registry import query


@query(None)
def extract_intent(spark, sf_dir):
    k = F.col("p_partkey")
    cues = ("up to 50", "under 50 dollars", "between 1,000 and 2,000", "in stock", "cheapest", "up to 5 people", "from 1999", "around 10", "without")
    cue = F.element_at(F.array(*map(F.lit, cues)), (k % len(cues) + 1).cast("int"))
    q = B.table(spark, sf_dir, "part").select(k.alias("query_id"), F.concat_ws(" ", cue, "p_name", F.lower("p_type")).alias("query"))
    return N.extract_intent(q, stored(N.phrase_table(stored(D.facet_values(vis(spark, sf_dir)), "facets")), "phrases"))
