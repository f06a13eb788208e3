"""Queries of query understanding over the dev queries and planned events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F, types as T

from ..functions import intents as I
from ..functions.querytext import modality_weights, parsed, spatial, variants
from ..tables import table


class Expand:
    """Table function: the numbered variants of a query text; none for a null or empty one."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        yield from enumerate(variants((text or "").strip()))


expand = F.udtf(Expand, returnType="pos int, variant string")


def parse_query_udf(s, d):
    p = parsed(table(s, d, "kis_dev").select("kis_id", "query"), "query")
    join = lambda c: F.array_join(f"plan.{c}", "|").alias(c)
    return p.select("kis_id", "plan.language", join("entities"), join("actions"), join("colours"), join("events"), join("roles"), join("constraints"), "plan.complexity")


def expand_query_udtf(s, d):
    """Every planned event beside its query variants, by a lateral join with the table function."""
    t = table(s, d, "notebook_events").select("event_id", F.coalesce("en_text", "vi_text").alias("t"))
    return t.lateralJoin(expand(F.col("t").outer())).select("event_id", "pos", "variant")


_WORDS = T.ArrayType(T.StringType())
SIGNALS = T.StructType([T.StructField(n, t) for n, t in (("chain", T.BooleanType()), ("expand", T.BooleanType()), ("long", T.BooleanType()), ("places", _WORDS), ("weights", T.MapType(T.StringType(), T.DoubleType())), ("queries", _WORDS), ("strict", T.BooleanType()))])


@F.pandas_udf(SIGNALS)
def signals_of(texts: pd.Series) -> pd.DataFrame:
    """Gates, places, modality weights and the transcript plan's queries of each text; those of an empty text for null."""
    rows = []
    for t in texts:
        t = (t or "").strip()
        p = I.transcript_plan(t)
        rows.append((I.is_action_chain(t), I.should_expand(t), I.looks_long(t), spatial(t), modality_weights(t), p.queries, p.strict))
    return pd.DataFrame(rows, columns=SIGNALS.names)


def query_signals_udf(s, d):
    q = table(s, d, "kis_dev").select("kis_id", signals_of("query").alias("x"))
    return q.select("kis_id", "x.chain", "x.expand", "x.long", F.array_join("x.places", "|").alias("places"), *(F.col("x.weights")[k].alias(k) for k in ("visual", "asr", "ocr", "object")), F.array_join("x.queries", "|").alias("queries"), "x.strict")


QUERIES = {"parse_query_udf": parse_query_udf, "expand_query_udtf": expand_query_udtf, "query_signals_udf": query_signals_udf}
SQL: dict[str, str] = {}
