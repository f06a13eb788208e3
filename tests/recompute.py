"""Results of queries without SQL, computed again on the driver from the same tables."""

from __future__ import annotations

import numpy as np

from sparkmoment.functions import intents as I, querytext as Q


def plans(c, rows):
    want = {}
    for i, t in c.sql("SELECT kis_id, query FROM kis_dev").fetchall():
        p = Q.plan(t)
        want[i] = {k: p[k] if isinstance(p[k], str) else "|".join(p[k]) for k in ("language", "entities", "actions", "colours", "events", "roles", "constraints", "complexity")}
    return {r["kis_id"]: {k: v for k, v in r.items() if k != "kis_id"} for r in rows} == want, "plans text by text"


def expansions(c, rows):
    want = {(i, k, v) for i, t in c.sql("SELECT event_id, coalesce(en_text, vi_text) FROM notebook_events").fetchall() for k, v in enumerate(Q.variants((t or "").strip()))}
    return {(r["event_id"], r["pos"], r["variant"]) for r in rows} == want and len(rows) == len(want), "variants text by text"


def neighbours(c, rows):
    got = c.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, v = np.array([i for i, _ in got]), np.array([x for _, x in got], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    at = {i: n for n, i in enumerate(ids.tolist())}
    asked = [i for i in ids.tolist() if i % 20 == 0]
    best = {(q, int(ids[j])) for q in asked for j in np.lexsort((ids, -(v @ v[at[q]])))[:20]}
    found = {(r["query_id"], r["vector_id"]) for r in rows}
    exact = all(abs(r["score"] - v[at[r["query_id"]]] @ v[at[r["vector_id"]]]) < 1e-5 for r in rows)
    recall = len(best & found) / len(best)
    return exact and recall >= 0.9 and len(found) == len(rows) == 20 * len(asked), f"recall {recall:.3f}"


def signals(c, rows):
    want = {}
    for i, t in c.sql("SELECT kis_id, query FROM kis_dev").fetchall():
        t = (t or "").strip()
        w, p = Q.modality_weights(t), I.transcript_plan(t)
        want[i] = {"chain": I.is_action_chain(t), "expand": I.should_expand(t), "long": len(t.split()) >= 12, "places": "|".join(Q.spatial(t)), **{k: w[k] for k in ("visual", "asr", "ocr", "object")}, "queries": "|".join(p.queries), "strict": p.strict}
    return {r["kis_id"]: {k: v for k, v in r.items() if k != "kis_id"} for r in rows} == want, "signals text by text"


CHECKS = {"query_signals_udf": signals, "parse_query_udf": plans, "expand_query_udtf": expansions, "ann_every": neighbours}
