"""Results of the llm queries without SQL, computed again on the driver."""

from __future__ import annotations

import numpy as np

from sparkmoment.llm import tokenize as TK


def _vectors(c):
    by = {}
    for i, version, v in c.sql("SELECT vector_id, embedding_version, vec FROM manifest_siglip2 JOIN siglip2_meta USING (embedding_version) WHERE len(vec) = embedding_dim").fetchall():
        if None not in v and np.isfinite(v).all() and np.any(v):
            by.setdefault(version, []).append((i, v))
    for rows in by.values():
        rows.sort()
        x = np.array([v for _, v in rows], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids = np.array([i for i, _ in rows])
        s = np.round(x @ x.T, 9)
        np.fill_diagonal(s, -2)
        yield ids, s


def nearest(c, rows):
    want = {(int(ids[a]), int(ids[b])) for ids, s in _vectors(c) for a in range(len(ids)) for b in np.argsort(-s[a], kind="stable")[:5] if a != b}
    got = {(r["id"], r["other"]) for r in rows}
    recall = len(want & got) / len(want)
    return len(got) == len(rows) and recall >= 0.95, f"recall {recall:.4f}"


def pairs(c, rows):
    want = {(min(i, j), max(i, j)) for ids, s in _vectors(c) for a in range(len(ids)) for b in np.argsort(-s[a], kind="stable")[:5] if a != b for i, j in [(int(ids[a]), int(ids[b]))]}
    got = {(r["vector_id_a"], r["vector_id_b"]) for r in rows}
    recall = len(want & got) / len(want)
    return len(got) == len(rows) and recall >= 0.95 and len(got - want) <= 0.05 * len(got), f"recall {recall:.4f}"


def ids(c, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TK.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = c.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    want = {i: e.ids for (i, _), e in zip(texts, t.encode_batch([x for _, x in texts], add_special_tokens=False))}
    return {r["doc_id"]: list(r["ids"]) for r in rows} == want and len(rows) == len(want), "equal to the library"


CHECKS = {"p6_found": pairs, "p6_nearest": nearest, "p8_ids": ids}
