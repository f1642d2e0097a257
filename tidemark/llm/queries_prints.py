"""Query op10."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd

from tidemark.llm.common import table
from tidemark.llm.fingerprints import likeness, spell, winnow
from tidemark.llm.neighbour_texts import edited, with_next_text

SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def _rows(frame):
    """Fingerprints of texts, edited texts and the texts that follow."""
    texts = frame["text"].tolist()
    # within a frame the next text is the next row's, but for the last
    changed = [edited(t, x) for t, x in zip(texts, frame["next"])]
    own = list(winnow(texts))
    other = list(winnow(changed))
    last = next(winnow([frame["next"].iloc[-1]]))
    in_order = (frame["next"].iloc[:-1].to_numpy() == frame["text"].iloc[1:].to_numpy()) \
        if len(frame) > 1 else np.zeros(0, bool)
    follow = [own[i + 1] if same else None for i, same in enumerate(in_order)] + [last]
    follow = [f if f is not None else next(winnow([frame["next"].iloc[i]]))
              for i, f in enumerate(follow)]
    sets = [np.unique(h) for h, _ in own]
    yield pd.DataFrame({
        "doc_id": frame["doc_id"], "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": [spell(*x) for x in own],
        "edited_fingerprint": [spell(*x) for x in other],
        "near_edited": [likeness(s, np.unique(h)) for s, (h, _) in zip(sets, other)],
        "near_next": [likeness(s, np.unique(h)) for s, (h, _) in zip(sets, follow)]})


def op10_winnowing_fingerprints(spark, sf_dir):
    return with_next_text(spark, table(spark, sf_dir, "documents"), _rows, SCHEMA)


QUERIES = {f.__name__: f for f in (op10_winnowing_fingerprints,)}
ORACLE: dict[str, str] = {}
