"""Operator 1: token counts attributed to sections by offsets.

Each document is encoded once as a whole. The byte span of every token is joined with the byte spans of the document's sections
by binary search on both sorted sequences. A token that touches several sections is allocated by an explicit rule.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.bpe import RANKS, encode_text, encoding
from quadloom.llm.common import slices, small_batches, table, text_of

RULES = ("majority", "first", "last")
#: The section number of tokens that touch no section.
OUTSIDE = -1


def line_sections(text: str) -> list[tuple[int, int]]:
    """Character spans of the lines; the line ends themselves lie in no section."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def attribute(token_ends, starts, ends, rule: str = "majority"):
    """Per token the index of its section, or OUTSIDE, and whether it touches two or more sections.

    token_ends: cumulative byte ends of the tokens; starts, ends: byte spans of disjoint sections in ascending order, none empty.
    majority: the section with most of the token's bytes, the earlier one at a tie; first, last: the first or last one touched.
    """
    import numpy as np

    token_ends = np.asarray(token_ends, np.int64)
    token_starts = np.concatenate([np.zeros(1, np.int64), token_ends[:-1]]) if len(token_ends) else token_ends
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    first = np.searchsorted(ends, token_starts, "right")
    last = np.searchsorted(starts, token_ends, "left") - 1
    crossing = last > first
    owner = np.where(last < first, OUTSIDE, last if rule == "last" else first)
    if rule == "majority":
        for t in np.nonzero(crossing)[0]:
            k = np.arange(first[t], last[t] + 1)
            owner[t] = k[np.argmax(np.minimum(ends[k], token_ends[t]) - np.maximum(starts[k], token_starts[t]))]
    return owner, crossing


def section_token_counts(docs: DataFrame, rule: str = "majority", sections: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row per document and section: doc_id, section, start_char, end_char, n_tokens, n_crossing.

    sections: a column array<struct<start:int,end:int>> of character spans; None takes the lines. Spans are clipped to the text
    and to the end of the span before, in order of start. Section -1 holds the tokens that touch no section, and its row is there
    for every document, so a document's counts always add up to its tokens. n_crossing: the tokens of the section that touch
    another one as well. A null text counts as empty, a null span list as no section; empty sections count 0.
    """
    if rule not in RULES:
        raise ValueError(f"rule: one of {RULES}")
    path = ranks_path or public_tokenizers.path(RANKS)
    names = ["section", "start_char", "end_char", "n_tokens", "n_crossing"]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in names)])
    given = sections is not None
    picked = small_batches(docs).select("doc_id", text_of(docs).alias("text"), *([docs[sections].alias("spans")] if given else []))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoding(path)
        length = np.zeros(enc.n_vocab, np.int64)
        for token, i in enc._mergeable_ranks.items():
            length[i] = len(token)
        for batch in slices(batches, "text"):
            at, cols = [], [[] for _ in names]
            texts = batch.column(1).to_pylist()
            spans = batch.column(2).to_pylist() if given else [None] * len(texts)
            for row, (text, own) in enumerate(zip(texts, spans, strict=True)):
                if given:
                    clipped, low = [], 0
                    for a, b in sorted((x["start"], x["end"]) for x in own or [] if x and x["start"] is not None and x["end"] is not None):
                        a, b = max(a, low), min(b, len(text))
                        clipped.append((min(a, len(text)), max(min(a, len(text)), b)))
                        low = clipped[-1][1]
                else:
                    clipped = line_sections(text)
                raw = text.encode()
                chars = np.array(clipped, np.int64).reshape(-1, 2)
                if len(raw) == len(text):
                    spans_b = chars
                else:  # byte place of each character
                    place = np.append(np.nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[0], len(raw))
                    spans_b = place[chars]
                full = np.nonzero(spans_b[:, 1] > spans_b[:, 0])[0]
                token_ends = np.cumsum(length[np.frombuffer(encode_text(enc, text), np.uint32)])
                owner, crossing = attribute(token_ends, spans_b[full, 0], spans_b[full, 1], rule)
                target = np.where(owner < 0, len(chars), full[owner] if len(full) else len(chars))
                counts, cross = (np.bincount(x, minlength=len(chars) + 1) for x in (target, target[crossing]))
                at += [row] * (len(chars) + 1)
                for col, x in zip(cols, (range(len(chars)), chars[:, 0], chars[:, 1], counts, cross), strict=True):
                    col.extend(map(int, x))
                for col, x in zip(cols[:3], (OUTSIDE, 0, len(text)), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in cols)], ["doc_id", *names])

    return picked.mapInArrow(run, schema)


def op1_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_token_counts(table(spark, sf_dir, "documents"))


def per_document(counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens over all sections."""
    return counts.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"))
