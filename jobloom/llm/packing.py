"""Packing documents into training windows by order-preserving dynamic programming.

A partition holds a contiguous run of documents in id order, as one stream of tokens. Allowed cuts are sentence ends
and document ends (and single tokens where a sentence is longer than a window). f(j), the least cost of packing the
stream up to cut j, is f(i) + padding(j - i) + penalty(j) over the cuts i within one window before j; since padding is
window - (j - i), the best i is the front of a monotone queue of f(i) + i. Window lengths that are a power of two need
no padding and are tried besides.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_bytes, worker_tokenizer

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _powers_behind(cuts: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """For each cut the cuts a power of two (up to the window) before it, shortest first: where its own begin in a list of them."""
    here, there = [], []
    for p in (1 << k for k in range(window.bit_length()) if 1 << k <= window):
        at = np.minimum(np.searchsorted(cuts, cuts - p), len(cuts) - 1)
        hit = np.flatnonzero(cuts[at] == cuts - p)
        here.append(hit)
        there.append(at[hit])
    own, behind = np.concatenate(here), np.concatenate(there)
    order = np.argsort(own, kind="stable")
    return np.searchsorted(own[order], np.arange(len(cuts) + 1)).tolist(), behind[order].tolist()


def choose_cuts(cuts: list[int], penalties: list[float], window: int, final: bool = True) -> list[int]:
    """Cheapest increasing choice of cuts (token positions, first 0) with gaps of at most window; ends at the last cut.

    The padding of the last window counts only if final. Gaps between neighbouring cuts must fit a window.
    """
    n = len(cuts)
    cost, back = [0.0] * n, [0] * n
    near, behind = _powers_behind(np.asarray(cuts, np.int64), window)
    queue: deque[int] = deque([0])
    for j in range(1, n):
        c = cuts[j]
        while cuts[queue[0]] < c - window:
            queue.popleft()
        if j == n - 1 and not final:  # the stream goes on: what is left over is packed with what follows
            i = min(queue, key=lambda k: cost[k])
            best = cost[i]
        else:
            i = queue[0]
            best = cost[i] + window - (c - cuts[i])
            for k in behind[near[j] : near[j + 1]]:
                if cost[k] < best:
                    i, best = k, cost[k]
        cost[j], back[j] = best + penalties[j], i
        key = cost[j] + c
        while queue and cost[queue[-1]] + cuts[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    chosen, j = [], n - 1
    while j:
        chosen.append(cuts[j])
        j = back[j]
    return chosen[::-1]


def split_tail(length: int, window: int, penalty: float) -> list[int]:
    """A window's pieces: itself, or powers of two where those cuts cost less than its padding."""
    if length == 0 or length & (length - 1) == 0 or window - length <= (length.bit_count() - 1) * penalty:
        return [length] if length else []
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


def _pack(tokenizer: str, end_id: int, window: int, cut_penalty: float, token_penalty: float, segment: int):
    def run(batches: Iterator) -> Iterator:
        import zlib

        import pandas as pd
        from pyspark import TaskContext

        encoder = worker_tokenizer(tokenizer)
        vocab = encoder.lib.get_vocab(with_added_tokens=True)
        ender = np.zeros(max([*vocab.values(), end_id]) + 1, bool)
        ender[[i for t, i in vocab.items() if t.removesuffix("</w>")[-1:] in (".", "!", "?")]] = True
        end, next_id = int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId() << 40

        def packed(docs: list, final: bool):
            """Windows over docs (id, bytes of all ids, first id still to pack); returns rows and what is left over."""
            nonlocal next_id
            sizes = np.array([len(raw) // 4 - at for _, raw, at in docs], np.int64)
            ends = np.cumsum(sizes)
            total = int(ends[-1])
            ids = np.concatenate([np.frombuffer(raw, "<u4")[at:] for _, raw, at in docs])
            is_cut = ender[ids]
            is_cut[ends - 1] = True
            at = np.concatenate([[0], np.flatnonzero(is_cut) + 1])
            gaps = np.flatnonzero(np.diff(at) > window)
            if len(gaps):  # sentences beyond a window: any whole number of windows into them
                at = np.sort(np.concatenate([at, *(np.arange(at[g] + window, at[g + 1], window) for g in gaps)]))
            at_end = np.isin(at, ends)
            penalty = np.where(at_end, 0.0, cut_penalty)
            chosen = choose_cuts(at.tolist(), penalty.tolist(), window, final)
            bounds = [0]
            for c in chosen[:-1] if not final else chosen:
                for piece in split_tail(c - bounds[-1], window, token_penalty) if final else [c - bounds[-1]]:
                    bounds.append(bounds[-1] + piece)
            rows, d, begin = [], 0, 0
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                p = lo
                while p < hi:
                    while ends[d] <= p:
                        begin, d = int(ends[d]), d + 1
                    doc, raw, skipped = docs[d]
                    q = min(hi, int(ends[d]))
                    a, b = p - begin + skipped, q - begin + skipped
                    rows.append((doc, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), len(raw) // 4, next_id, p - lo))
                    p = q
                next_id += 1
            left, done = [], bounds[-1]
            if done < total:
                d = int(np.searchsorted(ends, done, "right"))
                before = int(ends[d]) - int(sizes[d])
                left = [(docs[d][0], docs[d][1], docs[d][2] + done - before), *docs[d + 1 :]]
            return rows, left

        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({c: "Int64" if c == "doc_id" else "int64" for c in columns})
        held: list = []
        waiting = 0
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                some = batch.iloc[lo : lo + 1024]
                for doc, raw in zip(some["doc_id"].astype("Int64").tolist(), encoder.encode(some["text"].tolist()), strict=True):
                    held.append((doc, raw + end, 0))
                    waiting += len(raw) // 4 + 1
                if waiting >= segment:
                    rows, held = packed(held, False)
                    waiting = sum(len(raw) // 4 - at for _, raw, at in held)
                    yield frame(rows)
        if held:
            yield frame(packed(held, True)[0])

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, window: int = 4096, cut_penalty: float = 4.0, token_penalty: float = 32.0,
    doc_id: str = "doc_id", text: str = "text", part_bytes: int = 24 << 20, segment: int = 1 << 18,
) -> DataFrame:
    """Pieces of windows: `doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`.

    Costs are padding tokens plus cut_penalty for a window that ends inside a document at a sentence end, and
    token_penalty for each cut at no boundary; those are made only in the last window of a partition, into powers of
    two. Null texts are empty and hold the end id alone; repeated rows are packed each; null ids come first; other
    columns are not read; an empty table gives no rows. A partition packs segments of the given tokens one after
    another and carries what is left over into the next, so memory does not grow with the partition or its longest run.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = max(1, -(-text_bytes(rows) // part_bytes))
    order = [F.col("doc_id"), F.xxhash64("text")]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return placed.mapInPandas(_pack(tokenizer, end_id, window, cut_penalty, token_penalty, segment), SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, "word_bpe_49k.json", 2)
