"""The context tree does the whole job: full depth, every node, a distributed tree equal to the plain one."""

import random
import zlib

import numpy as np

from jobloom.llm import lm


def test_the_seventh_byte_back_counts():
    docs = [b"a123456x"] * 50 + [b"b123456y"] * 50
    level, nodes = lm.counted(lm.packed_grams(docs)[0]), []
    for _ in range(lm.DEPTH + 1):
        nodes.insert(0, lm.nodes_of(*level, 1))
        level = lm.counted(lm.shortened(level[0]), level[1])
    p = 10 ** lm.ContextTree(nodes).log10(lm.packed_grams([b"a123456x"])[0])
    assert p[-2] > 0.9  # x after a123456: six bytes alone give x and y one half each


def test_scores_equal_the_plain_tree_of_every_node(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(400)]  # over 2**19 training bytes, from where single contexts used to be dropped
    got = lm.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block_bytes=1 << 17, bucket_bytes=1 << 16).toPandas().set_index("doc_id")
    docs = lm.streams(texts)
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(docs))]
    level, nodes = lm.counted(lm.packed_grams([d for d, h in zip(docs, held) if not h])[0]), []
    for _ in range(lm.DEPTH + 1):
        nodes.insert(0, lm.nodes_of(*level, 1))
        level = lm.counted(lm.shortened(level[0]), level[1])
    tree = lm.ContextTree(nodes)
    assert sum(len(d) + 1 for d, h in zip(docs, held) if not h) > 1 << 19
    assert len(got) == len(docs) and (got.held_out.sort_index() == held).all()
    for i in (0, 1, held.index(True), 399):
        grams = np.sort(lm.packed_grams([docs[i]])[0])
        want = tree.log10(grams).sum()
        assert abs(got.score[i] - want) < 1e-6 * abs(want), (i, got.score[i], want)
